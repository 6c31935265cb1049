"""Registry of queries and the SQL each is checked against."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from graphlens.session import scratch_path

from workload import views

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
MODULES: dict[str, list[str]] = {}


# Views that stand for stored tables of the service. They are written once per
# session and input folder under the shared folder, as an ingest would leave them.
STORED = {
    "v_functions", "v_files", "v_classes", "v_call_sites", "v_calls", "v_imports", "v_definitions",
}
_written: dict[tuple[str, str, str], tuple[str, StructType]] = {}


class Bed:
    """The test tables of one directory, and the views derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.dir = sf_dir.rstrip("/")
        self._made: dict[str, DataFrame] = {}

    def table(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
        return self._made[name]

    def view(self, name: str) -> DataFrame:
        if name not in self._made:
            sql = views.SPARK.get(name, views.SHARED.get(name))
            used = {
                word: self.table(word) if word in TABLES else self.view(word)
                for word in dict.fromkeys(re.findall(r"\{(\w+)\}", sql))
            }
            build = lambda: self.spark.sql(sql, **used)
            self._made[name] = self.stored(name, build) if name in STORED else build()
        return self._made[name]

    def stored(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        """The table `name`, built and written on first use in this session."""
        key = (self.spark.sparkContext.applicationId, self.dir, name)
        if key not in _written:
            path = scratch_path(self.spark, name)
            df = build()
            df.write.parquet(path)
            _written[key] = (path, df.schema)
        path, schema = _written[key]
        return self.spark.read.schema(schema).parquet(path)

    def as_of(self):
        """The newest event time: the log's own clock, never the wall clock."""
        from pyspark.sql import functions as F

        return self.table("events").agg(F.max("ts")).first()[0]


def _closure(sql: str) -> list[str]:
    """Views named in `sql`, dependencies first."""
    out: list[str] = []

    def visit(text: str) -> None:
        for word in re.findall(r"\bv_\w+\b", text):
            body = views.DUCK.get(word, views.SHARED.get(word))
            if body is not None and word not in out:
                visit(body)
                if word not in out:
                    out.append(word)

    visit(sql)
    return out


def expand(sql: str) -> str:
    """Prefix `sql` with the views it names, as one statement."""
    ctes = []
    for name in _closure(sql):
        body = views.DUCK.get(name, views.SHARED.get(name))
        ctes.append(f"{name} AS ({re.sub(r'[{](\w+)[}]', r'\1', body).strip()})")
    body = sql.strip()
    own = re.match(r"WITH\s+(?:RECURSIVE\s+)?", body, re.IGNORECASE)
    if own:
        body = body[own.end():]
        return "WITH RECURSIVE " + ",\n".join([*ctes, body]) if ctes else "WITH RECURSIVE " + body
    return ("WITH RECURSIVE " + ",\n".join(ctes) + "\n" + body) if ctes else body


def query(name: str, sql: str | None = None):
    """Register a query; `sql` may name the views of `workload.views` freely."""

    def wrap(fn: Callable[[Bed], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Bed(spark, sf_dir))
        MODULES.setdefault(fn.__module__.rsplit(".", 1)[-1], []).append(name)
        if sql is not None:
            ORACLES[name] = expand(sql)
        return fn

    return wrap
