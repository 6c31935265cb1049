"""A stored code graph that a batch of files changes at the cost of the change.

Rows that belong to a file, and its calls, lie in buckets of its path; who bears a
name, and which buckets of paths call it, lies in buckets of the name. Call edges are
held by name: a caller and the name it calls are one row, whatever the number of
functions that bear the name, and caller and bearers are joined where the graph is
read. So a batch replaces the buckets of its files and of the names that its files
bear or call anew or no longer, and what is stored grows with callers plus bearers.
"""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlens.operators.maintain import purge_files
from graphlens.operators.resolve import NamedCalls
from graphlens.plans.incremental import Graph
from graphlens.session import children, cut, exists, forget, remove
from graphlens.sources.trees import fingerprint, snapshot_diff
from graphlens.tables import SCHEMAS

FILES_PER_BUCKET = 256
NAMES_PER_FILE = 2
MOST_PATHS = 4096

OF_FILES = ("files", "functions", "classes", "imports", "call_sites")
EDGES = "repo_id string, file_path string, name string, src string, line int"  # src calls the name, whoever bears it
OF_NAMES = {
    "bearers": "repo_id string, name string, fn string, file_path string",
    "callers": "repo_id string, name string, place int",  # a bucket of paths with files that call the name
}
# an edge refined by definition stands in the bucket of either end
REFINED = "repo_id string, node string, src string, dst string, line int"
STORED = {**{t: SCHEMAS[t] for t in OF_FILES}, "edges": EDGES, **OF_NAMES, "refined": REFINED}
LAYOUT = "repo_id string, buckets int"


def path_column(table: str) -> str:
    return "path" if table == "files" else "file_path"


def bucket(key: str, times: int = 1) -> Column:
    """Bucket of a key in a repo with `buckets` buckets of paths."""
    return F.pmod(F.xxhash64(key), F.col("buckets") * times).cast("int").alias("bucket")


@dataclass
class Touched:
    """The buckets (repo_id, bucket) a batch touches; listed where they are few."""

    rows: DataFrame
    listed: list[tuple[str, int]] | None

    @classmethod
    def of(cls, keys: DataFrame) -> Touched:
        """Buckets of the keys (repo_id, bucket)."""
        spark, rows = keys.sparkSession, keys.select("repo_id", "bucket").distinct()
        few = [tuple(r) for r in rows.limit(MOST_PATHS + 1).collect()]
        if len(few) > MOST_PATHS:
            return cls(cut(rows), None)
        return cls(spark.createDataFrame(few, "repo_id string, bucket int"), few)


class Store:
    """The tables under a folder, by repo and bucket."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root
        self._escape = spark._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName

    def _folder(self, table: str, repo: str, number: int | None = None) -> str:
        repo = self._escape(repo) if repo else "__HIVE_DEFAULT_PARTITION__"
        return f"{self.root}/{table}/repo_id={repo}" + ("" if number is None else f"/bucket={number}")

    def layout(self) -> DataFrame:
        path = f"{self.root}/layout"
        return self.spark.read.schema(LAYOUT).parquet(path) if exists(self.spark, path) else self.spark.createDataFrame([], LAYOUT)

    def settle(self, files: DataFrame) -> DataFrame:
        """The layout with the repos of `files` (repo_id); a new one gets a bucket for every 256 files it has now."""
        path, known = f"{self.root}/layout", self.layout()
        new = files.groupBy("repo_id").agg(F.count("*").alias("n")).join(known, "repo_id", "left_anti").select(
            "repo_id", F.expr(f"cast(power(2, ceil(log2(greatest(ceil(n / {FILES_PER_BUCKET}), 1)))) as int)").alias("buckets")
        )
        if not exists(self.spark, path) or new.limit(1).count():
            new.write.mode("append").parquet(path)
        return self.layout()

    def rows(self, table: str, touched: Touched | None = None) -> DataFrame:
        """A table with its buckets: all of it, or what lies in the touched ones. Only these are listed and opened."""
        schema, top = f"{STORED[table]}, bucket int", f"{self.root}/{table}"
        paths = [top] if exists(self.spark, top) else []
        if touched is not None and touched.listed is not None:
            there = {repo: set(children(self.spark, self._folder(table, repo))) for repo in {r for r, _ in touched.listed}}
            paths = [self._folder(table, r, b) for r, b in touched.listed if f"bucket={b}" in there[r]]
        if not paths:
            return self.spark.createDataFrame([], schema)
        found = self.spark.read.schema(schema).option("basePath", top).parquet(*paths)
        if touched is not None and touched.listed is None:
            found = found.join(touched.rows, ["repo_id", "bucket"], "left_semi")
        return found

    def stage(self, table: str, rows: DataFrame) -> DataFrame:
        """Rows of a table (with buckets), stored on the side, as they come from the buckets they are to replace."""
        names = [f.split()[0] for f in STORED[table].split(", ")]
        return cut(rows.select(*[rows[c] if c in rows.columns else F.lit(None).alias(c) for c in names], "bucket").repartition("repo_id", "bucket"))

    def put(self, table: str, staged: DataFrame, touched: Touched) -> DataFrame:
        """Put staged rows in place of the touched buckets."""
        staged.repartition("repo_id", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            "repo_id", "bucket"
        ).parquet(f"{self.root}/{table}")
        left = staged.select("repo_id", "bucket").distinct()
        if touched.listed is None:
            emptied = touched.rows.join(left, ["repo_id", "bucket"], "left_anti").toLocalIterator()
        else:
            emptied = set(touched.listed) - {tuple(r) for r in left.collect()}
        for repo, number in emptied:
            if exists(self.spark, self._folder(table, repo, number)):
                remove(self.spark, self._folder(table, repo, number))
        return staged

    def replace(self, table: str, rows: DataFrame, touched: Touched) -> DataFrame:
        return self.put(table, self.stage(table, rows), touched)


def _all(*calls):
    """Run independent steps at once: each is a job of a few small tasks."""
    with ThreadPoolExecutor(len(calls)) as pool:
        return [f.result() for f in [pool.submit(c) for c in calls]]


def apply_batch(root: str, batch: DataFrame) -> None:
    """Upsert the files of one batch (repo_id, path, content, seq): of a file sent twice, the last one sent counts.

    A row without content means the file was removed. All state is in the tables
    under `root`, so a stream may be started anew at any time. Names and edges are
    brought up to date before the rows of files, and fingerprints come last: a batch
    that broke off finds its files still to do, and what they bore and called still
    known, when it is replayed; one that is replayed after it was done changes nothing.
    """
    spark = batch.sparkSession
    store = Store(spark, root)
    sent = cut(batch.groupBy("repo_id", "path").agg(F.max_by("content", "seq").alias("content")))
    layout = store.settle(sent.select("repo_id"))
    placed = lambda df, key, times=1: df.join(layout, "repo_id").withColumn("bucket", bucket(key, times)).drop("buckets")
    named = lambda df: placed(df, "name", NAMES_PER_FILE)

    asked = Touched.of(placed(sent.select("repo_id", "path"), "path"))
    removed = sent.where("content is null").select("repo_id", "path")
    present = sent.where("content is not null")
    known = store.rows("files", asked).drop("bucket").join(sent.select("repo_id", "path"), ["repo_id", "path"], "left_semi")
    states = snapshot_diff(known.join(removed, ["repo_id", "path"], "left_anti"), fingerprint(present)).where("state <> 'unchanged'")
    todo = cut(states.select("repo_id", "path", F.lit(True).alias("comes")).unionByName(removed.withColumn("comes", F.lit(False))))
    ours = todo.select("repo_id", "path")
    fresh = Graph.of(present.join(todo.where("comes"), ["repo_id", "path"], "left_semi"))
    new = fresh.tables()
    here = Touched.of(placed(ours, "path"))
    own = ["repo_id", "file_path"]
    paths = ours.withColumnRenamed("path", "file_path")

    def renewed(table: str) -> DataFrame:
        kept = purge_files(store.rows(table, here), ours, path_column(table))
        return store.stage(table, kept.unionByName(placed(new[table], path_column(table)), allowMissingColumns=True))

    staged = dict(zip(OF_FILES, _all(*[lambda t=t: renewed(t) for t in OF_FILES]), strict=True))

    # bearers of names that the batch's files gained or lost
    borne = lambda df: df.select("repo_id", "name", F.col("qualified_name").alias("fn"), "file_path").distinct()
    old, now = borne(store.rows("functions", here).join(paths, own, "left_semi")), borne(new["functions"])
    turned = cut(named(old.exceptAll(now).withColumn("comes", F.lit(False)).unionByName(now.exceptAll(old).withColumn("comes", F.lit(True)))))
    key = ["repo_id", "name"]
    names = turned.select(*key, "bucket").distinct()
    of_names = Touched.of(names)
    kept = purge_files(store.rows("bearers", of_names), ours)
    again = named(now).join(of_names.rows, ["repo_id", "bucket"], "left_semi")  # all that the files bear there, as all was purged

    # names that a bucket of paths has begun or ceased to call
    called = lambda df: df.select("repo_id", F.col("callee_name").alias("name"), F.col("bucket").alias("place")).distinct()
    was, calls = called(store.rows("call_sites", here)), called(staged["call_sites"])
    moved = cut(named(was.exceptAll(calls).withColumn("comes", F.lit(False)).unionByName(calls.exceptAll(was).withColumn("comes", F.lit(True)))))
    of_callers = Touched.of(moved)
    others = store.rows("callers", of_callers).join(moved.select(*key, "place"), [*key, "place"], "left_anti")
    bearers, callers = _all(
        lambda: store.replace("bearers", kept.unionByName(again), of_names),
        lambda: store.replace("callers", others.unionByName(moved.where("comes").drop("comes")), of_callers),
    )

    # calls of functions that there are; who bears the names they call is known to the readers
    whole = new["functions"].select(*own, F.col("qualified_name").alias("caller_qname")).distinct()
    on = placed(
        new["call_sites"].join(whole, [*own, "caller_qname"], "left_semi")
        .groupBy(*own, F.col("caller_qname").alias("src"), F.col("callee_name").alias("name")).agg(F.max("line").alias("line")), "file_path",
    )
    stand = purge_files(store.rows("edges", here), ours)
    gone = cut(placed(
        turned.where("not comes").select("repo_id", "fn").distinct().join(bearers.select("repo_id", "fn").distinct(), ["repo_id", "fn"], "left_anti")
        .withColumnRenamed("fn", "node"), "node",
    ))
    edges, _ = _all(lambda: store.replace("edges", stand.unionByName(on.select(*stand.columns)), here), lambda: _drop_refined(store, gone, placed))
    _all(*[lambda t=t: store.put(t, staged[t], here) for t in OF_FILES[1:]])
    store.put("files", staged["files"], here)
    fresh.release()
    forget(sent, todo, turned, moved, bearers, callers, edges, gone, *staged.values())


def _drop_refined(store: Store, gone: DataFrame, placed) -> None:
    """Refined edges go with either end; each stands in two buckets."""
    if not exists(store.spark, f"{store.root}/refined"):
        return
    lost = cut(store.rows("refined", Touched.of(gone)).join(gone, ["repo_id", "node"], "left_semi").select("repo_id", "src", "dst").distinct())
    ends = placed(lost.select("repo_id", F.explode(F.array("src", "dst")).alias("node")), "node")
    touched = Touched.of(ends)
    forget(store.replace("refined", store.rows("refined", touched).join(lost, ["repo_id", "src", "dst"], "left_anti"), touched), lost)


def refine(root: str, refined: DataFrame) -> None:
    """Add edges found by definition (repo_id, src, dst, line); they stand until an end goes."""
    store = Store(refined.sparkSession, root)
    ends = (
        refined.select("repo_id", F.explode(F.array_distinct(F.array("src", "dst"))).alias("node"), "src", "dst", "line")
        .join(store.layout(), "repo_id").withColumn("bucket", bucket("node")).drop("buckets")
    )
    touched = Touched.of(ends)
    kept = store.rows("refined", touched).join(ends.select("repo_id", "src", "dst").distinct(), ["repo_id", "src", "dst"], "left_anti")
    again = ends.groupBy("repo_id", "node", "src", "dst", "bucket").agg(F.max("line").alias("line"))
    forget(store.replace("refined", kept.unionByName(again), touched))


def read(spark: SparkSession, root: str) -> Graph:
    """The graph stored under `root`, whoever wrote it."""
    store = Store(spark, root)
    whole = {t: store.rows(t).drop("bucket") for t in OF_FILES}
    # a function may be defined in several files, each with calls of its own
    sites = store.rows("edges").select("repo_id", F.col("src").alias("caller_qname"), F.col("name").alias("callee_name"), "line")
    named = NamedCalls.of(sites, store.rows("bearers").select("repo_id", "name", F.col("fn").alias("qualified_name")))
    if not exists(spark, f"{root}/refined"):
        return Graph(**whole, calls=named.edges().withColumn("precise", F.lit(False)))
    refined = store.rows("refined").where("node = src").select("repo_id", "src", "dst", "line", F.lit(True).alias("precise"))
    # only edges of a caller and name of which some are refined are held against them
    key = ["repo_id", "src", "name"]
    met = refined.join(named.names, ["repo_id", "dst"]).select(*key).distinct()
    rest = NamedCalls(named.calls.join(met, key, "left_anti"), named.names).edges()
    some = NamedCalls(named.calls.join(met, key, "left_semi"), named.names).edges().join(refined, ["repo_id", "src", "dst"], "left_anti")
    return Graph(**whole, calls=rest.unionByName(some).withColumn("precise", F.lit(False)).unionByName(refined))
