"""A stored index of vectors by cell: cosine search that opens the cells a bound cannot rule out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphlens.session import cut, exists

MOST_CELLS = 4096
CELLS_PER_PART = 64
ITEMS, QUERIES = 1024, 512
FIRST_CELLS = 4
SLACK = 1e-9


def _unit(vectors: pd.Series) -> np.ndarray:
    """Vectors as rows of length one; nan where a vector has no length."""
    m = np.array([np.asarray(v, float) for v in vectors])
    with np.errstate(invalid="ignore", divide="ignore"):
        return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def _angle(cosine: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(cosine, -1, 1))


class VectorIndex:
    """The index under `root`, filled batch by batch.

    Centres are at most 4096 of the vectors (those with the smallest hashes of their
    id, four times the square root of their number), chosen once. `blocks` has up to
    1024 vectors of a cell and group a row, with their greatest angle to the centre;
    blocks lie by cell, 64 cells to a folder, so a search opens those it needs.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def build(self, items: DataFrame) -> None:
        """Choose centres among the items (item_id, grp, vector) and store all of them."""
        has_length = F.exists("vector", lambda x: x != 0) & ~F.exists("vector", lambda x: x.isNull() | F.isnan(x.cast("double")))
        usable = items.where(has_length)
        n = min(MOST_CELLS, max(1, int(4 * usable.count() ** 0.5)))
        chosen = usable.select("item_id", "vector").orderBy(F.xxhash64("item_id"), "item_id").limit(n)
        numbered = chosen.withColumn("cell", F.row_number().over(Window.orderBy(F.xxhash64("item_id"), "item_id")) - 1)  # of 4096 at most
        numbered.select("cell", F.col("vector").cast("array<double>").alias("vector")).write.parquet(f"{self.root}/centres")
        self.add(0, usable)

    def _centres(self) -> np.ndarray:
        rows = self.spark.read.parquet(f"{self.root}/centres").orderBy("cell").collect()
        return _unit(pd.Series([r.vector for r in rows])) if rows else np.zeros((0, 1))

    def add(self, batch: int, items: DataFrame) -> None:
        """Store items as a batch of their own; one that is written again replaces it. Vectors without a length are left out."""
        centres = self.spark.sparkContext.broadcast(self._centres())
        kinds = items.schema
        placed = T.StructType([
            T.StructField("item_id", kinds["item_id"].dataType), T.StructField("grp", T.StringType()), T.StructField("cell", T.IntegerType()),
            T.StructField("angle", T.DoubleType()), T.StructField("vector", T.ArrayType(T.DoubleType())),
        ])

        def place(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in parts:
                pdf = pdf[pdf["vector"].notna()]
                if not len(pdf) or not len(centres.value):
                    continue
                unit = _unit(pdf["vector"])
                good = np.isfinite(unit).all(axis=1)
                pdf, unit = pdf[good], unit[good]
                if not len(pdf):
                    continue
                scores = unit @ centres.value.T
                cell = scores.argmax(axis=1)
                yield pd.DataFrame({
                    "item_id": pdf["item_id"].to_numpy(), "grp": pdf["grp"].to_numpy(), "cell": cell.astype(np.int32),
                    "angle": _angle(scores[np.arange(len(cell)), cell]), "vector": list(unit),
                })

        blocks = T.StructType([
            T.StructField("cell", T.IntegerType()), T.StructField("grp", T.StringType()), T.StructField("n", T.IntegerType()), T.StructField("radius", T.DoubleType()),
            T.StructField("ids", T.ArrayType(kinds["item_id"].dataType)), T.StructField("vectors", T.BinaryType()),
        ])

        def pack(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in parts:  # sorted by cell and group
                made: list[tuple] = []
                for (cell, grp), some in pdf.groupby(["cell", "grp"], sort=False, dropna=False):
                    for at in range(0, len(some), ITEMS):
                        own = some.iloc[at : at + ITEMS]
                        vectors = np.stack(own["vector"].to_numpy()).astype(float).tobytes()
                        made.append((cell, None if pd.isna(grp) else grp, len(own), own["angle"].max(), own["item_id"].to_numpy(), vectors))
                if made:
                    yield pd.DataFrame(made, columns=["cell", "grp", "n", "radius", "ids", "vectors"])

        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        sorted_in = (
            items.select("item_id", F.col("grp").cast("string").alias("grp"), F.col("vector").cast("array<double>").alias("vector")).mapInPandas(place, placed)
            .repartitionByRange(n, "cell", "grp", "item_id").sortWithinPartitions("cell", "grp")
        )
        sorted_in.mapInPandas(pack, blocks).withColumn("part", F.floor(F.col("cell") / CELLS_PER_PART).cast("int")).withColumn("batch", F.lit(batch)).write.mode(
            "overwrite"
        ).option("partitionOverwriteMode", "dynamic").partitionBy("part", "batch").parquet(f"{self.root}/blocks")

    def _cells(self, grouped: bool) -> DataFrame:
        """Per group (or for all) the cells that have members: their number and greatest angle; 4096 at most each."""
        blocks = self.spark.read.parquet(f"{self.root}/blocks")
        key = F.coalesce("grp", F.lit("")) if grouped else F.lit("")
        cells = blocks.groupBy(key.alias("key"), "cell").agg(F.sum("n").alias("n"), F.max("radius").alias("radius"))
        return cells.groupBy("key").agg(F.collect_list(F.struct("cell", "n", "radius")).alias("cells"))

    def _probes(self, asked: DataFrame, limit: int, first: bool) -> DataFrame:
        """(query_id, key, vector, cell): the cells to open, the nearest ones first, then those that may hold better items than the kth."""
        centres = self.spark.sparkContext.broadcast(self._centres())
        schema = T.StructType([asked.schema["query_id"], asked.schema["key"], T.StructField("vector", T.ArrayType(T.DoubleType())), T.StructField("cell", T.IntegerType())])

        def choose(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in parts:
                made: list[tuple] = []
                for query, key, vector, cells, *kth in zip(*(pdf[c] for c in ("query_id", "key", "vector", "cells", *(() if first else ("kth",)))), strict=True):
                    unit = _unit(pd.Series([vector]))[0]
                    if not np.isfinite(unit).all():
                        continue
                    number = np.array([c["cell"] for c in cells])
                    far = _angle(centres.value[number] @ unit)
                    order = np.lexsort((number, far))
                    held = np.cumsum(np.array([c["n"] for c in cells])[order])
                    near = max(FIRST_CELLS, int(np.searchsorted(held, limit)) + 1)
                    if first:
                        taken = order[:near]
                    else:
                        rest = order[near:]
                        radius = np.array([c["radius"] for c in cells])[rest]
                        taken = rest[far[rest] - radius <= _angle(np.array(kth[0])) + SLACK]
                    made += [(query, key, unit, int(c)) for c in number[taken]]
                if made:
                    yield pd.DataFrame(made, columns=["query_id", "key", "vector", "cell"])

        return asked.mapInPandas(choose, schema)

    def _met(self, probes: DataFrame, limit: int, grouped: bool, queries: int) -> DataFrame:
        """The best `limit` of the opened cells per query and block: (query_id, item_id, score)."""
        stored = self.spark.read.parquet(f"{self.root}/blocks")
        opened = [r.cell for r in probes.select("cell").distinct().collect()]  # 4096 at most
        stored = stored.where(F.col("part").isin(sorted({c // CELLS_PER_PART for c in opened})) & F.col("cell").isin(opened))
        key = F.coalesce("grp", F.lit("")) if grouped else F.lit("")
        deal = F.pmod(F.xxhash64("query_id"), F.lit(-(-queries // QUERIES))).alias("deal")
        asked = probes.groupBy("cell", "key", deal).agg(F.collect_list(F.struct("query_id", "vector")).alias("asked"))
        both = stored.withColumn("key", key).join(asked, ["cell", "key"]).select("ids", "vectors", "asked")
        schema = T.StructType([probes.schema["query_id"], T.StructField("item_id", stored.schema["ids"].dataType.elementType), T.StructField("score", T.DoubleType())])

        def best(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in parts:
                made: list[tuple] = []
                for ids, vectors, asked in zip(pdf["ids"], pdf["vectors"], pdf["asked"], strict=True):
                    m = np.frombuffer(vectors).reshape(len(ids), -1)
                    q = np.array([a["vector"] for a in asked])
                    ids, k = np.asarray(ids), min(limit, len(ids))
                    for a, unit, row in zip(asked, q, q @ m.T, strict=True):
                        # products depend on where a row stands in the matrix; the best are summed again one by one, so that equal vectors tie
                        some = np.flatnonzero(row >= -np.partition(-row, k - 1)[k - 1] - SLACK)
                        exact = (m[some] * unit).sum(axis=1)
                        top = np.lexsort((ids[some], -exact))[:limit]
                        made += zip([a["query_id"]] * len(top), ids[some][top], exact[top], strict=True)
                if made:
                    yield pd.DataFrame(made, columns=["query_id", "item_id", "score"])

        return both.mapInPandas(best, schema)

    def search(self, queries: DataFrame, limit: int = 10, grouped: bool = False) -> DataFrame:
        """The `limit` items closest to each query (query_id, vector; grp if `grouped`): (query_id, item_id, score, rank).

        Exact: a query first opens its nearest cells, until they hold `limit` items;
        then those whose nearest possible member, by the angle to the centre less the
        cell's greatest, is not beyond the kth found. With `grouped`, a query sees its
        own group only, from the start. Ties go to the smaller id. Vectors without a
        length find nothing and are not found.
        """
        key = F.coalesce(F.col("grp").cast("string"), F.lit("")) if grouped else F.lit("")
        asked = queries.select("query_id", key.alias("key"), F.col("vector").cast("array<double>").alias("vector")).where("vector is not null")
        order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "item_id")
        if not exists(self.spark, f"{self.root}/blocks") or not self._centres().size:
            none = asked.limit(0).select("query_id", F.lit(0).cast("long").alias("item_id"), F.lit(0.0).alias("score"))
            return none.withColumn("rank", F.row_number().over(order))
        asked = cut(asked.join(self._cells(grouped), "key"))
        n = max(1, asked.count())
        near = cut(self._met(self._probes(asked, limit, True), limit, grouped, n).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit))
        kth = near.groupBy("query_id").agg(F.when(F.count("*") == limit, F.min("score")).otherwise(-1.0).alias("kth"))
        more = cut(self._probes(asked.join(kth, "query_id"), limit, False))
        found = near.drop("rank").unionByName(self._met(more, limit, grouped, n))
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= limit)
