"""A stored inverted index: BM25 search that reads postings of the words asked for, never the texts."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphlens.operators.search import tokens
from graphlens.session import cut, exists, forget

K1, B = 1.2, 0.75
BLOCK = 128
PARTS = 64
DOCS_PER_SLICE = 250_000
FIRST_BLOCKS = 8
SLACK = 1e-6  # scores are rounded to six digits


TABLES = {
    "postings": "token string, grp string, max_tf int, min_length int, n int, docs array<struct<doc:{doc},tf:int,length:int>>, part int, batch int",
    "gone": "doc {doc}, grp string, of int, token string, part int, batch int",
    "tokens": "doc {doc}, grp string, length int, words array<string>, here boolean, part int, batch int",
    "sizes": "grp string, docs bigint, words bigint, batch int",
}


def query_words(query: str) -> list[str]:
    return sorted({w for w in re.split(r"[^\w]+", query.lower()) if w})


def weight(tf: Column, length: Column, average: float) -> Column:
    """BM25 share of a word without its idf: grows with tf, falls with the length."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.lit(average)))


def _runs(worded: DataFrame) -> DataFrame:
    """(doc, grp, length, token, tf) of (doc, grp, words), counted in the row: equal words follow each other once sorted."""
    sorted_ = worded.where(F.size("words") > 0).select("doc", "grp", F.array_sort("words").alias("w")).select(
        "doc", "grp", "w", F.filter(F.sequence(F.lit(1), F.size("w")), lambda i: (i == 1) | (F.get("w", i - 1) != F.get("w", i - 2))).alias("starts")
    )
    end = F.size("w") + 1
    runs = F.transform("starts", lambda s, k: F.struct(F.get("w", s - 1).alias("token"), (F.coalesce(F.get("starts", k + 1), end) - s).alias("tf")))
    return sorted_.select("doc", "grp", F.size("w").alias("length"), F.inline(runs))


class KeywordIndex:
    """The index under `root`, written batch by batch.

    Tables, all by a hash of the token (`part`) and by batch:
    `postings`, blocks of up to 128 documents (doc, tf, length) of a token in a group,
    most frequent and shortest first, with the greatest tf and the least length in
    them; `gone`, what documents that were replaced or removed had in earlier batches.
    By a hash of the document: `tokens`, what each document holds, for its removal.
    `sizes` has documents and words per group and batch, negative for what went.
    A batch only adds files, whatever the index holds; one that is written again
    replaces its own.
    """

    def __init__(self, spark: SparkSession, root: str, parts: int = PARTS, doc_type: str = "bigint"):
        self.spark, self.root, self.parts, self.doc_type = spark, root, parts, doc_type

    def _read(self, table: str) -> DataFrame:
        schema = TABLES[table].format(doc=self.doc_type)
        path = f"{self.root}/{table}"
        return self.spark.read.schema(schema).parquet(path) if exists(self.spark, path) else self.spark.createDataFrame([], schema)

    def _part(self, key: str | Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.parts)).cast("int")

    def _write(self, df: DataFrame, table: str, batch: int, by: str | None = "part") -> None:
        keys = [*([by] if by else []), "batch"]
        df.withColumn("batch", F.lit(batch)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(f"{self.root}/{table}")

    def update(self, batch: int, docs: DataFrame, removed: DataFrame | None = None) -> None:
        """Add the documents (doc, grp, text) and drop what the index has of them and of `removed` (doc).

        Batches are numbered upwards. Null texts are empty; a document that is sent
        twice in one batch is two. Of what is stored, only the parts of `tokens`
        that can hold the documents are read.
        """
        worded = docs.select("doc", "grp", tokens(F.coalesce("text", F.lit(""))).alias("words"))
        twice = cut(docs.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc").alias("again")))
        same, length = F.col("doc").eqNullSafe(F.col("again")), F.size("words").alias("length")
        merged = worded.join(twice, same, "left_semi").select("doc", "grp", length, F.explode("words").alias("token")).groupBy("doc", "grp", "length", "token").agg(
            F.count(F.lit(1)).cast("int").alias("tf")
        )
        counted = _runs(worded.join(twice, same, "left_anti")).unionByName(merged)
        slices = max(1, math.ceil(docs.count() / DOCS_PER_SLICE))
        stale = cut(self._stale(batch, docs.select("doc") if removed is None else docs.select("doc").unionByName(removed.select("doc"))))
        gone = stale.select("doc", "grp", F.col("of"), F.explode("words").alias("token"))
        left = stale.groupBy("grp").agg((-F.count(F.lit(1))).alias("docs"), (-F.sum("length")).alias("words"))
        held = worded.select("doc", "grp", F.size("words").alias("length"), F.array_distinct("words").alias("words"), F.lit(True).alias("here"))
        if removed is not None:
            away = removed.join(docs, "doc", "left_anti").select("doc", F.lit(None).cast("string").alias("grp"), F.lit(0).alias("length"), F.array().cast("array<string>").alias("words"), F.lit(False).alias("here"))
            held = held.unionByName(away.distinct())
        self._write(gone.withColumn("part", self._part("token")).hint("rebalance", "part"), "gone", batch)
        self._write(worded.groupBy("grp").agg(F.count(F.lit(1)).alias("docs"), F.sum(F.size("words")).alias("words")).unionByName(left), "sizes", batch, None)
        self._write(self._blocks(counted.withColumn("part", self._part("token")), slices), "postings", batch)
        self._write(held.withColumn("part", self._part("doc")).hint("rebalance", "part"), "tokens", batch)
        forget(twice, stale)

    def _blocks(self, counted: DataFrame, slices: int) -> DataFrame:
        """Postings (part, doc, grp, token, tf, length) in blocks, in the order in which they are written.

        They are moved once, to their part and a slice of the documents, so that a word
        that every document has is cut into slices as well.
        """
        order = [F.desc("tf"), "length", "doc"]
        dealt = counted.withColumn("slice", F.pmod(F.xxhash64("doc"), F.lit(slices)).cast("int")).repartition("part", "slice")
        inside = Window.partitionBy("part", "slice", "grp", "token").orderBy(*order)
        blocks = (
            dealt.withColumn("block", F.floor((F.row_number().over(inside) - 1) / BLOCK)).groupBy("part", "slice", "grp", "token", "block")
            .agg(F.collect_list(F.struct("doc", "tf", "length")).alias("docs"), F.max("tf").alias("max_tf"), F.min("length").alias("min_length"))
            .select("part", "token", "grp", "max_tf", "min_length", F.size("docs").alias("n"), "docs")
        )
        return blocks.sortWithinPartitions("part", "token", "grp", F.desc("max_tf"), "min_length")

    def _stale(self, batch: int, keys: DataFrame) -> DataFrame:
        """The rows (doc, grp, length, words, of) that earlier batches hold of the documents and no batch has dropped."""
        asked = keys.distinct().withColumn("part", self._part("doc"))
        places = [r.part for r in asked.select("part").distinct().collect()]  # at most `parts`
        had = self._read("tokens").where(F.col("part").isin(places) & (F.col("batch") < batch)).join(asked, ["part", "doc"], "left_semi")
        last = had.groupBy("doc").agg(F.max("batch").alias("batch"))
        return had.join(last, ["doc", "batch"]).where("here").select("doc", "grp", "length", "words", F.col("batch").alias("of"))

    def _of(self, table: str, words: list[str], group: str | None) -> DataFrame:
        """Rows of a table for some words: pruned to their parts, and to the words and the group by the files' statistics."""
        found = self._read(table)
        for_words = found.where(F.col("part").isin([self._part(F.lit(w)) for w in words]) & F.col("token").isin(words))
        return for_words if group is None else for_words.where(F.col("grp") == group)

    def plan(self, query: str, limit: int = 25, group: str | None = None) -> tuple[DataFrame, dict]:
        """The live postings that can matter (token, doc, tf, length, score), and what was found on the way.

        The score of a document is a sum over the words; a block's greatest tf and least
        length bound a word's part in it. The first blocks of each word give a kth
        score that the result cannot fall below. A block is skipped if its own bound
        and the best of all other words stay below that: no document in it can be
        among the first `limit`. Nothing but a row per word and `limit` scores reaches
        the driver.
        """
        words = query_words(query)
        sizes = self._read("sizes")
        size = (sizes if group is None else sizes.where(F.col("grp") == group)).agg(F.sum("docs"), F.sum("words")).first()
        n, average = size[0] or 0, (size[1] or 0) / size[0] if size[0] else 0.0
        if not words or not n or not average:
            return self._scored(self._of("postings", ["", *words], group).where("false"), words, group, {}, 1.0), {"words": []}
        blocks, gone = self._of("postings", words, group), self._of("gone", words, group)
        bound = weight(F.col("max_tf"), F.col("min_length"), average)
        heads = {r.token: r for r in blocks.groupBy("token").agg(
            F.sum("n").alias("n"), F.max(bound).alias("best"), F.min("min_length").alias("shortest"), F.max("max_tf").alias("most"), F.count("*").alias("blocks")
        ).collect()}
        dead = {r.token: r.n for r in gone.groupBy("token").agg(F.count("*").alias("n")).collect()}
        df = {w: heads[w].n - dead.get(w, 0) for w in heads}
        idf = {w: math.log(1 + (n - d + 0.5) / (d + 0.5)) for w, d in df.items() if d > 0}
        top = {w: idf[w] * heads[w].best for w in idf}
        least = 0.0
        if any(heads[w].blocks > FIRST_BLOCKS for w in idf):
            some = None
            for w in idf:
                first = blocks.where(F.col("token") == w).orderBy(bound.desc()).limit(FIRST_BLOCKS)
                some = first if some is None else some.unionByName(first)
            lowest = self._scored(some, list(idf), group, idf, average).groupBy("doc").agg(F.sum("score").alias("score")).orderBy(F.desc("score")).limit(limit)
            least = lowest.agg(F.when(F.count("*") == limit, F.min("score")).otherwise(0.0)).first()[0]
        keep = F.lit(False)
        for w in idf:
            need = least - SLACK - sum(v for u, v in top.items() if u != w)
            keep = keep | ((F.col("token") == w) & (F.col("max_tf") >= self._least_tf(need / idf[w], heads[w], average)) & (bound >= need / idf[w]))
        return self._scored(blocks.where(keep), list(idf), group, idf, average), {"words": list(idf), "least": least, "blocks": sum(h.blocks for h in heads.values()), "keep": keep}

    @staticmethod
    def _least_tf(need: float, head, average: float) -> int:
        """The smallest tf that reaches `need` in the shortest document: what the scan can skip files by."""
        rest = K1 * (1 - B + B * head.shortest / average)
        if need <= 0:
            return 0
        return head.most + 1 if need >= K1 + 1 else max(0, math.ceil(need * rest / (K1 + 1 - need) - 1e-9))

    def _scored(self, blocks: DataFrame, words: list[str], group: str | None, idf: dict[str, float], average: float) -> DataFrame:
        """Live postings of blocks with the part of the score they add."""
        rows = blocks.select("token", "batch", F.explode("docs").alias("d")).select("token", "batch", "d.*")
        if words:
            rows = rows.join(self._of("gone", words, group).select("token", "doc", F.col("of").alias("batch")), ["token", "doc", "batch"], "left_anti")
        part = F.lit(None).cast("double")
        for w, v in idf.items():
            part = F.when(F.col("token") == w, F.lit(v)).otherwise(part)
        return rows.withColumn("score", part * weight(F.col("tf"), F.col("length"), average))

    def search(self, query: str, limit: int = 25, group: str | None = None) -> DataFrame:
        """Best documents (doc, score) for a query by BM25 (k1 1.2, b 0.75), best first; counts are those of the group."""
        found, _ = self.plan(query, limit, group)
        scores = found.groupBy("doc").agg(F.round(F.sum("score"), 6).alias("score"))
        return scores.orderBy(F.col("score").desc(), "doc").limit(limit)

    def compact(self, root: str) -> KeywordIndex:
        """The same index in a new folder as one batch, without what is gone."""
        index = KeywordIndex(self.spark, root, self.parts)
        flat = self._read("postings").select("part", "token", "grp", "batch", F.explode("docs").alias("d")).select("part", "token", "grp", "batch", "d.*")
        # a document that went did so with all its words
        dropped = cut(self._read("gone").select("doc", F.col("of").alias("batch")).distinct())
        live = flat.join(dropped, ["doc", "batch"], "left_anti").select("part", "doc", "grp", "token", "tf", "length")
        size = self._read("sizes").agg(F.sum("docs")).first()[0] or 0
        index._write(self._blocks(live, max(1, math.ceil(size / DOCS_PER_SLICE))), "postings", 0)
        index._write(self._read("gone").where("false").drop("batch"), "gone", 0)
        index._write(self._read("sizes").groupBy("grp").agg(F.sum("docs").alias("docs"), F.sum("words").alias("words")), "sizes", 0, None)
        held = self._read("tokens")
        last = held.groupBy("doc").agg(F.max("batch").alias("batch"))
        index._write(held.join(last, ["doc", "batch"]).where("here").drop("batch").hint("rebalance", "part"), "tokens", 0)
        forget(dropped)
        return index
