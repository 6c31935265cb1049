"""Keyword and vector search on the documents and embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlens.operators import search
from graphlens.operators.cells import VectorIndex
from graphlens.operators.inverted import KeywordIndex
from graphlens.session import scratch_path
from workload.harness import Bed, query

WORDS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{Nd}_]+'), lambda x: x <> '')"


@query("text_index", f"""
SELECT doc, token, count(*) AS tf, length FROM (
  SELECT doc_id AS doc, CAST(len(w) AS INTEGER) AS length, unnest(w) AS token FROM (SELECT doc_id, {WORDS} AS w FROM documents) t) u
GROUP BY 1, 2, 4
""")
def _(bed: Bed):
    return search.postings(bed.table("documents"), "doc_id", F.col("text"))


@query("token_frequency", f"""
SELECT token, count(DISTINCT doc_id) AS df, count(*) AS total FROM (SELECT doc_id, unnest({WORDS}) AS token FROM documents) t GROUP BY 1
""")
def _(bed: Bed):
    return search.document_frequency(search.postings(bed.table("documents"), "doc_id", F.col("text")))


def _bm25(where: str, docs: str = "documents") -> str:
    return f"""
WITH d AS (SELECT doc_id, len(w) AS l, w FROM (SELECT doc_id, {WORDS} AS w FROM {docs} d {where}) t),
q AS (SELECT unnest(['the', 'die', 'erent']) AS token),
tf AS (SELECT d.doc_id, d.l, q.token, len(list_filter(d.w, lambda x: x = q.token)) AS tf FROM d, q),
n AS (SELECT count(*) AS n, avg(l) AS al FROM d),
df AS (SELECT token, count(*) FILTER (tf > 0) AS df FROM tf GROUP BY 1)
SELECT doc_id AS doc, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * l / al))), 6) AS score
FROM tf JOIN df USING (token), n GROUP BY 1 HAVING sum(tf) > 0 ORDER BY 2 DESC, 1 LIMIT 25"""


_indexes: dict[tuple[str, str], KeywordIndex] = {}


def _indexed(bed: Bed) -> DataFrame:
    return bed.table("documents").select(F.col("doc_id").alias("doc"), F.col("source").alias("grp"), "text")


def standing_index(bed: Bed) -> KeywordIndex:
    """The index of all documents, by source: stored once per session and input folder."""
    key = (bed.spark.sparkContext.applicationId, bed.dir)
    if key not in _indexes:
        index = KeywordIndex(bed.spark, scratch_path(bed.spark, "index"))
        index.update(0, _indexed(bed))
        _indexes[key] = index
    return _indexes[key]


@query("keyword_search", _bm25(""))
def _(bed: Bed):
    return standing_index(bed).search("The, die erent")


@query("keyword_search_in_source", _bm25("WHERE source = 'src3'"))
def _(bed: Bed):
    return standing_index(bed).search("The, die erent", group="src3")


@query("keyword_search_after_batches", _bm25("", "(SELECT doc_id, CASE WHEN doc_id % 10 = 3 THEN concat('the erent ', text) ELSE text END AS text FROM documents WHERE doc_id % 10 <> 7)"))
def _(bed: Bed):
    """Half of the documents are indexed; then a tenth is replaced, a tenth removed, the rest added; and the index is made anew from what is left."""
    docs, key = _indexed(bed), F.col("doc") % 10
    index = KeywordIndex(bed.spark, scratch_path(bed.spark, "index"))
    index.update(0, docs.where(key.isin(1, 3, 5, 7, 9)))
    index.update(1, docs.where(key == 3).withColumn("text", F.concat(F.lit("the erent "), "text")), docs.where(key == 7).select("doc"))
    index.update(2, docs.where(key.isin(0, 2, 4, 6, 8)))
    return index.compact(scratch_path(bed.spark, "index")).search("The, die erent")


def _vectors(bed: Bed):
    items = bed.table("embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"), "label")
    # one query per label: the mean of its vectors, taken per dimension
    parts = items.select("label", F.posexplode("vector").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    queries = parts.groupBy("label").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("vector"))
    return items, queries.withColumn("query_id", F.col("label"))


_stored_vectors: dict[tuple[str, str], VectorIndex] = {}


def standing_vectors(bed: Bed) -> VectorIndex:
    """The index of all vectors, by label: stored once per session and input folder."""
    key = (bed.spark.sparkContext.applicationId, bed.dir)
    if key not in _stored_vectors:
        index = VectorIndex(bed.spark, scratch_path(bed.spark, "vectors"))
        index.build(_vectors(bed)[0].withColumnRenamed("label", "grp"))
        _stored_vectors[key] = index
    return _stored_vectors[key]


CENTRES = """
c AS (SELECT label, list(x ORDER BY i) AS v FROM (
        SELECT label, i, avg(CAST(x AS DOUBLE)) AS x FROM (SELECT label, unnest(embedding) AS x, unnest(range(1, 65)) AS i FROM embeddings) u GROUP BY 1, 2) t GROUP BY 1)"""


@query("semantic_search", f"""
WITH {CENTRES}
SELECT query_id, item_id, round(score, 5) AS score, rank FROM (
  SELECT c.label AS query_id, e.vec_id AS item_id, list_cosine_similarity(c.v, CAST(e.embedding AS DOUBLE[])) AS score,
         row_number() OVER (PARTITION BY c.label ORDER BY list_cosine_similarity(c.v, CAST(e.embedding AS DOUBLE[])) DESC, e.vec_id) AS rank
  FROM embeddings e, c) t WHERE rank <= 10
""")
def _(bed: Bed):
    _, queries = _vectors(bed)
    return standing_vectors(bed).search(queries.drop("label")).withColumn("score", F.round("score", 5))


@query("semantic_search_in_label", f"""
WITH {CENTRES}
SELECT query_id, item_id, rank FROM (
  SELECT c.label AS query_id, e.vec_id AS item_id,
         row_number() OVER (PARTITION BY c.label ORDER BY list_cosine_similarity(c.v, CAST(e.embedding AS DOUBLE[])) DESC, e.vec_id) AS rank
  FROM embeddings e JOIN c ON c.label = e.label) t WHERE rank <= 10
""")
def _(bed: Bed):
    _, queries = _vectors(bed)
    return standing_vectors(bed).search(queries.withColumnRenamed("label", "grp"), grouped=True).drop("score")


@query("embed_functions")
def _(bed: Bed):
    return search.embed(bed.view("v_functions").select("repo_id", "qualified_name", "doc"), F.col("doc"), dims=64)
