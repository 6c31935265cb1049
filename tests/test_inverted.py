"""The stored keyword index against scores of all documents."""

import math
import random
from collections import Counter

from pyspark.sql import functions as F

from graphlens.operators import inverted
from graphlens.operators.inverted import KeywordIndex


def plain(docs, query, limit, group=None):
    """(doc, score) of the best, from whole texts: {doc: (group, text)}."""
    words = {d: (t or "").lower().split() for d, (g, t) in docs.items() if group is None or g == group}
    n, average = len(words), sum(map(len, words.values())) / max(len(words), 1)
    asked = set(query.lower().split())
    df = {w: sum(w in ws for ws in words.values()) for w in asked}
    out = []
    for d, ws in words.items():
        tf = Counter(ws)
        if any(tf[w] for w in asked):
            out.append((d, round(sum(
                math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(ws) / average)) for w in asked if tf[w]
            ), 6)))
    return sorted(out, key=lambda x: (-x[1], x[0]))[:limit]


def corpus(seed, n):
    rng = random.Random(seed)
    common = ["common"] * 6 + ["often"] * 3 + ["rare1", "rare2", "é"] + [f"w{k}" for k in range(40)]
    return {k: (rng.choice(["a", "b", None]), " ".join(rng.choice(common) for _ in range(rng.randint(0, 30)))) for k in range(n)}


def frame(spark, docs):
    return spark.createDataFrame([(d, g, t) for d, (g, t) in docs.items()], "doc long, grp string, text string")


QUESTIONS = [("common", None), ("common often", "a"), ("rare1 common é", None), ("nowhere rare2", "b"), ("nowhere", None), ("", None), ("often", "no such group")]


def _agree(index, docs):
    for query, group in QUESTIONS:
        for limit in (1, 10):
            got = [(r.doc, r.score) for r in index.search(query, limit, group).collect()]
            assert got == plain(docs, query, limit, group), (query, group, limit)


def test_search_over_batches(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(inverted, "BLOCK", 8)
    monkeypatch.setattr(inverted, "FIRST_BLOCKS", 2)
    docs = corpus(1, 400) | {1000: ("a", None), 1001: (None, "")}
    index = KeywordIndex(spark, str(tmp_path / "one"), parts=4)
    assert index.search("common").collect() == []
    index.update(0, frame(spark, docs))
    _agree(index, docs)
    changed = {k: ("b", "often rare1 " * (k % 5)) for k in range(0, 60, 2)} | {2000: ("a", "rare2 rare2")}
    gone = [k for k in range(1, 60, 2)] + [9999]
    for _ in range(2):  # a batch that is sent again changes nothing
        index.update(1, frame(spark, changed), spark.createDataFrame([(k,) for k in gone], "doc long"))
    now = {k: v for k, v in (docs | changed).items() if k not in gone}
    _agree(index, now)
    back = {1: ("a", "common é"), 0: ("a", "often")}
    index.update(2, frame(spark, back), spark.createDataFrame([(3,)], "doc long"))
    now |= back
    _agree(index, now)
    small = index.compact(str(tmp_path / "two"))
    _agree(small, now)
    assert small._read("gone").count() == 0 and small._read("postings").agg(F.sum("n")).first()[0] == sum(len(set((t or "").split())) for _, t in now.values())


def test_blocks_are_skipped_and_parts_pruned(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(inverted, "BLOCK", 8)
    rng = random.Random(2)
    docs = {k: ("a", "word " * min(40, int(rng.paretovariate(1))) + "other " * rng.randint(0, 30)) for k in range(1500)}
    index = KeywordIndex(spark, str(tmp_path / "index"), parts=16)
    index.update(0, frame(spark, docs))
    found, seen = index.plan("word", 5)
    words = seen["words"]
    kept = index._of("postings", words, None).where(seen["keep"]).count()
    assert seen["least"] > 0 and kept <= seen["blocks"] / 4
    assert [(r.doc, r.score) for r in index.search("word", 5).collect()] == plain(docs, "word", 5)
    explained = spark._jvm.org.apache.spark.sql.api.python.PythonSQLUtils.explainString
    plan = explained(index._of("postings", words, "a").where(seen["keep"])._jdf.queryExecution(), "formatted")
    assert "PartitionFilters: [" in plan and "part#" in plan.split("PartitionFilters: [")[1][:60]
    assert "EqualTo(token,word)" in plan or "In(token" in plan
    assert "EqualTo(grp,a)" in plan and "GreaterThanOrEqual(max_tf" in plan
    opened = index._of("postings", words, None).select(F.input_file_name().alias("f")).distinct().collect()
    assert len({r.f.split("part=")[1].split("/")[0] for r in opened}) == len(words)
    assert "text" not in found._jdf.queryExecution().toString()


def test_words_are_counted_in_the_row_and_moved_once(spark, tmp_path, monkeypatch):
    worded = spark.createDataFrame([(1, "a", ["b", "a", "b", "é"]), (2, None, []), (3, "a", ["x"])], "doc long, grp string, words array<string>")
    counted = inverted._runs(worded)
    assert sorted(map(tuple, counted.collect())) == [(1, "a", 4, "a", 1), (1, "a", 4, "b", 2), (1, "a", 4, "é", 1), (3, "a", 1, "x", 1)]
    index = KeywordIndex(spark, str(tmp_path / "index"), parts=4)
    plan = index._blocks(counted.withColumn("part", index._part("token")), 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
    monkeypatch.setattr(inverted, "DOCS_PER_SLICE", 50)
    monkeypatch.setattr(inverted, "BLOCK", 8)
    docs = corpus(5, 300)
    index.update(0, frame(spark, docs))
    _agree(index, docs)


def test_a_document_sent_twice_is_one_posting(spark, tmp_path):
    index = KeywordIndex(spark, str(tmp_path / "index"), parts=4)
    index.update(0, spark.createDataFrame([(1, "a", "x y"), (1, "a", "x z"), (1, "a", "x"), (None, "a", "x y"), (None, "a", "x y"), (2, "a", "x x y")], "doc long, grp string, text string"))
    rows = index._read("postings").where("token = 'x'").select("docs").collect()
    assert sorted(((d.doc or 0), d.tf, d.length) for r in rows for d in r.docs) == [(0, 2, 2), (1, 1, 1), (1, 2, 2), (2, 2, 3)]
