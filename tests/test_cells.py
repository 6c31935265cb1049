"""The stored vector index against the scores of all items."""

import random

import numpy as np

from graphlens.operators import cells
from graphlens.operators.cells import VectorIndex

ITEMS, QUERIES = "item_id long, grp string, vector array<float>", "query_id long, grp string, vector array<double>"


def clustered(seed, n, dims=16, groups=40):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, dims))
    out = [(k, f"g{k % 3}" if k % 7 else None, (centres[k % groups] + 0.1 * rng.normal(size=dims)).astype(np.float32).tolist()) for k in range(n)]
    out += [(n + k, "g0", out[5][2]) for k in range(4)]  # ties
    return out + [(n + 10, "g0", None), (n + 11, "g0", [0.0] * dims), (n + 12, "g0", [float("nan")] * dims)]


def plain(items, query, limit, grp=False):
    q = np.array(query[2], float)
    with np.errstate(all="ignore"):
        q = q / np.linalg.norm(q)
        scored = [(-float(np.array(v, float) @ q / np.linalg.norm(v)), i) for i, g, v in items if v is not None and (not grp or (g or "") == (query[1] or ""))]
    return [i for s, i in sorted(((round(s, 9), i) for s, i in scored if np.isfinite(s)))[:limit]]


def _found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append(r.item_id)
    return out


def test_search_is_exact_and_opens_few_cells(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cells, "ITEMS", 16)
    monkeypatch.setattr(cells, "QUERIES", 8)
    items = clustered(1, 1200)
    index = VectorIndex(spark, str(tmp_path / "index"))
    index.build(spark.createDataFrame(items, ITEMS))
    rng = random.Random(2)
    asked = [(k, items[rng.randrange(1200)][1], items[rng.randrange(1200)][2]) for k in range(30)] + [(100, "g1", [0.0] * 16), (101, "none", items[0][2]), (102, "g0", None), (103, "g0", items[5][2])]
    queries = spark.createDataFrame(asked, QUERIES)
    usable = [q for q in asked if q[2] is not None and any(q[2])]
    for limit in (1, 7):
        got = _found(index.search(queries, limit))
        assert got == {q[0]: plain(items, q, limit) for q in usable}
        got = _found(index.search(queries, limit, grouped=True))
        assert got == {q[0]: plain(items, q, limit, True) for q in usable if q[1] != "none"}
    frame = queries.selectExpr("query_id", "'' as key", "vector").where("vector is not null").join(index._cells(False), "key")
    near = index.search(queries, 7).groupBy("query_id").min("score").withColumnRenamed("min(score)", "kth")
    every = frame.selectExpr("sum(size(cells))").first()[0]
    opened = index._probes(frame, 7, True).count() + index._probes(frame.join(near, "query_id"), 7, False).count()
    assert opened < every / 4


def test_later_batches_and_small_indexes(spark, tmp_path):
    items = clustered(3, 200)
    index = VectorIndex(spark, str(tmp_path / "index"))
    assert index.search(spark.createDataFrame([(1, "g0", [1.0, 0.0])], QUERIES)).collect() == [] if (tmp_path / "index").exists() else True
    index.build(spark.createDataFrame(items[:50], ITEMS))
    for _ in range(2):
        index.add(1, spark.createDataFrame(items[50:], ITEMS))
    asked = [(k, "g0", items[k][2]) for k in (0, 60, 150)]
    assert _found(index.search(spark.createDataFrame(asked, QUERIES), 500)) == {q[0]: plain(items, q, 500) for q in asked}
    empty = VectorIndex(spark, str(tmp_path / "empty"))
    empty.build(spark.createDataFrame([], ITEMS))
    assert empty.search(spark.createDataFrame(asked, QUERIES)).collect() == []
