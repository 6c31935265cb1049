"""The pivot index and the threshold algorithm against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphlens.llm import pivots, threshold


def vectors(seed, n=400, dims=16):
    rng = np.random.default_rng(seed)
    rows = rng.normal(size=(n, dims))
    for k in range(0, n, 4):  # clusters around every fourth
        rows[k + 1] = rows[k] + rng.normal(size=dims) * 0.25 * rng.random()
    rows[7] = rows[3]
    rows[11] = rows[3]
    return rows


def links(rows):
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    root = np.arange(len(rows))
    for _ in range(len(rows)):
        now = np.array([min([root[i], *root[near[i]]]) for i in range(len(rows))])
        if (now == root).all():
            break
        root = now
    return near.sum(axis=1), root


def test_index_against_all_pairs(spark):
    rows = vectors(2)
    n, root = links(rows)
    data = [(i, r.tolist()) for i, r in enumerate(rows)]
    odd = [(1000, None), (1001, []), (1002, [0.0] * 16), (1003, [float("nan")] * 16), (1004, [None] * 16), (1005, [float("inf")] + [1.0] * 15)]
    df = spark.createDataFrame(data + odd, "vec_id long, embedding array<double>").selectExpr("*", "1 as node", "2 as kept")
    for chunk in (1024, 20):
        got = {r.vec_id: r for r in pivots.near_duplicates(df, chunk=chunk).collect()}
        for i in range(len(rows)):
            assert (got[i].n_links, got[i].component_id, got[i].kept) == (n[i], root[i], root[i] == i)
        for i, _ in odd:
            assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert pivots.near_duplicates(df.limit(0)).count() == 0


def test_recall_at_the_threshold():
    rng = np.random.default_rng(5)
    base = rng.normal(size=(3000, 64))
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    turn = rng.normal(size=base.shape)
    turn -= (turn * base).sum(1, keepdims=True) * base
    turn /= np.linalg.norm(turn, axis=1, keepdims=True)
    near = 0.95 * base + (1 - 0.95**2) ** 0.5 * turn
    marks = rng.normal(size=(int(4 * 6000**0.5), 64))
    marks /= np.linalg.norm(marks, axis=1, keepdims=True)
    one, two = (np.argsort(-(x @ marks.T), axis=1)[:, : pivots.NEAREST] for x in (base, near))
    shared = (one[:, :, None] == two[:, None, :]).any(axis=2).sum(axis=1)
    assert (shared >= pivots.SHARED).mean() > 0.99


@pytest.mark.parametrize("share", [0.1, 0.33])
def test_recall_in_a_large_group(spark, share):
    rng = np.random.default_rng(8)
    rows = rng.normal(size=(4000, 64))
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    group = int(share * len(rows))
    turn = rng.normal(size=(group, 64))
    rows[:group] = rows[-1] + 0.2 * turn / np.linalg.norm(turn, axis=1, keepdims=True)
    unit = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    pairs = (unit @ unit.T >= 0.95).sum() - len(rows)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)], "vec_id long, embedding array<double>")
    found = pivots.near_duplicates(df, chunk=300).agg(F.sum("n_links")).first()[0]
    print(share, pairs, found / pairs)
    assert 0.99 * pairs <= found <= pairs


def test_repeated_vectors_count(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0]) for i in (5, 3, 9)] + [(3, [1.0, 2.0]), (4, [2.0, 4.0]), (6, [-1.0, 2.0])], "vec_id long, embedding array<float>")
    got = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in pivots.near_duplicates(df).collect())
    assert got == [(3, 4, 3, True), (3, 4, 3, True), (4, 4, 3, False), (5, 4, 3, False), (6, 0, 6, True), (9, 4, 3, False)]


def exact(rows, ids, k):
    floored = np.floor(rows * 64).astype(np.int64)
    scores = floored @ floored.T
    out = []
    for i in np.flatnonzero(ids % 20 == 0):
        order = [j for j in np.lexsort((ids, -scores[i])) if ids[j] != ids[i]][:k]
        out += [(int(ids[i]), r, int(ids[j]), int(scores[i, j])) for r, j in enumerate(order, 1)]
    return sorted(out)


def test_top_k_against_all_scores(spark):
    rows = vectors(9, 300)
    rows[40:60] = np.round(rows[40:60])  # ties
    rows[50:55] = rows[41]
    ids = np.arange(300)
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(rows)] + [(2000, None), (2020, [float("nan")] * 16), (2040, [None])], "vec_id long, embedding array<double>")
    for block, asked, depth in ((8192, 512, 64), (37, 4, 2)):
        got = sorted(tuple(r) for r in threshold.top_k(df, F.col("id") % 20 == 0, block=block, query_block=asked, depth=depth).collect())
        assert got == exact(rows, ids, 20)
    few = df.where("vec_id in (20, 41, 50)")
    assert sorted(tuple(r)[:3] for r in threshold.top_k(few, F.col("id") % 20 == 0).collect()) == [r[:3] for r in exact(rows[[20, 41, 50]], np.array([20, 41, 50]), 20)]
    assert threshold.top_k(df.limit(0), F.col("id") % 20 == 0).count() == 0


def test_rows_that_come_twice_count_twice(spark):
    data = [(0, [1.0, 0.0]), (1, [3.0, 1.0]), (2, [2.0, 1.0]), (2, [2.0, 1.0]), (3, [1.0, 1.0])] + [(4, [4.0, 1.0])] * 3
    twice = [(20, [0.0, 1.0])] * 2
    df = spark.createDataFrame(data + twice, "vec_id long, embedding array<float>")
    want = []
    for q, v in ((0, [1, 0]), (20, [0, 1]), (20, [0, 1])):
        want += [(q, i, int(64 * 64 * (v[0] * x[0] + v[1] * x[1]))) for i, x in data + twice if i != q]
    for k in (20, 4):
        best = {q: sorted(((-s, i) for a, i, s in want if a == q))[:k] for q in (0, 20)}
        expected = [(q, r, i, -s) for q in (0, 20) for r, (s, i) in enumerate(best[q], 1)]
        for block in (8192, 2):
            got = threshold.top_k(df, F.col("id") % 20 == 0, k=k, block=block, query_block=1, depth=1).collect()
            assert sorted(tuple(r) for r in got) == expected


def test_the_algorithm_stops_early():
    rng = np.random.default_rng(0)
    rows = rng.integers(-5, 6, (5000, 4)).astype(float)
    rows[:30] += 60
    lists = threshold.Lists(np.arange(5000), rows)
    read = []

    class Seen(np.ndarray):
        def __getitem__(self, at):
            read.append(np.size(at))
            return np.asarray(self)[at]

    lists.rows = rows.view(Seen)
    ids, scores = lists.top(np.ones(4), -1, 20, 16)
    want = np.lexsort((np.arange(5000), -rows.sum(axis=1)))[:20]
    assert ids.tolist() == want.tolist() and sum(read) < 1000
