"""Order MinHash classes against alignment of all pairs."""

import random

import numpy as np

from graphlens.llm import omh
from graphlens.llm.edits import banded


def brute(rows, similarity=0.8):
    split = {i: (t or "").lower().split() for i, t in rows}
    root = {i: i for i, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = [i for i, _ in rows if split[i]]
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            x, y = split[a], split[b]
            limit = int((1 - similarity) * max(len(x), len(y)) + 1e-9)
            if abs(len(x) - len(y)) <= limit and banded(x, y, limit) <= limit:
                one, two = sorted((find(a), find(b)))
                root[two] = one
    return {i: find(i) for i, _ in rows}


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(400)]
    rows, at = [], 0
    for _ in range(40):
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(3, 120))]
        for _ in range(rng.choice([1, 1, 2, 5])):
            copy = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 45)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            rows.append((at, " ".join(copy)))
            at += 1
    base = [rng.choice(vocabulary) for _ in range(80)]
    for _ in range(60):  # one large group, every copy with an edit of its own
        copy = list(base)
        copy[rng.randrange(80)] = rng.choice(vocabulary)
        rows.append((at, "  ".join(copy).upper()))
        at += 1
    return rows


def test_classes_against_all_pairs(spark):
    rows = [*corpus(4), (900, None), (901, ""), (902, " \n"), (903, "one"), (904, "one"), (905, "ONE"), (906, "two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as content", "1 as kept")
    got = {r.doc_id: r for r in omh.near_duplicates(docs).collect()}
    want = brute(rows)
    assert {i: r.class_id for i, r in got.items()} == want
    assert {i for i, r in got.items() if r.kept} == set(want.values())
    left = omh.without_duplicates(docs)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == set(want.values())


def test_odd_rows(spark):
    text = "the very same words stand in each of these rows"
    rows = [(1, text), (1, text), (1, text.replace("very", "quite")), (None, text), (2, "x" * 50_000), (2, "x" * 50_000), (3, None), (3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id or 0), r.class_id, r.kept) for r in omh.near_duplicates(docs).collect())
    assert [g[:2] for g in got] == [(0, 1), (1, 1), (1, 1), (1, 1), (2, 2), (2, 2), (3, 3), (3, 3)]
    left = sorted((r.doc_id, r.text is None) for r in omh.without_duplicates(docs).collect())
    assert left == [(1, False), (2, False), (3, True), (3, True)]
    assert omh.near_duplicates(docs.limit(0)).count() == 0 and omh.without_duplicates(docs.limit(0)).count() == 0


def test_repeated_shingles_are_told_apart():
    keys = np.array([5, 6, 5, 6, 5, 6, 9, 5, 6], np.uint64)
    rows = np.array([0, 0, 0, 0, 0, 0, 1, 1, 1])
    out, bounds = omh.labelled_shingles(keys, rows, 3, 2)
    assert bounds.tolist() == [0, 5, 7, 7] and len(set(out[:5].tolist())) == 5
    assert out[6] in out[:5]  # the first occurrence has the same label in every row


def test_order_matters():
    keys = np.arange(10, dtype=np.uint64)
    one = omh.sketch(*omh.labelled_shingles(keys, np.zeros(10, int), 1, 1), 6, 2)
    two = omh.sketch(*omh.labelled_shingles(keys[::-1].copy(), np.zeros(10, int), 1, 1), 6, 2)
    assert (one != two).all()


def test_pairs_in_full_buckets(spark):
    """Pairs far below a Jaccard of 0.8 that meet in buckets of over 48 contents, whatever the limit."""
    rng = random.Random(6)
    vocabulary = [f"w{k}" for k in range(3000)]
    passage = [rng.choice(vocabulary) for _ in range(40)]
    rows = []
    for k in range(100):
        base = passage + [rng.choice(vocabulary) for _ in range(60)]
        copy = list(base)
        for p in rng.sample(range(40, 100), 7):
            copy[p] = rng.choice(vocabulary)
        rows += [(2 * k, " ".join(base)), (2 * k + 1, " ".join(copy))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    few, many = ({r.doc_id: r.class_id for r in omh.near_duplicates(docs, full=f).collect()} for f in (10**6, 48))
    print(sum(few[2 * k + 1] == 2 * k for k in range(100)), sum(many[2 * k + 1] == 2 * k for k in range(100)))
    assert many == few
    assert sum(many[2 * k + 1] == 2 * k for k in range(100)) >= 95


def test_pairs_of_a_full_bucket_stay_in_its_task(spark, monkeypatch):
    """Texts that all but align: what is aligned over rows grows with the texts, not with their pairs."""
    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(3000)]
    body = [rng.choice(vocabulary) for _ in range(150)]
    rows = [(k, " ".join(body + [rng.choice(vocabulary) for _ in range(40)])) for k in range(120)]
    rows += [(120 + k, rows[k][1] + " more") for k in range(0, 120, 10)]
    made, aligned = [], omh._aligned

    def counted(pairs, *rest):
        made.append(pairs.count())
        return aligned(pairs, *rest)

    monkeypatch.setattr(omh, "_aligned", counted)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in omh.near_duplicates(docs, full=8).collect()}
    assert got == brute(rows)
    assert sum(made) <= 8 * len(rows), made
