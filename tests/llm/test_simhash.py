"""Fingerprints, edited texts and the search against plain versions."""

import hashlib
import random
import re
import struct

import pytest
import xxhash

from graphlens.llm import simhash

SPACE = re.compile("[\x20\x09-\x0d]+")


def fingerprint(text):
    words = SPACE.split(text.lower())
    votes, total = [0] * 128, 0
    for word, after in zip(words, [*words[1:], None], strict=True):
        weight = len(word) + len(after or "")
        total += weight
        for half in (0, 1):
            seed = 42 if not half else xxhash.xxh64_intdigest(struct.pack("<i", 1), 42)
            for part in (word, after):
                if part is not None:
                    seed = xxhash.xxh64_intdigest(part.encode(), seed)
            for k in range(64):
                votes[64 * half + k] += weight * (seed >> k & 1)
    return [sum((2 * votes[64 * h + k] > total) << k for k in range(64)) for h in (0, 1)]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def apart(a, b):
    return sum((x ^ y).bit_count() for x, y in zip(a, b, strict=True))


def texts(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"{rng.choice('abcxyzéß漢')}{k}" for k in range(300)]
    out = []
    for _ in range(n):
        out.append(" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 60))))
    for k in range(0, n, 3):  # near copies of the first
        words = out[0].split(" ") * 40
        words[rng.randrange(len(words))] = f"w{k}"
        out[k] = " ".join(words)
    return out


CASES = {
    "texts": list(enumerate(texts(1, 150))),
    "odd": [(0, None), (100, ""), (200, " a  B\n"), (300, "A b"), (None, "lost"), (None, "lost two"), (5, "dup one"), (5, "dup one"), (5, "dup"), (400, "x" * 70_000), (600, "é漢 😀 z")],
    "lone": [(7, "only one here")],
    "none": [],
}


@pytest.mark.parametrize(("name", "rows"), [("texts", 4), ("odd", 4), ("odd", 20_000), ("lone", 4), ("none", 4)])
def test_report_equals_a_plain_version(spark, monkeypatch, name, rows):
    monkeypatch.setattr(simhash, "RANGE_ROWS", rows)
    docs = CASES[name]
    df = spark.createDataFrame([(i, t, 1, "x", 3, 4) for i, t in docs], "doc_id long, text string, range int, real string, hi int, id int")
    got = simhash.report(df).collect()
    tie = lambda t: signed(xxhash.xxh64_intdigest(t.encode(), 42))
    order = sorted([(i, t or "") for i, t in docs], key=lambda d: (d[0] is None, -(d[0] or 0), tie(d[1])))
    prints = [fingerprint(t) for _, t in order]
    want = []
    for k, (i, t) in enumerate(order):
        after = (k + 1) % len(order)
        half = len(t) // 2
        edited = t[: len(t) - half] + order[after][1][:half]
        own, other = prints[k], fingerprint(edited)
        near = sum(apart(own, p) <= 6 for p in prints) - 1 if i is not None and i % 100 == 0 else None
        want.append((
            i, len(t), hashlib.sha256(edited.encode()).hexdigest(), "{:016x}{:016x}".format(*own), "{:016x}{:016x}".format(*other),
            1 - apart(own, other) / 128, 1 - apart(own, prints[after]) / 128, near,
        ))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_dense_buckets(spark):
    """All within six bits of one, in lists of a few: the counts of all pairs."""
    rng = random.Random(3)
    base = [rng.getrandbits(64), rng.getrandbits(64)]
    prints = {tuple(base): 3}
    while len(prints) < 400:
        p = list(base)
        for _ in range(rng.randint(0, 7)):
            k = rng.randrange(128)
            p[k // 64] ^= 1 << k % 64
        prints[tuple(p)] = rng.randint(1, 5)
    df = spark.createDataFrame([(signed(a), signed(b), n) for (a, b), n in prints.items()], "hi long, lo long, n long")
    got = {(r.hi, r.lo): r.n_near for r in simhash.near(df, df, dense_rows=20).collect()}
    want = {(signed(a), signed(b)): sum(n for q, n in prints.items() if apart((a, b), q) <= 6) for a, b in prints}
    assert got == want


def test_equal_texts_and_likeness(spark):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(["Same text here", "same  text\nHERE", "other words", "Same text here"])], "doc_id long, text string")
    rows = {r.doc_id: r for r in simhash.report(df).collect()}
    assert rows[0].fingerprint == rows[1].fingerprint == rows[3].fingerprint != rows[2].fingerprint
    assert rows[0].n_near == 2 and all(0 <= r.near_next <= 1 for r in rows.values())
