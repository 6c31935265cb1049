"""Edit distances and the join of near lines against brute force."""

import random

import numpy as np
import pytest

from graphlens.llm import line_dedup
from graphlens.llm.edits import banded, banded_pairs


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (x != y)))
        row = now
    return row[-1]


def edited(rng, text, times, letters="xyz"):
    for _ in range(times if text else 0):
        i, kind = rng.randrange(len(text)), rng.randrange(3)
        text = text[:i] + (rng.choice(letters) if kind < 2 else "") + text[i + (kind != 0) :] or "a"
    return text


def test_banded_distances():
    rng = random.Random(1)
    pairs = []
    for _ in range(1500):
        a = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 14)))
        pairs.append((a, edited(rng, a, rng.randrange(0, 3), "abc") if rng.random() < 0.8 else "".join(rng.choice("abc") for _ in range(6))))
    pairs += [("", ""), ("a", ""), ("", "ab")]
    want = [distance(a, b) for a, b in pairs]
    codes = [[np.frombuffer(x.encode("utf-32-le"), np.uint32) for x in side] for side in zip(*pairs, strict=True)]
    for limit in (0, 1, 2, 4):
        assert [banded(a, b, limit) for a, b in pairs] == [min(d, limit + 1) for d in want]
        assert banded_pairs(*codes, limit).tolist() == [min(d, limit + 1) for d in want]


def expected(rows, edits, least):
    seen = [
        (d, i, line.strip(line_dedup.BLANKS))
        for d, text in rows if text for i, line in enumerate(text.split("\n")) if len(line.strip(line_dedup.BLANKS)) >= least
    ]
    lines = sorted({s[2] for s in seen})
    root = {x: x for x in lines}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(lines):
        for b in lines[i + 1 :]:
            if abs(len(a) - len(b)) <= edits and banded(a, b, edits) <= edits:
                root[find(a)] = find(b)
    first, out = set(), {}
    for d, i, line in sorted(seen, key=lambda s: s[:2]):
        if find(line) in first:
            out.setdefault(d, []).append(i)
        first.add(find(line))
    return out


@pytest.mark.parametrize(("edits", "bucket"), [(1, 6), (2, 64)])
def test_lines_against_all_pairs(spark, edits, bucket):
    rng = random.Random(edits)
    bases = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(20, 40))).strip().ljust(20, "q") for _ in range(12)]
    rows = [(d, "\n".join(edited(rng, rng.choice(bases), rng.randrange(0, 4)) for _ in range(rng.randrange(1, 5)))) for d in range(80)]
    hot = "the same line with one edit somewhere in every copy of it"
    rows += [(100 + d, edited(rng, hot, 1)) for d in range(60)]
    rows += [(200, None), (201, ""), (202, "short\nshort"), (203, " \t" + hot), (204, hot + "\r")]
    got = {r.doc_id: r.removed for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), edits=edits, bucket=bucket).collect()}
    want = expected(rows, edits, line_dedup.MIN_CHARS)
    assert got == {d: want.get(d, []) for d, _ in rows}


@pytest.mark.parametrize("edits", [2, 3])
def test_shifted_segments_in_full_buckets(spark, edits):
    """Pairs whose only common segment is shifted, and stands in many other lines."""
    rng = random.Random(edits)

    def letters(n):
        return "".join(rng.choice("abcdefghijklm") for _ in range(n))

    lines = [letters(9) + "k" + "the common" + letters(10 * (edits - 1)) for _ in range(24)]
    for line in lines[:8]:
        near = line[:8] + "z" + line[8:25] + line[26:]
        lines.append(near if edits == 2 else near[:35] + "z" + near[36:])
    rows = list(enumerate(lines))
    got = {r.doc_id: r.removed for r in line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), edits=edits, bucket=6).collect()}
    want = expected(rows, edits, line_dedup.MIN_CHARS)
    assert len(want) >= 8
    assert got == {d: want.get(d, []) for d, _ in rows}


def test_text_columns_and_odd_rows(spark):
    line = "a line that is long enough to count"
    rows = [(1, f"{line}\nshort\n{line}", "x", 5), (2, f"one of its own, also long\n{line}", "y", 6), (None, line, "z", 7), (3, None, None, None), (3, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, removed string, key int")
    got = sorted((r.doc_id or 0, r.text, r.n_lines, r.removed, r.key or 0) for r in line_dedup.dedup_lines(docs).collect() if r.text is not None)
    assert got == [(0, line, 1, [], 7), (1, "short", 3, [0, 2], 5), (2, "one of its own, also long", 2, [1], 6)]
    assert line_dedup.dedup_lines(docs).where("text is null").count() == 2
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0
