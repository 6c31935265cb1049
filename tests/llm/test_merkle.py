"""The manifest against a plain tree."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from graphlens.llm import merkle

LAYOUT = "doc_id long, source string, lang string, n_chars long, text string, hash string, n int, rank int, name string"


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(doc, text):
    parts = [doc[0], doc[1], doc[2], doc[3], text]
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in parts))


def tree(nodes):
    """The root of a list of hashes and per node its (left, right) siblings, level by level."""
    paths, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        runs = [nodes[i : i + 16] for i in range(0, len(nodes), 16)]
        for path, k in zip(paths, at, strict=True):
            run = runs[k // 16]
            path.append(("".join(run[: k % 16]), "".join(run[k % 16 + 1 :])))
        nodes, at = [h("".join(r)) for r in runs], [k // 16 for k in at]
    return nodes[0], paths


def plain(docs):
    groups = {}
    for d in docs:
        groups.setdefault(d[1], []).append(d)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees, out = {}, []
    for s in order:
        groups[s].sort(key=lambda d: (d[0] is not None, d[0] or 0, leaf(d, d[4])))
        trees[s] = tree([leaf(d, d[4]) for d in groups[s]])
    root, tops = tree([trees[s][0] for s in order])
    for s, top in zip(order, tops, strict=True):
        for d, path in zip(groups[s], trees[s][1], strict=True):
            path = path + top
            own = leaf(d, d[4])
            node = own
            if d[0] is not None and zlib.crc32(str(d[0]).encode()) % 5 == 0 and d[4] is not None:
                node = leaf(d, "".join(c.lower() if "A" <= c <= "Z" else c for c in d[4]))
            for left, right in path:
                node = h(left + node + right)
            out.append((d[0], own, trees[s][0], root, h("".join(a + b for a, b in path)), node, node == root))
    return sorted(out, key=str)


def cases():
    many = [(k, "big", "en", k % 7, f"Text {k} É" * (k % 5)) for k in range(4200)]  # two blocks
    odd = [
        (1, None, None, None, None), (2, None, "", 0, ""), (None, None, "en", 1, "x"), (None, "a", "en", 1, "X"), (7, "a", "en", 1, "ABC"), (7, "a", "en", 1, "ABC"),
        (7, "a", "en", 1, "abd"), (5, "lone", "x", None, "only One"), (8, "", "x", 3, "Q" * 50_000), (9, "é", "x", 3, "漢A"), (10, "Z", "x", 3, "-"),
    ]
    return many + odd + [(20_000 + k, f"s{k:03}", "en", 1, "A b") for k in range(300)]


@pytest.mark.parametrize("pick", [slice(0, None), slice(4200, 4211), slice(4207, 4208), slice(0, 17)])
def test_manifest_equals_a_plain_tree(spark, pick):
    docs = cases()[pick]
    df = spark.createDataFrame([(*d, "x", 1, 2, "y") for d in docs], LAYOUT)
    got = sorted((tuple(r) for r in merkle.verified(df).collect()), key=str)
    assert got == plain(docs)
    if len(docs) > 1000:
        assert {r[-1] for r in got} == {True, False}


def test_no_rows(spark):
    assert merkle.verified(spark.createDataFrame([], LAYOUT)).collect() == []


def test_general_fields(spark):
    df = spark.createDataFrame([("b", "k1", 2.5), ("a", "k1", None), ("c", None, 1.0)], "key string, part string, x double")
    got = merkle.proofs(df, ["key", "x"], "key", "part").select("*", merkle.folded(F.col("leaf"), "path").alias("again")).collect()
    assert {r.id for r in got} == {"a", "b", "c"} and all(r.again == r.root and r.seen is None for r in got)
