"""Packing and mixing: exact round trips, capacities and targets."""

import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from graphlens.llm import mixing, packing

TEXTS = [
    (1, "plain words, and numbers 123"), (2, None), (3, ""), (4, "long " * 3000), (5, "ünïcödé \U0001f600 text\n\n  with   blanks"),
    (6, "ends with <|endoftext|>"), (7, "x" * 5000), (1, "plain words, and numbers 123"), (None, "no id"),
]


def test_differencing_balances():
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 257, 700).tolist()
    k = -(-sum(sizes) // 1024)
    made = packing.difference(sizes, k)
    assert sorted(i for w in made for i in w) == list(range(700))
    sums = [sum(sizes[i] for i in w) for w in made]
    assert len(made) == k and max(sums) - min(sums) < 60
    assert all(sum(sizes[i] for i in w) <= 1024 for w in packing.windows_of(sizes, 1024))
    assert packing.windows_of([600, 600, 600], 1024) == [[0], [1], [2]] or len(packing.windows_of([600, 600, 600], 1024)) == 3
    assert packing.windows_of([], 1024) == [[]] and packing.difference([5], 3) == [[0]]


def test_pieces_hold_every_id_once(spark):
    docs = spark.createDataFrame(TEXTS, "doc_id long, text string").withColumnRenamed("text", "body").selectExpr("*", "1 as sequence_id", "'x' as text")
    rows = packing.pack(docs, text_col="body", windows=2, capacity=64, piece=16).collect()
    bpe = Tokenizer.from_file(packing.tokenizer_path("byte_bpe_50k.json"))
    want = sorted((d or 0, [*bpe.encode(t or "", add_special_tokens=False).ids, 0]) for d, t in TEXTS)
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        assert len(r.ids) == r.length and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        pieces[r.doc_id or 0, r.doc_tokens].append(r)
        windows[r.sequence_id].append(r)
    got = []
    for (d, total), own in pieces.items():
        own.sort(key=lambda r: r.start)
        copies = sum(r.length for r in own) // total
        got += [(d, [i for r in own[k::copies] for i in r.ids]) for k in range(copies)]
    assert sorted(got) == want
    for own in windows.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == np.cumsum([0, *(r.length for r in own[:-1])]).tolist() and sum(r.length for r in own) <= 64
    assert packing.pack(docs.limit(0)).count() == 0


def test_fast_and_slow_tokenizers_agree():
    bpe = packing.ByteBpe(packing.tokenizer_path("byte_bpe_50k.json"), packing.tokenizer_path("byte_bpe_50k.tiktoken"))
    for text in ("Hello  world", "éß漢字", "\t\n a\r\n", "it's 12345 -- ok", "  x", "a" * 999):
        assert bpe.encode(text) == bpe.slow.encode(text, add_special_tokens=False).ids


def test_targets_share_by_weight_and_stop():
    assert mixing.targets([100, 100, 100], [1, 2, 3]) == [50, 100, 150]
    assert mixing.targets([1000, 10, 10], [1, 2, 3]) == [960, 30, 30]
    assert mixing.targets([0, 0], [1, 2]) == [0, 0] and mixing.targets([], []) == []


def test_permutations_and_shards():
    for n in (1, 2, 3, 17, 256, 1000):
        one = mixing.Permutation(n, 5, 1, 0)
        order = one.of(np.arange(n))
        assert sorted(order.tolist()) == list(range(n)) and one.of(order, back=True).tolist() == list(range(n))
    totals = np.array([5, 0, 1000, 333])
    at = np.zeros(4, int)
    for shard in range(14):
        first, have = mixing.shard_counts(totals, shard, 14, 100, 7)
        assert first.tolist() == at.tolist() and have.sum() == min(100, 1338 - 100 * shard)
        at += have
    assert at.tolist() == totals.tolist()


@pytest.mark.parametrize("block", [4, 256])
def test_mix_meets_its_targets(spark, block):
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 60))), ["a", "b", None, "d"][i % 4 if i % 3 else 0]) for i in range(120)]
    rows += [(7, "same row twice", "b"), (7, "same row twice", "b"), (900, None, "d"), (None, "x y z", "d"), (901, "\u000b \t", "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "5L as size", "1 as _row")
    got = mixing.mix_report(docs, block=block).collect()
    again = mixing.mix_report(docs, block=block).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows)
    names = sorted({r[2] for r in rows}, key=lambda s: (s is None, s or ""))
    words = lambda t: len([w for w in (t or "").replace("\u000b", " ").replace("\t", " ").split(" ") if w])
    sizes = [sum(words(t) for _, t, s in rows if s == n) for n in names]
    want = mixing.targets(sizes, [1, 2, 3, 1])
    by = defaultdict(list)
    for r in got:
        assert r.taken <= 3 * r.size
        by[r.source_size, r.target].append(r.taken)
    assert sorted(by) == sorted(zip(sizes, want, strict=True))
    for (_, target), taken in by.items():
        assert abs(sum(taken) - target) <= 1


def test_the_plan_is_joined_without_python(spark):
    docs = spark.createDataFrame([(1, "x y", None), (2, "z", "a")], "doc_id long, text string, source string")
    for made in (mixing.mix_report(docs), mixing.mixed_texts(docs)):
        assert "ExistingRDD" not in made._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.doc_id, r.source_size, r.taken) for r in mixing.mix_report(docs).collect()) == [(1, 2, 2), (2, 1, 1)]


def test_mixed_texts_hold_the_words_taken(spark):
    rows = [(i, "".join(f"d{i}w{k}{' ' if k % 3 else chr(10)}" for k in range(7 * i)), "abc"[i % 3], i) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars int")
    made = mixing.mixed_texts(docs, block=8)
    assert made.columns == docs.columns
    taken = {r.doc_id: r.taken for r in mixing.mix_report(docs, block=8).collect() if r.taken}
    got = defaultdict(int)
    for r in made.collect():
        assert r.text in rows[r.doc_id][1] and r.n_chars == len(r.text)
        got[r.doc_id] += len(r.text.split())
    assert got == taken
    assert mixing.mixed_texts(docs.limit(0)).count() == 0
