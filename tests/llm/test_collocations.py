"""Phrase counts and reports against plain counting."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from graphlens.llm import collocations

LAYOUT = "lang string, text string, phrase string, k int, n int, rank int"
PIECES, GAPS = re.compile("[.,;:!?\x0a-\x0d]"), re.compile("[\x20\x09]+")


def pieces(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in ([x for x in GAPS.split(p) if x] for p in PIECES.split(low)) if w]


def grams(docs):
    f = Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for ws in pieces(text):
            for i in range(len(ws)):
                for k in range(1, min(4, len(ws) - i) + 1):
                    f[lang, *ws[i : i + k]] += 1
                f[lang,] += 1
    return f


def plain(docs, least, reported):
    f = grams(docs)
    found = {}
    for g, a in f.items():
        if len(g) > 2 and a >= least:
            cuts = [(2_000_000 * a // (f[g[:j]] + f[g[0], *g[j:]]), j) for j in range(2, len(g))]
            score, j = min(cuts)
            found[g] = (score, a, f[g[:j]], f[g[0], *g[j:]])
    dropped = {
        (g[0], *g[i : i + n]) for g in found for n in range(2, len(g) - 1) for i in range(1, len(g) - n + 1)
        if 100 * f[g] >= 80 * f[(g[0], *g[i : i + n])]
    }
    out = []
    for lang in {g[0] for g in found}:
        mine = sorted(((g, s) for g, s in found.items() if g[0] == lang and g not in dropped), key=lambda x: (-x[1][0], -x[1][1], " ".join(x[0][1:]).encode()))
        out += [(lang, k + 1, " ".join(g[1:]), s[1], s[2], s[3], f[lang,], s[0]) for k, (g, s) in enumerate(mine[:reported])]
    return sorted(out)


def corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "of", "new", "york", "city", "é", "漢字", "x-y", "a'b", " ", "\x00"] + [f"w{k}" for k in range(8)]
    out = []
    for _ in range(n):
        said = [rng.choice(["new york city hall", "the the the the the", "of the new", rng.choice(vocabulary)]) + rng.choice([" ", "  ", "\t", ", ", ".", "\n", " !? "]) for _ in range(rng.randint(0, 30))]
        out.append((rng.choice(["en", "de", None, "und", ""]), "".join(said)))
    return out


@pytest.mark.parametrize(("seed", "least", "reported"), [(1, 30, 2000), (2, 3, 7)])
def test_report_equals_plain_counting(spark, monkeypatch, seed, least, reported):
    docs = corpus(seed, 300) + [("en", None), (None, ""), ("fr", ". , !"), ("en", "new york " * 4000)]
    monkeypatch.setattr(collocations, "SLICE", 700)
    monkeypatch.setattr(collocations, "FEWEST_BITS", 64)
    df = spark.createDataFrame([(lang, text, "p", 1, 2, 3) for lang, text in docs], LAYOUT)
    got = sorted(tuple(r) for r in collocations.collocations(df, least=least, reported=reported).collect())
    assert got == plain(docs, least, reported) and got


def test_nothing_to_count(spark):
    for rows in ([], [(None, None, "p", 1, 2, 3)], [("en", " . ", "p", 1, 2, 3)]):
        assert collocations.collocations(spark.createDataFrame(rows, LAYOUT)).collect() == []


def test_windows_of_long_texts_do_not_depend_on_slices():
    text = ("one two, three four five six seven. " * 50 + "a b c d e f " * 100) * 3
    batch = pa.RecordBatch.from_pydict({"lang": ["x"], "text": [text]})
    seen = []
    for limit in (10, 200, 1 << 20):
        total = Counter()
        for words, langs in collocations._read(batch, limit):
            w = collocations.windows(words, langs).to_pydict()
            for row in zip(*(w[c] for c in collocations.WORDS), w["n"], strict=True):
                total[row[:-1]] += row[-1]
        seen.append(total)
    assert seen[0] == seen[1] == seen[2] and sum(seen[0].values()) == sum(len(p) for p in pieces(text))


def test_windows_end_at_rare_words_pairs_and_triples():
    batch = pa.RecordBatch.from_pydict({"lang": ["x"], "text": ["a b c d"]})
    ((words, langs),) = collocations._read(batch)
    none, every = np.zeros(8, np.uint8), np.full(8, 255, np.uint8)
    empty = collocations.windows(words, langs, none).to_pydict()
    assert empty == {"lang": ["x"], **{w: [""] for w in collocations.WORDS}, "n": [4]}
    two = collocations.windows(words, langs, every, none).to_pydict()
    assert sorted(zip(two["w1"], two["w2"], strict=True)) == [("a", "b"), ("b", "c"), ("c", "d"), ("d", "")] and set(two["w3"]) == {""}
