"""Secret scans and the quality classifier."""

import hashlib
import re
import zlib

import numpy as np

from graphlens.llm import gam, ownership
from graphlens.llm.text_features import NAMES, features
from graphlens.llm.common import text_buffers

LIVE = "aZ3kQ9xL2mV7pR5tY8wB1cD4"
KEY = "AKIA" + "Q7ZX4M2N8P1R5T9V"
HEX = "0123456789abcdef" * 2


def base(text):
    """The base patterns as they are written down, without any shortcut."""
    found = []
    assign = r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    found += [(m.start(), 0, m.end()) for m in re.finditer(assign, text) if len(m[2]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 32]
    return [f"{ownership.KINDS[k]}:{s}:{e}" for s, k, e in sorted(found)]


def test_base_spans_and_ownership(spark):
    texts = [
        ("a", f"é\U0001f600 password = '{LIVE}' end"), ("a", "token:token:abcdefgh12 token=short"), ("b", f"{KEY} and {KEY[:12]} and xAKIAAKIA{KEY}"), ("c", f"id {HEX}f, {HEX[:31]}"),
        ("a", f"bare {LIVE} again"), ("b", "see EXAMPLE9key8value7here6now"), ("c", "see EXAMPLE9key8value7here6now"), ("d", "see EXAMPLE9key8value7here6now"),
        (None, "paſſword=abcdefghi toKen=abcdefghi TOKEN = abcdefghi"), ("a", None), ("a", ""), ("a", "x" * 100_000 + " api_key: abcdefgh"), ("a", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaa1"),
    ]
    docs = spark.createDataFrame([(i, t, s, "en") for i, (s, t) in enumerate(texts)] + [(3, texts[3][1], "c", "en")], "doc_id long, text string, source string, lang string")
    got = {r.doc_id: r for r in ownership.find_secrets(docs.selectExpr("*", "1 as row", "2 as spans")).collect()}
    assert len(got) == len(texts)
    for i, (_, text) in enumerate(texts):
        want = base(text or "")
        r = got[i]
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [sum(w.startswith(k) for w in want) for k in ("assign", "access", "hex")] == [r.n_assign, r.n_access, r.n_hex]
        assert set(want) <= set(r.spans.split(","))
    assert got[4].spans == f"token:5:{5 + len(LIVE)}" and got[4].n_live == 1  # one owner
    assert [got[i].spans for i in (5, 6, 7)] == [""] * 3 and got[5].n_copied == 1  # three owners
    assert got[12].spans == ""  # too regular to be live
    assert ownership.find_secrets(docs.limit(0)).count() == 0


def test_features_of_many_texts_equal_those_of_each():
    texts = ["", None, "One two. Two!\nThree | four\n\nOne two.", "x", "### *** ###", " \n ", "a b c d e f a b c d e f", "ünï cödé 漢字."]
    import pyarrow as pa

    every = features(*text_buffers(pa.array(texts)))
    for i, t in enumerate(texts):
        assert np.allclose(every[i], features(*text_buffers(pa.array([t])))[0])
    assert every.shape[1] == len(NAMES) and not every[0].any() and not every[1].any() and not every[5].any()
    assert features(*text_buffers(pa.array([], pa.string()))).shape == (0, len(NAMES))


def test_model_learns_single_features_and_pairs():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(4000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)  # nothing but an interaction
    model = gam.train(x[:3000], y[:3000], rounds=20)
    assert (0, 1) in model.pairs and ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.9
    assert np.allclose(gam.train(x, np.ones(4000)).score(x), 0.999, atol=1e-3)
    assert gam.train(np.zeros((0, 4)), np.zeros(0)).score(np.zeros((2, 4))).tolist() == [0.5, 0.5]


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    extra = spark.createDataFrame([(None, None), (-1, ""), (-2, "x " * 60_000), (-2, "x " * 60_000)], "doc_id long, text string")
    rows = gam.classify(docs.select("doc_id", "text").unionByName(extra).selectExpr("*", "1 as score", "2 as held_out"), labels).collect()
    assert len(rows) == docs.count() + 4 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows if r.doc_id is not None)
    truth = {r.doc_id: r.quality for r in labels.collect()}
    seen = [(r.predicted, truth[r.doc_id]) for r in rows if r.held_out and r.doc_id in truth]
    assert len(seen) > 40 and np.mean([a == b for a, b in seen]) > 0.95
    none = gam.classify(docs.limit(5), labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5} and gam.classify(docs.limit(0), labels).count() == 0
