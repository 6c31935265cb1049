"""Phrases whose words keep company, from one count of the longest windows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlens.functions.skew import running_total, split_hot_join
from graphlens.llm.common import FOLD, Substrings, mix, slices, small_batches, text_buffers
from graphlens.session import cut, forget

LONGEST = 4
LEAST = 30
REPORTED = 2000
NO_LANG = "und"
SLICE = 500_000
SPREAD = 4096
BITS_EACH, FEWEST_BITS, MOST_BITS = 64, 1 << 16, 1 << 30
WORDS = [f"w{k}" for k in range(1, LONGEST + 1)]
U64 = np.uint64
STEP = U64(0x9E3779B97F4A7C15)

GAP = np.zeros(256, bool)  # between words
GAP[[9, 32]] = True
END = np.zeros(256, bool)  # between pieces
END[[*b".,;:!?", 10, 11, 12, 13]] = True

GRAMS = pa.schema([("gram", pa.int64()), ("n", pa.int64())])
WINDOWS = pa.schema([("lang", pa.string()), *((w, pa.string()) for w in WORDS), ("n", pa.int64())])


class Words:
    """The words of some texts, in order: where they are, their hashes, and which are followed by one of their piece."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, langs: np.ndarray):
        self.raw = FOLD[raw]
        inside = ~(GAP | END)[raw]
        edge = np.zeros(len(raw) + 1, bool)
        edge[offsets] = True
        before, after = np.concatenate([[False], inside[:-1]]), np.concatenate([inside[1:], [False]])
        self.starts = np.flatnonzero(inside & (~before | edge[:-1]))
        self.ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.rows = np.searchsorted(offsets, self.starts, side="right") - 1
        closed = np.concatenate([[0], np.cumsum(END[raw])])
        self.hashes = Substrings(self.raw).of(self.starts, self.ends)
        self.langs = langs[self.rows]
        self.follows = np.zeros(len(self.starts), bool)
        self.follows[:-1] = (self.rows[1:] == self.rows[:-1]) & (closed[self.starts[1:]] == closed[self.ends[:-1]])

    def singles(self) -> np.ndarray:
        """A hash of language and word for every word."""
        return mix(self.hashes + self.langs)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Words with a follower, and a hash of language, word and follower."""
        at = np.flatnonzero(self.follows)
        return at, mix(self.hashes[at] * STEP + mix(self.hashes[at + 1] + self.langs[at]))

    def triples(self, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words that begin two overlapping pairs marked in `pair`, and a hash of language and the three words."""
        at = np.flatnonzero(pair[:-1] & pair[1:])
        return at, mix(mix(self.hashes[at] * STEP + mix(self.hashes[at + 1] + self.langs[at])) * STEP + self.hashes[at + 2])

    def text(self, index: np.ndarray) -> pa.Array:
        """The words of that index, empty for -1."""
        none = index < 0
        sizes = np.where(none, 0, self.ends[index] - self.starts[index])
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        taken = self.raw[np.repeat(self.starts[index] - offsets[:-1], sizes) + np.arange(offsets[-1])]
        return pa.StringArray.from_buffers(len(index), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(taken.tobytes()))


def _portions(raw: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Stretches of about `limit` bytes of one text, cut at ends of pieces; a piece is never cut."""
    if len(raw) <= 2 * limit:
        yield 0, len(raw)
        return
    ends, first = np.flatnonzero(END[raw]) + 1, 0
    while first < len(raw):
        k = int(np.searchsorted(ends, first + limit))
        last = int(ends[k]) if k < len(ends) else len(raw)
        yield first, last
        first = last


def _read(batch: pa.RecordBatch, limit: int | None = None) -> Iterator[tuple[Words, pa.Array]]:
    """The words of a batch (lang, text), a MB of text at a time, with the languages of their rows."""
    limit = limit or SLICE
    raw, offsets = text_buffers(batch.column("text"))
    names = batch.column("lang").dictionary_encode()
    keys = np.array([xxhash.xxh64_intdigest(v.encode()) for v in names.dictionary.to_pylist()], U64)
    langs = keys[names.indices.to_numpy()]
    for a, b in slices(offsets, limit):
        own, at = raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        if b - a > 1:
            yield Words(own, at, langs[a:b]), batch.column("lang").slice(a, b - a)
        else:
            for first, last in _portions(own, limit):
                yield Words(own[first:last], np.array([0, last - first]), langs[a:b]), batch.column("lang").slice(a, 1)


def _within(common: np.ndarray | None, grams: np.ndarray) -> np.ndarray:
    """Which hashes a bit map holds; without a map, all."""
    if common is None:
        return np.ones(len(grams), bool)
    bit = grams >> U64(64 - (len(common) * 8).bit_length() + 1)
    return (common[(bit >> U64(3)).astype(np.int64)] >> (bit & U64(7)).astype(np.uint8) & 1).astype(bool)


def _marked(words: Words, short: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Per word, whether it can be common, and whether the pair it begins can be."""
    pair = np.zeros(len(words.starts), bool)
    at, pairs = words.pairs()
    pair[at] = _within(short, pairs)
    return _within(short, words.singles()), pair


def windows(words: Words, langs: pa.Array, short: np.ndarray | None = None, long: np.ndarray | None = None) -> pa.RecordBatch:
    """The window of each word, as far as its piece goes and its words, pairs and triples can be common; equal ones counted together."""
    here = np.arange(len(words.starts))
    single, pair = _marked(words, short)
    triple = np.zeros(len(here), bool)
    at, triples = words.triples(pair)
    triple[at] = _within(long, triples)
    pair &= single
    triple &= single
    both = triple & np.concatenate([triple[1:], [False]])
    held = [np.where(goes, here + k, -1) for k, goes in enumerate((single, pair, triple, both))]
    key = words.langs.copy()
    for k, place in enumerate(held):
        key = mix(key * STEP + np.where(place < 0, U64(k + 1), words.hashes[place]))
    _, first, counts = np.unique(key, return_index=True, return_counts=True)
    return pa.RecordBatch.from_arrays(
        [langs.take(pa.array(words.rows[first])).cast(pa.string()), *(words.text(h[first]) for h in held), pa.array(counts)], schema=WINDOWS
    )


def common_grams(texts: DataFrame, least: int, short: np.ndarray | None = None) -> np.ndarray:
    """A bit map that holds every word and pair with `least` occurrences in its language; with that map, every triple.

    Words and pairs are counted by hash, and then the triples of pairs in the map. So
    all that are common are in it, and 1 in 64 others. There are 64 bits for each that
    is common, and at most 2^30: beyond 16 million common ones a map lets more of the
    others through, which costs rows but changes nothing.
    """
    held = None if short is None else texts.sparkSession.sparkContext.broadcast(short)

    def run(batches):
        for batch in batches:
            for words, _ in _read(batch):
                grams = np.concatenate([words.singles(), words.pairs()[1]]) if held is None else words.triples(_marked(words, held.value)[1])[1]
                found, n = np.unique(grams, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], schema=GRAMS)

    counted = small_batches(texts).mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    kept = cut(counted.select("gram"))
    bits = FEWEST_BITS
    wanted = kept.count() * BITS_EACH
    while bits < min(wanted, MOST_BITS):
        bits *= 2
    marks = kept.select(F.shiftrightunsigned("gram", 64 - bits.bit_length() + 1).alias("bit")).distinct()
    # the words of 64 bits that are not empty, each made of at most 64 rows
    parts = marks.groupBy(F.shiftright("bit", 6).alias("at")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("word"))
    blocks = parts.groupBy(F.shiftright("at", 9).alias("block")).agg(F.collect_list(F.struct("at", "word")).alias("words"))
    out = np.zeros(bits // 64, U64)
    for r in blocks.select("words.at", "words.word").toLocalIterator():
        out[np.array(r[0], np.int64)] = np.array(r[1], np.int64).view(U64)
    forget(kept)
    return out.view(np.uint8)


def phrase_counts(texts: DataFrame, least: int = LEAST) -> DataFrame:
    """(lang, k, phrase, f): every phrase of k = 1 to 4 words with `least` occurrences, and per language all words (k = 0).

    Every word opens one window: itself and the words after it in its piece, up to
    four, padded with empty ones. Only these longest windows are counted; Spark's
    ROLLUP over their columns then sums shorter and shorter prefixes, down to the
    words and the language. A window ends early where its next pair or triple of words
    cannot be common, as no common phrase holds it, and is empty where its first word
    cannot be; it still counts for the prefixes that can, and for the language.
    """
    share = texts.sparkSession.sparkContext.broadcast
    pairs = common_grams(texts, least)
    short, long = share(pairs), share(common_grams(texts, least, pairs))

    def run(batches):
        for batch in batches:
            for words, langs in _read(batch):
                if len(words.starts):
                    yield windows(words, langs, short.value, long.value)

    columns = ["lang", *WORDS]
    counted = small_batches(texts).mapInArrow(run, ", ".join(f"{c} string" for c in columns) + ", n long")
    counted = counted.groupBy(*columns).agg(F.sum("n").alias("n"))
    rolled = counted.rollup(*columns).agg(F.sum("n").alias("f"), F.grouping_id().alias("rolled"))
    k = LONGEST - F.bit_count("rolled")
    last = F.coalesce(*[F.col(w) for w in reversed(WORDS)], F.lit(" "))
    return rolled.where((k >= 0) & (last != "") & ((k == 0) | (F.col("f") >= least))).select(
        "lang", k.alias("k"), F.concat_ws(" ", *WORDS).alias("phrase"), "f"
    )


def _words(first: Column, n: Column) -> Column:
    return F.array_join(F.slice("parts", first, n), " ")


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = LEAST, reported: int = REPORTED) -> DataFrame:
    """Each language's first phrases by score: lang, rank, phrase, a, l, r, n, score.

    Words are what stands between blanks in the pieces of a text; phrases are two to
    four in a row that occur `least` times. A phrase scores by its weakest cut:
    2,000,000 times its count by the sum of its parts' counts, rounded down, in
    decimals. Phrases inside a longer one with at least 80 % of their count are left
    out. Ties go to the more frequent, then the smaller phrase.

    Null texts are empty, null languages `und`, repeated rows count again, and empty
    tables have no phrases. Words of a very long text are read a MB at a time, cut
    between pieces; one piece is held whole. Common parts are joined in slices, and
    ranks are counted over ranges, so no language or word is gathered in one task.
    Other columns are left out.
    """
    texts = docs.select(
        F.coalesce(F.col(lang_col).cast("string"), F.lit(NO_LANG)).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text")
    )
    counts = cut(phrase_counts(texts, least))
    phrases = counts.where("k > 1").select("lang", "phrase", F.col("f").alias("a"), "k", F.split("phrase", " ").alias("parts"))
    k = F.col("k")
    halves = phrases.select("lang", "phrase", "a", "k", "parts", F.explode(F.sequence(F.lit(1), k - 1)).alias("cut")).select(
        "lang", "phrase", "a", "cut", F.posexplode(F.array(_words(F.lit(1), F.col("cut")), _words(F.col("cut") + 1, k - F.col("cut")))).alias("side", "part")
    )
    known = counts.where("k between 1 and 3").select("lang", F.col("phrase").alias("part"), "f")
    side = lambda s: F.sum(F.when(F.col("side") == s, F.col("f")))
    scored = (
        split_hot_join(halves, known, ["lang", "part"], F.col("phrase"), hot_rows=SPREAD)
        .groupBy("lang", "phrase", "a", "cut").agg(side(0).alias("l"), side(1).alias("r"))
        .withColumn("score", F.expr("cast(2000000 as decimal(7, 0)) * cast(a as decimal(20, 0)) div (cast(l as decimal(20, 0)) + cast(r as decimal(20, 0)))"))
        .groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("s")).select("lang", "phrase", "a", "s.score", "s.l", "s.r")
    )
    inner = F.flatten(F.transform(F.sequence(F.lit(2), k - 1), lambda n: F.transform(F.sequence(F.lit(1), k - n + 1), lambda i: _words(i, n))))
    covered = (
        phrases.where("k > 2").select("lang", F.col("a").alias("most"), F.explode(inner).alias("phrase"))
        .groupBy("lang", "phrase").agg(F.max("most").alias("most"))
    )
    wide = lambda c, by: F.col(c).cast("decimal(20, 0)") * F.lit(by).cast("decimal(3, 0)")
    kept = scored.join(covered, ["lang", "phrase"], "left").where(F.col("most").isNull() | (wide("most", 100) < wide("a", 80)))
    keyed = kept.select("lang", (-F.col("score")).alias("by_score"), (-F.col("a")).alias("by_count"), "phrase", "a", "l", "r", "score")
    ranked = running_total(keyed, ["lang"], ["by_score", "by_count", "phrase"], F.lit(1), "earlier").where(F.col("earlier") < reported)
    totals = counts.where("k = 0").select("lang", F.col("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", (F.col("earlier") + 1).cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


SQL = r"""
WITH pieces AS (
    SELECT lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n-\r]')) AS piece
    FROM (SELECT coalesce(lang, 'und') AS lang, coalesce(text, '') AS text FROM documents) d
), worded AS (
    SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda w: w <> '') AS ws FROM pieces
), counted AS MATERIALIZED (
    SELECT lang, k, phrase, count(*) AS f
    FROM (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase
          FROM worded, (SELECT unnest(range(1, 5)) AS k) k) g
    GROUP BY 1, 2, 3
), candidates AS (
    SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM counted WHERE k > 1 AND f >= 30
), halves AS MATERIALIZED (
    SELECT lang, phrase, a, i, array_to_string(ws[1:i], ' ') AS left_part, array_to_string(ws[i + 1:], ' ') AS right_part
    FROM candidates, (SELECT unnest(range(1, 4)) AS i) i WHERE i < k
), lefts AS MATERIALIZED (
    SELECT h.*, c.f AS l FROM halves h JOIN counted c ON c.lang = h.lang AND c.phrase = h.left_part
), cuts AS MATERIALIZED (
    SELECT h.lang, h.phrase, a, i, l, c.f AS r, CAST(2000000::HUGEINT * a // (l + c.f) AS BIGINT) AS score
    FROM lefts h JOIN counted c ON c.lang = h.lang AND c.phrase = h.right_part
), scored AS (
    SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, i) = 1
), covered AS (
    SELECT lang, phrase, max(a) AS most
    FROM (SELECT lang, a, unnest(list_transform(range(1, k - n + 2), lambda i: array_to_string(ws[i:i + n - 1], ' '))) AS phrase
          FROM candidates, (SELECT unnest([2, 3]) AS n) n WHERE n < k) s
    GROUP BY 1, 2
), ranked AS (
    SELECT s.*, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.phrase) AS rank
    FROM scored s LEFT JOIN covered c ON c.lang = s.lang AND c.phrase = s.phrase
    WHERE c.most IS NULL OR 100::HUGEINT * c.most < 80::HUGEINT * s.a
)
SELECT r.lang, rank, phrase, a, l, r, n, score
FROM ranked r JOIN (SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM counted WHERE k = 1 GROUP BY 1) t ON t.lang = r.lang
WHERE rank <= 2000
"""
