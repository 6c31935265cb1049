"""Near-duplicate documents by order MinHash and banded alignment."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlens.llm.common import FOLD, U64, Substrings, connected, map_slices, mix, per_row, slices, small_batches, words
from graphlens.llm.edits import banded
from graphlens.session import cut

SHINGLE = 5
BANDS = 8
KEPT = 2
SIMILARITY = 0.8
FULL = 48
GRAM = 2
CHUNK = 1024
SLOTS = 22
RUN = 500_000
TOP = U64(0xFFFFFFFFFFFFFFFF)


def labelled_shingles(keys: np.ndarray, rows: np.ndarray, n: int, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word shingles of each row, and the bounds of the rows among them.

    A shingle that occurs again in its row is told apart by which occurrence it
    is. A row of fewer words than a shingle has one, of all its words.
    """
    bounds = np.searchsorted(rows, np.arange(n + 1))
    count = np.diff(bounds)
    made = np.maximum(count - shingle + 1, np.minimum(count, 1))
    out_bounds = np.concatenate([[0], np.cumsum(made)])
    row = np.repeat(np.arange(n), made)
    first = bounds[row] + np.arange(len(row)) - out_bounds[row]
    end = bounds[row + 1] if len(row) else first
    out = np.zeros(len(row), U64)
    for j in range(shingle):
        at = first + j
        out = mix(out + np.where(at < end, keys[np.minimum(at, max(len(keys) - 1, 0))] if len(keys) else U64(0), U64(j)))
    spread = out ^ mix(row.astype(U64) + U64(1))
    ordered = np.sort(spread)
    again = ordered[1:][ordered[1:] == ordered[:-1]]
    if len(again):
        where = np.flatnonzero(np.isin(spread, again))
        order = where[np.argsort(spread[where], kind="stable")]
        same = np.concatenate([[False], spread[order][1:] == spread[order][:-1]])
        begin = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
        nth = (np.arange(len(order)) - begin).astype(U64)
        out[order] = np.where(nth > 0, mix(out[order] + nth * U64(0xD1B54A32D192ED03)), out[order])
    return out, out_bounds


def sketch(shingles: np.ndarray, bounds: np.ndarray, bands: int, kept: int) -> np.ndarray:
    """Per row and band: a key of the `kept` shingles with the smallest hashes, in the order of the text."""
    n = len(bounds) - 1
    out = np.zeros((n, bands), U64)
    full = np.diff(bounds) > 0
    row = np.repeat(np.arange(n), np.diff(bounds))
    for b in range(bands):
        value = mix(shingles ^ mix(np.array([b + 1], U64)))
        places = np.full((n, kept), len(shingles), np.int64)
        for k in range(kept):
            least = per_row(value, bounds, np.minimum, TOP)
            hit = np.flatnonzero(value == least[row]) if len(row) else row
            hit = hit[value[hit] != TOP]
            first = hit[np.concatenate([[True], row[hit][1:] != row[hit][:-1]])] if len(hit) else hit
            places[row[first], k] = first
            value[first] = TOP
        places.sort(axis=1)
        padded = np.append(shingles, U64(0))
        key = np.full(n, U64(b + 11), U64)
        for k in range(kept):
            key = mix(key * U64(3) + padded[places[:, k]])
        out[:, b] = key
    out[~full] = 0
    return out


def sketches(docs: DataFrame, shingle: int = SHINGLE, bands: int = BANDS, kept: int = KEPT) -> DataFrame:
    """(id, version, content, n_words, keys) of (id, text) rows; no content and no keys without words."""
    arrow = pa.schema([
        ("id", pa.int64()), ("version", pa.int64()), ("content", pa.int64()), ("n_words", pa.int64()), ("keys", pa.list_(pa.int64())),
    ])

    def make(rows, raw, offsets):
        starts, ends, of = words(raw, offsets)
        n = len(offsets) - 1
        count = np.bincount(of, minlength=n)
        keys = Substrings(FOLD[raw]).of(starts, ends)
        bounds = np.searchsorted(of, np.arange(n + 1))
        place = (np.arange(len(of)) - bounds[of]).astype(U64)
        content = mix(per_row(mix(keys + place * U64(0x9E3779B97F4A7C15)), bounds, np.add, U64(0)) + count.astype(U64))
        made = sketch(*labelled_shingles(keys, of, n, shingle), bands, kept).view(np.int64)
        ends_of = np.concatenate([[0], np.cumsum(np.where(count > 0, bands, 0))]).astype(np.int32)
        return {
            "id": rows.column(0), "version": rows.column(1), "content": pa.array(content.view(np.int64), mask=count == 0), "n_words": pa.array(count),
            "keys": pa.ListArray.from_arrays(pa.array(ends_of), pa.array(made[count > 0].ravel())),
        }

    return map_slices(
        docs.select("id", F.xxhash64("text").alias("version"), "text"), "text",
        "id long, version long, content long, n_words long, keys array<long>", arrow, make,
    )


def _fits(similarity: float):
    return F.least("n_a", "n_b") >= similarity * F.greatest("n_a", "n_b")


def _aligned(pairs: DataFrame, texts: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose words align with at most (1 - similarity) of the longer edited."""

    def word_keys(text: str) -> list[int]:
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        starts, ends, _ = words(raw, np.array([0, len(raw)]))
        return Substrings(FOLD[raw]).of(starts, ends).tolist()

    def verify(batches):
        held, other = None, []
        for batch in batches:
            near = []
            for a, b, one, two in zip(*(batch.column(i) for i in range(4)), strict=True):
                if b.as_py() != held:
                    held, other = b.as_py(), word_keys(two.as_py())
                mine = word_keys(one.as_py())
                limit = int((1 - similarity) * max(len(mine), len(other)) + 1e-9)
                near.append(banded(mine, other, limit) <= limit)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(near, pa.bool_()))

    both = pairs.join(texts.select(F.col("content").alias("a"), F.col("text").alias("text_a")), "a").join(
        texts.select(F.col("content").alias("b"), F.col("text").alias("text_b")), "b"
    )
    return small_batches(both.select("a", "b", "text_a", "text_b")).mapInArrow(verify, "a long, b long")


def _word_keys(texts: DataFrame) -> DataFrame:
    """(content, words): the 64-bit hashes of each text's words, in order."""
    arrow = pa.schema([("content", pa.int64()), ("words", pa.binary())])

    def make(rows, raw, offsets):
        starts, ends, of = words(raw, offsets)
        keys = Substrings(FOLD[raw]).of(starts, ends)
        bounds = np.searchsorted(of, np.arange(len(offsets)))
        return {"content": rows.column(0), "words": pa.array([keys[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary())}

    return map_slices(texts.select("content", "text"), "text", "content long, words binary", arrow, make)


def _slots(keys: np.ndarray, bounds: np.ndarray, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Slots of each text's runs of `gram` words, repeated ones told apart, and the bounds of the texts among them."""
    made, count = [], []
    for a, b in slices(bounds, RUN):
        rows = np.repeat(np.arange(b - a), np.diff(bounds[a : b + 1]))
        out, at = labelled_shingles(keys[bounds[a] : bounds[b]], rows, b - a, gram)
        made.append((out >> U64(64 - SLOTS)).astype(np.uint32))
        count.append(np.diff(at))
    return np.concatenate(made), np.concatenate([[0], np.cumsum(np.concatenate(count))])


def _links(pdf: pd.DataFrame, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j) of a block whose words align, as many as tie together what aligns and had different roots.

    An edit changes at most g of a text's runs of g words, so two texts that align
    within k edits share all but g * k of the longer's. Pairs that do, for words and
    for word pairs, are aligned, unless links found before already put them in one
    class or an earlier key of both, whose bucket has them too. Nothing that aligns is
    lost; runs that meet in a slot by chance only let more through.
    """
    pdf.sort_values(["n", "content"], inplace=True, ignore_index=True)
    n, side = pdf["n"].to_numpy(), pdf["chunk"].to_numpy()
    _, root = np.unique(pdf["root"].to_numpy(), return_inverse=True)
    most, label = np.bincount(root).argmax(), root.copy()
    bands = np.array(pdf["keys"].tolist(), np.int64)
    earlier = bands[:, : int((bands[0] == pdf["key"].iloc[0]).argmax())]
    keys = np.frombuffer(b"".join(pdf["words"]), U64)
    bounds = np.concatenate([[0], np.cumsum([len(w) // 8 for w in pdf["words"]])])
    single, ends = _slots(keys, bounds, 1)
    double, ends_2 = _slots(keys, bounds, GRAM)
    mark = np.zeros(1 << SLOTS, np.int32)
    across, place = pdf["lo"].iloc[0] != pdf["hi"].iloc[0], np.arange(len(pdf))
    kept: list[tuple[int, int]] = []
    # pairs with the most common root are seen from their other side
    for i in np.flatnonzero(root != most).tolist():
        a, b = np.searchsorted(n, [similarity * n[i] - 1, n[i] / similarity + 1])
        wanted = (label[a:b] != label[i]) & ((place[a:b] > i) | (root[a:b] == most))
        wanted &= np.minimum(n[a:b], n[i]) >= similarity * np.maximum(n[a:b], n[i])
        wanted &= ~(earlier[a:b] == earlier[i]).any(axis=1)
        if across:
            wanted &= side[a:b] != side[i]
        if not wanted.any():
            continue
        own = single[ends[i] : ends[i + 1]]
        mark[own] = 1
        shared = np.add.reduceat(mark[single[ends[a] : ends[b]]], ends[a:b] - ends[a])
        mark[own] = 0
        longer = np.maximum(n[a:b], n[i])
        limit = ((1 - similarity) * longer + 1e-9).astype(np.int64)
        maybe = np.flatnonzero(wanted & (shared >= longer - limit))
        own, mine = double[ends_2[i] : ends_2[i + 1]], None
        mark[own] = 1
        for o in maybe[np.argsort(-shared[maybe], kind="stable")].tolist():
            j = a + o
            if label[j] == label[i] or mark[double[ends_2[j] : ends_2[j + 1]]].sum() < longer[o] - GRAM + 1 - GRAM * limit[o]:
                continue
            mine = keys[bounds[i] : bounds[i + 1]].tolist() if mine is None else mine
            if banded(mine, keys[bounds[j] : bounds[j + 1]].tolist(), int(limit[o])) <= limit[o]:
                label[label == label[j]] = label[i]
                kept.append((i, j))
        mark[own] = 0
    made = np.array(kept, np.int64).reshape(-1, 2)
    return made[:, 0], made[:, 1]


def _within(members: DataFrame, contents: DataFrame, similarity: float, chunk: int = CHUNK) -> DataFrame:
    """Links (a, b) that join the classes so far of full buckets (key, content, n, root) wherever their words align.

    Contents are (content, words, keys). Buckets are cut into chunks by a hash, every two
    chunks of a bucket meet in a task, and the pairs are aligned there: no more
    links leave it than it takes to join its rows, however many pairs there are.
    """
    open_ = members.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.ceil(F.count("*") / chunk).cast("int").alias("chunks"))
    dealt = (
        members.select("key", "content", "n", "root").join(open_.where("x <> y").select("key", "chunks").hint("merge"), "key")
        .join(contents.hint("merge"), "content").withColumn("chunk", F.pmod(F.xxhash64("content"), F.col("chunks")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        .select("key", F.least("chunk", "other").alias("lo"), F.greatest("chunk", "other").alias("hi"), "chunk", "content", "n", "root", "words", "keys")
    )

    def groups(batches) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:
            if held is not None and len(held):
                pdf = pd.concat([held, pdf], ignore_index=True)
            if not len(pdf):
                continue
            at = pdf[["key", "lo", "hi"]].to_numpy()
            new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]).any(axis=1)]))
            for a, b in zip(new[:-1], new[1:], strict=True):
                yield pdf.iloc[a:b].copy()
            held = pdf.iloc[new[-1] :]
        if held is not None and len(held):
            yield held.copy()

    def run(batches):
        for pdf in groups(batches):
            if len(pdf) > 1:
                i, j = _links(pdf, similarity)
                one, two = pdf["content"].to_numpy()[i], pdf["content"].to_numpy()[j]
                yield pd.DataFrame({"a": np.maximum(one, two), "b": np.minimum(one, two)})

    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = dealt.repartition(n, "key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")
    return small_batches(dealt).mapInPandas(run, "a long, b long").distinct()


def _across(members: DataFrame, similarity: float) -> DataFrame:
    """Pairs (a, b) of like size in one bucket and in different classes so far."""
    left = members.select("key", "size", F.col("content").alias("a"), F.col("n").alias("n_a"), F.col("root").alias("r_a"))
    right = members.select(
        "key", F.explode(F.array(F.col("size"), F.col("size") + 1)).alias("size"), F.col("size").alias("own"),
        F.col("content").alias("b"), F.col("n").alias("n_b"), F.col("root").alias("r_b"),
    )
    # equal sizes meet once, by content; neighbouring ones once, from the smaller
    once = (F.col("own") != F.col("size")) | (F.col("a") > F.col("b"))
    return (
        left.join(right, ["key", "size"]).where((F.col("r_a") != F.col("r_b")) & once & _fits(similarity))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    )


def classes(
    docs: DataFrame, shingle: int = SHINGLE, bands: int = BANDS, kept: int = KEPT, similarity: float = SIMILARITY,
    full: int = FULL,
) -> DataFrame:
    """(id, version, n_words, class_id, kept) for every row of (id, text).

    Texts with the same words are one content. Contents that share a key in a band
    are candidates; candidates are linked if their words align within the
    similarity, and links over others make one class.

    A bucket of candidates is first held against one of its members, which joins
    large groups of copies without forming their pairs. What the links found so
    leave in different classes of one bucket is then compared pair by pair. In
    buckets of more than `full` that is done within tasks, which hand out links only.
    """
    every = cut(sketches(docs, shingle, bands, kept))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "version"))
    contents = cut(
        every.where("content is not null").groupBy("content")
        .agg(first.alias("first"), F.first("n_words").alias("n"), F.first("keys").alias("keys"))
    )
    size = F.floor(F.log("n") / F.lit(-np.log(similarity)))
    shared = contents.select("content", "n", F.explode("keys").alias("key"))
    several = shared.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key")
    buckets = cut(shared.join(several, "key").withColumn("size", size))
    hubs = buckets.groupBy("key", "size").agg(F.min(F.struct("content", "n")).alias("hub"))
    # the sizes of two that may be alike are equal or adjacent
    reach = hubs.select("key", F.explode(F.array(F.col("size") - 1, F.col("size"), F.col("size") + 1)).alias("size"), "hub")
    starred = cut(
        buckets.join(reach, ["key", "size"])
        .select(F.col("content").alias("a"), F.col("hub.content").alias("b"), F.col("n").alias("n_a"), F.col("hub.n").alias("n_b"))
        .where((F.col("a") != F.col("b")) & _fits(similarity))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    narrow = contents.select("content", "first.id", "first.version")
    wanted = narrow.join(buckets.select("content").distinct(), "content").withColumnsRenamed({"id": "_id", "version": "_version"})
    texts = cut(
        docs.join(wanted, docs["id"].eqNullSafe(F.col("_id")) & (F.xxhash64(docs["text"]) == F.col("_version")))
        .select("content", "text").groupBy("content").agg(F.min("text").alias("text"))
    )
    links = cut(_aligned(starred, texts, similarity))
    roots = connected(links)
    placed = cut(
        buckets.join(roots.withColumnRenamed("node", "content"), "content", "left").withColumn("root", F.coalesce("root", "content"))
    )
    met = placed.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("m")).where("x <> y")
    open_ = cut(placed.join(met.select("key", "m"), "key").select("key", "size", "content", "n", "root", "m"))
    few, many = open_.where(F.col("m") <= full), open_.where(F.col("m") > full)
    rest = cut(_across(few, similarity).distinct().join(starred, ["a", "b"], "left_anti"))
    more = cut(_aligned(rest, texts, similarity))
    if many.limit(1).count():
        crowd = many.select("content").distinct()
        inside = _word_keys(texts.join(crowd.hint("merge"), "content", "left_semi")).join(contents.select("content", "keys"), "content")
        more = more.unionByName(cut(_within(many, cut(inside), similarity)))
    if more.limit(1).count():
        roots = connected(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))
    member = contents.select("content", "first").join(roots.withColumnRenamed("node", "content"), "content", "left").withColumn(
        "root", F.coalesce("root", "content")
    )
    member = cut(member)
    least = member.groupBy("root").agg(F.min("first").alias("keep"))
    of_content = member.join(least, "root").select("content", "keep")
    return every.drop("keys").join(of_content, "content", "left").select(
        "id", "version", "n_words",
        F.when(F.col("content").isNull(), F.col("id")).otherwise(F.col("keep.id")).alias("class_id"),
        (F.col("content").isNull() | F.struct(F.col("id").isNull().alias("none"), "id", "version").eqNullSafe(F.col("keep"))).alias("kept"),
    )


def _narrow(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, class_id, kept and n_words of every row.

    Words are what stands between white space, in ASCII lower case; two documents
    are alike if their words align with at most a fifth of the longer's edited.
    class_id is the smallest id of the class, kept whether the row is the one that
    stays (rows alike in id and text are both marked). Texts without words, null
    ones too, are linked with nothing. Null ids come after all others and stay null
    as class ids only among themselves. Very long texts are aligned within their
    band; other columns are left out. Contents are known by 64-bit hashes.
    """
    return classes(_narrow(docs, id_col, text_col), **options).select(F.col("id").alias("doc_id"), "class_id", "kept", "n_words")


def without_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """`docs` with one row of each class; of rows alike in id and text, one."""
    from pyspark.sql import Window

    keep = classes(_narrow(docs, id_col, text_col), **options).where("kept").select(
        F.col("id").alias("_id"), F.col("version").alias("_version"), (F.col("n_words") > 0).alias("_filled")
    ).distinct()
    version = F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    joined = docs.join(keep, docs[id_col].cast("long").eqNullSafe(F.col("_id")) & (version == F.col("_version")))
    alike = Window.partitionBy("_id", "_version").orderBy(F.lit(0))
    return joined.withColumn("_place", F.row_number().over(alike)).where("_place = 1 or not _filled").select(*[docs[c] for c in docs.columns])
