"""Near-duplicate lines: a segment-partition edit join."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlens.llm.common import U64, Substrings, connected, mix, small_batches
from graphlens.llm.edits import banded_pairs
from graphlens.session import cut

MAX_EDITS = 1
MIN_CHARS = 20
BUCKET = 64
BLANKS = " \t\r"
SEEN = 500_000
CHARS = 1_000_000

SIGNATURES = pa.schema([("key", pa.int64()), ("side", pa.int32()), ("line", pa.int64()), ("gap", pa.int64())])
CANDIDATES = pa.schema([("kind", pa.int32()), ("a", pa.int64()), ("b", pa.int64()), ("key", pa.int64()), ("side", pa.int32()), ("gap", pa.int64())])


def line_key(line: str) -> int:
    """What Spark's xxhash64 gives for the line."""
    x = xxhash.xxh64_intdigest(line.encode(), 42)
    return x - (1 << 64) if x >= 1 << 63 else x


def segments(length: np.ndarray, parts: int, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Start and size of the i-th of `parts` even segments of lines of these lengths."""
    base, longer = length // parts, length % parts
    return i * base + np.maximum(0, i - (parts - longer)), base + (i >= parts - longer)


def signatures(
    sub: Substrings, begin: np.ndarray, length: np.ndarray, edits: int, side: np.ndarray | None = None
) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Yield (which lines, key, side, start, size) for the segments and the probes of lines.

    A line of length L is cut into edits + 1 segments. Of two lines within `edits`
    edits, the longer contains one of the segments of the shorter, near its place.
    Side 0 is such a segment; side 1 + d is a substring of a line that is d longer
    than the line whose segment it may be. Substrings are only looked for where the
    edits left for either side of them allow it. With `side` given, lines of side 0
    are only held against lines of their length, and those of 1 + d only against
    lines d shorter.
    """
    everyone = np.arange(len(begin))
    for i in range(edits + 1):
        for d in range(edits + 1):
            chosen = everyone if side is None else everyone[(side == 1 + d) | ((side == 0) & (d == 0))]
            target = length[chosen] - d
            chosen = chosen[target > edits]
            target = length[chosen] - d
            start, size = segments(target, edits + 1, i)
            for shift in range(max(-i, d - (edits - i)), min(i, d + (edits - i)) + 1):
                own = d == 0 and shift == 0
                at = start + shift
                fits = (at >= 0) & (at + size <= length[chosen])
                rows, at, n, goal = chosen[fits], at[fits], size[fits], target[fits]
                key = sub.of(begin[rows] + at, begin[rows] + at + n)
                key = mix(key + goal.astype(U64) * U64(0x9E3779B97F4A7C15) + U64(i))
                # a line that was a probe stays one where its rest is not shifted
                as_ = side[rows].astype(np.int32) if own and side is not None else np.full(len(rows), 0 if own else 1 + d, np.int32)
                yield rows, key, as_, at, n


def _codes(lines: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all lines in one array, and the begin and length of each."""
    length = np.fromiter(map(len, lines), np.int64, len(lines))
    codes = np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32)
    return codes, np.concatenate([[0], np.cumsum(length)[:-1]]) if len(lines) else length, length


def _first_signatures(docs: DataFrame, edits: int, least: int) -> DataFrame:
    """Signatures of the lines of all documents; copies a task meets again are left out."""

    def run(batches):
        seen: set[int] = set()

        def emit(lines, keys):
            codes, begin, length = _codes(lines)
            ids = np.array(keys, np.int64)
            for rows, key, side, at, n in signatures(Substrings(codes), begin, length, edits):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), pa.array(side), pa.array(ids[rows]), pa.array((at << 32) | n)], schema=SIGNATURES
                )

        lines, keys, held = [], [], 0
        for batch in batches:
            for text in batch.column(0):
                for line in (text.as_py() or "").split("\n"):
                    line = line.strip(BLANKS)
                    if len(line) < least:
                        continue
                    key = line_key(line)
                    if key in seen:
                        continue
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(key)
                    lines.append(line)
                    keys.append(key)
                    held += len(line)
                    if held >= CHARS:
                        yield from emit(lines, keys)
                        lines, keys, held = [], [], 0
        if lines:
            yield from emit(lines, keys)

    return small_batches(docs.select("text")).mapInArrow(run, "key long, side int, line long, gap long")


def _rest_signatures(hot: DataFrame, edits: int) -> DataFrame:
    """Signatures of what is left of the lines of full buckets, within their bucket.

    Two lines that share a segment are within `edits` edits only if they are
    without it, so the same join applies to the rests. Rests of at most `edits`
    characters are alike.
    """

    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            gap = pdf["gap"].to_numpy()
            rest = [t[: g >> 32] + t[(g >> 32) + (g & 0xFFFFFFFF) :] for t, g in zip(pdf["text"], gap.tolist(), strict=True)]
            codes, begin, length = _codes(rest)
            side, parent, line = pdf["side"].to_numpy(), pdf["key"].to_numpy().view(np.uint64), pdf["line"].to_numpy()
            texts = np.array(rest, object)
            short = length - np.maximum(side - 1, 0) <= edits
            if short.any():
                yield pd.DataFrame({
                    "key": mix(parent[short] + U64(7)).view(np.int64), "side": np.int32(-1), "line": line[short], "gap": 0, "text": texts[short],
                })
            where = np.flatnonzero(~short)
            for rows, key, s, at, n in signatures(Substrings(codes), begin[where], length[where], edits, side[where]):
                rows = where[rows]
                yield pd.DataFrame({
                    "key": mix(key ^ mix(parent[rows])).view(np.int64), "side": s, "line": line[rows], "gap": (at << 32) | n, "text": texts[rows],
                })

    return small_batches(hot.select("key", "side", "line", "gap", "text")).mapInPandas(run, "key long, side int, line long, gap long, text string")


def _buckets(rows: DataFrame, bucket: int) -> DataFrame:
    """Pairs of lines that share a key (kind 0), and the rows of keys with too many (kind 1).

    A key's rows come in order, segments first. At most `bucket` of them are held:
    once there are more, they are passed on as they stream by. Rows of side -1 all
    belong together and are tied to the first of them.
    """

    def run(batches):
        held_key, held, state = None, [], 0  # state: 0 holding, 1 passing on, 2 tying together

        def close(out):
            if state == 0 and len(held) > 1:
                own = [x for x in held if x[0] == 0]
                for p, x in enumerate(own):
                    out.extend((0, x[1], y[1], 0, 0, 0) for y in own[p + 1 :] if x[1] != y[1])
                    out.extend((0, x[1], y[1], 0, 0, 0) for y in held[len(own) :] if x[1] != y[1])

        for batch in batches:
            key, side, line, gap = (c.to_numpy(zero_copy_only=False) for c in (batch.column(i) for i in range(4)))
            if not len(key):
                continue
            out: list[tuple] = []
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            last = np.append(first[1:], len(key))
            # keys of one row in the middle of a batch pair with nothing
            wanted = (last - first > 1) | (first == 0) | (last == len(key))
            for a, b in zip(first[wanted].tolist(), last[wanted].tolist(), strict=True):
                k = key[a]
                if held_key is None or k != held_key:
                    close(out)
                    held_key, held, state = k, [], 0
                for s, l, g in zip(side[a:b].tolist(), line[a:b].tolist(), gap[a:b].tolist(), strict=True):
                    if held and held[-1][:2] == (s, l) and state != 1:
                        continue
                    if s < 0:
                        state = 2
                        if held:
                            out.append((0, held[0][1], l, 0, 0, 0))
                        else:
                            held.append((s, l, g))
                    elif state == 1:
                        out.append((1, l, 0, int(k), s, g))
                    else:
                        held.append((s, l, g))
                        if len(held) > bucket:
                            out.extend((1, y, 0, int(k), x, z) for x, y, z in held)
                            held, state = [], 1
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), CANDIDATES, strict=True)], schema=CANDIDATES)
        out = []
        close(out)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), CANDIDATES, strict=True)], schema=CANDIDATES)

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select("key", "side", "line", "gap").repartition(n, "key").sortWithinPartitions("key", "side", "line", "gap")
    return dealt.mapInArrow(run, "kind int, a long, b long, key long, side int, gap long")


def _lines(docs: DataFrame, least: int) -> DataFrame:
    """(id, version, position, line, text) of the lines long enough to be compared."""
    return (
        docs.select("id", F.xxhash64("text").alias("version"), F.posexplode(F.split("text", "\n")).alias("position", "text"))
        .withColumn("text", F.btrim("text", F.lit(BLANKS))).where(F.length("text") >= least)
        .withColumn("line", F.xxhash64("text"))
    )


def near_lines(docs: DataFrame, edits: int = MAX_EDITS, least: int = MIN_CHARS, bucket: int = BUCKET) -> DataFrame:
    """(a, b): pairs of keys of different lines that lie within `edits` edits, so that
    every such pair is linked directly or over others."""
    texts = _lines(docs, least).select("line", "text")
    found = cut(_buckets(_first_signatures(docs, edits, least), bucket))
    pairs = found.where("kind = 0").select("a", "b")
    hot = found.where("kind = 1").select("key", "side", F.col("a").alias("line"), "gap")
    carried = hot.dropDuplicates() if hot.limit(1).count() else None
    if carried is not None:
        needed = hot.select("line").distinct()
        carried = carried.join(texts.join(needed.hint("merge"), "line", "left_semi").dropDuplicates(["line"]), "line")
    while carried is not None:
        bucket *= 2
        rows = cut(_rest_signatures(carried, edits))
        found = cut(_buckets(rows, bucket))
        pairs = pairs.unionByName(found.where("kind = 0").select("a", "b"))
        again = found.where("kind = 1").select("key", "side", F.col("a").alias("line"), "gap").distinct()
        carried = again.join(rows, ["key", "side", "line", "gap"]).dropDuplicates(["key", "side", "line", "gap"]) if again.limit(1).count() else None
    pairs = cut(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    needed = pairs.select(F.explode(F.array("a", "b")).alias("line")).distinct()
    known = cut(texts.join(needed.hint("merge"), "line", "left_semi").groupBy("line").agg(F.min("text").alias("text")))
    both = pairs.join(known.select(F.col("line").alias("a"), F.col("text").alias("text_a")), "a").join(
        known.select(F.col("line").alias("b"), F.col("text").alias("text_b")), "b"
    )

    def verify(batches):
        for batch in batches:
            for begin in range(0, batch.num_rows, 2000):
                part = batch.slice(begin, 2000)
                codes = [
                    [np.frombuffer(t.encode("utf-32-le"), np.uint32) for t in part.column(c).to_pylist()] for c in ("text_a", "text_b")
                ]
                near = pa.array(banded_pairs(*codes, edits) <= edits)
                yield pa.RecordBatch.from_arrays([part.column("a"), part.column("b")], names=["a", "b"]).filter(near)

    return small_batches(both.select("a", "b", "text_a", "text_b")).mapInArrow(verify, "a long, b long")


def repeats(docs: DataFrame, edits: int = MAX_EDITS, least: int = MIN_CHARS, bucket: int = BUCKET) -> DataFrame:
    """(id, version, removed): positions of the lines of each document that repeat an earlier one.

    Lines are compared without blanks at their ends, and only those of `least`
    characters or more. Lines within `edits` edits of each other, directly or over
    others, are one class; the first by id, version and position stays.
    """
    lines = cut(_lines(docs, least).select("id", "version", "position", "line"))
    classes = connected(near_lines(docs, edits, least, bucket))
    order = F.struct("id", "version", "position")
    each = lines.groupBy("line").agg(F.min(order).alias("first"), F.count("*").alias("n"))
    rooted = cut(each.join(classes.withColumnRenamed("node", "line"), "line", "left").withColumn("root", F.coalesce("root", "line")))
    whole = rooted.groupBy("root").agg(F.min("first").alias("keep"), F.sum("n").alias("n")).where("n > 1")
    repeated = rooted.select("line", "root").join(whole, "root").select("line", "keep")
    extra = lines.join(repeated.hint("merge"), "line").where(~order.eqNullSafe(F.col("keep")))
    return extra.groupBy("id", "version").agg(F.collect_set("position").alias("removed"))


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = MAX_EDITS, least: int = MIN_CHARS, bucket: int = BUCKET
) -> DataFrame:
    """`docs` with every line removed that repeats, up to `edits` edits, an earlier one.

    Adds `n_lines` and `removed` (the positions taken out, ascending). Order is by
    id (nulls first), then by the text's hash, then by position; rows alike in id
    and text count as one document and lose the same lines. Null texts stay null,
    empty ones empty. A document whose lines all repeat ends up empty. Other
    columns are kept; ones called n_lines or removed are replaced.

    The joins with texts and with lines are always sort-merge joins: the other side
    grows with the table, and on small tables Spark would broadcast it.

    Lines are known by a 64-bit hash; near ones are compared letter by letter.
    """
    base = docs.drop("n_lines", "removed")
    narrow = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    taken = repeats(narrow, edits, least, bucket).withColumnsRenamed({"id": "_id", "version": "_version", "removed": "_removed"})

    @F.arrow_udf("string")
    def without(text: pa.Array, removed: pa.Array) -> pa.Array:
        out = []
        for t, r in zip(text, removed, strict=True):
            t, r = t.as_py(), r.as_py()
            gone = set(r or ())
            out.append(None if t is None or r is None else "\n".join(x for i, x in enumerate(t.split("\n")) if i not in gone))
        return pa.array(out, pa.string())

    text = F.col(text_col)
    at = small_batches(base).join(
        taken.hint("merge"),
        base[id_col].cast("long").eqNullSafe(F.col("_id")) & (F.xxhash64(F.coalesce(text.cast("string"), F.lit(""))) == F.col("_version")),
        "left",
    )
    # a filter on the text would otherwise run the function a second time, with workers of its own
    rebuilt = without.asNondeterministic()(F.when(F.col("_removed").isNotNull(), text), F.col("_removed"))
    return at.select(
        *[F.coalesce(rebuilt, text).alias(c) if c == text_col else F.col(c) for c in base.columns],
        F.when(text.isNull(), 0).otherwise(F.size(F.split(text, "\n"))).alias("n_lines"),
        F.coalesce(F.sort_array("_removed"), F.expr("cast(array() as array<int>)")).alias("removed"),
    )
