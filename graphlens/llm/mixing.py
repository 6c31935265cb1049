"""Mixing sources to target weights in fixed-length blocks."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphlens.functions.skew import running_total
from graphlens.llm.common import U64, mix, small_batches, small_table, stamp
from graphlens.session import cut

WORD = r"[^\x20\x09-\x0D]+"
BLOCK = 256
SHARD = 4096
HYPERGEOMETRIC_LIMIT = 100_000_000


def targets(sizes: Sequence[int], weights: Sequence[float], most: float = 3.0) -> list[float]:
    """Share the sum of `sizes` by weight, no share above `most` times its size."""
    total, left = float(sum(sizes)), set(range(len(sizes)))
    out = [0.0] * len(sizes)
    while left:
        free = total - sum(most * sizes[i] for i in range(len(sizes)) if i not in left)
        weight = sum(weights[i] for i in left)
        above = {i for i in left if free * weights[i] / weight > most * sizes[i]}
        if not above:
            for i in left:
                out[i] = free * weights[i] / weight
            break
        for i in above:
            out[i] = most * sizes[i]
        left -= above
    return out


class Permutation:
    """A pseudorandom permutation of range(n): a Feistel network, walked until it lands inside."""

    def __init__(self, n: int, seed: int, source: int, epoch: int):
        self.n = n
        self.half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
        with np.errstate(over="ignore"):
            key = mix(np.array([seed], U64) + U64(source) * U64(0x9E3779B97F4A7C15) + U64(epoch) * U64(0xD1B54A32D192ED03))
            self.keys = [mix(key + U64(r + 1))[0] for r in range(6)]

    def _round(self, x: np.ndarray, back: bool) -> np.ndarray:
        h, mask = U64(self.half), U64((1 << self.half) - 1)
        a, b = x >> h, x & mask
        for key in reversed(self.keys) if back else self.keys:
            if back:
                a, b = b ^ (mix(a ^ key) & mask), a
            else:
                a, b = b, a ^ (mix(b ^ key) & mask)
        return (a << h) | b

    def of(self, at: np.ndarray, back: bool = False) -> np.ndarray:
        x = self._round(np.asarray(at, U64), back)
        while (outside := x >= U64(self.n)).any():
            x[outside] = self._round(x[outside], back)
        return x.astype(np.int64)


def draws(left: np.ndarray, take: int, rng: np.random.Generator) -> np.ndarray:
    """How many of `take` slots go to each source, of which `left` remain.

    Multinomial counts given the total of every source: one hypergeometric draw
    per source. Beyond the generator's range its normal limit is used.
    """
    out, rest = np.zeros(len(left), np.int64), int(left.sum())
    for i, have in enumerate(left.tolist()):
        rest -= have
        low, high = max(0, take - rest), min(have, take)
        if low == high:
            n = low
        elif have < HYPERGEOMETRIC_LIMIT and rest < HYPERGEOMETRIC_LIMIT:
            n = int(rng.hypergeometric(have, rest, take))
        else:
            share = have / (have + rest)
            spread = (take * share * (1 - share) * max(0.0, (have + rest - take) / max(1, have + rest - 1))) ** 0.5
            n = int(min(high, max(low, round(rng.normal(take * share, spread)))))
        out[i] = n
        take -= n
    return out


def shard_counts(totals: np.ndarray, shard: int, shards: int, per: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """First slot and number of slots of each source in one output shard.

    The shards are halved again and again; every half draws its counts from those
    of the whole with a generator seeded by its place. A task so finds the counts
    of its shards alone, and all tasks agree.
    """
    first, have, lo, hi = np.zeros(len(totals), np.int64), totals.astype(np.int64), 0, shards
    while hi - lo > 1:
        mid = (lo + hi) // 2
        take = min(int(have.sum()), (mid - lo) * per)
        one = draws(have, take, np.random.default_rng([seed, lo, hi]))
        if shard < mid:
            have, hi = one, mid
        else:
            first, have, lo = first + one, have - one, mid
    return first, have


class Plan:
    """What each source gives: its size, target, blocks, whole rounds and slots."""

    def __init__(self, names: list[str | None], sizes: list[int], weights: Sequence[float], most: float, block: int, seed: int):
        self.names, self.sizes, self.block, self.seed = names, sizes, block, seed
        self.targets = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], most)
        self.words = [min(round(t), int(most * s)) for t, s in zip(self.targets, sizes, strict=True)]
        self.blocks = [-(-s // block) for s in sizes]
        self.slots = []
        for i, (n, size, want) in enumerate(zip(self.blocks, sizes, self.words, strict=True)):
            if not size:
                self.slots.append(0)
                continue
            rounds, rest = divmod(want, size)
            need = -(-rest // block)
            lack = n * block - size
            if need and lack and self.short(i, rounds) < need:
                need = -(-(rest + lack) // block)
            self.slots.append(rounds * n + need)

    def short(self, source: int, epoch: int) -> int:
        """The slot of the source's last block, which may be short, in a round."""
        n = self.blocks[source]
        return int(Permutation(n, self.seed, source, epoch).of(np.array([n - 1]), back=True)[0])

    def blocks_of(self, source: int, first: int, count: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Round, block and words of the slots first .. first + count - 1 of a source."""
        n, size, block = self.blocks[source], self.sizes[source], self.block
        at = np.arange(first, first + count)
        epoch, index, words = at // n, np.zeros(count, np.int64), np.full(count, block, np.int64)
        for e in np.unique(epoch):
            mine = epoch == e
            index[mine] = Permutation(n, self.seed, source, int(e)).of(at[mine] % n)
        words[index == n - 1] = size - (n - 1) * block
        last = self.slots[source] - 1
        if first <= last < first + count:
            e, k = divmod(last, n)
            before = k * block - (n * block - size if self.short(source, e) < k else 0)
            words[last - first] = min(words[last - first], self.words[source] - e * size - before)
        return epoch, index, words


def plan_mix(
    sizes: DataFrame, weights: Sequence[float] = (1, 2, 3), most: float = 3.0, block: int = BLOCK, seed: int = 17
) -> Plan:
    """The plan for (source, size) rows. Only a row per source reaches the driver."""
    rows = sizes.groupBy("source").agg(F.sum("size").alias("size")).collect()
    rows.sort(key=lambda r: (r.source is None, r.source or ""))
    return Plan([r.source for r in rows], [int(r["size"] or 0) for r in rows], list(weights), most, block, seed)


def slots(spark, plan: Plan, per_shard: int = SHARD) -> DataFrame:
    """(shard, source_ix, epoch, block, words): every slot of the mix, a task per few shards."""
    totals = np.array(plan.slots, np.int64)
    shards = max(1, -(-int(totals.sum()) // per_shard))

    def run(batches):
        for pdf in batches:
            for shard in pdf["id"].tolist():
                first, have = shard_counts(totals, shard, shards, per_shard, plan.seed)
                for s in np.flatnonzero(have):
                    epoch, index, words = plan.blocks_of(int(s), int(first[s]), int(have[s]))
                    yield pd.DataFrame({"shard": shard, "source_ix": int(s), "epoch": epoch, "block": index, "words": words})

    return spark.range(0, shards, 1, max(1, min(shards, 4096))).mapInPandas(
        run, "shard long, source_ix int, epoch long, block long, words long"
    )


def mix_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", carry: Sequence[str] = (),
    weights: Sequence[float] = (1, 2, 3), most: float = 3.0, block: int = BLOCK, seed: int = 17,
) -> tuple[DataFrame, DataFrame, Plan]:
    """Mix documents so that each source's words come to its target.

    The words of a source, in order of id, form one stream that is cut into
    blocks of `block` words. A source's weight is `weights` repeating over the
    sources by code point, null last; targets share the sum of all words by
    weight, with at most `most` times a source's own words. The mix is a row of
    slots in shards: how many slots of a shard a source gets is drawn (see
    `shard_counts`), which block a slot holds is looked up in a pseudorandom
    permutation of the source's blocks, a fresh one each time the source has been
    used up. The last slot of a source is filled as far as its target goes, so
    its words meet the target to a word, and no document is used more than `most`
    times, rounded up.

    Returns (documents, pieces, plan): a stored row per input row (_row, the id,
    source, size, and `carry`, which may name the text), and the pieces of the
    mix (shard, _row, epoch, from_word, to_word). Null texts have no words; null
    sources are one source; repeated rows are documents of their own; no rows
    give no pieces. The same input gives the same mix. Other columns are left out.
    """
    spark = docs.sparkSession
    stored = stamp(
        docs.select(
            F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"),
            F.coalesce(F.regexp_count(F.col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            *[F.col(c).alias(f"carry_{c}") for c in carry],
        )
    )
    plan = plan_mix(stored.select("source", "size"), weights, most, block, seed)
    index = small_table(spark, source_ix=pa.array(range(len(plan.names)), pa.int32()), source=pa.array(plan.names, pa.string()))
    narrow = stored.where("size > 0").select("_row", "id", "source", "size")
    placed = running_total(
        narrow.join(F.broadcast(index), narrow["source"].eqNullSafe(index["source"])).select("_row", "id", "source_ix", "size"),
        ["source_ix"], ["id", "_row"], F.col("size"), "begin",
    )
    parts = placed.select(
        "_row", "source_ix", "begin", "size",
        F.explode(F.sequence(F.expr(f"begin div {block}"), F.expr(f"(begin + size - 1) div {block}"))).alias("block"),
    ).withColumns({
        "low": F.greatest("begin", F.col("block") * block), "high": F.least(F.expr("begin + size"), (F.col("block") + 1) * block),
    })
    taken = parts.join(slots(spark, plan).hint("merge"), ["source_ix", "block"]).withColumn(
        "high", F.least("high", F.col("block") * block + F.col("words"))
    )
    pieces = taken.where("high > low").select(
        "shard", "_row", "epoch", (F.col("low") - F.col("begin")).alias("from_word"), (F.col("high") - F.col("begin")).alias("to_word")
    )
    return stored, pieces, plan


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target and taken words of every document."""
    stored, pieces, plan = mix_documents(docs, **options)
    sums = pieces.groupBy("_row").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken"))
    sources = small_table(
        docs.sparkSession, source=pa.array(plan.names, pa.string()), source_size=pa.array(plan.sizes, pa.int64()),
        target=pa.array(plan.targets, pa.float64()),
    )
    left = stored.join(sums, "_row", "left").alias("d")
    return left.join(F.broadcast(sources).alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))).select(
        F.col("d.id").alias("doc_id"), "d.size", "s.source_size", "s.target", F.coalesce("d.taken", F.lit(0)).alias("taken")
    )


def mixed_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The mix as documents: the columns of `docs`, a row per stretch of words that is used.

    Stretches of a document that follow each other in one round are one row; a
    document used whole is its text unchanged, otherwise the text from its first
    to its last word used. `n_chars`, where there is such a column, is counted anew.
    """
    import re

    names = docs.columns
    stored, pieces, _ = mix_documents(docs, id_col, text_col, source_col, carry=names, **options)
    ordered = Window.partitionBy("_row", "epoch").orderBy("from_word")
    joined = pieces.withColumn("_new", F.coalesce((F.lag("to_word").over(ordered) != F.col("from_word")).cast("int"), F.lit(1)))
    runs = (
        joined.withColumn("_run", F.sum("_new").over(ordered))
        .groupBy("_row", "epoch", "_run").agg(F.min("from_word").alias("a"), F.max("to_word").alias("b"))
        .groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("epoch", "a", "b"))).alias("runs"))
    )
    word = re.compile(WORD)

    @F.arrow_udf("array<string>")
    def stretches(text: pa.Array, size: pa.Array, runs: pa.Array) -> pa.Array:
        out = []
        for whole, n, wanted in zip(text, size, runs, strict=True):
            whole, n, wanted = whole.as_py(), n.as_py(), [(r["a"], r["b"]) for r in wanted.as_py()]
            spans = [] if all(w == (0, n) for w in wanted) else [m.span() for m in word.finditer(whole)]
            out.append([whole if (a, b) == (0, n) else whole[spans[a][0] : spans[b - 1][1]] for a, b in wanted])
        return pa.array(out, pa.list_(pa.string()))

    made = small_batches(stored).join(runs, "_row").withColumn("_text", F.explode(stretches(f"carry_{text_col}", "size", "runs")))
    changed = {text_col: F.col("_text"), "n_chars": F.length("_text").cast(docs.schema["n_chars"].dataType) if "n_chars" in names else None}
    return made.select(*[(changed[c] if c in changed else F.col(f"carry_{c}")).alias(c) for c in names])
