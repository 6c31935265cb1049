"""Fingerprints of texts by signed votes of weighted terms, and the search for near ones."""

from __future__ import annotations

import functools
import itertools
import json
import math
import operator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphlens.session import cut

BITS = 128
RADIUS = 6
BLOCKS = 8
WIDTH = BITS // BLOCKS
LANES = 0x0000000100000001  # two counters of 32 bits in a long
LOW = 0xFFFFFFFF
MOST_RANGES = 1 << 16
RANGE_ROWS = 20_000
SPREAD, DENSE_ROWS = 16, 1 << 16
EDITED = ("doc_id", "n_chars", "edited_sha256")


def terms(text: Column) -> Column:
    """The words of a text with the word after each: (word, following), null at the end."""
    words = F.split(F.lower(text), r"[\x20\x09-\x0D]+")
    return F.arrays_zip(words.alias("word"), F.slice(words, F.lit(2), F.size(words)).alias("following"))


def fingerprints(texts: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """(keys, hi, lo): 128 bits for each row of keys, which must be distinct.

    Terms are pairs of neighbouring words in lower case (and the last word alone),
    weighted by their length, as long words say more than short ones. A term's
    weight counts for every bit that its hash has set; a bit of the fingerprint is
    set if more than half of the weight is for it. Texts equal but for case and
    white space have equal fingerprints; those without words, and nulls, have none
    set. Two bits' sums share a long, so a text may weigh up to 2^32, which is
    beyond the longest string. Where rows already lie by some of the keys, as
    after a window, nothing is shuffled.
    """
    said = texts.select(*keys, F.inline(terms(F.coalesce(F.col(text_col).cast("string"), F.lit("")))).alias("word", "following"))
    weight = F.length("word") + F.coalesce(F.length("following"), F.lit(0))
    hashed = said.select(
        *keys, weight.cast("long").alias("w"), F.xxhash64("word", "following").alias("h0"), F.xxhash64(F.lit(1), "word", "following").alias("h1")
    )
    sums = [
        F.sum(F.col("w") * F.shiftrightunsigned(f"h{half}", k).bitwiseAND(F.lit(LANES))).alias(f"v{half}_{k}") for half in (0, 1) for k in range(32)
    ]
    voted = hashed.groupBy(*keys).agg(F.sum("w").alias("w"), *sums)

    def word(half: int) -> Column:
        bits = []
        for k in range(32):
            v = F.col(f"v{half}_{k}")
            for at, ones in ((k, v.bitwiseAND(F.lit(LOW))), (k + 32, F.shiftrightunsigned(v, 32))):
                # the sign of w - 2 ones, moved to its place
                bits.append(F.shiftleft(F.shiftrightunsigned(F.col("w") - 2 * ones, 63), at))
        return functools.reduce(lambda a, b: a.bitwiseOR(b), bits)

    return voted.select(*keys, word(0).alias("hi"), word(1).alias("lo"))


def distance(hi: Column, lo: Column, other_hi: Column, other_lo: Column) -> Column:
    """Number of bits in which two fingerprints differ."""
    return F.bit_count(hi.bitwiseXOR(other_hi)) + F.bit_count(lo.bitwiseXOR(other_lo))


def likeness(hi: Column, lo: Column, other_hi: Column, other_lo: Column) -> Column:
    """Share of equal bits."""
    return 1 - distance(hi, lo, other_hi, other_lo) / F.lit(float(BITS))


def text_of(hi: Column, lo: Column) -> Column:
    return F.concat(*[F.lpad(F.lower(F.hex(c)), 16, "0") for c in (hi, lo)])


def range_of(df: DataFrame, order: str) -> Column:
    """Number of a range of about 20,000 rows that a value of the column `order` lies in; null is below all.

    The bounds are quantiles, at most 65,536 of them, looked up in two steps.
    """
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    n = min(max(2 * parts, df.count() // RANGE_ROWS), MOST_RANGES)
    shares = F.split(F.lit(",".join(str(k / n) for k in range(1, n))), ",").cast("array<double>")
    found = df.agg(F.percentile_approx(order, shares, 4 * n).alias("q")).first()[0] or [] if n > 1 else []
    bounds = sorted(set(found))
    if not bounds:
        return F.when(F.col(order).isNull(), -1).otherwise(0)
    step = math.isqrt(len(bounds)) + 1
    groups = [bounds[k : k + step] for k in range(0, len(bounds), step)]
    firsts = F.from_json(F.lit(json.dumps([g[0] for g in groups])), "array<bigint>")
    inner = F.from_json(F.lit(json.dumps(groups)), "array<array<bigint>>")
    reached = lambda bound: bound <= F.col(order)
    group = F.size(F.filter(firsts, reached))
    return F.when(F.col(order).isNull(), -1).when(group == 0, 0).otherwise(
        (group - 1) * step + F.size(F.filter(F.element_at(inner, F.greatest(group, F.lit(1))), reached))
    )


def with_next(docs: DataFrame, order: str, text_col: str) -> DataFrame:
    """(range, place, real, id, text, next): every text with the one after it in descending order, the first after the last.

    Rows lie by ranges of the order and meet their successor in a window of their
    range. The head of each range is sent to the range above it a second time
    (real = false), where it follows the last row. So texts are shuffled once.
    """
    rows = docs.select(F.col(order).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("range", range_of(rows.select("id"), "id")).withColumn("tie", F.xxhash64("text"))
    heads = rows.groupBy("range").agg(F.max("id").alias("head"))
    up = Window.orderBy("range")  # a row per range
    heads = heads.select(
        "range", "head", F.coalesce(F.lead("range").over(up), F.first("range").over(up)).alias("above")
    )
    again = rows.join(F.broadcast(heads), "range").where(F.col("id").eqNullSafe(F.col("head")))
    all_rows = rows.withColumn("real", F.lit(True)).unionByName(
        again.select("id", "text", F.col("above").alias("range"), "tie", F.lit(False).alias("real"))
    )
    w = Window.partitionBy("range").orderBy(F.desc("real"), F.desc_nulls_last("id"), "tie")
    return all_rows.select("range", "real", "id", "text", F.row_number().over(w).alias("place"), F.lead("text").over(w).alias("next"))


def edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per text: id, n_chars, edited_sha256, and fingerprints hi, lo of it, edited_hi, edited_lo of its edited text, next_hi, next_lo of the next one.

    The edited text has the last half (rounded down) of the code points replaced by
    the first as many of the next text, in descending order of id; the first
    follows the last. Equal ids follow by a hash of the text, null ids come last;
    ids that many rows share lie in one range. Null texts are empty, a lone text
    is next to itself, repeated rows are rows of their own; an empty table has
    none. Other columns are left out.
    """
    rows = with_next(docs, id_col, text_col)
    half = F.shiftright("n_chars", 1)
    rows = rows.withColumn("n_chars", F.length("text").cast("long")).withColumn(
        "edited", F.when(F.col("real"), F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring("next", F.lit(1), half.cast("int"))))
    )
    both = rows.select(
        "range", "place", "real", "id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), F.posexplode(F.array("text", "edited")).alias("kind", "said")
    ).where((F.col("kind") == 0) | F.col("real"))
    own = ["range", "place", "real", "id", "n_chars", "edited_sha256"]
    made = fingerprints(both, [*own, "kind"], "said")
    one = made.groupBy(*own).agg(*[
        F.max(F.when(F.col("kind") == kind, F.col(c))).alias(name)
        for kind, c, name in ((0, "hi", "hi"), (0, "lo", "lo"), (1, "hi", "edited_hi"), (1, "lo", "edited_lo"))
    ])
    after = Window.partitionBy("range").orderBy("place")
    return one.withColumns({f"next_{c}": F.lead(c).over(after) for c in ("hi", "lo")}).where("real").drop("range", "place", "real")


def _block(hi: Column, lo: Column, k: int) -> Column:
    """The k-th 16 bits of a fingerprint."""
    half, at = (hi, k) if k < BLOCKS // 2 else (lo, k - BLOCKS // 2)
    return F.shiftrightunsigned(half, WIDTH * at).bitwiseAND(F.lit((1 << WIDTH) - 1))


TABLES = list(itertools.combinations(range(BLOCKS), BLOCKS - RADIUS))


def _tables(prints: DataFrame) -> DataFrame:
    """A row per fingerprint and permuted table: number of the table and the blocks that come first in it, in one key."""
    hi, lo = F.col("hi"), F.col("lo")
    keys = [
        F.struct(
            F.lit(t).alias("t"),
            functools.reduce(lambda a, k: F.shiftleft(a, WIDTH).bitwiseOR(_block(hi, lo, k)), picked, F.lit(t).cast("long")).alias("key"),
        )
        for t, picked in enumerate(TABLES)
    ]
    return prints.withColumn("at", F.explode(F.array(*keys))).select("*", "at.*").drop("at")


def near(prints: DataFrame, asked: DataFrame, dense_rows: int = DENSE_ROWS) -> DataFrame:
    """(hi, lo, n_near) for distinct fingerprints `asked`: how many rows of `prints` (hi, lo, n) lie within 6 bits of them.

    Two fingerprints that differ in at most 6 bits agree in 2 of 8 blocks. There is
    a table per pair of blocks, permuted so that these come first; a bucket is what
    agrees in them, and a pair counts in the first table in which it meets.
    Members of a bucket are held in a list, one of more than 65,536 in 16 lists for
    every 65,536, so that a bucket of any size makes a row per question and list.
    """
    members = _tables(prints)
    questions = _tables(asked.select("hi", "lo")).select(F.col("hi").alias("ask_hi"), F.col("lo").alias("ask_lo"), "t", "key")
    wanted = questions.select("key").distinct()
    dense = members.groupBy("key").agg(F.count("*").alias("m")).where(F.col("m") > dense_rows).select(
        "key", (F.ceil(F.col("m") / dense_rows) * SPREAD).cast("int").alias("lists")
    )
    lists = F.coalesce("lists", F.lit(1))
    # at most one key in `dense_rows` members
    spread = lambda df: df.join(F.broadcast(dense), "key", "left")
    in_lists = lambda df: spread(df).withColumn("list", F.explode(F.sequence(F.lit(0), lists - 1))).drop("lists")
    dealt = spread(members).withColumn("list", F.pmod(F.xxhash64("hi", "lo"), lists).cast("int")).drop("lists")
    held = (
        dealt.join(in_lists(wanted), ["key", "list"], "left_semi").groupBy("key", "list")
        .agg(F.collect_list(F.struct("hi", "lo", "n")).alias("held"))
    )

    def counted(m: Column) -> Column:
        close = distance(m["hi"], m["lo"], F.col("ask_hi"), F.col("ask_lo")) <= RADIUS
        alike = [_block(m["hi"].bitwiseXOR(F.col("ask_hi")), m["lo"].bitwiseXOR(F.col("ask_lo")), k) == 0 for k in range(BLOCKS)]
        first = functools.reduce(
            lambda later, t: F.when(functools.reduce(operator.and_, [alike[k] for k in TABLES[t]]), F.lit(t)).otherwise(later),
            reversed(range(len(TABLES))), F.lit(-1),
        )
        return F.when(close, F.when(first == F.col("t"), m["n"]).otherwise(0)).otherwise(0)

    zero = F.lit(0).cast("long")
    return (
        in_lists(questions).join(held, ["key", "list"])
        .select("ask_hi", "ask_lo", F.aggregate("held", zero, lambda total, m: total + counted(m)).alias("c"))
        .groupBy(F.col("ask_hi").alias("hi"), F.col("ask_lo").alias("lo")).agg(F.sum("c").alias("n_near"))
    )


def report(docs: DataFrame, every: int = 100) -> DataFrame:
    """A row per document: its fingerprints, how like they are, and n_near for ids that `every` divides.

    n_near is the number of other documents within 6 bits, for the questions of the
    search; it is null for all others.
    """
    made = cut(edited(docs).withColumnRenamed("id", "doc_id"))
    asks = F.coalesce(F.col("doc_id") % every == 0, F.lit(False))
    found = near(made.groupBy("hi", "lo").agg(F.count("*").alias("n")), made.where(asks).select("hi", "lo").distinct())
    answered = made.where(asks).join(found, ["hi", "lo"], "left").withColumn("n_near", F.col("n_near") - 1)
    rows = answered.unionByName(made.where(~asks).withColumn("n_near", F.lit(None).cast("long")))
    own = (F.col("hi"), F.col("lo"))
    return rows.select(
        *EDITED, text_of(*own).alias("fingerprint"), text_of(F.col("edited_hi"), F.col("edited_lo")).alias("edited_fingerprint"),
        likeness(*own, F.col("edited_hi"), F.col("edited_lo")).alias("near_edited"), likeness(*own, F.col("next_hi"), F.col("next_lo")).alias("near_next"), "n_near",
    )
