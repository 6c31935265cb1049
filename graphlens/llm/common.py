"""What the operators share: text as numpy arrays, tables between steps, components."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphlens.session import cut

SLICE_BYTES = 500_000
BATCH_CONF, BATCH_DEFAULT, BATCH = "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b", "8m"
U64 = np.uint64


def small_batches(df: DataFrame) -> DataFrame:
    """`df`, with 8 MB to a batch for Python, unless the session says otherwise.

    Rows differ in size by four orders of magnitude, so a number of rows bounds
    nothing, and Spark's own 64 MB are held several times over in every task.
    """
    conf = df.sparkSession.conf
    if conf.get(BATCH_CONF, None) == BATCH_DEFAULT:
        conf.set(BATCH_CONF, BATCH)
    return df


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and n + 1 offsets of a string column; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, ends - ends[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes, or of one row where it is longer."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BASE = U64(0x9E3779B97F4A7C15) | U64(1)
_INVERSE = U64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {"up": np.ones(1, U64), "down": np.ones(1, U64)}


def _power(which: str, n: int) -> np.ndarray:
    """The first n powers of the base or of its inverse; long ones are not kept."""
    have = _powers[which]
    if len(have) >= n:
        return have[:n]
    step = np.full(n, _BASE if which == "up" else _INVERSE, U64)
    step[0] = 1
    made = np.cumprod(step, dtype=U64)
    if n <= 2 * SLICE_BYTES:
        _powers[which] = made
    return made


class Substrings:
    """Hashes of any substrings of one sequence of small integers."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.sums = np.zeros(n + 1, U64)
        np.cumsum(mix(values.astype(U64) + U64(1)) * _power("up", max(n, 1))[:n], dtype=U64, out=self.sums[1:])
        self.back = _power("down", n + 1)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.back[starts] + (ends - starts).astype(U64))


SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and rows of the words between white space, in order."""
    if not len(raw):
        none = np.zeros(0, np.int64)
        return none, none, none
    inside = ~SPACE[raw]
    edge = np.zeros(len(raw) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], inside[:-1]])
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.concatenate([inside[1:], [False]])
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return starts, ends, rows


def per_row(values: np.ndarray, bounds: np.ndarray, ufunc: np.ufunc, empty) -> np.ndarray:
    """`ufunc` over values[bounds[i]:bounds[i+1]] for every i; `empty` where that is nothing."""
    out = np.full(len(bounds) - 1, empty, values.dtype)
    full = np.flatnonzero(np.diff(bounds))
    if len(full):
        out[full] = ufunc.reduceat(values, bounds[full])
    return out


def map_slices(
    df: DataFrame, text: str, schema: str, arrow: pa.Schema,
    make: Callable[[pa.RecordBatch, np.ndarray, np.ndarray], dict[str, object] | None],
) -> DataFrame:
    """Apply `make` to slices of rows whose texts are a few MB together.

    `make` gets the rows, the bytes of their texts and the offsets, and returns
    the columns of `arrow`. A text longer than a slice is handled on its own.
    """

    def run(batches):
        for batch in batches:
            raw, offsets = text_buffers(batch.column(text))
            for a, b in slices(offsets):
                made = make(batch.slice(a, b - a), raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                if made is not None:
                    yield pa.RecordBatch.from_arrays(
                        [v if isinstance(v, pa.Array) else pa.array(v, f.type) for f, v in ((f, made[f.name]) for f in arrow)],
                        schema=arrow,
                    )

    return small_batches(df).mapInArrow(run, schema)


def stamp(df: DataFrame, name: str = "_row") -> DataFrame:
    """`df` with a number for every row, stored, so that a lost task cannot renumber it."""
    return cut(df.withColumn(name, F.monotonically_increasing_id()))


def small_table(spark: SparkSession, **columns: pa.Array) -> DataFrame:
    """A table of a few rows of the driver's.

    From a list of rows Spark makes an RDD that Python workers read, with a daemon of
    their own, and they stay in memory beside those of the functions.
    """
    return spark.createDataFrame(pa.table(columns))


def content_key(text: Column) -> list[Column]:
    """Two independent 64-bit hashes of a text."""
    return [F.xxhash64(text), F.xxhash64(F.lit("second"), text)]


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected links (a, b): the smallest node it reaches.

    Alternating large-star and small-star rounds of (a, b) pairs. Every round is
    a table of the shared folder, so lost executors cost one round. It ends when
    a round changes nothing.
    """
    now = cut(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    seen = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = cut(large.where("a <> b").distinct())
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(
            F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")
        ).select("e.*")
        now = cut(small.where("a <> b").distinct())
        state = tuple(now.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.bit_xor(F.xxhash64("a", "b"))).first())
        if state == seen:
            break
        seen = state
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def backoff(call: Callable[[], object], tries: int = 3):
    """Storage calls of tasks, tried again after short pauses."""
    for k in range(tries):
        try:
            return call()
        except OSError:
            if k + 1 == tries:
                raise
            time.sleep(0.5 * 2**k)
