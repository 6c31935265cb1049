"""Packing token sequences into windows by multiway differencing."""

from __future__ import annotations

import base64
import heapq
import json
import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlens.llm.common import small_batches

CAPACITY = 1024
PIECE = 256
WINDOWS = 128

SCHEMA = (
    "{id} long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids array<int>"
)


def tokenizer_path(name: str) -> str:
    """Where the installed vocabulary files are."""
    import public_tokenizers

    return public_tokenizers.path(name)


class ByteBpe:
    """Ids of a byte-level BPE vocabulary.

    `spec` is the JSON the tokenizers library loads and `ranks` the same
    vocabulary as a rank file, which a faster encoder reads. Texts that spell one
    of the special tokens go to the tokenizers library, which alone defines what
    becomes of those.
    """

    def __init__(self, spec: str, ranks: str):
        import public_tokenizers
        import tiktoken

        self.spec, self.loaded = spec, None
        with open(spec, encoding="utf-8") as text:
            self.special = [t["content"] for t in json.load(text)["added_tokens"]]
        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})

    @property
    def slow(self):
        from tokenizers import Tokenizer

        if self.loaded is None:
            self.loaded = Tokenizer.from_file(self.spec)
        return self.loaded

    def encode(self, text: str) -> list[int]:
        if any(s in text for s in self.special):
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


def difference(sizes: Sequence[int], windows: int) -> list[list[int]]:
    """Distribute items over `windows` sets of nearly equal size.

    Karmarkar and Karp's differencing: every item starts as a partial partition
    of its own. The two partial partitions whose sets differ most are merged, the
    largest set of one with the smallest of the other, until one is left. Only
    sets that are not empty are stored, largest first.
    """
    heap = [(-s, i, [(s, i)]) for i, s in enumerate(sizes)] if windows > 1 else []
    if windows == 1:
        return [list(range(len(sizes)))]
    heapq.heapify(heap)
    fresh = len(sizes)
    while len(heap) > 1:
        _, _, one = heapq.heappop(heap)
        _, _, two = heapq.heappop(heap)
        spare = windows - len(one)
        # the largest sets of `two` meet the empty sets of `one` and stay as they are
        alone = two[:spare] if len(two) > spare else two
        over = two[spare:] if len(two) > spare else []
        merged = one[: len(one) - len(over)] if over else list(one)
        if over:
            tail = one[len(one) - len(over) :]
            merged += [(a[0] + b[0], (a[1], b[1])) for a, b in zip(tail, reversed(over), strict=True)]
        merged += alone
        merged.sort(key=lambda x: -x[0])
        gap = merged[0][0] - (merged[-1][0] if len(merged) == windows else 0)
        heapq.heappush(heap, (-gap, fresh, merged))
        fresh += 1
    out = []
    for _, members in heap[0][2] if heap else []:
        flat, stack = [], [members]
        while stack:
            x = stack.pop()
            if isinstance(x, tuple):
                stack.extend(x)
            else:
                flat.append(x)
        out.append(sorted(flat))
    return out


def windows_of(sizes: Sequence[int], capacity: int) -> list[list[int]]:
    """Near-equal windows of at most `capacity`: as few as differencing can make fit."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        made = difference(sizes, k)
        if all(sum(sizes[i] for i in w) <= capacity for w in made):
            return made
        k += 1


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", spec: str | None = None, ranks: str | None = None,
    capacity: int = CAPACITY, piece: int = PIECE, windows: int = WINDOWS, end_id: int = 0, with_ids: bool = True,
) -> DataFrame:
    """Pack the tokens of all documents into sequences of at most `capacity` ids.

    A document's ids end with `end_id`; null texts count as empty and so give that
    id alone. Runs of `capacity` ids become sequences as they are. What is left of
    a document is cut at `piece` ids, and about `windows` windows' worth of such
    pieces are placed by differencing; where a window would exceed the capacity,
    one more is opened. Returns one row per piece: the id column, start, length,
    ids_crc32 (of the ids as little-endian unsigned 32-bit), doc_tokens,
    sequence_id, offset, and ids unless `with_ids` is false (then null).

    Every task packs its own rows in order, holds one batch of texts and the
    pieces of one group of windows, and shuffles nothing; sequence ids carry the
    number of the task. An empty table gives no rows; repeated rows are packed as
    often as they occur; null ids stay null. Other columns are left out.
    """
    spec = spec or tokenizer_path("byte_bpe_50k.json")
    ranks = ranks or tokenizer_path("byte_bpe_50k.tiktoken")
    if not 0 < piece <= capacity:
        raise ValueError("piece must lie between 1 and capacity")
    arrow = pa.schema([
        (id_col, pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()),
        ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.list_(pa.int32())),
    ])
    room = windows * capacity - piece // 8

    def run(batches):
        bpe = ByteBpe(spec, ranks)
        sequence = TaskContext.get().partitionId() << 40
        waiting: list[tuple] = []
        held = 0
        rows: list[tuple] = []

        def emit(members):
            nonlocal sequence
            at = 0
            for doc, start, total, ids in members:
                rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, sequence, at, ids if with_ids else None))
                at += len(ids)
            sequence += 1

        def place():
            nonlocal held
            for members in windows_of([len(w[3]) for w in waiting], capacity):
                emit([waiting[i] for i in members])
            waiting.clear()
            held = 0

        def flush():
            columns = list(zip(*rows, strict=True))
            ids = columns.pop()
            arrays = [pa.array(c, f.type) for c, f in zip(columns, arrow, strict=False)]
            if with_ids:
                ends = np.zeros(len(ids) + 1, np.int32)
                np.cumsum([len(x) for x in ids], out=ends[1:])
                arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids).view(np.int32))))
            else:
                arrays.append(pa.nulls(len(ids), pa.list_(pa.int32())))
            rows.clear()
            return pa.RecordBatch.from_arrays(arrays, schema=arrow)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array([*bpe.encode(text.as_py() or ""), end_id], "<u4")
                total = len(ids)
                whole = total - total % capacity
                for start in range(0, whole, capacity):
                    emit([(doc, start, total, ids[start : start + capacity])])
                for start in range(whole, total, piece):
                    part = ids[start : start + piece]
                    if held + len(part) > room and waiting:
                        place()
                    waiting.append((doc, start, total, part))
                    held += len(part)
                if len(rows) >= 4096:
                    yield flush()
        if waiting:
            place()
        if rows:
            yield flush()

    source = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias("_text"))
    return small_batches(source).mapInArrow(run, SCHEMA.format(id=f"`{id_col}`"))
