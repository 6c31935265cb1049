"""Secrets in texts, told apart from examples by who else has them."""

from __future__ import annotations

import hashlib
import math
import re

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlens.llm.common import small_batches
from graphlens.session import cut

KINDS = ("assign", "access", "hex", "token")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
LEAST = {"assign": 8, "access": 16}
BITS = 3.0
COPIED = 3

SCANNED = pa.schema([
    ("row", pa.int64()), ("doc_id", pa.int64()), ("owner", pa.string()), ("repository", pa.string()), ("n_assign", pa.int64()),
    ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()),
    ("found", pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("key", pa.int64()), ("strong", pa.bool_())]))),
])


def entropy(value: str) -> float:
    """Bits per character."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in map(value.count, set(value)))


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind, end, value) of the base patterns, in order.

    A maximal run of hex digits and one of 32 or more are the same matches; so are
    those of `AKIA`. An assignment that is too short still uses up its text.
    """
    out = []
    low = text.lower()
    if any(w in low for w in WORDS):
        out += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    out += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(out)


def token_spans(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, int, str]]:
    """Other long tokens with letters and digits that no base span touches."""
    out = []
    for m in TOKEN.finditer(text):
        value = m[0]
        if any(c.isdigit() for c in value) and any(c.isalpha() for c in value) and not any(s < m.end() and m.start() < e for s, _, e, _ in base):
            out.append((m.start(), 3, m.end(), value))
    return out


def scan(docs: DataFrame) -> DataFrame:
    """A row per (row, doc_id, owner, repository, text): base counts and digest, and all candidates with a hash of their value."""

    def key(value: str) -> int:
        x = xxhash.xxh64_intdigest(value.encode("utf-8", "surrogatepass"))
        return x - (1 << 64) if x >= 1 << 63 else x

    def run(batches):
        for batch in batches:
            rows = []
            for row, doc, owner, repository, text in zip(*(batch.column(i).to_pylist() for i in range(4)), batch.column(4), strict=True):
                text = text.as_py() or ""
                base = base_spans(text)
                found = sorted([*base, *token_spans(text, base)])
                said = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e, _ in base)
                kinds = [k for _, k, _, _ in base]
                rows.append((
                    row, doc, owner, repository, kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(said.encode()).hexdigest(),
                    [{"kind": k, "start": s, "end": e, "key": key(v), "strong": entropy(v) >= BITS} for s, k, e, v in found],
                ))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), SCANNED, strict=True)], schema=SCANNED)

    return small_batches(docs).mapInArrow(
        run, "row long, doc_id long, owner string, repository string, n_assign long, n_access long, n_hex long, base_sha256 string, "
        "found array<struct<kind:int,start:long,end:long,key:long,strong:boolean>>",
    )


def ownership(candidates: DataFrame) -> DataFrame:
    """(key, occurrences, repositories, owners) of every candidate value in the corpus.

    Repeats are counted up within each repository first, so a value that a third of
    all rows hold arrives as one row per repository.
    """
    return (
        candidates.groupBy("key", "owner", "repository").agg(F.count("*").alias("n"))
        .groupBy("key", "owner").agg(F.sum("n").alias("n"), F.count("*").alias("m"))
        .groupBy("key").agg(F.sum("n").alias("occurrences"), F.sum("m").alias("repositories"), F.count("*").alias("owners"))
    )


def find_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repository_col: str | None = "lang",
    copied: int = COPIED,
) -> DataFrame:
    """A row per document: base counts, base_sha256, all spans, and how its candidates are owned.

    Candidates are the base patterns' matches and other tokens of 20 characters or
    more. Each value's hash is counted over the corpus by distinct owners, and
    repositories (owner and `repository_col`). A value with `copied` owners or more
    is widely copied, such as an example from documentation; one with fewer that
    has at least three bits of entropy a character looks live. Tokens are added to
    the spans (kind token) only if they look live; base spans always stay. n_live
    and n_copied count the document's candidates of either sort. Null texts are
    empty, null owners one owner; repeated rows are documents of their own. Values
    themselves are never stored. Other columns are left out.
    """
    repository = F.col(repository_col).cast("string") if repository_col else F.lit("")
    narrow = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"),
        F.coalesce(F.col(owner_col).cast("string"), F.lit("")).alias("owner"), F.coalesce(repository, F.lit("")).alias("repository"),
        F.col(text_col).cast("string").alias("text"),
    )
    scanned = cut(scan(narrow))
    candidates = scanned.select("row", "owner", "repository", F.explode("found").alias("c")).select("row", "owner", "repository", "c.*")
    counted = ownership(candidates)
    judged = candidates.select("row", "kind", "start", "end", "key", "strong").join(counted, "key").withColumns({
        "copied": F.col("owners") >= copied, "live": (F.col("owners") < copied) & F.col("strong"),
    })
    names = F.element_at(F.array(*[F.lit(k) for k in KINDS]), F.col("kind") + 1)
    spans = judged.groupBy("row").agg(
        F.sum(F.col("live").cast("long")).alias("n_live"), F.sum(F.col("copied").cast("long")).alias("n_copied"),
        F.sort_array(F.collect_list(F.when(
            (F.col("kind") < 3) | F.col("live"), F.struct("start", "kind", F.concat_ws(":", names, "start", "end").alias("said"))
        ))).alias("all"),
    )
    none = F.lit(0).cast("long")
    return scanned.drop("found", "owner", "repository").join(spans, "row", "left").select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256",
        F.coalesce(F.array_join("all.said", ","), F.lit("")).alias("spans"),
        F.coalesce("n_live", none).alias("n_live"), F.coalesce("n_copied", none).alias("n_copied"),
    )
