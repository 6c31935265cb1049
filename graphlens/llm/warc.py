"""WARC archives in Zstandard: one frame per record, the dictionary in front."""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphlens.llm.common import backoff, small_batches
from graphlens.session import cut, scratch_path

DICTIONARY_FRAME = 0x184D2A5D
DICTIONARY_MAGIC = 0xEC30A437
FRAME_MAGIC = 0xFD2FB528
DICTIONARY_BYTES = 16_384
SAMPLE_BYTES = 2_000_000
ARCHIVE_BYTES = 32_000_000
BLOCK = 1 << 16
LEAST_REVISIT = 1000
DATE = "2024-01-01T00:00:00Z"
NO_PAGE = "none"


class Malformed(ValueError):
    """An archive that breaks the format."""


class Record(NamedTuple):
    headers: dict[str, str]
    block: bytes


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


# -- writing ---------------------------------------------------------------


def make_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A record with its length; line breaks and blanks in values are escaped."""
    safe = lambda v: re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", v)
    lines = ["WARC/1.1", *(f"{k}: {safe(v)}" for k, v in headers), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def http_block(payload: bytes, carried: bool) -> bytes:
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    return head + payload if carried else head


def page_record(page: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    name = lambda x: f"<urn:page:{NO_PAGE if x is None else x}>"
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    headers = [
        ("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", name(page)), ("WARC-Date", DATE),
        ("WARC-Target-URI", url or "about:blank"), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}"),
    ]
    if refers_to is not None:
        headers += [
            ("WARC-Refers-To", name(refers_to)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        ]
    return make_record(headers, http_block(payload, refers_to is None))


def train_dictionary(samples: list[bytes]) -> bytes | None:
    """A dictionary of the samples, or nothing where they are too few or too much alike."""
    if len(samples) < 16:
        return None
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=3).as_bytes()
    except zstandard.ZstdError:
        return None


class Archive:
    """One archive in the making; it exists under its name once it is closed."""

    def __init__(self, root: str, name: str, dictionary: bytes | None):
        self.system, folder = file_system(root)
        backoff(lambda: self.system.create_dir(folder, recursive=True))
        self.name = name
        self.sink = self.system.open_output_stream(f"{folder}/{name}")
        self.records, self.size = 0, 0
        use = {}
        if dictionary:
            packed = zstandard.ZstdCompressor(level=3).compress(dictionary)
            self._write(struct.pack("<II", DICTIONARY_FRAME, len(packed)) + packed)
            use = {"dict_data": zstandard.ZstdCompressionDict(dictionary)}
        self.compressor = zstandard.ZstdCompressor(level=3, write_checksum=True, write_content_size=True, **use)

    def _write(self, data: bytes) -> None:
        self.sink.write(data)
        self.size += len(data)

    def add(self, record: bytes) -> None:
        self._write(self.compressor.compress(record))
        self.records += 1

    def close(self) -> tuple[str, int, int]:
        self.sink.close()
        return self.name, self.records, self.size


MANIFEST = pa.schema([("name", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())])


def write_records(
    rows: DataFrame, root: str, make: Callable[[dict], bytes], archive_bytes: int = ARCHIVE_BYTES, sample_bytes: int = SAMPLE_BYTES
) -> DataFrame:
    """Write the record of every row into archives under `root`; return the stored list of files.

    Every task writes files of its own, of about `archive_bytes`, under names with
    the task attempt in them. Only the files of attempts that Spark accepts are in
    the list, so a task run twice leaves a file that nobody reads.
    """

    def run(batches):
        task = TaskContext.get()
        made, archive, waiting, held = 0, None, [], 0

        def start():
            nonlocal archive, made, held
            archive = Archive(root, f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{made:05d}.warc.zst", train_dictionary(waiting))
            made += 1
            for record in waiting:
                archive.add(record)
            waiting.clear()
            held = 0

        for batch in batches:
            done = []
            for row in batch.to_pylist():
                record = make(row)
                if archive is None:
                    waiting.append(record)
                    held += len(record)
                    if held >= sample_bytes:
                        start()
                else:
                    archive.add(record)
                if archive is not None and archive.size >= archive_bytes:
                    done.append(archive.close())
                    archive = None
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), MANIFEST, strict=True)], schema=MANIFEST)
        if waiting:
            start()
        if archive is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(archive.close(), MANIFEST, strict=True)], schema=MANIFEST)

    return cut(small_batches(rows).mapInArrow(run, "name string, records long, bytes long"))


# -- reading ---------------------------------------------------------------


class Tape:
    """Bytes of a stream, read in blocks and handed out in order."""

    def __init__(self, source):
        self.source, self.have = source, b""

    def more(self) -> bool:
        got = self.source.read(BLOCK)
        self.have += got
        return bool(got)

    def take(self, n: int) -> bytes:
        while len(self.have) < n:
            if not self.more():
                raise Malformed("the archive ends early")
        out, self.have = self.have[:n], self.have[n:]
        return out

    def at_end(self) -> bool:
        return not self.have and not self.more()

    def peek(self, n: int) -> bytes:
        while len(self.have) < n and self.more():
            pass
        return self.have[:n]


def read_dictionary(tape: Tape) -> bytes | None:
    """The dictionary in the leading skippable frame, which may itself be compressed."""
    start = tape.peek(8)
    if len(start) < 8 or struct.unpack("<I", start[:4])[0] != DICTIONARY_FRAME:
        return None
    data = tape.take(8 + struct.unpack("<I", start[4:])[0])[8:]
    magic = struct.unpack("<I", data[:4])[0] if len(data) >= 4 else 0
    if magic == FRAME_MAGIC:
        data = zstandard.ZstdDecompressor().decompressobj().decompress(data)
        magic = struct.unpack("<I", data[:4])[0] if len(data) >= 4 else 0
    if magic != DICTIONARY_MAGIC:
        raise Malformed("the leading frame holds no dictionary")
    return data


def frames(tape: Tape) -> Iterator[bytes]:
    """The content of each frame; other skippable frames are passed over."""
    dictionary = read_dictionary(tape)
    use = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
    decompressor = zstandard.ZstdDecompressor(**use)
    while not tape.at_end():
        start = tape.peek(8)
        magic = struct.unpack("<I", start[:4])[0] if len(start) >= 4 else 0
        if magic & 0xFFFFFFF0 == 0x184D2A50 and len(start) == 8:
            tape.take(8 + struct.unpack("<I", start[4:])[0])
            continue
        if magic != FRAME_MAGIC:
            raise Malformed("not a Zstandard frame")
        one, out = decompressor.decompressobj(), []
        try:
            while True:
                out.append(one.decompress(tape.take(len(tape.have)) if tape.have else b""))
                if one.eof:
                    tape.have = one.unused_data + tape.have
                    break
                if not tape.more():
                    raise Malformed("a frame ends early")
        except zstandard.ZstdError as error:
            raise Malformed(f"a frame cannot be decoded: {error}") from error
        yield b"".join(out)


def parse_record(data: bytes) -> Record:
    """A record from the content of its frame, with its headers and lengths checked."""
    head, blank, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not blank or lines[0] not in ("WARC/1.0", "WARC/1.1"):
        raise Malformed(f"no WARC record: {lines[0][:40]!r}")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise Malformed(f"header without a name: {line[:40]!r}")
        headers[name.strip().lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if not headers.get(name):
            raise Malformed(f"{name} is missing")
    if not headers["content-length"].isdigit() or int(headers["content-length"]) != len(rest) - 4 or not rest.endswith(b"\r\n\r\n"):
        raise Malformed("the length of the record is not what its header says")
    return Record(headers, rest[:-4])


class Page(NamedTuple):
    page_id: int | None
    url: str
    record_type: str
    refers_to: int | None
    payload_bytes: int
    payload_digest: str
    payload: bytes | None


def parse_page(record: Record) -> Page:
    """The page of a response or revisit record; a response's payload is held against its digest."""
    kind = record.headers["warc-type"]
    if kind not in ("response", "revisit"):
        raise Malformed(f"unexpected record type {kind}")
    head, blank, body = record.block.partition(b"\r\n\r\n")
    length = re.search(rb"\r\nContent-Length: (\d+)(?:\r\n|$)", head)
    if not blank or not head.startswith(b"HTTP/") or not length:
        raise Malformed("no HTTP message")
    method, _, digest = record.headers.get("warc-payload-digest", "").partition(":")
    if method != "sha1":
        raise Malformed("no SHA-1 of the payload")
    digest = base64.b32decode(digest).hex()
    if kind == "response" and (len(body) != int(length[1]) or hashlib.sha1(body).hexdigest() != digest):
        raise Malformed("the payload is not what its headers say")
    if kind == "revisit" and (body or "warc-refers-to" not in record.headers):
        raise Malformed("a revisit record refers to one other and has no payload")

    def number(uri: str | None) -> int | None:
        found = re.fullmatch(r"<urn:page:(-?\d+|none)>", uri or "")
        if uri and not found:
            raise Malformed(f"unexpected record id {uri[:40]!r}")
        return int(found[1]) if found and found[1] != NO_PAGE else None

    return Page(
        number(record.headers["warc-record-id"]), record.headers.get("warc-target-uri", ""), kind, number(record.headers.get("warc-refers-to")),
        int(length[1]), digest, body if kind == "response" else None,
    )


PAGES = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()),
    ("payload_digest", pa.string()), ("payload", pa.binary()),
])


def read_pages(files: DataFrame, root: str, with_payload: bool = True) -> DataFrame:
    """The pages of the archives listed in `files` (name, records); a file is one task's work.

    Fails on an archive that breaks the format or holds another number of records
    than was written. Rows come out in batches of about a MB.
    """

    def run(batches):
        system, folder = file_system(root)
        for batch in batches:
            for name, records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found, rows, held = 0, [], 0
                with backoff(lambda name=name: system.open_input_stream(f"{folder}/{name}")) as source:
                    for data in frames(Tape(source)):
                        page = parse_page(parse_record(data))
                        found += 1
                        held += len(data)
                        rows.append(page if with_payload else page._replace(payload=None))
                        if held >= 1_000_000:
                            yield to_batch(rows)
                            rows, held = [], 0
                if found != records:
                    raise Malformed(f"{name} holds {found} records of {records}")
                if rows:
                    yield to_batch(rows)

    def to_batch(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), PAGES, strict=True)], schema=PAGES)

    n = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.select("name", "records").repartition(n).mapInArrow(
        run, "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
    )


def write_pages(pages: DataFrame, root: str, least: int = LEAST_REVISIT, **sizes: int) -> DataFrame:
    """Archive (page_id, url, html) rows; return the stored list of files.

    Of pages with equal payloads of `least` bytes or more, that with the largest
    id is the response and the others are revisits of it. Revisits are found on
    ids, digests and sizes alone; the pages then meet that decision by id, so that
    no group of copies comes together with its texts. Null html is an empty
    payload; a null id is never the largest and revisits a page that has one, or is
    a response; rows alike in id and payload are written as often as they occur.
    """
    source = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"),
    )
    digest = F.sha1("payload")
    narrow = source.where(F.octet_length("payload") >= least).select("page_id", digest.alias("digest"))
    keepers = narrow.groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n")).where("n > 1 and keeper is not null")
    revisits = (
        narrow.join(keepers.drop("n"), "digest").where(~F.col("page_id").eqNullSafe(F.col("keeper"))).distinct()
        .select(F.col("page_id").alias("r_page"), F.col("digest").alias("r_digest"), "keeper")
    )
    decided = source.withColumn("digest", digest).join(
        revisits, F.col("page_id").eqNullSafe(F.col("r_page")) & (F.col("digest") == F.col("r_digest")), "left"
    )
    return write_records(
        decided.select("page_id", "url", "payload", "keeper"), root, lambda r: page_record(r["page_id"], r["url"], r["payload"], r["keeper"]), **sizes
    )


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages to archives in the shared folder and read them back, payloads left out."""
    root = scratch_path(pages.sparkSession, "warc")
    return read_pages(write_pages(pages, root), root, with_payload=False).drop("payload")


SQL = """
WITH p AS (
    SELECT page_id, coalesce(html, '') AS html, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes,
           sha1(coalesce(html, '')) AS payload_digest
    FROM pages
), k AS (SELECT payload_digest, max(page_id) AS keeper FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, CASE WHEN keeper <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN keeper <> page_id THEN keeper END AS refers_to, payload_bytes, p.payload_digest
FROM p LEFT JOIN k ON p.payload_digest = k.payload_digest AND payload_bytes >= 1000
"""
