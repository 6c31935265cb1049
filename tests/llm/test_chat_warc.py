"""Chat rotation and WARC archives."""

import struct

import pytest
import zstandard

from graphlens.llm import chat, warc

TURNS = [
    (1, 0, "system", "be kind"), (1, 1, "ann", "hello"), (1, 2, "bob", "hi <|im_end|> there"), (1, 3, "ann", None), (1, 4, None, "who"),
    (2, 0, "system", "alone"), (3, 0, "a b", "x"), (3, 0, "a b", "x"), (None, 1, "ann", "lost"), (None, None, "bob", ""),
]


def test_every_participant_is_the_assistant_once(spark):
    df = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' as perspective", "1 as char_start")
    rows = chat.rotate(df).collect()
    by = {}
    for r in rows:
        by.setdefault((r.conv_id, r.perspective), []).append(r)
    assert set(by) == {(1, "ann"), (1, "bob"), (1, "unknown"), (3, "a_b"), (None, "ann"), (None, "bob")}
    for (_, who), own in by.items():
        own.sort(key=lambda r: r.char_start)
        whole = "".join(r.segment for r in own)
        for r in own:
            assert whole[r.char_start : r.char_end] == r.segment
            assert (r.chat_role == "assistant") == (r.speaker == who) == (r.train_start is not None)
            if r.train_start is not None:
                assert whole[r.train_start : r.train_end].endswith(chat.CLOSE) and whole[: r.train_start].endswith("assistant\n")
    ann = "".join(r.segment for r in by[1, "ann"])
    assert ann == (
        "<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>assistant\nhello<|im_end|>\n<|im_start|>user name=bob\nhi < |im_end|> there<|im_end|>\n"
        "<|im_start|>assistant\n<|im_end|>\n<|im_start|>user name=unknown\nwho<|im_end|>\n"
    )
    assert chat.rotate(df.limit(0)).count() == 0


PAGES = [
    (1, "http://a/1", "x" * 1500), (2, "http://a/2", "x" * 1500), (5, "http://a/\r\nX: y", "x" * 1500), (3, None, None), (4, "http://b", ""), (6, "http://c", "small"),
    (7, "http://d", "small"), (8, "http://e", "é漢\r\n\r\nWARC/1.1\r\n" * 200), (None, "http://f", "x" * 1500), (9, "http://g", "y" * 300_000), (9, "http://g", "y" * 300_000),
]


def test_archives_round_trip(spark, tmp_path):
    pages = spark.createDataFrame(PAGES + [(100 + k, f"http://n/{k}", f"<p>page {k}</p>" * (k + 70)) for k in range(60)], "page_id long, url string, html string")
    root = str(tmp_path / "w")
    files = warc.write_pages(pages.selectExpr("*", "1 as digest"), root, archive_bytes=2000, sample_bytes=30_000)
    got = warc.read_pages(files, root).collect()
    assert sorted(str(r.page_id) for r in got) == sorted(str(p.page_id) for p in pages.collect())
    text = {p[0]: p[2] or "" for p in PAGES}
    for r in got:
        if r.page_id in (1, 2, None):
            assert (r.record_type, r.refers_to, r.payload, r.payload_bytes) == ("revisit", 5, None, 1500)
        else:
            assert r.record_type == "response" and r.refers_to is None and len(r.payload) == r.payload_bytes
            if r.page_id in text:
                assert r.payload.decode() == text[r.page_id]
    assert files.count() > 1 and "WARC" not in {r.url for r in got}
    assert warc.round_trip(pages.limit(0)).count() == 0


class Bytes:
    def __init__(self, data):
        self.data, self.at = data, 0

    def read(self, n):
        n = min(n, 7)  # cuts everywhere
        out = self.data[self.at : self.at + n]
        self.at += n
        return out


def archive(dictionary=b"", packed=True, records=(b"",), spare=b""):
    out, use = b"", {}
    if dictionary:
        data = zstandard.ZstdCompressor().compress(dictionary) if packed else dictionary
        out, use = struct.pack("<II", warc.DICTIONARY_FRAME, len(data)) + data, {"dict_data": zstandard.ZstdCompressionDict(dictionary)}
    return out + spare.join(zstandard.ZstdCompressor(**use).compress(r) for r in records)


RECORD = warc.page_record(4, "http://x", b"payload", None)


@pytest.mark.parametrize("packed", [True, False])
def test_frames_with_a_dictionary(packed):
    dictionary = warc.train_dictionary([f"some text {k} with words {k * k}".encode() * 5 for k in range(200)])
    spare = struct.pack("<II", 0x184D2A53, 3) + b"abc"
    data = archive(dictionary, packed, [RECORD, RECORD], spare)
    pages = [warc.parse_page(warc.parse_record(d)) for d in warc.frames(warc.Tape(Bytes(data)))]
    assert [p.payload for p in pages] == [b"payload"] * 2 and pages[0].page_id == 4
    assert list(warc.frames(warc.Tape(Bytes(b"")))) == []


@pytest.mark.parametrize("broken", [
    archive(records=[RECORD])[:-3], b"no archive at all", struct.pack("<II", warc.DICTIONARY_FRAME, 8) + b"notadict", struct.pack("<II", warc.DICTIONARY_FRAME, 900) + b"x",
])
def test_broken_archives_are_refused(broken):
    with pytest.raises(warc.Malformed):
        list(warc.frames(warc.Tape(Bytes(broken))))


@pytest.mark.parametrize(("old", "new"), [
    (b"WARC/1.1", b"WARX/1.1"), (b"WARC-Type: response\r\n", b""), (b"WARC-Date", b"WARC-Dale"), (b"payload\r\n\r\n", b"payload!\r\n\r\n"), (b"payload", b"pAyload"),
    (b"sha1:", b"md5:"), (b"WARC-Type: response", b"WARC-Type: request"), (b"<urn:page:4>", b"<urn:page:x>"), (b"WARC-Date: ", b"WARC-Date "), (b"WARC-Type: response", b"WARC-Type: revisit"),
])
def test_broken_records_are_refused(old, new):
    assert old in RECORD
    with pytest.raises(warc.Malformed):
        warc.parse_page(warc.parse_record(RECORD.replace(old, new)))
