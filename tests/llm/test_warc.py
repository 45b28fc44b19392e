import hashlib
import struct

import pytest
import zstandard

from tallyspark.llm import warc
from tallyspark.llm.common import written

PAGES = "page_id long, url string, html string"


def archives_of(spark, rows, **options):
    return written(warc.written_archives(warc.planned(spark.createDataFrame(rows, PAGES)), **options), "archives")


def test_round_trip_with_revisits(spark):
    twice, short = "<p>twice</p>" * 20, "<p>short</p>"
    rows = [(i, f"http://h/{i}", f"<html>{'é' * i}{i}</html>" * 3) for i in range(200)]
    rows += [(500, "u", twice), (400, "u", twice), (450, None, twice), (600, "a b\n", short), (601, "", short), (602, None, None)]
    got = {r.page_id: r for r in warc.read_records(archives_of(spark, rows, archive_bytes=3000)).collect()}
    assert len(got) == len(rows) and not any(r.problem for r in got.values())
    assert {i for i, r in got.items() if r.record_type == "revisit"} == {450, 500}
    assert got[500].refers_to == got[450].refers_to == 400 and got[400].payload == twice
    assert got[600].url == "a%20b%0A" and got[602].payload == "" and got[602].url is None
    for i, _, html in rows:
        raw = (html or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(raw), hashlib.sha256(raw).hexdigest())


def test_files_on_disk_by_the_binary_source(spark, tmp_path):
    rows = [(i, f"http://h/{i}", f"<html><body>page {i} with some words {i * i}</body></html>" * 40) for i in range(900)]
    for r in archives_of(spark, rows, archive_bytes=20_000).collect():
        (tmp_path / r.archive).write_bytes(r.content)
        assert struct.unpack("<I", r.content[:4])[0] == warc.DICTIONARY_FRAME
    files = spark.read.format("binaryFile").load(str(tmp_path))
    assert files.count() > 1
    got = {r.page_id: r for r in warc.read_records(files).collect()}
    assert len(got) == 900 and all(got[i].payload == html for i, _, html in rows)


def test_one_frame_a_record_and_compressed_dictionaries():
    raws = [warc.record(i, "u", f"<p>{i}</p>".encode() * 30, len(f"<p>{i}</p>") * 30, "x", None, "2020-01-01T00:00:00Z") for i in range(60)]
    archive = warc.Archive(1 << 20)
    for raw in raws:
        archive.add(raw)
    content = archive.content()
    assert [r for r, _ in warc.frames(content)] == raws
    size = struct.unpack_from("<I", content, 4)[0]
    packed = zstandard.ZstdCompressor().compress(content[8 : 8 + size])
    again = struct.pack("<II", warc.DICTIONARY_FRAME, len(packed)) + packed + struct.pack("<II", 0x184D2A50, 3) + b"abc" + content[8 + size :]
    assert [r for r, _ in warc.frames(again)] == raws


def test_broken_archives_have_problems(spark):
    good = warc.record(1, "u", b"<p>x</p>", 8, hashlib.sha256(b"<p>x</p>").hexdigest(), None, "d")
    frame = zstandard.ZstdCompressor(write_checksum=True).compress
    cases = {
        "cut": frame(good)[:-6],
        "length": frame(good.replace(b"<p>x</p>", b"<p>longer</p>")),
        "digest": frame(good.replace(b"<p>x</p>", b"<p>y</p>")),
        "header": frame(b"WARC/9" + good[8:]),
        "date": frame(good.replace(b"WARC-Date", b"X-Date")),
        "bytes": frame(good) + b"no frame at all",
    }
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "name string, content binary")
    rows = warc.read_records(df).collect()
    assert sum(r.problem is not None for r in rows) == len(cases)
    assert sum(r.problem is None for r in rows) == 1  # the whole record before the broken bytes


def test_a_cut_anywhere_is_reported_unless_it_is_between_frames():
    archive = warc.Archive(1 << 20)
    for i in range(40):
        archive.add(warc.record(i, f"http://h/{i}", f"<p>{i} words of a page</p>".encode() * 30, 10, "x", None, "2020-01-01T00:00:00Z"))
    content = archive.content()
    at = 8 + struct.unpack_from("<I", content, 4)[0]
    borders = [0, at]
    while at < len(content):
        unpack = zstandard.ZstdDecompressor(dict_data=warc.read_dictionary(content[8 : borders[1]])).decompressobj()
        unpack.decompress(content[at:])
        at = len(content) - len(unpack.unused_data)
        borders.append(at)
    assert len(borders) == 42 and borders[-1] == len(content)
    inside = sorted({b + d for b in borders for d in (1, 3, 4, 7, 8, 9)} | {borders[1] // 2} | {b - 1 for b in borders[1:]})
    for cut in borders + [c for c in inside if c < len(content)]:
        problems = [p for _, p in warc.frames(content[:cut])]
        whole = sum(b <= cut for b in borders[2:])
        assert problems[:whole] == [None] * whole
        assert len(problems[whole:]) == (cut not in borders) and all(problems[whole:]), cut


def test_broken_dictionaries_are_reported(spark):
    packed = zstandard.ZstdCompressor(write_checksum=True).compress(b"words " * 500)
    head = lambda raw: struct.pack("<II", warc.DICTIONARY_FRAME, len(raw)) + raw
    broken = bytearray(packed)
    broken[-1] ^= 1
    contents = [head(packed[:-5]), head(bytes(broken)), head(packed)[:20], struct.pack("<II", 0x184D2A50, 9) + b"abc"]
    rows = warc.read_records(spark.createDataFrame([(c,) for c in contents], "content binary")).collect()
    assert len(rows) == 4 and all(r.problem for r in rows)
    assert sum("dictionary" in r.problem for r in rows) == 3


def test_odd_rows(spark):
    page = "<p>equal</p>" * 20
    rows = [(7, "u", page), (7, "u", page), (None, None, page), (None, None, None), (8, "u", page)]
    got = warc.read_records(archives_of(spark, rows)).collect()
    assert sorted((r.page_id is None, r.page_id or 0, r.record_type, r.refers_to) for r in got) == [
        (False, 7, "response", None), (False, 7, "response", None), (False, 8, "revisit", 7),
        (True, 0, "response", None), (True, 0, "revisit", 7),
    ]
    assert warc.read_records(archives_of(spark, [])).collect() == []
    assert warc.read_records(spark.createDataFrame([(None,), (b"",)], "content binary")).collect() == []


@pytest.mark.parametrize("n", [0, 1, 99, 100])
def test_smallest_payload_that_is_revisited(spark, n):
    got = warc.read_records(archives_of(spark, [(1, "u", "x" * n), (2, "u", "x" * n)])).collect()
    assert sorted(r.record_type for r in got) == (["response", "revisit"] if n >= 100 else ["response"] * 2)
