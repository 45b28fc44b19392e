"""WARC archives in Zstandard: a dictionary in the leading skippable frame, one frame for each record.

Archives are rows (archive, content), with content the bytes of a ``.warc.zst`` file of bounded
size; ``read_records`` takes any such rows, those of Spark's ``binaryFile`` source too.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The skippable frame that carries a dictionary, and the range of such frames.
DICTIONARY_FRAME, SKIPPABLE = 0x184D2A5D, range(0x184D2A50, 0x184D2A60)
ZSTD_FRAME = b"\x28\xb5\x2f\xfd"
#: A dictionary is trained on the first records of its archive, up to this many bytes, and has at most so many.
TRAINED_ON, DICTIONARY_BYTES = 1 << 20, 1 << 15
LEVEL = 3
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload string, problem string"


def planned(pages: DataFrame, id_column: str = "page_id", url: str = "url", html: str = "html", *, min_bytes: int = 100) -> DataFrame:
    """(page_id, url, payload, size, digest, refers_to): of equal payloads of ``min_bytes`` or more, the smallest id is referred to by the others.

    Null payloads are empty. Rows with the smallest id of their group, and rows without an id in a
    group without any, are responses. Only digests are grouped; a payload moves once.
    """
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_column).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("size", F.octet_length("payload").cast("long")).withColumn("digest", F.sha2("payload", 256))
    groups = rows.where(F.col("size") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("least"), F.count("*").alias("n")).where("n > 1").select("digest", "least")
    joined = rows.join(groups, "digest", "left")
    refers = F.when(F.col("least").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("least")), F.col("least"))
    return joined.select("page_id", "url", F.when(refers.isNull(), F.col("payload")).alias("payload"), "size", "digest", refers.alias("refers_to"))


def record(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: int | None, date: str) -> bytes:
    """One record: a response with its payload, or a revisit with the headers alone.

    Spaces and control characters of a URL are percent-encoded; a null URL has no header.
    """
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http + (payload or b"") if refers_to is None else http
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {date}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha256:{digest}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(identifier: str) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?[0-9]+)>", identifier)
    return int(found[1]) if found else None


class Archive:
    """Bytes of one archive; records wait until the dictionary can be trained on the first of them."""

    def __init__(self, max_bytes: int) -> None:
        self.waiting, self.size, self.parts, self.packer, self.max_bytes = [], 0, [], None, max_bytes

    def add(self, raw: bytes) -> None:
        if self.packer:
            self._frame(raw)
            return
        self.waiting.append(raw)
        if sum(map(len, self.waiting)) >= TRAINED_ON:
            self.start()

    def start(self) -> None:
        options = {}
        try:
            trained = zstandard.train_dictionary(DICTIONARY_BYTES, [w[:8192] for w in self.waiting])
            self._append(struct.pack("<II", DICTIONARY_FRAME, len(trained.as_bytes())) + trained.as_bytes())
            options["dict_data"] = trained
        except zstandard.ZstdError:  # too little to learn from: such an archive has no dictionary
            pass
        self.packer = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, **options)
        for raw in self.waiting:
            self._frame(raw)
        self.waiting = []

    def _frame(self, raw: bytes) -> None:
        self._append(self.packer.compress(raw))

    def _append(self, part: bytes) -> None:
        self.parts.append(part)
        self.size += len(part)

    @property
    def full(self) -> bool:
        return self.size >= self.max_bytes

    def content(self) -> bytes:
        if not self.packer:
            self.start()
        return b"".join(self.parts)


def written_archives(records: DataFrame, *, archive_bytes: int = 4 << 20, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """(archive, content) of the planned records, each archive closed once it has ``archive_bytes``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, empty = Archive(archive_bytes), True
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                for row in zip(*(c.to_pylist() for c in batch.slice(start, 64).columns)):
                    archive.add(record(*row, date))
                    empty = False
                    if archive.full:
                        yield closed(archive)
                        archive, empty = Archive(archive_bytes), True
        if not empty:
            yield closed(archive)

    def closed(archive: Archive) -> pa.RecordBatch:
        content = archive.content()
        name = f"{uuid.UUID(bytes=hashlib.sha256(content).digest()[:16])}.warc.zst"
        return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([content], pa.binary())], names=["archive", "content"])

    return records.select("page_id", "url", "payload", "size", "digest", "refers_to").mapInArrow(run, "archive string, content binary")


def read_dictionary(raw: bytes) -> zstandard.ZstdCompressionDict:
    """The dictionary of a frame, which may be compressed itself; ZstdError if it is not whole."""
    if raw[:4] == ZSTD_FRAME:
        unpack = zstandard.ZstdDecompressor().decompressobj()
        raw = unpack.decompress(raw)
        if not unpack.eof:
            raise zstandard.ZstdError("it is cut off")
    return zstandard.ZstdCompressionDict(raw)


def frames(content: bytes) -> Iterator[tuple[bytes, str | None]]:
    """Each frame's bytes and what is wrong with it; after a broken frame, the dictionary's too, the rest can't be found.

    A cut between two frames leaves a whole archive with fewer records.
    """
    at, dictionary = 0, None
    view = memoryview(content)
    while at < len(content):
        if len(content) - at >= 8 and (magic := struct.unpack_from("<I", content, at)[0]) in SKIPPABLE:
            size = struct.unpack_from("<I", content, at + 4)[0]
            if at + 8 + size > len(content):
                yield b"", f"the {'dictionary' if magic == DICTIONARY_FRAME and at == 0 else 'skippable'} frame is cut off"
                return
            if magic == DICTIONARY_FRAME and at == 0:
                try:
                    dictionary = read_dictionary(bytes(view[8 : 8 + size]))
                except zstandard.ZstdError as e:
                    yield b"", f"broken dictionary: {e}"
                    return
            at += 8 + size
            continue
        unpack = zstandard.ZstdDecompressor(**({"dict_data": dictionary} if dictionary else {})).decompressobj()
        parts = []
        try:
            while not unpack.eof and at < len(content):
                given = view[at : at + (1 << 16)]
                parts.append(unpack.decompress(given))
                at += len(given) - len(unpack.unused_data)
        except zstandard.ZstdError as e:
            yield b"".join(parts), f"broken frame: {e}"
            return
        yield b"".join(parts), None if unpack.eof else "the last frame is cut off"


def parsed(raw: bytes) -> tuple:
    """A row of RECORDS from one record's bytes."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, colon, v in (x.partition(":") for x in lines[1:]) if colon}
    problem = None
    if not gap or not re.fullmatch(r"WARC/1\.[01]", lines[0]):
        problem = "no WARC header"
    elif missing := [k for k in REQUIRED if k not in fields]:
        problem = f"without {', '.join(missing)}"
    elif not fields["content-length"].isdigit() or len(rest) != int(fields["content-length"]) + 4 or not rest.endswith(b"\r\n\r\n"):
        problem = "the length is not that of the block"
    if problem:
        return (None,) * 7 + (problem,)
    http, gap, payload = rest[:-4].partition(b"\r\n\r\n")
    length = re.search(rb"(?im)^content-length:[ \t]*([0-9]+)", http)
    kind, digest = fields["warc-type"], fields.get("warc-payload-digest", "").removeprefix("sha256:")
    size = int(length[1]) if length else len(payload)
    if kind == "response" and (size != len(payload) or hashlib.sha256(payload).hexdigest() != digest):
        problem = "the payload is not that of the headers"
    elif kind == "revisit" and "warc-refers-to" not in fields:
        problem = "it refers to nothing"
    return page_of(fields["warc-record-id"]), fields.get("warc-target-uri"), size, digest, kind, page_of(fields.get("warc-refers-to", "")), payload.decode("utf-8", "replace") if kind == "response" else None, problem


def read_records(archives: DataFrame, content: str = "content", *, with_payload: bool = True) -> DataFrame:
    """A row of RECORDS for each record; ``problem`` says what is wrong with one, and such a record stays a row.

    Null and empty contents have no records. Without ``with_payload`` payloads are validated and left out.
    """
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
    names = [f.split()[0] for f in RECORDS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column(0):
                rows = []
                for raw, problem in frames(value.as_py() or b""):
                    row = parsed(raw) if problem is None else (None,) * 7 + (problem,)
                    rows.append(row if with_payload else (*row[:6], None, row[7]))
                    if len(rows) == 256:
                        yield rows_of(rows)
                        rows = []
                yield rows_of(rows)

    def rows_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 8, kinds)], names=names)

    return archives.select(content).mapInArrow(run, RECORDS)
