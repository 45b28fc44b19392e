"""Quality rules: counts within a document, and lines that many documents of a host share.

Normalised lines (words with single spaces, A-Z lower-cased) are hashed. For each host, the
distinct documents of a line are counted. Lines above the limit are removed, and a document that
loses too much is rejected.

A document is told by a digest of its whole normalised text, so exact copies count once; near copies
are documents of their own, and where more of them than the limit share most of their lines, those
lines are common as any others are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import written

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\v\f\r"
#: A line is common in a host if more distinct documents than this have it.
MAX_DOCUMENTS = 20
#: A document is depleted if more than this share of its words is in common lines.
MAX_REMOVED = 0.6
BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"
NAMES = [f.split()[0] for f in BASE.split(", ")]


def repeated_words(words: list[bytes], size: int = 3) -> int:
    """Words that lie in a window of ``size`` words found twice or more, the first included."""
    windows = list(zip(*(words[i:] for i in range(size))))
    if len(set(windows)) == len(windows):
        return 0
    seen: set[tuple] = set()
    twice = {w for w in windows if w in seen or seen.add(w)}
    count = end = 0
    for i, w in enumerate(windows):
        if w in twice:
            count += i + size - max(i, end)
            end = i + size
    return count


def normalised(line: bytes) -> bytes:
    return b" ".join(line.split()).lower()


def line_hash(line: bytes) -> int:
    """The first eight bytes of the MD5, as a signed long."""
    return int.from_bytes(hashlib.md5(line, usedforsecurity=False).digest()[:8], "big", signed=True)


def measured(text: str | None) -> tuple[list[int], int, list[dict]]:
    """The base counts of a text, its digest, and of each distinct normalised line the hash and the words in all its places."""
    raw = (text or "").encode()
    words = raw.split()
    lines: dict[bytes, int] = {}
    seen: set[bytes] = set()
    duplicates = 0
    for line in raw.split(b"\n"):
        own = line.split()
        if not own:
            continue
        duplicates += line in seen
        seen.add(line)
        key = b" ".join(own).lower()
        lines[key] = lines.get(key, 0) + len(own)
    chars = len(text or "") - (len(raw) - len(raw.translate(None, SPACES)))
    counts = [len(words), chars, len(raw) - len(raw.translate(None, SYMBOLS)), duplicates, repeated_words(words)]
    return counts, line_hash(b" ".join(words).lower()), [{"line": line_hash(k), "words": n} for k, n in lines.items()]


def measures(docs: DataFrame, id_column: str, text: str, host: str) -> DataFrame:
    """(key, doc_id, host, the base counts, document, lines) of each row; key is a 128-bit hash of id, host and text, so that equal rows share it."""
    kinds = [pa.string(), pa.int64(), pa.string(), *[pa.int64()] * 6, pa.list_(pa.struct([("line", pa.int64()), ("words", pa.int64())]))]
    names = ["key", "doc_id", "host", *NAMES, "document", "lines"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                rows = []
                for key, doc_id, host_name, value in zip(*(c.to_pylist() for c in batch.slice(start, 256).columns)):
                    counts, document, lines = measured(value)
                    rows.append((key, doc_id, host_name, *counts, document, lines))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    source = docs.select(_key(id_column, host, text).alias("key"), F.col(id_column).cast("long"), F.coalesce(F.col(host), F.lit("")), F.col(text))
    return source.mapInArrow(run, f"key string, doc_id long, host string, {BASE}, document long, lines array<struct<line:bigint,words:bigint>>")


def _key(id_column: str, host: str, text: str):
    parts = [F.col(id_column), F.col(host), F.col(text)]
    return F.concat(F.hex(F.xxhash64(*parts)), F.lit("-"), F.hex(F.xxhash64(F.lit(1), *parts)))


def judged(docs: DataFrame, id_column: str = "doc_id", text: str = "text", host: str = "source", *, max_documents: int = MAX_DOCUMENTS, max_removed: float = MAX_REMOVED) -> DataFrame:
    """(key, doc_id, base counts, base_failed, n_removed_words, kept, common): a row for each row.

    ``common`` has the hashes of its lines that are removed. Null texts have no words and fail;
    null hosts are the host "". Null ids stay null. Equal rows have a verdict each, but texts that
    are equal but for case and white space count once for a line.
    """
    rows = written(measures(docs, id_column, text, host), "lines")
    lines = rows.select("key", "host", "document", F.explode("lines").alias("l")).select("key", "host", "document", "l.*")
    # an equal pair of line and document is gone before the shuffle; a very common line is counted in parts
    own = lines.select("host", "line", "document").distinct()
    common = own.groupBy("host", "line").count().where(F.col("count") > max_documents).select("host", "line")
    found = lines.join(common, ["host", "line"], "left_semi").groupBy("key").agg(F.collect_set(F.struct("line", "words")).alias("found"))
    removed = F.coalesce(F.aggregate("found", F.lit(0).cast("long"), lambda s, x: s + x["words"]), F.lit(0))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = rows.join(found, "key", "left").select("key", "doc_id", *NAMES, failed.alias("base_failed"), removed.alias("n_removed_words"), F.coalesce(F.transform("found", lambda x: x["line"]), F.array().cast("array<bigint>")).alias("common"))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("n_removed_words") <= max_removed * F.col("n_words")))


def _without(text: str | None, common: list[int] | None) -> str | None:
    if not text or not common:
        return text
    drop = set(common)
    return "\n".join(x for x in text.split("\n") if not (n := normalised(x.encode())) or line_hash(n) not in drop)


def cleaned(docs: DataFrame, id_column: str = "doc_id", text: str = "text", host: str = "source", *, max_documents: int = MAX_DOCUMENTS, max_removed: float = MAX_REMOVED) -> DataFrame:
    """The rows that are kept, without their common lines; all columns stay, and null texts are never kept."""
    verdicts = judged(docs, id_column, text, host, max_documents=max_documents, max_removed=max_removed)
    kept = verdicts.where("kept").groupBy("key").agg(F.first("common").alias("common"))  # equal rows have equal verdicts
    names = docs.columns
    plain = docs.select(_key(id_column, host, text).alias("_key"), *(F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(names)))
    joined = plain.join(kept.withColumnRenamed("key", "_key").withColumnRenamed("common", "_common"), "_key")
    at = f"_c{names.index(text)}"
    untouched = F.size("_common") == 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            i = batch.schema.names.index(at)
            texts = [_without(t, c) for t, c in zip(batch.column(i).to_pylist(), batch.column(batch.num_columns - 1).to_pylist())]
            columns = list(batch.columns)
            columns[i] = pa.array(texts, batch.schema.field(i).type)
            yield pa.RecordBatch.from_arrays(columns[:-1], names=batch.schema.names[:-1])

    columns = [f"_c{i}" for i in range(len(names))]
    changed = joined.where(~untouched).select(*columns, "_common")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in changed.schema.fields[:-1])
    out = joined.where(untouched).select(*columns).union(changed.mapInArrow(run, schema))
    return out.select(*(F.col(c).alias(n) for c, n in zip(columns, names)))
