"""Context-triggered piecewise hashing.

A rolling hash over seven bytes ends a piece where it meets a condition that depends on the block
size; each piece gives one letter of the signature. The block size is the smallest of 3, 6, 12, ...
by which the text's bytes make at most 64 blocks, and the fingerprint also has the signature at twice
that size. Signatures of equal block size are compared by edit distance (insertions and deletions).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import written

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
WINDOW, LEAST_BLOCK, PIECES = 7, 3, 64
#: Signatures that share no run of so many letters are not alike; short ones need half their letters.
COMMON_RUN = 5
PRIME = 0x100000001B3
RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def rolling(data: np.ndarray) -> np.ndarray:
    """Hash of the last seven bytes at every place: their sum, their weighted sum and a shifted exclusive or."""
    n = len(data)
    padded = np.concatenate([np.zeros(WINDOW - 1, np.uint32), data.astype(np.uint32)])
    total, weighted, mixed = np.zeros(n, np.uint32), np.zeros(n, np.uint32), np.zeros(n, np.uint32)
    for i in range(WINDOW):
        part = padded[i : i + n]
        total += part
        weighted += part * np.uint32(i + 1)
        mixed ^= part << np.uint32(5 * (WINDOW - 1 - i))
    return total + weighted + mixed


class Powers:
    """Powers of an odd number and of its inverse modulo 2**64, as far as needed so far."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) <= n:
            size = 1 << max(12, n.bit_length())
            factors = np.full(size, PRIME, np.uint64)
            factors[0] = 1
            inverse = np.full(size, pow(PRIME, -1, 1 << 64), np.uint64)
            inverse[0] = 1
            self.up, self.down = np.multiply.accumulate(factors), np.multiply.accumulate(inverse)
        return self.up, self.down


def fingerprint(raw: bytes, powers: Powers | None = None) -> str:
    """block:signature:signature at twice the block size; the empty text has block size 3 and no pieces."""
    n = len(raw)
    block = LEAST_BLOCK
    while block * PIECES < n:
        block *= 2
    if not n:
        return f"{block}::"
    data = np.frombuffer(raw, np.uint8)
    up, down = (powers or Powers()).to(n)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:n], dtype=np.uint64)])
    hashes = rolling(data)
    ends = np.flatnonzero(hashes % np.uint32(block) == block - 1) + 1
    return f"{block}:{_letters(sums, down, ends, n)}:{_letters(sums, down, np.flatnonzero(hashes % np.uint32(2 * block) == 2 * block - 1) + 1, n)}"


def _letters(sums: np.ndarray, down: np.ndarray, ends: np.ndarray, n: int) -> str:
    """A letter for each piece; beyond 64 pieces the last one reaches to the end."""
    ends = ends[: PIECES - 1]
    if not len(ends) or ends[-1] != n:
        ends = np.append(ends, n)
    starts = np.concatenate([[0], ends[:-1]])
    hashes = (sums[ends] - sums[starts]) * down[starts]
    hashes ^= hashes >> np.uint64(32)
    hashes *= np.uint64(0x9E3779B97F4A7C15)
    return "".join(LETTERS[i] for i in (hashes >> np.uint64(58)).tolist())


def common_letters(a: str, b: str) -> int:
    """Length of the longest common subsequence, one bit for each letter of a."""
    places: dict[str, int] = {}
    for i, letter in enumerate(a):
        places[letter] = places.get(letter, 0) | 1 << i
    every = (1 << len(a)) - 1
    row = every
    for letter in b:
        met = row & places.get(letter, 0)
        row = ((row + met) | (row - met)) & every
    return len(a) - row.bit_count()


def alike(a: str, b: str) -> float:
    """1 less the edit distance of two signatures over their letters; 0 if no run of letters is common."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    run = min(COMMON_RUN, max(1, min(len(a), len(b)) // 2))
    if not {a[i : i + run] for i in range(len(a) - run + 1)} & {b[i : i + run] for i in range(len(b) - run + 1)}:
        return 0.0
    distance = len(a) + len(b) - 2 * common_letters(a, b)
    return 1.0 - distance / (len(a) + len(b))


def likeness(a: str, b: str) -> float:
    """0 to 1: the better of the comparisons at equal block sizes; 0 if the sizes are more than twice apart."""
    if a == b:
        return 1.0
    (x, x1, x2), (y, y1, y2) = a.split(":"), b.split(":")
    x, y = int(x), int(y)
    pairs = [(x1, y1), (x2, y2)] if x == y else [(x1, y2)] if x == 2 * y else [(x2, y1)] if y == 2 * x else []
    return max((alike(p, q) for p, q in pairs if p or q), default=0.0)


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _compared(text: str, own: str, following: str, other: str, powers: Powers) -> tuple:
    changed = edited(text, following).encode()
    print_ = fingerprint(changed, powers)
    return len(text), hashlib.sha256(changed).hexdigest(), own, print_, likeness(own, print_), likeness(own, other)


def with_next(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """RESULT: each text's fingerprint, compared with that of an edited text and of the next document.

    Rows are dealt out by ranges of ids and sorted there, so a text moves once; only the first row
    of each range is looked up for the last row of the range before it. Nulls are empty texts.
    Rows of equal id follow each other in the order of their texts, null ids come first.
    """
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    ranges = source.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").withColumn("part", F.spark_partition_id())
    rows = written(ranges.mapInArrow(_within, f"{RESULT}, part int, first string, last string"), "fingerprints")
    edges = rows.where("first is not null or last is not null").select("part", "doc_id", "first", "last")
    firsts = edges.where("first is not null").select(F.col("part").alias("at"), "first")
    lasts = edges.where("last is not null").select("part", "doc_id", "last")
    parts = sorted(r.at for r in firsts.select("at").collect())  # one number for each range
    after = dict(zip(parts, [*parts[1:], *parts[:1]]))
    if not after:
        return rows.select(*(f.split()[0] for f in RESULT.split(", ")))
    following = F.create_map(*(F.lit(x) for pair in after.items() for x in pair))
    met = lasts.withColumn("at", following[F.col("part")]).join(firsts, "at").select("doc_id", "last", "first")
    rest = met.mapInArrow(_across, RESULT)
    return rows.where("last is null and n_chars is not null").select(*rest.columns).union(rest)


KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def _within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of all rows of a range but the last, which goes on with its text, and the first text."""
    powers, held, part = Powers(), None, None
    names = [f.split()[0] for f in RESULT.split(", ")] + ["part", "first", "last"]
    kinds = [*KINDS, pa.int32(), pa.string(), pa.string()]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    for batch in batches:
        for start in range(0, batch.num_rows, 256):
            rows = []
            for doc_id, text, part in zip(*(c.to_pylist() for c in batch.slice(start, 256).columns)):
                own = fingerprint(text.encode(), powers)
                if held is None:
                    rows.append((None,) * 7 + (part, text, None))
                else:
                    rows.append((held[0], *_compared(held[1], held[2], text, own, powers), None, None, None))
                held = doc_id, text, own
            yield batch_of(rows)
    if held is not None:
        yield batch_of([(held[0], *(None,) * 6, part, None, held[1])])


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    powers = Powers()
    for batch in batches:
        rows = [(d, *_compared(a, fingerprint(a.encode(), powers), b, fingerprint(b.encode(), powers), powers)) for d, a, b in zip(*(c.to_pylist() for c in batch.columns))]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 7, KINDS)], names=[f.split()[0] for f in RESULT.split(", ")])
