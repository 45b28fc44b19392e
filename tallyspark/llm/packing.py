"""Conflict-constrained best-fit packing of texts into sequences.

Pieces go in descending order into the bin with the smallest sufficient rest whose bitmaps show no
conflict: no two pieces of one duplicate cluster share a bin, and at most ``per_source`` pieces of
one source do (one bitmap for each). Bins are ordered by rest, and the search goes on to the next
larger rest until a bin is compatible; else a new bin opens.

Rows are dealt out by a hash to shards of about ``shard_rows`` rows that are packed on their own;
a source or cluster with a third of all rows is spread over all shards like any other, and rows
without an id are told apart by a number. Each shard leaves at most its last bins half full.
"""

from __future__ import annotations

import bisect
import hashlib
import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import map_rows, written

CAPACITY = 2048
PER_SOURCE = 4
SHARD_ROWS = 5_000
PACKED = "doc_id long, piece int, n_tokens int, bin_id string, position int, offset int"


class Bins:
    """Open bins ordered by rest, then age."""

    def __init__(self, capacity: int, per_source: int) -> None:
        self.capacity, self.per_source = capacity, per_source
        self.order: list[tuple[int, int]] = []
        self.clusters: list[int] = []
        self.sources: list[list[int]] = []
        self.closed: list[int] = []  # sources that all bitmaps of a bin have
        self.held: list[int] = []

    def place(self, size: int, cluster: int, source: int) -> tuple[int, int, int]:
        """(bin, position, offset) of a piece; cluster and source are one-bit masks, or zero if nothing else has them."""
        i = bisect.bisect_left(self.order, (size, -1))
        order, clusters, closed = self.order, self.clusters, self.closed
        while i < len(order) and (clusters[order[i][1]] & cluster or closed[order[i][1]] & source):
            i += 1
        if i < len(self.order):
            rest, chosen = self.order.pop(i)
        else:
            rest, chosen = self.capacity, len(self.held)
            self.clusters.append(0)
            self.sources.append([0] * self.per_source)
            self.closed.append(0)
            self.held.append(0)
        self.clusters[chosen] |= cluster
        for k, bits in enumerate(self.sources[chosen]):
            if not bits & source:
                self.sources[chosen][k] |= source
                if k == self.per_source - 1:
                    self.closed[chosen] |= source
                break
        position = self.held[chosen]
        self.held[chosen] += 1
        if rest > size:
            bisect.insort(self.order, (rest - size, chosen))
        return chosen, position, self.capacity - rest


def masks(values: list) -> dict:
    """A bit for each value that occurs more than once; null conflicts with nothing."""
    return {v: 1 << i for i, v in enumerate(sorted(v for v, n in Counter(values).items() if n > 1 and v is not None))}


def packed_shard(rows: list[tuple], capacity: int, per_source: int) -> list[tuple]:
    """Rows (doc_id, size, cluster, source) of a shard; (doc_id, piece, size, bin, position, offset) of each piece.

    A text beyond the capacity fills bins of its own and its last piece is packed like any other.
    An empty text has one piece of no tokens, which goes where it fits.
    """
    cluster_bits, source_bits = masks([r[2] for r in rows]), masks([r[3] for r in rows])
    bins, out, pieces = Bins(capacity, per_source), [], []
    full = 0
    for row in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1], str(r[2]), str(r[3]))):
        whole, rest = divmod(row[1], capacity)
        if whole and not rest:
            whole, rest = whole - 1, capacity
        for piece in range(whole):
            out.append((row[0], piece, capacity, f"full-{full}", 0, 0))
            full += 1
        pieces.append((rest, whole, row))
    pieces.sort(key=lambda p: -p[0])  # stable: equal sizes stay in the order of ids
    for size, piece, (doc_id, _, cluster, source) in pieces:
        out.append((doc_id, piece, size, *bins.place(size, cluster_bits.get(cluster, 0), source_bits.get(source, 0))))
    return out


def packed(items: DataFrame, *, capacity: int = CAPACITY, per_source: int = PER_SOURCE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """PACKED rows for items (doc_id, size, cluster, source): one for each piece of each row.

    Null and negative sizes count as zero, null clusters and sources conflict with nothing. Equal
    rows are pieces of their own, and share a cluster if it is given.
    """
    if capacity < 1 or per_source < 1:
        raise ValueError("capacity and per_source must be positive")
    source = items.select(F.col("doc_id").cast("long"), F.greatest(F.col("size").cast("long"), F.lit(0)).alias("size"), F.col("cluster").cast("string"), F.col("source").cast("string"))
    # written with the items, so that a repeated task deals its rows as before
    number = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())
    source = written(source.withColumn("number", number), "items")
    shards = max(1, math.ceil(source.count() / shard_rows))
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.int32()]
    names = [f.split()[0] for f in PACKED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, rows = None, []
        for batch in batches:
            for number, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if number != shard:
                    yield placed(shard, rows)
                    shard, rows = number, []
                rows.append(tuple(row))
        yield placed(shard, rows)

    def placed(shard: int | None, rows: list[tuple]) -> pa.RecordBatch:
        out = [(d, p, n, f"{shard}-{b}", at, offset) for d, p, n, b, at, offset in packed_shard(rows, capacity, per_source)]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 6, kinds)], names=names)

    dealt = source.select(F.pmod(F.xxhash64("doc_id", "size", "cluster", "number"), F.lit(shards)).alias("shard"), *source.columns[:4])
    return dealt.repartition("shard").sortWithinPartitions("shard").mapInArrow(run, PACKED)


def item(doc_id: int | None, text: str | None, source: str | None) -> tuple:
    """Words of a text, and as cluster the digest of the words with A-Z lower-cased; none without words."""
    words = (text or "").encode().lower().split()
    return doc_id, len(words), hashlib.md5(b" ".join(words), usedforsecurity=False).hexdigest() if words else None, source


def text_items(docs: DataFrame, id_column: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Items of texts: their words, and a cluster by which copies up to white space and case conflict."""
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text"), F.col(source).cast("string").alias("source"))
    return map_rows(rows, item, ["doc_id", "text", "source"], "doc_id long, size long, cluster string, source string")
