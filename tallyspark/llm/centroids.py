"""Centroid clustering over zone maps along a Hilbert curve.

Vectors are sorted by their place on a Hilbert curve and cut into blocks of neighbours; each block
carries the least and greatest value of every component. For a block, the distances from its box to
the centroids bound which of them can be nearest to any vector inside; only those candidates are
compared with the vectors, exactly and in whole arrays. All arithmetic is on integers.

The blocks are written once and read in each round. A round returns, from each task, one row of sums
for each centroid; the sums are added by Spark, and what reaches the driver is one row for each
centroid. Equal vectors have one place on the curve, so a hash of the row spreads them over tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import written

#: Components of a vector that is kept.
SIZE = 64
#: Integers of a component: 64 to the unit.
SCALE = 64
#: Integers beyond this are taken as this, so that a squared distance fits a long.
LARGEST = 1 << 27
#: Bits of each component that the curve sees.
CURVE_BITS = 4
#: Vectors of a block.
BLOCK = 128


def usable(vector: Column, size: int = SIZE) -> Column:
    """Whether a vector has ``size`` components, all of them finite numbers; false where it is null."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) == size) & finite, F.lit(False))


def integers(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component, x as double."""
    return F.transform(vector, lambda x: F.greatest(F.least(F.floor(F.least(F.greatest(x.cast("double") * scale, F.lit(-1e18)), F.lit(1e18))), F.lit(LARGEST)), F.lit(-LARGEST)).cast("int"))


def hilbert_keys(points: np.ndarray, bits: int = CURVE_BITS) -> list[bytes]:
    """Place on the Hilbert curve of each row of integers in [0, 2^bits), as bytes that sort like it.

    Bits are taken from the highest down; each level undoes the turns and reflections of the cells
    it lies in, by exchanging or inverting the lower bits of the first component.
    """
    x = points.astype(np.uint32).T.copy()
    dims = len(x)
    level = 1 << (bits - 1)
    while level > 1:
        low = np.uint32(level - 1)
        for i in range(dims):
            inverted = (x[i] & level) != 0
            swapped = np.where(inverted, 0, (x[0] ^ x[i]) & low).astype(np.uint32)
            x[0] ^= np.where(inverted, low, swapped)
            x[i] ^= swapped
        level >>= 1
    for i in range(1, dims):  # Gray code over the components
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    level = 1 << (bits - 1)
    while level > 1:
        turn ^= np.where((x[-1] & level) != 0, np.uint32(level - 1), np.uint32(0))
        level >>= 1
    x ^= turn
    planes = [(x >> b) & 1 for b in range(bits - 1, -1, -1)]
    packed = np.packbits(np.concatenate(planes).astype(np.uint8).T, axis=1)
    return [row.tobytes() for row in packed]


def _with_keys(vectors: DataFrame, size: int, low: int, high: int) -> DataFrame:
    """Adds the place on the curve; components between ``low`` and ``high`` are spread over its cells."""
    span = max(high - low + 1, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            points = np.asarray(batch.column("q").flatten(), np.int64).reshape(-1, size)
            cells = np.clip((points - low) * (1 << CURVE_BITS) // span, 0, (1 << CURVE_BITS) - 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hilbert_keys(cells), pa.binary())], names=["id", "q", "salt", "place"])

    return vectors.mapInArrow(run, "id long, q array<int>, salt long, place binary")


def blocks(vectors: DataFrame, size: int = SIZE, block: int = BLOCK) -> DataFrame:
    """Blocks of neighbours on the curve from rows (id, q): ids, the matrix of integers, and the box (low, high).

    Every row lies in one block; equal rows are rows of their own. No row gives no block.
    """
    spread = vectors.agg(F.min(F.array_min("q")).alias("low"), F.max(F.array_max("q")).alias("high")).first()
    salted = vectors.select("id", "q", F.xxhash64("id", F.monotonically_increasing_id()).alias("salt"))
    keyed = written(_with_keys(salted, size, spread.low or 0, spread.high or 0), "places")
    ordered = keyed.repartitionByRange("place", "salt").sortWithinPartitions("place", "salt").select("id", "q")

    def row(ids: list[pa.Array], points: list[np.ndarray]) -> pa.RecordBatch:
        matrix = np.concatenate(points)
        columns = [[pa.concat_arrays(ids).to_pylist()], [matrix.astype("<i4").tobytes()], [matrix.min(0).tolist()], [matrix.max(0).tolist()]]
        kinds = [pa.list_(pa.int64()), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32())]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["ids", "points", "low", "high"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, points, held = [], [], 0
        for batch in batches:
            matrix, at = np.asarray(batch.column("q").flatten(), np.int64).reshape(-1, size), 0
            while at < len(matrix):
                taken = min(block - held, len(matrix) - at)
                ids.append(batch.column("id").slice(at, taken).cast(pa.int64()))
                points.append(matrix[at : at + taken])
                at, held = at + taken, held + taken
                if held == block:
                    yield row(ids, points)
                    ids, points, held = [], [], 0
        if held:
            yield row(ids, points)

    return written(ordered.mapInArrow(run, "ids array<long>, points binary, low array<int>, high array<int>"), "blocks")


def candidates(low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Numbers of the centroids that can be nearest to a point of the box, or tie there.

    First by distance from the box: a centroid whose nearest point of the box is farther than some
    other's farthest one is out. Then by pairs: one is out if another is nearer in the whole box,
    which the corner that favours it most decides, as the difference of squared distances is linear.
    """
    below, above = low - centroids, centroids - high
    near = np.square(np.maximum(np.maximum(below, above), 0)).sum(1)
    far = np.square(np.maximum(np.abs(below), np.abs(above))).sum(1)
    left = np.flatnonzero(near <= far.min())
    if len(left) > 1:
        c = centroids[left]
        norms = np.square(c).sum(1)
        slope = 2 * (c[:, None, :] - c[None, :, :])  # of distance to other (second) less distance to own (first)
        lead = norms[None, :] - norms[:, None] + np.maximum(slope * low, slope * high).sum(2)
        left = left[(lead >= 0).all(1)]
    return left


def assigned(points: np.ndarray, low: np.ndarray, high: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(nearest centroid, squared distance) of each row, and how many centroids were compared; ties go to the smaller number."""
    left = candidates(low, high, centroids)
    distance = np.stack([np.square(points - centroids[c]).sum(1) for c in left], 1)
    best = distance.argmin(1)
    return left[best], distance[np.arange(len(points)), best], len(left)


def _decoded(batch: pa.RecordBatch, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for points, low, high in zip(batch.column("points"), batch.column("low"), batch.column("high")):
        yield np.frombuffer(points.as_py(), "<i4").astype(np.int64).reshape(-1, size), np.asarray(low.as_py(), np.int64), np.asarray(high.as_py(), np.int64)


def round_sums(table: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """(cluster, members, sums of the components, compared) after assigning all vectors: a row for each centroid that has any."""
    size, places = len(centroids[0]), np.asarray(centroids, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums, compared = np.zeros(len(places), np.int64), np.zeros(places.shape, np.int64), np.zeros(len(places), np.int64)
        for batch in batches:
            for points, low, high in _decoded(batch, size):
                cluster, _, tried = assigned(points, low, high, places)
                for c in np.unique(cluster):
                    own = points[cluster == c]
                    counts[c] += len(own)
                    sums[c] += own.sum(0)
                    compared[c] += tried * len(own)
        found = np.flatnonzero(counts)
        columns = [pa.array(found, pa.int32()), pa.array(counts[found]), pa.array(sums[found].tolist(), pa.list_(pa.int64())), pa.array(compared[found])]
        yield pa.RecordBatch.from_arrays(columns, names=["cluster", "members", "sums", "compared"])

    parts = table.select("points", "low", "high").mapInArrow(run, "cluster int, members long, sums array<long>, compared long")
    whole = [F.sum(F.col("sums")[i].cast("decimal(38,0)")) for i in range(size)]
    return parts.groupBy("cluster").agg(F.sum("members").alias("members"), F.array(*whole).alias("sums"), F.sum("compared").alias("compared"))


def moved(table: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The centroids after a round: the floor of the mean of their vectors, or the old place where there is none."""
    after = [list(c) for c in centroids]
    for r in round_sums(table, centroids).collect():  # at most one row for each centroid
        after[r.cluster] = [int(s) // r.members for s in r.sums]
    return after


def placed(table: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """(id, cluster, distance) of every vector of the blocks."""
    size, places = len(centroids[0]), np.asarray(centroids, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, (points, low, high) in zip(batch.column("ids"), _decoded(batch, size)):
                cluster, distance, _ = assigned(points, low, high, places)
                yield pa.RecordBatch.from_arrays([pa.array(ids.as_py(), pa.int64()), pa.array(cluster, pa.int32()), pa.array(distance)], names=["id", "cluster", "distance"])

    return table.select("ids", "points", "low", "high").mapInArrow(run, "id long, cluster int, distance long")


def starts(vectors: DataFrame, k: int) -> list[list[int]]:
    """The ``k`` vectors whose ids have the smallest SHA-256 of ``1:<id>``; null ids come last, equal ids by components."""
    digest = F.sha2(F.concat(F.lit("1:"), F.col("id").cast("string")), 256)
    first = vectors.select(digest.alias("h"), "q").orderBy(F.col("h").asc_nulls_last(), "q").limit(k)
    return [list(r.q) for r in first.collect()]


def clustered(
    docs: DataFrame, id_column: str = "vec_id", vector: str = "embedding", *, k: int = 16, rounds: int = 3, size: int = SIZE, scale: int = SCALE, block: int = BLOCK
) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that is kept.

    Kept are vectors of ``size`` components, none null, NaN or infinite; others, and null ones, have
    no row. A component is floor(scale * x), held within plus and minus 2^27. Null ids stay null.
    Equal rows are vectors of their own. With fewer than ``k`` vectors there are fewer clusters; a
    table without any gives no row. Other columns are not read.
    """
    source = docs.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.col(f"`{vector}`").alias("v"))
    vectors = source.where(usable(F.col("v"), size)).select("id", integers(F.col("v"), scale).alias("q"))
    centroids = starts(vectors, k)
    if not centroids:
        return vectors.select(F.col("id").alias("vec_id"), *(F.lit(None).cast(t).alias(n) for n, t in RESULT.items()))
    table = blocks(vectors, size, block)
    for _ in range(rounds):
        centroids = moved(table, centroids)
    found = written(placed(table, centroids), "clusters")
    sums = {r.cluster: int(r.s) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    per_cluster = [min(sums.get(c, 0), (1 << 63) - 1) for c in range(len(centroids))]
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    of = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("cluster") + 1)
    return found.select(
        F.col("id").alias("vec_id"),
        "cluster",
        "distance",
        of(per_cluster).cast("long").alias("cluster_inertia"),
        F.lit(min(sum(sums.values()), (1 << 63) - 1)).cast("long").alias("inertia"),
        of(digests).alias("centroid_sha256"),
    )


RESULT = {"cluster": "int", "distance": "long", "cluster_inertia": "long", "inertia": "long", "centroid_sha256": "string"}
