import hashlib
import itertools
import math
import random

import duckdb
import numpy as np
import pytest

from tallyspark.llm import centroids
from tallyspark.llm.queries import ORACLES, op13_centroids


def brute(rows, k=16, rounds=3, size=64):
    """Every centroid against every vector, in Python integers."""
    kept = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    places = [q for _, q in first]

    def nearest(q):
        return min((sum((a - b) ** 2 for a, b in zip(q, c)), n) for n, c in enumerate(places))

    for _ in range(rounds):
        owners = [nearest(q)[1] for _, q in kept]
        for n in range(len(places)):
            own = [q for (_, q), o in zip(kept, owners) if o == n]
            if own:
                places[n] = [sum(c) // len(own) for c in zip(*own)]
    last = [(i, *nearest(q)) for i, q in kept]
    inertia = [sum(d for _, d, n in last if n == c) for c in range(len(places))]
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in places]
    return sorted(((i, n, d, inertia[n], sum(inertia), digest[n]) for i, d, n in last), key=str)


def vectors(spark, rows, **extra):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    from pyspark.sql import functions as F

    return df.withColumns({k: F.lit(v) for k, v in extra.items()})


def got(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_hilbert_neighbours_differ_in_one_component_by_one():
    for dims, bits in ((2, 3), (3, 2), (4, 2)):
        points = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        keys = centroids.hilbert_keys(points, bits)
        assert len(set(keys)) == len(points)
        path = points[np.argsort(keys)]
        assert (np.abs(np.diff(path, axis=0)).sum(1) == 1).all()


def test_candidates_keep_every_nearest_centroid():
    rng = np.random.default_rng(5)
    pruned = 0
    for _ in range(300):
        places = rng.integers(-6, 7, (8, 3))
        points = rng.integers(-9, 10, 3) + rng.integers(0, 4, (20, 3))
        low, high = points.min(0), points.max(0)
        cluster, distance, tried = centroids.assigned(points, low, high, places)
        every = np.square(points[:, None, :] - places[None]).sum(2)
        assert (cluster == every.argmin(1)).all() and (distance == every.min(1)).all()
        pruned += 8 - tried
    assert pruned > 300


@pytest.mark.parametrize("seed", [1, 2])
def test_equal_to_brute_force(spark, seed):
    rng = random.Random(seed)
    middles = [[rng.gauss(0, 0.3) for _ in range(64)] for _ in range(9)]
    rows = [(i, [float(np.float32(m + rng.gauss(0, 0.1))) for m in rng.choice(middles)]) for i in range(300)]
    rows += [(1000 + i, rows[7][1]) for i in range(150)]  # one vector a third of all rows
    assert got(centroids.clustered(vectors(spark, rows), block=16)) == brute(rows)


def test_the_given_table_equals_brute_force(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    assert got(op13_centroids(spark, sf_dir)) == brute(rows)


def test_sql_equals_brute_force(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW embeddings AS SELECT * FROM '/root/testdata/sf0.001/embeddings.parquet'")
    rows = con.execute("SELECT vec_id, embedding FROM embeddings").fetchall()
    columns = "vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256"
    assert sorted(con.execute(f"SELECT {columns} FROM ({ORACLES['op13_centroids']})").fetchall(), key=str) == brute(rows)


def test_odd_vectors(spark):
    one = [0.5] * 64
    bad = [None, [], [1.0] * 63, [1.0] * 65, [None, *one[1:]], [float("nan"), *one[1:]], [float("inf"), *one[1:]], [*one[1:], float("-inf")]]
    rows = [(i, v) for i, v in enumerate(bad)] + [(20, one), (20, one), (None, one), (None, [-0.01] * 64), (21, [-0.0] * 64)]
    clashing = {k: "x" for k in ("id", "q", "salt", "place", "ids", "points", "low", "high", "cluster", "distance", "v", "h")}
    df = vectors(spark, rows, **clashing)
    assert got(centroids.clustered(df)) == brute(rows)
    assert got(centroids.clustered(df.limit(0))) == []
    assert got(centroids.clustered(df.where("vec_id < 8"))) == []
    assert centroids.clustered(df.limit(0)).dtypes == centroids.clustered(df).dtypes


def test_very_large_components_are_held(spark):
    rows = [(i, [(-1.0) ** i * 10.0**i] * 64) for i in range(0, 38, 3)]
    found = {r.vec_id: r for r in centroids.clustered(vectors(spark, rows)).collect()}
    assert len(found) == len(rows) and all(0 <= r.distance < 1 << 63 and r.cluster_inertia >= 0 for r in found.values())
