import random
from collections import Counter

import pytest

from tallyspark.llm import packing

ITEMS = "doc_id long, size long, cluster string, source string"


def brute(rows, capacity, per_source):
    """Best fit by trying every bin."""
    pieces, bins, out = [], [], []
    for row in sorted(rows, key=lambda r: r[0]):
        whole, rest = divmod(row[1], capacity)
        if whole and not rest:
            whole, rest = whole - 1, capacity
        pieces.append((rest, whole, row))
    for size, piece, row in sorted(pieces, key=lambda p: -p[0]):
        fits = [
            (capacity - sum(s for s, _ in b), i)
            for i, b in enumerate(bins)
            if capacity - sum(s for s, _ in b) >= size
            and all(row[2] is None or r[2] != row[2] for _, r in b)
            and (row[3] is None or sum(r[3] == row[3] for _, r in b) < per_source)
        ]
        full = [f for f in fits if f[0] == 0]
        fits = [f for f in fits if f not in full]  # a full bin takes nothing, not even an empty piece
        i = min(fits)[1] if fits else len(bins)
        if not fits:
            bins.append([])
        out.append((row[0], piece, size, i, len(bins[i]), sum(s for s, _ in bins[i])))
        bins[i].append((size, row))
    return sorted(out)


@pytest.mark.parametrize("seed, per_source", [(1, 1), (2, 2), (3, 4)])
def test_shards_equal_brute_force(seed, per_source):
    rng = random.Random(seed)
    rows = [(i, rng.choice([0, 1, 5, 17, 40, 99, 100, 101, 250]), rng.choice([None, "a", "b", str(i)]), rng.choice(["hot", "hot", "s", "t", None])) for i in range(300)]
    got = packing.packed_shard(rows, 100, per_source)
    assert sorted(r for r in got if not str(r[3]).startswith("full")) == brute(rows, 100, per_source)


def test_constraints_hold_over_shards(spark):
    rng = random.Random(9)
    rows = [(i, rng.randint(0, 300), f"c{rng.randint(0, 400)}", "hot" if i % 3 else f"s{i % 11}") for i in range(3000)]
    got = packing.packed(spark.createDataFrame(rows, ITEMS), capacity=120, per_source=2, shard_rows=500).collect()
    by_id = {r[0]: r for r in rows}
    tokens, bins = Counter(), {}
    for r in got:
        tokens[r.doc_id] += r.n_tokens
        bins.setdefault(r.bin_id, []).append(r)
    assert tokens == {r[0]: r[1] for r in rows}
    for pieces in bins.values():
        pieces.sort(key=lambda p: p.position)
        assert [p.position for p in pieces] == list(range(len(pieces)))
        assert [p.offset for p in pieces] == [sum(q.n_tokens for q in pieces[:i]) for i in range(len(pieces))]
        assert sum(p.n_tokens for p in pieces) <= 120
        assert max(Counter(by_id[p.doc_id][2] for p in pieces).values()) == 1
        assert max(Counter(by_id[p.doc_id][3] for p in pieces).values()) <= 2


def test_odd_rows(odd, spark):
    rows = packing.packed(packing.text_items(odd)).collect()
    assert sum(r.n_tokens for r in rows) == sum(len((r.text or "").replace("\x1c", "x").encode().split()) for r in odd.collect())
    assert packing.packed(spark.createDataFrame([], ITEMS)).collect() == []
    nulls = packing.packed(spark.createDataFrame([(None, None, None, None)] * 3, ITEMS)).collect()
    assert [(r.doc_id, r.n_tokens) for r in nulls] == [(None, 0)] * 3
    with pytest.raises(ValueError):
        packing.packed(spark.createDataFrame([], ITEMS), capacity=0)


def test_equal_rows_without_an_id_are_spread(spark):
    rows = [(None, 7, "same", "hot")] * 2000 + [(i, 7, None, None) for i in range(1000)]
    got = packing.packed(spark.createDataFrame(rows, ITEMS), capacity=70, shard_rows=300).collect()
    assert len(got) == len(rows) and all(r.n_tokens == 7 for r in got)
    held = Counter(r.bin_id.split("-")[0] for r in got if r.doc_id is None)
    assert len(held) == 10 and max(held.values()) < 400
    bins = Counter(r.bin_id for r in got if r.doc_id is None)
    assert max(bins.values()) == 1  # one cluster, so a bin for each


def test_sizes_below_zero_count_as_zero(spark):
    got = packing.packed(spark.createDataFrame([(1, -5, None, None), (2, None, None, None)], ITEMS)).collect()
    assert sorted((r.doc_id, r.piece, r.n_tokens) for r in got) == [(1, 0, 0), (2, 0, 0)]
