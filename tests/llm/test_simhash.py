import random

import numpy as np
import pytest
import xxhash

from tallyspark.llm import simhash
from tallyspark.llm.components import components


def brute_components(fps, distance=4):
    codes = np.array(fps, np.int64).view(np.uint64)

    def links():
        for i in range(len(codes)):
            j = np.flatnonzero(np.bitwise_count(codes[i + 1 :] ^ codes[i]) <= distance) + i + 1
            if len(j):
                yield np.full(len(j), i), j

    return simhash.forest(len(codes), links())


def groups(pairs):
    out = {}
    for node, root in pairs:
        out.setdefault(root, set()).add(node)
    return sorted(tuple(sorted(g)) for g in out.values() if len(g) > 1)


def brute_fingerprint(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({ord(c): " " for c in "\t\n\v\f\r"}).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("max_group", [4096, 7])
def test_links_lose_no_component(spark, max_group):
    rng = random.Random(3)
    fps = set()
    for i in range(300):
        base = rng.getrandbits(64)
        fps.add(base)
        for _ in range(30 if i < 40 else 0):
            near = base
            for _ in range(rng.randint(1, 6)):
                near ^= 1 << rng.randrange(64)
            fps.add(near)
    fps = [simhash.signed(x) for x in fps]
    label = brute_components(fps)
    df = spark.createDataFrame([(x,) for x in fps], "fp long")
    got = components(simhash.fingerprint_links(df, 4, max_group)).collect()
    assert groups((r.node, r.root) for r in got) == groups((fps[i], int(k)) for i, k in enumerate(label))


@pytest.mark.parametrize("count", [0, 2, 10**4, 10**6, 10**9, 10**12])
def test_tables_meet_all_close_pairs(count):
    """Whatever four bits differ, one mask has none of them."""
    masks = simhash.tables(count, 4)
    rng = random.Random(count)
    for _ in range(300):
        differ = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(not m & differ for m in masks)
    assert all(m.bit_count() >= min(32, np.log2(max(2, count))) - 1 for m in masks)


def test_index_finds_what_brute_force_finds():
    rng = np.random.default_rng(1)
    codes = np.unique(rng.integers(0, 2**64, 400, dtype=np.uint64) & np.uint64(0xFFF0000000000FFF))
    group = np.sort(rng.integers(0, 5, len(codes)))
    order = np.lexsort((simhash.gray_rank(codes), group))
    codes, group = codes[order], group[order]
    got = {(int(a), int(b)) for x, y in simhash.GrayIndex(codes, group).links(group, 4) for a, b in zip(x, y)}
    want = {(i, j) for i in range(len(codes)) for j in range(i + 1, len(codes)) if group[i] == group[j] and (int(codes[i]) ^ int(codes[j])).bit_count() <= 4}
    assert got == want and want


@pytest.mark.parametrize("words", [1, 8])
def test_wide_index_links_what_brute_force_links(words):
    """Codes of one and of eight longs, in groups with near copies: the forest has each link within the distance."""
    rng = np.random.default_rng(words)
    base = rng.integers(0, 2**64, (60, words), dtype=np.uint64)
    flips = lambda n: np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (n, words, 2), dtype=np.uint64), axis=2)
    codes = np.concatenate([base, *(base[:20] ^ flips(20) for _ in range(20))])
    group = np.sort(rng.integers(0, 3, len(codes)))
    order = simhash.gray_order(codes, group)
    codes, group = codes[order], group[order]
    limit = 2.5 * words
    differ = np.bitwise_count(codes[:, None] ^ codes[None]).sum(axis=2)
    met = (differ <= limit) & (group[:, None] == group[None]) & ~np.eye(len(codes), dtype=bool)
    want = simhash.forest(len(codes), iter([np.nonzero(np.triu(met))]))
    index = simhash.GrayIndex(codes, group)
    assert index.forest(limit).tolist() == want.tolist() and len(set(want)) < len(want)
    assert {(int(a), int(b)) for x, y in index.links(group, limit) for a, b in zip(x, y)} == set(zip(*map(lambda c: c.tolist(), np.nonzero(np.triu(met)))))


def test_similar_documents_go_through_the_index(documents, monkeypatch):
    """Fingerprint links propose by themselves, and sketches of a cell are searched in the index."""
    import pyarrow as pa

    text = " ".join(f"w{i}" for i in range(400))
    docs = documents([text, text + " more", "other " * 60])
    with monkeypatch.context() as m:
        m.setattr(simhash, "dealt_cells", lambda keyed, sizes, own, f=simhash.dealt_cells: f(keyed, sizes, own) if own != ["text"] or "n" in keyed.columns else f(keyed, sizes, own).limit(0))
        rows = {r.doc_id: r.component_id for r in simhash.similar_documents(docs).collect()}
    assert rows == {0: 0, 1: 0, 2: 2}
    asked = []
    monkeypatch.setattr(simhash.GrayIndex, "forest", lambda self, distance, f=simhash.GrayIndex.forest: asked.append(self.codes.shape) or f(self, distance))
    values = [simhash.sketch(t) for t in (text, text + " more")]
    columns = [[7, 7], *([v[2 + k] for v in values] for k in range(simhash.SKETCH)), [v[0] for v in values]]
    batch = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[f"c{i}" for i in range(len(columns))])
    edges = [e for b in simhash._maybe_similar(iter([batch]), 145.0) for e in b.to_pylist()]
    assert asked == [(2, simhash.SKETCH)] and len(edges) == 1


def test_gray_rank_is_the_inverse_of_the_gray_code():
    x = np.arange(1000, dtype=np.uint64)
    assert (simhash.gray_rank(x ^ (x >> np.uint64(1))) == x).all()


def test_documents_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = simhash.near_duplicates(docs).collect()
    assert all(simhash.signed(brute_fingerprint(texts[r.doc_id])) == r.fp for r in rows if r.doc_id < 300)
    label = brute_components([r.fp for r in rows])
    least = {}
    for r, k in zip(rows, label):
        least[k] = min(least.get(k, r.doc_id), r.doc_id)
    assert all(least[k] == r.component_id for r, k in zip(rows, label))
    kept = {r.doc_id for r in simhash.first_of_each(docs, simhash.near_duplicates(docs)).collect()}
    assert kept == set(least.values())


def test_odd_rows(odd):
    rows = simhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    empty = {r.component_id for r in rows if r.fp == 0}
    assert empty == {1}  # null, empty and blank texts are one component
    kept = simhash.first_of_each(odd, simhash.near_duplicates(odd))
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(set(ids) - {None}) and ids.count(None) == 2
    assert simhash.near_duplicates(odd.limit(0)).collect() == []
    similar = simhash.similar_documents(odd).collect()
    assert len(similar) == len(rows) and {r.component_id for r in similar if r.doc_id in (1, 2, 5)} == {1}
    assert simhash.similar_documents(odd.limit(0)).collect() == []


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def test_similar_documents_find_near_copies_and_leave_others(documents):
    """Copies with a few words replaced; a passage in common is not similarity."""
    rng = random.Random(12)
    word = lambda: "".join(rng.choice("abcdefghijk") for _ in range(rng.randint(3, 9)))
    base = [[word() for _ in range(rng.randint(60, 400))] for _ in range(120)]
    passage = [word() for _ in range(40)]
    texts = [" ".join(w[:30] + passage + w[30:]) for w in base]
    near = []
    for w in base[:80]:
        copy = w[:30] + passage + w[30:]
        for i in range(10, len(copy), 60):
            copy[i] = word()
        near.append(" ".join(copy).upper() if len(copy) % 2 else " ".join(copy))
    rows = {r.doc_id: r.component_id for r in simhash.similar_documents(documents(texts + near + texts[:5])).collect()}
    pairs = [i for i in range(80) if jaccard(shingles(texts[i]), shingles(near[i])) >= 0.8]
    assert len(pairs) > 60
    assert sum(rows[120 + i] == i for i in pairs) >= 0.9 * len(pairs)
    assert all(rows[i] == i for i in range(120)) and all(rows[200 + i] == i for i in range(5))


def test_recall_on_the_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    sets = {r.doc_id: shingles(r.text) for r in docs.collect()}
    place = {r.doc_id: r.component_id for r in simhash.similar_documents(docs).collect()}
    holders = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    met = {(a, b) for ids in holders.values() for k, a in enumerate(ids) for b in ids[k + 1 :]}
    close = [(a, b) for a, b in met if jaccard(sets[a], sets[b]) >= 0.8]
    assert len(close) > 50 and sum(place[a] == place[b] for a, b in close) >= 0.95 * len(close)
    alone = set(sets) - {i for a, b in met if jaccard(sets[a], sets[b]) >= 0.5 for i in (a, b)}
    assert all(place[i] == i for i in alone)


def brute_similar(texts):
    sets = [shingles(t) for t in texts]
    links = ((np.array([i]), np.array([j])) for i in range(len(sets)) for j in range(i + 1, len(sets)) if jaccard(sets[i], sets[j]) >= 0.8)
    return simhash.forest(len(sets), links)


def edited(rng, word, words, share, kind):
    """One block of the words replaced, appended or cut."""
    n = round(len(words) * share)
    at = rng.randint(0, len(words) - n)
    return {"replace": words[:at] + [word() for _ in range(n)] + words[at + n :], "append": words + [word() for _ in range(n)], "cut": words[:at] + words[at + n :]}[kind]


@pytest.fixture(scope="module")
def blocks():
    """Texts, and for each one copy with a block edit, on both sides of the limit."""
    rng = random.Random(21)
    word = lambda: "".join(rng.choice("abcdefghijk") for _ in range(rng.randint(3, 9)))
    base = [[word() for _ in range(rng.randint(60, 400))] for _ in range(400)]
    near = [edited(rng, word, w, rng.uniform(0.05, 0.24 if i % 3 else 0.14), ("replace", "append", "cut")[i % 3]) for i, w in enumerate(base)]
    return [" ".join(w) for w in base + near]


def test_block_edits_equal_brute_force(documents, blocks):
    """Pairs from the limit on are found whatever the edit's shape."""
    want = brute_similar(blocks)
    rows = {r.doc_id: r.component_id for r in simhash.similar_documents(documents(blocks)).collect()}
    linked = sum(int(want[400 + i]) == i for i in range(400))
    assert 200 < linked < 400
    missed = [i for i in range(800) if rows[i] != want[i] and rows[i] == i]
    assert not missed


def test_pairs_under_the_limit_stay(documents, blocks):
    want = brute_similar(blocks)
    rows = {r.doc_id: r.component_id for r in simhash.similar_documents(documents(blocks)).collect()}
    assert not [i for i in range(800) if rows[i] != want[i] and rows[i] != i]


@pytest.mark.parametrize("max_group", [4096, 5])
def test_close_variants_hide_no_partner(documents, max_group):
    """Groups of variants that differ in a word, and two such groups about 0.85 apart: each is one component."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijk") for _ in range(rng.randint(3, 9)))
    texts = []
    for _ in range(15):
        a = [word() for _ in range(1000)]
        b = a[:460] + [word() for _ in range(76)] + a[536:]
        for w in (a, b):
            texts += [" ".join([*w[:k], word(), *w[k + 1 :]]) for k in (0, 1, 2, 999)]
    want = brute_similar(texts)
    assert set(want) == set(range(0, 120, 8))
    rows = {r.doc_id: r.component_id for r in simhash.similar_documents(documents(texts), max_group=max_group).collect()}
    assert [rows[i] for i in range(120)] == want.tolist()


def test_keys_meet_as_many_as_they_say():
    count = simhash.keys_needed(0.8, 1e-5)
    rng = np.random.default_rng(4)
    shared = []
    for _ in range(300):
        x = rng.integers(0, 2**64, 270, dtype=np.uint64)
        a, b = (simhash.least_keys(np.unique(y), count) for y in (x[:243], x[27:]))  # 216 of 270
        shared.append((a == b).sum())
    assert min(shared) > 0 and abs(np.mean(shared) / count - 0.8**simhash.LEAST) < 0.02


@pytest.mark.parametrize("count", [10, 10**5, 10**8])
def test_random_tables_meet_as_many_as_they_say(count):
    masks = simhash.random_tables(count, 8, 0.97)
    rng = random.Random(count)
    differ = [sum(1 << b for b in rng.sample(range(64), 8)) for _ in range(1000)]
    assert sum(any(not m & d for m in masks) for d in differ) > 950


def test_fingerprints_by_the_letter():
    for text in (None, "", " \t", "One", "one two THREE", "É é İ ſ K a b c d e", "a\x1cb c\xa0d e f g"):
        assert simhash.signed(brute_fingerprint(text)) == simhash.fingerprint(text)[0]
