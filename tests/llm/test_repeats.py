import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tallyspark.llm import repeats


def brute(texts, length):
    raws = [(t or "").encode() for t in texts]
    counts = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    out = []
    for raw in raws:
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if counts[raw[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        runs = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(raw)))
        out.append((len(raw), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(raw, gone) if not g)).hexdigest()))
    return out


def hard():
    rng = random.Random(1)
    word = lambda n: "".join(rng.choice("ab") for _ in range(n))
    base = word(600)
    texts = [word(rng.randint(0, 500)) for _ in range(20)]
    texts += [base[a : a + rng.randint(10, 400)] + word(40) + base[:90] for a in range(0, 400, 20)]
    texts += ["a" * 300, "ab" * 200, None, "", "é" * 100, base, base]
    return texts + ["x" * k + base[50:130] + word(100) for k in range(30)]


@pytest.mark.parametrize("length, trigger, max_phrases, common, compare", [(40, 8, 20_000, 256, 20_000), (40, 8, 2, 256, 7), (60, 32, 20_000, 256, 50), (40, 8, 3, 3, 7)])
def test_equals_brute_force(documents, monkeypatch, length, trigger, max_phrases, common, compare):
    """Also with triggers that are too common to be gathered, and with small groups."""
    monkeypatch.setattr(repeats, "COMMON", common)
    monkeypatch.setattr(repeats, "COMPARE", compare)
    texts = hard()
    rows = repeats.repeat_digests(documents(texts).repartition(3), length=length, trigger=trigger, max_phrases=max_phrases).collect()
    want = brute(texts, length)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in rows} == dict(enumerate(want))


def test_pieces_of_long_texts(documents, monkeypatch):
    monkeypatch.setattr(repeats, "PIECE", 128)
    monkeypatch.setattr(repeats, "COMBINE", 50)
    texts = hard()
    rows = repeats.repeat_digests(documents(texts), length=40, trigger=8).collect()
    assert {r.doc_id: r[1:] for r in rows} == dict(enumerate(brute(texts, 40)))


def test_given_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    want = dict(zip([r.doc_id for r in rows], brute([r.text for r in rows], 200)))
    assert {r.doc_id: tuple(r[1:]) for r in repeats.repeat_digests(docs).collect()} == want
    kept = {r.doc_id: r.text for r in repeats.without_repeats(docs).collect()}
    assert all(len(kept[i].encode()) <= w[0] - w[1] for i, w in want.items())


def test_rolling_hash_depends_on_the_bytes_alone():
    data = np.random.default_rng(0).integers(0, 3, 500, dtype=np.uint8)
    for size in (1, 5, 8, 31, 32):
        hashes = repeats.rolling_hash(data, size)
        assert len(hashes) == 500 - size + 1
        seen = {}
        for i, h in enumerate(hashes.tolist()):
            assert seen.setdefault(h, data[i : i + size].tobytes()) == data[i : i + size].tobytes()
        assert len(seen) == len({data[i : i + size].tobytes() for i in range(len(hashes))})


def test_phrases_cover_all_strings_and_triggers_follow_the_content():
    data = np.frombuffer(b"".join(bytes([97 + i * i % 7]) for i in range(400)) * 2, np.uint8)
    first, last, at, _ = repeats.phrases(data, 50, 8)
    assert first[0] == 0 and last[-1] == len(data) - 50 and (first[1:] == last[:-1] + 1).all()
    assert (at >= last).all() and (at + 8 <= first + 50).all()
    offset = {int(p): int(t - p) for f, e, t in zip(first, last, at) for p in range(f, e + 1)}
    seen = {}
    for p, d in offset.items():
        assert seen.setdefault(data[p : p + 50].tobytes(), d) == d


def test_odd_rows(odd):
    rows = repeats.repeat_digests(odd, length=24, trigger=8).collect()
    assert len(rows) == odd.count()
    assert sorted((r.n_bytes, r.n_removed) for r in rows if r.doc_id == 4) == [(23, 0), (25, 25), (25, 25)]
    assert {(r.n_bytes, r.n_spans) for r in rows if r.doc_id in (1, 2)} == {(0, 0)}
    kept = repeats.without_repeats(odd, length=24, trigger=8)
    assert kept.columns == [*odd.columns, "cuts"] and kept.count() == odd.count()
    assert {r.text for r in kept.collect() if r.doc_id == 1} == {None}
    assert repeats.repeat_digests(odd.limit(0)).collect() == []


def test_a_character_cut_in_two_goes_whole(documents):
    tail = "z" * 39
    docs = documents(["é" + tail, "é"[:0] + "©" + tail, "\u00e9" + tail + "q"])
    kept = {r.doc_id: r.text for r in repeats.without_repeats(docs, length=40, trigger=8).collect()}
    assert all("\ufffd" not in t for t in kept.values())
