import hashlib
import random

import numpy as np
import pytest

from tallyspark.llm import ctph


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(2, 9))) for _ in range(n))


def slow_rolling(raw):
    out = []
    for i in range(len(raw)):
        window = [0] * max(0, 6 - i) + list(raw[max(0, i - 6) : i + 1])
        mixed = 0
        for c in window:
            mixed = (mixed << 5 ^ c) & 0xFFFFFFFF
        out.append((sum(window) + sum(c * (k + 1) for k, c in enumerate(window)) + mixed) & 0xFFFFFFFF)
    return out


def slow_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, before = [i], row
        for j, y in enumerate(b, 1):
            row.append(before[j - 1] if x == y else 1 + min(before[j], row[j - 1]))
    return row[-1]


def test_rolling_hash_equals_the_loop():
    raw = bytes(np.random.default_rng(3).integers(0, 256, 300, dtype=np.uint8))
    assert ctph.rolling(np.frombuffer(raw, np.uint8)).tolist() == slow_rolling(raw)


def test_edit_distance_equals_the_table():
    rng = random.Random(4)
    for _ in range(300):
        a, b = ("".join(rng.choice("ABC") for _ in range(rng.randint(0, 64))) for _ in range(2))
        assert len(a) + len(b) - 2 * ctph.common_letters(a, b) == slow_distance(a, b)


def test_pieces_end_at_the_content(documents):
    """An insertion changes letters near it only."""
    rng = random.Random(5)
    text = words(rng, 500)
    changed = text[:1500] + "an insertion" + text[1500:]
    a, b = ctph.fingerprint(text.encode()), ctph.fingerprint(changed.encode())
    assert a != b and ctph.likeness(a, b) > 0.9
    assert ctph.likeness(a, ctph.fingerprint(words(rng, 500).encode())) == 0.0


@pytest.mark.parametrize("raw", [b"", b"a", b"ab" * 5, b"a" * 10**6, bytes(range(256)) * 40])
def test_signatures_have_at_most_64_letters(raw):
    print_ = ctph.fingerprint(raw)
    block, one, two = print_.split(":")
    assert len(one) <= 64 and len(two) <= 64 and int(block) * 64 >= min(len(raw), int(block) * 64)
    assert ctph.likeness(print_, print_) == 1.0 and print_ == ctph.fingerprint(bytes(raw))


def test_rows_follow_their_ids_over_ranges(spark, documents):
    rng = random.Random(6)
    texts = {rng.randint(-(10**9), 10**9): words(rng, rng.randint(0, 60)) + "é😀" * rng.randint(0, 3) for _ in range(500)}
    docs = documents(list(texts.items())).repartition(7)
    rows = ctph.with_next(docs).collect()
    assert len(rows) == len(texts)
    order = sorted(texts)
    for r in rows:
        text, after = texts[r.doc_id], texts[order[(order.index(r.doc_id) + 1) % len(order)]]
        half = len(text) // 2
        edit = (text[: len(text) - half] + after[:half]).encode()
        own, other, changed = (ctph.fingerprint(x) for x in (text.encode(), after.encode(), edit))
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edit).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (own, changed)
        assert (r.near_edited, r.near_next) == (ctph.likeness(own, changed), ctph.likeness(own, other))


def test_edited_texts_are_nearer_than_the_next(spark):
    rows = ctph.with_next(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()
    assert sum(r.near_edited > r.near_next for r in rows) > 0.95 * len(rows)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in rows)


def test_odd_rows(odd, documents):
    rows = ctph.with_next(odd).collect()
    assert len(rows) == odd.count()
    assert {(r.n_chars, r.fingerprint) for r in rows if r.doc_id in (1, 2)} == {(0, "3::")}
    assert ctph.with_next(odd.limit(0)).collect() == []
    (alone,) = ctph.with_next(documents(["just one text that follows itself"])).collect()
    assert alone.near_next == 1.0
