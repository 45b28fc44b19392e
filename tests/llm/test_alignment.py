import bisect
import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from tallyspark.llm import alignment
from tallyspark.llm.queries import op12_alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def both():
    return alignment.Tokenizers(A, B)


def whole(both, text):
    """Ids by the libraries, each text in one go."""
    if not text:
        return [], []
    a, b = both.a.encode(" " + text, add_special_tokens=False).ids, both.b.encode(text)
    raw = (" " + text).encode()
    same = b"".join(both.bytes_a[i] for i in a) == raw and b"".join(both.bytes_b[i] for i in b) == raw
    return (a, b) if same else ([], [])


def spans(ids, lengths):
    out, at = [], 0
    for i in ids:
        out.append((at, at + lengths[i]))
        at += lengths[i]
    return out


def brute(both, rows):
    """Every A token against every B token that is not before it."""
    texts, per_doc, counts = [], [], Counter()
    length_a, length_b = both.length_a.tolist(), both.length_b.tolist()
    for _, text in rows:
        a, b = whole(both, text)
        in_a, in_b = spans(a, length_a), spans(b, length_b)
        start, found = 0, []
        for (s, e), i in zip(in_a, a):
            while start < len(in_b) and in_b[start][1] <= s:
                start += 1
            for (u, v), j in zip(in_b[start : start + 200], b[start : start + 200]):
                if u >= e:
                    break
                found.append((i, j))
        cuts = sorted({e for _, e in in_a} & {e for _, e in in_b})
        groups = [([], []) for _ in cuts]
        for side, (ids, places) in enumerate(((a, in_a), (b, in_b))):
            for i, (_, e) in zip(ids, places):
                groups[bisect.bisect_left(cuts, e)][side].append(str(i))
        counts.update(found)
        per_doc.append((a, b, cuts, found))
        texts.append(";".join("|".join(map(",".join, g)) for g in groups))
    highest = Counter()
    for (_, j), n in counts.items():
        highest[j] = max(highest[j], n)
    return sorted(
        (
            (doc_id, len(a), len(b), len(cuts), len(found), sum(counts[p] == highest[p[1]] for p in found), sum(counts[p] for p in found), hashlib.sha256(t.encode()).hexdigest() if len(a) else "")
            for (doc_id, _), (a, b, cuts, found), t in zip(rows, per_doc, texts)
        ),
        key=str,
    )


def got(df):
    return sorted(map(tuple, df.select(*alignment.RESULT).collect()), key=str)


def test_crossings_equal_a_merge():
    rng = random.Random(3)
    for _ in range(200):
        a, b = (np.unique(rng.choices(range(1, 40), k=rng.randint(1, 25))) for _ in range(2))
        merged = sorted([(x, 0) for x in a] + [(x, 1) for x in b])
        diagonals = np.arange(len(merged) + 1)
        assert alignment.crossings(a, b, diagonals).tolist() == [sum(side == 0 for _, side in merged[:d]) for d in diagonals]


def test_pieces_of_any_size_give_the_same_links():
    rng = random.Random(6)
    for _ in range(200):
        a, b = (np.unique([*rng.choices(range(1, 60), k=rng.randint(1, 40)), 60]) for _ in range(2))
        ends = np.union1d(a, b)
        want = [np.searchsorted(a, ends).tolist(), np.searchsorted(b, ends).tolist(), np.isin(ends, np.intersect1d(a, b)).tolist()]
        for piece in (1, 2, 3, 7, 1000):
            assert [x.tolist() for x in alignment.links(a, b, piece)] == want


def test_remembered_words_give_the_ids_of_the_whole_text(both, monkeypatch):
    monkeypatch.setattr(alignment, "REMEMBERED", 8)
    rng = random.Random(1)
    parts = ["a", "The", "é", " ", "  ", "\n", "\t", "1", "12", "_", ".", "'s", "中", "\u3000", "\x85", "\x1c", "\u180e", "▁", "😀", "don't", "ﬁ", "\u0301", "<s>"]
    for _ in range(60):
        texts = ["".join(rng.choices(parts, k=rng.randint(0, 12))) for _ in range(30)]
        assert [(a.tolist(), b.tolist()) for a, b in both.encode(texts)] == [whole(both, t) for t in texts]


ODD = ["", None, " ", "a", "<s> </s> <|endoftext|> <0x41> <unk>", "▁ under ▁", "ünï cödé 😀 𝔘 \x00 \x1c end", "日本語のテキスト and more", "x" * 5000, " \t\n  two  spaces \r\n", "é � ​"]


@pytest.mark.parametrize("block_bytes,piece", [(1, 1), (300, 5), (1 << 24, 1 << 16)])
def test_equal_to_brute_force(spark, both, documents, block_bytes, piece):
    rng = random.Random(9)
    words = ["the", "tokenization", "of", "unbelievable", "straße", "naïve", "中文", "2024", "foo_bar", "\n", "😀", "<s>"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randint(1, 40)))) for i in range(60)]
    rows += [(100 + i, t) for i, t in enumerate(ODD)] + [(None, "an id is missing"), (7, "an id twice"), (7, "an id twice")]
    found = alignment.aligned(documents(rows, block="x", own="x", pairs="x", a="x", b="x", n="x"), A, B, block_bytes=block_bytes, piece=piece)
    want = brute(both, rows)
    assert got(found) == want
    assert sum(r[1] == 0 for r in want) >= 2 and ("" in {r[-1] for r in want})


def test_the_given_table_equals_brute_force(spark, both):
    sf_dir = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    assert got(op12_alignment(spark, sf_dir)) == brute(both, rows)


def test_odd_rows(odd):
    found = alignment.aligned(odd, A, B)
    assert found.count() == odd.count()
    assert alignment.aligned(odd.limit(0), A, B).collect() == []
