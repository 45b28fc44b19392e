import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from tallyspark.llm import bpe
from tallyspark.llm.queries import vocabulary_path


@pytest.fixture(scope="module")
def theirs():
    return Tokenizer.from_file(vocabulary_path())


@pytest.fixture(scope="module")
def ours():
    return bpe.Bpe(bpe.read_vocabulary(vocabulary_path()))


def texts():
    rng = random.Random(5)
    parts = ["the", " of", "  ", "\n", "\n\n ", "\t", "'s", "'S", "<|endoftext|>", "<|endof", "1234", " ٣", "é", "ß", "日本", "😀", "...", "!?", "\x00", " ", " ", "　", "\r\n", "naïve", "x" * 90]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(3000)]


def test_ids_and_texts_are_the_librarys(theirs, ours):
    for text in texts():
        want = theirs.encode(text, add_special_tokens=False).ids
        assert ours.encode(text).tolist() == want, text
        assert ours.decode(want) == theirs.decode(want, skip_special_tokens=False)


def test_pieces_that_leave_the_memory_are_encoded_again(theirs, ours, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 5)
    for text in texts()[:200]:
        assert ours.encode(text).tolist() == theirs.encode(text, add_special_tokens=False).ids


def test_broken_bytes_and_unknown_ids(theirs, ours):
    ids = theirs.encode("日本", add_special_tokens=False).ids
    for cut in (ids[1:], ids[:-1], [10**6], []):
        known = [i for i in cut if i < 50257]
        assert ours.decode(cut) == theirs.decode(known, skip_special_tokens=False)


def test_one_long_piece(theirs, ours):
    text = "ab" * 50_000
    assert ours.encode(text).tolist() == theirs.encode(text, add_special_tokens=False).ids


def test_given_table(spark, theirs):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = bpe.token_digests(docs, vocabulary_path()).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = theirs.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(theirs.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_round_trip_and_odd_rows(odd):
    tokens = bpe.encoded(odd, vocabulary_path())
    back = bpe.decoded(tokens, vocabulary_path())
    key = lambda rows: sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in rows)
    assert key(back.collect()) == key(odd.collect())
    assert bpe.token_digests(odd.limit(0), vocabulary_path()).collect() == []
