import math
import random
import zlib

import numpy as np
import pytest

from tallyspark.llm import language
from tallyspark.llm.queries import op11_language

SF_DIR = "/root/testdata/sf0.01"


def brute_phrases(text: bytes, sample: bytes, piece: int) -> int:
    """The longest strings that occur in the sample, one after the other, found by search."""
    count = 0
    for start in range(0, len(text), piece):
        part = text[start : start + piece]
        i = 0
        while i < len(part):
            j = i + 1
            while j < len(part) and part[i : j + 1] in sample:
                j += 1
            count, i = count + 1, j
    return count


@pytest.mark.parametrize("piece", [7, 2048])
def test_phrases_equal_search(monkeypatch, piece):
    monkeypatch.setattr(language, "PIECE", piece)
    rng = random.Random(4)
    for _ in range(30):
        word = lambda a, n: "".join(rng.choice(a) for _ in range(rng.randint(1, n)))
        samples = {"a": [word("abc é", 40) + "a" for _ in range(3)], "b": [word("ab中 ", 60) + "b"]}
        parser = language.Parser(samples)
        texts = [language.letters_of(word("abcdé 中", 50)) for _ in range(12)] + [b""]
        joined = {k: b"\x00".join(map(language.letters_of, v)) for k, v in samples.items()}
        want = [[brute_phrases(t, joined[k], piece) for k in ("a", "b")] for t in texts]
        assert parser.phrases(texts).tolist() == want


def test_automaton_accepts_exactly_the_strings_of_the_text():
    text = b"abracadabra"
    symbol = np.zeros(256, np.int32)
    symbol[sorted(set(text))] = range(1, 6)
    table = language.suffix_automaton(text, symbol, 6)
    strings = {text[i:j] for i in range(len(text)) for j in range(i + 1, len(text) + 1)}

    def walk(state):
        for c in sorted(set(text)):
            if to := table[state, symbol[c]]:
                yield bytes([c])
                yield from (bytes([c]) + rest for rest in walk(to))

    assert set(walk(1)) == strings


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    truth = {r.doc_id: r for r in docs.select("doc_id", "text", "lang").collect()}
    rows = op11_language(spark, SF_DIR).collect()
    assert sorted(r.doc_id for r in rows) == sorted(truth)
    right = total = 0
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        text = truth[r.doc_id].text
        assert (r.lang_pred == "und") == (text is None or not any(c.isalpha() for c in text))
        assert 0 <= r.score <= 1 and not math.isnan(r.score)
        if r.held_out and truth[r.doc_id].lang and r.lang_pred != "und":
            total += 1
            right += r.lang_pred == truth[r.doc_id].lang
    assert total > 150 and right >= 0.97 * total, (right, total)


def test_held_out_labels_and_other_columns_are_not_seen(spark):
    """Changing the labels of held-out rows, or any source, changes nothing."""
    from pyspark.sql import functions as F

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    changed = docs.withColumn("lang", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, "xx").otherwise(F.col("lang"))).withColumn("source", F.lit("z"))
    assert sorted(map(tuple, language.predicted(docs).collect())) == sorted(map(tuple, language.predicted(changed).collect()))


def test_odd_rows(odd):
    rows = language.predicted(odd).collect()
    assert len(rows) == odd.count()
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in rows if r.doc_id in (1, 2, 5))
    assert all(not r.held_out for r in rows if r.doc_id is None)
    assert language.predicted(odd.limit(0)).collect() == []


def test_nothing_learned_is_und(spark):
    df = spark.createDataFrame([(i, "plain words", None) for i in range(8)], "doc_id long, text string, lang string")
    assert {(r.lang_pred, r.score) for r in language.predicted(df).collect()} == {("und", 0.0)}


def test_a_label_that_holds_most_rows_and_copies(spark):
    """One text in a third of all rows takes one place of the sample."""
    rows = [(i, "the same words again", "en") for i in range(900)] + [(1000 + i, f"autre texte numéro {'é' * (i % 7 + 1)} de la série", "fr") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    samples = language.samples_of(df, "doc_id", "text", "lang")
    assert samples["en"] == ["the same words again"] and len(samples["fr"]) == 7
    got = {(r.lang_pred) for r in language.predicted(df).where("doc_id >= 1000").collect()}
    assert got == {"fr"}
