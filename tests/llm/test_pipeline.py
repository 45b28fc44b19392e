"""The stages one after the other, each held against brute force over its own input."""

import random
from collections import Counter

import corpus_pipeline as pipeline
import __spark_entry__ as entry
import pytest
from test_repeats import brute as brute_repeats
from test_secrets import HEX
from test_simhash import jaccard, shingles

from tallyspark.llm import line_quality, secrets


@pytest.fixture(scope="module")
def folder(documents, tmp_path_factory):
    """Clean documents, copies, near copies, rejects, a shared passage and secrets."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefghijk") for _ in range(rng.randint(3, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    texts = [prose(120) for _ in range(60)]
    texts += texts[:10] + [t + " more" for t in texts[10:15]]
    texts += ["too short", "again and again " * 60, None, ""]
    passage = prose(60)
    texts += [f"{prose(80)} {passage} {prose(70)}" for _ in range(5)]
    texts += [f"{prose(90)} token = \"{HEX}{i}\" {prose(20)}" for i in range(5)]
    path = str(tmp_path_factory.mktemp("corpus"))
    documents(texts).write.parquet(f"{path}/documents.parquet")
    return path


def test_every_stage(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [n for n, _ in pipeline.STAGES] == ["quality rules", "near duplicates", "repeated text", "secret scan", "packing"]
    for i, (_, stage) in enumerate(pipeline.STAGES):
        before = docs.collect()
        docs = stage(spark, docs, folder)
        out = docs.collect()
        docs = spark.createDataFrame(out, docs.schema)
        if i < 4:
            assert docs.columns == pipeline.COLUMNS and all(r.n_chars == len(r.text) for r in out)
        if i == 0:
            good = {r.doc_id for r in before if not (len((r.text or "").split()) < 50 or line_quality.measured(r.text)[0][4] * 2 > len(r.text.split()))}
            assert {r.doc_id for r in out} == good and len(before) - len(good) == 4
        if i == 1:
            sets = {r.doc_id: shingles(r.text) for r in sorted(before)}
            least = {i: min(j for j in sets if jaccard(sets[i], sets[j]) >= 0.8) for i in sets}
            assert {r.doc_id for r in out} == set(least.values()) and len(before) - len(out) == 15
        if i == 2:
            want = {r.doc_id: w[0] - w[1] for r, w in zip(before, brute_repeats([r.text for r in before], 200))}
            assert {r.doc_id: len(r.text.encode()) for r in out} == want and sum(want.values()) < sum(len(r.text) for r in before)
        if i == 3:
            assert {r.doc_id: r.text for r in out} == {r.doc_id: secrets.without_spans(r.text) for r in before}
            assert sum("[SECRET]" in r.text for r in out) == 5 and not any(HEX in r.text for r in out)
        if i == 4:
            tokens = Counter()
            for r in out:
                tokens[r.doc_id] += r.n_tokens
            assert tokens == {r.doc_id: len(r.text.split()) for r in before}
            assert max(Counter(x for r in out for x in [r.bin_id] * r.n_tokens).values()) <= 2048


def test_run_is_the_stages(spark, folder):
    rows = pipeline.run(spark, folder).collect()
    assert len(rows) == len({(r.doc_id, r.piece) for r in rows}) and rows


def test_registered(spark):
    names = entry.queries()
    assert "pipeline" in names and all(any(k.startswith(f"op{n}_") for k in names) for n in range(1, 11))
    assert pipeline.ORACLE_SQL is None and "pipeline" not in entry.oracle_sql()


@pytest.mark.parametrize("name", ["op5_warc", "op6_quality", "op7_repeats"])
def test_sql(spark, name):
    from oracle import compare, duck

    sf = "/root/testdata/sf0.01"
    ok, note = compare(entry.queries()[name](spark, sf), duck(sf), entry.oracle_sql()[name])
    assert ok, note


def test_empty_tables(spark, documents, tmp_path):
    documents([]).write.parquet(f"{tmp_path}/documents.parquet")
    assert pipeline.run(spark, str(tmp_path)).collect() == []
