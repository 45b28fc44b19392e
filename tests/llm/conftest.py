import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """A table of documents from texts, or (id, text) or (id, text, source) rows; None is an empty table."""

    def make(rows, **extra):
        full = []
        for i, row in enumerate(rows):
            row = (i, row) if isinstance(row, str) or row is None else row
            doc_id, text, source = (*row, "s")[:3]
            full.append((doc_id, text, "en", source, len(text or "")))
        df = spark.createDataFrame(full, DOCS)
        return df.withColumns({k: F.lit(v) for k, v in extra.items()})

    return make


#: Columns whose names the operators use inside.
CLASHING = {k: "x" for k in ("key", "part", "t", "fp", "kept", "cuts", "host", "line", "base", "found", "label", "_key", "_text", "_c0", "_stays", "first", "last", "shard", "cluster", "digest", "payload", "size")}


@pytest.fixture(scope="session")
def odd(documents):
    """Nulls in every column, empty and long texts, repeated rows and ids, and clashing names."""
    long = "word " * 20_000 + "x" * 50_000
    rows = [(1, None, None), (2, "", "s"), (2, "", "s"), (None, "plain text of a few words", "s"), (None, None, None), (3, long, "s"), (4, "the same text in two rows", "s"), (4, "the same text in two rows", "s"), (4, "another text of that id", "s"), (5, " \t\n\x0b\f\r ", "s"), (6, "ünï cödé 😀 𝔘 \x00 \x1c end", "s")]
    return documents(rows, **CLASHING)
