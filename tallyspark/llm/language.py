"""Language identification by cross-parsing entropy.

For each language, a suffix automaton recognises every string of a bounded sample of its labelled
text. A text is parsed against each of them from left to right into the longest phrases that occur
in the sample; a phrase costs the logarithm of the sample's length, as a pointer into it would. The
language in which a text needs the fewest phrases, so normalised, wins.

Letters are lower-cased and everything between them is one space; the rest is a matter of UTF-8
bytes, so any script has the same small alphabet. Texts are parsed whole, in pieces of 2,048 bytes:
all pieces of many texts advance together, one byte at a time, as rows of an array. Only the samples
are broadcast (``sample_rows`` times ``sample_chars`` for each label); each worker builds the automata once.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bound of the sample: rows of each label, and characters of each row, from a place that a hash picks.
SAMPLE_ROWS = 128
SAMPLE_CHARS = 512
#: Bytes of a piece; a phrase ends where its piece ends.
PIECE = 2048
#: Bytes that are parsed together.
TOGETHER = 4 << 20
UNKNOWN = "und"
NOT_LETTERS = re.compile(r"[\W\d_]+")


def letters_of(text: str) -> bytes:
    """Lower-case letters with one space between runs of them, as UTF-8."""
    return NOT_LETTERS.sub(" ", text.lower()).encode()


def suffix_automaton(text: bytes, symbol: np.ndarray, width: int) -> np.ndarray:
    """Transitions of the suffix automaton of a text: a row of ``width`` targets for each state, 0 for none.

    State 1 is the start; ``symbol`` has the column of each byte.
    """
    follow = array("i", bytes(4 * 2 * width))  # state 0 stays empty
    link, length = [0, 0], [-1, 0]
    last = 1
    for c in symbol[np.frombuffer(text, np.uint8)].tolist():
        new = len(link)
        follow.frombytes(bytes(4 * width))
        link.append(1)
        length.append(length[last] + 1)
        p = last
        while p and not follow[p * width + c]:
            follow[p * width + c] = new
            p = link[p]
        if p:
            q = follow[p * width + c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                copy = len(link)
                follow.extend(follow[q * width : (q + 1) * width])
                link.append(link[q])
                length.append(length[p] + 1)
                while p and follow[p * width + c] == q:
                    follow[p * width + c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return np.frombuffer(follow, np.int32).reshape(-1, width)


class Parser:
    """Automata of all languages in one array of transitions; a state is the place of its row there."""

    def __init__(self, samples: dict[str, list[str]]) -> None:
        texts = {lang: b"\x00".join(x for x in map(letters_of, rows) if x.strip()) for lang, rows in sorted(samples.items())}
        texts = {lang: t for lang, t in texts.items() if t}
        self.languages = list(texts)
        self.cost = np.array([math.log2(len(t) + 1) for t in texts.values()])
        self.symbols = np.zeros((len(texts), 256), np.int32)
        tables, roots, base = [np.zeros(1, np.int64)], [], 1
        for n, text in enumerate(texts.values()):
            known = sorted(set(text))
            width = len(known) + 1  # column 0: bytes that the sample lacks
            self.symbols[n, known] = np.arange(1, width)
            table = suffix_automaton(text, self.symbols[n], width)
            alone = len(table)  # the state after an unknown byte: a phrase of its own
            table = np.concatenate([table, np.zeros((1, width), np.int32)])
            table[1, 0] = alone
            tables.append(np.where(table > 0, table.astype(np.int64) * width + base, 0).ravel())
            roots.append(base + width)
            base += table.size
        kind = np.int32 if base < 1 << 31 else np.int64
        self.table, self.roots = np.concatenate(tables, dtype=kind), np.array(roots, kind)

    def phrases(self, texts: list[bytes]) -> np.ndarray:
        """Phrases of each text (rows) in each language (columns)."""
        total = np.zeros((len(texts), len(self.languages)), np.int64)
        owners, starts, sizes, at = [], [], [], 0
        for n, text in enumerate(texts):
            for start in range(0, len(text), PIECE):
                owners.append(n)
                starts.append(at + start)
                sizes.append(min(PIECE, len(text) - start))
            at += len(text)
        if not owners or not self.languages:
            return total
        joined, sizes = np.frombuffer(b"".join(texts), np.uint8), np.array(sizes)
        order = np.argsort(-sizes, kind="stable")
        places, sizes, owners = np.array(starts)[order], sizes[order], np.array(owners)[order]
        active = np.searchsorted(-sizes, -np.arange(sizes[0]), "left")  # pieces longer than each step
        state = np.repeat(self.roots[:, None], len(places), 1)
        count = np.ones(state.shape, np.int64)
        for step, n in enumerate(active.tolist()):
            symbol = self.symbols[:, joined[places[:n] + step]]
            after = self.table[state[:, :n] + symbol]
            lang, piece = np.nonzero(after == 0)
            after[lang, piece] = self.table[self.roots[lang] + symbol[lang, piece]]
            count[lang, piece] += 1
            state[:, :n] = after
        np.add.at(total, owners, count.T)
        return total

    def judge(self, texts: list[str | None]) -> list[tuple[str, float, int]]:
        """(language, score, phrases) of each text. The score is the winner's share of two to the power of minus the costs."""
        raw = [letters_of(t or "") for t in texts]
        found = self.phrases(raw)
        out = []
        for text, counts in zip(raw, found):
            if not text.strip() or not self.languages:
                out.append((UNKNOWN, 0.0, 0))
                continue
            bits = counts * self.cost
            best = int(bits.argmin())  # ties: the first by name
            out.append((self.languages[best], float(1 / np.exp2(bits[best] - bits).sum()), int(counts[best])))
        return out


def _remainder(id_column: str) -> Column:
    return F.pmod(F.crc32(F.col(f"`{id_column}`").cast("string").cast("binary")), F.lit(4))


def samples_of(labelled: DataFrame, id_column: str, text: str, lang: str, *, rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> dict[str, list[str]]:
    """Up to ``rows`` different passages of ``chars`` characters for each label, from the rows with the smallest hashes of id and text.

    Labels are counted first, so that only about four times as many rows as needed are looked at.
    The number of labels must be that of a label set; it is what the driver holds.
    """
    named = labelled.select(F.col(f"`{id_column}`").alias("i"), F.col(f"`{text}`").alias("t"), F.col(f"`{lang}`").alias("l")).where("l IS NOT NULL AND t IS NOT NULL")
    counts = {r.l: r["count"] for r in named.groupBy("l").count().collect()}
    if not counts:
        return {}
    span = 1 << 40
    limits = F.create_map(*(F.lit(x) for label, n in counts.items() for x in (label, min(span, span * 4 * rows // n))))
    place = F.pmod(F.xxhash64("i", "t"), F.lit(span))
    start = F.pmod(F.xxhash64("i", F.lit("start")), F.greatest(F.length("t") - chars, F.lit(0)) + 1) + 1
    near = named.where(place < limits[F.col("l")]).where(F.col("t").rlike(r"\p{L}"))
    passages = near.select("l", F.col("t").substr(start.cast("int"), F.lit(chars)).alias("p"), place.alias("h")).groupBy("l", "p").agg(F.min("h").alias("h"))
    ranked = passages.withColumn("n", F.row_number().over(Window.partitionBy("l").orderBy("h", "p"))).where(F.col("n") <= rows)
    out: dict[str, list[str]] = {}
    for r in ranked.orderBy("l", "n").collect():
        out.setdefault(r.l, []).append(r.p)
    return out


def predicted(
    docs: DataFrame, id_column: str = "doc_id", text: str = "text", lang: str = "lang", *, sample_rows: int = SAMPLE_ROWS, sample_chars: int = SAMPLE_CHARS
) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, n_phrases) of every row.

    Labels are learned from rows with text, label and an id whose CRC-32 modulo 4 is not 2; the
    others are held out. A null text, one without a letter, and any text where nothing was learned
    are ``und`` with score 0. Null ids are neither learned from nor held out. Equal texts have equal
    results, ties go to the first label by name, and labels without any letter in their sample are
    never given. An empty table gives no row.
    """
    rest = _remainder(id_column)
    samples = samples_of(docs.where(rest != 2), id_column, text, lang, rows=sample_rows, chars=sample_chars)
    model = docs.sparkSession.sparkContext.broadcast({"samples": samples})
    kinds = [pa.int64(), pa.bool_(), pa.string(), pa.float64(), pa.int64()]
    names = ["doc_id", "held_out", "lang_pred", "score", "n_phrases"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = model.value  # stays in the worker from task to task
        parser = held.get("parser") or held.setdefault("parser", Parser(held["samples"]))
        for batch in batches:
            sizes = batch.column("text").fill_null("").cast(pa.binary()).to_pylist()
            start = taken = 0
            for i, raw in enumerate(sizes):
                taken += len(raw)
                if taken >= TOGETHER or i == len(sizes) - 1:
                    part = batch.slice(start, i + 1 - start)
                    pred = list(zip(*parser.judge(part.column("text").to_pylist())))
                    columns = [part.column(0), part.column(1), *(pa.array(c, t) for c, t in zip(pred, kinds[2:]))]
                    yield pa.RecordBatch.from_arrays(columns, names=names)
                    start, taken = i + 1, 0

    source = docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.coalesce(rest == 2, F.lit(False)).alias("held_out"), F.col(f"`{text}`").alias("text"))
    return source.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, n_phrases long")
