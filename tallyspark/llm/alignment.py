"""Alignment of two tokenizers' tokens over the bytes of a text, by merge paths.

The ends of a text's A tokens and of its B tokens, as byte offsets, are two sorted lists. Their merge
is a path through the grid of both; the point where it crosses a diagonal is found by binary search,
so diagonals at equal distances cut the merge into independent pieces of equal work. A piece gives
the token pairs that overlap in it, one for each stretch between ends, and marks where A and B both
end; pieces are put together by their borders into groups.

Documents are handled in blocks of some megabytes of text. A block gives its distinct linked id pairs
with their numbers, and each document the places of its own pairs in that list; both are written
once. The pairs' numbers are added over the corpus, and the totals return to the blocks that hold
the pair, where documents look theirs up. So a frequent pair is one row for each block, and neither
counts nor links of the corpus are ever in one task.
"""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.bpe import byte_letters
from tallyspark.llm.common import written

#: Ends of a piece.
PIECE = 1 << 16
#: Bytes of text after which a block is full; it has one text at least.
BLOCK_BYTES = 8 << 20
#: Bytes of text that are tokenized at once.
TOGETHER = 1 << 20
#: Words whose ids a worker remembers, twice over.
REMEMBERED = 1 << 19
#: Texts of characters on whose kind everybody agrees; others are tokenized in one go.
PLAIN = re.compile(r"[\x20-\x7e\t\n\r\w]*")
#: A space between two characters that are none: a token of neither side goes over its left edge.
CUT = re.compile(r" (?<=\S )(?=\S)")


class Tokenizers:
    """Both tokenizers, and the bytes of their tokens. Special tokens are plain text."""

    def __init__(self, path_a: str, path_b: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.a.no_padding()
        self.a.no_truncation()
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters = byte_letters()
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for token, i in self.a.get_vocab(with_added_tokens=False).items():
            self.bytes_a[i] = bytes(letters[c] for c in token)
        n = self.b.get_piece_size()
        self.bytes_b = [bytes([int(self.b.id_to_piece(i)[3:-1], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode() for i in range(n)]
        self.length_a, self.length_b = (np.array(list(map(len, t)), np.int64) for t in (self.bytes_a, self.bytes_b))
        # texts of ids inside a group, and at the end of its side
        self.words = [f"{i}{end}".encode() for m, ends in ((len(self.bytes_a), ",|"), (n, ",;")) for end in ends for i in range(m)]
        self.first_b = 2 * len(self.bytes_a)

        pieces = [self.b.id_to_piece(i) for i in range(n)]
        self.cuts = not any(re.search("[^▁]▁", p) for p in pieces if p)  # no token of B goes over a word's start
        self.known: tuple[dict, dict] = {}, {}  # ids of each side, as bytes
        self.older: tuple[dict, dict] = {}, {}

    def learn(self, texts: Iterable[str]) -> None:
        """Ids of both sides of each text, as 32-bit integers; None where B does not give its bytes back.

        A does so by construction: all its tokens are made of the bytes themselves.
        """
        if len(self.known[0]) > REMEMBERED:
            self.older, self.known = self.known, ({}, {})
        (known_a, known_b), (older_a, older_b) = self.known, self.older
        new = []
        for text in texts:
            if text not in known_a:
                if text in older_a:
                    known_a[text], known_b[text] = older_a[text], older_b[text]
                else:
                    new.append(text)
        spaced = [" " + t for t in new]
        pieces = self.bytes_b.__getitem__
        for text, raw, a, b in zip(new, spaced, self.a.encode_batch_fast(spaced, add_special_tokens=False), self.b.encode(new, num_threads=1)):
            same = b"".join(map(pieces, b)) == raw.encode()
            known_a[text], known_b[text] = (array("i", a.ids).tobytes(), array("i", b).tobytes()) if same else (None, None)

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Ids of A and B of each text; none where the text is empty or the bytes of a side are not those of space and text.

        Words with the space before them are tokenized once and remembered.
        """
        cut = [CUT.split(t) if self.cuts and PLAIN.fullmatch(t) else [t] for t in texts]
        self.learn(set().union(*cut) - {""})
        none, out = np.zeros(0, np.int64), []
        for text, chunks in zip(texts, cut):
            try:
                sides = [b"".join(map(k.__getitem__, chunks)) for k in self.known] if text else [b"", b""]
            except TypeError:  # a None among them
                sides = [b"", b""]
            out.append(tuple(np.frombuffer(x, np.int32).astype(np.int64) if x else none for x in sides))
        return out


def crossings(a: np.ndarray, b: np.ndarray, diagonals: np.ndarray) -> np.ndarray:
    """For each diagonal, how many of its first ends in merged order are from ``a``; equal ends of ``a`` come first."""
    low, high = np.maximum(diagonals - len(b), 0), np.minimum(diagonals, len(a))
    while (open_ := low < high).any():
        middle = (low + high) // 2
        other = diagonals - middle - 1
        taken = open_ & (a[np.minimum(middle, len(a) - 1)] <= b[np.maximum(other, 0)])
        low, high = np.where(taken, middle + 1, low), np.where(open_ & ~taken, middle, high)
    return low


def piece_links(a: np.ndarray, b: np.ndarray, i: int, j: int, i_end: int, j_end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(A place, B place, both end here) of each stretch that ends in a piece of the merge.

    An end of B that an end of A equals closes no stretch of its own; that end of A may lie in the piece before.
    """
    own_a, own_b = a[i:i_end], b[j:j_end]
    in_a = i + np.searchsorted(own_a, own_b, "left")  # the first end of A that is not before
    double = np.zeros(len(own_b), bool)
    inside = in_a < i_end
    double[inside] = a[in_a[inside]] == own_b[inside]
    if i and len(own_b):
        double |= own_b == a[i - 1]
    in_b = j + np.searchsorted(own_b, own_a, "left")
    there = np.minimum(in_b, len(b) - 1)
    both = b[there] == own_a
    ends = np.concatenate([own_a, own_b[~double]])
    order = np.argsort(ends, kind="stable")
    side_a = np.concatenate([np.arange(i, i_end), in_a[~double]])[order]
    side_b = np.concatenate([in_b, np.arange(j, j_end)[~double]])[order]
    return side_a, side_b, np.concatenate([both, np.zeros((~double).sum(), bool)])[order]


def links(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(A place, B place, both end here) of every overlapping pair of tokens, from the sorted ends of both sides.

    Both sides must end at the same place. Pieces are independent; put together in order they are
    the whole, and a group that a border cuts goes on in the next piece.
    """
    if not len(a):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    diagonals = np.append(np.arange(0, len(a) + len(b), piece), len(a) + len(b))
    i = crossings(a, b, diagonals)
    j = diagonals - i
    pieces = [piece_links(a, b, *cut) for cut in zip(i, j, i[1:], j[1:])]
    return tuple(map(np.concatenate, zip(*pieces)))


def group_text(words: list[bytes], first_b: int, a: np.ndarray, b: np.ndarray, last_a: np.ndarray, last_b: np.ndarray) -> bytes:
    """``a1,a2|b1;a3|b2,b3``: the ids of each group, from the places of the groups' last tokens."""
    chosen = np.empty(len(a) + len(b), np.int64)
    after_a, after_b = last_a + 1, last_b + 1
    word_a, word_b = a.copy(), b + first_b
    word_a[last_a] += first_b // 2
    word_b[last_b] += (len(words) - first_b) // 2
    before = np.append(0, after_b[:-1])  # tokens of B in earlier groups
    chosen[np.arange(len(a)) + np.repeat(before, np.diff(after_a, prepend=0))] = word_a
    chosen[np.arange(len(b)) + np.repeat(after_a, np.diff(after_b, prepend=0))] = word_b
    return b"".join(map(words.__getitem__, chosen.tolist()))[:-1]


def _packed(numbers: np.ndarray, counts: np.ndarray) -> bytes:
    return zlib.compress(np.concatenate([np.diff(numbers, prepend=0), counts]).astype("<u4").tobytes(), 1)


def _unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(zlib.decompress(raw), "<u4").astype(np.int64)
    half = len(both) // 2
    return np.cumsum(both[:half]), both[half:]


DOCUMENT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
_DOCUMENT_TYPES = [pa.int64(), *[pa.int64()] * 4, pa.string()]
_DOCUMENT_NAMES = [f.split()[0] for f in DOCUMENT.split(", ")]
_PAIRS = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("n", pa.int64())]))


def blocks(docs: DataFrame, path_a: str, path_b: str, id_column: str = "doc_id", text: str = "text", *, block_bytes: int = BLOCK_BYTES, piece: int = PIECE) -> DataFrame:
    """Rows of documents, with ``own`` (places and numbers of their pairs in the block's list), and one row of ``pairs`` for each block."""
    held = docs.sparkSession.sparkContext.broadcast({})  # stays in the worker from task to task

    def aligned_text(both: Tokenizers, a: np.ndarray, b: np.ndarray) -> tuple[list, np.ndarray]:
        side_a, side_b, closes = links(np.cumsum(both.length_a[a]), np.cumsum(both.length_b[b]), piece)
        if not len(a):
            return [0, 0, 0, 0, ""], np.zeros(0, np.int64)
        text = group_text(both.words, both.first_b, a, b, side_a[closes], side_b[closes])
        digest = hashlib.sha256(text).hexdigest()
        return [len(a), len(b), int(closes.sum()), len(side_a), digest], a[side_a] << 32 | b[side_b]

    def block_rows(name: str, rows: list[list], keys: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        distinct, place = np.unique(np.concatenate([k for k, _ in keys]), return_inverse=True)
        n = np.bincount(place, np.concatenate([c for _, c in keys]), len(distinct))
        own = [_packed(p, c) for p, (_, c) in zip(np.split(place, np.cumsum([len(k) for k, _ in keys])[:-1]), keys)]
        listed = pa.StructArray.from_arrays([pa.array(distinct >> 32, pa.int32()), pa.array(distinct & 0xFFFFFFFF, pa.int32()), pa.array(n.astype(np.int64))], ["a", "b", "n"])
        pairs = pa.ListArray.from_arrays(pa.array([0, len(listed)], pa.int32()), listed)
        columns = [pa.array(c, t) for c, t in zip(zip(*rows), _DOCUMENT_TYPES)]
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows)), *columns, pa.array(own, pa.binary()), pa.nulls(len(rows), _PAIRS)], names=NAMES)
        empty = [pa.nulls(1, t) for t in [*_DOCUMENT_TYPES, pa.binary()]]
        yield pa.RecordBatch.from_arrays([pa.array([name]), *empty, pairs], names=NAMES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = held.value.get("both") or held.value.setdefault("both", Tokenizers(path_a, path_b))
        part, number, size, rows, keys = TaskContext.get().partitionId(), 0, 0, [], []
        waiting: list[tuple] = []
        held_bytes = 0

        def flush() -> None:
            for (doc_id, _), (a, b) in zip(waiting, both.encode([t or "" for _, t in waiting])):
                row, key = aligned_text(both, a, b)
                rows.append([doc_id, *row])
                keys.append(np.unique(key, return_counts=True))
            waiting.clear()

        for batch in batches:
            for doc_id, value in zip(*(c.to_pylist() for c in batch.columns)):
                waiting.append((doc_id, value))
                held_bytes += len(value or "")
                size += len(value or "")
                if held_bytes >= TOGETHER or size >= block_bytes or len(waiting) >= 4096:
                    flush()
                    held_bytes = 0
                if size >= block_bytes or len(rows) >= 1 << 16:
                    flush()
                    yield from block_rows(f"{part}-{number}", rows, keys)
                    number, size, rows, keys = number + 1, 0, [], []
        flush()
        if rows:
            yield from block_rows(f"{part}-{number}", rows, keys)

    NAMES = ["block", *_DOCUMENT_NAMES, "own", "pairs"]
    source = docs.select(F.col(f"`{id_column}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    return source.mapInArrow(run, f"block string, {DOCUMENT}, own binary, pairs array<struct<a:int,b:int,n:bigint>>")


def pair_counts(table: DataFrame) -> DataFrame:
    """(a, b, n, best): the corpus-wide links of each id pair, and whether none of its B id has more."""
    listed = table.where("pairs IS NOT NULL").select(F.explode("pairs").alias("p")).select("p.*")
    counts = listed.groupBy("a", "b").agg(F.sum("n").alias("n"))
    highest = counts.groupBy("b").agg(F.max("n").alias("highest"))
    return counts.join(highest, "b").select("a", "b", "n", (F.col("n") == F.col("highest")).alias("best"))


def aligned(docs: DataFrame, path_a: str, path_b: str, id_column: str = "doc_id", text: str = "text", *, block_bytes: int = BLOCK_BYTES, piece: int = PIECE) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row.

    ``path_a`` is a byte-level vocabulary of tokenizers, ``path_b`` a model of sentencepiece that adds
    a space. Null and empty texts, and texts that a side does not give back byte by byte, have no
    tokens: zeros and an empty digest. Null ids stay null; equal rows are documents of their own and
    all count. B ids with several most frequent A ids count all of these as best. An empty table gives
    no row; other columns are not read.
    """
    table = written(blocks(docs, path_a, path_b, id_column, text, block_bytes=block_bytes, piece=piece), "aligned")
    counts = written(pair_counts(table), "pair_counts")
    listed = table.where("pairs IS NOT NULL").select(F.col("block").alias("home"), F.explode("pairs").alias("p")).select("home", "p.a", "p.b")
    back = listed.join(counts, ["a", "b"])
    documents = table.where("own IS NOT NULL").select("block", *_DOCUMENT_NAMES, "own")

    def look_up(docs_of: pa.Table, pairs_of: pa.Table) -> pa.Table:
        a, b, n, best = (pairs_of.column(c).to_numpy() for c in ("a", "b", "n", "best"))
        order = np.argsort(a.astype(np.int64) << 32 | b)
        n, best = n[order], best[order]
        sums, bests = [], []
        for raw in docs_of.column("own"):
            places, times = _unpacked(raw.as_py())
            sums.append(int((n[places] * times).sum()))
            bests.append(int(times[best[places]].sum()))
        columns = {c: docs_of.column(c) for c in _DOCUMENT_NAMES} | {"n_best": pa.array(bests, pa.int64()), "count_sum": pa.array(sums, pa.int64())}
        return pa.table({c: columns[c] for c in RESULT})

    schema = ", ".join(f"{c} {t}" for c, t in RESULT.items())
    return documents.groupBy("block").cogroup(back.groupBy("home")).applyInArrow(look_up, schema)


RESULT = {c: "string" if c == "groups_sha256" else "long" for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")}
