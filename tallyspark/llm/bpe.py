"""Byte-pair encoding and decoding with a public tokenizer's vocabulary.

Within a piece of text, symbols form a doubly linked list and possible merges wait in a priority
queue by rank, then place. A popped entry whose symbols have changed since is stale and skipped.
Decoding concatenates vocabulary strings. The vocabulary has a fixed size and is broadcast.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import sys
from array import array
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The pattern that byte-level vocabularies of this family were made with.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces whose ids a worker remembers, twice over.
REMEMBERED = 1 << 18


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary: itself where it prints, else one from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in prints]
    return {chr(b): b for b in prints} | {chr(256 + i): b for i, b in enumerate(others)}


def read_vocabulary(path: str) -> dict:
    """Ids, merges and added tokens of a tokenizers file with byte-level BPE."""
    with open(path, encoding="utf-8") as f:
        raw = json.load(f)
    model, before = raw["model"], raw["pre_tokenizer"]
    if model["type"] != "BPE" or before["type"] != "ByteLevel" or before["add_prefix_space"] or raw["normalizer"]:
        raise ValueError("only plain byte-level BPE is supported")
    letters, ids = byte_letters(), model["vocab"]
    pairs = [tuple(m if isinstance(m, list) else m.split(" ")) for m in model["merges"]]
    return {
        "bytes": [ids[c] for c, _ in sorted(letters.items(), key=lambda x: x[1])],
        "merges": [(ids[a], ids[b], ids[a + b]) for a, b in pairs],
        "strings": {i: bytes(letters[c] for c in token) for token, i in ids.items()},
        "added": {t["content"]: t["id"] for t in raw["added_tokens"]},
    }


class Memory(dict):
    """What was computed lately: when it is full it becomes the older half, and what is asked for again moves over."""

    def __init__(self, compute) -> None:
        self.compute, self.older = compute, {}

    def __missing__(self, key: str) -> bytes:
        value = self.older.get(key)
        if value is None:
            value = self.compute(key)
        if len(key) < 64:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[key] = value
        return value


class Bpe:
    def __init__(self, vocabulary: dict) -> None:
        self.first = vocabulary["bytes"]
        self.merges = {(a, b): (rank << 32, c) for rank, (a, b, c) in enumerate(vocabulary["merges"])}
        self.added = vocabulary["added"]
        self.strings = dict(vocabulary["strings"]) | {i: t.encode() for t, i in self.added.items()}
        self.pieces = regex.compile(PIECES)
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.piece_ids = Memory(self.merge)
        self.chunk_ids = Memory(lambda chunk: self.chunk(" " + chunk))

    def merge(self, piece: str) -> bytes:
        """Ids of one piece, as unsigned 32-bit integers."""
        ids = [self.first[b] for b in piece.encode()]
        n, merges, push, pop = len(ids), self.merges, heapq.heappush, heapq.heappop
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        queue = [m[0] | i for i in range(n - 1) if (m := merges.get((ids[i], ids[i + 1])))]  # rank, then place
        heapq.heapify(queue)
        while queue:
            entry = pop(queue)
            i = entry & 0xFFFFFFFF
            j = after[i]
            if j < 0 or ids[i] < 0:
                continue
            m = merges.get((ids[i], ids[j]))
            if not m or m[0] | i != entry:  # stale: its symbols have changed
                continue
            ids[i], ids[j] = made, _ = m[1], -1
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if m := merges.get((made, ids[k])):
                    push(queue, m[0] | i)
            h = before[i]
            if h >= 0 and (m := merges.get((ids[h], made))):
                push(queue, m[0] | h)
        return array("I", [x for x in ids if x >= 0]).tobytes()

    def chunk(self, text: str) -> bytes:
        return b"".join([self.piece_ids[x] for x in self.pieces.findall(text)])

    def encode(self, text: str | None) -> array:
        """Ids of a text. It is cut before spaces that follow and precede other characters, as every piece is."""
        parts = []
        for part in self.special.split(text or "") if self.special else [text or ""]:
            if part in self.added:
                parts.append(array("I", [self.added[part]]).tobytes())
                continue
            chunks = part.split(" ")
            if any(not c or c[-1].isspace() for c in chunks):
                chunks = self.joined(chunks)
            parts.append(self.chunk(chunks[0]))
            known = self.chunk_ids
            parts += [known[c] for c in chunks[1:]]
        ids = array("I")
        ids.frombytes(b"".join(parts))
        return ids

    @staticmethod
    def joined(chunks: list[str]) -> list[str]:
        """Chunks that end in white space go together with the next ones."""
        out, held = [], []
        for i, chunk in enumerate(chunks):
            held.append(chunk)
            if chunk and not chunk[-1].isspace() or i == len(chunks) - 1:
                out.append(" ".join(held))
                held = []
        return out

    def decode(self, ids: Iterable[int]) -> str:
        """Unknown ids stand for nothing; bytes that are not UTF-8 become replacement characters."""
        strings = self.strings
        try:
            raw = b"".join(map(strings.__getitem__, ids))
        except KeyError:
            raw = b"".join(strings.get(i, b"") for i in ids)
        return raw.decode("utf-8", "replace")


def _little_endian(ids: array) -> bytes:
    if sys.byteorder == "big":
        ids = array("I", ids)
        ids.byteswap()
    return ids.tobytes()


def _mapped(docs: DataFrame, columns: list[str], path: str, fn, schema: str, types: list[pa.DataType], names: list[str]) -> DataFrame:
    vocabulary = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = vocabulary.value  # stays in the worker from task to task, and what it remembers with it
        bpe = held.get("bpe") or held.setdefault("bpe", Bpe(held))
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                rows = [fn(bpe, *x) for x in zip(*(c.to_pylist() for c in batch.slice(start, 256).columns))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return docs.select(*columns).mapInArrow(run, schema)


def encoded(docs: DataFrame, path: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and ids (array of int) of each whole text; null and empty texts have no ids. Every row is answered."""
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return _mapped(source, ["doc_id", "text"], path, lambda bpe, i, t: (i, bpe.encode(t).tolist()), "doc_id long, ids array<int>", [pa.int64(), pa.list_(pa.int32())], ["doc_id", "ids"])


def decoded(tokens: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows (doc_id, ids); null ids give the empty text."""
    return _mapped(tokens, ["doc_id", "ids"], path, lambda bpe, i, ids: (i, bpe.decode(ids or [])), "doc_id long, text string", [pa.int64(), pa.string()], ["doc_id", "text"])


def token_digests(docs: DataFrame, path: str, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes each text, decodes the ids again, and returns the number and digest of the ids and the digest of the text they give."""

    def digests(bpe: Bpe, doc_id: int | None, text: str | None) -> tuple:
        ids = bpe.encode(text)
        return doc_id, len(ids), hashlib.sha256(_little_endian(ids)).hexdigest(), hashlib.sha256(bpe.decode(ids).encode()).hexdigest()

    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text"))
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    return _mapped(source, ["doc_id", "text"], path, digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", [pa.int64(), pa.int64(), pa.string(), pa.string()], names)
