"""Removal of repeated byte strings by prefix-free parsing.

A rolling hash runs over every text. In each string of ``length`` bytes the position with the
smallest hash of ``trigger`` bytes (the last of equal ones) is its trigger. The rule looks at
nothing outside the string, so equal strings have equal triggers at equal places. The strings
that share one trigger are neighbours; the bytes they span form a phrase, and the phrases
overlap by ``length - 1`` bytes, so none is a proper prefix of another at the same trigger.

1. A phrase that occurs twice is repeated as a whole. Only one row for each phrase, not its
   bytes, is shuffled: equal phrases of one task are combined before that.
2. Distinct phrases around equal triggers may share some strings. They are fetched and two
   orders are sorted: that of the dictionary (the bytes before the trigger, read backwards) and
   that of the parse (the bytes from the trigger on). Their common prefixes between neighbours,
   taken together for each offset, group the strings as the suffix array of the corpus would:
   equal strings have the same class in both orders.
3. The spans are gathered for each document and cut out of its text.

A trigger with more than ``max_phrases`` distinct phrases isn't gathered: its strings are hashed
and counted one by one, with partial aggregation before the shuffle.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import written

TRIGGER = 32
#: Bytes hashed at once; longer texts are taken in pieces that overlap.
PIECE = 1 << 20
POSITION_BITS = np.uint64(23)
BASE = 0x9E3779B97F4A7C15 | 1
#: Kinds of phrase rows: a phrase; a span known to be repeated; a phrase whose trigger is common in
#: its task, dealt out by its own hash; a note that a trigger has such phrases.
NEW, SPAN, SPLIT, NOTE = 0, 1, 2, 3
#: Distinct phrases of one trigger in one task from which they are dealt out by phrase.
COMMON = 256
#: Phrases that a map task combines at once.
COMBINE = 1 << 20
PHRASE_ROWS = "part long, t long, e long, key long, at long, kind byte"
FLAGGED = "key long, t long, lo long, hi long, at int, check boolean"
CONTEXTS = "t long, key long, lo long, hi long, at int, phrase binary"
SPANS = "key long, lo long, hi long"


def rolling_hash(data: np.ndarray, size: int) -> np.ndarray:
    """Hash of every ``size`` bytes: polynomial modulo 2**64, by doubling lengths."""
    out, have, base = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9), 1, BASE
    parts, held, rest = None, 0, size
    while True:
        if rest & 1:
            if parts is None:
                parts, held = out, have
            else:  # the bytes so far come first
                parts = parts[: len(out) - held] * np.uint64(pow(BASE, have, 1 << 64)) + out[held:]
                held += have
        rest >>= 1
        if not rest:
            break
        out = out[: len(out) - have] * np.uint64(base) + out[have:]
        have *= 2
        base = base * base & ((1 << 64) - 1)
    out = parts[: max(0, len(data) - size + 1)]
    out = out ^ (out >> np.uint64(29))
    return out * np.uint64(0x94D049BB133111EB)


def phrases(data: np.ndarray, length: int, trigger: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last string start of each phrase, its trigger's position and hash."""
    hashes = rolling_hash(data, trigger)
    width = length - trigger + 1
    n = len(hashes)
    low = (np.uint64(1) << POSITION_BITS) - np.uint64(1)
    best = (hashes & ~low) | (low - np.arange(n, dtype=np.uint64))  # of equal hashes, the last position is the smallest value
    have = 1
    while have < width:
        step = min(have, width - have)
        best = np.minimum(best[: len(best) - step], best[step:])
        have += step
    at = (low - (best & low)).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.concatenate([first[1:], [len(at)]]) - 1
    return first, last, at[first], hashes[at[first]]


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open spans, as maximal runs in ascending order; spans that touch are one run."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], starts[1:] > ends[:-1]])
    return starts[new], ends[np.concatenate([np.flatnonzero(new)[1:] - 1, [len(ends) - 1]])]


def _to_batch(schema: str, columns: list[np.ndarray]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "byte": pa.int8(), "boolean": pa.bool_(), "binary": pa.binary()}
    fields = [f.strip().split() for f in schema.split(",")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], names=[n for n, _ in fields])


def _phrase_rows(batches: Iterator[pa.RecordBatch], length: int, trigger: int) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, ...]] = []
    size = 0
    for batch in batches:
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            raw = text.as_buffer()
            n = raw.size if raw is not None else 0
            for start in range(0, n - length + 1, PIECE):
                piece = bytes(raw[start : min(n, start + PIECE + length - 1)])
                first, last, at, t = phrases(np.frombuffer(piece, np.uint8), length, trigger)
                e = np.array([xxhash.xxh3_64_intdigest(piece[a:b]) for a, b in zip(first.tolist(), (last + length).tolist())], np.uint64)
                held.append((t.view(np.int64), e.view(np.int64), np.full(len(t), key), first + start, last + start, at + start))
                size += len(t)
            if size >= COMBINE:
                yield from _combined(held, length)
                held, size = [], 0
    if held:
        yield from _combined(held, length)


def _combined(held: list[tuple[np.ndarray, ...]], length: int) -> Iterator[pa.RecordBatch]:
    """Equal phrases of a task become spans and one row; those of common triggers are dealt out by phrase."""
    t, e, key, lo, hi, at = (np.concatenate(c) for c in zip(*held))
    order = np.lexsort((e, t))
    t_new = np.concatenate([[True], t[order][1:] != t[order][:-1]])
    new = t_new | np.concatenate([[True], e[order][1:] != e[order][:-1]])
    starts = np.flatnonzero(new)
    twice = np.zeros(len(t), bool)
    twice[order] = np.repeat(np.diff(np.append(starts, len(t))) > 1, np.diff(np.append(starts, len(t))))
    rows = order[starts]
    of_t = np.cumsum(t_new[starts]) - 1
    common = (np.bincount(of_t) > COMMON)[of_t]
    packed = lo[rows] << 16 | (hi - lo)[rows] << 8 | (at - lo)[rows]
    kind = np.where(common, SPLIT, NEW)
    yield _to_batch(PHRASE_ROWS, [np.where(common, e[rows], t[rows]), t[rows], e[rows], key[rows], packed, kind])
    if common.any():
        notes = np.unique(t[rows][common])
        none = np.zeros(len(notes), np.int64)
        yield _to_batch(PHRASE_ROWS, [notes, notes, none + np.iinfo(np.int64).min, none, none, none + NOTE])
    where = np.flatnonzero(twice)  # in the order of the texts
    if len(where):
        key, lo, hi = key[where], lo[where], hi[where] + length
        new = np.concatenate([[True], (key[1:] != key[:-1]) | (lo[1:] > hi[:-1]) | (lo[1:] < lo[:-1])])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(key)) - 1
        none = np.zeros(len(first), np.int64)
        yield _to_batch(PHRASE_ROWS, [key[first] + lo[first], lo[first], hi[last], key[first], none, none + SPAN])


def _classified(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """From rows sorted by trigger and phrase: spans of phrases that occur twice, and one row of each phrase whose trigger has others.

    The last row of a batch is held back, as what follows decides on it; nothing else is.
    """
    tail, tail_twice, tail_others = None, False, False
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]]
            span = columns[4] == SPAN
            if span.any():
                lo, hi, key = (c[span] for c in columns[:3])
                yield _to_batch(FLAGGED, [key, np.zeros(len(lo), np.int64), lo, hi, np.zeros(len(lo), np.int32), np.zeros(len(lo), bool)])
                columns = [c[~span] for c in columns]
            if not len(columns[0]):
                continue
            if tail is not None:
                columns = [np.concatenate(x) for x in zip(tail, columns)]
        elif tail is None:
            return
        else:
            columns = tail
        t, e, key, packed, kind = columns
        n, at = len(t), np.arange(len(t))
        new_t = np.concatenate([[True], t[1:] != t[:-1]])
        new_e = new_t | np.concatenate([[True], e[1:] != e[:-1]])
        follows_t, follows_e = np.append(~new_t[1:], False), np.append(~new_e[1:], False)
        twice = ~new_e | follows_e
        twice[0] |= tail_twice
        mark = (kind == SPLIT) | (kind == NOTE)
        marks = np.cumsum(mark)
        t_start, e_start = np.maximum.accumulate(np.where(new_t, at, 0)), np.maximum.accumulate(np.where(new_e, at, 0))
        others = (e_start > t_start) | (marks - marks[t_start] + mark[t_start] > 0) | ((t_start == 0) & tail_others)
        check = ~follows_e & (others | follows_t)
        lo, hi = packed >> 16, (packed >> 16) + (packed >> 8 & 255)
        done = n if batch is None else n - 1
        for chosen, is_check in ((twice, False), (check, True)):
            x = np.flatnonzero(chosen[:done] & (kind[:done] != NOTE))
            if len(x):
                yield _to_batch(FLAGGED, [key[x], t[x], lo[x], hi[x] + (0 if is_check else length), packed[x] & 255, np.full(len(x), is_check)])
        tail = [c[-1:] for c in columns]
        tail_twice, tail_others = bool(not new_e[-1] or (n == 1 and tail_twice)), bool(others[-1])


def _packed_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed for the shuffle."""
    pack = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        packed = [None if x is None else pack.compress(x.encode()) for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary()), *batch.columns[2:]], names=batch.schema.names)


def unpacked(packed: bytes | None) -> bytes:
    return b"" if packed is None else zstandard.ZstdDecompressor().decompress(packed)


def _fetched(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for key, packed, rows in zip(*(c.to_pylist() for c in batch.columns)):
            raw = unpacked(packed)
            yield _to_batch(
                CONTEXTS,
                [[r["t"] for r in rows], [key] * len(rows), [r["lo"] for r in rows], [r["hi"] for r in rows], [r["at"] for r in rows], [raw[r["lo"] : r["hi"] + length] for r in rows]],
            )


def _padded(parts: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(x[:width].ljust(width, b"\0") for x in parts), np.uint8).reshape(len(parts), width)


def _order(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order of byte rows, and the common prefix of each with the one before it."""
    order = np.argsort(np.ascontiguousarray(rows).view(f"V{rows.shape[1]}").ravel(), kind="stable")
    differ = rows[order[1:]] != rows[order[:-1]]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return order, np.concatenate([[0], common])


def _shared(columns: list[np.ndarray], length: int, trigger: int) -> pa.RecordBatch:
    """Spans of the strings that distinct phrases share, from both sorted orders."""
    _, key, lo, hi, at, phrase = columns
    n, widest = len(key), length - trigger
    left, left_common = _order(_padded([p[:a][::-1] for p, a in zip(phrase, at.tolist())], max(1, widest)))
    right, right_common = _order(_padded([p[a:] for p, a in zip(phrase, at.tolist())], length))
    low, high = at - (hi - lo), at  # bytes before the trigger, of the phrase's last and first string
    spans = []
    left_class, right_class = np.empty(n, np.int64), np.empty(n, np.int64)
    for before in range(widest + 1):
        x = np.flatnonzero((low <= before) & (before <= high))
        if len(x) < 2:
            continue
        left_class[left] = np.cumsum(left_common < before)
        right_class[right] = np.cumsum(right_common < length - before)
        _, inverse, counts = np.unique(left_class[x] * (n + 1) + right_class[x], return_inverse=True, return_counts=True)
        x = x[counts[inverse] > 1]
        spans.append((x, lo[x] + at[x] - before))
    x, start = (np.concatenate(c) for c in zip(*spans)) if spans else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    order = np.lexsort((start, x))
    x, start = x[order], start[order]
    new = np.concatenate([[True], (x[1:] != x[:-1]) | (start[1:] > start[:-1] + 1)])[: len(x)]
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(x))[: len(first)] - 1
    return _to_batch(SPANS, [key[x[first]], start[first], start[last] + length])


#: Phrases compared at once, and triggers are never cut between two such groups.
COMPARE = 20_000


def _compared(batches: Iterator[pa.RecordBatch], length: int, trigger: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by trigger, taken in groups of whole triggers."""
    held: list[list[np.ndarray]] = []
    size = 0
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            size += batch.num_rows
        if not size or (batch is not None and size < COMPARE):
            continue
        columns = [np.concatenate(c) for c in zip(*held)]
        cut = size if batch is None else int(np.searchsorted(columns[0], columns[0][-1]))
        if cut:
            yield _shared([c[:cut] for c in columns], length, trigger)
        held, size = [[c[cut:] for c in columns]], size - cut


def _strings(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Every string of a phrase by its hash, for triggers with too many phrases to be gathered."""
    for batch in batches:
        for _, key, lo, hi, _, phrase in zip(*(c.to_pylist() for c in batch.columns)):
            digests = [xxhash.xxh3_128_digest(phrase[i : i + length]) for i in range(hi - lo + 1)]
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.binary()), pa.array([key] * len(digests), pa.int64()), pa.array(range(lo, hi + 1), pa.int64())], names=["string", "key", "lo"])


def with_key(docs: DataFrame, id_column: str, text_column: str, key: str) -> DataFrame:
    """A key of the row's id and text: equal rows share it, and the same spans hold for them."""
    return docs.withColumn(key, F.xxhash64(F.col(id_column), F.col(text_column)))


def packed_texts(docs: DataFrame, *columns: str) -> DataFrame:
    """The first column, the second one compressed, and the others as they are."""
    chosen = docs.select(*columns)
    kinds = ["binary" if i == 1 else f.dataType.simpleString() for i, f in enumerate(chosen.schema.fields)]
    return chosen.mapInArrow(_packed_texts, ", ".join(f"`{c}` {k}" for c, k in zip(columns, kinds)))


def repeated_spans(docs: DataFrame, key: str, text: str, *, length: int = 200, trigger: int = TRIGGER, max_phrases: int = COMPARE) -> DataFrame:
    """(key, lo, hi): bytes of each text covered by a string of ``length`` bytes that also starts elsewhere. Spans may overlap.

    ``length - trigger`` must be below 256. Null texts have no bytes. Rows of equal key and text
    are copies of each other.
    """
    if not 0 < trigger < length or length - trigger > 255:
        raise ValueError("the trigger must be shorter than the string, by less than 256 bytes")
    source = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    rows = source.where(F.octet_length("text") >= length).mapInArrow(lambda b: _phrase_rows(b, length, trigger), PHRASE_ROWS)
    flagged = written(rows.repartition("part").sortWithinPartitions("t", "e").mapInArrow(lambda b: _classified(b, length), FLAGGED), "phrases")
    whole = flagged.where(~F.col("check")).select("key", "lo", "hi")
    check = flagged.where("check").select("key", "t", "lo", "hi", "at")
    places = check.groupBy("key").agg(F.collect_list(F.struct("t", "lo", "hi", "at")).alias("places"))
    contexts = packed_texts(source, "key", "text").join(places, "key").mapInArrow(lambda b: _fetched(b, length), CONTEXTS)
    common = check.groupBy("t").count().where(F.col("count") > max_phrases).select("t")
    if common.isEmpty():
        parts = [contexts]
    else:
        contexts = written(contexts, "contexts")
        parts = [contexts.join(common, "t", "left_anti"), contexts.join(common, "t", "left_semi")]
    shared = parts[0].repartition("t").sortWithinPartitions("t").mapInArrow(lambda b: _compared(b, length, trigger), SPANS)
    if parts[1:]:
        strings = parts[1].select("t", "key", "lo", "hi", "at", "phrase").mapInArrow(lambda b: _strings(b, length), "string binary, key long, lo long")
        twice = strings.groupBy("string").count().where("count > 1").select("string")
        shared = shared.union(strings.join(twice, "string", "left_semi").select("key", "lo", (F.col("lo") + length).alias("hi")))
    return whole.union(shared)


def _cut(packed: bytes | None, spans: list | None) -> tuple[int, list[tuple[int, int]], bytes]:
    raw = unpacked(packed)
    if not spans:
        return len(raw), [], raw
    lo, hi = merged(np.array([s["lo"] for s in spans]), np.array([s["hi"] for s in spans]))
    kept, end = [], 0
    for a, b in zip(lo.tolist(), hi.tolist()):
        kept.append(raw[end:a])
        end = b
    kept.append(raw[end:])
    return len(raw), list(zip(lo.tolist(), hi.tolist())), b"".join(kept)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for doc_id, packed, spans in zip(*(c.to_pylist() for c in batch.columns)):
            size, cuts, kept = _cut(packed, spans)
            rows.append((doc_id, size, size - len(kept), len(cuts), hashlib.sha256(kept).hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 5, [pa.int64()] * 4 + [pa.string()])], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _kept_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, cuts = [], []
        for packed, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            _, spans, kept = _cut(packed, spans)
            texts.append(None if packed is None else kept.decode("utf-8", "ignore"))
            cuts.append([{"start": a, "end": b} for a, b in spans])
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[2:], pa.array(texts, pa.string()), pa.array(cuts, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))],
            names=[*batch.schema.names[2:], "_kept", "_cuts"],
        )


def _joined(docs: DataFrame, id_column: str, text: str, others: list[str], length: int, trigger: int, max_phrases: int) -> DataFrame:
    keyed = with_key(docs, id_column, text, "_key")
    spans = repeated_spans(keyed, "_key", text, length=length, trigger=trigger, max_phrases=max_phrases)
    lists = spans.groupBy(F.col("key").alias("_key")).agg(F.collect_list(F.struct("lo", "hi")).alias("_spans"))
    texts = keyed.withColumn("_text", F.col(text)).select("_key", "_text", *others)
    return packed_texts(texts, "_key", "_text", *others).join(lists, "_key", "left")


def repeat_digests(docs: DataFrame, id_column: str = "doc_id", text: str = "text", *, length: int = 200, trigger: int = TRIGGER, max_phrases: int = COMPARE) -> DataFrame:
    """Per row: its bytes, the removed ones, the removed runs and the digest of what is kept.

    Null and empty texts have no bytes and keep none; texts under ``length`` bytes are kept whole.
    Rows that are equal in id and text count as copies of each other. Null ids stay null.
    """
    source = docs.select(F.col(id_column).cast("long").alias("_id"), F.col(text).alias("_body"))
    joined = _joined(source, "_id", "_body", ["_id"], length, trigger, max_phrases)
    return joined.select("_id", "_text", "_spans").mapInArrow(_digests, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, id_column: str = "doc_id", text: str = "text", *, length: int = 200, trigger: int = TRIGGER, max_phrases: int = COMPARE) -> DataFrame:
    """The rows with repeated bytes cut from ``text`` and the runs in ``cuts`` (start, end in bytes of the old text).

    Parts of a character that a cut leaves behind go too. Null texts stay null.
    """
    plain = docs.select(*(F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(docs.columns)))
    names = plain.columns
    joined = _joined(plain, names[docs.columns.index(id_column)], names[docs.columns.index(text)], [c for c, o in zip(names, docs.columns) if o != text], length, trigger, max_phrases)
    others = [c for c, o in zip(names, docs.columns) if o != text]
    kinds = {f.name: f.dataType.simpleString() for f in plain.schema.fields}
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in others), "_kept string, _cuts array<struct<start:bigint,end:bigint>>"])
    out = joined.select("_text", "_spans", *others).mapInArrow(_kept_texts, schema)
    return out.select(*(F.col("_kept" if o == text else c).alias(o) for c, o in zip(names, docs.columns)), F.col("_cuts").alias("cuts"))
