"""Near-duplicates by SimHash, linked through hierarchical indexes in Gray order.

Equal fingerprints are one node, so a third of all rows with one text is one node too. With the
64 bits cut into B blocks, fingerprints within ``distance`` bits of each other agree in at least
B - distance whole blocks. A table row is made for each choice of so many blocks, and only
fingerprints with the same bits there meet. B grows with the logarithm of the fingerprints'
number, which changes the work and never the links.

The fingerprints that meet are sorted by Gray rank, where neighbours share most bits. Eight in a
row form a node that keeps the bits they share; eight nodes form a node above, and bits shared
there are taken out below. A query adds up differences from the root down and drops a node with
all below it once they exceed the distance. Links leave as a spanning forest, not as pairs.
Groups beyond ``max_group`` fingerprints are cut into parts and every two parts meet in a cell.

Four bits are a narrow test: texts of which 80 % of the five-word shingles are equal differ in
about ten bits of a fingerprint over these shingles. ``similar_documents`` is for them. It takes the
links of fingerprints as above and adds wider ones: a fingerprint of 512 bits (the sketch) is searched
by the same index, in Gray order, within a margin. Tables of equal bits would be too many there, so
cells are keys over the least hashes of the shingles, which texts share as often as they share
shingles, wherever an edit lies. Each group of possible links then meets once with its texts, where
the shingles themselves decide.
"""

from __future__ import annotations

import itertools
import math
import random
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import map_rows, written
from tallyspark.llm.components import components

DISTANCE = 4
FAN = 8
#: Query and node pairs held at once in a search.
FRONTIER = 1 << 20


def fingerprint(text: str | None, size: int = 4, seed: int = 42) -> tuple[int]:
    """SimHash of the shingles of ``size`` words, as a signed long; zero without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return (0,)
    joined = b" ".join(words)
    ends = list(itertools.accumulate(map(len, words), lambda a, b: a + 1 + b))
    starts = [0, *(e + 1 for e in ends[:-1])]
    spans = zip(starts, ends[size - 1 :]) if len(words) >= size else [(0, len(joined))]
    digest = xxhash.xxh64_intdigest
    return (majority(np.array([digest(joined[a:b], seed) for a, b in spans], "<u8")),)


def majority(hashes: np.ndarray) -> int:
    """The bits that more than half of the hashes have, as a signed long."""
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        counts += np.unpackbits(hashes[i : i + (1 << 14)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def mixed(hashes: np.ndarray, salt: int) -> np.ndarray:
    """Other hashes of what has these hashes."""
    x = hashes + np.uint64(salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


#: Longs in a sketch, and standard errors by which its test is wider than the similarity.
SKETCH, WIDER = 8, 8
#: Least hashes in the key of a cell, and shingles that a part of a group may hold.
LEAST, MAX_SHINGLES = 5, 1 << 22


def shingle_hashes(words: list[bytes], size: int) -> np.ndarray:
    """Hashes of the distinct shingles, sorted; all words are one shingle if they are fewer than its size."""
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(b" ".join(words[i : i + size])) for i in range(max(1, len(words) - size + 1))], np.uint64))


def text_hash(words: list[bytes]) -> int:
    return signed(xxhash.xxh64_intdigest(b" ".join(words))) if words else 0


def keys_needed(similarity: float, loss: float) -> int:
    """Keys of which two texts of that similarity share none with the probability ``loss``."""
    met = similarity**LEAST
    return 1 if met >= 1 else math.ceil(math.log(loss) / math.log(1 - met))


def least_keys(shingles: np.ndarray, count: int) -> np.ndarray:
    """Keys over the least of the shingles under random orders, LEAST orders to a key."""
    factors = mixed(np.arange(1, count * LEAST + 1, dtype=np.uint64), 99)[:, None] | np.uint64(1)
    least = np.full(count * LEAST, ~np.uint64(0))
    for i in range(0, len(shingles), 1 << 12):
        least = np.minimum(least, (shingles[i : i + (1 << 12)] * factors).min(axis=1))
    keys = np.zeros(count, np.uint64)
    for k, column in enumerate(least.reshape(count, LEAST).T):
        keys = mixed(keys ^ column, k + 1)
    return keys


def sketch(text: str | None, size: int = 5, keys: int = 1) -> tuple[int, ...]:
    """A hash of the words with A-Z lower-cased, the number of distinct shingles, the sketch over them, and their keys."""
    words = (text or "").encode().lower().split()
    if not words:
        return (0,) * (2 + SKETCH + keys)
    shingles = shingle_hashes(words, size)
    bits = (majority(mixed(shingles, k + 1)) for k in range(SKETCH))
    return text_hash(words), len(shingles), *bits, *map(int, least_keys(shingles, keys).view(np.int64))


def gray_rank(x: np.ndarray) -> np.ndarray:
    """Place of each code in Gray order."""
    for shift in (1, 2, 4, 8, 16, 32):
        x = x ^ (x >> np.uint64(shift))
    return x


def gray_order(codes: np.ndarray, group: np.ndarray) -> np.ndarray:
    """The order by group and, within it, Gray rank of codes of one or more words, the first word the highest."""
    ranks, odd = [], np.zeros(len(codes), bool)
    for word in codes.reshape(len(codes), -1).T:
        ranks.append(np.where(odd, ~gray_rank(word), gray_rank(word)))
        odd = odd ^ (np.bitwise_count(word) % 2 == 1)
    return np.lexsort((*reversed(ranks), group))


class GrayIndex:
    """Hierarchies over fingerprints sorted by group and Gray rank, one for each group, searched together.

    A fingerprint is a long or a row of them. Of a level: the bits that a node adds to what those
    above it share, their values, its first and last child, and the first and last fingerprint below it.
    """

    def __init__(self, codes: np.ndarray, group: np.ndarray) -> None:
        self.codes, self.levels = codes.reshape(len(codes), -1), []
        self.group = group
        mask, value, of = np.full(self.codes.shape, ~np.uint64(0)), self.codes, group
        low = high = np.arange(len(codes))
        while True:
            first_of = np.concatenate([[True], of[1:] != of[:-1]])
            self.levels.append([mask, value, None, low, high])
            if first_of.all():
                break
            start = np.maximum.accumulate(np.where(first_of, np.arange(len(of)), 0))
            first = np.flatnonzero(first_of | ((np.arange(len(of)) - start) % FAN == 0))
            end = np.append(first[1:], len(of))
            shared = np.bitwise_and.reduceat(mask, first) & ~(np.bitwise_or.reduceat(value, first) ^ np.bitwise_and.reduceat(value | ~mask, first))
            above = np.repeat(shared, end - first, axis=0)
            self.levels[-1][:2] = mask & ~above, value & ~above
            mask, value, of, low, high = shared, value[first] & shared, of[first], low[first], high[end - 1]
            self.levels.append([first, end])
        self.roots = of

    def links(self, group: np.ndarray, distance: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs of places, the smaller first, within the distance and of one group."""
        yield from self._from(np.arange(len(group)), distance, None)

    def forest(self, distance: float) -> np.ndarray:
        """The smallest place that each place is linked with.

        Of a group the first one is asked for, then the next two, the next four and so on; a node whose
        fingerprints are all linked with the one that asks is dropped, since they add nothing to it.
        """
        label = np.arange(len(self.codes))
        first = np.concatenate([[0], np.flatnonzero(self.group[1:] != self.group[:-1]) + 1]) if len(label) else label
        turn = np.log2(np.arange(len(label)) - np.repeat(first, np.diff(np.append(first, len(label)))) + 1).astype(int)
        for t in range(turn.max(initial=-1) + 1):
            edges = [(low, high) for _, _, _, low, high in self.levels[::2]]
            kept = [(np.minimum.reduceat(label, low), np.maximum.reduceat(label, low)) for low, _ in edges]
            for a, b in self._from(np.flatnonzero(turn == t), distance, (label.copy(), kept)):
                merge(label, a, b)
        return label

    def _from(self, queries: np.ndarray, distance: float, known: tuple | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        root = np.searchsorted(self.roots, self.group[queries])
        for start in range(0, len(queries), 1 << 13):
            query = queries[start : start + (1 << 13)]
            yield from self._search(len(self.levels) - 1, query, root[start : start + (1 << 13)], np.zeros(len(query), np.uint16), distance, known)

    def _search(self, level: int, query: np.ndarray, node: np.ndarray, differences: np.ndarray, distance: float, known: tuple | None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        mask, value, _, _, last = self.levels[level]
        keep = last[node] > query
        if known:
            label, (low, high) = known[0][query], (x[node] for x in known[1][level // 2])
            keep &= (low != label) | (high != label)
        query, node, differences = query[keep], node[keep], differences[keep]
        differences = differences + np.bitwise_count((self.codes[query] & mask[node]) ^ value[node]).sum(axis=1, dtype=np.uint16)
        keep = differences <= distance
        query, node, differences = query[keep], node[keep], differences[keep]
        if level == 0:
            if len(query):
                yield query, node
            return
        first, end = self.levels[level - 1]
        width = max(1, FRONTIER // FAN // self.codes.shape[1])
        for i in range(0, len(query), width):
            q, n, d = query[i : i + width], node[i : i + width], differences[i : i + width]
            count = end[n] - first[n]
            child = np.repeat(first[n] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
            yield from self._search(level - 2, np.repeat(q, count), child, np.repeat(d, count), distance, known)


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Give all that is linked, now by a and b too, the smallest place of it."""
    while True:
        x, y = label[a], label[b]
        differ = x != y
        if not differ.any():
            return
        np.minimum.at(label, np.maximum(x, y)[differ], np.minimum(x, y)[differ])
        while (label[label] != label).any():
            label[:] = label[label]


def forest(n: int, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest place that each place is linked with, over any number of links."""
    label = np.arange(n)
    for a, b in links:
        merge(label, a, b)
    return label


def _whole_cells(batches: Iterator[pa.RecordBatch], words: int = 1) -> Iterator[list[np.ndarray]]:
    """Columns of rows (cell, words of a fingerprint, ...) sorted by cell, in groups of whole cells, each in Gray order."""
    held, size = [], 0
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            size += batch.num_rows
        if not size or (batch is not None and size < 20_000):
            continue
        columns = [np.concatenate(c) for c in zip(*held)]
        cut = size if batch is None else int(np.searchsorted(columns[0], columns[0][-1]))
        held, size = [[c[cut:] for c in columns]], size - cut
        if cut:
            order = gray_order(np.stack([c[:cut] for c in columns[1 : 1 + words]], axis=1).view(np.uint64), columns[0][:cut])
            yield [c[:cut][order] for c in columns]


def _labels_of(cell: np.ndarray, codes: np.ndarray, distance: float) -> np.ndarray:
    group = np.cumsum(np.concatenate([[True], cell[1:] != cell[:-1]])) - 1
    return GrayIndex(codes, group).forest(distance)


def _edges(batches: Iterator[pa.RecordBatch], distance: int) -> Iterator[pa.RecordBatch]:
    """A spanning forest of the links in each cell."""
    for cell, fp in _whole_cells(batches):
        label = _labels_of(cell, fp.view(np.uint64), distance)
        linked = np.flatnonzero(label != np.arange(len(cell)))
        yield pa.RecordBatch.from_arrays([pa.array(fp[linked]), pa.array(fp[label[linked]])], names=["a", "b"])


def spread(count: int, near: Callable[[int, np.ndarray], np.ndarray]) -> np.ndarray:
    """The first place that each place reaches by links; ``near`` tests one place against others, and no place is left untested."""
    label, todo = np.arange(count), np.arange(count)
    while len(todo):
        root, todo = todo[0], todo[1:]
        queue = [root]
        while queue and len(todo):
            found = near(queue.pop(), todo)
            if found.any():
                label[todo[found]] = root
                queue.extend(todo[found])
                todo = todo[~found]
    return label


def _maybe_similar(batches: Iterator[pa.RecordBatch], limit: float) -> Iterator[pa.RecordBatch]:
    """In each cell a spanning forest of all pairs whose sketches differ in no more bits than the limit."""
    for cell, *parts, text in _whole_cells(batches, SKETCH):
        label = _labels_of(cell, np.stack(parts, axis=1).view(np.uint64), limit)
        found = np.flatnonzero(label != np.arange(len(cell)))
        yield pa.RecordBatch.from_arrays([pa.array(text[found]), pa.array(text[label[found]])], names=["a", "b"])


def similar_places(shingles: list[np.ndarray], similarity: float) -> np.ndarray:
    """The first place that each place reaches by pairs of at least that Jaccard similarity, counted exactly."""
    sizes = np.array([len(x) for x in shingles])
    numbers = np.unique(np.concatenate(shingles), return_inverse=True)[1]
    own = np.split(numbers, np.cumsum(sizes)[:-1])
    mark, held = np.zeros(len(numbers), bool), (None, None, None)

    def near(x: int, others: np.ndarray) -> np.ndarray:
        nonlocal held
        if held[0] is not others:
            held = others, np.concatenate([own[i] for i in others]), np.concatenate([[0], np.cumsum(sizes[others])[:-1]])
        mark[own[x]] = True
        both = np.add.reduceat(mark[held[1]], held[2], dtype=np.int64)
        mark[own[x]] = False
        return both / (sizes[x] + sizes[others] - both) >= similarity

    return spread(len(shingles), near)


def _similar(batches: Iterator[pa.RecordBatch], size: int, similarity: float) -> Iterator[pa.RecordBatch]:
    """Of rows (cell, text, value) sorted by cell, a spanning forest of the similar texts in each cell."""
    rows = (row for batch in batches for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)))
    edges: list[tuple[int, int]] = []
    out = lambda: pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*edges) if edges else ([], []))], names=["a", "b"])
    for _, members in itertools.groupby(rows, lambda r: r[0]):
        texts, shingles = zip(*((text, shingle_hashes(value.as_py().encode().lower().split(), size)) for _, text, value in members))
        edges += [(texts[i], texts[k]) for i, k in enumerate(similar_places(shingles, similarity)) if i != k]
        if len(edges) > 10_000:
            yield out()
            edges = []
    yield out()


def tables(count: int, distance: int) -> list[int]:
    """Masks of the bits that must agree; their number of bits follows the logarithm of the count."""
    blocks = distance + 1
    while blocks < 64 and 64 * (blocks - distance) // blocks < math.log2(max(2, count)) + 1:
        blocks += 1
    edges = [64 * i // blocks for i in range(blocks + 1)]
    parts = [((1 << b) - (1 << a)) for a, b in itertools.pairwise(edges)]
    return [sum(c) for c in itertools.combinations(parts, blocks - distance)]


def random_tables(count: int, distance: int, recall: float, seed: int = 1) -> list[int]:
    """Masks of random bits, as many as meet a pair at ``distance`` bits with the given probability.

    A mask has about as many bits as numbers up to the count have, so a cell has few rows by chance.
    """
    size = min(32, max(8, math.ceil(math.log2(max(2, count)))))
    met = math.comb(64 - size, distance) / math.comb(64, distance)
    rng = random.Random(seed)
    return [sum(1 << b for b in rng.sample(range(64), size)) for _ in range(math.ceil(math.log(1 - recall) / math.log(1 - met)))]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def met_cells(rows: DataFrame, masks: list[int], max_group: int) -> DataFrame:
    """The rows (with a long column fp) once for each cell in which they meet others, with the cell's hash."""
    own = [c for c in rows.columns if c != "fp"]
    keyed = rows.select(*own, "fp", F.posexplode(F.array(*(F.lit(signed(m)) for m in masks))).alias("part", "mask"))
    keyed = keyed.select(*own, "fp", F.col("part").cast("short"), F.col("fp").bitwiseAND(F.col("mask")).alias("bits"))
    sizes = keyed.groupBy("part", "bits").count().where("count > 1").select("part", "bits", F.ceil(F.col("count") / max_group).alias("cut"))
    return dealt_cells(keyed, sizes, ["fp", *own])


def dealt_cells(keyed: DataFrame, sizes: DataFrame, own: list[str]) -> DataFrame:
    """The rows whose part and bits are in ``sizes`` with the cell's hash; with more than one cut, once for each cell of two cuts."""
    slot = F.pmod(F.xxhash64(*own), F.col("cut"))
    met = keyed.join(sizes, ["part", "bits"]).select(*own, "part", "bits", slot.alias("own"), F.explode(F.sequence(F.lit(0), F.col("cut") - 1)).alias("other"))
    return met.select(F.xxhash64("part", "bits", F.least("own", "other"), F.greatest("own", "other")).alias("cell"), *own)


def fingerprint_links(fps: DataFrame, distance: int = DISTANCE, max_group: int = 4096) -> DataFrame:
    """(a, b): a spanning set of the links between distinct longs in column fp."""
    cells = met_cells(fps.select("fp"), tables(fps.count(), distance), max_group)
    return cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(lambda b: _edges(b, distance), "a long, b long")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text: str = "text", *, size: int = 4, distance: int = DISTANCE, max_group: int = 4096) -> DataFrame:
    """Per row: doc_id, fp (long) and component_id, the smallest id that links of ``distance`` bits reach.

    Null texts and texts without words have fingerprint zero and are linked like any other. Null
    ids are never the smallest; a component of null ids has a null component_id. Repeated rows are
    answered one by one.
    """
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text"))
    fps = written(_with_fingerprints(source, size), "fingerprints")
    distinct = written(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(fingerprint_links(distinct.select("fp"), distance, max_group)).withColumnRenamed("node", "fp")
    placed = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return fps.join(placed.join(smallest, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def _with_fingerprints(source: DataFrame, size: int) -> DataFrame:
    return map_rows(source, lambda doc_id, text: (doc_id, *fingerprint(text, size)), ["doc_id", "text"], "doc_id long, fp long")


def similar_documents(docs: DataFrame, id_column: str = "doc_id", text: str = "text", *, size: int = 5, similarity: float = 0.8, loss: float = 1e-5, max_group: int = 4096) -> DataFrame:
    """Per row: doc_id and component_id, the smallest id reached by pairs of texts that share ``similarity`` of their shingles.

    Similarity is that of the sets of shingles of ``size`` words (Jaccard), counted exactly on
    64-bit hashes; pairs at the limit count as similar. Links of fingerprints (those of
    ``near_duplicates``, over shingles of ``size``) propose, and so do cells of least hashes: there a
    pair at the limit is met but for a probability of ``loss``, a closer one yet more surely. Texts of equal words are always one. Null
    texts and texts without words are one class; null ids are never the smallest.
    """
    source = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text).alias("text"))
    count = keys_needed(similarity, loss)
    parts, keys = [f"s{i}" for i in range(SKETCH)], [f"k{i}" for i in range(count)]
    schema = ", ".join(f"{c} long" for c in ["doc_id", "text", "n", *parts, *keys])
    rows = written(map_rows(source, lambda doc_id, value: (doc_id, *sketch(value, size, count)), ["doc_id", "text"], schema), "sketches")
    classes = written(rows.groupBy("text", "n", *parts, *keys).agg(F.min("doc_id").alias("least")), "classes")
    keyed = classes.where("n > 0").select("text", F.posexplode(F.array(*keys)).alias("part", "bits"))
    sizes = keyed.groupBy("part", "bits").count().where("count > 1").select("part", "bits", F.ceil(F.col("count") / max_group).alias("cut"))
    cells = dealt_cells(keyed, sizes, ["text"]).join(classes.select("text", *parts), "text").select("cell", *parts, "text")
    angle = math.acos(2 * similarity / (1 + similarity)) / math.pi
    limit = 64 * SKETCH * angle + WIDER * math.sqrt(64 * SKETCH * angle * (1 - angle))
    wide = cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(lambda b: _maybe_similar(b, limit), "a long, b long")
    maybe = components(wide.union(_linked_texts(classes.where("n > 0").select("text", F.col("s0").alias("fp")), max_group)))
    close = _similar_links(source, classes.select("text", "n").join(maybe.withColumnRenamed("node", "text"), "text"), size, similarity, max_group)
    roots = components(close).withColumnRenamed("node", "text")
    placed = classes.select("text", "least").join(roots, "text", "left").withColumn("root", F.coalesce("root", "text"))
    smallest = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.select("doc_id", "text").join(placed.join(smallest, "root").select("text", "component_id"), "text").select("doc_id", "component_id")


def _linked_texts(texts: DataFrame, max_group: int) -> DataFrame:
    """(a, b): a spanning set of the links between the fingerprints of ``texts`` (text, fp), as texts."""
    nodes = written(texts.groupBy("fp").agg(F.min("text").alias("node")), "nodes")
    same = texts.join(nodes, "fp").where("text <> node").select(F.col("text").alias("a"), F.col("node").alias("b"))
    of = lambda side: nodes.select(F.col("fp").alias(side), F.col("node").alias(f"node_{side}"))
    links = fingerprint_links(nodes.select("fp"), DISTANCE, max_group).join(of("a"), "a").join(of("b"), "b")
    return same.union(links.select("node_a", "node_b"))


def _similar_links(source: DataFrame, grouped: DataFrame, size: int, similarity: float, max_group: int) -> DataFrame:
    """(a, b): a spanning set of the exactly similar pairs within each group (text, n, root) of texts."""
    keyed = grouped.select("text", "n", F.lit(0).alias("part"), F.col("root").alias("bits"))
    cut = F.ceil(F.greatest(F.count("*") / max_group, F.sum("n") / MAX_SHINGLES))
    cells = dealt_cells(keyed, keyed.groupBy("part", "bits").agg(cut.alias("cut")), ["text"])
    wanted = written(cells, "cells")
    texts = map_rows(source, lambda value: (text_hash((value or "").encode().lower().split()), value), ["text"], "text long, value string")
    one = texts.join(wanted.select("text").distinct(), "text").dropDuplicates(["text"])
    return wanted.join(one, "text").select("cell", "text", "value").repartition("cell").sortWithinPartitions("cell").mapInArrow(lambda b: _similar(b, size, similarity), "a long, b long")


def first_of_each(docs: DataFrame, groups: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Of ``docs`` one row for each component of ``groups`` (doc_id, component_id), that of its smallest id.

    Rows that share an id count as one. Rows without an id stay.
    """
    stay = groups.where("doc_id = component_id").select(F.col("doc_id").alias("_stays")).distinct()
    names = docs.columns
    plain = docs.select(*(F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(names)))
    own = f"_c{names.index(id_column)}"
    named = plain.join(stay, F.col(own).cast("long") == F.col("_stays"), "left_semi").dropDuplicates([own])
    return named.union(plain.where(F.col(own).isNull())).toDF(*names)
