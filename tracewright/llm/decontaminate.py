"""Benchmark passages in documents, edits allowed: CGK embedding, bit-sampling LSH, exact edit distance."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm.common import light_batches, released, table
from tracewright.llm.words import mix, words

#: Share of an item's words that may be edited (floor of the product).
EDITS = 0.2
#: Recall that the repetitions must reach on items edited as much as allowed.
TARGET = 0.95
#: Symbols of an embedding that make up one key.
SAMPLED = 3
#: Items of twice as many words and more are cut into pieces of at least PIECE words that are embedded on their own.
PIECE = 32
SEED = 11
#: Items of one size class have sizes within this ratio.
RATIO = 1.3
#: Bytes of benchmark text in a block of items (items are dealt to blocks by a hash of their id).
BLOCK_BYTES = 16_000_000
#: Blocks that one pass over the documents searches; with the bytes of a block this bounds what is broadcast at once.
PASS_BLOCKS = 8
#: Cells of the texts that are compared at a time.
CELLS = 400_000
#: Bytes of text whose windows are hashed at a time; smaller slices pay the work of each repetition more often.
SLICE_BYTES = 1_000_000
SCHEMA = "doc_id bigint, item_id bigint, edits int, first_word bigint, item_words int"


def allowed(n: int) -> int:
    return int(EDITS * n)


def _key(symbols: np.ndarray, starts: np.ndarray, steps: np.ndarray, seed: int, r: int) -> np.ndarray:
    """Keys of the windows at starts in repetition r, from the embedding's symbols at the sampled steps.

    A window is read by a random walk: step j emits the symbol under the pointer and moves the
    pointer on if a random bit of (r, j, symbol) is set. Two windows a few edits apart fall into
    step again after each edit, so few emitted symbols differ.
    """
    at, key, wanted = starts.copy(), np.zeros(len(starts), np.uint64), set(steps.tolist())
    for j in range(int(steps[-1]) + 1):
        symbol = symbols[at]
        if j in wanted:
            key = mix(key ^ symbol, 7)
        at += ((symbol ^ (symbol >> np.uint64(29))) * _odd(seed, r, j) >> np.uint64(63)).astype(np.int64)
    return key


@cache
def _odd(seed: int, r: int, j: int) -> np.uint64:
    return mix(np.array([(seed << 40) | (r << 20) | j], np.uint64), 5)[0] | np.uint64(1)


@dataclass
class SizeClass:
    """Items or pieces of items of similar size: the sampling plan and the keys of all repetitions."""

    items: list[int]  # numbers of the pieces
    sizes: np.ndarray
    least: int
    plan: list[np.ndarray] = field(default_factory=list)
    keys: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)  # sorted keys and numbers of pieces
    recall: float = 0.0


def pieces(items: list[np.ndarray]) -> list[tuple[int, int, int]]:
    """(item, first word, words) of what is embedded: short items whole, long ones cut into n // PIECE equal pieces.

    The edits allowed in an item are at most those allowed in its pieces together, before rounding down; so in some piece there are
    no more than that piece allows, and the item is found with the recall of that piece at least.
    """
    out = []
    for i, x in enumerate(items):
        cuts = max(1, len(x) // PIECE)
        bounds = [len(x) * k // cuts for k in range(cuts + 1)]
        out += [(i, a, b - a) for a, b in zip(bounds, bounds[1:]) if b > a]
    return out


def _edited(item: np.ndarray, edits: int, rng: np.random.Generator) -> np.ndarray:
    out = item.tolist()
    for _ in range(edits):
        kind, at = rng.integers(3), int(rng.integers(len(out)))
        new = int(rng.integers(1, 2**63))
        if kind == 0:
            out[at] = new
        elif kind == 1:
            out.insert(at, new)
        elif len(out) > 1:
            del out[at]
    return np.array(out, np.uint64)


def build(items: list[np.ndarray], seed: int = SEED) -> list[SizeClass]:
    """Size classes with as many repetitions as the target recall needs, measured on edited items."""
    order = sorted((len(x), i) for i, x in enumerate(items) if len(x))
    classes: list[SizeClass] = []
    for n, i in order:
        if not classes or n > RATIO * classes[-1].least:
            classes.append(SizeClass([], np.empty(0), n))
        classes[-1].items.append(i)
    for c in classes:
        c.sizes = np.array([len(items[i]) for i in c.items])
        rng = np.random.default_rng(seed + c.least)
        steps = max(1, 2 * c.least - 2)
        tail = np.arange(1, 4, dtype=np.uint64) * np.uint64(977)
        pad = lambda x: np.concatenate([x, np.resize(tail, 3 * c.least)])  # noqa: B023, E731
        sample = [items[i] for i in c.items[:: max(1, len(c.items) // 100)]]
        pairs = [(pad(x), pad(_edited(x, allowed(len(x)), rng))) for x in sample for _ in range(max(1, 200 // len(sample)))]
        both = np.concatenate([y for p in pairs for y in p])
        at = np.cumsum([0, *[len(y) for p in pairs for y in p]])[:-1]
        met = np.zeros(len(pairs), bool)
        while c.recall < TARGET:
            c.plan.append(np.sort(rng.choice(steps, min(SAMPLED, steps), replace=False)))
            keys = _key(both, at, c.plan[-1], seed, len(c.plan) - 1)
            met |= keys[0::2] == keys[1::2]
            c.recall = float(met.mean())
        flat = np.concatenate([pad(items[i]) for i in c.items])
        starts = np.cumsum([0, *[len(items[i]) + 3 * c.least for i in c.items]])[:-1]
        for r, sampled in enumerate(c.plan):
            keys = _key(flat, starts, sampled, seed, r)
            o = np.argsort(keys, kind="stable")
            c.keys.append((keys[o], np.array(c.items)[o]))
    return classes


def edit_distances(items: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """For each row: the least edit distance of an item (all columns) to any run of words of the text row."""
    m, width = texts.shape
    steps = np.arange(width + 1, dtype=np.int32)
    d = np.zeros((m, width + 1), np.int32)
    for i in range(items.shape[1]):
        new = np.empty_like(d)
        new[:, 0] = i + 1
        new[:, 1:] = np.minimum(d[:, :-1] + (texts != items[:, i : i + 1]), d[:, 1:] + 1)
        d = np.minimum.accumulate(new - steps, axis=1) + steps
    return d.min(axis=1)


def _nearest_run(item: np.ndarray, text: np.ndarray) -> int:
    """Where the run of text nearest to item starts, the first one of equals: distances carry their run's start along."""
    step = len(text) + 1
    steps = np.arange(step, dtype=np.int64) * step
    d = np.arange(step, dtype=np.int64)
    for i in range(len(item)):
        new = np.empty_like(d)
        new[0] = (i + 1) * step
        new[1:] = np.minimum(d[:-1] + (text != item[i]) * step, d[1:] + step)
        d = np.minimum.accumulate(new - steps) + steps
    return int(d.min() % step)


class Searcher:
    """What a task needs to search texts for a block of items."""

    def __init__(self, ids: np.ndarray, items: list[np.ndarray]):
        self.ids, self.items = ids, items
        cut = pieces(items)
        self.owner, self.offset = np.array([p[0] for p in cut], np.int64), np.array([p[1] for p in cut], np.int64)
        self.classes = build([items[i][a : a + n] for i, a, n in cut])
        self.vocabulary = np.unique(np.concatenate(items)) if items else np.empty(0, np.uint64)
        self.known = np.zeros(1 << 22, bool)
        self.known[(self.vocabulary & np.uint64((1 << 22) - 1)).astype(np.int64)] = True

    def candidates(self, h: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(piece, start) pairs whose keys meet; h holds the words of several rows in turn.

        Only windows in which enough words occur in some item at all can be within the allowed edits
        of an item of that size; the others are not embedded.
        """
        inside = self.known[(h & np.uint64((1 << 22) - 1)).astype(np.int64)]
        where = np.flatnonzero(inside)
        hit = np.minimum(np.searchsorted(self.vocabulary, h[where]), max(len(self.vocabulary) - 1, 0))
        inside[where] = self.vocabulary[hit] == h[where]
        total = np.concatenate([[0], np.cumsum(inside, dtype=np.int32)])
        last = np.repeat(np.cumsum(counts), counts)  # end of each word's row
        found = []
        for c in self.classes:
            starts = np.zeros(len(h), bool)
            here = np.arange(len(h))
            for n in np.unique(c.sizes).tolist():
                ends = np.minimum(here + n, last)
                starts |= total[ends] - total[:-1] >= n - allowed(n)
            starts = np.flatnonzero(starts)
            if not len(starts):
                continue
            padded = np.concatenate([h, np.resize(np.arange(1, 4, dtype=np.uint64) * np.uint64(977), 3 * c.least)])
            for r, (names, items) in enumerate(c.keys):
                keys = _key(padded, starts, c.plan[r], SEED, r)
                lo = np.searchsorted(names, keys)
                met = np.flatnonzero(names[np.minimum(lo, len(names) - 1)] == keys)
                if len(met):
                    hi = lo.copy()
                    hi[met] = np.searchsorted(names, keys[met], "right")
                    n = (hi - lo)[met]
                    take = np.repeat(lo[met] - np.cumsum(n) + n, n) + np.arange(n.sum())
                    found.append(np.stack([items[take], np.repeat(starts[met], n)], 1))
        if not found:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        pairs = np.unique(np.concatenate(found), axis=0)
        return pairs[:, 0], pairs[:, 1]

    def hits(self, h: np.ndarray, counts: np.ndarray) -> Iterator[tuple[int, int, int, int]]:
        """(row, item, edits, first word) of the best place of each item in each row.

        A piece that begins at a place tells where its item begins, give or take the edits; places as near as that are looked at together.
        """
        piece, start = self.candidates(h, counts)
        row_end = np.cumsum(counts)
        sizes = np.array([len(x) for x in self.items], np.int64)
        edits = np.array([allowed(n) for n in sizes.tolist()], np.int64)
        item, row = self.owner[piece], np.searchsorted(row_end, start, "right")
        start = (start - self.offset[piece]) // (edits[item] + 1) * (edits[item] + 1)
        places = np.unique(np.stack([item, row, start], 1), axis=0) if len(item) else np.empty((0, 3), np.int64)
        item, row, start = places.T
        best: dict[tuple[int, int], tuple[int, int]] = {}
        for n in np.unique(sizes[item]).tolist():
            k = allowed(n)
            w = np.flatnonzero(sizes[item] == n)
            for block in np.array_split(w, len(w) * (n + 4 * k) // CELLS + 1):
                if not len(block):
                    continue
                at = start[block][:, None] + np.arange(-k - 3, n + 3 * k + 3)[None, :]
                first = (row_end - counts)[row[block]]
                ok = (at >= first[:, None]) & (at < row_end[row[block]][:, None])
                texts = np.where(ok, h[np.clip(at, 0, len(h) - 1)], np.uint64(0))
                d = edit_distances(np.stack([self.items[i] for i in item[block]]), texts)
                for x in np.flatnonzero(d <= k).tolist():
                    key = int(row[block[x]]), int(item[block[x]])
                    if int(d[x]) <= best.get(key, (n, 0))[0]:
                        place = int(at[x, 0] - first[x]) + _nearest_run(self.items[key[1]], texts[x])
                        best[key] = min(best.get(key, (n + 1, 0)), (int(d[x]), max(place, 0)))
        for (r, i), (d, place) in best.items():
            yield r, i, d, place


def _found(searchers: list[Searcher], column: pa.Array) -> Iterator[tuple[int, int, int, int, int]]:
    """(row, item id, edits, first word, item words) of a column of texts: the best place of each item id in each row."""
    for w in words(column, slice_bytes=SLICE_BYTES):
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for s in searchers if len(w.hashes) else []:
            for row, i, edits, place in s.hits(w.hashes, w.counts):
                key = w.first + row, int(s.ids[i])
                best[key] = min(best.get(key, (edits, place, len(s.items[i]))), (edits, place, len(s.items[i])))
        for (row, item), (edits, place, size) in best.items():
            yield row, item, edits, place, size


def _search(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searchers = [b.value for b in shared]
        for batch in batches:
            out = list(_found(searchers, batch.column(1)))
            if out:
                row, item, edits, place, sizes = (np.array(x, np.int64) for x in zip(*out))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(row)), pa.array(item), pa.array(edits.astype(np.int32)), pa.array(place), pa.array(sizes.astype(np.int32))],
                    names=["doc_id", "item_id", "edits", "first_word", "item_words"],
                )

    return run


def _clean(shared):
    """Whole rows whose text holds no item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        searchers = [b.value for b in shared]
        for batch in batches:
            keep = np.ones(len(batch), bool)
            keep[[hit[0] for hit in _found(searchers, batch.column(batch.schema.names.index("text")))]] = False
            yield batch.filter(pa.array(keep))

    return run


def _passes(docs: DataFrame, benchmark: DataFrame) -> Iterator[list]:
    """Broadcast searchers, PASS_BLOCKS of them at most for one pass over the documents; an item id is in one block only."""
    spark = docs.sparkSession
    light_batches(spark)
    items = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text")).where("text is not null and item_id is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = int(size // BLOCK_BYTES) + 1
    for first in range(0, blocks, PASS_BLOCKS):
        shared = []
        for k in range(first, min(first + PASS_BLOCKS, blocks)):
            block = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).distinct().orderBy("item_id", "text").toPandas()
            split = [(i, x) for i, t in zip(block["item_id"], block["text"]) for w in words(pa.array([t])) if len(x := w.hashes)]
            shared.append(spark.sparkContext.broadcast(Searcher(np.array([i for i, _ in split], np.int64), [x for _, x in split])))
        yield shared


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, edits, first_word, item_words): items found in documents.

    An item occurs where some run of a document's words is at most EDITS of the item's words away in edit
    distance. Words are runs of letters and digits, A-Z lower-cased. Whole texts are searched, a
    window at every word. Windows and items are embedded and keyed as in _key; the number of
    repetitions is set for each size class by measuring recall on edited items; each candidate is
    verified by the exact distance. Items of 2 * PIECE words and more are embedded piece by piece (see pieces). first_word is where
    the nearest run begins, the first of equals. The benchmark is broadcast in blocks of about BLOCK_BYTES; a pass over
    the documents searches PASS_BLOCKS of them while it holds a batch's hashed words, so its size may grow.

    Null, empty or word-less texts and items match nothing. A null doc_id is reported as null; repeated rows
    are reported as often as they occur. An item_id with several texts is reported once for a row, at the best place of any
    of them. Other columns are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return reduce(DataFrame.unionByName, [rows.mapInArrow(released(_search(shared)), SCHEMA) for shared in _passes(docs, benchmark)])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the rows whose text holds a benchmark item; columns unchanged.

    Each row is judged by its own text, whatever its doc_id: of rows with one doc_id only the contaminated ones go, and a
    contaminated row with a null doc_id goes too. Rows with null text stay.
    """
    return reduce(lambda left, shared: left.mapInArrow(released(_clean(shared)), docs.schema), _passes(docs, benchmark), docs)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op7_decontamination": op7_decontamination}
ORACLES: dict[str, str] = {}
