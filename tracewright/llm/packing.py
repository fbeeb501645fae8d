"""Packing token sequences of equal length with balanced attention cost."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from heapq import heappop, heappush, heapify

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from tracewright.llm.common import light_batches, released, table
from tracewright.llm.tokens import encoded

SEQUENCE = 2048
#: Cost of a piece of n tokens: LINEAR * n + QUADRATIC * n * n (attention inside a piece).
LINEAR, QUADRATIC = 1.0, 1.0 / 1024
#: Tokens that are packed together; bounds a task's memory whatever the partition holds.
WINDOW = 4_000_000

SCHEMA = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"
_NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


def pack(sizes: list[int], capacity: int = SEQUENCE) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of the pieces of documents of given sizes.

    What a document has beyond whole sequences is cut off first; each cut is a full sequence. The
    rest go, largest first, to the sequence of lowest cost that has room. Where the room is smaller
    than the document, the room is filled and the remainder waits its turn among the smaller ones. There are only as
    many sequences as the tokens need, so the free room of all of them together is less than one sequence.
    """
    pieces, wait = [], []
    sequence = 0
    for doc, size in enumerate(sizes):
        full = (size - 1) // capacity if size else 0
        for k in range(full):
            pieces.append((doc, k * capacity, capacity, sequence, 0))
            sequence += 1
        if size:
            heappush(wait, (full * capacity - size, doc, full * capacity))
    bins = -(-sum(-w[0] for w in wait) // capacity)
    open_ = [(0.0, sequence + i, 0) for i in range(bins)]
    heapify(open_)
    while wait:
        left, doc, start = heappop(wait)
        cost, at, used = heappop(open_)
        take = min(-left, capacity - used)
        pieces.append((doc, start, take, at, used))
        if used + take < capacity:
            heappush(open_, (cost + LINEAR * take + QUADRATIC * take * take, at, used + take))
        if take < -left:
            heappush(wait, (left + take, doc, start + take))
    return pieces


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    base = TaskContext.get().partitionId() << 36
    ids, flats, counts, held = [], [], [], 0

    def flush():
        nonlocal base, ids, flats, counts, held
        sizes, flat = np.concatenate(counts), np.ascontiguousarray(np.concatenate(flats), "<u4")
        first = np.cumsum(sizes) - sizes
        pieces = pack(sizes.tolist())
        doc, start, length, sequence, offset = (np.array(c, np.int64) for c in zip(*pieces))
        at = first[doc] + start
        crc = [zlib.crc32(flat[a : a + n]) for a, n in zip(at.tolist(), length.tolist())]
        out = [pa.concat_arrays(ids).take(pa.array(doc)), start, length, pa.array(crc, pa.int64()), sizes[doc], base + sequence, offset]
        base += int(sequence.max()) + 1
        ids, flats, counts, held = [], [], [], 0
        return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in out], names=_NAMES)

    for batch in batches:
        for first, flat, n in encoded(batch):
            ids.append(batch.column(0).slice(first, len(n)))
            flats.append(flat)
            counts.append(n)
            held += len(flat)
            if held >= WINDOW:
                yield flush()
    if held:
        yield flush()


def pack_documents(docs: DataFrame) -> DataFrame:
    """Pieces of all documents in sequences of at most SEQUENCE tokens; see pack().

    Each task packs what it reads, window by window, so nothing is shuffled and a sequence holds
    documents of one input split. The sequences of a window have less than SEQUENCE tokens of free room together, so padding
    is below SEQUENCE / WINDOW = 0.05 % in windows that are full. sequence_id is unique over the
    table: the task's number, then a running number. The result depends on how the input is split.

    Null text counts as empty: one piece with the end id only. A null doc_id is carried along;
    repeated rows are documents of their own. Other columns are ignored. An empty table has no pieces.
    """
    light_batches(docs.sparkSession)
    return docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"]).mapInArrow(released(_packed), SCHEMA)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op5_packing": op5_packing}
ORACLES: dict[str, str] = {}
