"""Toxicity by a chain of sparse linear classifiers, each fed the earlier categories' probabilities."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm.common import light_batches, semi_by_id, table
from tracewright.llm.ftrl import Sparse, fit, softmax
from tracewright.llm.words import words

#: Buckets of hashed words and word beginnings; one bucket more for the bias, then one for each earlier category.
BUCKETS = 1 << 19
PREFIXES = (4, 5)
#: The chain in order: category and its condition on the labels. The last one is what a document is flagged for.
CONDITIONS = {"low_quality": "quality = 0", "toxic": "toxic = 1"}
#: The chain is fitted on at most this many labelled documents.
TRAIN_ROWS = 8_000
#: Buckets met in fewer documents of the sample are not used.
LEAST_ROWS = 4
FOLDS = 5
THRESHOLD = 0.5


def features(column: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(row, distinct buckets) of whole texts: every word and its first bytes."""
    for w in words(column):
        every = np.stack([w.hashes, *[w.prefixes(k) for k in PREFIXES]], 1) & np.uint64(BUCKETS - 1)
        at = 0
        for i, n in enumerate(w.counts.tolist()):
            yield w.first + i, np.unique(every[at : at + n]).astype(np.int64)
            at += n


@dataclass
class Chain:
    categories: list[str]
    weights: list[np.ndarray]  # of log-odds, for each category

    def row(self, buckets: np.ndarray, earlier: list[float]) -> tuple[np.ndarray, np.ndarray]:
        more = BUCKETS + np.arange(1 + len(earlier))
        return np.append(buckets, more).astype(np.int32), np.concatenate([np.ones(len(buckets) + 1), earlier]).astype(np.float32)

    def predict(self, buckets: np.ndarray) -> list[float]:
        out: list[float] = []
        for w in self.weights:
            at, values = self.row(buckets, out)
            out.append(float(1 / (1 + np.exp(-np.clip(values @ w[at], -30, 30)))))
        return out


def _fit(x: Sparse, y: np.ndarray, size: int) -> np.ndarray:
    if not len(y):
        return np.zeros(size)
    w = fit(x, y.astype(np.int64), 2, size, alpha=1.0, l1=2.0, l2=0.01, epochs=6)
    return w[:, 1] - w[:, 0]


def _with_earlier(flat: np.ndarray, bounds: np.ndarray, earlier: np.ndarray) -> Sparse:
    """The rows of buckets, each followed by the bias and the probabilities of earlier categories; made in place, since the driver holds it."""
    more = 1 + earlier.shape[1]
    ends = bounds + more * np.arange(len(bounds))
    last = (ends[1:, None] - more + np.arange(more)).ravel()
    features, values, own = np.empty(ends[-1], np.int32), np.ones(ends[-1], np.float32), np.ones(ends[-1], bool)
    own[last] = False
    features[own] = flat
    features[last] = np.tile(BUCKETS + np.arange(more), len(earlier))
    values[last] = np.column_stack([np.ones(len(earlier)), earlier]).ravel()
    return Sparse(features, values, ends)


def _probabilities(x: Sparse, w: np.ndarray) -> np.ndarray:
    return softmax(np.stack([np.zeros(len(x.bounds) - 1), x.times(w[:, None])[:, 0]], 1))[:, 1]


def _fold_fits(shared, size: int):
    """Fits of the folds named by the rows: for a fold, the unseen probabilities of its rows; for number FOLDS, the weights from all rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, y = shared.value
        fold = np.arange(len(y)) % FOLDS
        for batch in batches:
            for f in batch.column(0).to_pylist():
                if f == FOLDS:
                    w = _fit(x, y, size)
                    at = np.flatnonzero(w)
                    values = w[at]
                else:
                    at = np.flatnonzero(fold == f)
                    inside = np.flatnonzero(fold != f)
                    values = _probabilities(x.take(at), _fit(x.take(inside), y[inside], size))
                yield pa.RecordBatch.from_arrays([pa.array([f]), pa.array([at.astype(np.int32)], pa.list_(pa.int32())), pa.array([values], pa.list_(pa.float64()))], names=["fold", "at", "value"])

    return run


def train_chain(spark: SparkSession, rows: list[np.ndarray], labels: np.ndarray, categories: list[str]) -> Chain:
    """A chain for labels (rows x categories). Later models are trained on out-of-fold probabilities of earlier ones.

    The bounded sample is broadcast; each fold and the fit on all rows is one task. The folds of a category run side by side,
    categories one after the other.
    """
    chain, size = Chain(categories, []), BUCKETS + 1 + len(categories)
    flat = np.concatenate([np.empty(0, np.int32), *rows], dtype=np.int32, casting="unsafe")
    used = np.bincount(flat, minlength=BUCKETS)[flat] >= LEAST_ROWS
    flat, bounds = flat[used], np.concatenate([[0], np.cumsum(used)])[np.cumsum([0, *map(len, rows)])]
    earlier = np.zeros((len(rows), 0))
    for k in range(len(categories)):
        shared = spark.sparkContext.broadcast((_with_earlier(flat, bounds, earlier), labels[:, k]))
        first = FOLDS if k + 1 == len(categories) else 0
        fits = spark.range(first, FOLDS + 1, 1, FOLDS + 1 - first).mapInArrow(_fold_fits(shared, size), "fold bigint, at array<int>, value array<double>").toArrow().to_pydict()
        weights, unseen = np.zeros(size), np.zeros(len(rows))
        for f, at, value in zip(fits["fold"], fits["at"], fits["value"]):
            (weights if f == FOLDS else unseen)[at] = value
        chain.weights.append(weights)
        earlier = np.column_stack([earlier, unseen])
        shared.destroy()
        del shared
    return chain


def train(docs: DataFrame, labels: DataFrame, conditions: dict[str, str] = CONDITIONS) -> Chain:
    """A chain from labelled documents: a hash of doc_id picks TRAIN_ROWS of them at most.

    The ids of the sample are few, so their texts are fetched with a checked broadcast. Where a doc_id has several labels
    or texts, the least label and the least set of buckets are learned from.
    """
    light_batches(docs.sparkSession)
    names = list(conditions)
    truth = labels.where("doc_id is not null").select("doc_id", *[F.expr(c).cast("int").alias(n) for n, c in conditions.items()])
    for n in names:
        truth = truth.where(F.col(n).isNotNull())
    truth = truth.groupBy("doc_id").agg(F.min(F.struct(*names)).alias("l")).select("doc_id", "l.*")
    count = truth.count()
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("toxicity")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    few = truth.where(draw <= 0.9 * TRAIN_ROWS / max(count, 1)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_ROWS).collect()
    if not few:
        return Chain(names, [np.zeros(BUCKETS + 1 + len(names)) for _ in names])
    spark = docs.sparkSession
    ids = spark.createDataFrame([(int(r["doc_id"]),) for r in few], "doc_id bigint")
    sample = semi_by_id(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), ids, "doc_id")
    hashed = sample.mapInArrow(_hashed, "doc_id bigint, buckets array<int>").groupBy("doc_id").agg(F.min("buckets").alias("buckets")).toArrow()
    where = {i: n for n, i in enumerate(hashed["doc_id"].to_pylist())}
    known = sorted((r for r in few if r["doc_id"] in where), key=lambda r: r["doc_id"])
    flat, ends = _lists(hashed["buckets"])
    rows = [flat[ends[where[r["doc_id"]]] : ends[where[r["doc_id"]] + 1]] for r in known]
    return train_chain(spark, rows, np.array([[r[n] for n in names] for r in known], np.int64).reshape(-1, len(names)), names)


def _lists(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(values, bounds) of a column of lists without nulls."""
    lists = column.combine_chunks()
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    return lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [b.astype(np.int32) for _, b in features(batch.column(1))]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int32()))], names=["doc_id", "buckets"])


def _scored(shared, categories: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = [shared.value.predict(b) for _, b in features(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array([x[k] for x in p], pa.float64()) for k in range(len(categories))]], names=["doc_id", *[f"p_{c}" for c in categories]]
            )

    return run


def toxicity(docs: DataFrame, labels: DataFrame, conditions: dict[str, str] = CONDITIONS) -> DataFrame:
    """doc_id and a probability p_<category> for every row of docs, from its whole text.

    The categories are predicted in the order of conditions; each model sees the words, word
    beginnings and the probabilities of the categories before it. Null or empty text has no words, so it gets
    the models' prior. Labels that are null are not learned from; without labels all probabilities are
    0.5. Repeated rows are scored one by one; a null doc_id is carried along; other columns are ignored.
    """
    names = list(conditions)
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, conditions))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(_scored(shared, names), "doc_id bigint, " + ", ".join(f"p_{n} double" for n in names))


def toxic_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents whose probability of the last category is above the threshold, with all probabilities."""
    return toxicity(docs, labels).where(F.col("p_toxic") > threshold)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxic_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op2_toxicity": op2_toxicity}
ORACLES: dict[str, str] = {}
