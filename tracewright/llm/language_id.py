"""Language identification: TF-IDF character n-grams, sparse multinomial regression (FTRL), temperature."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm.common import light_batches, released, table
from tracewright.llm.ftrl import Sparse, fit, softmax, temperature
from tracewright.llm.words import mix

#: Buckets of hashed n-grams and the lengths of n-grams in characters.
BUCKETS, LENGTHS = 1 << 15, (1, 2, 3)
#: The classifier is fitted on at most about this many labelled documents, split evenly over the languages ...
TRAIN_ROWS = 4000
#: ... and at most this many of one language; a quarter of them only set the temperature.
TRAIN_PER_LANG = 800
UNKNOWN = "und"
#: In the pipeline a document is rejected if it has no letter or its score is below this.
LEAST_SCORE = 0.4


def _plain() -> np.ndarray:
    codes = np.arange(128, dtype=np.uint32)
    letter = ((codes >= 97) & (codes <= 122)) | ((codes >= 65) & (codes <= 90))
    return np.where(letter, codes | 32, 32).astype(np.uint32)


_PLAIN = _plain()


def ngram_counts(text: str) -> np.ndarray:
    """Counts of the hashed character n-grams of a whole text; A-Z lower-cased, other ASCII signs and digits are blanks."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    codes = np.where(codes < 128, _PLAIN[np.minimum(codes, 127)], codes).astype(np.uint64)
    out, gram = np.zeros(BUCKETS, np.int64), np.zeros(len(codes), np.uint64)
    for n in range(1, max(LENGTHS) + 1):
        if len(codes) < n:
            break
        gram = gram[: len(codes) - n + 1] * np.uint64(1_114_113) + codes[n - 1 :]
        if n in LENGTHS:
            out += np.bincount((mix(gram, n) >> np.uint64(49)).astype(np.int64), minlength=BUCKETS)
    return out


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float = 1.0

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        counts = ngram_counts(text)
        at = np.flatnonzero(counts)
        values = (1 + np.log(counts[at])) * self.idf[at]
        return at, values / max(np.linalg.norm(values), 1e-12)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        at, values = self.vector(text)
        p = softmax((values @ self.weights[at])[None, :] / self.temperature)[0]
        return self.languages[int(p.argmax())], float(p.max())


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, rows = np.zeros(BUCKETS, np.int64), 0
    for batch in batches:
        for text in batch.column(0):
            df += ngram_counts(text.as_py() or "") > 0
            rows += 1
    at = np.flatnonzero(df)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], rows))], names=["gram", "df"])


def learnable(doc_id: str = "doc_id", lang: str = "lang") -> Column:
    """Rows that may be learned from: a label, and not of the held-out quarter."""
    return F.col(lang).isNotNull() & ~held_out(doc_id)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")), F.lit(4)) == 2, F.lit(False))


def train(docs: DataFrame) -> Model:
    """A model from the labelled rows of docs outside the held-out quarter.

    Document frequencies are taken over all those rows (BUCKETS numbers reach the driver). The
    regression sees a sample that a hash of doc_id picks, bounded by TRAIN_ROWS and TRAIN_PER_LANG.
    """
    light_batches(docs.sparkSession)
    rows = docs.where(learnable()).select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(sizes)
    if not languages:
        return Model([], np.ones(BUCKETS), np.zeros((BUCKETS, 1)))
    found = {r["gram"]: r["df"] for r in rows.select("text").mapInArrow(released(_document_frequencies), "gram bigint, df bigint").groupBy("gram").agg(F.sum("df").alias("df")).collect()}
    df, total = np.zeros(BUCKETS), found.pop(-1, 0)
    df[list(found)] = list(found.values())
    model = Model(languages, np.log((1 + total) / (1 + df)) + 1, np.zeros((BUCKETS, len(languages))))
    each = min(TRAIN_PER_LANG, max(1, TRAIN_ROWS // len(languages)))
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("language")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = None
    for lang, n in sizes.items():
        one = (F.col("lang") == lang) & (draw <= each / n)
        chosen = one if chosen is None else chosen | one
    # The limit only guards against an unlucky hash; the expected number of rows is below half of it.
    sample = rows.where(chosen).select("doc_id", "text", "lang").limit(2 * TRAIN_ROWS).toPandas().sort_values(["doc_id", "text"], ignore_index=True)
    sample = sample[[isinstance(t, str) and has_letter(t) for t in sample["text"]]].reset_index(drop=True)
    if not len(sample):
        return Model([], model.idf, model.weights)
    number = {lang: i for i, lang in enumerate(languages)}
    y = sample["lang"].map(number).to_numpy()
    x = Sparse.of([model.vector(t) for t in sample["text"]])
    judge = np.arange(len(y)) % 4 == 3
    model.weights = fit(x.take(np.flatnonzero(~judge)), y[~judge], len(languages), BUCKETS, alpha=1.0, l1=0.002, l2=0.01, epochs=6)
    model.temperature = temperature(x.take(np.flatnonzero(judge)).times(model.weights), y[judge])
    return model


def _predicted(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = [shared.value.predict(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([s[0] for s in said], pa.string()), pa.array([s[1] for s in said], pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    return run


def identify_languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs, from its whole text alone.

    lang, source and doc_id are never inputs of a prediction. Null text and text without a letter
    give `und` with score 0; so does everything if no row is labelled. Rows with a null lang
    are predicted but not learned from; a null doc_id is never held out. Repeated rows are predicted one by one.
    Ties go to the first language by name. The model is a fixed-size array per language, broadcast once.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text"), held_out().alias("held_out"))
    return rows.mapInArrow(released(_predicted(shared)), "doc_id bigint, held_out boolean, lang_pred string, score double")


def _accepted(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.schema.names.index("text"))
            keep = [lang != UNKNOWN and score >= LEAST_SCORE for lang, score in (shared.value.predict(t.as_py()) for t in column)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return run


def drop_unidentified(docs: DataFrame) -> DataFrame:
    """docs without those whose language the model cannot tell (no letter, or score below LEAST_SCORE)."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs))
    return docs.mapInArrow(released(_accepted(shared)), docs.schema)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"))


QUERIES = {"op3_language_id": op3_language_id}
ORACLES: dict[str, str] = {}
