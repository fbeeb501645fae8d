"""From documents to packed training sequences: five stages, each written and read again by the next.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and returns a table. All but the
last return the columns of documents. Rejected documents are gone from all later stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracewright.llm.common import materialise, table
from tracewright.llm.decontaminate import drop_contaminated
from tracewright.llm.exact_dedup import drop_exact_duplicates
from tracewright.llm.language_id import drop_unidentified
from tracewright.llm.ngram_join import drop_near_copies
from tracewright.llm.packing import pack_documents


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the model can tell."""
    return drop_unidentified(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text."""
    return drop_exact_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, Jaccard 0.8 or more."""
    return drop_near_copies(docs, width=5, percent=80)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in sequences of balanced cost."""
    return pack_documents(docs)


STAGES = [("language_id", language), ("exact_dedup", exact), ("ngram_join", near), ("decontamination", clean), ("packing", packed)]

#: Language identification, edit-distance search and packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
