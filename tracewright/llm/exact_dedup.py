"""Exact deduplication: 128-bit content hash, smallest id kept, bytes compared inside groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm.common import anti_by_id, materialise, table

#: Fixed by the contract: runs of these characters count as one space.
BLANKS = r"[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " ")


def exact_duplicates(docs: DataFrame, content_hash: Callable[[Column], Column] = F.md5) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Rows are grouped by the content hash AND the normalised bytes, so two texts that collide in the
    hash stay apart. The grouping is pre-aggregated in each task, so a text that a third of all rows
    share reaches the shuffle once per task. Only (doc_id, hashes) meet the classes afterwards.

    Null text counts as empty; empty texts are one group. A null doc_id never wins over a number; a
    group of null ids only has keep_id null and kept true. Rows that repeat both doc_id and text are
    all returned, count in group_size and share one verdict. Other columns of docs are ignored, so
    their names cannot clash. An empty table gives an empty result.
    """
    rows = docs.select("doc_id", normalised(F.col("text")).alias("body"))
    rows = rows.select("doc_id", "body", content_hash(F.col("body")).alias("content_hash"))
    classes = (
        rows.groupBy("content_hash", "body")
        .agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .select("content_hash", F.sha2("body", 256).alias("text_sha256"), "keep_id", "group_size")
    )
    members = rows.select("doc_id", "content_hash", F.sha2("body", 256).alias("text_sha256"))
    return members.join(classes, ["content_hash", "text_sha256"]).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def drop_exact_duplicates(docs: DataFrame) -> DataFrame:
    """docs without the rows that repeat an earlier text; the columns stay as they were.

    Of rows with equal text the one with the smallest doc_id stays. Rows that repeat doc_id and
    normalised text are reduced to one, and rows of one doc_id with other texts are judged by their own
    text; only if a doc_id is repeated is the text shuffled for that. Rows with a null
    doc_id go unless no number has their text, and then one stays.
    """
    verdicts = materialise(exact_duplicates(docs).select("doc_id", "keep_id", "kept", "text_sha256"), "dedup", compact=True)
    losers = verdicts.where("not kept and doc_id is not null")
    sha = F.sha2(normalised(F.col("text")), 256)
    repeated = verdicts.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count()
    if repeated:
        lost = losers.select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__lost")).distinct()
        out = docs.join(lost, (F.col("doc_id") == F.col("__id")) & (sha == F.col("__lost")), "left_anti")
    else:
        out = anti_by_id(docs, losers.select("doc_id").distinct(), "doc_id")
    kept = verdicts.where("kept")
    if kept.where("doc_id is null").limit(1).count() or verdicts.where("doc_id is null").limit(1).count():
        named = kept.where("doc_id is not null").select(F.col("text_sha256").alias("__sha")).distinct()
        unnamed = out.where("doc_id is null").join(named, sha == F.col("__sha"), "left_anti").withColumn("__sha", sha)
        out = out.where("doc_id is not null").unionByName(unnamed.dropDuplicates(["__sha"]).drop("__sha"))
    return out.withColumn("__sha", sha).dropDuplicates(["doc_id", "__sha"]).drop("__sha") if repeated else out


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents)
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY body) AS keep_id,
       count(*) OVER (PARTITION BY body) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY body) AS kept,
       sha256(body) AS text_sha256
FROM d
"""

QUERIES = {"op4_exact_dedup": op4_exact_dedup}
ORACLES = {"op4_exact_dedup": SQL}
