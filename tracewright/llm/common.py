"""What the corpus operators share: table access, shared work folders, checked broadcasts."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.operators.scale import new_path, salted_join, work_folder
from tracewright.operators.scale import written as materialise
from tracewright.shipping import ship_package

__all__ = ["BATCH_ROWS", "BROADCAST_ROWS", "anti_by_id", "body", "light_batches", "materialise", "new_path", "offsets", "released", "salted_join", "semi_by_id", "table", "work_folder"]

#: Rows of whole texts that go to Python at a time.
BATCH_ROWS = 500
#: Rows of (id) that may be broadcast; beyond it the same join runs as a shuffle join.
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def light_batches(spark: SparkSession) -> None:
    """Make Python stages over whole texts ready: the package is on the executors, and batches hold BATCH_ROWS rows at most.

    Memory then follows the texts, not Spark's default of 10,000 rows. The setting is read when a plan runs, so it
    stays in the session; a smaller one of the user is kept.
    """
    ship_package(spark)
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def released(run):
    """A map over batches whose worker gives freed memory back to the system at its end: workers are reused, and what one stage freed would count beside the next."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return wrapped


def body(col: str = "text"):
    """A text column where null counts as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def semi_by_id(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of df whose key is in ids. The ids are broadcast only after their number is checked."""
    few = ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return df.join(F.broadcast(ids) if few else ids, key, "left_semi")


def anti_by_id(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of df whose key is not in ids, null keys included; broadcast as in semi_by_id."""
    few = ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return df.join(F.broadcast(ids) if few else ids, key, "left_anti")


def offsets(parts: DataFrame, size: str, name: str) -> DataFrame:
    """(part, name, total): the sum of size over earlier parts, and over all; parts has one row per file part, so one window holds it."""
    w = Window.orderBy("part")
    before = F.coalesce(F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return parts.select("part", before.cast("bigint").alias(name), F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"))
