"""What loops, skewed joins and rankings share: tables in the shared folder, joins with hot keys, running sums."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A join of fewer rows than FEW_ROWS is left as it is.
FEW_ROWS = 2_000
#: Narrow rows that one file may hold.
SMALL_ROWS = 100_000
#: Rows of one key that a window sorts in one task; keys with more are cut into chunks.
CHUNK_ROWS = 2_000_000
#: A key is hot if it has more than HOT_ROWS rows and more than one HOT_KEYS-th of all, so there are at most HOT_KEYS hot keys.
HOT_ROWS, HOT_KEYS = 100, 20_000


def work_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir.

    Where that is unset, a temporary folder is taken and remembered in a local session; on a cluster
    that is an error, since executors could not see it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("tracewright.work.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="tracewright-")
        spark.conf.set("tracewright.work.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    return f"{spark.conf.get('tracewright.run.dir', None) or work_folder(spark)}/{tag}-{uuid.uuid4().hex}"


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """A folder of its own in the shared folder for what operators write inside the block; it is deleted at the end, so results must be written or read by then.

    >>> with scratch(spark):
    ...     task_graphs(edges).write.parquet(path)
    """
    folder, before = new_path(spark, "run"), spark.conf.get("tracewright.run.dir", None)
    spark.conf.set("tracewright.run.dir", folder)
    try:
        yield folder
    finally:
        spark.conf.set("tracewright.run.dir", before) if before else spark.conf.unset("tracewright.run.dir")
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def written(df: DataFrame, tag: str, compact: bool = False, rows: int | None = None) -> DataFrame:
    """df written to the shared folder and read back: cuts lineage and survives lost executors. What is written stays, but for a block of scratch().

    compact deals narrow tables (ids, links) to two files per core, however many partitions the last shuffle had; with a
    bound on their number, rows, to one file for each SMALL_ROWS.
    """
    spark = df.sparkSession
    if rows is not None and rows < 8 * SMALL_ROWS:
        df = df.coalesce(rows // SMALL_ROWS + 1)
    elif compact:
        df = df.repartition(max(8, 2 * spark.sparkContext.defaultParallelism))
    path = new_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def salted_join(rows: DataFrame, side: DataFrame, *keys: str, how: str = "inner", total: int | None = None, counted: DataFrame | None = None) -> DataFrame:
    """rows joined with side (few rows per key); the rows of a hot key are dealt to many tasks, each of which gets the key's side rows.

    Keys are counted in counted (default: rows), which should be a written table. Only the hot keys are broadcast, HOT_KEYS at most.
    """
    counted = rows if counted is None else counted
    total = counted.count() if total is None else total
    if total < FEW_ROWS:
        return rows.join(side, list(keys), how)
    limit = max(HOT_ROWS, total // HOT_KEYS)
    counts = counted.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > limit)
    hot = counts.select(*keys, ((F.col("__n") / limit).cast("int") + 1).alias("__parts")).where(reduce(lambda a, k: a & F.col(k).isNotNull(), keys, F.lit(True)))
    if not hot.limit(1).count():
        return rows.join(side, list(keys), how)
    parts = F.broadcast(hot)
    left = rows.join(parts, list(keys), "left").withColumn("__part", F.coalesce(F.pmod(F.xxhash64(*rows.columns), F.col("__parts")), F.lit(0)).cast("int")).drop("__parts")
    right = side.join(parts, list(keys), "left").withColumn("__part", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))).drop("__parts")
    return left.join(right, [*keys, "__part"], how).drop("__part")


def grid_join(left: DataFrame, right: DataFrame, *keys: str, cell_pairs: int = 1_000_000) -> DataFrame:
    """Inner many-to-many join whose hot keys are spread over a grid of tasks (fragment and replicate).

    A key with p rows on the left and q on the right makes p * q pairs. If that is above cell_pairs, its left rows are dealt to a parts
    and copied to b, its right rows dealt to b and copied to a, with a to b as p to q so that few rows are copied; each of
    the a * b cells then makes about cell_pairs pairs. At most as many keys are hot as the result has cells.
    """
    n = lambda df, name: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    hot = n(left, "__p").join(n(right, "__q"), list(keys)).where(F.col("__p").cast("double") * F.col("__q") > cell_pairs)
    cells = F.ceil(F.col("__p").cast("double") * F.col("__q") / cell_pairs)
    a = F.greatest(F.lit(1), F.least(F.col("__p"), F.ceil(F.sqrt(cells * F.col("__p") / F.col("__q"))))).cast("int")
    hot = hot.select(*keys, a.alias("__a"), cells.alias("__cells")).select(*keys, "__a", F.greatest(F.lit(1), F.ceil(F.col("__cells") / F.col("__a"))).cast("int").alias("__b"))
    hot = written(hot, "hot-keys", compact=True)  # dealt by a shuffle: a coalesce would count all keys in one task
    many = hot.count()
    if not many:
        return left.join(right, list(keys))
    hot = F.broadcast(hot) if many <= HOT_KEYS else hot
    parts = lambda c: F.coalesce(F.col(c), F.lit(1))
    deal = lambda df, c: F.pmod(F.xxhash64(*df.columns), parts(c)).cast("int")
    copies = lambda c: F.explode(F.sequence(F.lit(0), parts(c) - 1))
    x = left.join(hot, list(keys), "left").withColumn("__i", deal(left, "__a")).withColumn("__j", copies("__b")).drop("__a", "__b")
    y = right.join(hot, list(keys), "left").withColumn("__j", deal(right, "__b")).withColumn("__i", copies("__a")).drop("__a", "__b")
    return x.join(y, [*keys, "__i", "__j"]).drop("__i", "__j")


def alike(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    """Equality of the keys of two tables; nulls are equal."""
    return reduce(lambda c, k: c & a[k].eqNullSafe(b[k]), keys, F.lit(True))


def running_sum(df: DataFrame, keys: list[str], order: list[Column | str], weight: str) -> DataFrame:
    """df with `before` (sum of weight over the earlier rows of its key) and `total` (of its key).

    Rows are range partitioned by (keys, order), so a key with very many rows is shared by many tasks;
    each partition sums its own run, and a second window over one row per (key, partition) adds what lies before.
    """
    ranged = written(df.repartitionByRange(*keys, *order).withColumn("__part", F.spark_partition_id()), "ranged")
    here = Window.partitionBy("__part", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy(*keys, "__part").agg(F.sum(weight).alias("__w"))
    w = Window.partitionBy(*keys)
    sums = sums.select(
        *[F.col(k).alias(f"__{k}") for k in keys], F.col("__part").alias("__at"),
        F.coalesce(F.sum("__w").over(w.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"), F.sum("__w").over(w).alias("total"),
    )
    rows = ranged.withColumn("__here", F.coalesce(F.sum(weight).over(here), F.lit(0)))
    same = reduce(lambda c, k: c & F.col(k).eqNullSafe(F.col(f"__{k}")), keys, F.col("__part") == F.col("__at"))
    return rows.join(sums, same).select(*df.columns, (F.col("__before") + F.col("__here")).alias("before"), "total")


@dataclass
class Ordered:
    """Rows of keys in an order that no two rows of a key share, cut into chunks so that no window has to hold a whole key.

    What crosses chunks goes through one summary row for each (key, chunk).
    """

    rows: DataFrame  # with __chunk
    keys: list[str]
    order: list[str]
    whole: bool  # every key is one chunk

    def window(self, *more: str):
        return Window.partitionBy(*self.keys, "__chunk", *more).orderBy(*self.order)

    def joined(self, rows: DataFrame, summary: DataFrame) -> DataFrame:
        """rows with the columns of a summary (keys, __chunk, ...) of their chunk."""
        named = summary.select(*[F.col(c).alias(f"__of_{c}") for c in (*self.keys, "__chunk")], *[c for c in summary.columns if c not in (*self.keys, "__chunk")])
        same = reduce(lambda c, k: c & F.col(k).eqNullSafe(F.col(f"__of_{k}")), self.keys, F.col("__chunk") == F.col("__of___chunk"))
        return rows.join(named, same, "left").drop(*[f"__of_{c}" for c in (*self.keys, "__chunk")])

    def with_next(self, **columns: str) -> DataFrame:
        """rows with columns of the next row of the key; name=column."""
        value = F.struct(*[F.col(c).alias(n) for n, c in columns.items()])
        near = self.rows.withColumn("__near", F.lead(value).over(self.window()))
        if not self.whole:
            first = self.rows.groupBy(*self.keys, "__chunk").agg(F.min(F.struct(*self.order, value.alias("__value"))).alias("__first"))
            far = first.select(*self.keys, "__chunk", F.lead("__first.__value").over(Window.partitionBy(*self.keys).orderBy("__chunk")).alias("__far"))
            near = self.joined(near, far).withColumn("__near", F.coalesce("__near", "__far")).drop("__far")
        return near.select(*self.rows.columns, *[F.col(f"__near.{n}").alias(n) for n in columns])

    def with_sum(self, rows: DataFrame, weight: str, name: str) -> DataFrame:
        """rows (of this order) with the sum of weight over the earlier rows of the key."""
        here = F.coalesce(F.sum(weight).over(self.window().rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        rows = rows.withColumn(name, here)
        if self.whole:
            return rows
        total = rows.groupBy(*self.keys, "__chunk").agg(F.sum(weight).alias("__total"))
        before = F.coalesce(F.sum("__total").over(Window.partitionBy(*self.keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        rows = self.joined(rows, total.select(*self.keys, "__chunk", before.alias("__before")))
        return rows.withColumn(name, F.col(name) + F.col("__before")).drop("__before")


def ordered(df: DataFrame, keys: list[str], order: list[str], chunk_rows: int | None = None) -> Ordered:
    """df in chunks: one for each key if none has more than chunk_rows rows, else range partitions by (keys, order), written.

    Rows are counted once, but for tables that the optimizer takes for less than two bytes per row of a chunk: rows differ in their order, so those are shorter.
    """
    limit = CHUNK_ROWS if chunk_rows is None else chunk_rows
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < 2 * limit:
        return Ordered(df.withColumn("__chunk", F.lit(0)), keys, order, True)
    most = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n"), F.sum("n")).first()
    if (most[0] or 0) <= limit:
        return Ordered(df.withColumn("__chunk", F.lit(0)), keys, order, True)
    cut = df.repartitionByRange(-(-most[1] // limit), *keys, *order).withColumn("__chunk", F.spark_partition_id())
    return Ordered(written(cut, "chunks"), keys, order, False)
