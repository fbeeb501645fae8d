"""Spans from start and end events, gaps and counting windows. Ordering is by (ts_ns, id) everywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.operators.scale import ordered, running_sum

START, END = "callback_start", "callback_end"


def _marks(trace: DataFrame) -> DataFrame:
    return trace.where(F.col("event").isin(START, END))


def _span(df: DataFrame, *more: str) -> DataFrame:
    return df.selectExpr("id AS span_id", "vpid", "vtid", "cb", "ts_ns AS t0", "t2 AS t1", *more)


ORDER = ["ts_ns", "id"]


def pair_nested(trace: DataFrame, chunk_rows: int | None = None) -> DataFrame:
    """Stack pairing: an end closes the innermost open start of its (process, thread); an end with nothing open is ignored.

    Parallel bracket matching. The depth is the running sum of +1 / -1 less its running minimum below zero, so a start and the
    end that closes it have one level and are neighbours there.

    1. A thread with more than chunk_rows marks is cut into chunks (see scale.ordered). Each is summed on its own
       and summarised by its total and its least prefix, which say how many ends and starts it leaves open.
    2. A prefix scan over the summaries gives the sum and the minimum with which each chunk begins, hence all levels.
    3. Marks that are neighbours at their level of a chunk are matched there. Across chunks only the first and the
       last mark of each level of a chunk can match: these are put in order per level.
    """
    keys = ["vpid", "vtid"]
    marks = _marks(trace).select("id", "ts_ns", *keys, "cb", "event").withColumn("step", F.when(F.col("event") == START, 1).otherwise(-1))
    at = ordered(marks, keys, ORDER, chunk_rows)
    here = at.window().rowsBetween(Window.unboundedPreceding, 0)
    depth = at.rows.withColumn("s", F.sum("step").over(here))
    depth = depth.withColumn("low", F.min("s").over(here))
    if not at.whole:
        ends = depth.groupBy(*keys, "__chunk").agg(F.sum("step").alias("total"), F.min("low").alias("least"))
        by = Window.partitionBy(*keys).orderBy("__chunk")
        before = by.rowsBetween(Window.unboundedPreceding, -1)
        ends = ends.withColumn("sum_before", F.coalesce(F.sum("total").over(before), F.lit(0)))
        ends = ends.withColumn("low_before", F.coalesce(F.min(F.col("sum_before") + F.col("least")).over(before), F.lit(0)))
        depth = at.joined(depth, ends.select(*keys, "__chunk", "sum_before", "low_before"))
        depth = depth.withColumn("s", F.col("s") + F.col("sum_before")).withColumn("low", F.least("low_before", F.col("low") + F.col("sum_before")))
    d = F.col("s") - F.least(F.lit(0), "low")
    level = F.when(F.col("event") == START, d).otherwise(d + 1).alias("lvl")
    rows = depth.select("id", "ts_ns", *keys, "cb", "event", "__chunk", level)
    w = at.window("lvl")
    rows = rows.withColumn("e2", F.lead("event").over(w)).withColumn("t2", F.lead("ts_ns").over(w))
    inside = rows.where((F.col("event") == START) & (F.col("e2") == END))
    if at.whole:
        return _span(inside, "lvl")
    edge = rows.withColumn("first", F.lag("event").over(w).isNull()).where((F.col("first") & (F.col("event") == END)) | (F.col("e2").isNull() & (F.col("event") == START)))
    across = Window.partitionBy(*keys, "lvl").orderBy(*ORDER)
    edge = edge.withColumn("e2", F.lead("event").over(across)).withColumn("t2", F.lead("ts_ns").over(across))
    return _span(inside.unionByName(edge.where((F.col("event") == START) & (F.col("e2") == END)).drop("first")), "lvl")


def _pair_last(trace: DataFrame, *keys: str, chunk_rows: int | None = None) -> DataFrame:
    """A start whose next mark in its partition is an end; keyed variants differ in keys only."""
    marks = _marks(trace).select("id", "ts_ns", "vpid", "vtid", "cb", "event")
    nxt = ordered(marks, list(keys), ORDER, chunk_rows).with_next(e2="event", t2="ts_ns")
    return _span(nxt.where((F.col("event") == START) & (F.col("e2") == END)))


def pair_adjacent(trace: DataFrame, chunk_rows: int | None = None) -> DataFrame:
    """A start whose next mark on the thread is an end (by thread alone, as threads are unique on a host)."""
    return _pair_last(trace, "vtid", chunk_rows=chunk_rows)


def pair_by_key(trace: DataFrame, chunk_rows: int | None = None) -> DataFrame:
    """Per (process, thread, callback): an end takes the last start; the start is used once."""
    return _pair_last(trace, "vpid", "vtid", "cb", chunk_rows=chunk_rows)


def pair_thread_last(trace: DataFrame, chunk_rows: int | None = None) -> DataFrame:
    """Per (process, thread): a later start overwrites; the callback is the start's."""
    return _pair_last(trace, "vpid", "vtid", chunk_rows=chunk_rows)


def pair_single(trace: DataFrame, cb: str, chunk_rows: int | None = None) -> DataFrame:
    """The spans of one callback over all threads."""
    return _pair_last(trace.where(F.col("cb") == cb), "cb", chunk_rows=chunk_rows)


def span_stats(spans: DataFrame, *keys: str) -> DataFrame:
    """Count, least, largest, mean and population deviation of durations (ns). The mean is of an exact sum: sums of ns pass 2**53, where doubles lose units."""
    d = F.col("t1") - F.col("t0")
    mean = (F.sum(d.cast("decimal(19,0)")) / F.count(d)).cast("double")
    return spans.groupBy(*(keys or ("cb",))).agg(
        F.count(F.lit(1)).alias("n"), F.min(d).alias("min_ns"), F.max(d).alias("max_ns"),
        F.round(mean, 0).cast("bigint").alias("mean_ns"), F.round(F.stddev_pop(d) / 1e9, 3).alias("std_s"),
    )


def inter_arrival(spans: DataFrame, *keys: str) -> DataFrame:
    """Gap to the previous start in the partition."""
    w = Window.partitionBy(*keys).orderBy("t0", "span_id")
    return spans.withColumn("gap", F.col("t0") - F.lag("t0").over(w))


def empirical_period(spans: DataFrame, least: int = 5, *keys: str) -> DataFrame:
    """Median gap (element n // 2 of the sorted gaps) where there are more than `least` arrivals."""
    keys = keys or ("cb",)
    gaps = inter_arrival(spans, *keys).where("gap IS NOT NULL")
    counts = gaps.groupBy(*keys, "gap").agg(F.count(F.lit(1)).alias("c"))
    at = F.expr("total div 2")
    middle = running_sum(counts, list(keys), ["gap"], "c").where((F.col("before") <= at) & (at < F.col("before") + F.col("c")) & (F.col("total") >= least))
    return middle.select(*keys, F.col("gap").alias("period_ns"), (F.col("total") + 1).alias("arrivals"))


def sync_gap_periods(trace: DataFrame, gap_ns: int, *keys: str, chunk_rows: int | None = None) -> DataFrame:
    """Number the periods of a thread: a sync followed by a gap above gap_ns closes one; what follows belongs to the next."""
    at = ordered(trace, list(keys), ORDER, chunk_rows)
    closes = ((F.col("event") == "sync") & (F.col("t2") - F.col("ts_ns") > gap_ns)).cast("int")
    flagged = at.with_next(t2="ts_ns").withColumn("closes", F.coalesce(closes, F.lit(0)))
    return at.with_sum(flagged, "closes", "period").withColumn("period", F.col("period").cast("bigint")).drop("closes", "t2", "__chunk")


def period_report(periods: DataFrame, spans: DataFrame, *keys: str) -> DataFrame:
    """Per period of a key: length, jitter (difference to the length of the period before, null for the first), bottleneck (the callback with the longest
    spans in all that begin in it, the least by name on ties; null without spans) and its time. periods: the rows of sync_gap_periods."""
    length = periods.groupBy(*keys, "period").agg((F.max("ts_ns") - F.min("ts_ns")).alias("length_ns"))
    w = Window.partitionBy(*keys).orderBy("period")
    length = length.withColumn("jitter_ns", F.abs(F.col("length_ns") - F.lag("length_ns").over(w)))
    began = spans.select(F.col("span_id").alias("id"), "cb", (F.col("t1") - F.col("t0")).alias("busy")).join(periods.select("id", *keys, "period"), "id")
    busy = began.groupBy(*keys, "period", "cb").agg(F.sum("busy").alias("busy_ns"))
    worst = busy.groupBy(*keys, "period").agg(F.min_by(F.struct("cb", "busy_ns"), F.struct(-F.col("busy_ns"), "cb")).alias("b")).select(*keys, "period", F.col("b.cb").alias("bottleneck"), "b.busy_ns")
    return length.join(worst, [*keys, "period"], "left")


def productive(periods: DataFrame, operations: list[str], least: int, *keys: str) -> DataFrame:
    """Periods with at least `least` of the given events."""
    ops = F.sum(F.col("event").isin(operations).cast("int"))
    return periods.groupBy(*keys, "period").agg(ops.alias("ops"), F.count(F.lit(1)).alias("events")).where(F.col("ops") >= least)


def window_counts(points: DataFrame, width_ns: int, anchor_ns: int, *keys: str) -> DataFrame:
    """Counts per tumbling window on a grid from anchor_ns, between a key's first and last non-empty window.

    Empty windows in between count as 0 without being materialised: their number follows from the
    first and last window, so mean and deviation come from sums alone.
    """
    bucket = F.expr(f"floor((t - {anchor_ns}) / {width_ns})").cast("bigint")
    return bucket_stats(points.withColumn("bucket", bucket), *keys)


def bucket_stats(points: DataFrame, *keys: str) -> DataFrame:
    """Statistics of the rows per bucket of each key, see window_counts."""
    filled = points.groupBy(*keys, "bucket").agg(F.count(F.lit(1)).alias("c"))
    stats = filled.groupBy(*keys).agg(
        (F.max("bucket") - F.min("bucket") + 1).alias("n"), F.count(F.lit(1)).alias("filled"), F.sum("c").alias("total"), F.sum(F.col("c") * F.col("c")).alias("squares"), F.min("c").alias("low"), F.max("c").alias("max_count"),
    )
    return stats.select(
        *keys, "n", "total", F.when(F.col("filled") < F.col("n"), F.lit(0)).otherwise(F.col("low")).alias("min_count"), "max_count",
        F.round(F.col("total") / F.col("n"), 3).alias("mean"),
        F.round(F.sqrt(F.greatest(F.lit(0.0), F.col("squares") / F.col("n") - (F.col("total") / F.col("n")) * (F.col("total") / F.col("n")))), 3).alias("std"),
    )
