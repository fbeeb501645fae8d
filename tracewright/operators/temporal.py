"""As-of, nearest and interval joins built from windows and bucketed equi joins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.operators.scale import ordered, written

#: A key with more rows than this is cut into time chunks of about so many, which several tasks share.
KEY_ROWS = 2_000_000


def chunk_for(keys: list[str], *tables: DataFrame, key_rows: int = KEY_ROWS) -> int:
    """ns of a time chunk in which the busiest key of the tables has about key_rows rows; 0 if it has no more in all. One count is made."""
    rows = reduce(DataFrame.unionByName, [t.select(*keys, "t") for t in tables])
    n, first, last = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("a"), F.max("t").alias("b")).agg(F.max("n"), F.min("a"), F.max("b")).first()
    return max(1, (last - first) * key_rows // n) if n and n > key_rows else 0


def asof(left: DataFrame, right: DataFrame, keys: list[str], payload: list[str] = (), strict: bool = False, forward: bool = False, chunk_ns: int | None = None) -> DataFrame:
    """left with r_t (and r_<payload>) of the last right row at or before left.t; strict: before; forward: the first at or after.

    Both sides need keys, t and id (the tie break). The union is windowed per key. If a key has very many rows (chunk_ns, by
    default from chunk_for), it is windowed per (keys, time chunk), and what an earlier chunk leaves behind is carried over by a second window
    over one row per chunk, so a busy key is not one task.
    """
    chunk_ns = chunk_for(keys, left, right) if chunk_ns is None else chunk_ns
    sign = -1 if forward else 1
    value = F.struct(F.col("t").alias("t"), *[F.col(p).alias(p) for p in payload])
    chunk = F.expr(f"floor(t / {chunk_ns})").cast("bigint") * sign if chunk_ns else F.lit(0)
    cols = left.columns
    side = (1 if strict else 0)
    both = left.withColumn("__v", F.lit(None).cast(right.select(value.alias("v")).schema["v"].dataType)).withColumn("__s", F.lit(1 - side)).withColumn("__id", F.lit(0).cast("bigint"))
    other = right.select(*[F.col(k) for k in keys], F.col("t"), value.alias("__v"), F.lit(side).alias("__s"), F.col("id").cast("bigint").alias("__id"))
    rows = both.unionByName(other, allowMissingColumns=True).withColumn("__c", chunk).withColumn("__left", F.col("__v").isNull())
    order = [F.col("t") * sign, "__s", F.col("__id") * sign]
    w = Window.partitionBy(*keys, "__c").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    here = rows.withColumn("__r", F.last("__v", ignorenulls=True).over(w)).where("__left")
    if not chunk_ns:
        return here.select(*cols, F.col("__r.t").alias("r_t"), *[F.col(f"__r.{p}").alias(f"r_{p}") for p in payload])
    tail = rows.where("not __left").groupBy(*keys, "__c").agg(F.max_by("__v", F.struct(*[x if not isinstance(x, str) else F.col(x) for x in order])).alias("__tail"))
    chunks = here.select(*keys, "__c").distinct().unionByName(tail.select(*keys, "__c")).distinct().join(tail, [*keys, "__c"], "left")
    carry = chunks.withColumn("__carry", F.last("__tail", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("__c").rowsBetween(Window.unboundedPreceding, -1))).select(*keys, "__c", "__carry")
    out = here.join(carry, [*keys, "__c"], "left").withColumn("__r", F.coalesce("__r", "__carry"))
    return out.select(*cols, F.col("__r.t").alias("r_t"), *[F.col(f"__r.{p}").alias(f"r_{p}") for p in payload])


def asof_last(left: DataFrame, right: DataFrame, keys: list[str], payload: list[str] = ()) -> DataFrame:
    """Last right row strictly before left.t, and its age."""
    return asof(left, right, keys, payload, strict=True).withColumn("age", F.col("t") - F.col("r_t"))


def asof_tolerance(left: DataFrame, right: DataFrame, keys: list[str], tolerance: int, payload: list[str] = ()) -> DataFrame:
    """Latest right row at or before left.t and within the tolerance; rows without one go."""
    return asof(left, right, keys, payload).where(F.col("t") - F.col("r_t") <= tolerance)


def nearest_tolerance(left: DataFrame, right: DataFrame, keys: list[str], tolerance: int, ref: str = "ref") -> DataFrame:
    """Right row nearest to ref (own t where ref is 0 or null), the earlier one on ties; kept within the tolerance and not after left.t."""
    at = left.withColumn("__own", F.col("t")).withColumn("t", F.when(F.coalesce(F.col(ref), F.lit(0)) == 0, F.col("t")).otherwise(F.col(ref)))
    before = asof(at, right, keys).withColumnRenamed("r_t", "__before")
    after = asof(before, right, keys, forward=True).withColumnRenamed("r_t", "__after")
    near = F.when(F.col("__after").isNull() | (F.col("t") - F.col("__before") <= F.col("__after") - F.col("t")), F.col("__before")).otherwise(F.col("__after"))
    out = after.withColumn("match_t", near).where((F.abs(F.col("t") - F.col("match_t")) <= tolerance) & (F.col("__own") >= F.col("match_t")))
    return out.withColumn("t", F.col("__own")).drop("__own", "__before", "__after")


def next_start(points: DataFrame, spans: DataFrame, keys: list[str], tolerance: int) -> DataFrame:
    """First span of the thread that begins at or after t, within the tolerance."""
    starts = spans.select(*keys, F.col("t0").alias("t"), F.col("span_id").alias("id"), "span_id")
    return asof(points, starts, keys, ["span_id"], forward=True).where(F.col("r_t") - F.col("t") <= tolerance)


#: Buckets of level l are FINEST * 8**l ns wide.
FINEST = 1 << 20


def contained(points: DataFrame, spans: DataFrame, keys: list[str]) -> DataFrame:
    """(point, span) rows with t0 <= t <= t1. Each span is filed under at most two buckets of its own level.

    The level is the first whose buckets are as wide as the span, so long spans do not multiply; a point
    looks into one bucket of each level that occurs (a few numbers that are gathered first).
    """
    spans = written(spans, "spans")
    level = F.greatest(F.lit(0), F.ceil(F.log2((F.col("t1") - F.col("t0") + 1) / F.lit(float(FINEST))) / 3)).cast("int")
    width = lambda c: F.lit(FINEST).cast("bigint") * F.pow(F.lit(8.0), c).cast("bigint")
    filed = spans.where("t1 >= t0").withColumn("level", level).withColumn("w", width(F.col("level")))
    filed = filed.withColumn("bucket", F.explode(F.sequence(F.expr("t0 div w"), F.expr("t1 div w")))).drop("w")
    levels = sorted(r["level"] for r in filed.select("level").distinct().collect())
    looks = points.withColumn("level", F.explode(F.array(*[F.lit(x) for x in levels]).cast("array<int>"))).withColumn("w", width(F.col("level")))
    looks = looks.withColumn("bucket", F.expr("t div w")).drop("w")
    return looks.join(filed, [*keys, "level", "bucket"]).where("t BETWEEN t0 AND t1").drop("level", "bucket")


def interval_owner(points: DataFrame, spans: DataFrame, keys: list[str], point_id: str = "id") -> DataFrame:
    """points with the span_id and t0 of the innermost span of their key that holds t (both ends count): the latest start, then the largest id."""
    best = contained(points.select(point_id, "t", *keys), spans.select("span_id", "t0", "t1", *keys), keys).groupBy(point_id).agg(F.max(F.struct("t0", "span_id")).alias("best"))
    return points.join(best, point_id, "left").withColumn("span_id", F.col("best.span_id")).withColumn("t0", F.col("best.t0")).drop("best")


def earliest_open(points: DataFrame, spans: DataFrame, keys: list[str], chunk_rows: int | None = None) -> DataFrame:
    """points with open_id, the span of their key that holds t (both ends count) and began first, the least id on ties; null without one.

    In the order of starts only a span that ends later than all before it is ever the answer: to the points behind those. Such spans
    also end in that order, so a point looks up the first of them that ends at or after t, and no pair of a point and a span is made.
    """
    named = spans.where(" AND ".join(["t1 >= t0", *[f"{k} IS NOT NULL" for k in keys]])).select("span_id", "t0", "t1", *keys)
    at = ordered(named, keys, ["t0", "span_id"], chunk_rows)
    rows = at.rows.withColumn("reach", F.max("t1").over(at.window().rowsBetween(Window.unboundedPreceding, -1)))
    if not at.whole:
        ends = rows.groupBy(*keys, "__chunk").agg(F.max("t1").alias("far"))
        before = Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
        rows = at.joined(rows, ends.select(*keys, "__chunk", F.max("far").over(before).alias("far"))).withColumn("reach", F.greatest("reach", "far"))
    later = written(rows.where("reach IS NULL OR t1 > reach").select(*keys, F.col("t1").alias("t"), F.col("span_id").alias("id"), "span_id", "t0"), "later")
    found = asof(points, later, keys, ["span_id", "t0"], forward=True)
    return found.select(*points.columns, F.when(F.col("r_t0") <= F.col("t"), F.col("r_span_id")).alias("open_id"))


def interval_overlaps(points: DataFrame, spans: DataFrame, keys: list[str], point_id: str = "id", chunk_rows: int | None = None) -> DataFrame:
    """points with the number of spans that hold them (both ends count), as overlaps: those that began at or before t less those that ended before it, by one running sum."""
    named = spans.where(" AND ".join(["t1 >= t0", *[f"{k} IS NOT NULL" for k in keys]]))
    mark = lambda df, t, place, name, step: df.select(*keys, F.col(t).alias("t"), F.lit(place).alias("__place"), F.col(name).cast("bigint").alias("__id"), F.lit(step).alias("__step"))
    ends = mark(named, "t0", 0, "span_id", 1).unionByName(mark(named, "t1", 2, "span_id", -1))
    rows = points.withColumns({"__place": F.lit(1), "__id": F.col(point_id).cast("bigint"), "__step": F.lit(0)}).unionByName(ends, allowMissingColumns=True)
    at = ordered(rows, keys, ["t", "__place", "__id"], chunk_rows)
    return at.with_sum(at.rows, "__step", "overlaps").where("__place = 1").select(*points.columns, F.col("overlaps").cast("bigint").alias("overlaps"))


def interval_semi(spans: DataFrame, points: DataFrame, keys: list[str]) -> DataFrame:
    """Spans that hold at least one point."""
    held = contained(points.select("t", *keys), spans.select("span_id", "t0", "t1", *keys), keys).select("span_id").distinct()
    return spans.join(held, "span_id", "left_semi")


def bucket_between(takes: DataFrame, outputs: DataFrame, keys: list[str], item: str) -> DataFrame:
    """The multiset of inputs that each output closes (takes up to it since the output before), counted."""
    to = asof(takes, outputs, keys, ["id"], forward=True).where("r_id IS NOT NULL")
    counts = to.groupBy("r_id", item).agg(F.count(F.lit(1)).alias("c"))
    sets = counts.groupBy("r_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", F.col(item), F.col("c")))), ",").alias("inputs"))
    return sets.groupBy("inputs").agg(F.count(F.lit(1)).alias("outputs"))


def recent_members(outputs: DataFrame, arrivals: DataFrame, member: str, members: list[str], window_ns: int, keys: list[str]) -> DataFrame:
    """For each output: the members whose latest arrival strictly before it is within the window, and whether that is all of them."""
    wanted = outputs.withColumn(member, F.explode(F.array(*[F.lit(m) for m in members])))
    seen = asof_last(wanted, arrivals, [*keys, member])
    here = (F.col("age") <= window_ns)
    return seen.groupBy("id").agg(
        F.array_join(F.array_sort(F.collect_set(F.when(~F.coalesce(here, F.lit(False)), F.col(member)))), ",").alias("missing"),
        F.bool_and(F.coalesce(here, F.lit(False))).alias("complete"),
    )
