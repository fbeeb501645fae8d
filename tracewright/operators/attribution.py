"""Which span owns a runtime call: own thread, claimed stream, or released."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.operators.scale import running_sum, written
from tracewright.operators.temporal import KEY_ROWS, asof, chunk_for, interval_owner

#: What a sync of each type releases.
OWN_STREAM, ALL_STREAMS, WAIT = (1, 3), 4, 2


def correlate(runtime: DataFrame, activity: DataFrame) -> DataFrame:
    """Runtime calls with the activity of their correlation id and process; kernel before memcpy before memset."""
    rank = F.when(F.col("kind") == "kernel", 0).when(F.col("kind") == "memcpy", 1).otherwise(2)
    best = activity.groupBy("pid", "corr").agg(F.min_by(F.struct("kind", "stream", "t_start", "t_end"), F.struct(rank, F.col("t_start"))).alias("a"))
    return runtime.join(best, ["pid", "corr"], "left").select(*[runtime[c] for c in runtime.columns if c not in ("pid", "corr")], "pid", "corr", "a.kind", "a.stream", "a.t_start", "a.t_end")


def owners(runtime: DataFrame, spans: DataFrame) -> DataFrame:
    """Runtime calls with the innermost span of their own thread, if any."""
    s = spans.select("span_id", F.col("vpid").alias("pid"), F.col("vtid").alias("tid"), "t0", "t1")
    return interval_owner(runtime, s, ["pid", "tid"], "corr")


def stream_claims(runtime: DataFrame, spans: DataFrame, activity: DataFrame) -> DataFrame:
    """(pid, stream, t, span_id): a span claims, from its start, each stream that its own thread's calls touch."""
    return _claims(owners(runtime, spans), activity)


def _claims(owned: DataFrame, activity: DataFrame) -> DataFrame:
    own = owned.where("span_id IS NOT NULL").select("pid", "corr", "span_id", "t0")
    touched = own.join(activity.select("pid", "corr", "stream"), ["pid", "corr"])
    return touched.select("pid", "stream", F.col("t0").alias("t"), "span_id").distinct()


def releases(sync: DataFrame, activity: DataFrame) -> DataFrame:
    """(pid, stream, t): types 1 and 3 release their own stream, type 4 all streams seen in the process, type 2 none."""
    own = sync.where(F.col("sync_type").isin(*OWN_STREAM)).select("pid", "stream", "t")
    streams = activity.select("pid", "stream").distinct()
    every = sync.where(F.col("sync_type") == ALL_STREAMS).select("pid", "t").join(streams, "pid").select("pid", "stream", "t")
    return own.unionByName(every).distinct()


def _last_of_both(points: DataFrame, claims: DataFrame, freed: DataFrame) -> DataFrame:
    """points with claim_t, claimant and r_t: the last claim (the largest id of one time) and the last release of their stream at or before t."""
    nothing = lambda df, *names: df.withColumns({n: F.lit(None).cast("bigint") for n in names})
    rows = nothing(points.withColumn("side", F.lit(1)), "claim_at", "by", "free_at")
    rows = rows.unionByName(nothing(claims.select("pid", "stream", "t", F.col("t").alias("claim_at"), F.col("id").alias("by"), F.lit(0).alias("side")), "corr", "span_id", "free_at"))
    rows = rows.unionByName(nothing(freed.select("pid", "stream", "t", F.col("t").alias("free_at"), F.lit(0).alias("side")), "corr", "span_id", "claim_at", "by"))
    w = Window.partitionBy("pid", "stream").orderBy("t", "side", "by").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda c: F.last(c, ignorenulls=True).over(w)
    found = rows.select("*", last("claim_at").alias("claim_t"), last("by").alias("claimant"), last("free_at").alias("r_t")).where("side = 1")
    return found.select(*points.columns, "claim_t", "claimant", "r_t")


def attribute_runtime(runtime: DataFrame, spans: DataFrame, activity: DataFrame, sync: DataFrame, gpu_only: bool = True, sync_aware: bool = True) -> DataFrame:
    """corr, pid, t, rule, span_id for each call.

    time: the innermost span of the call's own thread. stream: else the latest claim on the call's
    stream at or before t, unless (sync_aware) a release lies at or after the claim and at or before t:
    post-release. residual: no claim. gpu_only keeps the calls that started an activity. Owners are found once and written.

    Claims and releases are carried to the calls in one window over the streams; where a process has so many calls that a stream
    could be too long for one task, by two as-of joins in time chunks.
    """
    owned = written(owners(runtime, spans), "owned")
    called = correlate(owned, activity)
    called = called.where("stream IS NOT NULL") if gpu_only else called
    claims = _claims(owned, activity).withColumnRenamed("span_id", "id")
    points = called.select("corr", "pid", "stream", "t", "span_id")
    freed = releases(sync, activity).withColumn("id", F.lit(0).cast("bigint"))
    busiest = owned.groupBy("pid").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if busiest <= KEY_ROWS // 4:  # claims and releases are fewer than calls and waits
        out = _last_of_both(points, claims, freed)
    else:
        chunk = chunk_for(["pid", "stream"], points, claims, freed)
        claimed = asof(points, claims, ["pid", "stream"], ["id"], chunk_ns=chunk)
        out = asof(claimed.withColumnRenamed("r_t", "claim_t").withColumnRenamed("r_id", "claimant"), freed, ["pid", "stream"], chunk_ns=chunk)
    void = F.col("r_t") >= F.col("claim_t") if sync_aware else F.lit(False)
    rule = F.when(F.col("span_id").isNotNull(), "time").when(F.col("claimant").isNull(), "residual").when(F.coalesce(void, F.lit(False)), "post_release").otherwise("stream")
    return out.select("corr", "pid", "t", rule.alias("rule"), F.coalesce("span_id", F.when(rule == "stream", F.col("claimant"))).alias("span_id"))


def attribution_fractions(attributed: DataFrame) -> DataFrame:
    """Calls per process and rule, and their share of the process."""
    w = Window.partitionBy("pid")
    return attributed.groupBy("pid", "rule").agg(F.count(F.lit(1)).alias("n")).withColumn("share", F.round(F.col("n") / F.sum("n").over(w), 6))


def stream_precedence(sync: DataFrame, activity: DataFrame) -> DataFrame:
    """For each wait: the latest activity of the process that ended strictly before it on another stream.

    Each pair (wait, other stream) is an as-of lookup against that stream; the number of streams of a
    process is small, so waits times streams rows stay in proportion to the waits.
    """
    waits = sync.where(F.col("sync_type") == WAIT)
    streams = activity.select("pid", F.col("stream").alias("other")).distinct()
    pairs = waits.join(streams, "pid").where("stream <> other").select("id", "pid", F.col("stream").alias("own"), F.col("other").alias("stream"), "t")
    ends = activity.select("pid", "stream", F.col("t_end").alias("t"), F.col("corr").alias("id"), "corr")
    found = asof(pairs, ends, ["pid", "stream"], ["corr"], strict=True)
    best = found.where("r_t IS NOT NULL").groupBy("id").agg(F.max(F.struct(F.col("r_t"), F.col("r_corr").alias("corr"), F.col("stream"))).alias("b"))
    return waits.join(best, "id", "left").select("id", "pid", "stream", "t", F.col("b.stream").alias("before_stream"), F.col("b.corr").alias("before_corr"), F.col("b.r_t").alias("before_t"))


def residual_summary(attributed: DataFrame, runtime: DataFrame, bins: int = 10) -> DataFrame:
    """Residual calls per name and time bin (equal bins from the first to the last; the last is closed)."""
    rest = _residual(attributed, runtime)
    lo, hi = rest.agg(F.min("t").alias("lo"), F.max("t").alias("hi")).first() or (0, 0)
    lo, hi = lo or 0, hi or 0
    at = F.least(F.lit(bins - 1), F.expr(f"(t - {lo}) * {bins} div {max(hi - lo, 1)}")).cast("int")
    return rest.groupBy("api_name", at.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("tid").alias("threads"))


def _residual(attributed: DataFrame, runtime: DataFrame) -> DataFrame:
    return attributed.where("rule = 'residual'").select("pid", "corr", "t").join(runtime.select("pid", "corr", "api_name", "tid"), ["pid", "corr"])


def residual_tops(attributed: DataFrame, runtime: DataFrame, k: int = 15) -> DataFrame:
    """The k most frequent names of residual calls (what = api) and all their threads (what = tid), with their number."""
    rest = _residual(attributed, runtime)
    names = rest.groupBy(F.col("api_name").alias("key")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "key").limit(k)
    threads = rest.groupBy(F.col("tid").cast("string").alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return names.withColumn("what", F.lit("api")).unionByName(threads.withColumn("what", F.lit("tid")))


def _long(spans: DataFrame, least_ns: int) -> DataFrame:
    """Long spans per thread, those that touch or overlap made one: (pid, tid, a, b)."""
    s = spans.where(F.col("t1") - F.col("t0") >= least_ns).select(F.col("vpid").alias("pid"), F.col("vtid").alias("tid"), F.col("t0").alias("a"), F.col("t1").alias("b"))
    before = Window.partitionBy("pid", "tid").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, -1)
    cut = s.withColumn("new", (F.col("a") > F.coalesce(F.max("b").over(before), F.col("a") - 1)).cast("int"))
    run = cut.withColumn("run", F.sum("new").over(Window.partitionBy("pid", "tid").orderBy("a", "b").rowsBetween(Window.unboundedPreceding, 0)))
    return run.groupBy("pid", "tid", "run").agg(F.min("a").alias("a"), F.max("b").alias("b")).drop("run")


def _reach(runtime: DataFrame, spans: DataFrame, least_ns: int, low: int, high: int) -> DataFrame:
    """(from, to): the shifts within low .. high that bring some call into some long span of its thread, one row for each such pair.

    Merged spans and calls meet in time buckets, as wide as the range of shifts and the mean span: a span stands in the buckets from which
    a call can reach it, two or three on average.
    """
    s = written(_long(spans, least_ns), "long-spans")
    width = max(1, high - low, int(s.agg(F.avg(F.col("b") - F.col("a"))).first()[0] or 0))
    bucket = lambda t: F.floor(t / width)
    filed = s.withColumn("at", F.explode(F.sequence(bucket(F.col("a") - high), bucket(F.col("b") - low))))
    pairs = runtime.select("pid", "tid", "t", bucket(F.col("t")).alias("at")).join(filed, ["pid", "tid", "at"])
    pairs = pairs.select(F.greatest(F.col("a") - F.col("t"), F.lit(low)).alias("from"), F.least(F.col("b") - F.col("t"), F.lit(high)).alias("to"))
    return pairs.where(F.col("from") <= F.col("to"))


def coverage_steps(runtime: DataFrame, spans: DataFrame, least_ns: int, low: int, high: int) -> DataFrame:
    """(shift, covered): how many calls lie in a long span of their thread after a shift of the clock, for every shift from which on that number differs.

    A sweep without a grid: a call and a span (overlapping ones are made one first) cover an interval of shifts, whose ends
    count +1 and -1. Equal ends are summed before they are put in order, and the running sum goes over range partitions.
    """
    steps = _reach(runtime, spans, least_ns, low, high)
    ends = steps.select(F.col("from").alias("shift"), F.lit(1).alias("step")).unionByName(steps.select((F.col("to") + 1).alias("shift"), F.lit(-1).alias("step")))
    ends = ends.unionByName(ends.sparkSession.range(1).select(F.lit(low).cast("bigint").alias("shift"), F.lit(0).alias("step")))
    sums = ends.groupBy("shift").agg(F.sum("step").alias("step")).withColumn("all", F.lit(0))
    return running_sum(sums, ["all"], ["shift"], "step").where(F.col("shift") <= high).select("shift", (F.col("before") + F.col("step")).alias("covered"))


def best_shift(runtime: DataFrame, spans: DataFrame, least_ns: int, low: int, high: int) -> DataFrame:
    """(shift, until, covered, calls): the least shift of low .. high that brings the most calls into long spans, and the last one of the run with as many."""
    steps = written(coverage_steps(runtime, spans, least_ns, low, high), "steps")
    top = steps.agg(F.max("covered").alias("covered"))
    at = steps.join(F.broadcast(top), "covered").agg(F.min("shift").alias("shift"), F.first("covered").alias("covered"))
    later = steps.select(F.col("shift").alias("next"), F.col("covered").alias("then")).join(F.broadcast(at), (F.col("next") > F.col("shift")) & (F.col("then") != F.col("covered")))
    until = later.agg((F.coalesce(F.min("next"), F.lit(high + 1)) - 1).alias("until"))
    return at.join(F.broadcast(until)).join(F.broadcast(runtime.agg(F.count(F.lit(1)).alias("calls")))).select("shift", "until", "covered", "calls")


def coverage(runtime: DataFrame, spans: DataFrame, least_ns: int, shifts: list[int]) -> DataFrame:
    """Share of calls that lie in a long span of their thread after shifting the clock by each candidate; `best` marks the least shift of the largest share.

    Read off the steps of coverage_steps(), so calls are not copied for each candidate.
    """
    steps = coverage_steps(runtime, spans, least_ns, min(shifts), max(shifts))
    asked = runtime.sparkSession.createDataFrame([(int(s),) for s in sorted(set(shifts))], "candidate bigint")
    at = steps.join(F.broadcast(asked), F.col("shift") <= F.col("candidate")).groupBy(F.col("candidate").alias("shift")).agg(F.max_by("covered", "shift").alias("covered"))
    shares = at.join(F.broadcast(runtime.agg(F.count(F.lit(1)).alias("calls")))).withColumn("share", F.round(F.col("covered") / F.col("calls"), 6))
    best = at.agg(F.max(F.struct("covered", -F.col("shift"))).alias("b")).select((-F.col("b.col2")).alias("best_shift"))
    return shares.join(F.broadcast(best)).select("shift", "calls", "covered", "share", (F.col("shift") == F.col("best_shift")).alias("best"))


def call_places(runtime: DataFrame, spans: DataFrame) -> DataFrame:
    """Where each call lies: inside a span of its thread, before the first, after the last, in a gap, or on a thread without spans."""
    per = spans.groupBy(F.col("vpid").alias("pid"), F.col("vtid").alias("tid")).agg(F.min("t0").alias("first"), F.max("t1").alias("last"))
    out = owners(runtime, spans).drop("t0").join(per, ["pid", "tid"], "left")
    place = (
        F.when(F.col("first").isNull(), "no_callback_thread").when(F.col("span_id").isNotNull(), "inside")
        .when(F.col("t") < F.col("first"), "before").when(F.col("t") > F.col("last"), "after").otherwise("gap")
    )
    return out.select("corr", "pid", "tid", "t", "span_id", place.alias("place"))
