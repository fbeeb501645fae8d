"""Queries that run the streaming forms over the event table and return what the streams wrote; and text round trips."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.operators.scale import written
from tracewright.plans.bindings import sql, v_trace
from tracewright.sources.readers import parse_trace
from tracewright.sources.sinks import export_spans
from tracewright.streaming import streams

QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


def through(spark: SparkSession, build, source: DataFrame, state_store: str | None = None) -> DataFrame:
    """Write source as files, stream them through build to a parquet sink until all is read, and read the sink."""
    table = written(source, "stream-in")
    base = table.inputFiles()[0].rsplit("/", 1)[0]
    live = spark.readStream.schema(table.schema).parquet(base)
    out = f"{base}-out-{uuid.uuid4().hex}"
    result = build(live)
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    if state_store:
        spark.conf.set(key, state_store)
    q = result.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-state").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    spark.conf.set(key, before)
    return spark.read.schema(result.schema).parquet(out)


@query(sql("v_trace", """SELECT CAST(floor(ts_ns / 86400000000000) * 86400000000 AS BIGINT) AS start_us, event, count(*) AS n FROM v_trace
  WHERE floor(ts_ns / 86400000000000) < (SELECT max(floor(ts_ns / 86400000000000)) FROM v_trace) GROUP BY ALL"""))
def x3_stream_rates(spark, d):
    """Days that the watermark has closed."""
    return through(spark, lambda s: streams.stream_rates(s, "1 day"), v_trace(spark, d).select("id", "ts_ns", "event"))


@query(sql("v_trace", """, g AS (SELECT vpid, ts_ns, CASE WHEN ts_ns - lag(ts_ns) OVER w >= 7200000000000 THEN 1 ELSE 0 END AS b FROM v_trace WINDOW w AS (PARTITION BY vpid ORDER BY ts_ns, id)),
  s AS (SELECT vpid, ts_ns, sum(b) OVER (PARTITION BY vpid ORDER BY ts_ns ROWS UNBOUNDED PRECEDING) AS k FROM g), r AS (SELECT vpid, k, min(ts_ns) // 1000 AS start_us, max(ts_ns) // 1000 + 7200000000 AS end_us, count(*) AS n FROM s GROUP BY ALL)
  SELECT vpid, start_us, end_us, n FROM r WHERE end_us <= (SELECT max(ts_ns) // 1000 - 600000000 FROM v_trace)"""))
def x4_stream_sessions(spark, d):
    """Sessions that the watermark has closed."""
    return through(spark, lambda s: streams.stream_sessions(s, "2 hours", "vpid"), v_trace(spark, d).select("id", "ts_ns", "vpid"))


@query(sql("v_trace", """, f AS (SELECT *, CASE WHEN event = 'sync' AND lead(ts_ns) OVER w - ts_ns > 7200000000000 THEN 1 ELSE 0 END AS c FROM v_trace WINDOW w AS (PARTITION BY vtid ORDER BY ts_ns, id)),
  p AS (SELECT *, coalesce(sum(c) OVER (PARTITION BY vtid ORDER BY ts_ns, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS period FROM f),
  r AS (SELECT vtid, period, min(ts_ns) AS start_ns, max(ts_ns) AS end_ns, count(*) AS n, arg_max(event, struct_pack(t := ts_ns, i := id)) AS last FROM p GROUP BY ALL)
  SELECT vtid, start_ns, end_ns, n, true AS closed FROM r WHERE last = 'sync' AND end_ns + 7200000000000 < (SELECT (max(ts_ns) // 1000000 - 600000) * 1000000 FROM v_trace)"""))
def x4_stream_sync_sessions(spark, d):
    """Periods that end with a sync and a gap, as far as the watermark has come."""
    source = v_trace(spark, d).select("id", "ts_ns", "event", "vtid")
    return through(spark, lambda s: streams.stream_sync_sessions(s, 7_200_000_000_000, "vtid"), source, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@query(sql("v_trace", "SELECT id, ts_ns, event, vpid, vtid, coalesce(cb, '') AS cb, CAST(id % 8 AS INT) AS cpu FROM v_trace"))
def s1_trace_text(spark, d):
    """The event table as trace lines, parsed back."""
    tod = F.col("ts_ns") % 86_400_000_000_000
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    clock = F.concat(two(F.expr("(ts_ns % 86400000000000) div 3600000000000")), F.lit(":"), two(F.expr("(ts_ns % 3600000000000) div 60000000000")), F.lit(":"), two(F.expr("(ts_ns % 60000000000) div 1000000000")), F.lit("."), F.lpad((tod % 1_000_000_000).cast("string"), 9, "0"))
    line = F.format_string('[%s] (+0.1) host e:%s: { cpu_id = %d }, { procname = "p", vpid = %d, vtid = %d }, { cb = "%s", n = %d, day = %d }', clock, "event", F.col("id") % 8, "vpid", "vtid", F.coalesce("cb", F.lit("")), "id", F.expr("ts_ns div 86400000000000"))
    text = v_trace(spark, d).select(line.alias("value"), F.concat(F.lit("f"), "id").alias("file"), F.col("id").alias("at"))
    got = parse_trace(text, "s", "1970-01-01")
    return got.select("id", (F.col("ts_ns") + F.col("payload")["day"].cast("bigint") * 86_400_000_000_000).alias("ts_ns"), F.regexp_replace("event", "^e:", "").alias("event"), F.col("vpid").cast("bigint").alias("vpid"), F.col("vtid").cast("bigint").alias("vtid"), F.col("payload")["cb"].alias("cb"), F.col("cpu_id").cast("int").alias("cpu"))


@query(sql("v_span", "SELECT substr(sha256('s|' || vpid), 1, 32) AS trace_id, substr(sha256('s|' || span_id), 1, 16) AS span, vpid || '/n' || vpid AS resource, cb AS name, t0 + 5 AS start_ns, t1 + 5 AS end_ns FROM v_span"))
def k4_export_spans(spark, d):
    from tracewright.plans.bindings import v_span

    nodes = v_trace(spark, d).select("vpid", F.concat(F.lit("n"), "vpid").alias("node")).distinct()
    return export_spans(v_span(spark, d), nodes, "s", 5)
