"""Queries that write text, tables or streams from the star-schema tables, read them back through the readers and writers, and return what came back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.operators.scale import new_path
from tracewright.plans.bindings import read, sql, v_gpu, v_span, v_trace
from tracewright.plans.live import through
from tracewright.sources import readers as rd
from tracewright.sources import sinks as sk
from tracewright.streaming import streams

#: The tables span a month, so their events are kept by week.
_WEEK = 7 * 86_400_000_000_000
QUERIES, ORACLES = {}, {}


def query(oracle: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, oracle
        return f

    return add


def _lines(spark: SparkSession, text: DataFrame, *order: str) -> DataFrame:
    """A column `value` written as text and read as lines; with order, as one file whose lines have that order."""
    path = new_path(spark, "text")
    # One partition that is sorted: sorted partitions put together by coalesce may come in the order of their places on a cluster.
    (text.repartition(1).sortWithinPartitions(*order).select("value") if order else text.select("value")).write.text(path)
    return rd.lines(spark, path)


def _sessions(spark, d) -> DataFrame:
    return v_trace(spark, d).select(F.concat(F.lit("s"), "vpid").alias("session_id"), "id", "ts_ns", "event")


@query(sql("v_trace", "SELECT 's' || vpid AS session_id, count(*) AS events, max(ts_ns) - min(ts_ns) AS span_ns, round(count(*) / (nullif(max(ts_ns) - min(ts_ns), 0) / 1e9), 6) AS per_second FROM v_trace GROUP BY vpid"))
def s2_ingest_events(spark, d):
    """The log after two ingests of the same sessions; the second one finds them all and adds nothing."""
    ev, path = _sessions(spark, d), new_path(spark, "events")
    for _ in range(2):
        sk.ingest_events(ev, path, f"{path}-log", bucket_ns=_WEEK)
    return spark.read.parquet(f"{path}-log")


@query(sql("v_gpu", """SELECT 'memcpy' AS kind, corr, t_start AS ts_ns, CASE WHEN corr % 6 = 0 THEN -1 ELSE t_end - t_start END AS duration_ns, pid, pid * 3 AS tid, coalesce(r_name, '') AS name, corr % 100 AS bytes, corr % 4 AS copy_kind FROM v_gpu LEFT JOIN region ON r_regionkey = corr % 7 WHERE corr % 10 <> 3"""))
def s3_read_activities(spark, d):
    rows = v_gpu(spark, d).selectExpr("corr", "if(corr % 10 = 3, NULL, t_start - 1000) AS start", "if(corr % 6 = 0, NULL, t_end - 1000) AS end", "corr % 7 AS name_id", "pid * 16777216 AS global_pid", "(pid * 16777216) + pid * 3 AS global_tid", "corr % 100 AS bytes", "corr % 4 AS copy_kind")
    strings = read(spark, d, "region").selectExpr("cast(r_regionkey AS bigint) AS id", "r_name AS value")
    return rd.read_activities("memcpy", rows, strings, 1000).na.fill(-1, ["duration_ns"]).na.fill("", ["name"])


@query("SELECT l_orderkey AS callchain_id, l_linenumber AS depth, CASE WHEN l_linenumber % 2 = 0 THEN l_linestatus ELSE '0x' || lower(to_hex(CAST(l_partkey AS BIGINT))) END AS symbol, CAST(77 + CAST(l_orderkey AS BIGINT) * 1000 + l_linenumber AS BIGINT) AS ts_ns FROM lineitem")
def s4_callchains(spark, d):
    frames = read(spark, d, "lineitem").selectExpr("cast(l_orderkey AS bigint) AS callchain_id", "l_linenumber AS depth", "if(l_linenumber % 2 = 0, l_linestatus, NULL) AS symbol", "cast(l_partkey AS bigint) AS ip")
    return rd.read_callchains(frames, 77)


@query(sql("v_gpu", "SELECT t_start AS ts_ns, t_end - t_start AS duration_ns, 'd' || pid AS domain, corr % 3 AS type, kind AS text FROM v_gpu"))
def s5_ranges(spark, d):
    return rd.read_ranges(v_gpu(spark, d).selectExpr("t_start - 5 AS start", "t_end - 5 AS end", "concat('d', pid) AS domain", "corr % 3 AS type", "kind AS text"), 5)


@query("SELECT 's' AS session_id, n_name, 'n_nationkey=' || n_nationkey || ',n_regionkey=' || n_regionkey AS extras FROM nation WHERE n_regionkey <> 2 UNION ALL SELECT 's', 'again', 'n_nationkey=' || n_nationkey || ',n_regionkey=2' FROM nation WHERE n_regionkey = 2")
def s6_static_metadata(spark, d):
    """A static table written by region, the partition of region 2 replaced by a second ingest."""
    n = read(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    path = new_path(spark, "static")
    for rows in (n, n.where("n_regionkey = 2").withColumn("n_name", F.lit("again"))):
        sk.replace_table(rd.static_metadata(rows, "s", ["n_name"]).withColumn("part", F.col("extras")["n_regionkey"].cast("int")), path, "session_id", "part")
    text = F.array_join(F.array_sort(F.transform(F.map_entries("extras"), lambda e: F.concat_ws("=", e["key"], e["value"]))), ",")
    return spark.read.parquet(path).select("session_id", "n_name", text.alias("extras"))


@query("""SELECT o_orderkey AS id, CAST(CASE o_orderkey % 3 WHEN 0 THEN CAST(epoch(CAST(o_orderdate AS TIMESTAMP)) AS BIGINT) * 1000000000 + o_orderkey WHEN 1 THEN (CAST(epoch(CAST(o_orderdate AS TIMESTAMP)) AS BIGINT) - 32400) * 1000000000 ELSE o_orderkey END AS BIGINT) AS start_ns FROM orders""")
def s7_session_clock(spark, d):
    o = read(spark, d, "orders").selectExpr("o_orderkey AS id", "cast(cast(o_orderdate AS date) AS string) AS day")
    clock = o.selectExpr("id", "if(id % 3 = 0, concat(day, 'T00:00:00Z'), NULL) AS utc_text", "if(id % 3 = 1, concat(day, ' 00:00:00'), NULL) AS local_text", "if(id % 3 = 1, 'Asia/Tokyo', NULL) AS zone", "if(id % 3 = 1, NULL, cast(id AS bigint)) AS epoch_ns")
    return rd.session_clock_offset(clock).select("id", "start_ns")


@query("""SELECT 'process' AS kind, CAST(1000 + n_nationkey AS INT) AS pid, CAST(1000 + n_nationkey AS INT) AS lwp, 'run  ' || n_nationkey || ' now' AS cmd FROM nation
  UNION ALL SELECT 'thread', CAST(1000 + s_suppkey % 30 AS INT), CAST(5000 + s_suppkey AS INT), 'work' FROM supplier WHERE s_suppkey % 30 IN (SELECT n_nationkey FROM nation)""")
def s8_process_tree(spark, d):
    n = read(spark, d, "nation").select(F.format_string("%d 1 %d 0 root run  %d now", F.col("n_nationkey") + 1000, F.col("n_nationkey") + 1000, "n_nationkey").alias("value"))
    s = read(spark, d, "supplier").select(F.format_string("  %d   1 %d 0 root work", F.col("s_suppkey") % 30 + 1000, F.col("s_suppkey") + 5000).alias("value"))
    p, t = rd.parse_process_tree(_lines(spark, spark.range(1).select(F.lit("PID PPID LWP UID USER CMD").alias("value")).unionByName(n).unionByName(s)))
    return p.select(F.lit("process").alias("kind"), "pid", "lwp", "cmd").unionByName(t.select(F.lit("thread").alias("kind"), "pid", "lwp", "cmd"))


@query("SELECT '/n' || s_nationkey AS node, CASE WHEN s_suppkey % 2 = 0 THEN 'Publishers' ELSE 'Subscribers' END AS kind, '/t' || s_suppkey AS name, 'pkg/T' || s_suppkey % 5 AS type FROM supplier")
def s9_node_info(spark, d):
    s = read(spark, d, "supplier").select("s_nationkey", (F.col("s_suppkey") % 2).alias("side"), F.format_string("    /t%d: pkg/T%d", "s_suppkey", F.col("s_suppkey") % 5).alias("line"))
    part = lambda k, head: F.concat(F.lit(f"  {head}:\n"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("side") == k, F.col("line")))), "\n"), F.lit("\n"))
    report = s.groupBy("s_nationkey").agg(F.concat(F.lit("Node report\n"), part(1, "Subscribers"), part(0, "Publishers"), F.lit("  none")).alias("report"))
    return rd.parse_node_info(_lines(spark, report.select(F.to_json(F.create_map(F.concat(F.lit("/n"), "s_nationkey"), "report")).alias("value"))))


@query("SELECT '/t' || p_partkey AS topic, p_type AS type, CAST(p_size AS INT) AS publisher_count, CAST(p_partkey % 5 AS INT) AS subscription_count, CAST(p_size AS DOUBLE) / 4 AS average_rate, CAST(p_partkey % 9 AS INT) AS window_size FROM part")
def s10_topics(spark, d):
    p = read(spark, d, "part").withColumn("topic", F.concat(F.lit("/t"), "p_partkey"))
    texts = p.groupBy((F.col("p_partkey") % 4).alias("k")).agg(
        F.to_json(F.map_from_entries(F.collect_list(F.struct("topic", F.struct(F.col("p_type").alias("type"), F.col("p_size").alias("publisher_count"), (F.col("p_partkey") % 5).alias("subscription_count")))))).alias("info"),
        F.to_json(F.map_from_entries(F.collect_list(F.struct("topic", F.struct((F.col("p_size") / 4).alias("average_rate"), (F.col("p_partkey") % 9).alias("window_size")))))).alias("rates"),
    )
    info = rd.parse_topic_info(_lines(spark, texts.select(F.col("info").alias("value"))))
    return info.join(rd.parse_topic_rates(_lines(spark, texts.select(F.col("rates").alias("value")))).select("topic", "average_rate", "window_size"), "topic")


@query("SELECT '/box' || s_nationkey AS container, CAST(s_suppkey AS INT) AS idx, '/box' || s_nationkey || '/c' || s_suppkey AS component FROM supplier")
def s11_component_list(spark, d):
    s = read(spark, d, "supplier")
    head = s.select("s_nationkey", F.lit(0).alias("line"), F.lit(0).cast("bigint").alias("s_suppkey"), F.concat(F.lit("/box"), "s_nationkey").alias("value")).distinct()
    rows = s.select("s_nationkey", F.lit(1).alias("line"), "s_suppkey", F.concat(F.lit("  "), "s_suppkey", F.lit("  /box"), "s_nationkey", F.lit("/c"), "s_suppkey").alias("value"))
    return rd.parse_component_list(_lines(spark, head.unionByName(rows), "s_nationkey", "line", "s_suppkey"))


@query("SELECT DISTINCT '/n' || s_suppkey % 70 AS node FROM supplier")
def s12_node_list(spark, d):
    s = read(spark, d, "supplier")
    return rd.parse_node_list(_lines(spark, s.select(F.concat(F.lit("  /n"), F.col("s_suppkey") % 70, F.lit(" ")).alias("value")).unionByName(s.select(F.lit("   ").alias("value")))))


@query("""SELECT CAST(o_orderkey + 1000 AS BIGINT) AS ts_ns, CAST(o_orderkey AS BIGINT) AS monotonic_ns, CASE WHEN o_orderkey % 2 = 0 THEN 'kill' ELSE 'up' END AS action, 'p' || o_custkey AS process_name, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_custkey AS INT) ELSE -1 END AS killed_pid,
  CASE WHEN o_orderkey % 2 = 0 THEN -1 ELSE CAST(o_custkey AS INT) END AS resurrected_pid, 'because of ' || o_orderpriority AS cmd FROM orders WHERE o_orderkey % 7 <> 0""")
def s13_daemon_log(spark, d):
    o = read(spark, d, "orders")
    row = F.expr("concat_ws(' ', o_orderkey, if(o_orderkey % 2 = 0, 'kill', 'up'), concat('p', o_custkey), if(o_orderkey % 2 = 0, cast(o_custkey AS string), '-'), if(o_orderkey % 2 = 0, '-', cast(o_custkey AS string)), concat('because of ', o_orderpriority))")
    text = o.select(F.when(F.col("o_orderkey") % 7 == 0, F.concat(F.lit("# "), row)).otherwise(row).alias("value"))
    return rd.parse_daemon_log(_lines(spark, text), 1000).na.fill(-1, ["killed_pid", "resurrected_pid"])


@query("""WITH a AS (SELECT c_custkey AS id, c_name AS name, c_mktsegment AS seg FROM customer WHERE c_custkey % 3 <> 0), b AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 2 = 0 THEN 'new' END AS name, 's' AS seg FROM customer WHERE c_custkey % 3 <> 1)
  SELECT id, coalesce(b.name, a.name, '') AS name, coalesce(b.seg, a.seg) AS seg FROM a FULL JOIN b USING (id)""")
def s14_register(spark, d):
    c = read(spark, d, "customer")
    new = c.where("c_custkey % 3 <> 1").selectExpr("c_custkey AS id", "if(c_custkey % 2 = 0, 'new', NULL) AS name", "'s' AS seg")
    return rd.register(c.where("c_custkey % 3 <> 0").selectExpr("c_custkey AS id", "c_name AS name", "c_mktsegment AS seg"), new, "id").na.fill("", ["name"])


@query(sql("v_trace", "SELECT 's' || vpid AS session_id, CASE WHEN vpid = 3 THEN 'replaced' ELSE event END AS event, count(*) AS n, sum(id)::BIGINT AS ids FROM v_trace WHERE vpid <> 5 GROUP BY ALL"))
def s16_replace_and_delete(spark, d):
    """Sessions written, one of them replaced, another deleted."""
    ev, path = _sessions(spark, d), new_path(spark, "events")
    sk.ingest_events(ev, path, f"{path}-log", bucket_ns=_WEEK)
    sk.ingest_events(ev.where("session_id = 's3'").withColumn("event", F.lit("replaced")), path, f"{path}-log", force=True, bucket_ns=_WEEK)
    left = sk.delete_session(spark, {"events": path}, "s5", f"{path}-left")
    return spark.read.parquet(left["events"]).groupBy("session_id", "event").agg(F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids"))


@query(sql("v_trace", "SELECT id, cb AS p_cb, ts_ns FROM v_trace WHERE event = 'take' AND vpid > 3 ORDER BY ts_ns DESC, id LIMIT 300"))
def s18_query_table(spark, d):
    t = v_trace(spark, d).select("id", "ts_ns", "event", "vpid", F.struct("cb", "vtid").alias("p"))
    return rd.query_table(t, ["event = 'take'", "vpid > 3"], ["id", "p.cb", "ts_ns"], ["-ts_ns", "id"], 300)


@query("SELECT CAST(p_size AS DOUBLE) AS value, CAST(p_partkey AS BIGINT) * 7 AS ms FROM part WHERE p_partkey % 3 <> 0")
def s18_query_series(spark, d):
    p = read(spark, d, "part").selectExpr("if(p_partkey % 3 = 0, concat('x', p_size), cast(p_size AS string)) AS v", "cast(p_partkey AS bigint) * 7000000 + 5 AS ts_ns")
    return rd.query_series(p, "v", "ts_ns")


@query(sql("v_trace", "SELECT id, ts_ns, event FROM v_trace WHERE vpid = 2 AND starts_with(event, 'callback') ORDER BY ts_ns, id LIMIT 400"))
def s19_executor_events(spark, d):
    return rd.executor_events(v_trace(spark, d), 2, "callback", 400).select("id", "ts_ns", "event")


@query(sql("v_trace", """, i AS (SELECT DISTINCT 'v' || vpid AS instance, vpid FROM v_trace WHERE vpid <> 6) SELECT instance, 'proc' AS kind, ts_ns // 1000000 AS ms, CAST(value AS DOUBLE) AS value FROM v_trace t JOIN i ON t.vpid = i.vpid WHERE t.event = 'publish'"""))
def s20_telemetry_series(spark, d):
    """One series for each process that has all placeholders; process 6 lacks one and is skipped."""
    t = v_trace(spark, d)
    inst = t.select("vpid").distinct().select(F.concat(F.lit("v"), "vpid").alias("instance"), F.lit("proc").alias("kind"), F.when(F.col("vpid") == 6, F.create_map(F.lit("x"), F.lit("1"))).otherwise(F.create_map(F.lit("pid"), F.col("vpid").cast("string"))).alias("properties"))
    templates = t.limit(1).select(F.lit("proc").alias("kind"), F.lit("trace").alias("table"), F.lit("value").alias("column"), F.lit("vpid = {pid} AND event = 'publish'").alias("template"))
    return rd.series_of_templates(rd.telemetry_series(templates, inst), {"trace": t})


def _graph(spark, d) -> tuple[DataFrame, DataFrame]:
    v = read(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("id"), F.create_map(F.lit("name"), F.col("s_name"), F.lit("nation"), F.col("s_nationkey").cast("string")).alias("attrs"))
    line = read(spark, d, "lineitem")
    return v, line.select(F.concat(F.lit("o"), F.col("l_orderkey") % 100).alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst"), F.col("l_returnflag").alias("rel"), F.col("l_linestatus").alias("mode"))


@query("SELECT 'o' || l_orderkey % 100 AS src, 's' || l_suppkey AS dst, l_returnflag AS rel, min(l_linestatus) AS mode FROM lineitem GROUP BY ALL")
def k1_save_graph(spark, d):
    """A graph saved, refused, replaced and loaded again; its log and listing are checked on the way."""
    v, e = _graph(spark, d)
    path = new_path(spark, "graph")
    sk.save_graph(v, e, "s", "main", path)
    try:
        sk.save_graph(v, e, "s", "main", path)
    except ValueError:
        sk.save_graph(v, e, "s", "main", path, replace=True, actor="me")
    loaded = sk.load_graph(spark, path, "s", "main")
    same = spark.read.parquet(f"{path}/mutations").where("op = 'replace' AND actor = 'me'").select("vertices", F.col("edges").alias("logged"))
    return loaded[1].crossJoin(F.broadcast(same)).where("logged > 0").select("src", "dst", "rel", "mode")


@query("SELECT 's' || l_linenumber % 3 AS session_id, 1 AS scopes, count(DISTINCT l_suppkey) AS vertices FROM lineitem GROUP BY 1")
def k2_list_sessions(spark, d):
    _, e = _graph(spark, d)
    path = new_path(spark, "graph")
    line = read(spark, d, "lineitem")
    for k in range(3):
        v = line.where(F.col("l_linenumber") % 3 == k).select(F.col("l_suppkey").alias("id")).distinct()
        sk.save_graph(v, e, f"s{k}", "main", path)
    return sk.list_sessions(spark, path)


@query("""SELECT 's' || s_suppkey AS id, s_name AS name, CAST(s_nationkey AS VARCHAR) AS nation FROM supplier""")
def k3_graph_json(spark, d):
    path = new_path(spark, "json")
    sk.graph_json(_graph(spark, d)[0]).write.text(path)
    return spark.read.schema("id string, name string, nation string").json(path)


@query(sql("v_span", "SELECT substr(sha256('s|' || vpid), 1, 32) AS trace_id, substr(sha256('s|' || span_id), 1, 16) AS span, vpid || '/n' || vpid AS resource, cb AS name, t0 AS start_ns, t1 AS end_ns, true AS small FROM v_span"))
def k4_span_batches(spark, d):
    """Spans written as JSON in files of at most 50, read back with a check of the sizes of all files."""
    nodes = v_trace(spark, d).select("vpid", F.concat(F.lit("n"), "vpid").alias("node")).distinct()
    path = new_path(spark, "spans")
    sk.write_span_batches(sk.export_spans(v_span(spark, d), nodes, "s"), path, 50)
    back = spark.read.schema("span string, resource string, name string, start_ns bigint, end_ns bigint, trace_id string").json(path).withColumn("file", F.col("_metadata.file_path"))
    sizes = back.groupBy("file").agg((F.count(F.lit(1)) <= 50).alias("small"))
    return back.join(sizes, "file").drop("file")


@query("SELECT l_linestatus AS kernel_name, min(l_linenumber) AS grid_x, min(CAST(l_quantity AS INT)) AS block_x, min(l_partkey % 64) AS registers, count(*) AS launches, string_agg(DISTINCT CAST(l_suppkey % 8 AS VARCHAR), ',' ORDER BY CAST(l_suppkey % 8 AS VARCHAR)) AS streams FROM lineitem GROUP BY l_linestatus")
def k6_kernel_catalog(spark, d):
    k = read(spark, d, "lineitem").selectExpr("l_linestatus AS kernel_name", "l_linenumber AS grid_x", "cast(l_quantity AS int) AS block_x", "l_partkey % 64 AS registers", "l_suppkey % 8 AS stream_id")
    streams_ = sk.kernel_streams(k).groupBy("kernel_name").agg(F.array_join(F.array_sort(F.collect_list(F.col("stream_id").cast("string"))), ",").alias("streams"))
    return sk.kernel_catalog(k).join(streams_, "kernel_name")


@query(sql("v_gpu", "SELECT DISTINCT stream AS stream_id, pid FROM v_gpu"))
def k6_stream_owner(spark, d):
    return sk.stream_owner(v_gpu(spark, d).select(F.col("stream").alias("stream_id"), (F.col("pid") * 16777216).alias("global_pid")))


@query("SELECT c_custkey AS id, c_name AS name, 'segment=' || c_mktsegment AS rest FROM customer")
def p13_promote(spark, d):
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.create_map(F.lit("name"), F.col("c_name"), F.lit("segment"), F.col("c_mktsegment"), F.lit("gone"), F.lit(None).cast("string")).alias("attrs"))
    return sk.promote(c, ["name"]).select("id", "name", F.array_join(F.transform(F.map_entries("attrs"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("rest"))


@query(sql("v_trace", "SELECT id, vpid, vtid, 'e:' || event AS event, ts_ns % 86400000000000 AS ts_ns FROM v_trace"))
def x1_stream_ingest(spark, d):
    tod = F.col("ts_ns") % 86_400_000_000_000
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    clock = F.concat(two(F.floor(tod / 3_600_000_000_000)), F.lit(":"), two(F.expr("(ts_ns % 3600000000000) div 60000000000")), F.lit(":"), two(F.expr("(ts_ns % 60000000000) div 1000000000")), F.lit("."), F.lpad((tod % 1_000_000_000).cast("string"), 9, "0"))
    text = v_trace(spark, d).select(F.format_string('[%s] (+0.1) host e:%s: { cpu_id = 1 }, { procname = "p", vpid = %d, vtid = %d }, { n = %d }', clock, "event", "vpid", "vtid", "id").alias("value"))
    got = through(spark, lambda s: streams.stream_ingest(s, "s", 0), text)
    return got.select(F.col("payload")["n"].cast("bigint").alias("id"), F.col("vpid").cast("bigint").alias("vpid"), F.col("vtid").cast("bigint").alias("vtid"), "event", "ts_ns")


@query(sql("v_span", "SELECT span_id, vpid, vtid, cb, t0, t1 FROM v_span"))
def x2_stream_pair(spark, d):
    """All spans: one start far behind the last event moves the watermark past it."""
    t = v_trace(spark, d).select("id", "ts_ns", "vpid", "vtid", "cb", "event")
    end = t.agg(F.max("ts_ns").alias("m")).select(F.lit(-1).cast("bigint").alias("id"), (F.col("m") + 10**16).alias("ts_ns"), F.lit(0).cast("bigint").alias("vpid"), F.lit(-1).cast("bigint").alias("vtid"), F.lit("x").alias("cb"), F.lit("callback_start").alias("event"))
    return through(spark, lambda s: streams.stream_pair(s, "10 minutes", ttl_ns=10**18), t.unionByName(end), "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
