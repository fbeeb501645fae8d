"""Trace-shaped views over the star-schema tables: as DataFrames, and as DuckDB text for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.operators.pairing import pair_nested


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def v_trace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as trace events: process user_id % 8, thread user_id, callback props.k."""
    return read(spark, sf_dir, "events").selectExpr(
        "event_id AS id", "unix_micros(cast(ts AS timestamp)) * 1000 AS ts_ns", "user_id % 8 AS vpid", "user_id AS vtid", "get_json_object(props, '$.k') AS cb",
        "CASE event_type WHEN 'click' THEN 'callback_start' WHEN 'view' THEN 'callback_end' WHEN 'signup' THEN 'publish' WHEN 'purchase' THEN 'take' WHEN 'error' THEN 'sync' ELSE event_type END AS event",
        "value",
    )


def v_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_nested(v_trace(spark, sf_dir))


def v_runtime(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v_trace(spark, sf_dir).where("event IN ('publish', 'take')").selectExpr(
        "id AS corr", "vpid AS pid", "vtid AS tid", "ts_ns AS t",
        "element_at(array('cudaLaunchKernel', 'cudaMemcpyAsync', 'cudaMemset', 'cudaStreamSynchronize', 'cudaMalloc'), cast(id % 5 AS int) + 1) AS api_name", "value",
    )


def v_gpu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v_runtime(spark, sf_dir).where("corr % 5 < 3").selectExpr(
        "corr", "pid", "element_at(array('kernel', 'memcpy', 'memset'), cast(corr % 5 AS int) + 1) AS kind", "pid * 4 + corr % 4 AS stream",
        "t + 1000 AS t_start", "t + 1000 + cast(round(value * 1e6) AS bigint) AS t_end",
    )


def v_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v_trace(spark, sf_dir).where("event = 'sync'").selectExpr("id", "vpid AS pid", "vpid * 4 + id % 4 AS stream", "ts_ns AS t", "1 + id % 4 AS sync_type")


def supplied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All line items with their order and part."""
    line = read(spark, sf_dir, "lineitem")
    orders, part = read(spark, sf_dir, "orders"), read(spark, sf_dir, "part")
    return line.join(orders, line["l_orderkey"] == orders["o_orderkey"]).join(part, line["l_partkey"] == part["p_partkey"])


def v_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customer -> supplier by brand, from all line items; no path has two edges."""
    return (
        supplied(spark, sf_dir)
        .groupBy("o_custkey", "l_suppkey", F.col("p_brand").alias("topic")).agg(F.count(F.lit(1)).alias("n"))  # by numbers: the names are longer to shuffle
        .select(F.concat(F.lit("NC:"), "o_custkey").alias("src"), F.concat(F.lit("NS:"), "l_suppkey").alias("dst"), "topic", "n")
    )


def v_taker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier (dst) of a brand (topic) in v_edge, once."""
    return supplied(spark, sf_dir).select("l_suppkey", "p_brand").distinct().select(F.concat(F.lit("NS:"), "l_suppkey").alias("dst"), F.col("p_brand").alias("topic"))


def v_vertex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations, customers with suppliers, orders as a containment tree of four levels."""
    t = lambda n: read(spark, sf_dir, n)
    return (
        t("region").selectExpr("concat('CN:', r_regionkey) AS id", "'CN' AS type", "cast(NULL AS string) AS parent", "r_name AS label")
        .unionByName(t("nation").selectExpr("concat('EX:', n_nationkey) AS id", "'EX' AS type", "concat('CN:', n_regionkey) AS parent", "n_name AS label"))
        .unionByName(t("customer").selectExpr("concat('NC:', c_custkey) AS id", "'N' AS type", "concat('EX:', c_nationkey) AS parent", "c_name AS label"))
        .unionByName(t("supplier").selectExpr("concat('NS:', s_suppkey) AS id", "'N' AS type", "concat('EX:', s_nationkey) AS parent", "s_name AS label"))
        .unionByName(t("orders").selectExpr("concat('E:', o_orderkey) AS id", "'E' AS type", "concat('NC:', o_custkey) AS parent", "o_orderstatus AS label"))
    )


def v_call(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as invocations, their line items as calls in order."""
    return read(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS inv", "row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS pos",
        "concat(l_returnflag, l_linestatus) AS token", "l_suppkey % 4 AS stream", "l_extendedprice AS cost",
    )


def v_pub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers, in the node of their nation, publish one topic for each of their orders."""
    orders, customer = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    return orders.join(customer, orders["o_custkey"] == customer["c_custkey"]).selectExpr("concat('EX:', c_nationkey) AS node", "concat('NC:', c_custkey) AS entity", "concat('O:', o_orderkey) AS topic")


def v_sub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers, in the node of their nation, take the topics of the orders with their line items."""
    line, supplier = read(spark, sf_dir, "lineitem"), read(spark, sf_dir, "supplier")
    return line.join(supplier, line["l_suppkey"] == supplier["s_suppkey"]).selectExpr("concat('EX:', s_nationkey) AS node", "concat('NS:', s_suppkey) AS entity", "concat('O:', l_orderkey) AS topic").distinct()


def v_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier at a place of an order -> supplier at the next place, by token: an acyclic graph with paths as long as orders."""
    over = "OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice)"
    line = read(spark, sf_dir, "lineitem").selectExpr("l_suppkey", "concat(l_returnflag, l_linestatus) AS topic", f"row_number() {over} AS pos", f"lead(l_suppkey) {over} AS following")
    return (
        line.where("following IS NOT NULL")
        .groupBy("l_suppkey", "pos", "following", "topic").agg(F.count(F.lit(1)).alias("n"))
        .select(F.expr("concat('S:', l_suppkey, '@', pos)").alias("src"), F.expr("concat('S:', following, '@', pos + 1)").alias("dst"), "topic", "n")
    )


def v_topic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "pages").selectExpr("page_id", "regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1) AS name")


_PAIR = """
_run AS (SELECT *, sum(CASE event WHEN 'callback_start' THEN 1 ELSE -1 END) OVER (PARTITION BY vpid, vtid ORDER BY ts_ns, id ROWS UNBOUNDED PRECEDING) AS s
  FROM v_trace WHERE event IN ('callback_start', 'callback_end')),
_depth AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY vpid, vtid ORDER BY ts_ns, id ROWS UNBOUNDED PRECEDING)) AS d FROM _run),
_lvl AS (SELECT *, CASE event WHEN 'callback_start' THEN d ELSE d + 1 END AS lvl FROM _depth),
_next AS (SELECT *, lead(event) OVER w AS e2, lead(ts_ns) OVER w AS t2 FROM _lvl WINDOW w AS (PARTITION BY vpid, vtid, lvl ORDER BY ts_ns, id))"""

#: DuckDB text of the views; sql() joins those that a query needs.
VIEWS = {
    "v_trace": """v_trace AS (SELECT event_id AS id, epoch_us(ts) * 1000 AS ts_ns, user_id % 8 AS vpid, user_id AS vtid, json_extract_string(props, '$.k') AS cb,
  CASE event_type WHEN 'click' THEN 'callback_start' WHEN 'view' THEN 'callback_end' WHEN 'signup' THEN 'publish' WHEN 'purchase' THEN 'take' WHEN 'error' THEN 'sync' ELSE event_type END AS event, value
  FROM events)""",
    "v_span": _PAIR.strip() + """,
v_span AS (SELECT id AS span_id, vpid, vtid, cb, ts_ns AS t0, t2 AS t1, CAST(lvl AS BIGINT) AS lvl FROM _next WHERE event = 'callback_start' AND e2 = 'callback_end')""",
    "v_runtime": """v_runtime AS (SELECT id AS corr, vpid AS pid, vtid AS tid, ts_ns AS t,
  ['cudaLaunchKernel', 'cudaMemcpyAsync', 'cudaMemset', 'cudaStreamSynchronize', 'cudaMalloc'][id % 5 + 1] AS api_name, value FROM v_trace WHERE event IN ('publish', 'take'))""",
    "v_gpu": """v_gpu AS (SELECT corr, pid, ['kernel', 'memcpy', 'memset'][corr % 5 + 1] AS kind, pid * 4 + corr % 4 AS stream, t + 1000 AS t_start,
  t + 1000 + CAST(round(value * 1e6) AS BIGINT) AS t_end FROM v_runtime WHERE corr % 5 < 3)""",
    "v_sync": "v_sync AS (SELECT id, vpid AS pid, vpid * 4 + id % 4 AS stream, ts_ns AS t, 1 + id % 4 AS sync_type FROM v_trace WHERE event = 'sync')",
    "v_edge": """v_edge AS (SELECT 'NC:' || o_custkey AS src, 'NS:' || l_suppkey AS dst, p_brand AS topic, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN part ON l_partkey = p_partkey GROUP BY ALL)""",
    "v_vertex": """v_vertex AS (SELECT 'CN:' || r_regionkey AS id, 'CN' AS type, CAST(NULL AS VARCHAR) AS parent, r_name AS label FROM region
  UNION ALL SELECT 'EX:' || n_nationkey, 'EX', 'CN:' || n_regionkey, n_name FROM nation
  UNION ALL SELECT 'NC:' || c_custkey, 'N', 'EX:' || c_nationkey, c_name FROM customer
  UNION ALL SELECT 'NS:' || s_suppkey, 'N', 'EX:' || s_nationkey, s_name FROM supplier
  UNION ALL SELECT 'E:' || o_orderkey, 'E', 'NC:' || o_custkey, o_orderstatus FROM orders)""",
    "v_call": """v_call AS (SELECT l_orderkey AS inv, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS pos,
  l_returnflag || l_linestatus AS token, l_suppkey % 4 AS stream, l_extendedprice AS cost FROM lineitem)""",
    "v_pub": "v_pub AS (SELECT 'EX:' || c_nationkey AS node, 'NC:' || c_custkey AS entity, 'O:' || o_orderkey AS topic FROM orders JOIN customer ON o_custkey = c_custkey)",
    "v_sub": "v_sub AS (SELECT DISTINCT 'EX:' || s_nationkey AS node, 'NS:' || s_suppkey AS entity, 'O:' || l_orderkey AS topic FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)",
    "v_hop": """v_hop AS (SELECT 'S:' || l_suppkey || '@' || pos AS src, 'S:' || following || '@' || (pos + 1) AS dst, topic, count(*) AS n FROM (SELECT l_suppkey, l_returnflag || l_linestatus AS topic, row_number() OVER w AS pos, lead(l_suppkey) OVER w AS following
  FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice)) WHERE following IS NOT NULL GROUP BY ALL)""",
    "v_topic": "v_topic AS (SELECT page_id, regexp_extract(url, '^https?://[^/]+(/[^?#]*)', 1) AS name FROM pages)",
}
_NEEDS = {"v_span": ["v_trace"], "v_runtime": ["v_trace"], "v_gpu": ["v_trace", "v_runtime"], "v_sync": ["v_trace"]}


def sql(views: str, body: str) -> str:
    """A DuckDB query over the named views (blank-separated); body starts with SELECT or with ', name AS (...)'."""
    wanted: list[str] = []
    for v in views.split():
        for n in [*_NEEDS.get(v, []), v]:
            if n not in wanted:
                wanted.append(n)
    head = "WITH RECURSIVE " + ",\n".join(VIEWS[v] for v in wanted)
    return f"{head}{body}" if body.lstrip().startswith(",") else f"{head}\n{body}"
