"""Queries over the graph views and scalar functions, with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.functions import scalars as sc
from tracewright.operators import graph as gr
from tracewright.plans.bindings import read, sql, v_edge, v_hop, v_topic, v_trace, v_vertex

QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


_COMP = """, b AS (SELECT src AS a, dst AS b FROM v_hop UNION SELECT dst, src FROM v_hop), reach(node, seen) AS (SELECT a, a FROM b UNION SELECT b.b, reach.seen FROM reach JOIN b ON b.a = reach.node),
  comp AS (SELECT node, min(seen) AS component FROM reach GROUP BY node)"""
_SRC = ", srcs AS (SELECT DISTINCT src AS id FROM v_hop WHERE src NOT IN (SELECT dst FROM v_hop)), snks AS (SELECT DISTINCT dst AS id FROM v_hop WHERE dst NOT IN (SELECT src FROM v_hop))"
_DEPTH = ", walk(id, d) AS (SELECT id, 0 FROM srcs UNION SELECT e.dst, d + 1 FROM walk JOIN v_hop e ON e.src = walk.id WHERE d < 64)"


@query(sql("v_hop", _COMP + " SELECT node, component FROM comp"))
def g4_components(spark, d):
    return gr.components(v_hop(spark, d))


@query(sql("v_hop", _COMP + _SRC + _DEPTH + """, l AS (SELECT id, max(d) AS d FROM walk GROUP BY id), e AS (SELECT component, count(*) AS edges FROM (SELECT DISTINCT src, dst FROM v_hop) JOIN comp ON src = node GROUP BY component)
  SELECT c.component, count(*) AS nodes, count(s.id) AS roots, count(k.id) AS sinks, CAST(coalesce(max(l.d), 0) AS INT) AS depth, any_value(e.edges) AS edges
  FROM comp c JOIN e USING (component) LEFT JOIN srcs s ON c.node = s.id LEFT JOIN snks k ON c.node = k.id LEFT JOIN l ON c.node = l.id GROUP BY c.component"""))
def g5_task_graphs(spark, d):
    return gr.task_graphs(v_hop(spark, d))


@query(sql("v_hop", _COMP + """, n AS (SELECT component, count(*) AS nodes FROM comp GROUP BY component)
  SELECT component, any_value(nodes) AS nodes, count(*) AS edges, count(DISTINCT topic) AS topics, CAST(sum(n) AS BIGINT) AS weight FROM v_hop JOIN comp ON src = node JOIN n USING (component) GROUP BY component"""))
def g6_component_stats(spark, d):
    e = v_hop(spark, d)
    return gr.component_stats(e, gr.components(e))


@query(sql("v_edge", """SELECT id, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) + sum(i) AS BIGINT) AS total
  FROM (SELECT src AS id, 1 AS o, 0 AS i FROM v_edge UNION ALL SELECT dst, 0, 1 FROM v_edge) GROUP BY id"""))
def g9_degree(spark, d):
    return gr.degree(v_edge(spark, d))


@query(sql("v_hop", _SRC + _DEPTH + " , n AS (SELECT src AS id FROM v_hop UNION SELECT dst FROM v_hop) SELECT n.id, CAST(coalesce(min(d), -1) AS INT) AS depth FROM n LEFT JOIN walk ON n.id = walk.id GROUP BY n.id"))
def g10_bfs_depth(spark, d):
    return gr.bfs_depth(v_hop(spark, d))


@query(sql("v_hop", """, e AS (SELECT DISTINCT src, dst FROM v_hop WHERE src <> dst), n AS (SELECT src AS id FROM e UNION SELECT dst FROM e),
  walk(s, id, d, p) AS (SELECT id, id, 0, 1.0::DOUBLE FROM n UNION ALL SELECT s, dst, d + 1, sum(p) FROM walk JOIN e ON src = id GROUP BY s, dst, d + 1),
  sp AS (SELECT s, id, min(d) AS d, arg_min(p, d) AS p FROM walk GROUP BY s, id),
  b AS (SELECT a.id, sum(a.p * b.p / c.p) AS x FROM sp a JOIN sp b ON b.s = a.id JOIN sp c ON c.s = a.s AND c.id = b.id WHERE a.d > 0 AND b.d > 0 AND a.d + b.d = c.d GROUP BY a.id)
  SELECT id, round(coalesce(x, 0) / ((count(*) OVER () - 1) * (count(*) OVER () - 2)), 9) AS betweenness FROM n LEFT JOIN b USING (id)"""))
def g11_betweenness(spark, d):
    return gr.betweenness(v_hop(spark, d))


@query(sql("v_vertex", """, c AS (SELECT parent AS m, count(*) AS c FROM v_vertex WHERE type = 'E' GROUP BY parent), p AS (SELECT v.parent AS root, count(*) AS children, sum(coalesce(c, 0)) AS g, max(coalesce(c, 0)) AS w FROM v_vertex v LEFT JOIN c ON v.id = c.m WHERE v.type = 'N' GROUP BY v.parent)
  SELECT id AS root, coalesce(children, 0) AS children, CAST(coalesce(g, 0) AS BIGINT) AS grandchildren, coalesce(w, 0) AS widest FROM v_vertex LEFT JOIN p ON id = root WHERE type = 'EX'"""))
def g12_subtree_sizes(spark, d):
    return gr.subtree_sizes(v_vertex(spark, d), "EX", "N", "E")


@query(sql("v_hop", _SRC + " SELECT id, 'source' AS kind FROM srcs UNION ALL SELECT id, 'sink' FROM snks"))
def g13_sources_sinks(spark, d):
    e = v_hop(spark, d)
    return gr.sources(e).withColumn("kind", F.lit("source")).unionByName(gr.sinks(e).withColumn("kind", F.lit("sink")))


@query(sql("v_vertex", "SELECT p.id AS src, v.id AS dst, p.type || '_' || v.type AS level FROM v_vertex v JOIN v_vertex p ON v.parent = p.id"))
def g2_contains_edges(spark, d):
    return gr.contains_edges(v_vertex(spark, d))


@query(sql("v_vertex", """SELECT e.id AS leaf, n.id AS n, n.label AS n_label, x.id AS ex, x.label AS ex_label FROM v_vertex e LEFT JOIN v_vertex n ON e.parent = n.id AND n.type = 'N' LEFT JOIN v_vertex x ON n.parent = x.id AND x.type = 'EX' WHERE e.type = 'E'"""))
def j25_containment(spark, d):
    return gr.containment(v_vertex(spark, d), "E", ["N", "EX"])


_ROLL = """SELECT a.parent AS src, b.parent AS dst, count(*) AS edges, CAST(sum(n) AS BIGINT) AS n, array_to_string(list_sort(list_distinct(list(topic))), ',') AS topics
  FROM v_edge e JOIN v_vertex a ON e.src = a.id JOIN v_vertex b ON e.dst = b.id {} GROUP BY ALL"""


@query(sql("v_edge v_vertex", _ROLL.format("WHERE a.parent <> b.parent")))
def a17_rollup_edges(spark, d):
    return gr.rollup_edges(v_edge(spark, d), v_vertex(spark, d))


@query(sql("v_edge v_vertex", _ROLL.format("")))
def a18_comm_density(spark, d):
    return gr.rollup_edges(v_edge(spark, d), v_vertex(spark, d), keep_self=True)


@query(sql("v_vertex", "SELECT coalesce(type, 'all') AS type, count(*) AS vertices, count(parent) AS contained FROM v_vertex GROUP BY ROLLUP (type)"))
def a32_graph_summary(spark, d):
    return gr.graph_summary(v_vertex(spark, d))


@query(sql("v_hop", """, o AS (SELECT src AS id, array_to_string(list_sort(list_distinct(list(topic))), ',') AS out_topics FROM v_hop GROUP BY src), i AS (SELECT dst AS id, array_to_string(list_sort(list_distinct(list(topic))), ',') AS in_topics FROM v_hop GROUP BY dst)
  SELECT coalesce(o.id, i.id) AS id, coalesce(out_topics, '') AS out_topics, coalesce(in_topics, '') AS in_topics, CASE WHEN o.id IS NOT NULL AND i.id IS NOT NULL THEN 'relay' WHEN o.id IS NOT NULL THEN 'source' ELSE 'sink' END AS role FROM o FULL JOIN i ON o.id = i.id"""))
def h10_dataflow_role(spark, d):
    return gr.dataflow_role(v_hop(spark, d))


@query(sql("v_hop", _SRC + _DEPTH + """, n AS (SELECT src AS id FROM v_hop UNION SELECT dst FROM v_hop), b AS (SELECT n.id, coalesce(min(d), -1) AS depth FROM n LEFT JOIN walk ON n.id = walk.id GROUP BY n.id),
  g AS (SELECT id, count(*) AS total FROM (SELECT src AS id FROM v_hop UNION ALL SELECT dst FROM v_hop) GROUP BY id)
  SELECT id, CAST(depth AS INT) AS depth, total, CAST(row_number() OVER (ORDER BY CASE WHEN depth < 0 THEN 999 ELSE depth END, total DESC, id) AS INT) AS rn FROM b JOIN g USING (id)"""))
def l3_staircase_order(spark, d):
    return gr.staircase_order(gr.written(v_hop(spark, d).select("src", "dst"), "hops"))


@query(sql("v_vertex", ", t(id, depth) AS (SELECT id, 0 FROM v_vertex WHERE id = 'CN:1' UNION ALL SELECT v.id, depth + 1 FROM t JOIN v_vertex v ON v.parent = t.id WHERE depth < 2) SELECT id, CAST(depth AS INT) AS depth FROM t"))
def g16_subtree(spark, d):
    return gr.subtree(v_vertex(spark, d), "CN:1", 2)


@query(sql("v_edge", "SELECT src, dst, max(topic) AS topic, CAST(sum(n) AS BIGINT) AS n FROM v_edge GROUP BY src, dst"))
def q1_collapse(spark, d):
    return gr.collapse(v_edge(spark, d))


@query(sql("v_edge v_vertex", "SELECT e.src, e.dst, e.topic, e.n FROM v_edge e WHERE src IN (SELECT id FROM v_vertex WHERE type = 'N') AND dst IN (SELECT id FROM v_vertex WHERE type = 'N')"))
def g17_comm_subgraph(spark, d):
    return gr.comm_subgraph(v_edge(spark, d), v_vertex(spark, d), "N").select("src", "dst", "topic", "n")


@query("SELECT 'r' || r_regionkey AS id, r_name AS label FROM region WHERE r_regionkey NOT IN (1) AND r_regionkey <> 2 UNION ALL SELECT 'r2', 'CHANGED' UNION ALL SELECT 'r9', 'NEW'")
def g15_mutate(spark, d):
    now = read(spark, d, "region").selectExpr("concat('r', r_regionkey) AS id", "r_name AS label")
    # The changes follow from the table itself, plus one added row.
    changes = now.where("id IN ('r1', 'r2')").selectExpr("id", "CASE id WHEN 'r2' THEN 'CHANGED' END AS label", "CASE id WHEN 'r1' THEN 'remove' ELSE 'set' END AS op")
    added = now.where("id = 'r0'").selectExpr("'r9' AS id", "'NEW' AS label", "'set' AS op")
    return gr.mutate(now, changes.unionByName(added))


_NAMES = ", t AS (SELECT DISTINCT name FROM v_topic)"


@query(sql("v_topic", _NAMES + """ SELECT name, CASE WHEN regexp_matches(name, '^(?:/en/.*|/tf)$') THEN 'infra' ELSE 'data' END AS class, regexp_matches(name, '^(?:/.*)$') AND NOT regexp_matches(name, '^(?:/de/.*)$') AS kept,
  substr(list_last(string_split(name, '/')), 1, 20) AS short, CASE WHEN len(list_filter(string_split(name, '/'), lambda p: p <> '')) > 1 THEN '/' || list_filter(string_split(name, '/'), lambda p: p <> '')[1] ELSE '/' END AS space FROM t"""))
def p3_topic_names(spark, d):
    n = F.col("name")
    return v_topic(spark, d).select("name").distinct().select(
        "name", sc.topic_class(n, ["/en/*", "/tf"]).alias("class"), sc.glob_filter(n, "/*,-/de/*").alias("kept"), sc.short_topic(n).alias("short"), sc.namespace(n, 1).alias("space")
    )


@query(sql("v_trace", """SELECT id, json_extract_string(props, '$.k') AS k, json_exists(props, '$.k') AS has_k, json_exists(props, '$.zz') AS has_zz, substr(sha256(CAST(id AS VARCHAR)), 1, 32) AS trace, substr(sha256(CAST(id AS VARCHAR)), 1, 16) AS span,
  (id * 16777216 + 77 >> 24) & 16777215 AS pid, (id * 16777216 + 77) & 16777215 AS tid, CASE id % 4 WHEN 1 THEN 'H2D' WHEN 2 THEN 'D2H' WHEN 3 THEN 'D2D' ELSE 'k0' END AS copy FROM v_trace JOIN events ON id = event_id"""))
def c7_scalars(spark, d):
    g = F.col("id") * 16777216 + 77
    e = read(spark, d, "events").select(F.col("event_id").alias("id"), "props")
    return e.select("id", sc.payload("props", "k").alias("k"), sc.has_key(F.col("props"), "k").alias("has_k"), sc.has_key(F.col("props"), "zz").alias("has_zz"), sc.trace_id(F.col("id").cast("string")).alias("trace"),
                    sc.span_id(F.col("id").cast("string")).alias("span"), sc.decode_pid(g).alias("pid"), sc.decode_tid(g).alias("tid"), sc.copy_direction(F.col("id") % 4).alias("copy"))


@query("""SELECT o_orderkey AS id, CASE WHEN v > 1e15 THEN CAST(floor(v / 1000000) AS BIGINT) WHEN v > 1e12 THEN CAST(floor(v / 1000) AS BIGINT) ELSE v END AS ms, CAST(round_even(v2 / g, 0) AS BIGINT) * g AS nice
  FROM (SELECT o_orderkey, CAST(o_orderkey AS BIGINT) * 1000000000000 AS v, CAST(o_orderkey AS BIGINT) * 12345 AS v2, CASE WHEN CAST(o_orderkey AS BIGINT) * 12345 >= 1000000000 THEN 50000000 WHEN CAST(o_orderkey AS BIGINT) * 12345 >= 100000000 THEN 10000000 WHEN CAST(o_orderkey AS BIGINT) * 12345 >= 10000000 THEN 1000000 WHEN CAST(o_orderkey AS BIGINT) * 12345 >= 100000 THEN 1000 ELSE 100 END AS g FROM orders)""")
def c8_to_ms(spark, d):
    k = F.col("o_orderkey").cast("bigint")
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("id"), sc.to_ms(k * 1_000_000_000_000).alias("ms"), sc.round_nice(k * 12345).alias("nice"))


@query("""WITH a AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem WHERE l_returnflag = 'A' GROUP BY ALL), b AS (SELECT l_orderkey AS k, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL)
  SELECT a.k, b.n - a.n AS delta, round(100.0 * (b.n - a.n) / nullif(a.n, 0), 6) AS pct FROM a JOIN b ON a.k = b.k""")
def j31_compare_metrics(spark, d):
    from tracewright.operators.model import compare_metrics

    n = lambda f: read(spark, d, "lineitem").where(F.col("l_returnflag") == f).groupBy(F.col("l_orderkey").alias("k")).agg(F.count(F.lit(1)).alias("value"))
    return compare_metrics(n("A"), n("R"), "k")


@query("""WITH x AS (SELECT c_nationkey AS k, count(*) AS actual FROM customer GROUP BY ALL), e AS (SELECT n_nationkey AS k, 60 AS expected FROM nation), j AS (SELECT e.k, expected, coalesce(actual, 0) AS actual FROM e LEFT JOIN x ON e.k = x.k)
  SELECT CAST(k AS VARCHAR) AS key, CAST(sum(expected) AS BIGINT) AS expected, CAST(sum(actual) AS BIGINT) AS actual, CAST(sum(actual) - sum(expected) AS BIGINT) AS delta, CASE WHEN sum(actual) = sum(expected) THEN 'ok' WHEN sum(actual) < sum(expected) THEN 'missing' ELSE 'extra' END AS verdict
  FROM j GROUP BY ROLLUP (k)""".replace("CAST(k AS VARCHAR) AS key", "coalesce(CAST(k AS VARCHAR), 'total') AS key"))
def j32_expected_vs_actual(spark, d):
    from tracewright.operators.model import expected_vs_actual

    expected = read(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("key"), F.lit(60).cast("bigint").alias("expected"))
    return expected_vs_actual(expected, read(spark, d, "customer").groupBy(F.col("c_nationkey").cast("string").alias("key")).agg(F.count(F.lit(1)).alias("actual")))
