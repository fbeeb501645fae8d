"""What reviews found: results on larger tables and odd values, and work that grew faster than the tables."""

import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tracewright.functions import scalars as sc
from tracewright.operators import build, graph, model, pairing, scale, shapes, temporal, whole
from tracewright.plans import bindings, catalog, files
from tracewright.streaming import streams


def test_units_round_the_binary_value_and_stop_at_the_largest_unit(spark):
    r = spark.range(1).select(
        sc.fmt_ns(F.lit(1_005_000_000)).alias("a"), sc.fmt_ns(F.lit(2_675_000)).alias("b"), sc.human_bytes(F.lit(3 << 30), "MiB").alias("c"), sc.human_bytes(F.lit(3 << 30)).alias("d"),
        sc.human_bytes(F.lit(1280)).alias("e"), sc.human_bytes(F.lit(1000)).alias("f"), sc.fmt_ns(F.lit(4_418_690_000_000)).alias("g"),
    ).first()
    assert tuple(r) == (f"{1.005:.2f} s", f"{2.675:.2f} ms", "3072.0 MiB", "3.0 GiB", f"{1.25:.1f} KiB", "1000 B", "4418.69 s")


def test_header_lines_of_component_lists_come_first(spark, tmp_path, monkeypatch):
    keys = [(n, k) for n in range(40) for k in (0, 5 * n + 7, -3)]
    spark.createDataFrame(keys, "s_nationkey int, s_suppkey bigint").repartition(7).write.parquet(str(tmp_path / "supplier.parquet"))
    monkeypatch.setattr(files.rd, "parse_component_list", lambda text: text)
    text = [r["value"] for r in files.s11_component_list(spark, str(tmp_path)).orderBy("file", "at").collect()]
    assert len(text) == 160 and all(v.startswith("/box") == (i % 4 == 0) for i, v in enumerate(text))
    assert all(f"/{text[i - i % 4][1:]}/c" in v for i, v in enumerate(text) if i % 4)


def test_mean_of_spans_is_exact(spark):
    spans = spark.range(6000).selectExpr("'a' AS cb", "0L AS t0", f"{2**50 + 1}L AS t1").repartition(3)
    assert pairing.span_stats(spans).first()["mean_ns"] == 2**50 + 1  # units are lost in a sum of doubles


@pytest.mark.parametrize("chunk_rows", [None, 7])
def test_earliest_open_makes_no_pairs(spark, chunk_rows):
    r = random.Random(5)
    spans = [(i, r.choice([1, 2, None]), a := r.randrange(60), a + r.choice([-1, 0, 1, 5, 40])) for i in range(120)]
    points = [(1000 + i, r.choice([1, 2, 3, None]), r.randrange(-5, 110)) for i in range(150)]
    s = spark.createDataFrame(spans, "span_id bigint, k bigint, t0 bigint, t1 bigint").repartition(3)
    p = spark.createDataFrame(points, "id bigint, k bigint, t bigint").repartition(3)
    got = {x["id"]: x["open_id"] for x in temporal.earliest_open(p, s, ["k"], chunk_rows).collect()}
    want = {i: min(((a, n) for n, q, a, b in spans if q == k and q is not None and a <= t <= b), default=(0, None))[1] for i, k, t in points}
    assert got == want and len(set(got.values())) > 10


def test_active_spans_of_a_process_are_found_without_all_pairs(spark, monkeypatch):
    def refuse(points, spans, keys):
        assert keys != ["vpid"], "pairs of a whole process"
        return contained(points, spans, keys)

    contained = temporal.contained
    monkeypatch.setattr(temporal, "contained", refuse)
    monkeypatch.setattr(model, "contained", refuse, raising=False)
    spans = spark.createDataFrame([(i, 1, 10 + i, i, 1000) for i in range(50)], "span_id bigint, vpid bigint, vtid bigint, t0 bigint, t1 bigint")
    points = spark.createDataFrame([(100, 1, 12, 70), (101, 1, 5, 70), (102, 1, 5, 1001), (103, 2, 5, 70)], "id bigint, vpid bigint, vtid bigint, t bigint")
    got = {r["id"]: (r["span_id"], r["rule"]) for r in model.attribute_by_active(points, spans).collect()}
    assert got == {100: (2, "thread"), 101: (0, "process"), 102: (None, "none"), 103: (None, "none")}


@pytest.mark.parametrize("chunk_rows", [None, 9])
def test_overlaps_are_counted_without_pairs(spark, monkeypatch, chunk_rows):
    monkeypatch.setattr(temporal, "contained", None)
    r = random.Random(6)
    spans = [(i, r.choice([1, 2, None]), a := r.randrange(60), a + r.choice([-1, 0, 1, 5, 40])) for i in range(120)]
    points = [(1000 + i, r.choice([1, 2, 3, None]), r.choice([None, *range(-5, 110)])) for i in range(150)]
    s = spark.createDataFrame(spans, "span_id bigint, k bigint, t0 bigint, t1 bigint").repartition(3)
    p = spark.createDataFrame(points, "id bigint, k bigint, t bigint").repartition(3)
    more = {"chunk_rows": chunk_rows} if chunk_rows else {}
    got = {x["id"]: x["overlaps"] for x in temporal.interval_overlaps(p, s, ["k"], **more).collect()}
    assert got == {i: sum(q is not None and t is not None and q == k and a <= t <= b for _, q, a, b in spans) for i, k, t in points}


def test_keys_of_grid_joins_are_counted_by_many_tasks(spark, monkeypatch):
    made = {}

    def noted(df, tag, *args, **kwargs):
        made[tag] = kwargs
        return written(df, tag, *args, **kwargs)

    written = scale.written
    monkeypatch.setattr(scale, "written", noted)
    left = spark.range(3000).selectExpr("id % 300 AS k", "id AS a")
    right = spark.range(900).selectExpr("id % 300 AS k", "id AS b")
    assert scale.grid_join(left, right, "k", cell_pairs=20).count() == 9000
    assert made["hot-keys"].get("rows") is None, "so few files that one task would count all keys"


def test_pca_by_steps_stops_where_its_sql_does(spark):
    rows = [(i, float(i * 7 % 11), float(i * i % 13), float(i * 5 % 17)) for i in range(60)]
    df = spark.createDataFrame(rows, "inv long, a double, b double, c double")
    z = np.array(rows)[:, 1:]
    z = (z - z.mean(axis=0)) / z.std(axis=0)
    m, want = z.T @ z / len(z), []
    for _ in range(2):
        v = np.array([1.0, 1.1, 1.2])
        for _ in range(4):
            v = m @ v / np.linalg.norm(m @ v)
        want.append(z @ v * np.sign(v[np.abs(v).argmax()]))
        m = m - (v @ m @ v) * np.outer(v, v)
    got = np.array([tuple(r)[1:] for r in shapes.pca(df, steps=4).orderBy("inv").collect()])
    exact = np.array([tuple(r)[1:] for r in shapes.pca(df).orderBy("inv").collect()])
    assert np.abs(got - np.array(want).T).max() < 1e-9 < 1e-3 < np.abs(got - exact).max()


def test_edges_are_grouped_by_numbers(spark):
    for view, key in ((bindings.v_edge, "o_custkey"), (bindings.v_hop, "l_suppkey")):
        plan = view(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert f"hashpartitioning({key}" in plan, "names are shuffled"


@pytest.mark.parametrize("depth", [graph.bfs_depth, graph.longest_depth])
def test_links_are_not_shuffled_in_the_rounds_of_depths(spark, monkeypatch, depth):
    plans = {}

    def noted(df, tag, *args, **kwargs):
        plans.setdefault(tag, []).append(df._jdf.queryExecution().executedPlan().toString())
        return written(df, tag, *args, **kwargs)

    written, key = scale.written, "spark.sql.autoBroadcastJoinThreshold"
    monkeypatch.setattr(graph, "written", noted)
    edges = spark.createDataFrame([(a, b) for a in range(4) for b in range(a + 1, 6)] + [(9, 0), (9, 0), (8, 5)], "src long, dst long")
    spark.conf.set(key, "-1")  # as where the nodes of a graph are above the limit for a table of unknown size
    try:
        got = {r["id"]: r["depth"] for r in depth(edges).collect()}
    finally:
        spark.conf.unset(key)
    assert got[5] == (1 if depth is graph.bfs_depth else 5) and got[0] == 1 and got[9] == 0
    assert all("BroadcastHashJoin" in p for p in plans["depths" if depth is graph.bfs_depth else "peeled"][1:])
    assert "Exchange" not in plans["short"][0].replace("BroadcastExchange", ""), "links of contracted chains are grouped again"


def test_components_do_not_sort_out_copies_of_links_first(spark, monkeypatch):
    plans = []

    def noted(df, tag, *args, **kwargs):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return written(df, tag, *args, **kwargs)

    written = scale.written
    monkeypatch.setattr(graph, "written", noted)
    edges = spark.createDataFrame([(1, 2), (2, 1), (2, 1), (3, 3), (3, 3), (2, 4), (5, None)], "src long, dst long")
    assert sorted(map(tuple, graph.components(edges).collect())) == [(1, 1), (2, 1), (3, 3), (4, 1)]
    assert "Exchange" not in plans[0]


def test_edges_of_call_graphs_are_made_in_one_pass(spark):
    calls = spark.createDataFrame([(1, p, "ab"[p % 2], s, 1.0) for p, s in ((1, 5), (2, None), (3, 5), (4, 6))] + [(2, 1, "a", 5, 1.0)], "inv long, pos int, token string, stream int, cost double")
    nodes, edges = shapes.typed_dag(calls)
    plan = edges._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1, plan
    got = sorted(map(tuple, edges.collect()))
    assert got == [(1, 0, 1, "launch"), (1, 0, 2, "cpu_order"), (1, 1, 4, "stream_fifo"), (1, 2, 3, "cpu_order"), (1, 3, 4, "launch"), (1, 3, 5, "cpu_order"), (1, 5, 6, "launch"), (2, 0, 1, "launch")]
    row = {r["inv"]: r.asDict() for r in shapes.dag_features(nodes, edges).collect()}
    assert [row[1][c] for c in ("n_cpu", "n_sm", "n_streams", "e_launch", "e_fifo", "e_order", "depth", "branch")] == [4, 3, 2, 3, 1, 3, 3, 1]
    assert [row[2][c] for c in ("total", "e_launch", "e_order", "branch")] == [2, 1, 0, 1]


def test_composed_edges_are_counted_without_moving_them(spark):
    plan = catalog.g14_compose(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(src" not in plan and "SortMergeJoin" not in plan


def test_runs_are_named_behind_the_shuffle_of_sequences(spark, monkeypatch):
    kept = {}

    def noted(df, tag, *args, **kwargs):
        kept[tag] = df.columns
        return written(df, tag, *args, **kwargs)

    written = scale.written
    monkeypatch.setattr(shapes, "written", noted)
    rows = spark.createDataFrame([(1, list("abcde")), (1, list("xbcdy")), (2, list("aa")), (3, list("ab")), (3, list("cd"))], "k long, tokens array<string>")
    assert sorted(map(tuple, shapes.common_block(rows, "k").collect())) == [("1", 3, "b,c,d"), ("2", 2, "a,a")]
    assert kept["sequences"] == ["key", "tokens"] and "levels" not in kept["shortest"]


def test_streams_keep_the_rows_of_a_batch_in_one_call():
    calls = []

    class State:
        def __init__(self):
            self.rows = []

        def exists(self):
            return bool(self.rows)

        def get(self):
            return iter(self.rows)

        def put(self, rows):
            calls.append("put")
            self.rows = list(rows)

        def clear(self):
            self.rows = []

        def appendValue(self, row):
            calls.append("appendValue")
            self.rows.append(row)

        def appendList(self, rows):
            calls.append("appendList")
            self.rows.extend(rows)

    class Handle:
        def __init__(self):
            self.timers = []

        def getListState(self, name, schema):
            return State()

        def getValueState(self, name, schema):
            return State()

        def registerTimer(self, ms):
            self.timers.append(ms)

    class Clock:
        def __init__(self, ms):
            self.ms = ms

        def getCurrentWatermarkInMs(self):
            return self.ms

    rows = pd.DataFrame([(i, i * 1_000_000, 1, 2, "c", "callback_start" if i % 2 == 0 else "callback_end") for i in range(20)], columns=["id", "ts_ns", "vpid", "vtid", "cb", "event"])
    for p, key in ((streams.PairNested(10**18), (1, 2)), (streams.SyncSessions(["vtid"], 5, 10**18), (2,))):
        handle = Handle()
        p.init(handle)
        calls.clear()
        list(p.handleInputRows(key, iter([rows.iloc[12:], rows.iloc[:12]]), Clock(3)))
        assert calls == ["appendList", "appendList"] and sorted(w[0] for w in p.wait.get())[0] == (3 if key == (1, 2) else 3_000_000) and min(handle.timers) == 4
        if key == (1, 2):
            spans = pd.concat(list(p.handleExpiredTimer(key, Clock(100), None)))
            assert list(spans["span_id"]) == list(range(4, 20, 2)) and not p.wait.rows


def test_pairs_of_topics_with_one_publisher_are_made_once_for_all_levels(spark, monkeypatch):
    tags = []

    def noted(df, tag, *args, **kwargs):
        tags.append(tag)
        return written(df, tag, *args, **kwargs)

    written = scale.written
    monkeypatch.setattr(build, "written", noted)
    from tracewright.plans import shapes as queries

    queries.g3_comm_edges(spark, "/root/testdata/sf0.001")
    assert tags == ["ends", "apart"]


def test_betweenness_writes_tiles_not_pairs(spark, monkeypatch):
    rows, write = [], scale.written
    monkeypatch.setattr(graph, "written", lambda df, tag, *a, **k: rows.append((tag, write(df, tag, *a, **k))) or rows[-1][1])
    monkeypatch.setattr(graph, "TILE_PAIRS", 1)
    r = random.Random(3)
    links = {(r.randrange(24), r.randrange(24)) for _ in range(60)} | {(100, 101), (101, 102), (102, 100)}
    links = {(f"n{a}", f"n{b}") for a, b in links if a != b}
    e = spark.createDataFrame(sorted(links), "src string, dst string")
    got = {x["id"]: x["betweenness"] for x in graph.betweenness(e, 300, tile=5).collect()}  # two batches of sources
    out, total = {}, {x: 0.0 for link in links for x in link}
    for a, b in links:
        out.setdefault(a, []).append(b)
    dist, paths = {}, {}
    for s in total:
        dist[s], paths[s], front = {s: 0}, {s: 1}, [s]
        while front:
            step = {}
            for v in front:
                for w in out.get(v, []):
                    if w not in dist[s]:
                        step[w] = step.get(w, 0) + paths[s][v]
            dist[s].update(dict.fromkeys(step, dist[s][front[0]] + 1))
            paths[s].update(step)
            front = list(step)
    for s in total:
        for v in dist[s].keys() - {s}:
            total[v] += sum(paths[s][v] * paths[v][t] / paths[s][t] for t in dist[v].keys() - {s, v} if dist[s][t] == dist[s][v] + dist[v][t])
    n = len(total)
    assert got.keys() == total.keys() and all(abs(got[k] - total[k] / ((n - 1) * (n - 2))) < 1e-8 for k in total)
    chunks = next(df for tag, df in rows if tag == "chunks")
    assert chunks.select("batch").distinct().count() == 2 and all(len(df.columns) == 4 for tag, df in rows if tag == "level")


def test_edges_of_a_model_are_counted_without_pairs(spark):
    r = random.Random(11)
    table = lambda rows, names: spark.createDataFrame(sorted(set(rows)), ", ".join(f"{n} string" for n in names.split()))
    ids = [f"e{i}" for i in range(40)]
    node = {x: f"n{r.randrange(6)}" for x in ids}
    nodes = table([(x, node[x], "x" + str(int(node[x][1]) % 3)) for x in ids], "entity node executor")
    some = lambda n, names, tag: table([(node[x], x, f"{tag}{r.randrange(4)}") for x in r.choices(ids, k=n)], names)
    pub, sub = some(30, "node entity topic", "t"), some(50, "node entity topic", "t")
    clients, servers = some(15, "node entity service", "s"), some(12, "node entity service", "s")
    ingress, egress = some(30, "node entity group", "g"), some(30, "node entity group", "g")  # some are both
    functions = model.split_callbacks(table([(x, f"f{x}", "main") for x in ids[:33]], "entity function part"), clients)
    joins = table([(node[x], x, "completer", "t1") for x in ids[:9]], "node entity role join_group")
    state = spark.createDataFrame([("e1", "e2", "t0", 0), ("e3", "e2", "t0", 4), ("e5", "e6", "t0", 2)], "src string, dst string, topic string, takes bigint")
    every = (pub, sub, clients, servers, functions, nodes, joins, state, ingress, egress)
    pairs = build.comm_edges(*every, store=True)
    want = pairs.groupBy("level", "nature", "direction").agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("n"))
    key = lambda df: sorted(str(tuple(x)) for x in df.collect())
    assert key(build.comm_totals(*every)) == key(want) and want.count() == 13
    upper = "level IN ('L0', 'L1')"
    assert key(build.comm_edges(*every).where(upper)) == key(pairs.where(upper))
    # 4e10 pairs of one topic, which the form before would have had to make
    many = spark.range(200_000).select(F.lit("n0").alias("node"), F.concat(F.lit("m"), "id").alias("entity"), F.lit("t0").alias("topic"))
    got = build.comm_totals(many, many, clients, servers, functions, many.select("entity", "node", F.lit("x").alias("executor")))
    assert got.where("level = 'L2' AND nature = 'msg'").first()["rows"] == 200_000**2


@pytest.mark.parametrize("limit", [None, 0])
def test_rows_with_long_texts_are_dealt_whatever_their_topics(spark, monkeypatch, limit):
    if limit is not None:
        monkeypatch.setattr(model, "TEXT_BYTES", limit)
    before = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    links = spark.range(2000).select("id", F.lit(1).alias("vpid"), (F.col("id") % 3).alias("handle"))
    handles = spark.createDataFrame([(1, 0, "a"), (1, 0, "a"), (1, 1, "a"), (1, 2, "none")], "vpid int, handle long, topic string")
    edges = spark.createDataFrame([("x", "b", "a"), ("y", "a", "a"), ("z", "b", "a"), ("z", "c", "other")], "src string, dst string, topic string")
    try:
        for k, v in zip(before, ("-1", "false")):
            spark.conf.set(k, v)
        rows = model.causal_feed(links, handles, edges).withColumn("task", F.spark_partition_id()).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(r["id"] for r in rows) == list(range(2000)) and all(r["subscribers"] == (None if r["id"] % 3 == 2 else "a,b") for r in rows)
    of_a = [r["task"] for r in rows if r["topic"] == "a"]
    assert max(of_a.count(t) for t in set(of_a)) < len(of_a) / 2  # all in one task before


def test_betweenness_of_components_takes_no_level_tables(spark, monkeypatch):
    tags, write = [], scale.written
    monkeypatch.setattr(graph, "written", lambda df, tag, *a, **k: tags.append(tag) or write(df, tag, *a, **k))
    monkeypatch.setattr(graph, "LEAST_WORK", 1)  # the sources of a bin are shared by several tasks
    monkeypatch.setattr(graph, "BIN_NODES", 20)
    layer = lambda k, wide: [f"c{k}-{x}" for x in range(wide)]
    links, want = [], {}
    for c in range(4):  # components of layers that are linked in full: sizes differ, so bins have one or some
        sizes = [2 + c, 3, 2, 3 + c]
        rows = [layer(f"{c}-{d}", w) for d, w in enumerate(sizes)]
        links += [(a, b) for x, y in zip(rows, rows[1:]) for a in x for b in y]
        for d, x in enumerate(rows):  # each path from before a layer to behind it passes one of its nodes, all alike
            want |= dict.fromkeys(x, sum(sizes[:d]) * sum(sizes[d + 1 :]) / sizes[d])
    links += [(f"leaf{k}", "hub") for k in range(3)] + [("hub", f"end{k}") for k in range(4)]  # nothing but leaves
    want |= {"hub": 12.0} | dict.fromkeys([f"leaf{k}" for k in range(3)] + [f"end{k}" for k in range(4)], 0.0)
    got = {r["id"]: r["betweenness"] for r in graph.betweenness(spark.createDataFrame(links, "src string, dst string")).collect()}
    n = len(want)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k] / ((n - 1) * (n - 2))) < 1e-8 for k in want)
    assert "wholes" in tags and not {"level", "passed", "chunks"} & set(tags)


@pytest.mark.parametrize("block, dense, cells, rounds", [(4, 1, 8, 1), (8, 3, 200, 2), (256, 1000, 1 << 20, 64)])
def test_shares_of_a_whole_graph_equal_all_shortest_paths(monkeypatch, block, dense, cells, rounds):
    for name, value in zip(("BLOCK", "DENSE", "CELLS", "ROUNDS"), (block, dense, cells, rounds)):
        monkeypatch.setattr(whole, name, value)
    r = random.Random(block)
    links = sorted({(a, b) for a, b in ((r.randrange(40), r.randrange(40)) for _ in range(90)) if a != b} | {(x, 39) for x in range(30)} | {(k, (k + 1) % 40) for k in range(40)})
    dist, paths = {}, {}
    for s in range(40):
        dist[s], paths[s], front = {s: 0}, {s: 1}, [s]
        while front:
            step = {}
            for a, b in links:
                if a in front and b not in dist[s]:
                    step[b] = step.get(b, 0) + paths[s][a]
            dist[s].update(dict.fromkeys(step, dist[s][front[0]] + 1))
            paths[s].update(step)
            front = list(step)
    want = [sum(paths[s][v] * paths[v][t] / paths[s][t] for s in range(40) for t in range(40) if len({s, v, t}) == 3 and dist[s][t] == dist[s][v] + dist[v][t]) for v in range(40)]
    none = pa.array([[0.0] * 40], pa.list_(pa.float64()))
    codes = pa.array([[a << 32 | b for a, b in links]], pa.list_(pa.int64()))
    rows = [pa.RecordBatch.from_arrays([pa.array([5]), pa.array([k]), pa.array([3]), codes, none, none], ["bin", "share", "shares", "links", "ends", "starts"]) for k in range(3)]
    sums = [x.column("sums")[0].as_py() for x in whole.shares(iter(rows))]
    assert all(abs(sum(x[v] for x in sums) - want[v]) < 1e-9 for v in range(40))


def test_long_texts_are_written_once_in_a_file(spark, tmp_path):
    key = "parquet.dictionary.page.size"
    before = spark.conf.get(key, None)
    links = spark.range(4000).select("id", F.lit(1).alias("vpid"), (F.col("id") % 3).alias("handle"))
    handles = spark.createDataFrame([(1, 0, "a"), (1, 1, "b"), (1, 2, "none")], "vpid int, handle long, topic string")
    edges = spark.range(1000).select(F.concat(F.lit("s"), "id").alias("dst"), F.when(F.col("id") < 600, "a").otherwise("b").alias("topic"))
    try:
        spark.conf.set(key, "1500")  # less than either text
        model.causal_feed(links, handles, edges).na.fill("", ["subscribers"]).write.parquet(str(tmp_path / "feed"))
        assert int(spark.conf.get(key)) < 10_000
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)
    rows = spark.read.parquet(str(tmp_path / "feed")).groupBy("topic").agg(F.count(F.lit(1)).alias("n"), F.min("subscribers").alias("x"), F.max("subscribers").alias("y"))
    got = {r["topic"]: (r["n"], r["x"], r["y"]) for r in rows.collect()}
    a, b = (",".join(sorted(f"s{k}" for k in ids)) for ids in (range(600), range(600, 1000)))
    assert got == {"a": (1334, a, a), "b": (1333, b, b), "none": (1333, "", "")}
    files = [pq.ParquetFile(f).metadata for f in (tmp_path / "feed").glob("*.parquet")]
    groups = [m.row_group(k).column(m.schema.names.index("subscribers")) for m in files for k in range(m.num_row_groups)]
    assert groups and all("PLAIN" not in g.encodings for g in groups) and sum(m.num_rows for m in files) == 4000
