"""Graph loops, the model's rules and shape operators on hand-written tables."""

import random
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tracewright.functions import scalars as sc
from tracewright.operators import graph, model, shapes

EDGE = "src string, dst string, topic string, n long"


def test_components_and_depth(spark):
    e = spark.createDataFrame([("a", "b", "t", 1), ("b", "c", "t", 1), ("a", "c", "u", 1), ("x", "y", "t", 2), ("y", "x", "t", 1), ("q", "q", "t", 1)], EDGE)
    assert {r["node"]: r["component"] for r in graph.components(e).collect()} == {"a": "a", "b": "a", "c": "a", "x": "x", "y": "x", "q": "q"}
    assert {r["id"]: r["depth"] for r in graph.bfs_depth(e).collect()} == {"a": 0, "b": 1, "c": 1, "x": -1, "y": -1, "q": -1}
    assert {r["id"]: r["depth"] for r in graph.longest_depth(e).collect()} == {"a": 0, "b": 1, "c": 2, "x": 0, "y": 0}
    tasks = {r["component"]: r for r in graph.task_graphs(e).collect()}
    assert (tasks["a"]["nodes"], tasks["a"]["roots"], tasks["a"]["sinks"], tasks["a"]["depth"], tasks["x"]["roots"]) == (3, 1, 1, 2, 0)


def test_components_of_a_random_graph(spark):
    r = random.Random(8)
    edges = [(f"{r.randrange(200):03d}", f"{r.randrange(200):03d}") for _ in range(150)]
    root = {}

    def find(x):
        root.setdefault(x, x)
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {x["node"]: x["component"] for x in graph.components(spark.createDataFrame([(a, b, "t", 1) for a, b in edges], EDGE)).collect()}
    assert got == {x: find(x) for x in root}


def test_betweenness_of_a_path(spark):
    e = spark.createDataFrame([("a", "b", "t", 1), ("b", "c", "t", 1), ("a", "d", "t", 1), ("d", "c", "t", 1), ("c", "e", "t", 1)], EDGE)
    got = {r["id"]: round(r["betweenness"], 6) for r in graph.betweenness(e).collect()}
    assert got == {"a": 0.0, "b": round(1 / 12, 6), "c": round(3 / 12, 6), "d": round(1 / 12, 6), "e": 0.0}


def test_mutate_and_cascade(spark):
    v = spark.createDataFrame([("a", "1", None), ("b", "2", "x")], "id string, label string, note string")
    c = spark.createDataFrame([("set", "a", "9", None), ("set", "z", "new", "n"), ("remove", "b", None, None)], "op string, id string, label string, note string")
    out = graph.mutate(v, c)
    assert sorted(map(tuple, out.collect())) == [("a", "9", None), ("z", "new", "n")]
    e = spark.createDataFrame([("a", "z", "t", 1), ("a", "b", "t", 1)], EDGE)
    assert [r["dst"] for r in graph.remove_dangling(e, out).collect()] == ["z"]


def events(spark, rows):
    return spark.createDataFrame([("s", 1, k, k, e, p) for k, (e, p) in enumerate(rows)], "session_id string, vpid int, ts_ns long, id long, event string, payload map<string,string>")


def test_resolve_and_pick(spark):
    ev = events(spark, [
        ("subscription_init", {"subscription_handle": "h1", "topic_name": "/t"}), ("subscription_object", {"subscription_handle": "h1", "subscription": "o1"}),
        ("subscription_object", {"subscription_handle": "h1", "subscription": "o2"}), ("subscription_callback_added", {"subscription": "o1", "callback": "c1"}),
        ("subscription_callback_added", {"subscription": "o2", "callback": "c2"}), ("callback_register", {"callback": "c2", "symbol": "f()"}),
        ("timer_init", {"timer_handle": "m1", "period_ns": "100"}), ("timer_callback_added", {"timer_handle": "m1", "callback": "c3"}),
    ])
    cand = model.resolve_chain(ev)
    assert sorted((r["handle"], r["cb"], r["pos"], r["symbol"], r["kind"], r["name"]) for r in cand.collect()) == [("h1", "c1", 1, None, "sub", "/t"), ("h1", "c2", 2, "f()", "sub", "/t"), ("m1", "c3", 1, None, "tmr", "100")]
    keys = "session_id string, vpid int, cb string"
    none = spark.createDataFrame([], keys)
    pick = lambda fired, intra: {r["handle"]: (r["cb"], r["reason"], r["alternates"]) for r in model.pick_candidate(cand, spark.createDataFrame([("s", 1, c) for c in fired], keys) if fired else none, spark.createDataFrame([("s", 1, c) for c in intra], keys) if intra else none).collect()}
    assert pick([], [])["h1"] == ("c1", "first", []) and pick([], [])["m1"] == ("c3", "single", [])
    assert pick(["c2"], [])["h1"] == ("c2", "first_fired", []) and pick([], ["c2"])["h1"] == ("c2", "intra", [])
    assert pick(["c1", "c2"], ["c2"])["h1"] == ("c2", "intra_fired", ["c1"])
    bound = model.bind_intra(cand, spark.createDataFrame([("s", 1, "c2")], "session_id string, vpid int, callback string"))
    assert {r["handle"]: r["delivery"] for r in bound.collect()} == {"h1": "both", "m1": "dds"}


def test_joins_roles(spark):
    pub = spark.createDataFrame([("n", "a", "sub", "/o"), ("n", "b", "sub", "/o"), ("n", "t", "tmr", "/o"), ("n", "c", "sub", "/x")], "node string, entity string, kind string, topic string")
    types = spark.createDataFrame([("n", "a", "sub", "I"), ("n", "b", "sub", "J"), ("n", "c", "sub", "I"), ("n", "t", "tmr", None)], "node string, entity string, kind string, msg_type string")
    got = sorted((r["entity"], r["role"], r["join_group"]) for r in model.detect_joins(pub, types).collect())
    assert got == [("a", "completer", "/o"), ("b", "completer", "/o"), ("c", "member", "/o"), ("t", "timeout", "/o")]


def test_functions_of_services(spark):
    fns = spark.createDataFrame([("s", "fs", "main"), ("c", "fc", "main")], "entity string, function string, part string")
    split = model.split_callbacks(fns, spark.createDataFrame([("c",)], "entity string"))
    edges = spark.createDataFrame([("c", "s", "/v", "request"), ("s", "c", "/v", "response")], "src string, dst string, topic string, part string")
    got = sorted((r["src"], r["dst"]) for r in model.propagate_functions(edges, split).collect())
    assert got == [("fc", "fs"), ("fs", "fc#cont")]


def test_hyperperiod_is_capped(spark):
    rows = [("a", 4), ("a", 6), ("b", 3_000_000_000_001), ("b", 3_000_000_000_007), ("b", 3_000_000_000_013)]
    got = {r["executor"]: (r["hyperperiod_ns"], r["capped"]) for r in model.hyperperiod(spark.createDataFrame(rows, "executor string, period_ns long")).collect()}
    assert got["a"] == (12, False) and got["b"][1]


def test_shapes(spark):
    seqs = spark.createDataFrame([("k", 1, list("abcd")), ("k", 2, list("xabd")), ("k", 3, list("abzd"))], "key string, inv long, tokens array<string>")
    assert shapes.skeleton(seqs, "key").first()["skeleton"] == list("abd")
    assert tuple(shapes.common_block(seqs, "key").first()) == ("k", 2, "a,b")
    a = seqs.withColumn("match", shapes.align(F.col("tokens"), F.array(*[F.lit(x) for x in "abd"])))
    assert {r["inv"]: r["match"] for r in a.collect()} == {1: [0, 1, -1, 2], 2: [-1, 0, 1, 2], 3: [0, 1, -1, 2]}
    blocks = shapes.insertions(a)
    assert sorted((r["inv"], r["after"], r["block"]) for r in blocks.collect()) == [(1, 1, ["c"]), (2, -1, ["x"]), (3, 1, ["z"])]
    rows = [("k", 1, list("abc"), "S"), ("k", 2, list("abc"), "S"), ("k", 3, list("abcabc"), "D"), ("k", 4, list("ab"), "P"), ("k", 5, list("zz"), "Z")]
    got = shapes.classify_periods(spark.createDataFrame(rows, "key string, inv long, tokens array<string>, sig string"), 2).collect()
    assert {r["inv"]: r["phase"] for r in got} == {1: "STEADY", 2: "STEADY", 3: "COALESCED(2)", 4: "TAIL", 5: "UNKNOWN"}


def test_scalars(spark):
    one = spark.createDataFrame([("void ns::deep::scope::kern<int, A<b>>(float*, int)", "/a/b/node", "timer_500ns", 281506400436224, {"x": "1"})], "k string, n string, l string, g long, m map<string,string>")
    r = one.select(
        sc.short_kernel(F.col("k")).alias("k"), sc.namespace(F.col("n"), 1).alias("n"), sc.component(F.col("n"), 5).alias("c"), sc.timer_period(F.col("l")).alias("p"), sc.decode_pid(F.col("g")).alias("g"),
        sc.resolve_placeholders(F.lit("{x}/y"), F.col("m")).alias("r"), sc.resolve_placeholders(F.lit("{z}"), F.col("m")).alias("none"), sc.short_symbol(F.lit("a" * 70)).alias("s"), sc.action_name(F.lit("/go/_action/status")).alias("a"),
        sc.human_bytes(F.lit(2048)).alias("h"), sc.fmt_ns(F.lit(1_500_000)).alias("f"), sc.safe_id(F.lit("/a-b/")).alias("i"), sc.throughput(F.lit(10), F.lit(0)).alias("t"), sc.copy_direction(F.lit(5)).alias("d"),
    ).first()
    assert tuple(r) == ("deep::scope::kern", "/a", "/a/b", 500, r["g"], "1/y", None, "..." + "a" * 57, "/go", "2.0 KiB", "1.50 ms", "a_b", None, "k5")
    assert r["g"] == (281506400436224 >> 24) & 0xFFFFFF


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="no tables")
def test_edge_views_hold_all_line_items_and_paths(spark):
    from tracewright.plans import bindings, graphs

    d = "/root/testdata/sf0.001"
    line = bindings.read(spark, d, "lineitem")
    assert bindings.v_edge(spark, d).agg(F.sum("n")).first()[0] == line.count()
    assert bindings.v_hop(spark, d).agg(F.sum("n")).first()[0] == line.count() - line.select("l_orderkey").distinct().count()
    longest = line.groupBy("l_orderkey").count().agg(F.max("count")).first()[0] - 1
    assert graphs.g5_task_graphs(spark, d).agg(F.max("depth")).first()[0] == longest > 1
    assert {r["role"] for r in graphs.h10_dataflow_role(spark, d).select("role").distinct().collect()} >= {"source", "relay", "sink"}
    links = {(r["src"], r["dst"]) for r in bindings.v_hop(spark, d).collect()}
    want = brute_betweenness(links)
    got = {r["id"]: r["betweenness"] for r in graphs.g11_betweenness(spark, d).collect()}
    assert got.keys() == want.keys() and max(want.values()) > 0 and all(abs(got[k] - want[k]) < 1e-8 for k in want)


def brute_betweenness(links):
    """For each middle node, the share of the shortest paths between all pairs of others that pass it, by path counts between all pairs."""
    nodes = sorted({x for e in links for x in e})
    out = {x: sorted({b for a, b in links if a == x}) for x in nodes}
    dist, paths = {}, {}
    for s in nodes:
        dist[s], paths[s], front = {s: 0}, {s: 1}, [s]
        while front:
            count = {}
            for v in front:
                for w in out[v]:
                    if w not in dist[s]:
                        count[w] = count.get(w, 0) + paths[s][v]
            for w in count:
                dist[s][w], paths[s][w] = dist[s][front[0]] + 1, count[w]
            front = list(count)
    total = dict.fromkeys(nodes, 0.0)
    for s in nodes:
        for v in dist[s]:
            if v == s:
                continue
            for t in dist[v]:
                if t not in (s, v) and dist[s].get(t) == dist[s][v] + dist[v][t]:
                    total[v] += paths[s][v] * paths[v][t] / paths[s][t]
    n = len(nodes)
    return {v: x / ((n - 1) * (n - 2)) for v, x in total.items()}


def test_depths_of_a_chain_of_100(spark):
    name = lambda k: f"n{k:03d}"
    e = spark.createDataFrame([(name(k), name(k + 1), "t", 1) for k in range(99)], EDGE).coalesce(1)
    want = {name(k): k for k in range(100)}
    assert {r["id"]: r["depth"] for r in graph.bfs_depth(e).collect()} == want
    assert {r["id"]: r["depth"] for r in graph.longest_depth(e).collect()} == want


def plain_depths(links):
    """Breadth-first depth from nodes without incoming links, and the depth by peeling."""
    nodes = {x for e in links for x in e}
    near = {x: 0 for x in nodes if all(b != x for _, b in links)}
    front = list(near)
    while front:
        step = {b: near[a] + 1 for a, b in links if a in front and b not in near}
        near |= step
        front = list(step)
    links = {(a, b) for a, b in links if a != b}
    far, left = dict.fromkeys({x for e in links for x in e}, 0), set(links)
    while free := {a for a, _ in left} - {b for _, b in left}:
        for a, b in left:
            if a in free:
                far[b] = max(far[b], far[a] + 1)
        left = {(a, b) for a, b in left if a not in free}
    return {x: near.get(x, -1) for x in nodes}, far


@pytest.mark.parametrize("seed", [1, 2])
def test_depths_and_betweenness_of_random_graphs_with_chains_and_rings(spark, seed):
    r = random.Random(seed)
    links = {(f"n{r.randrange(30)}", f"n{r.randrange(30)}") for _ in range(28)}
    for c in range(8):  # chains between random nodes, some from or to nothing
        chain = [f"n{r.randrange(30)}"] * r.randrange(2) + [f"c{c}-{k}" for k in range(r.choice([1, 3, 9]))] + [f"n{r.randrange(30)}"] * r.randrange(2)
        links |= set(zip(chain, chain[1:]))
    links |= {("r0", "r1"), ("r1", "r2"), ("r2", "r0"), ("s0", "s1"), ("s1", "s2"), ("s2", "s0"), ("s1", "end"), ("only", "pair"), ("self", "self")}
    e = spark.createDataFrame([(a, b, "t", 1) for a, b in sorted(links)], EDGE)
    near, far = plain_depths(links)
    assert {x["id"]: x["depth"] for x in graph.bfs_depth(e).collect()} == near
    assert {x["id"]: x["depth"] for x in graph.longest_depth(e).collect()} == far
    want = brute_betweenness({(a, b) for a, b in links if a != b})
    for pairs in (10**6, 800):
        got = {x["id"]: x["betweenness"] for x in graph.betweenness(e, pairs).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-8 for k in want)


def test_a_chain_of_10000_takes_few_rounds(spark, monkeypatch):
    rounds = []
    monkeypatch.setattr(graph, "written", lambda df, tag, *a, f=graph.written, **k: rounds.append(tag) or f(df, tag, *a, **k))
    ids = list(range(10_000))
    random.Random(3).shuffle(ids)
    e = spark.createDataFrame([(f"{ids[k]:05d}", f"{ids[k + 1]:05d}", "t", 1) for k in range(9_999)], EDGE)
    for f in (graph.bfs_depth, graph.longest_depth):
        rounds.clear()
        got = {x["id"]: x["depth"] for x in f(e).collect()}
        assert got == {f"{i:05d}": k for k, i in enumerate(ids)} and len(rounds) < 26, rounds  # 15 doublings and a few others
    rounds.clear()
    assert {x["component"] for x in graph.components(e).collect()} == {"00000"} and len(rounds) < 40, rounds


def test_busy_topics_are_spread_over_a_grid(spark):
    from tracewright.operators.scale import grid_join

    left = spark.range(3000).select(F.when(F.col("id") < 2000, 1).when(F.col("id") % 7 == 0, None).otherwise(F.col("id") % 50).alias("k"), F.col("id").alias("a"))
    right = spark.range(400).select((F.col("id") % 40).alias("k"), F.col("id").alias("b"))
    want = sorted(left.join(right, "k").collect())
    assert sorted(grid_join(left, right, "k", cell_pairs=500).collect()) == want and sorted(grid_join(left, right, "k").collect()) == want
    # A topic with 100,000 publishers and 10 takers: no task gets more than a few cells.
    pub = spark.range(100_000).select(F.lit("busy").alias("topic"), F.col("id").alias("entity"), F.lit(0).alias("node"))
    sub = spark.range(10).select(F.lit("busy").alias("topic"), F.col("id").alias("entity"), F.lit(0).alias("node"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        pairs = grid_join(pub.withColumnRenamed("entity", "p"), sub.select("topic", F.col("entity").alias("s")), "topic", cell_pairs=20_000)
        per = [x["count"] for x in pairs.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(per) == 1_000_000 and len(per) > 20 and max(per) < 150_000
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert model.match_topics(pub.limit(50), sub).count() == 500


def test_profiled_pids_descend_through_wrappers(spark):
    tree = [(10, 1, "nsys"), (11, 10, "nsys-launcher a"), (12, 11, "nsys b"), (13, 12, "node"), (14, 13, "child"), (15, 10, "direct"), (20, 1, "nsys"), (21, 20, "other"), (30, 31, "nsys"), (31, 30, "nsys"), (32, 31, "ring"), (40, 10, None)]
    log = [("resurrect", 10), ("resurrect", None), ("kill", 20)]
    calls, own = [((7 << 24) + 5,), ((7 << 24) + 6,), ((8 << 24) + 1,)], [(700, 7 << 24), (900, 9 << 24)]
    got = model.profiled_pids(
        spark.createDataFrame(log, "action string, resurrected_pid long"), spark.createDataFrame(tree, "pid long, ppid long, cmd string"),
        spark.createDataFrame(calls, "global_tid long"), spark.createDataFrame(own, "pid long, global_pid long"), "nsys",
    )
    assert sorted(map(tuple, got.collect())) == [(13, "resurrect", 0), (15, "resurrect", 0), (40, "resurrect", 0), (700, "launch_wrap", 2)]


def plain_common(a, b):
    """A longest common subsequence by the full table; on ties the first sequence's token is dropped."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if a[i] == b[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append(a[i])
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def test_skeleton_equals_a_plain_fold(spark):
    r = random.Random(7)
    for _ in range(300):
        a, b = ([r.choice("abcd"[: r.randrange(1, 5)]) for _ in range(r.choice([0, 1, 5, 40, 150]))] for _ in range(2))
        assert shapes.common_subsequence(a, b) == plain_common(a, b)
    rows = [(k, [r.choice("abcde") for _ in range(r.randrange(0, 90))]) for k in range(6) for _ in range(7)] + [(9, ["x"]), (10, ["a", "b"]), (10, ["c"])]
    got = {x["key"]: (x["skeleton"], x["sequences"]) for x in shapes.skeleton(spark.createDataFrame([*rows, rows[0]], "k long, tokens array<string>"), "k", least=1).collect()}
    want = {}
    for k in {k for k, t in rows if t}:
        some = sorted({tuple(t) for q, t in rows if q == k and t}, key=lambda t: (len(t), t))
        fold = list(some[0])
        for t in some[1:]:
            fold = plain_common(fold, list(t))
        want[str(k)] = (fold, len(some))
    assert got == want


def test_pca_equals_the_axes_of_the_standardised_matrix(spark):
    import numpy as np

    r = np.random.default_rng(3)
    x = np.column_stack([r.normal(size=80) * 5, r.integers(0, 9, 80), np.zeros(80), np.arange(80) ** 1.5])
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "inv long, a double, b double, c double, d double")
    got = np.array([tuple(v)[1:] for v in shapes.pca(df).orderBy("inv").collect()])
    z = (x - x.mean(axis=0)) / np.where(x.std(axis=0) > 0, x.std(axis=0), 1)
    axes = np.linalg.svd(z, full_matrices=False)[2][:2]
    axes *= np.sign(axes[np.arange(2), np.abs(axes).argmax(axis=1)])[:, None]
    assert np.abs(got - z @ axes.T).max() < 1e-8
    assert shapes.pca(df.where("inv < 0")).count() == 0 and shapes.pca(df.where("inv = 1")).first()["pc1"] == 0


def test_sketched_quantiles_and_exact_medians(spark):
    from tracewright.operators import stats

    r = random.Random(2)
    rows = [("big", int(r.expovariate(0.001))) for _ in range(20_000)] + [("one", 5), ("two", 1), ("two", 4), ("none", None)]
    df = spark.createDataFrame(rows, "k string, v long").repartition(5)
    big = sorted(v for k, v in rows if k == "big")
    for p in (0.01, 0.5, 0.9, 0.99):
        got = {x["k"]: (x["q"], x["n"]) for x in stats.quantile_sketch(df, "v", p, "k").collect()}
        at = sum(v <= got["big"][0] for v in big) / len(big)
        assert abs(at - p) < 0.0133 + 1e-3 and got["big"][1] == 20_000 and got["one"] == (5, 1) and "none" not in got
    middle = {x["k"]: x["m"] for x in stats.medians(df, {"m": "v"}, "k").collect()}
    assert middle == {"big": (big[9_999] + big[10_000]) / 2, "one": 5.0, "two": 2.5}


def test_common_block_equals_a_plain_search(spark):
    r = random.Random(14)
    rows = []
    for k in range(25):
        core = [r.choice("ab") for _ in range(r.randrange(0, 23))]
        for _ in range(r.choice([1, 2, 5])):
            rows.append((k, [r.choice("abc") for _ in range(r.randrange(0, 9))] + core + [r.choice("abc") for _ in range(r.randrange(0, 9))]))
    rows += [rows[0], (90, []), (91, ["x"]), (91, ["y"]), (92, ["z"] * 40), (92, ["z"] * 33)]
    want = {}
    for k in {k for k, _ in rows}:
        some = sorted({tuple(t) for q, t in rows if q == k}, key=lambda t: (len(t), t))
        first = some[0]
        for n in range(len(first), 0, -1):
            held = [first[i : i + n] for i in range(len(first) - n + 1) if all(any(t[j : j + n] == first[i : i + n] for j in range(len(t))) for t in some)]
            if held:
                want[str(k)] = (n, ",".join(held[0]))
                break
    got = {x["key"]: (x["length"], x["block"]) for x in shapes.common_block(spark.createDataFrame(rows, "k long, tokens array<string>"), "k").collect()}
    assert got == want


def test_scratch_folders_are_deleted(spark):
    from tracewright.operators.scale import new_path, scratch, work_folder

    e = spark.createDataFrame([("a", "b", "t", 1), ("b", "c", "t", 1)], EDGE)
    with scratch(spark) as folder:
        assert {r["component"] for r in graph.components(e).collect()} == {"a"} and any(Path(folder).iterdir())
        with scratch(spark) as inner:
            assert inner.startswith(folder) and new_path(spark, "x").startswith(inner)
        assert new_path(spark, "x").startswith(folder) and not Path(inner).exists()
    assert not Path(folder).exists() and new_path(spark, "x").startswith(work_folder(spark) + "/x-")
