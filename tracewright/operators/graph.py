"""Graph operators over edge tables (src, dst, ...) and vertex tables (id, type, parent, label)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.operators import tiles, whole
from tracewright.operators.scale import new_path, running_sum, salted_join, scratch, written
from tracewright.shipping import ship_package

#: Nodes of a pointer table that may be broadcast.
BROADCAST_NODES = 1_000_000
#: Pairs in tiles that a batch of betweenness takes for each row of two names that it may write.
TILE_PAIRS = 50
#: A task holds components of `pairs` / WHOLE links whole; smaller ones are put together up to some BIN_NODES nodes.
WHOLE, BIN_NODES = 6, 1_000
#: Nodes times links that a share of the sources takes (1e9 is a few seconds), and tasks at once.
LEAST_WORK, MOST_WORK, MOST_TASKS = 1e7, 4e9, 10_000


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of weakly connected components of (src, dst): the least node, by hooking and contraction.

    Each node hooks to its least neighbour, pointers are doubled until they name local minima, and the links are taken between
    those; every round at least halves the nodes that still have links. Hooking is a grouped minimum (pre-aggregated), and in
    the joins back the rows of a hub are dealt to many tasks. Each round is written to the shared folder; only counts reach
    the driver. Self-links name single nodes; links with a null end are ignored. The first links are not made distinct, which
    would shuffle them all for a minimum that copies do not change.
    """
    pair = [F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")]
    ends = written(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").select(*pair), "links")
    links, maps = ends.where("u <> v"), []
    while many := links.count():
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        roots = both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("v")).select("node", F.least("node", "v").alias("root"))
        roots = doubled(written(roots, "hooks", rows=2 * many))
        nodes = roots.count()
        maps.append((roots, nodes))
        moved = _named(_named(links, roots, "u", nodes), roots, "v", nodes)
        links = written(moved.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links", rows=many)
    loops = ends.where("u = v").select(F.col("u").alias("node"), F.col("u").alias("component")).distinct()
    if not maps:
        return loops
    found = maps[0][0]
    for roots, nodes in maps[1:]:
        found = _named(found, roots, "root", nodes)
    found = written(found.select("node", F.col("root").alias("component")), "components", compact=True)
    return found.unionByName(loops.join(found.select("node"), "node", "left_anti"))


def _named(rows: DataFrame, pointers: DataFrame, column: str, many: int) -> DataFrame:
    """rows with a column's nodes replaced by what pointers (node, root; many rows) name; others stay. Few pointers are broadcast, else hot nodes are dealt out."""
    side = pointers.select(F.col("node").alias(column), F.col("root").alias("__to"))
    out = rows.join(F.broadcast(side), column, "left") if many <= BROADCAST_NODES else salted_join(rows, side, column, how="left")
    return out.select(*[F.coalesce("__to", c).alias(c) if c == column else c for c in rows.columns])


def doubled(pointers: DataFrame) -> DataFrame:
    """Pointers (node, root) without a cycle but for roots that point to themselves, followed until each names the end of its path: four steps of the table at a time, so log rounds."""
    many = pointers.count()
    while True:
        step = pointers
        for _ in range(2):
            step = _named(step, pointers, "root", many)
        step = _named(step.withColumn("before", F.col("root")), pointers, "root", many)
        step = written(step.select("node", "root", (F.col("before") != F.col("root")).alias("moved")), "pointers", rows=many)
        pointers = step.drop("moved")
        if not step.where("moved").limit(1).count():
            return pointers


def grouping_edges(edges: DataFrame, infra: bool = False) -> DataFrame:
    """The edges that put functions into one task: never state links, infra ones only on request. edges: src, dst, edge_class, ..."""
    return edges.where(F.col("edge_class") != "state") if infra else edges.where(~F.col("edge_class").isin("state", "infra"))


def component_stats(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """Nodes, edges, distinct topics and total weight of each component."""
    nodes = parts.groupBy("component").agg(F.count(F.lit(1)).alias("nodes"))
    links = edges.join(parts, edges["src"] == parts["node"]).groupBy("component").agg(F.count(F.lit(1)).alias("edges"), F.count_distinct("topic").alias("topics"), F.sum("n").alias("weight"))
    return nodes.join(links, "component")


def component_classes(edges: DataFrame, parts: DataFrame, external: DataFrame, least: int = 2) -> DataFrame:
    """Components of `least` nodes or more: nodes, real nodes, edges by class, external sources and sinks. external: id of nodes outside the traced system."""
    ext = external.select(F.col("id").alias("node"), F.lit(1).alias("ext"))
    both = edges.join(parts.select(F.col("node").alias("src"), "component"), "src").join(parts.select(F.col("node").alias("dst"), F.col("component").alias("other")), "dst").where("component = other")
    n = lambda c: F.count(F.when(F.col("edge_class") == c, 1))
    links = both.groupBy("component").agg(F.count(F.lit(1)).alias("edges"), n("infra").alias("infra_edges"), n("state").alias("state_edges"))
    ends = both.select("component", F.col("src").alias("node"), F.lit("src").alias("end")).unionByName(both.select("component", F.col("dst").alias("node"), F.lit("dst").alias("end"))).distinct().join(ext, "node")
    outer = ends.groupBy("component").agg(F.count(F.when(F.col("end") == "src", 1)).alias("ext_sources"), F.count(F.when(F.col("end") == "dst", 1)).alias("ext_sinks"))
    nodes = parts.join(ext, "node", "left").groupBy("component").agg(F.count(F.lit(1)).alias("nodes"), (F.count(F.lit(1)) - F.count("ext")).alias("real_nodes")).where(F.col("nodes") >= least)
    out = nodes.join(links, "component", "left").join(outer, "component", "left").na.fill(0)
    return out.withColumn("data_edges", F.col("edges") - F.col("infra_edges") - F.col("state_edges"))


def degree(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """in, out and total degree; with vertices, those without edges count 0."""
    out = edges.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("out_degree"))
    into = edges.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("in_degree"))
    both = out.join(into, "id", "full_outer")
    both = vertices.select("id").join(both, "id", "left") if vertices is not None else both
    both = both.na.fill(0, ["out_degree", "in_degree"])
    return both.withColumn("total", F.col("out_degree") + F.col("in_degree"))


def sources(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).distinct().join(edges.select(F.col("dst").alias("id")).distinct(), "id", "left_anti")


def sinks(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("id")).distinct().join(edges.select(F.col("src").alias("id")).distinct(), "id", "left_anti")


def _few(nodes: DataFrame, many: int) -> DataFrame:
    """nodes to be joined with links: broadcast if they are few, so that the links are not shuffled."""
    return F.broadcast(nodes) if many <= BROADCAST_NODES else nodes


def contracted(links: DataFrame, keep: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Links (src, dst, w) with chains made one link of their length, and the nodes inside chains as (id, head, far).

    Inside are nodes with one link in and one out that are not in keep (id). Their pointers to the node before are doubled until
    they name the chain's head, so rounds grow with the logarithm of a chain. A ring without any other node has no head and
    is left out of both.
    """
    ends = links.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.min("src").alias("head")).where("n = 1")
    inner = ends.join(links.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("m")).where("m = 1"), "id").select("id", "head", F.lit(1).cast("bigint").alias("far"))
    inner = written(inner if keep is None else inner.join(keep.select("id"), "id", "left_anti"), "inner")
    many = inner.count()
    if not many:
        return links.withColumn("w", F.lit(1).cast("bigint")), None
    for _ in range(many.bit_length() + 1):
        up = inner.select(F.col("id").alias("head"), F.col("head").alias("before"), F.col("far").alias("more"))
        step = salted_join(inner, up, "head", how="left", total=many)
        step = written(step.select("id", F.coalesce("before", "head").alias("head"), (F.col("far") + F.coalesce("more", F.lit(0))).alias("far"), F.col("before").isNotNull().alias("moved")), "inner", rows=many)
        inner = step.drop("moved")
        if not step.where("moved").limit(1).count():
            break
    inner = inner.join(inner.select(F.col("id").alias("head")), "head", "left_anti").select("id", "head", "far")  # rings keep moving
    outer = links.join(_few(inner.select(F.col("id").alias("dst")), many), "dst", "left_anti")
    named = outer.join(_few(inner.select(F.col("id").alias("src"), "head", "far"), many), "src", "left")
    return named.select(F.coalesce("head", "src").alias("src"), "dst", (F.coalesce("far", F.lit(0)) + 1).alias("w")), inner


def bfs_depth(edges: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """Steps from the nearest root (default: nodes without incoming edges); -1 if unreachable. Chains are contracted first, which may leave links twice; each round writes the nodes that came nearer."""
    links = written(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct(), "links")
    nodes = links.select(F.col("src").alias("id")).union(links.select("dst")).distinct()
    start = written((roots if roots is not None else sources(links)).select("id").distinct(), "roots")
    short, inner = contracted(links.where("src <> dst"), start)
    short = written(short.select("src", "dst", "w"), "short")
    state = written(start.select("id", F.lit(0).cast("bigint").alias("depth"), F.lit(True).alias("fresh")), "depths")
    while many := state.where("fresh").count():
        step = short.join(_few(state.where("fresh").select(F.col("id").alias("src"), "depth"), many), "src").groupBy(F.col("dst").alias("id")).agg(F.min(F.col("depth") + F.col("w")).alias("near"))
        nearer = F.coalesce(F.col("near") < F.coalesce("depth", "near") + F.col("depth").isNull().cast("int"), F.lit(False))
        state = written(state.select("id", "depth").join(step, "id", "full_outer").select("id", F.least("depth", "near").alias("depth"), nearer.alias("fresh")), "depths")
    found = state.select("id", "depth")
    if inner is not None:
        found = found.unionByName(inner.join(found.select(F.col("id").alias("head"), "depth"), "head").select("id", (F.col("depth") + F.col("far")).alias("depth")))
    return nodes.join(found, "id", "left").select("id", F.coalesce("depth", F.lit(-1)).cast("int").alias("depth"))


def longest_depth(edges: DataFrame, distinct: bool = False) -> DataFrame:
    """Longest path (edges) from a node without incoming edges, found by repeated peeling; nodes on or behind cycles keep what
    their already peeled predecessors give (0 without any).

    Chains are contracted first, which may leave links twice. A round takes away the nodes that wait for none; nodes hold how many links
    they wait for, so a round writes the nodes only, once. distinct: no two edges have the same ends, in a written table.
    """
    links = edges.select("src", "dst").where("src <> dst")
    links = links if distinct else written(links.distinct(), "links")
    nodes = links.select(F.col("src").alias("id")).union(links.select("dst")).distinct()
    short, inner = contracted(links)
    short = written(short.select("src", "dst", "w"), "short")
    ends = short.select(F.col("src").alias("id"), F.lit(0).alias("n")).unionByName(short.select(F.col("dst").alias("id"), F.lit(1).alias("n")))
    state = written(ends.groupBy("id").agg(F.sum("n").alias("waits")).select("id", "waits", F.lit(0).cast("bigint").alias("depth"), (F.col("waits") == 0).alias("fresh")), "peeled")
    while many := state.where("fresh").count():
        step = short.join(_few(state.where("fresh").select(F.col("id").alias("src"), "depth"), many), "src").groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("gone"), F.max(F.col("depth") + F.col("w")).alias("far"))
        left = F.col("waits") - F.coalesce("gone", F.lit(0))
        state = written(state.drop("fresh").join(step, "id", "left").select("id", left.alias("waits"), F.greatest("depth", F.coalesce("far", F.lit(0))).alias("depth"), ((left == 0) & (F.col("waits") > 0)).alias("fresh")), "peeled")
    found = state.select("id", "depth")
    if inner is not None:
        heads = state.where("waits = 0").select(F.col("id").alias("head"), "depth")
        found = found.unionByName(inner.join(heads, "head").select("id", (F.col("depth") + F.col("far")).alias("depth")))
    return nodes.join(found, "id", "left").select("id", F.coalesce("depth", F.lit(0)).cast("int").alias("depth"))


def task_graphs(edges: DataFrame, functions: DataFrame | None = None) -> DataFrame:
    """One row per component: nodes, edges, roots, sinks, longest depth; with functions (id, etype, executor, fires) also timer roots, fires and the sorted executors."""
    edges = written(edges.select("src", "dst").distinct(), "edges")
    parts = written(components(edges), "parts")
    depth = longest_depth(edges, distinct=True)
    flag = lambda df, name: df.select(F.col("id").alias("node"), F.lit(1).alias(name))
    rows = parts.join(depth.withColumnRenamed("id", "node"), "node", "left").join(flag(sources(edges), "root"), "node", "left").join(flag(sinks(edges), "sink"), "node", "left")
    more = []
    if functions is not None:
        rows = rows.join(functions.select(F.col("id").alias("node"), "etype", "executor", "fires"), "node", "left")
        more = [
            F.count(F.when((F.col("root") == 1) & (F.col("etype") == "tmr"), 1)).alias("timer_roots"), F.coalesce(F.sum("fires"), F.lit(0)).alias("fires"),
            F.array_join(F.array_sort(F.collect_set(F.col("executor").cast("string"))), ",").alias("executors"),
        ]
    per = rows.groupBy("component").agg(F.count(F.lit(1)).alias("nodes"), F.count("root").alias("roots"), F.count("sink").alias("sinks"), F.coalesce(F.max("depth"), F.lit(0)).alias("depth"), *more)
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("out"))  # counted by node first: the join is of nodes
    links = out.join(parts, "node").groupBy("component").agg(F.sum("out").alias("edges"))
    return per.join(links, "component")


def betweenness(edges: DataFrame, pairs: int = 20_000_000, tile: int = tiles.TILE) -> DataFrame:
    """Normalised betweenness of directed shortest paths: leaves folded away, then all sources of each component.

    A node whose only link comes in (a leaf sink) is a target of weight 1 more at the node before it; a node whose only link
    goes out (a leaf source) is a source of weight 1 more at the node behind it, on all of whose paths that node lies.

    Components of at most pairs / WHOLE links are held by tasks as a whole, which share the sources; small ones are put together. In larger
    ones no task holds all links: pairs of nodes lie in tiles of `tile` sources by `tile` nodes, which are moved level by level.
    """
    ship_package(edges.sparkSession)
    links = written(edges.select("src", "dst").where("src <> dst").distinct(), "links")
    end = lambda of, out: links.select(F.col(of).alias("name"), F.lit(out).alias("out"), F.lit(1 - out).alias("into"))
    nodes = end("src", 1).union(end("dst", 0)).groupBy("name").agg(F.sum("out").alias("out"), F.sum("into").alias("into"))
    nodes = nodes.select("name", F.expr("out = 0 AND into = 1").alias("sink"), F.expr("into = 0 AND out = 1").alias("source"))
    nodes = written(nodes.withColumn("id", F.monotonically_increasing_id()), "nodes")  # from here on nodes are numbers, since names are longer to shuffle
    n = nodes.count()
    links = links.join(nodes.select(F.col("name").alias("src"), F.col("id").alias("a"), "source"), "src").join(nodes.select(F.col("name").alias("dst"), F.col("id").alias("b"), "sink"), "dst")
    links = written(links.select(F.col("a").alias("src"), F.col("b").alias("dst"), "source", "sink"), "numbered")
    core = written(links.where("NOT source AND NOT sink").select("src", "dst"), "core")
    ends = links.where("sink").groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("ends"))
    starts = links.where("source AND NOT sink").groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("starts"))
    kept = nodes.where("NOT sink").select("id", "source").join(ends, "id", "left").join(starts, "id", "left").na.fill(0).where("NOT source OR ends > 0").drop("source")
    kept = written(kept.join(components(core).select(F.col("node").alias("id"), "component"), "id", "left"), "kept")
    out = core.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("links"))
    sizes = kept.where("component IS NOT NULL").join(out, "id", "left").groupBy("component").agg(F.count(F.lit(1)).alias("nodes"), F.coalesce(F.sum("links"), F.lit(0)).alias("links"))
    sizes = written(sizes.withColumn("large", F.col("links") > pairs // WHOLE), "sizes")
    large = {r["large"] for r in sizes.select("large").distinct().collect()}
    shares = [kept.where("component IS NULL").select("id", (F.col("ends") * F.col("starts")).cast("double").alias("sum"))]
    if False in large:
        shares.append(_whole(kept, core, sizes.where("NOT large")))
    if True in large:
        shares.append(_tiled(kept.join(sizes.where("large").select("component"), "component", "left_semi"), core, pairs, tile))
    scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 1.0
    return nodes.join(reduce(DataFrame.unionByName, shares), "id", "left").select(F.col("name").alias("id"), F.round(F.coalesce("sum", F.lit(0.0)) * scale, 9).alias("betweenness"))


def _whole(kept: DataFrame, core: DataFrame, sizes: DataFrame) -> DataFrame:
    """(id, sum) of the nodes of components that a task can hold; the sources of a component are shared by as many tasks as its work asks for."""
    spark = core.sparkSession
    bins = running_sum(sizes.select("component", "nodes"), [], ["component"], "nodes").select("component", F.floor(F.col("before") / BIN_NODES).alias("bin"))
    place = F.row_number().over(Window.partitionBy("bin").orderBy("id")) - 1
    placed = written(kept.join(bins, "component").select("id", "bin", "ends", "starts", place.cast("bigint").alias("place")), "placed")
    a, b = placed.select(F.col("id").alias("src"), "bin", F.col("place").alias("a")), placed.select(F.col("id").alias("dst"), F.col("place").alias("b"))
    codes = core.join(a, "src").join(b, "dst").groupBy("bin").agg(F.collect_list(F.shiftleft("a", 32) + F.col("b")).alias("links"))
    weights = placed.groupBy("bin").agg(F.array_sort(F.collect_list(F.struct("place", F.col("ends").cast("double").alias("ends"), F.col("starts").cast("double").alias("starts")))).alias("x"))
    rows = written(codes.join(weights, "bin").select("bin", "links", F.col("x.ends").alias("ends"), F.col("x.starts").alias("starts"), (F.size("x").cast("double") * F.size("links")).alias("work")), "wholes")
    work = rows.agg(F.sum("work")).first()[0]
    each = max(LEAST_WORK, min(MOST_WORK, work / (3 * spark.sparkContext.defaultParallelism)))
    number = F.ceil(F.col("work") / each).cast("int").alias("shares")
    first = F.sum("shares").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1))  # one row for each bin of BIN_NODES nodes or more
    dealt = written(rows.select("bin", number).select("bin", "shares", F.coalesce(first, F.lit(0)).alias("first")), "dealt")
    tasks = dealt.agg(F.sum("shares")).first()[0]
    rows = rows.join(dealt, "bin").select("bin", "shares", "first", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), "links", "ends", "starts")
    conf, before = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set(conf, "1")  # a row has all links of a component
    try:
        most = min(tasks, MOST_TASKS)
        sums = written(rows.repartitionById(most, ((F.col("first") + F.col("share")) % most).cast("int")).mapInArrow(whole.shares, whole.SUMS), "shares")
    finally:
        spark.conf.set(conf, before)
    each = sums.select("bin", F.posexplode("sums").alias("place", "x")).groupBy("bin", "place").agg(F.sum("x").alias("sum"))
    return placed.join(each, ["bin", "place"]).select("id", "sum")


def _tiled(kept: DataFrame, core: DataFrame, pairs: int, tile: int) -> DataFrame:
    """(id, sum) of the nodes of components that are too large for a task.

    The nodes are numbered by component and depth and cut into chunks of `tile`, so that tiles (source chunk, node chunk) are few and full.
    Forward: numbers of paths to the nodes at each distance from each source. Backward: what each node passes on to those before
    it. Every level is written and met with the masks of the earlier ones. Sources are taken in batches of about TILE_PAIRS times `pairs`
    pairs of one component at most (a pair in a tile is 8 bytes, where a row of two names took many); what a batch wrote but its sums is deleted.
    """
    core = written(core.join(kept.select(F.col("id").alias("src")), "src", "left_semi"), "core")
    kept = tiles.numbered(kept.join(bfs_depth(core), "id", "left"), ["component", "depth", "id"], tile)
    many = kept.groupBy("component").agg(F.count(F.lit(1)).alias("n")).agg(F.sum(F.col("n") * F.col("n"))).first()[0]
    forward, backward = tiles.link_tiles(core, kept)
    near = [written(x.select("i", "g"), "near") for x in (forward, backward)]
    column = lambda name: F.transform(F.array_sort(F.collect_list(F.struct("place", F.col(name).cast("double").alias("x")))), lambda x: x["x"])
    full = lambda name: F.concat(name, F.array_repeat(F.lit(0.0), F.lit(tiles.TILE) - F.col("n"))).alias(name)
    chunks = kept.groupBy("chunk").agg(F.count(F.lit(1)).cast("int").alias("n"), column("ends").alias("ends"), column("starts").alias("starts")).select("chunk", "n", full("ends"), full("starts"))
    batches = max(1, -(-many // (pairs * TILE_PAIRS)))
    chunks = written(chunks.withColumn("batch", F.pmod(F.xxhash64("chunk"), F.lit(batches)).cast("int")), "chunks")
    sums = [_shares(chunks, b, forward, backward, near) for b in range(batches)]
    each = reduce(DataFrame.unionByName, sums).select(F.col("i").alias("chunk"), F.posexplode("sums").alias("place", "sum"))
    return kept.select("id", "chunk", "place").join(each.groupBy("chunk", "place").agg(F.sum("sum").alias("sum")), ["chunk", "place"]).select("id", "sum")


def _shares(chunks: DataFrame, batch: int, forward: DataFrame, backward: DataFrame, near: list[DataFrame]) -> DataFrame:
    """Sums of the shares (i, sums) of all nodes over the sources of a batch, written."""
    spark = chunks.sparkSession
    path, rows = new_path(spark, "shares"), "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(rows)
    spark.conf.set(rows, "32")  # a tile has half a megabyte
    try:
        with scratch(spark):
            levels = [written(tiles.identity(chunks.where(F.col("batch") == batch)), "level")]
            while levels[-1].select("k").limit(1).count():
                levels.append(written(tiles.reached(levels, forward, near[0]), "level"))
            passed, total = None, []
            for d in reversed(range(len(levels) - 1)):
                passed = written(tiles.passed(levels[d], passed, backward, near[1], chunks, d == 0), "passed")
                total.append(passed.select("i", "sums"))
            total = reduce(DataFrame.unionByName, total) if total else levels[0].select("i", F.array(F.lit(0.0)).alias("sums"))
            total.select("i", F.posexplode("sums").alias("place", "x")).groupBy("i", "place").agg(F.sum("x").alias("x")).groupBy("i").agg(
                F.transform(F.array_sort(F.collect_list(F.struct("place", "x"))), lambda x: x["x"]).alias("sums")).write.parquet(path)
    finally:
        spark.conf.set(rows, before)
    return spark.read.schema("i bigint, sums array<double>").parquet(path)


def rollup_edges(edges: DataFrame, parent: DataFrame, keep_self: bool = False) -> DataFrame:
    """Edges between the parents of their ends: number, sorted topics; pairs inside one parent are dropped unless kept."""
    s = parent.select(F.col("id").alias("src"), F.col("parent").alias("src_parent"))
    t = parent.select(F.col("id").alias("dst"), F.col("parent").alias("dst_parent"))
    both = edges.join(s, "src").join(t, "dst")
    both = both if keep_self else both.where("src_parent <> dst_parent")
    return both.groupBy(F.col("src_parent").alias("src"), F.col("dst_parent").alias("dst")).agg(
        F.count(F.lit(1)).alias("edges"), F.sum("n").alias("n"), F.array_join(F.array_sort(F.collect_set("topic")), ",").alias("topics")
    )


def contains_edges(vertices: DataFrame) -> DataFrame:
    """Parent-child edges of a containment tree with the level they join."""
    up = vertices.select(F.col("id").alias("parent"), F.col("type").alias("parent_type"))
    return vertices.where("parent IS NOT NULL").join(up, "parent").select(F.col("parent").alias("src"), F.col("id").alias("dst"), F.concat_ws("_", "parent_type", "type").alias("level"))


def containment(vertices: DataFrame, leaf: str, chain: list[str]) -> DataFrame:
    """Leaves with the id of their ancestor of each type in chain (nearest first)."""
    out = vertices.where(F.col("type") == leaf).select(F.col("id").alias("leaf"), F.col("parent").alias("at"))
    for kind in chain:
        up = vertices.where(F.col("type") == kind).select(F.col("id").alias("at"), F.col("parent").alias("next"), F.col("label").alias(f"{kind.lower()}_label"))
        out = out.join(up, "at", "left").withColumnRenamed("at", kind.lower()).withColumnRenamed("next", "at")
    return out.drop("at")


def subtree_sizes(vertices: DataFrame, root: str, middle: str, leaf: str) -> DataFrame:
    """Children and grandchildren of each vertex of type root, and the widest child."""
    mid = vertices.where(F.col("type") == middle).select(F.col("id").alias("m"), F.col("parent").alias("root"))
    leaves = vertices.where(F.col("type") == leaf).groupBy(F.col("parent").alias("m")).agg(F.count(F.lit(1)).alias("c"))
    per = mid.join(leaves, "m", "left").na.fill(0, ["c"]).groupBy("root").agg(F.count(F.lit(1)).alias("children"), F.sum("c").alias("grandchildren"), F.max("c").alias("widest"))
    return vertices.where(F.col("type") == root).select(F.col("id").alias("root")).join(per, "root", "left").na.fill(0)


def node_summary(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Per node (type N): entities, functions, sorted topics it sends and receives, and entities without a function."""
    e = vertices.where("type = 'E'").select(F.col("id").alias("entity"), F.col("parent").alias("node"))
    f = vertices.where("type = 'F'").groupBy(F.col("parent").alias("entity")).agg(F.count(F.lit(1)).alias("functions"))
    per = e.join(f, "entity", "left").groupBy("node").agg(F.count(F.lit(1)).alias("entities"), F.coalesce(F.sum("functions"), F.lit(0)).alias("functions"), F.count(F.when(F.col("functions").isNull(), 1)).alias("unbound"))
    ends = edges.select(F.col("src").alias("entity"), "topic").unionByName(edges.select(F.col("dst").alias("entity"), "topic")).join(e, "entity")
    topics = ends.groupBy("node").agg(F.array_join(F.array_sort(F.collect_set("topic")), ",").alias("topics"))
    return vertices.where("type = 'N'").select(F.col("id").alias("node")).join(per, "node", "left").join(topics, "node", "left").na.fill(0).na.fill("", ["topics"])


def graph_summary(vertices: DataFrame) -> DataFrame:
    """Vertices by type, with the total."""
    return vertices.rollup("type").agg(F.count(F.lit(1)).alias("vertices"), F.count("parent").alias("contained")).withColumn("type", F.coalesce("type", F.lit("all")))


def edge_summary(edges: DataFrame) -> DataFrame:
    """Edges by relation and level, with the totals of each relation and of all ('all'). edges: rel, level."""
    every = F.lit("all")
    return edges.rollup("rel", "level").agg(F.count(F.lit(1)).alias("n"), F.grouping("level").alias("g")).select(F.coalesce("rel", every).alias("rel"), F.when(F.col("g") == 1, every).otherwise(F.col("level")).alias("level"), "n")


def missing_callbacks(entities: DataFrame, gpu_nodes: DataFrame) -> DataFrame:
    """(cause, n): all entities, those with a callback, and those without by cause: on a node of an accelerator process (gpu), part of an action, or other,
    which is neither. An entity may be counted under gpu and action. entities: id, node, cb, action; gpu_nodes: node."""
    rows = entities.join(gpu_nodes.select("node").distinct().withColumn("gpu", F.lit(True)), "node", "left")
    gpu, action, free = F.coalesce("gpu", F.lit(False)), F.col("action").isNotNull(), F.col("cb").isNull()
    counts = {"all": F.lit(True), "bound": ~free, "gpu": free & gpu, "action": free & action, "other": free & ~gpu & ~action}
    one = rows.agg(*[F.count(F.when(c, 1)).alias(n) for n, c in counts.items()])
    return one.select(F.explode(F.array(*[F.struct(F.lit(n).alias("cause"), F.col(n).alias("n")) for n in counts])).alias("x")).select("x.*")


def dataflow_role(edges: DataFrame, vertices: DataFrame | None = None) -> DataFrame:
    """source, sink, relay or isolated, with the sorted topics that go out and come in."""
    names = lambda end, name: edges.select(F.col(end).alias("id"), "topic").distinct().groupBy("id").agg(F.array_join(F.array_sort(F.collect_list("topic")), ",").alias(name))
    out, into = names("src", "out_topics"), names("dst", "in_topics")
    both = out.join(into, "id", "full_outer")
    both = vertices.select("id").join(both, "id", "left") if vertices is not None else both
    both = both.na.fill("", ["out_topics", "in_topics"])
    o, i = F.col("out_topics") != "", F.col("in_topics") != ""
    return both.withColumn("role", F.when(o & i, "relay").when(o, "source").when(i, "sink").otherwise("isolated"))


def staircase_order(edges: DataFrame, roles: DataFrame | None = None) -> DataFrame:
    """Rows in display order: depth (-1 last), then role (id, role; sources, relays, sinks, isolated), degree descending, id; rn counts over the whole table.

    The numbers are a running sum over a range partitioned sort.
    """
    rows = bfs_depth(edges).join(degree(edges), "id")
    rows = rows.join(roles.select("id", "role"), "id", "left") if roles is not None else rows.withColumn("role", F.lit(None).cast("string"))
    place = F.coalesce(F.array_position(F.array(*[F.lit(r) for r in ("source", "relay", "sink", "isolated")]), F.col("role")), F.lit(0))
    keyed = rows.select("id", "depth", "total", F.lit(1).alias("one"), F.when(F.col("depth") < 0, 999).otherwise(F.col("depth")).alias("k1"), place.alias("k2"), (-F.col("total")).alias("k3"))
    return running_sum(keyed.drop("total").withColumn("degree", -F.col("k3")), [], ["k1", "k2", "k3", "id"], "one").select("id", "depth", F.col("degree").alias("total"), (F.col("before") + 1).cast("int").alias("rn"))


def subtree(vertices: DataFrame, root: str, depth: int) -> DataFrame:
    """Descendants of a vertex with their distance, down to depth."""
    front = vertices.where(F.col("id") == root).select("id", F.lit(0).alias("depth"))
    out = front
    for k in range(1, depth + 1):
        front = vertices.join(front.select(F.col("id").alias("parent")), "parent", "left_semi").select("id", F.lit(k).alias("depth"))
        out = out.unionByName(front)
    return out


def comm_subgraph(edges: DataFrame, vertices: DataFrame, kind: str) -> DataFrame:
    """Edges whose two ends are vertices of one type."""
    ids = vertices.where(F.col("type") == kind).select("id")
    return edges.join(ids, edges["src"] == ids["id"], "left_semi").join(ids.withColumnRenamed("id", "i"), F.col("dst") == F.col("i"), "left_semi")


def collapse(edges: DataFrame) -> DataFrame:
    """One edge per (src, dst): the last topic by name wins, weights add up."""
    return edges.groupBy("src", "dst").agg(F.max("topic").alias("topic"), F.sum("n").alias("n"))


def mutate(current: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """current after changes (op 'set' or 'remove', nullable columns): set merges non-null values or adds the row, remove deletes it."""
    gone = changes.where("op = 'remove'").select(key)
    new = changes.where("op = 'set'").drop("op")
    cols = [c for c in current.columns if c != key]
    both = current.alias("a").join(new.alias("b"), key, "full_outer").select(key, *[F.coalesce(f"b.{c}", f"a.{c}").alias(c) for c in cols])
    return both.join(gone, key, "left_anti")


def remove_dangling(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Edges both of whose ends still exist (the cascade after removing vertices)."""
    ids = vertices.select(F.col("id").alias("k"))
    return edges.join(ids, F.col("src") == F.col("k"), "left_semi").join(ids, F.col("dst") == F.col("k"), "left_semi")


def mutation_log(current: DataFrame, changes: DataFrame, actor: str, key: str = "id") -> DataFrame:
    """(id, op, actor, note, diff) of changes (op, id, note, columns): diff holds `column: old -> new` of what a set changes; the log outlives the graph."""
    cols = [c for c in current.columns if c != key]
    both = changes.alias("b").join(current.alias("a"), key, "left")
    parts = [F.when(F.col(f"b.{c}").isNotNull() & ~F.col(f"b.{c}").eqNullSafe(F.col(f"a.{c}")), F.concat(F.lit(f"{c}: "), F.coalesce(F.col(f"a.{c}").cast("string"), F.lit("")), F.lit(" -> "), F.col(f"b.{c}").cast("string"))) for c in cols]
    return both.select(key, "op", F.lit(actor).alias("actor"), "note", F.when(F.col("op") == "set", F.concat_ws("; ", *parts)).otherwise("").alias("diff"))


def remap(edges: DataFrame, role: str) -> DataFrame:
    """Ids prefixed by a role, so graphs of several roles can be united."""
    return edges.withColumns({c: F.concat(F.lit(f"{role}/"), c) for c in ("src", "dst")})


def compose(graphs: dict[str, tuple[DataFrame, DataFrame]], boundary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One graph of several roles: ids prefixed by their role, a container vertex for each role, external vertices that a boundary link replaces
    gone with their edges, the links themselves added, and the number of links between containers.

    graphs: role -> (vertices with id, type, parent, label; edges with src, dst, topic). boundary: src_role, src, dst_role, dst, topic, as from match_boundaries.
    """
    vertices = reduce(DataFrame.unionByName, [
        v.select(F.concat(F.lit(f"{r}/"), "id").alias("id"), "type", F.coalesce(F.concat(F.lit(f"{r}/"), "parent"), F.lit(f"CN:{r}")).alias("parent"), "label")
        .unionByName(v.sparkSession.range(1).select(F.lit(f"CN:{r}").alias("id"), F.lit("CN").alias("type"), F.lit(None).cast("string").alias("parent"), F.lit(r).alias("label")))
        for r, (v, _) in graphs.items()
    ])
    edges = reduce(DataFrame.unionByName, [remap(e.select("src", "dst", "topic"), r).withColumn("rel", F.lit("comm")) for r, (_, e) in graphs.items()])
    gone = boundary.select(F.concat("src_role", F.lit("/ext:sink:"), "topic").alias("id")).unionByName(boundary.select(F.concat("dst_role", F.lit("/ext:src:"), "topic").alias("id"))).distinct()
    gone = written(gone, "replaced", compact=True)  # of known size from here, so a small one meets vertices and edges without moving them
    kept = vertices.join(gone, "id", "left_anti")
    edges = edges.join(gone.withColumnRenamed("id", "src"), "src", "left_anti").join(gone.withColumnRenamed("id", "dst"), "dst", "left_anti")
    links = boundary.select(F.concat_ws("/", "src_role", "src").alias("src"), F.concat_ws("/", "dst_role", "dst").alias("dst"), "topic", F.lit("comm").alias("rel"))
    rolled = boundary.groupBy(F.concat(F.lit("CN:"), "src_role").alias("src"), F.concat(F.lit("CN:"), "dst_role").alias("dst")).agg(F.count(F.lit(1)).cast("string").alias("topic")).withColumn("rel", F.lit("containers"))
    return kept, edges.unionByName(links).unionByName(rolled.select("src", "dst", "topic", "rel"))


def namespace_neighbours(edges: DataFrame, space: DataFrame, name: str) -> DataFrame:
    """Nodes of a namespace and their one-step neighbours, the latter flagged foreign."""
    inside = space.where(F.col("namespace") == name).select("id")
    a = edges.join(inside.withColumnRenamed("id", "src"), "src", "left_semi").select(F.col("dst").alias("id"))
    b = edges.join(inside.withColumnRenamed("id", "dst"), "dst", "left_semi").select(F.col("src").alias("id"))
    near = a.union(b).distinct().join(inside, "id", "left_anti")
    return inside.withColumn("foreign", F.lit(False)).unionByName(near.withColumn("foreign", F.lit(True)))


def component_graph(edges: DataFrame, space: DataFrame, sampled: DataFrame | None = None) -> DataFrame:
    """Links between namespaces by kind, with their number and the median weight (element n // 2 of the sorted edge weights).

    kind: sampled where the target is a deposit subscription, else trigger; pairs inside one namespace are dropped.
    """
    s = space.select(F.col("id").alias("src"), F.col("namespace").alias("a"))
    t = space.select(F.col("id").alias("dst"), F.col("namespace").alias("b"))
    both = edges.join(s, "src").join(t, "dst").where("a <> b")
    if sampled is not None:
        both = both.join(sampled.select(F.col("id").alias("dst"), F.lit(True).alias("deposit")), "dst", "left")
    kind = F.when(F.col("deposit"), "sampled").otherwise("trigger") if sampled is not None else F.lit("trigger")
    counts = both.withColumn("kind", kind).groupBy("a", "b", "kind", "n").agg(F.count(F.lit(1)).alias("c"))
    at = F.expr("total div 2")
    middle = running_sum(counts, ["a", "b", "kind"], ["n"], "c").where((F.col("before") <= at) & (at < F.col("before") + F.col("c")))
    return middle.select(F.col("a").alias("src"), F.col("b").alias("dst"), "kind", F.col("total").alias("links"), F.col("n").alias("median_n"))


#: Flow measures of edges that component_links takes the median of.
FLOWS = ["hop_p50", "hop_p90", "age_p50", "age_p90"]


def component_links(edges: DataFrame, functions: DataFrame) -> DataFrame:
    """Links between components by kind: edges, topics, flows, and the median (element n // 2) of each flow measure over the edges that have it.

    edges: src, dst, topic, nature, edge_class, flow_n and FLOWS (nullable). functions: id, component (null for external ones,
    which count as ext:in and ext:out). kind is infra or state by class, join by nature, else data; a data edge into a function that other
    functions of its node read by state links is sampled, and its age is the median age of those links. Edges inside a component are left out.
    """
    of = lambda end, name: functions.select(F.col("id").alias(end), F.col("component").alias(name), F.lit(True).alias(f"{name}_known"))
    both = edges.join(of("src", "a"), "src").join(of("dst", "b"), "dst").where("a IS NOT NULL OR b IS NOT NULL")
    both = both.withColumn("a", F.coalesce("a", F.lit("ext:in"))).withColumn("b", F.coalesce("b", F.lit("ext:out"))).where("a <> b")
    state = edges.where("nature = 'state'")
    held = _middle(state.where("age_p50 IS NOT NULL"), ["src"], "age_p50").select(F.col("src").alias("dst"), F.col("age_p50").alias("held_age"))
    read = state.select(F.col("src").alias("dst")).distinct().withColumn("read", F.lit(True))
    kind = F.when(F.col("edge_class").isin("infra", "state"), F.col("edge_class")).when(F.col("nature") == "join", "join").when(F.col("read"), "sampled").otherwise("data")
    both = both.join(read, "dst", "left").join(held, "dst", "left").withColumn("kind", kind)
    sampled = F.col("kind") == "sampled"
    both = both.withColumns({"age_p50": F.when(sampled, F.col("held_age")).otherwise(F.col("age_p50")), "age_p90": F.when(sampled, F.col("held_age")).otherwise(F.col("age_p90")), "flow_n": F.when(sampled, F.coalesce("flow_n", F.lit(1))).otherwise(F.col("flow_n"))})
    both = written(both.select("a", "b", "kind", "topic", "flow_n", *FLOWS), "links")
    sums = both.groupBy("a", "b", "kind").agg(F.count(F.lit(1)).alias("edges"), F.count_distinct("topic").alias("topics"), F.coalesce(F.sum("flow_n"), F.lit(0)).alias("flows"))
    long = both.select("a", "b", "kind", F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.col(m).cast("bigint").alias("v")) for m in FLOWS])).alias("x")).select("a", "b", "kind", "x.m", "x.v").where("v IS NOT NULL")
    wide = _middle(long, ["a", "b", "kind", "m"], "v").groupBy("a", "b", "kind").agg(*[F.max(F.when(F.col("m") == m, F.col("v"))).alias(m) for m in FLOWS])
    return sums.join(wide, ["a", "b", "kind"], "left").withColumnsRenamed({"a": "src", "b": "dst"})


def _middle(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Element n // 2 of each group's sorted values."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("c"))
    at = F.expr("total div 2")
    return running_sum(counts, keys, [value], "c").where((F.col("before") <= at) & (at < F.col("before") + F.col("c"))).select(*keys, value)


#: Components that touch everything and say nothing about the flow of data.
CROSSCUT = ["/system", "/adapi", "/default_adapi", "/viz", "/", "/pointcloud_container"]


def hide_crosscut(components_: DataFrame, links: DataFrame, infra: bool = False, names: list[str] = CROSSCUT) -> tuple[DataFrame, DataFrame]:
    """Components (name) and links (src, dst, kind) without the cross-cutting ones; infra links only on request."""
    left = links.where(~F.col("src").isin(names) & ~F.col("dst").isin(names))
    return components_.where(~F.col("name").isin(names)), left if infra else left.where("kind <> 'infra'")


def session_list(vertices: DataFrame, sessions: DataFrame, least: int = 5) -> DataFrame:
    """Vertices per session and scope (at least `least`), with session times, newest first, unknown times last."""
    n = vertices.groupBy("session_id", "scope").agg(F.count(F.lit(1)).alias("vertices")).where(F.col("vertices") >= least)
    return n.join(sessions, "session_id", "left").orderBy(F.col("started").desc_nulls_last(), "session_id", "scope")
