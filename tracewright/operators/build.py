"""The multi-level graph of a trace: vertices from its events, communication edges from what its entities send and receive.

Vertex ids are made of their natural key (session, process, handle or address), so no counter is needed and graphs of several sessions can be united.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.functions.scalars import entity_label, node_full_name, topic_class
from tracewright.operators.model import (
    _one, detect_actions, detect_joins, detect_polled, detect_state_links, external_graph, first_per_key, group_links, last_per_key, mark_phases, match_services, match_topics, measure_flows,
    pick_candidate, propagate_functions, resolve_chain, split_callbacks,
)
from tracewright.operators.scale import written
from tracewright.operators.stats import flow_stats

KEY = ["session_id", "vpid"]
VERTEX = ["session_id", "id", "type", "level", "parent", "label", "etype", "cb"]
EDGE = ["src", "dst", "level", "nature", "topic", "direction", "intra_node", "n"]


def _id(kind: str, *parts: str):
    return F.concat_ws(":", F.lit(kind), *[F.col(p).cast("string") for p in parts])


def node_table(events: DataFrame, kills: DataFrame | None = None) -> DataFrame:
    """Nodes (session_id, vpid, node_handle, name, full_name, procname) of processes that the kill log does not name."""
    inits = events.where("event = 'node_init'")
    if kills is not None:
        inits = inits.join(kills.where("killed_pid IS NOT NULL").select(F.col("killed_pid").alias("vpid")).distinct(), "vpid", "left_anti")
    at = lambda k: F.col("payload")[k]
    rows = inits.select(*KEY, "ts_ns", "id", "procname", at("node_handle").alias("node_handle"), at("node_name").alias("name"), node_full_name(F.coalesce(at("namespace"), F.lit("/")), at("node_name")).alias("full_name"))
    return first_per_key(rows, *KEY, "node_handle")


def entity_table(events: DataFrame) -> DataFrame:
    """Entities (session_id, vpid, node_handle, handle, etype, name): subscriptions, services, timers and waitables with the node that made them."""
    kinds = []
    for etype, event, handle, name in (("sub", "subscription_init", "subscription_handle", "topic_name"), ("serv", "service_init", "service_handle", "service_name"), ("waitable", "waitable_init", "waitable_handle", "waitable_handle")):
        rows = last_per_key(_one(events, event, handle=handle, name=name, node_handle="node_handle"), *KEY, "handle")
        kinds.append(rows.select(*KEY, "node_handle", "handle", F.lit(etype).alias("etype"), entity_label(F.lit(etype), F.col("name")).alias("name")))
    timers = last_per_key(_one(events, "timer_init", handle="timer_handle", period="period_ns", old="period"), *KEY, "handle").select(*KEY, "handle", F.coalesce("period", "old").alias("period"))
    owner = last_per_key(_one(events, "timer_link_node", handle="timer_handle", node_handle="node_handle"), *KEY, "handle").select(*KEY, "handle", "node_handle")
    kinds.append(timers.join(owner, [*KEY, "handle"]).select(*KEY, "node_handle", "handle", F.lit("tmr").alias("etype"), entity_label(F.lit("tmr"), F.col("period")).alias("name")))
    return reduce(DataFrame.unionByName, kinds)


def function_table(events: DataFrame) -> DataFrame:
    """Functions (session_id, vpid, handle, cb, symbol, reason, fires): the callback that each subscription, service, timer and waitable runs."""
    marks = events.where("event = 'callback_start'").select(*KEY, F.col("payload")["callback"].alias("cb"))
    intra = events.where("event = 'intra_bind'").select(*KEY, F.col("payload")["callback"].alias("cb"))
    chosen = pick_candidate(resolve_chain(events), marks, intra).select(*KEY, "handle", "cb", "symbol", "reason", "fires")
    waits = last_per_key(_one(events, "waitable_init", handle="waitable_handle"), *KEY, "handle").select(*KEY, "handle", F.col("handle").alias("cb"), F.lit(None).cast("string").alias("symbol"), F.lit("single").alias("reason"))
    return chosen.unionByName(waits.join(marks.distinct().withColumn("fires", F.lit(True)), [*KEY, "cb"], "left").na.fill(False, ["fires"]).select(*chosen.columns))


def build_vertices(events: DataFrame, kills: DataFrame | None = None) -> DataFrame:
    """session_id, id, type, level, parent, label, etype, cb: containers (CN, level -1), processes (EX, 0), nodes (N, 1), entities (E, 2) and functions (F, 3).

    events: session_id, vpid, ts_ns, id, event, procname, payload. A process is a vpid with a node_init; its label is that of its first node's process
    name. Entities of unknown nodes and functions of unknown entities are left out.
    """
    nodes = node_table(events, kills)
    entities = entity_table(events).join(nodes.select(*KEY, "node_handle"), [*KEY, "node_handle"], "left_semi")
    functions = function_table(events).join(entities.select(*KEY, "handle"), [*KEY, "handle"], "left_semi")
    none = F.lit(None).cast("string")
    row = lambda df, kind, level, id_, parent, label, etype=none, cb=none: df.select("session_id", id_.alias("id"), F.lit(kind).alias("type"), F.lit(level).alias("level"), parent.alias("parent"), label.alias("label"), etype.alias("etype"), cb.alias("cb"))
    processes = nodes.groupBy(*KEY).agg(F.min_by("procname", F.struct("ts_ns", "id")).alias("procname"))
    ex, n, e = _id("EX", *KEY), _id("N", *KEY, "node_handle"), _id("E", *KEY, "handle")
    return reduce(DataFrame.unionByName, [
        row(nodes.select("session_id").distinct(), "CN", -1, _id("CN", "session_id"), none, F.col("session_id")),
        row(processes, "EX", 0, ex, _id("CN", "session_id"), F.concat(F.col("procname"), F.lit(" (PID:"), F.col("vpid").cast("string"), F.lit(")"))),
        row(nodes, "N", 1, n, ex, F.col("full_name")),
        row(entities, "E", 2, e, n, F.col("name"), F.col("etype")),
        row(functions, "F", 3, _id("F", *KEY, "handle"), e, F.coalesce("symbol", "cb"), none, F.col("cb")),
    ])


def sent_topics(events: DataFrame, functions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(session_id, entity, topic) that entities publish, and (session_id, entity, service) that they call: link events name a callback, which names its entity."""
    owner = functions.select(*KEY, "cb", _id("E", *KEY, "handle").alias("entity")).groupBy(*KEY, "cb").agg(F.min("entity").alias("entity"))
    out = []
    for link, init, handle, name in (("publish_link", "publisher_init", "publisher_handle", "topic_name"), ("client_link", "client_init", "client_handle", "service_name")):
        named = last_per_key(_one(events, init, handle=handle, name=name), *KEY, "handle").select(*KEY, "handle", "name")
        links = events.where(F.col("event") == link).select(*KEY, F.col("payload")["callback"].alias("cb"), F.col("payload")[handle].alias("handle")).distinct()
        out.append(links.join(named, [*KEY, "handle"]).join(owner, [*KEY, "cb"]).select("session_id", "entity", F.col("name").alias("topic" if link == "publish_link" else "service")).distinct())
    return out[0], out[1]


def comm_edges(
    pub: DataFrame, sub: DataFrame, clients: DataFrame, servers: DataFrame, functions: DataFrame, nodes: DataFrame, joins: DataFrame | None = None, state: DataFrame | None = None,
    ingress: DataFrame | None = None, egress: DataFrame | None = None, store: bool = False,
) -> DataFrame:
    """Communication edges on all levels: src, dst, level, nature, topic, direction, intra_node, n.

    pub, sub: node, entity, topic; clients, servers: node, entity, service; functions: entity, function, part (main, continuation); nodes: entity, node, executor.
    L2 joins entities by topic (msg), service (dep, both ways) and shared group (gxf_internal: ingress, egress with node, group, entity). L3 repeats them between
    functions: main to main, a response to the continuation. joins (node, entity, role, join_group) ties each member of a join to its first completer; state (src, dst,
    topic, takes) adds sample-and-hold reads, observed ones with their number of takes. L1 counts the L2 edges between different nodes, L0 sums L1 between different executors.
    store writes the L2 edges once for all levels; it is meant for topics with few pairs, as all pairs of busy topics may not fit the shared folder.
    """
    none = F.lit(None).cast("string")
    shape = lambda df, nature, topic="topic", direction=none: df.select("src", "dst", F.lit(nature).alias("nature"), F.col(topic).alias("topic"), direction.alias("direction"))
    l2 = shape(match_topics(pub, sub), "msg").unionByName(shape(match_services(clients, servers), "dep", "service", F.col("part")))
    if ingress is not None and egress is not None:
        l2 = l2.unionByName(shape(group_links(ingress, egress), "gxf_internal", "group"))
    at = nodes.select("entity", "node", "executor").distinct()
    ends = l2.join(at.select(F.col("entity").alias("src"), F.col("node").alias("src_node"), F.col("executor").alias("src_ex")), "src").join(at.select(F.col("entity").alias("dst"), F.col("node").alias("dst_node"), F.col("executor").alias("dst_ex")), "dst")
    ends = written(ends, "ends") if store else ends
    intra = ends.withColumn("intra_node", F.col("src_node") == F.col("dst_node"))
    rows = lambda df, level, n=F.lit(1): df.withColumn("level", F.lit(level)).withColumn("n", n.cast("bigint")).select(*EDGE)
    out = [rows(intra, "L2")]
    l3 = propagate_functions(intra.withColumnRenamed("direction", "part"), functions, ["nature", "intra_node"]).withColumnRenamed("part", "direction")
    out.append(rows(l3.where("src IS NOT NULL AND dst IS NOT NULL"), "L3"))
    out += [rows(x, "L3", F.col("n")) for x in _tied(functions, joins, state)]
    if store:
        apart = ends.where("src_node <> dst_node").groupBy("src_node", "dst_node", "src_ex", "dst_ex").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_set("topic")), ",").alias("topic"))
    else:
        apart = _apart(*_sides(pub, sub, clients, servers, functions, nodes, ingress, egress))
    level = lambda df, a, b, topic, name: df.select(F.col(a).alias("src"), F.col(b).alias("dst"), F.lit(name).alias("level"), none.alias("nature"), topic.alias("topic"), none.alias("direction"), F.lit(False).alias("intra_node"), F.col("n").cast("bigint").alias("n"))
    apart = written(apart, "apart") if store else apart
    out.append(level(apart, "src_node", "dst_node", F.col("topic"), "L1"))
    out.append(level(apart.where("src_ex <> dst_ex").groupBy("src_ex", "dst_ex").agg(F.sum("n").alias("n")), "src_ex", "dst_ex", none, "L0"))
    return reduce(DataFrame.unionByName, out)


def _tied(functions: DataFrame, joins: DataFrame | None, state: DataFrame | None) -> list[DataFrame]:
    """Edges between functions that joins and state links make: src, dst, nature, topic, direction, intra_node, n."""
    none, out = F.lit(None).cast("string"), []
    main = functions.where("part = 'main'").groupBy("entity").agg(F.min("function").alias("function"))
    if joins is not None:
        f = joins.join(main, "entity").select("node", "join_group", "role", "function")
        first = f.groupBy("node", "join_group").agg(F.min(F.struct((F.col("role") != "completer").cast("int"), "function")).alias("a")).select("node", "join_group", F.col("a.function").alias("dst"))
        ties = f.join(first, ["node", "join_group"]).where("function <> dst").select(F.col("function").alias("src"), "dst", F.lit("join").alias("nature"), F.col("join_group").alias("topic"), none.alias("direction"), F.lit(True).alias("intra_node")).distinct()
        out.append(ties.withColumn("n", F.lit(1)))
    if state is not None:
        held = state.join(main.withColumnsRenamed({"entity": "src", "function": "f"}), "src").join(main.withColumnsRenamed({"entity": "dst", "function": "g"}), "dst")
        held = held.select(F.col("f").alias("src"), F.col("g").alias("dst"), F.lit("state").alias("nature"), "topic", F.when(F.col("takes") > 0, "polled").otherwise("inferred").alias("direction"), F.lit(True).alias("intra_node"), F.coalesce("takes", F.lit(0)).alias("n"))
        out.append(held)
    return out


#: What the two ends of an edge share; space is the node of a scheduler's group.
MEET = ["nature", "part", "topic", "space"]


def _sides(
    pub: DataFrame, sub: DataFrame, clients: DataFrame, servers: DataFrame, functions: DataFrame, nodes: DataFrame, ingress: DataFrame | None = None, egress: DataFrame | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The sending and the receiving ends of the L2 edges counted by MEET, node and executor, and the pairs of an entity with itself that are none.

    Each end has n, its number, and f, how many of these have the function that an L3 edge goes from or to. All ends that meet make edges, so edges can be counted without making them.
    """
    row = lambda df, nature, part, topic="topic", space=F.lit(""): df.select("entity", F.lit(nature).alias("nature"), F.lit(part).alias("part"), F.col(topic).alias("topic"), space.alias("space"))
    own = lambda df, *c: df.select(*c).distinct()
    ask, serve = own(clients, "entity", "service"), own(servers, "entity", "service")
    src = [row(own(pub, "node", "entity", "topic"), "msg", ""), row(ask, "dep", "request", "service"), row(serve, "dep", "response", "service")]
    dst = [row(own(sub, "node", "entity", "topic"), "msg", ""), row(serve, "dep", "request", "service"), row(ask, "dep", "response", "service")]
    if ingress is not None and egress is not None:
        src.append(row(own(ingress, "node", "group", "entity"), "gxf_internal", "", "group", F.col("node")))
        dst.append(row(own(egress, "node", "group", "entity"), "gxf_internal", "", "group", F.col("node")))
    at = nodes.select("entity", "node", "executor").distinct()
    f = functions.groupBy("entity").agg(F.min(F.when(F.col("part") == "main", F.col("function"))).alias("main"), F.min(F.when(F.col("part") == "continuation", F.col("function"))).alias("cont"))
    to = F.when(F.col("part") == "response", F.coalesce("cont", "main")).otherwise(F.col("main"))
    placed = lambda rows, fn: reduce(DataFrame.unionByName, rows).join(at, "entity").join(f, "entity", "left").select(*MEET, "entity", "node", "executor", fn.isNotNull().cast("bigint").alias("f"))
    src, dst = placed(src, F.col("main")), placed(dst, to)
    end = lambda df, name: df.select(*MEET, F.col("node").alias(f"{name}_node"), F.col("executor").alias(f"{name}_ex"), F.col("f").alias(f"{name}_f"), *[c for c in ("entity", f"{name}_n") if c in df.columns])
    self = end(src.where("nature = 'gxf_internal'"), "src").join(end(dst.where("nature = 'gxf_internal'"), "dst"), [*MEET, "entity"])
    counted = lambda df, name: end(df.groupBy(*MEET, "node", "executor").agg(F.count(F.lit(1)).alias(f"{name}_n"), F.sum("f").alias("f")), name)
    return counted(src, "src"), counted(dst, "dst"), self


def _apart(src: DataFrame, dst: DataFrame, self: DataFrame) -> DataFrame:
    """src_node, dst_node, src_ex, dst_ex with the number n of L2 edges between different nodes and their sorted topics; from _sides()."""
    by = ["src_node", "dst_node", "src_ex", "dst_ex", "nature", "topic"]
    both = src.join(dst, MEET).where("src_node <> dst_node").select(*by, (F.col("src_n") * F.col("dst_n")).alias("n")).unionByName(self.where("src_node <> dst_node").select(*by, F.lit(-1).cast("bigint").alias("n")))
    some = both.groupBy(*by).agg(F.sum("n").alias("n")).where("n > 0")
    return some.groupBy(*by[:4]).agg(F.sum("n").alias("n"), F.array_join(F.array_sort(F.collect_set("topic")), ",").alias("topic"))


def comm_totals(
    pub: DataFrame, sub: DataFrame, clients: DataFrame, servers: DataFrame, functions: DataFrame, nodes: DataFrame, joins: DataFrame | None = None, state: DataFrame | None = None,
    ingress: DataFrame | None = None, egress: DataFrame | None = None,
) -> DataFrame:
    """The edges of comm_edges() counted without making them: level, nature, direction, rows, n (sum of their n). L2 and L3 edges are products of the numbers of their ends."""
    src, dst, self = _sides(pub, sub, clients, servers, functions, nodes, ingress, egress)
    total = lambda df, name: df.groupBy(*MEET).agg(F.sum(f"{name}_n").alias(f"{name}_n"), F.sum(f"{name}_f").alias(f"{name}_f"))
    pairs = total(src, "src").join(total(dst, "dst"), MEET).select("nature", "part", (F.col("src_n") * F.col("dst_n")).alias("L2"), (F.col("src_f") * F.col("dst_f")).alias("L3"))
    pairs = pairs.unionByName(self.select("nature", "part", F.lit(-1).cast("bigint").alias("L2"), (-F.col("src_f") * F.col("dst_f")).alias("L3")))
    sums = pairs.groupBy("nature", "part").agg(F.sum("L2").alias("L2"), F.sum("L3").alias("L3"))
    row = lambda df, level, rows, n, nature=F.col("nature"), direction=F.col("direction"): df.select(F.lit(level).alias("level"), nature.alias("nature"), direction.alias("direction"), rows.cast("bigint").alias("rows"), n.cast("bigint").alias("n"))
    none, one = F.lit(None).cast("string"), F.count(F.lit(1)).alias("rows")
    named = sums.withColumn("direction", F.when(F.col("part") != "", F.col("part")))
    out = [row(named, level, F.col(level), F.col(level)) for level in ("L2", "L3")]
    out += [row(x.groupBy("nature", "direction").agg(one, F.sum("n").alias("n")), "L3", F.col("rows"), F.col("n")) for x in _tied(functions, joins, state)]
    apart = _apart(src, dst, self)
    out.append(row(apart.agg(one, F.sum("n").alias("n")), "L1", F.col("rows"), F.col("n"), none, none))
    upper = apart.where("src_ex <> dst_ex").groupBy("src_ex", "dst_ex").agg(F.sum("n").alias("n"))
    out.append(row(upper.agg(one, F.sum("n").alias("n")), "L0", F.col("rows"), F.col("n"), none, none))
    return reduce(DataFrame.unionByName, out).where("rows > 0")


def build_graph(events: DataFrame, kills: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Vertices of a trace and its edges: containment by the parent column of the vertices, communication from comm_edges. See build_model for all that a trace tells."""
    model = build_model(events, kills)
    return model.vertices.select(*VERTEX, "action", "role"), model.edges.where("nature IS NULL OR nature NOT IN ('join', 'state')")


@dataclass
class Model:
    """What build_model finds."""

    vertices: DataFrame  # VERTEX, action, role, join_role, join_group, phase
    edges: DataFrame  # EDGE
    joins: DataFrame  # node, entity, role, join_group
    state: DataFrame  # src, dst (entities), topic, takes (0 where inferred)
    flows: DataFrame | None  # topic, method, n, p50, p90, max
    totals: DataFrame  # comm_totals: the edges but those to external vertices, counted without making them
    borders: DataFrame  # EDGE, those to external vertices


def build_model(
    events: DataFrame, kills: DataFrame | None = None, types: DataFrame | None = None, groups: DataFrame | None = None, takes: DataFrame | None = None, spans: DataFrame | None = None,
    publishes: DataFrame | None = None, tolerance: int = 50_000_000,
) -> Model:
    """The whole task-graph model of a trace.

    1. Vertices of all levels (build_vertices) with external ones for topics of which the trace has one side, and the parts of actions.
    2. What entities publish and call (sent_topics), and from it joins and state links of each node; data topics only.
    3. With takes (id, session_id, vpid, vtid, t, cb, topic, ref) and spans (span_id, vpid, vtid, cb, t0, t1): polled reads, a take inside the span of another callback.
    4. Phases of functions from their fires; external and polled ones are data.
    5. Edges of all levels (comm_edges). Entities that send requests have a continuation. groups: session_id, vpid, handle, group, direction (in, out) of entities that a
       scheduler of their own links. types: topic, type.
    6. With publishes (id, topic, t): hop latencies and state ages (measure_flows), their statistics by topic and method.
    """
    events = written(events, "events")
    v = written(build_vertices(events, kills), "vertices")
    functions = written(function_table(events), "functions")
    pub, cli = (written(x, "sent") for x in sent_topics(events, functions))
    e = v.where("type = 'E'").select(F.col("id").alias("entity"), F.col("parent").alias("node"), "label", "etype")
    n = v.where("type = 'N'").select(F.col("id").alias("node"), F.col("parent").alias("executor"))
    nodes = e.join(n, "node").select("entity", "node", "executor")
    pub = pub.join(nodes, "entity").select("node", "entity", "topic")
    sub = e.where("etype = 'sub'").select("node", "entity", F.col("label").alias("topic"))
    clients = cli.join(nodes, "entity").select("node", "entity", "service")
    servers = e.where("etype = 'serv'").select("node", "entity", F.col("label").alias("service"))
    f = v.where("type = 'F'").select(F.col("parent").alias("entity"), F.col("id").alias("function"), "cb", F.lit("main").alias("part"))

    data = lambda df: df.where(topic_class(F.col("topic")) == "data")
    kinds = e.select("entity", F.col("etype").alias("kind"))
    info = types.groupBy("topic").agg(F.min("type").alias("msg_type")) if types is not None else sub.select("topic", F.lit(None).cast("string").alias("msg_type")).where("false")
    inputs = sub.join(info, "topic").select("node", "entity", F.lit("sub").alias("kind"), "msg_type")
    joins = written(detect_joins(data(pub).join(kinds, "entity").select("node", "entity", "kind", "topic"), inputs), "joins")
    fired = functions.where("fires").select(_id("E", *KEY, "handle").alias("entity"), F.lit(1).alias("fires"))
    quiet = detect_state_links(data(sub).join(fired, "entity"), data(pub), joins)
    state = quiet.join(sub.select(F.col("entity").alias("src"), "topic"), "src").select("src", "dst", "topic", F.lit(0).cast("bigint").alias("takes"))
    polled = v.select(F.col("id").alias("entity")).where("false")
    if takes is not None and spans is not None:
        owner = functions.select("vpid", "cb", _id("E", *KEY, "handle").alias("entity")).groupBy("vpid", "cb").agg(F.min("entity").alias("entity"))
        name = lambda c: F.concat_ws("@", F.col(c), F.col("vpid").cast("string"))  # noqa: E731  callbacks are unique in a process only
        reads = detect_polled(data(takes).withColumn("cb", name("cb")), spans.withColumn("cb", name("cb")))
        named = lambda c, to: owner.select(name("cb").alias(c), F.col("entity").alias(to))
        seen = written(reads.join(named("sub_cb", "src"), "sub_cb").join(named("reader", "dst"), "reader").groupBy("src", "dst", "topic").agg(F.sum("takes").alias("takes")), "polled")
        state, polled = state.unionByName(seen), seen.select(F.col("src").alias("entity")).distinct()
    state = written(state, "state")

    outer, borders = external_graph(pub, sub, types)
    none = F.lit(None).cast("string")
    every = v.unionByName(outer.select(none.alias("session_id"), "id", "type", "level", "parent", "label", "etype", none.alias("cb")))
    own = functions.select(_id("F", *KEY, "handle").alias("function"), _id("cb", *KEY, "cb").alias("cb"))
    marks = events.where("event = 'callback_start'").select(*KEY, "ts_ns", F.col("payload")["callback"].alias("cb")).select(_id("cb", *KEY, "cb").alias("cb"), "ts_ns")
    bounds = marks.groupBy("cb").agg(F.min("ts_ns").alias("first_ns"), F.max("ts_ns").alias("last_ns"), F.count(F.lit(1)).alias("fires"))
    asked = own.join(f.select("function", "entity"), "function").join(nodes, "entity").join(kinds.withColumnRenamed("kind", "source"), "entity").join(polled.withColumn("polled", F.lit(True)), "entity", "left")
    phases = mark_phases(asked.select("function", "executor", "cb", "source", F.lit(False).alias("external"), F.coalesce("polled", F.lit(False)).alias("polled")), bounds).select(F.col("function").alias("id"), "phase")
    roles = joins.groupBy(F.col("entity").alias("id")).agg(F.array_join(F.array_sort(F.collect_set("role")), ",").alias("join_role"), F.min("join_group").alias("join_group"))
    phase = F.coalesce("phase", F.when((F.col("type") == "F") & (F.col("etype") == "ext"), "data")).alias("phase")
    vertices = detect_actions(every).join(roles, "id", "left").join(phases, "id", "left").select(*VERTEX, "action", "role", "join_role", "join_group", phase)

    ends = {"ingress": None, "egress": None}
    if groups is not None:
        member = groups.select(_id("E", *KEY, "handle").alias("entity"), "group", "direction").join(nodes.select("entity", "node"), "entity")
        ends = {"ingress": member.where("direction = 'in'"), "egress": member.where("direction = 'out'")}
    parts = split_callbacks(f.drop("cb"), clients)
    edges = comm_edges(pub, sub, clients, servers, parts, nodes, joins=joins, state=state, **ends)
    totals = comm_totals(pub, sub, clients, servers, parts, nodes, joins=joins, state=state, **ends)
    borders = borders.where("nature = 'msg'").select("src", "dst", "level", "nature", "topic", none.alias("direction"), F.lit(False).alias("intra_node"), F.lit(1).cast("bigint").alias("n"))
    flows = flow_stats(measure_flows(takes, publishes, spans, tolerance), "value", "topic", "method") if publishes is not None and takes is not None and spans is not None else None
    return Model(vertices, edges.unionByName(borders), joins, state, flows, totals, borders)
