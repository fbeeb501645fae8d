"""The task-graph model: resolving handles, binding entities to callbacks, joins, phases and boundaries."""

from __future__ import annotations

from functools import reduce
from math import gcd

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from tracewright.functions.scalars import action_name, action_role
from tracewright.operators.scale import grid_join, written
from tracewright.operators.temporal import asof, asof_last, asof_tolerance, earliest_open, interval_owner, nearest_tolerance
from tracewright.shipping import ship_package


def _one(events: DataFrame, event: str, /, **columns: str) -> DataFrame:
    """Events of one name with payload keys as columns, keyed by session and process."""
    return events.where(F.col("event") == event).select("session_id", "vpid", "ts_ns", "id", *[F.col("payload")[k].alias(c) for c, k in columns.items()])


def first_per_key(df: DataFrame, *keys: str) -> DataFrame:
    """The row with the least (ts_ns, id) of each key."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct("ts_ns", "id")).alias("r")).select(*keys, "r.*")


def last_per_key(df: DataFrame, *keys: str) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct("ts_ns", "id")).alias("r")).select(*keys, "r.*")


def all_per_key(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """The values of each key in time order."""
    return df.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("ts_ns", "id", value))), lambda x: x[value]).alias(value))


def resolve_chain(events: DataFrame) -> DataFrame:
    """Candidates (session_id, vpid, handle, kind, name, cb, pos, symbol): subscriptions over their objects, services and timers by handle.

    Subscriptions go handle -> object -> callback -> symbol; keys hold session and process. Events that begin with py_ are those of a second client
    library, which binds callbacks to handles straight: they count for handles that the first library has no callback for. Its symbols win.
    """
    k = ["session_id", "vpid"]
    registers = [_one(events, f"{lib}callback_register", cb="callback", symbol="symbol").withColumn("lib", F.lit(i)) for i, lib in enumerate(("", "py_"))]
    symbol = registers[0].unionByName(registers[1]).groupBy(*k, "cb").agg(F.max_by("symbol", F.struct("lib", "ts_ns", "id")).alias("symbol"))
    sub = last_per_key(_one(events, "subscription_init", handle="subscription_handle", name="topic_name"), *k, "handle").select(*k, "handle", "name")
    objects = _one(events, "subscription_object", handle="subscription_handle", object="subscription").select(*k, "handle", "object")
    added = _one(events, "subscription_callback_added", object="subscription", cb="callback")
    subs = sub.join(objects, [*k, "handle"]).join(added, [*k, "object"]).withColumn("kind", F.lit("sub"))
    direct = []
    second = [sub.join(_one(events, "py_subscription_callback_added", handle="subscription_handle", cb="callback"), [*k, "handle"]).withColumn("kind", F.lit("sub"))]
    for kind, init, link, key, name in (("serv", "service_init", "service_callback_added", "service_handle", "service_name"), ("tmr", "timer_init", "timer_callback_added", "timer_handle", "period_ns")):
        a = last_per_key(_one(events, init, handle=key, name=name), *k, "handle").select(*k, "handle", "name")
        for found, event in ((direct, link), (second, f"py_{link}")):
            found.append(a.join(_one(events, event, handle=key, cb="callback"), [*k, "handle"]).withColumn("kind", F.lit(kind)))
    cols = [*k, "handle", "kind", "name", "cb", "ts_ns", "id"]
    every = subs.select(*cols)
    for x in direct:
        every = every.unionByName(x.select(*cols))
    bound = every.select(*k, "kind", "handle").distinct()
    every = every.unionByName(reduce(DataFrame.unionByName, [x.select(*cols) for x in second]).join(bound, [*k, "kind", "handle"], "left_anti").select(*cols))
    pos = F.row_number().over(Window.partitionBy(*k, "kind", "handle").orderBy("ts_ns", "id"))
    return every.withColumn("pos", pos).join(symbol, [*k, "cb"], "left").select(*k, "handle", "kind", "name", "cb", "pos", "symbol")


def pick_candidate(candidates: DataFrame, fired: DataFrame, intra: DataFrame) -> DataFrame:
    """One callback per handle, with the reason and the other firing ones.

    A single candidate is taken; else a firing intra-process copy, else the first firing, else the first
    intra-process one, else the first by registration.
    """
    k = ["session_id", "vpid", "kind", "handle"]
    f = fired.select("session_id", "vpid", "cb").distinct().withColumn("fires", F.lit(True))
    i = intra.select("session_id", "vpid", "cb").distinct().withColumn("intra", F.lit(True))
    rows = candidates.join(f, ["session_id", "vpid", "cb"], "left").join(i, ["session_id", "vpid", "cb"], "left").na.fill(False, ["fires", "intra"])
    score = F.when(F.col("fires") & F.col("intra"), 0).when(F.col("fires"), 1).when(F.col("intra"), 2).otherwise(3)
    w = Window.partitionBy(*k)
    rows = rows.withColumn("score", score).withColumn("n", F.count(F.lit(1)).over(w)).withColumn("rn", F.row_number().over(w.orderBy("score", "pos")))
    reason = F.when(F.col("n") == 1, "single").when(F.col("score") == 0, "intra_fired").when(F.col("score") == 1, "first_fired").when(F.col("score") == 2, "intra").otherwise("first")
    chosen = rows.where("rn = 1").withColumn("reason", reason)
    others = rows.where("rn > 1 AND fires").groupBy(*k).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "cb"))), lambda x: x["cb"]).alias("alternates"))
    return chosen.join(others, k, "left").withColumn("alternates", F.coalesce("alternates", F.array().cast("array<string>"))).select(*k, "name", "cb", "symbol", "reason", "fires", "alternates")


def bind_intra(candidates: DataFrame, waitables: DataFrame) -> DataFrame:
    """Delivery of each handle: both, ipc or dds, from its candidates' membership among intra-process waitables."""
    w = waitables.select("session_id", "vpid", F.col("callback").alias("cb")).distinct().withColumn("ipc", F.lit(1))
    return candidates.join(w, ["session_id", "vpid", "cb"], "left").groupBy("session_id", "vpid", "handle").agg(
        F.when((F.count("ipc") > 0) & (F.count("ipc") < F.count(F.lit(1))), "both").when(F.count("ipc") > 0, "ipc").otherwise("dds").alias("delivery")
    )


def entities_of(traced: DataFrame, snapshot: DataFrame, key: list[str]) -> DataFrame:
    """Entities from the trace and the snapshot; a snapshot value wins unless it is null or '?'."""
    cols = [c for c in traced.columns if c not in key]
    both = traced.alias("t").join(snapshot.alias("s"), key, "full_outer")
    return both.select(*key, *[F.coalesce(F.nullif(F.col(f"s.{c}"), F.lit("?")), F.col(f"t.{c}")).alias(c) for c in cols])


def attribute_links(links: DataFrame, entities: DataFrame, by_topic: DataFrame | None = None) -> DataFrame:
    """Publish, client and receive links with the entity of their callback: primary first, then alternates; then the fallback by (node, topic).

    One row per (entity, name); rows that find no entity have entity null.
    """
    alias = entities.select("session_id", "vpid", "entity", F.posexplode(F.concat(F.array("cb"), F.coalesce("alternates", F.array().cast("array<string>")))).alias("pos", "cb"))
    alias = alias.groupBy("session_id", "vpid", "cb").agg(F.min_by("entity", F.struct("pos", "entity")).alias("entity"))
    out = links.join(alias, ["session_id", "vpid", "cb"], "left")
    if by_topic is not None:
        by_topic = by_topic.groupBy("session_id", "node", "name").agg(F.min("entity").alias("fallback"))
        out = out.join(by_topic, ["session_id", "node", "name"], "left").withColumn("entity", F.coalesce("entity", "fallback")).drop("fallback")
    return out.groupBy("session_id", "entity", "name").agg(F.count(F.lit(1)).alias("links"))


def attribute_by_active(publishes: DataFrame, spans: DataFrame) -> DataFrame:
    """Publishes with the open callback of their thread, else the earliest still open callback of their process."""
    spans = written(spans.select("span_id", "t0", "t1", "vpid", "vtid"), "spans")
    own = written(interval_owner(publishes, spans, ["vpid", "vtid"]).select("id", "vpid", "vtid", "t", "span_id"), "owned")
    out = earliest_open(own, spans, ["vpid"])
    return out.select("id", "vpid", "vtid", "t", F.coalesce("span_id", "open_id").alias("span_id"), F.when(F.col("span_id").isNotNull(), "thread").when(F.col("open_id").isNotNull(), "process").otherwise("none").alias("rule"))


def match_topics(pub: DataFrame, sub: DataFrame) -> DataFrame:
    """Every publishing entity with every subscribing entity of the topic; pairs of one node are flagged. See with_topic_data for type and rate.

    The pairs of a busy topic are spread over a grid of tasks.
    """
    p = pub.select(F.col("node").alias("src_node"), F.col("entity").alias("src"), "topic").distinct()
    s = sub.select(F.col("node").alias("dst_node"), F.col("entity").alias("dst"), "topic").distinct()
    return grid_join(p, s, "topic").withColumn("intra_node", F.col("src_node") == F.col("dst_node"))


def with_topic_data(edges: DataFrame, info: DataFrame, rates: DataFrame) -> DataFrame:
    """Edges (topic, ...) with the topic's message type and average rate, null where unknown. info: topic, type; rates: topic, average_rate."""
    t = info.groupBy("topic").agg(F.min("type").alias("msg_type"))
    r = rates.groupBy("topic").agg(F.max("average_rate").alias("avg_rate_hz"))
    return edges.join(t, "topic", "left").join(r, "topic", "left")


def match_services(clients: DataFrame, servers: DataFrame) -> DataFrame:
    """A request and a response edge for each client and server of a service."""
    pairs = grid_join(clients.select(F.col("entity").alias("src"), "service").distinct(), servers.select(F.col("entity").alias("dst"), "service").distinct(), "service")
    back = pairs.select("service", F.col("dst").alias("src"), F.col("src").alias("dst"))
    return pairs.withColumn("part", F.lit("request")).unionByName(back.withColumn("part", F.lit("response"))).withColumn("nature", F.lit("dep"))


def external_boundary(pub: DataFrame, sub: DataFrame) -> DataFrame:
    """Edges from an external source for topics nobody publishes, to an external sink for topics nobody takes."""
    p, s = pub.select(F.col("entity").alias("src"), "topic").distinct(), sub.select(F.col("entity").alias("dst"), "topic").distinct()
    into = s.join(p, "topic", "left_anti").select(F.concat(F.lit("ext:src:"), "topic").alias("src"), "dst", "topic")
    out = p.join(s, "topic", "left_anti").select("src", F.concat(F.lit("ext:sink:"), "topic").alias("dst"), "topic")
    return into.unionByName(out)


def external_graph(pub: DataFrame, sub: DataFrame, info: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Vertices (id, type, level, parent, label, etype) and edges (src, dst, level, nature, topic, msg_type) that external_boundary() stands for.

    Each topic with one side only has an external entity with one function in it. Edges from a source carry the topic's message type, where
    info (topic, type) knows it.
    """
    outer = external_boundary(pub, sub)
    ends = outer.select(F.col("src").alias("id"), "topic").unionByName(outer.select(F.col("dst").alias("id"), "topic")).where("id LIKE 'ext:%'").distinct()
    none = F.lit(None).cast("string")
    label = F.concat(F.lit("ext:"), "topic").alias("label")
    function = F.concat("id", F.lit("/f"))
    e = ends.select("id", F.lit("E").alias("type"), F.lit(2).alias("level"), none.alias("parent"), label, F.lit("ext").alias("etype"))
    f = ends.select(function.alias("id"), F.lit("F").alias("type"), F.lit(3).alias("level"), F.col("id").alias("parent"), label, F.lit("ext").alias("etype"))
    kinds = info.groupBy("topic").agg(F.min("type").alias("msg_type")) if info is not None else outer.select("topic", none.alias("msg_type")).where("false")
    comm = outer.join(kinds, "topic", "left").select("src", "dst", F.lit("L2").alias("level"), F.lit("msg").alias("nature"), "topic", F.when(F.col("src").startswith("ext:"), F.col("msg_type")).alias("msg_type"))
    inner = ends.select(F.col("id").alias("src"), function.alias("dst"), F.lit("V").alias("level"), F.lit("contains").alias("nature"), none.alias("topic"), none.alias("msg_type"))
    return e.unionByName(f), comm.unionByName(inner)


def propagate_functions(edges: DataFrame, functions: DataFrame, more: list[str] = ()) -> DataFrame:
    """Entity edges as function edges: main to main; a response goes to the continuation, or to main if there is none. more: columns to carry along."""
    f = functions.groupBy("entity").agg(F.min(F.when(F.col("part") == "main", F.col("function"))).alias("main"), F.min(F.when(F.col("part") == "continuation", F.col("function"))).alias("cont"))
    a, b = f.select(F.col("entity").alias("src"), F.col("main").alias("src_fn")), f.select(F.col("entity").alias("dst"), F.col("main").alias("dst_main"), "cont")
    to = F.when(F.col("part") == "response", F.coalesce("cont", "dst_main")).otherwise(F.col("dst_main"))
    return edges.join(a, "src").join(b, "dst").select(F.col("src_fn").alias("src"), to.alias("dst"), "topic", "part", *more)


def split_callbacks(functions: DataFrame, clients: DataFrame) -> DataFrame:
    """Functions of entities that send requests become two parts: main and continuation."""
    c = clients.select("entity").distinct().withColumn("client", F.lit(True))
    parts = F.when(F.col("client"), F.array(F.lit("main"), F.lit("continuation"))).otherwise(F.array(F.lit("main")))
    out = functions.drop("part").join(c, "entity", "left").withColumn("part", F.explode(parts)).drop("client")
    return out.withColumn("function", F.when(F.col("part") == "continuation", F.concat("function", F.lit("#cont"))).otherwise(F.col("function")))


def group_links(ingress: DataFrame, egress: DataFrame) -> DataFrame:
    """Edges from every ingress to every egress of the same node and group."""
    ends = lambda df, name: df.select("node", "group", F.col("entity").alias(name)).distinct()
    return grid_join(ends(ingress, "src"), ends(egress, "dst"), "node", "group").where("src <> dst")


def unowned_threads(runtime: DataFrame, spans: DataFrame) -> DataFrame:
    """Threads of accelerator processes that call the runtime but never start a callback."""
    return runtime.select("pid", "tid").distinct().join(spans.select(F.col("vpid").alias("pid"), F.col("vtid").alias("tid")).distinct(), ["pid", "tid"], "left_anti")


def gpu_pids(activity: DataFrame, runtime: DataFrame) -> DataFrame:
    """Processes seen in activities; if there are none, those seen in runtime calls."""
    some = activity.select("pid").distinct().withColumn("rank", F.lit(0)).unionByName(runtime.select("pid").distinct().withColumn("rank", F.lit(1)))
    best = some.agg(F.min("rank").alias("best"))
    return some.join(F.broadcast(best), F.col("rank") == F.col("best"), "left_semi").select("pid")


def profiled_pids(log: DataFrame, tree: DataFrame, calls: DataFrame, processes: DataFrame, wrapper: str) -> DataFrame:
    """(pid, source, calls) of processes that ran under a profiler, found in two ways.

    resurrect: the process hangs below a resurrected one (log: action, resurrected_pid), with only processes between that
    are wrappers (their cmd holds the wrapper's name) while its own cmd does not. tree: pid, ppid, cmd. launch_wrap: it is one of the profiler's own processes
    (global_pid) that made runtime calls (global_tid); the numbers share all but their low 24 bits. calls counts those, 0 for resurrect.

    Each wrapper's way up is doubled until it ends outside the wrappers, so rounds grow with the logarithm of the deepest chain.
    """
    wraps = F.coalesce(F.contains("cmd", F.lit(wrapper)), F.lit(False))
    born = log.where("action = 'resurrect'").select(F.col("resurrected_pid").alias("pid")).where("pid IS NOT NULL").distinct()
    rows = written(tree.select("pid", "ppid", wraps.alias("wraps")).where("pid IS NOT NULL"), "tree")
    up = written(rows.where("wraps").join(born, "pid", "left_anti").groupBy("pid").agg(F.min("ppid").alias("top")), "wrappers")
    for _ in range(max(1, up.count()).bit_length() + 1):  # processes that are each other's parents would never end
        step = up.join(up.select(F.col("pid").alias("top"), F.col("top").alias("next")), "top", "left")
        step = written(step.select("pid", F.coalesce("next", "top").alias("top"), F.col("next").isNotNull().alias("moved")), "wrappers")
        up = step.drop("moved")
        if not step.where("moved").limit(1).count():
            break
    below = rows.where("not wraps").join(up.select(F.col("pid").alias("ppid"), "top"), "ppid", "left").select("pid", F.coalesce("top", "ppid").alias("top"))
    found = below.join(born.select(F.col("pid").alias("top")), "top", "left_semi").select("pid").distinct().select("pid", F.lit("resurrect").alias("source"), F.lit(0).cast("bigint").alias("calls"))
    high = lambda c: F.shiftright(c, 24).alias("high")
    made = calls.groupBy(high("global_tid")).agg(F.count(F.lit(1)).alias("n"))
    own = processes.select("pid", high("global_pid")).distinct().join(made, "high").groupBy("pid").agg(F.sum("n").alias("calls"))
    return found.unionByName(own.select("pid", F.lit("launch_wrap").alias("source"), "calls"))


def match_boundaries(graphs: DataFrame) -> DataFrame:
    """Real publisher of one role to real subscriber of another, over topics that both left external; graphs: role, entity, topic, direction."""
    p = graphs.where("direction = 'pub'").select(F.col("role").alias("src_role"), F.col("entity").alias("src"), "topic")
    s = graphs.where("direction = 'sub'").select(F.col("role").alias("dst_role"), F.col("entity").alias("dst"), "topic")
    return p.join(s, "topic").where("src_role <> dst_role").distinct()


def compare_metrics(off: DataFrame, on: DataFrame, key: str) -> DataFrame:
    """Difference and per cent of values present in both; per cent is null on a base of 0."""
    both = off.select(key, F.col("value").alias("a")).join(on.select(key, F.col("value").alias("b")), key)
    return both.select(key, (F.col("b") - F.col("a")).alias("delta"), F.round(100.0 * (F.col("b") - F.col("a")) / F.nullif("a", F.lit(0)), 6).alias("pct"))


def expected_vs_actual(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Counts beside their expectation by key, and the total."""
    rows = expected.join(actual, "key", "left").na.fill(0, ["actual"])
    out = rows.rollup("key").agg(F.sum("expected").alias("expected"), F.sum("actual").alias("actual"))
    verdict = F.when(F.col("actual") == F.col("expected"), "ok").when(F.col("actual") < F.col("expected"), "missing").otherwise("extra")
    return out.select(F.coalesce("key", F.lit("total")).alias("key"), "expected", "actual", (F.col("actual") - F.col("expected")).alias("delta"), verdict.alias("verdict"))


def mark_phases(functions: DataFrame, bounds: DataFrame) -> DataFrame:
    """Phase of each function: data if its last fire is not before its executor's data start, init if before, zero_exec if it never fired.

    The data start of an executor is the least first fire of its timers with two fires or more; without any the least over
    the session; without that too: unknown. External and polled functions are data. functions: function, executor, cb, source, external, polled.
    """
    b = functions.join(bounds, "cb", "left")
    timers = b.where("source = 'tmr' AND fires >= 2")
    starts = timers.groupBy("executor").agg(F.min("first_ns").alias("start"))
    session = timers.agg(F.min("first_ns").alias("session_start"))
    out = b.join(starts, "executor", "left").join(F.broadcast(session), F.lit(True), "left").withColumn("start", F.coalesce("start", "session_start"))
    phase = (
        F.when(F.col("external") | F.col("polled"), "data").when(F.coalesce("fires", F.lit(0)) == 0, "zero_exec")
        .when(F.col("start").isNull(), "unknown").when(F.col("last_ns") >= F.col("start"), "data").otherwise("init")
    )
    return out.select("function", "executor", "cb", phase.alias("phase"))


def detect_joins(publishes: DataFrame, types: DataFrame) -> DataFrame:
    """Roles at topics that two or more subscription entities of a node publish.

    publishes: node, entity, kind, topic; types: entity, msg_type (of its input). completer: such a
    publisher; member: another subscription of the node with the input type of a completer; timeout: a timer
    that publishes the topic. The first topic by name is the join's group.
    """
    multi = publishes.where("kind = 'sub'").groupBy("node", "topic").agg(F.count_distinct("entity").alias("n")).where("n >= 2").select("node", "topic")
    at = publishes.join(multi, ["node", "topic"])
    completers = at.where("kind = 'sub'").select("node", "topic", "entity", F.lit("completer").alias("role"))
    timeouts = at.where("kind = 'tmr'").select("node", "topic", "entity", F.lit("timeout").alias("role"))
    # Only the first topic by name is reported, so one topic per node and type is enough.
    input_types = completers.join(types.select("entity", "msg_type").distinct(), "entity").groupBy("node", "msg_type").agg(F.min("topic").alias("topic"))
    subs = types.where("kind = 'sub'").select("node", "entity", "msg_type")
    members = subs.join(input_types, ["node", "msg_type"]).join(completers.select("node", "entity"), ["node", "entity"], "left_anti").select("node", "topic", "entity", F.lit("member").alias("role"))
    return completers.unionByName(members).unionByName(timeouts).groupBy("node", "entity", "role").agg(F.min("topic").alias("join_group"))


def detect_state_links(subs: DataFrame, publishers: DataFrame, joins: DataFrame) -> DataFrame:
    """Fired data subscriptions that publish nothing and are in no join feed every data publisher of their node."""
    quiet = subs.where("fires > 0").join(publishers.select("node", "entity"), ["node", "entity"], "left_anti").join(joins.select("node", "entity"), ["node", "entity"], "left_anti")
    return quiet.select("node", F.col("entity").alias("src")).join(publishers.select("node", F.col("entity").alias("dst")).distinct(), "node")


def detect_polled(takes: DataFrame, spans: DataFrame) -> DataFrame:
    """Takes inside another callback's span: (sub callback, reader callback, topic) with their number. takes: id, vpid, vtid, t, cb, topic."""
    inside = interval_owner(takes.withColumnRenamed("cb", "sub_cb"), spans, ["vpid", "vtid"])
    reader = inside.where("span_id IS NOT NULL").join(spans.select("span_id", F.col("cb").alias("reader")), "span_id")
    return reader.where("reader <> sub_cb").groupBy("sub_cb", "reader", "topic").agg(F.count(F.lit(1)).alias("takes"))


def measure_flows(takes: DataFrame, publishes: DataFrame, spans: DataFrame, tolerance: int) -> DataFrame:
    """Hop latency of takes by their source time or the nearest publish of the topic, and the state age of the thread's spans.

    takes: id, topic, vpid, vtid, t, ref; publishes: id, topic, t. One row per take: method and value in ns.
    """
    hop = nearest_tolerance(takes, publishes, ["topic"], tolerance).select("id", "topic", F.when(F.coalesce("ref", F.lit(0)) == 0, "nearest").otherwise("source").alias("method"), (F.col("t") - F.col("match_t")).alias("value"))
    ends = spans.select("vpid", "vtid", F.col("t1").alias("t"), F.col("span_id").alias("id"))
    age = asof_last(takes.select("id", "topic", "vpid", "vtid", "t"), ends, ["vpid", "vtid"]).where("r_t IS NOT NULL").select("id", "topic", F.lit("state_age").alias("method"), F.col("age").alias("value"))
    return hop.unionByName(age)


def local_hops(starts: DataFrame, publishes: DataFrame, edges: DataFrame, tolerance: int) -> DataFrame:
    """Hop latency inside a process: each start of a receiving function with the latest publish of the sending one at or before it.

    starts: id, cb, t; publishes: id, topic, cb, t; edges: topic, src, dst (callbacks) that no take was seen for. Rows topic, src, dst, id, value.
    """
    left = edges.select("topic", "src", "dst").distinct().join(starts.select("id", F.col("cb").alias("dst"), "t"), "dst")
    return asof_tolerance(left, publishes.select("id", "topic", F.col("cb").alias("src"), "t"), ["topic", "src"], tolerance).select("topic", "src", "dst", "id", (F.col("t") - F.col("r_t")).alias("value"))


def polled_ages(takes: DataFrame, spans: DataFrame) -> DataFrame:
    """Age of the data that a callback reads by itself: take less source time, where the take lies in the span of another callback.

    takes: id, vpid, vtid, t, cb (of the subscription), topic, ref (source time). Rows topic, sub_cb, reader, id, value; negative ages and missing source times are left out.
    """
    inside = interval_owner(takes.withColumnRenamed("cb", "sub_cb"), spans, ["vpid", "vtid"]).where("span_id IS NOT NULL").join(spans.select("span_id", F.col("cb").alias("reader")), "span_id")
    return inside.where("reader <> sub_cb AND ref IS NOT NULL AND t >= ref").select("topic", "sub_cb", "reader", "id", (F.col("t") - F.col("ref")).alias("value"))


def state_ages(starts: DataFrame, links: DataFrame) -> DataFrame:
    """Age of held data along state links (src, dst callbacks): each start of the reader less the last start of the writer strictly before it."""
    left = links.select("src", "dst").distinct().join(starts.select("id", F.col("cb").alias("dst"), "t"), "dst")
    found = asof_last(left, starts.select("id", F.col("cb").alias("src"), "t"), ["src"])
    return found.where("r_t IS NOT NULL").select("src", "dst", "id", F.col("age").alias("value"))


def detect_actions(entities: DataFrame) -> DataFrame:
    """entities (label, ...) with action and role where the label is part of an action, else null."""
    return entities.withColumn("action", action_name(F.col("label"))).withColumn("role", F.when(F.col("action").isNotNull(), action_role(F.col("label"))))


def complete_actions(labels: DataFrame) -> DataFrame:
    """(action, services, topics, complete): an action is complete with its three services and two topics."""
    roles = detect_actions(labels).where("action IS NOT NULL").groupBy("action").agg(F.collect_set("role").alias("r"))
    n = lambda *names: F.size(F.array_intersect("r", F.array(*[F.lit(x) for x in names])))
    return roles.select("action", n("goal", "cancel", "result").alias("services"), n("feedback", "status").alias("topics")).withColumn("complete", (F.col("services") == 3) & (F.col("topics") == 2))


def filter_functions(functions: DataFrame, phases: list[str], keep: Column, external: str = "show", drop_external: Column | None = None) -> DataFrame:
    """Functions (phase, ptype, ...) of allowed phases whose node passes the filter. External ones count as data; they are hidden on
    request, and otherwise dropped only by a pattern of their own."""
    ext = F.coalesce(F.col("ptype") == "ext", F.lit(False))
    rows = functions.withColumn("phase", F.when(ext, "data").otherwise(F.coalesce("phase", F.lit("unknown"))))
    rows = rows.where(F.col("phase").isin(phases)).where(F.when(ext, F.lit(external != "hide")).otherwise(F.coalesce(keep, F.lit(False))))
    return rows.where(~ext | ~F.coalesce(drop_external, F.lit(False))) if drop_external is not None else rows


def exclude_killed(events: DataFrame, kills: DataFrame) -> DataFrame:
    """Events of processes that the kill log (killed_pid) does not name."""
    return events.join(kills.where("killed_pid IS NOT NULL").select(F.col("killed_pid").alias("vpid")).distinct(), "vpid", "left_anti")


def scope_filter(df: DataFrame, session: str | None = None, container: str | None = None) -> DataFrame:
    """Rows of a session and a container; None leaves a filter out."""
    out = df if session is None else df.where(F.col("session_id") == session)
    return out if container is None else out.where(F.col("container") == container)


#: Entities that only serve control.
CONTROL_PATTERNS = ["/parameter_events", "/rosout", "/_supported_types"]


def strip_control(functions: DataFrame, edges: DataFrame, patterns: list[str] = CONTROL_PATTERNS) -> tuple[DataFrame, DataFrame]:
    """Functions (id, entity) whose entity holds no control pattern, and the edges both of whose ends are left."""
    hit = F.coalesce(reduce(lambda a, p: a | F.col("entity").contains(p), patterns, F.lit(False)), F.lit(False))
    left = functions.where(~hit)
    ids = left.select(F.col("id").alias("k")).distinct()
    return left, edges.join(ids, F.col("src") == F.col("k"), "left_semi").join(ids, F.col("dst") == F.col("k"), "left_semi")


def is_boilerplate(kind: Column, label: Column) -> Column:
    """Entities about parameters and functions of the parameter service."""
    entity = (kind == "E") & F.lower(label).contains("parameter")
    function = (kind == "F") & (label.contains("ParameterService") | label.contains("TimeSource::param_event"))
    return F.coalesce(entity | function, F.lit(False))


def common_members(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(key, common): the sorted members that both tables have for a key. a, b: key, member."""
    both = a.select(key, "member").distinct().join(b.select(key, "member").distinct(), [key, "member"], "left_semi")
    return both.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list("member")), ",").alias("common"))


def service_round_trip(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """Requests with their response by (client, sequence number) and the time between."""
    return requests.join(responses.select("client", "seq", F.col("t").alias("t_response")), ["client", "seq"]).withColumn("round_trip", F.col("t_response") - F.col("t"))


def join_case(stats: DataFrame) -> DataFrame:
    """1b: timer driven; 2: all members needed (with timeout if one fires it); 1a: any member; else undetermined.

    stats: join_group, timer_share, complete_share, timeouts.
    """
    case = F.when(F.col("timer_share") >= 0.5, "1b").when(F.col("complete_share") >= 0.9, F.when(F.col("timeouts") > 0, "2_timeout").otherwise("2")).when(F.col("complete_share") < 0.5, "1a").otherwise("undetermined")
    return stats.withColumn("case", case)


@F.pandas_udf(LongType())
def _lcm(values: pd.Series) -> int:
    limit, out = 3_600_000_000_000, 1
    for v in sorted(set(values.dropna().astype("int64"))):
        out = out * v // gcd(out, int(v))
        if out > limit:
            break
    return min(int(out), 2**63 - 1)


def hyperperiod(periods: DataFrame, key: str = "executor") -> DataFrame:
    """Least common multiple of the distinct periods of each executor, ascending, stopped once above one hour (capped)."""
    ship_package(periods.sparkSession)
    few = periods.where("period_ns > 0").select(key, "period_ns").distinct()
    return few.groupBy(key).agg(_lcm("period_ns").alias("hyperperiod_ns")).withColumn("capped", F.col("hyperperiod_ns") > 3_600_000_000_000)


def taskset(functions: DataFrame, stats: DataFrame, roles: DataFrame) -> DataFrame:
    """One row per function: source class, period, execution statistics, delivery and join role. A function of several groups takes the first by name."""
    source = F.when(F.col("period_ns") > 0, "periodic").otherwise("aperiodic")
    first = roles.groupBy("entity").agg(F.min(F.struct("join_group", "role")).alias("r")).select("entity", "r.role", "r.join_group")
    return functions.join(stats, "cb", "left").join(first, "entity", "left").withColumn("class", source).na.fill(0, ["n", "mean", "p50", "p99", "max"])


def callback_groups(groups: DataFrame) -> DataFrame:
    """Executors of a process ranked by their number of distinct callback groups; the first is primary. groups: vpid, executor, group."""
    n = groups.groupBy("vpid", "executor").agg(F.count_distinct("group").alias("groups"))
    return n.withColumn("rank", F.row_number().over(Window.partitionBy("vpid").orderBy(F.col("groups").desc(), "executor"))).withColumn("primary", F.col("rank") == 1)


def group_of_entities(groups: DataFrame, members: DataFrame) -> DataFrame:
    """entity with its callback group and the group's executor: the first group by name on ties. groups: vpid, executor, group; members: vpid, group, entity."""
    pairs = members.join(groups.select("vpid", "executor", "group").distinct(), ["vpid", "group"])
    return pairs.groupBy("vpid", "entity").agg(F.min(F.struct("group", "executor")).alias("g")).select("vpid", "entity", "g.group", "g.executor")


def publisher_coverage(inits: DataFrame, links: DataFrame, fires: DataFrame) -> DataFrame:
    """Publishers by handle: GAP without a link though the process fires, low with few links, else ok."""
    n = links.groupBy("vpid", "handle").agg(F.count(F.lit(1)).alias("links"), F.count_distinct("cb").alias("callbacks"))
    f = fires.groupBy("vpid").agg(F.count(F.lit(1)).alias("fires"))
    out = inits.select("vpid", "handle", "topic").distinct().join(n, ["vpid", "handle"], "left").join(f, "vpid", "left").na.fill(0, ["links", "callbacks", "fires"])
    return out.withColumn("verdict", F.when((F.col("links") == 0) & (F.col("fires") > 0), "GAP").when(F.col("links") * 10 < F.col("fires"), "low").otherwise("ok"))


def quality_report(chosen: DataFrame, fired: DataFrame) -> DataFrame:
    """Bindings by reason, and the fired callbacks that are bound to nothing."""
    by = chosen.groupBy(F.col("reason").alias("category")).agg(F.count(F.lit(1)).alias("n"))
    keys = ["session_id", "vpid", "cb"]
    loose = fired.select(*keys).distinct().join(chosen.select(*keys).distinct(), keys, "left_anti").agg(F.count(F.lit(1)).alias("n")).select(F.lit("fired_unbound").alias("category"), "n")
    return by.unionByName(loose)


def drop_tool_processes(nodes: DataFrame, helpers: str | None, viewers: str | None, callers: str | None = None) -> DataFrame:
    """Nodes of processes that are not only command line helpers and hold no viewer; patterns are expressions over node and process names, None switches a rule off.

    callers keeps processes of helpers of which a node's name matches it (those that call actions).
    """
    match = lambda c, pattern: F.coalesce(F.col(c).rlike(pattern), F.lit(False)) if pattern else F.lit(False)
    per = nodes.groupBy("vpid").agg(F.bool_and(match("node", helpers)).alias("tools"), F.bool_or(match("node", callers)).alias("calls"), F.bool_or(match("proc", viewers)).alias("view"))
    return nodes.join(per.where("(NOT tools OR calls) AND NOT view").select("vpid"), "vpid", "left_semi")


#: Bytes of subscriber texts that are broadcast; above, the rows of a topic are dealt to TEXT_PARTS tasks.
TEXT_BYTES, TEXT_PARTS = 128 << 20, 32


def causal_feed(links: DataFrame, handles: DataFrame, edges: DataFrame) -> DataFrame:
    """Publish links with their topic, and the sorted subscribers of that topic.

    Each row holds the whole text of its topic, so the rows are dealt to tasks evenly whatever their topics. The texts are copied to
    the tasks: broadcast up to TEXT_BYTES in all, else by a join on (topic, part). Parquet files that are written from it hold a text once.
    """
    subs = edges.groupBy("topic").agg(F.array_join(F.array_sort(F.collect_set("dst")), ",").alias("subscribers"))
    subs = written(subs, "subscribers")
    named = links.join(handles.select("vpid", "handle", "topic").distinct(), ["vpid", "handle"])
    tasks = 4 * links.sparkSession.sparkContext.defaultParallelism
    size = F.octet_length("subscribers").cast("bigint")
    different, longest = subs.select("subscribers").distinct().agg(F.coalesce(F.sum(size + 4), F.lit(0)), F.coalesce(F.max(size), F.lit(0))).first()
    _written_once(links.sparkSession, "subscribers", different, longest)
    if (subs.agg(F.sum(size)).first()[0] or 0) <= TEXT_BYTES:
        return named.repartition(tasks, *named.columns).join(F.broadcast(subs), "topic", "left")
    part = F.pmod(F.xxhash64(*named.columns), F.lit(TEXT_PARTS))
    copies = subs.withColumn("__part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(TEXT_PARTS - 1).cast("bigint"))))
    return named.withColumn("__part", part).join(copies, ["topic", "__part"], "left").drop("__part")


def _written_once(spark: SparkSession, column: str, total: int, longest: int) -> None:
    """Lets Parquet writers of the session keep the few long texts of a column in the dictionary of a file; beyond its size, 1 MB by default, each row would hold its text.

    The size is only raised, to what all different texts (total bytes) and a short one for missing ones need, TEXT_BYTES at most. Least and greatest values of over 4 kB,
    which Parquet leaves out of its footers anyway, are not looked for.
    """
    key = "parquet.dictionary.page.size"
    limit = int(spark.conf.get(key, None) or spark.sparkContext._jsc.hadoopConfiguration().get(key) or 1 << 20)
    need = total + (1 << 10)
    if need > limit:
        spark.conf.set(key, str(max(limit, min(need, TEXT_BYTES))))
    if longest > 4096:
        spark.conf.set(f"parquet.column.statistics.enabled#{column}", "false")


def span_labels(spans: DataFrame, labels: DataFrame, topics: DataFrame) -> DataFrame:
    """Label of each span: the graph's, else the raw topic of its callback, else the callback id."""
    g = labels.groupBy("cb").agg(F.min("label").alias("label"))
    t = topics.groupBy("cb").agg(F.min("topic").alias("topic"))
    return spans.join(g, "cb", "left").join(t, "cb", "left").withColumn("label", F.coalesce("label", "topic", "cb")).drop("topic")


def names_per_process(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("vpid").agg(F.array_join(F.array_sort(F.collect_set("node")), ", ").alias("nodes"))


def split_durations(spans: DataFrame, requests: DataFrame, responses: DataFrame) -> DataFrame:
    """For spans that hold a request: start to the first request, and the last response to the end."""
    a = interval_owner(requests, spans, ["vpid", "vtid"]).where("span_id IS NOT NULL").groupBy("span_id").agg(F.min("t").alias("request"))
    b = interval_owner(responses, spans, ["vpid", "vtid"]).where("span_id IS NOT NULL").groupBy("span_id").agg(F.max("t").alias("response"))
    return spans.join(a, "span_id").join(b, "span_id", "left").select("span_id", "cb", (F.col("request") - F.col("t0")).alias("to_request"), (F.col("t1") - F.col("response")).alias("from_response"))


def first_after(points: DataFrame, events: DataFrame, keys: list[str]) -> DataFrame:
    """Time from each point to the first event of its key at or after it (latency of a phase)."""
    return asof(points, events, keys, forward=True).where("r_t IS NOT NULL").withColumn("latency", F.col("r_t") - F.col("t"))
