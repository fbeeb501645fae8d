"""Scalar functions as Column expressions; nothing here runs Python per row."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Suffixes of administrative topics and services, topics that carry no data, and the copy directions by kind.
ADMIN_SUFFIXES = ["/describe_parameters", "/get_parameter_types", "/get_parameters", "/list_parameters", "/set_parameters", "/set_parameters_atomically"]
INFRA_GLOBS = [
    "/tf", "/tf_static", "/parameter_events", "/clock", "/rosout", "/service_log",
    "/*/describe_parameters", "/*/get_parameters", "/*/get_parameter_types", "/*/list_parameters", "/*/set_parameters", "/*/set_parameters_atomically",
    "/diagnostics", "/diagnostics_agg", "/diagnostics_toplevel_state", "/statistics", "/time", "/diag_agg",
    "*/debug/*", "*/processing_time_ms", "*/processing_time_detail_ms", "*/cyclic_time_ms", "*/pipeline_latency_ms", "*/_*",
]
COPY_KINDS = {1: "H2D", 2: "D2H", 3: "D2D", 8: "H2H"}


def payload(column: Column | str, key: str) -> Column:
    """Text field of a JSON payload."""
    return F.get_json_object(column, f"$.{key}")


def has_key(column: Column, key: str) -> Column:
    return F.coalesce(F.array_contains(F.json_object_keys(column), key), F.lit(False))


def glob_regex(globs: list[str]) -> str:
    """One anchored expression for shell globs in which * also matches '/'."""
    return "^(?:" + "|".join(re.escape(g).replace(r"\*", ".*").replace(r"\?", ".") for g in globs) + ")$"


def is_admin_name(name: Column, skip_parameter_services: bool = False) -> Column:
    """Whether a name is administrative: with the switch, the parameter topic and any administrative suffix; without it nothing is."""
    if not skip_parameter_services:
        return F.lit(False)
    hit = reduce(lambda a, s: a | name.endswith(s), ADMIN_SUFFIXES, name == "/parameter_events")
    return F.coalesce(hit, F.lit(False))


def topic_class(name: Column, globs: list[str] = INFRA_GLOBS) -> Column:
    """'infra' where any glob matches, else 'data'; empty and null are data."""
    return F.when(name.rlike(glob_regex(globs)), "infra").otherwise("data")


def glob_filter(name: Column, spec: str) -> Column:
    """Comma list of globs; a leading '-' excludes and wins; '', '/' or only exclusions mean all others."""
    parts = [p.strip() for p in spec.split(",") if p.strip() not in ("", "/")]
    keep, drop = [p for p in parts if p[0] != "-"], [p[1:] for p in parts if p[0] == "-"]
    out = name.rlike(glob_regex(keep)) if keep else F.lit(True)
    return out & ~name.rlike(glob_regex(drop)) if drop else out


def edge_class(nature: Column, topic: Column, globs: list[str] = INFRA_GLOBS) -> Column:
    return F.when(nature == "join", "data").when(nature == "state", "state").otherwise(topic_class(topic, globs))


def short_kernel(name: Column, depth: int = 8) -> Column:
    """Kernel name without template arguments, return type and parameters; the last three scopes, else the first 60 characters."""
    out = name
    for _ in range(depth):
        out = F.regexp_replace(out, "<[^<>]*>", "")
    out = F.trim(F.regexp_replace(F.regexp_replace(out, r"\(.*$", ""), r"^.*\s", ""))
    parts = F.split(out, "::")
    short = F.concat_ws("::", F.slice(parts, F.greatest(F.size(parts) - 2, F.lit(1)), 3))
    return F.when(short == "", F.substring(name, 1, 60)).otherwise(short)


def _bound_path(text: Column) -> Column:
    """The scopes of what a bind closure of a void function holds, as an array; null without such a closure."""
    opening = "_Bind<void ("
    path = F.regexp_extract(F.substring_index(text, opening, -1), "^[*]?([0-9A-Za-z_:]*)", 1)
    return F.when(text.contains(opening), F.filter(F.split(path, "::"), lambda p: p != ""))


def short_symbol(symbol: Column) -> Column:
    """A callback's symbol in short: parameter services by operation, the forms of the time source, filters by message, bound methods by
    class and message (timers without one), transform listeners; anything else over 60 characters as '...' and its last 57."""
    found = lambda pattern, other: F.coalesce(F.nullif(F.regexp_extract(symbol, pattern, 1), F.lit("")), F.lit(other))
    opening = "_Bind<void ("
    run = F.regexp_extract(F.substring_index(symbol, opening, -1), "^([0-9A-Za-z_:]*)", 1)  # up to the last scope it names the class
    owner = F.when(symbol.contains(opening) & run.contains("::"), F.regexp_replace(run, "::[0-9A-Za-z_]*$", ""))
    message = found("(?:msg|srv)::([0-9A-Za-z_]+?)_?<", "")
    return (
        F.when(symbol.isNull() | symbol.isin("", "?"), symbol)
        .when(symbol.contains("ParameterService"), F.concat(F.lit("ParameterService::"), found("srv::([0-9A-Za-z_]+?)_Re(?:quest|sponse)", "op")))
        .when(symbol.contains("TimeSource"), F.when(symbol.contains("clock_sub"), "TimeSource::clock_sub").when(symbol.contains("ParameterEvent"), "TimeSource::param_event").otherwise("TimeSource::cb"))
        .when(symbol.contains("message_filters::Subscriber"), F.concat(F.lit("msg_filter::Sub<"), found("Subscriber<([0-9A-Za-z_]+::msg::[0-9A-Za-z_]+)", "?"), F.lit(">")))
        .when(F.coalesce(owner, F.lit("")) != "", F.concat(owner, F.when(F.rtrim(symbol).endswith("()>"), "::timer_cb").when(message != "", F.concat(F.lit("::cb("), message, F.lit(")"))).otherwise("::cb")))
        .when(symbol.contains("TransformListener"), "tf2::TransformListener::cb")
        .when(F.length(symbol) > 60, F.concat(F.lit("..."), F.substring(symbol, -57, 57))).otherwise(symbol)
    )


#: Parts of labels and what they are shortened to.
LABELS = [
    ("rclcpp::TimeSource", "TimeSource::attachNode"), ("rclcpp_components::ComponentManager", "ComponentManager::*"), ("negotiated::NegotiatedSubscription", "NegotiatedSubscription::*"),
    ("negotiated::NegotiatedPublisher", "NegotiatedPublisher::*"), ("ros2component.api", "ros2cli::list_nodes"), ("ROSTopicHz", "ros2topic.hz"),
]


def short_label(label: Column) -> Column:
    """Label of a function in a drawing: external topics, waitables, bound methods as class::method, known parts by name, else the first 60 characters."""
    path = _bound_path(label)
    known = F.coalesce(*[F.when(label.contains(part), text) for part, text in LABELS], F.substring(label, 1, 60))
    return (
        F.when(F.coalesce(label, F.lit("")) == "", "?").when(label.startswith("ext:"), F.substring(label, 5, 60)).when(label.contains("waitable@"), label)
        .when(F.coalesce(F.size(path), F.lit(0)) >= 2, F.concat_ws("::", F.slice(path, -2, 2))).otherwise(known)
    )


def filter_edges(topic: Column, spec: str) -> Column:
    """Whether an edge's topic passes a glob list; edges without a topic count as the empty name."""
    return glob_filter(F.coalesce(topic, F.lit("")), spec)


def entity_label(kind: Column, name: Column) -> Column:
    """timer_{period}ns for timers, waitable@ and the last six digits for waitables, else the name."""
    return F.when(kind == "tmr", F.concat(F.lit("timer_"), name, F.lit("ns"))).when(kind == "waitable", F.concat(F.lit("waitable@"), F.substring(name, -6, 6))).otherwise(name)


def short_topic(topic: Column) -> Column:
    """Last segment, 20 characters at most; action topics as action.role."""
    action = F.regexp_extract(topic, r"([^/]+)/_action/([^/]+)$", 1)
    role = F.regexp_extract(topic, r"([^/]+)/_action/([^/]+)$", 2)
    return F.when(action != "", F.concat_ws(".", action, role)).otherwise(F.substring(F.element_at(F.split(topic, "/"), -1), 1, 20))


def namespace(full: Column, depth: int) -> Column:
    """The segments before the last, cut at depth; '/' at the root."""
    parts = F.filter(F.split(full, "/"), lambda p: p != "")
    cut = F.slice(parts, 1, F.least(F.lit(depth), F.greatest(F.size(parts) - 1, F.lit(0))))
    return F.concat(F.lit("/"), F.concat_ws("/", cut))


def component(full: Column, depth: int, external: Column | None = None, viewers: list[str] = ("/rviz*", "/foxglove*")) -> Column:
    out = F.when(full.rlike(glob_regex(list(viewers))), "/viz").otherwise(namespace(full, depth))
    return F.when(external, F.lit(None).cast("string")).otherwise(out) if external is not None else out


def timer_period(label: Column) -> Column:
    return F.nullif(F.regexp_extract(label, "timer_([0-9]+)ns", 1), F.lit("")).cast("bigint")


def round_nice(ns: Column) -> Column:
    """Snap a period to a grid that grows with it: 50 ms from 1 s, 10 ms from 100 ms, 1 ms from 10 ms, 1 us from 100 us, else 100 ns (half to even)."""
    to = lambda grid: (F.bround(ns / grid) * grid).cast("bigint")
    return F.when(ns >= 1_000_000_000, to(50_000_000)).when(ns >= 100_000_000, to(10_000_000)).when(ns >= 10_000_000, to(1_000_000)).when(ns >= 100_000, to(1_000)).otherwise(to(100))


def decode_pid(global_pid: Column) -> Column:
    return F.shiftright(global_pid, 24).bitwiseAND(F.lit(0xFFFFFF))


def decode_tid(global_tid: Column) -> Column:
    return global_tid.bitwiseAND(F.lit(0xFFFFFF))


def to_ms(v: Column) -> Column:
    """Milliseconds of a time in ns, us or ms, told apart by size."""
    return F.when(v > 1e15, (v / 1_000_000).cast("bigint")).when(v > 1e12, (v / 1_000).cast("bigint")).otherwise(v.cast("bigint"))


def trace_id(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 32)


def span_id(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)


def copy_direction(kind: Column) -> Column:
    out = F.concat(F.lit("k"), kind.cast("string"))
    return reduce(lambda o, kv: F.when(kind == kv[0], kv[1]).otherwise(o), COPY_KINDS.items(), out)


def action_name(label: Column) -> Column:
    """The action of a topic or service name, null for others."""
    return F.nullif(F.regexp_extract(label, r"^(.*)/_action/[^/]+$", 1), F.lit(""))


def action_role(label: Column) -> Column:
    """goal, cancel, result, feedback or status."""
    last = F.regexp_extract(label, r"/_action/([^/]+)$", 1)
    return F.when(last.startswith("send_goal"), "goal").when(last.startswith("cancel_goal"), "cancel").when(last.startswith("get_result"), "result").otherwise(F.nullif(last, F.lit("")))


def node_full_name(space: Column, name: Column) -> Column:
    return F.concat(F.rtrim(space, F.lit("/")), F.lit("/"), name)


def is_sync_api(name: Column) -> Column:
    return name.rlike("Synchronize|EventQuery|StreamWaitEvent")


def is_async_copy(name: Column) -> Column:
    return name.contains("Memcpy") & name.contains("Async")


def throughput(size: Column, ns: Column) -> Column:
    """Bytes per second; null where no time passed."""
    return size / (F.nullif(ns, F.lit(0)) / F.lit(1e9))


def _fixed(x: Column, places: int) -> Column:
    """A double with so many places; its exact binary value is rounded, ties to even (format_string rounds the shortest decimal text)."""
    return F.call_function("format_number", x, F.lit("0." + "0" * places))


def fmt_ns(ns: Column) -> Column:
    f = lambda unit, by: F.concat(_fixed(ns.cast("double") / by, 2), F.lit(f" {unit}"))
    return F.when(ns >= 1_000_000_000, f("s", 1e9)).when(ns >= 1_000_000, f("ms", 1e6)).when(ns >= 1_000, f("us", 1e3)).otherwise(F.concat(ns.cast("string"), F.lit(" ns")))


def human_bytes(n: Column, largest: str = "GiB") -> Column:
    """Bytes in the largest unit that they fill, up to `largest`."""
    units = ["KiB", "MiB", "GiB"]
    text = F.concat(n.cast("string"), F.lit(" B"))
    for power, unit in enumerate(units[: units.index(largest) + 1], 1):
        text = F.when(n >= 1 << 10 * power, F.concat(_fixed(n.cast("double") / float(1 << 10 * power), 1), F.lit(f" {unit}"))).otherwise(text)
    return text


def resolve_placeholders(template: Column, properties: Column) -> Column:
    """{key} replaced by properties[key]; null if one is missing."""
    filled = F.aggregate(F.map_entries(properties), template, lambda t, kv: F.replace(t, F.concat(F.lit("{"), kv["key"], F.lit("}")), kv["value"]))
    return F.when(~filled.rlike(r"\{[^{}]+\}"), filled)


def safe_id(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "[^0-9A-Za-z]+", "_"), F.lit("_"))
