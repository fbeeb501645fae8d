"""Readers of trace text, activity exports and snapshots; every parser is a set of native columns over spark.read.text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.operators.scale import written

#: Fixed form of a trace line: [HH:MM:SS.nnnnnnnnn] (+d) host event: { cpu }, { proc }, { payload }.
LINE = r"^\[(\d{2}):(\d{2}):(\d{2})\.(\d{9})\] \([^)]*\) (\S+) ([^:\s]+:?[^:\s]*): \{([^}]*)\}, \{([^}]*)\}(?:, \{(.*)\})?\s*$"
PAIR = r'(\w+)\s*=\s*("(?:[^"\\]|\\.)*"|\[(?:[^\[\]]|\[\d+\])*\]|[^,{}\[\]]+)'
DAY = 86_400_000_000_000


def lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their file and place in it."""
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"))


def named(text: Column, key: str, value: str) -> Column:
    """The value of one `key = value` pair, null without it."""
    return F.nullif(F.regexp_extract(text, rf"(?:^|[ ,]){key}\s*=\s*{value}", 1), F.lit(""))


def fields(text: Column) -> Column:
    """Map of the `key = value` pairs of a payload: quotes go, blanks go; arrays keep their elements joined by commas and win over scalars of the same key."""
    pairs = F.transform(F.regexp_extract_all(text, F.lit(PAIR), F.lit(0)), lambda p: F.struct(F.trim(F.substring_index(p, "=", 1)).alias("key"), F.trim(F.substr(p, F.locate("=", p) + 1)).alias("value")))
    is_array = lambda p: p["value"].startswith("[")
    clean = lambda v: F.when(v.startswith('"'), F.substring(v, 2, F.length(v) - 2)).when(v.startswith("["), F.regexp_replace(v, r"\[\d+\]\s*=|[\[\]\s]", "")).otherwise(v)
    once = lambda ps: F.map_from_entries(F.transform(ps, lambda p: F.struct(p["key"], clean(p["value"]))))

    def first_of_each(ps: Column) -> Column:
        ordered = F.concat(F.filter(ps, is_array), F.filter(ps, lambda p: ~is_array(p)))
        return F.aggregate(ordered, F.array().cast("array<struct<key:string,value:string>>"), lambda acc, p: F.when(F.exists(acc, lambda a: a["key"] == p["key"]), acc).otherwise(F.concat(acc, F.array(p))))

    distinct = lambda ps: F.size(F.array_distinct(F.transform(ps, lambda p: p["key"]))) == F.size(ps)
    # The pairs are bound once by a one-element transform, so the expression is not matched again for each use.
    return F.transform(F.array(pairs), lambda ps: once(F.when(distinct(ps), ps).otherwise(first_of_each(ps))))[0]


#: Lines of a file that one task looks at for midnights.
CHUNK_LINES = 1_000_000


def _midnights(times: DataFrame) -> DataFrame:
    """(file, turns): the sorted places where the time of day falls by more than 12 hours. times: file, at, tod.

    Files are cut into chunks of lines; the border of two chunks is seen from the last time of the earlier one, so a large file is the work of many tasks.
    """
    falls = lambda before: before - F.col("tod") > DAY // 2
    rows = times.withColumn("chunk", F.expr(f"at div {CHUNK_LINES}"))
    inside = rows.withColumn("before", F.lag("tod").over(Window.partitionBy("file", "chunk").orderBy("at"))).where(falls(F.col("before"))).select("file", "at")
    ends = rows.groupBy("file", "chunk").agg(F.min(F.struct("at", "tod")).alias("first"), F.max(F.struct("at", "tod")).alias("last"))
    border = ends.withColumn("before", F.lag("last.tod").over(Window.partitionBy("file").orderBy("chunk"))).select("file", "first.at", "first.tod", "before").where(falls(F.col("before"))).select("file", "at")
    return inside.unionByName(border).groupBy("file").agg(F.array_sort(F.collect_list("at")).alias("turns"))


def parse_trace(text: DataFrame, session_id: str, date: str, zone: str = "UTC") -> DataFrame:
    """Trace events of lines (value, file, at); lines of another form are dropped.

    Times are times of day; where one falls by more than 12 hours in file order, a day is added to the rest of the file. A first pass
    over the times alone finds these places (a few per file); the events themselves are parsed without a shuffle, each line matched once.
    """
    cells = F.split(F.regexp_replace("value", LINE, "$1\u0001$2\u0001$3\u0001$4\u0001$5\u0001$6\u0001$7\u0001$8\u0001$9"), "\u0001")
    part = lambda i: F.get("cells", F.lit(i - 1))
    tod = ((part(1).cast("bigint") * 60 + part(2).cast("bigint")) * 60 + part(3).cast("bigint")) * 1_000_000_000 + part(4).cast("bigint")
    rows = text.where(F.col("value").startswith("[")).select("*", F.explode(F.array(cells)).alias("cells")).where(F.size("cells") == 9).withColumn("tod", tod)
    turns = written(_midnights(rows.select("file", "at", "tod")), "midnights")
    if turns.limit(1).count():
        rows = rows.join(turns, "file", "left").withColumn("days", F.coalesce(F.size(F.filter("turns", lambda t: t <= F.col("at"))), F.lit(0)))
        rows = rows.withColumn("days", F.greatest("days", F.lit(0)))
    else:
        rows = rows.withColumn("days", F.lit(0))
    start = F.unix_micros(F.to_utc_timestamp(F.lit(f"{date} 00:00:00").cast("timestamp_ltz"), zone)) * 1000
    return rows.select(
        F.col("at").alias("id"), F.lit(session_id).alias("session_id"), (start + F.col("tod") + F.col("days") * DAY).cast("bigint").alias("ts_ns"), part(6).alias("event"),
        named(part(7), "cpu_id", r"(\d+)").cast("smallint").alias("cpu_id"), named(part(8), "vpid", r"(-?\d+)").cast("int").alias("vpid"), named(part(8), "vtid", r"(-?\d+)").cast("int").alias("vtid"),
        part(5).alias("host_name"), named(part(8), "procname", '"([^"]*)"').alias("procname"), fields(part(9)).alias("payload"),
    )


def read_trace_text(spark: SparkSession, path: str, session_id: str, date: str, zone: str = "UTC") -> DataFrame:
    return parse_trace(lines(spark, path), session_id, date, zone)


def session_clock_offset(clock: DataFrame) -> DataFrame:
    """Session start in ns: seconds of the UTC text plus the fraction of the epoch number; else the local text in its zone; else the epoch number."""
    utc = F.unix_micros(F.to_timestamp(F.regexp_replace(F.col("utc_text"), "[TZ]", " "))) * 1000
    local = F.unix_micros(F.to_utc_timestamp(F.to_timestamp("local_text"), F.col("zone"))) * 1000
    whole = lambda ns: F.floor(ns / 1_000_000_000).cast("bigint") * 1_000_000_000
    rest = F.col("epoch_ns") % 1_000_000_000
    return clock.select("*", F.coalesce(whole(utc) + rest, whole(local) + F.coalesce(rest, F.lit(0)), F.col("epoch_ns")).alias("start_ns"))


def read_activity(rows: DataFrame, strings: DataFrame | None, session_start_ns: int, name: str | None = None) -> DataFrame:
    """Activity rows (start, end, ...) with ts_ns, duration_ns (null without an end), looked-up names and decoded ids; rows without a start go."""
    out = rows.where("start IS NOT NULL").withColumn("ts_ns", F.col("start") + F.lit(session_start_ns)).withColumn("duration_ns", F.col("end") - F.col("start"))
    if strings is not None and name:
        out = out.join(strings.select(F.col("id").alias(name), F.col("value").alias(f"{name}_text")), name, "left")
    if "global_tid" in rows.columns:
        out = out.withColumn("tid", F.col("global_tid").bitwiseAND(F.lit(0xFFFFFF)))
    if "global_pid" in rows.columns:
        out = out.withColumn("pid", F.shiftright("global_pid", 24).bitwiseAND(F.lit(0xFFFFFF)))
    return out.drop("start", "end")


#: Activity tables and the columns that only they have.
ACTIVITY_COLUMNS = {
    "kernel": ["grid_x", "grid_y", "grid_z", "block_x", "block_y", "block_z", "registers_per_thread", "static_smem_bytes", "dynamic_smem_bytes"], "memcpy": ["bytes", "copy_kind"],
    "memset": ["bytes", "value", "mem_kind"], "sync": ["sync_type", "event_id", "event_sync_id"], "runtime": ["return_value", "callchain_id", "event_class"], "overhead": ["overhead_kind"], "mem_usage": ["bytes", "address", "operation"],
}


def read_activities(kind: str, rows: DataFrame, strings: DataFrame, session_start_ns: int) -> DataFrame:
    """One activity table by kind: ts_ns, duration_ns, decoded ids, the kind's own columns (null where the export lacks them) and its name looked up by name_id."""
    out = read_activity(rows, strings if "name_id" in rows.columns else None, session_start_ns, "name_id")
    own = [F.col(c) if c in out.columns else F.lit(None).cast("bigint").alias(c) for c in ACTIVITY_COLUMNS[kind]]
    known = [c for c in ("corr", "stream", "pid", "tid") if c in out.columns]
    name = [F.col("name_id_text").alias("name")] if "name_id_text" in out.columns else []
    return out.select(F.lit(kind).alias("kind"), "ts_ns", "duration_ns", *known, *name, *own)


def static_metadata(rows: DataFrame, session_id: str, known: list[str]) -> DataFrame:
    """A static table of a session (devices, contexts, streams, environment, dictionaries): known columns typed as they come, all others as text in the map `extras`."""
    rest = [c for c in rows.columns if c not in known]
    pairs = [x for c in rest for x in (F.lit(c), F.col(c).cast("string"))]
    extras = F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull()) if pairs else F.create_map().cast("map<string,string>")
    return rows.select(F.lit(session_id).alias("session_id"), *[F.col(c) for c in known if c in rows.columns], extras.alias("extras"))


def series_of_templates(filters: DataFrame, tables: dict[str, DataFrame], most: int = 50) -> DataFrame:
    """(instance, kind, ms, value) series: each (instance, kind, table, column, filter) of telemetry_series read from its table, in order of instance; `most` series at most."""
    todo = filters.orderBy("instance", "kind", "table", "column").limit(most).collect()
    out = None
    for r in todo:
        part = query_series(tables[r["table"]].where(r["filter"]), r["column"], "ts_ns").select(F.lit(r["instance"]).alias("instance"), F.lit(r["kind"]).alias("kind"), "ms", "value")
        out = part if out is None else out.unionByName(part)
    spark = filters.sparkSession
    return out if out is not None else spark.createDataFrame([], "instance string, kind string, ms bigint, value double")


def read_callchains(frames: DataFrame, session_start_ns: int) -> DataFrame:
    """Stack frames with a symbol (else the address in hex) and a pseudo time that keeps their order."""
    return frames.select("callchain_id", "depth", F.coalesce("symbol", F.concat(F.lit("0x"), F.lower(F.hex("ip")))).alias("symbol"), (F.lit(session_start_ns) + F.col("callchain_id") * 1000 + F.col("depth")).alias("ts_ns"))


def read_ranges(rows: DataFrame, session_start_ns: int) -> DataFrame:
    return rows.select((F.col("start") + F.lit(session_start_ns)).alias("ts_ns"), (F.col("end") - F.col("start")).alias("duration_ns"), "domain", "type", "text")


def parse_process_tree(text: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Processes and threads of a table `pid ppid lwp uid user cmd...`; threads of unknown processes are dropped."""
    cells = F.split(F.trim("value"), r"\s+", 6)
    rows = text.select(*[F.get(cells, i).alias(n) for i, n in enumerate(("pid", "ppid", "lwp", "uid", "username", "cmd"))]).where(F.col("pid").rlike(r"^\d+$"))
    rows = rows.withColumns({c: F.col(c).cast("int") for c in ("pid", "ppid", "lwp", "uid")})
    processes = rows.where("pid = lwp")
    return processes, rows.where("pid <> lwp").join(processes.select("pid"), "pid", "left_semi")


def parse_node_info(text: DataFrame, column: str = "value") -> DataFrame:
    """(node, kind, name, type) of a JSON map node -> report; a report has section headers ending in ':' and entries `/name: type`."""
    node = text.select(F.explode(F.from_json(column, "map<string,string>")).alias("node", "report"))
    rows = node.select("node", F.posexplode(F.split("report", "\n")).alias("pos", "line"))
    header = F.when(F.trim("line").rlike(r"^[A-Z][A-Za-z ]+:$"), F.regexp_replace(F.trim("line"), ":$", ""))
    rows = rows.withColumn("kind", F.last(header, ignorenulls=True).over(Window.partitionBy("node").orderBy("pos")))
    cells = F.split(F.trim("line"), ": ", 2)
    return rows.where(F.trim("line").startswith("/") & F.col("kind").isNotNull()).select("node", "kind", cells[0].alias("name"), F.get(cells, 1).alias("type")).dropDuplicates(["node", "kind", "name"])


def parse_topic_info(text: DataFrame, column: str = "value") -> DataFrame:
    """Topics of a JSON map name -> {type, publisher_count, subscription_count}."""
    rows = text.select(F.explode(F.from_json(column, "map<string,struct<type:string,publisher_count:int,subscription_count:int>>")).alias("topic", "v"))
    return rows.select("topic", "v.type", "v.publisher_count", "v.subscription_count")


def parse_topic_rates(text: DataFrame, column: str = "value") -> DataFrame:
    kinds = "average_rate:double,min_period:double,max_period:double,std_dev:double,window_size:int"
    return text.select(F.explode(F.from_json(column, f"map<string,struct<{kinds}>>")).alias("topic", "v")).select("topic", "v.*")


def parse_component_list(text: DataFrame) -> DataFrame:
    """(container, idx, component): a header line names a container, indented `idx /path` lines its components; a text that begins with '#' has none."""
    w = Window.partitionBy("file").orderBy("at")
    rows = text.withColumn("container", F.last(F.when(F.col("value").rlike(r"^\S"), F.trim("value")), ignorenulls=True).over(w))
    rows = rows.where(F.col("value").rlike(r"^\s+\d+\s+/") & ~F.col("container").startswith("#"))
    return rows.select("container", F.regexp_extract("value", r"^\s+(\d+)", 1).cast("int").alias("idx"), F.regexp_extract("value", r"^\s+\d+\s+(\S+)", 1).alias("component"))


def parse_node_list(text: DataFrame) -> DataFrame:
    return text.select(F.trim("value").alias("node")).where("node <> ''").distinct()


def parse_daemon_log(text: DataFrame, session_start_ns: int) -> DataFrame:
    """Daemon actions `monotonic action name killed resurrected cmd...`; '-' is null, '#' lines are comments."""
    cells = F.split(F.trim("value"), r"\s+", 6)
    rows = text.where(~F.trim("value").startswith("#")).where(F.size(cells) >= 5)
    at = lambda i: F.nullif(F.get(cells, i), F.lit("-"))
    return rows.select((at(0).cast("bigint") + F.lit(session_start_ns)).alias("ts_ns"), at(0).cast("bigint").alias("monotonic_ns"), at(1).alias("action"), at(2).alias("process_name"), at(3).cast("int").alias("killed_pid"), at(4).cast("int").alias("resurrected_pid"), at(5).alias("cmd"))


def register(current: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """current upserted by new: a new value wins unless it is null."""
    cols = [c for c in current.columns if c != key]
    return current.alias("a").join(new.alias("b"), key, "full_outer").select(key, *[F.coalesce(f"b.{c}", f"a.{c}").alias(c) for c in cols])


def query_table(df: DataFrame, filters: list[str] = (), columns: list[str] = (), order: list[str] = (), limit: int = 50_000) -> DataFrame:
    """Filter, project (dotted names reach into structs), sort and limit."""
    out = reduce(lambda d, f: d.where(f), filters, df)
    out = out.orderBy(*[F.col(c[1:]).desc() if c.startswith("-") else F.col(c) for c in order]) if order else out
    out = out.limit(limit)
    return out.select(*[F.col(c).alias(c.replace(".", "_")) for c in columns]) if columns else out


def query_series(df: DataFrame, value: str, time: str) -> DataFrame:
    """(value, ms) points; values that are no numbers are skipped."""
    return df.select(F.col(value).try_cast("double").alias("value"), F.expr(f"{time} div 1000000").alias("ms")).where("value IS NOT NULL")


def executor_events(events: DataFrame, vpid: int, prefix: str, limit: int = 50_000) -> DataFrame:
    return events.where((F.col("vpid") == vpid) & F.col("event").startswith(prefix)).orderBy("ts_ns", "id").limit(limit)


def telemetry_series(templates: DataFrame, instances: DataFrame) -> DataFrame:
    """Filter texts of every template for every instance of its kind; templates with a missing placeholder are skipped."""
    from tracewright.functions.scalars import resolve_placeholders

    both = templates.join(instances, "kind").withColumn("filter", resolve_placeholders(F.col("template"), F.col("properties")))
    return both.where("filter IS NOT NULL").select("instance", "kind", "table", "column", "filter")
