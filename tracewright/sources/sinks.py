"""Writers: sessions, graphs, spans and catalogues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.functions.scalars import decode_pid, span_id, trace_id
from tracewright.operators.scale import written

BUCKET_NS = 300_000_000_000


def write_events(events: DataFrame, path: str, replace: bool = False, bucket_ns: int = BUCKET_NS) -> None:
    """Trace events partitioned by session and time bucket (five minutes by default). replace overwrites only the sessions at hand."""
    rows = events.withColumn("bucket", F.expr(f"ts_ns div {bucket_ns}"))
    writer = rows.repartition("session_id", "bucket").write.partitionBy("session_id", "bucket").option("maxRecordsPerFile", 5_000_000)
    (writer.mode("overwrite").option("partitionOverwriteMode", "dynamic") if replace else writer.mode("append")).parquet(path)


def ingest_events(events: DataFrame, path: str, log: str, force: bool = False, bucket_ns: int = BUCKET_NS) -> DataFrame:
    """Write the sessions of events that path does not have yet (with force: all, in place of old ones) and append their counts and event rates to log.

    Returns the log rows written: session_id, events, span_ns, per_second.
    """
    spark = events.sparkSession
    if not force and path_exists(spark, path):
        events = events.join(spark.read.parquet(path).select("session_id").distinct(), "session_id", "left_anti")
    n = events.groupBy("session_id").agg(F.count(F.lit(1)).alias("events"), (F.max("ts_ns") - F.min("ts_ns")).alias("span_ns"))
    n = written(n.withColumn("per_second", F.round(F.col("events") / (F.nullif("span_ns", F.lit(0)) / F.lit(1e9)), 6)), "ingested")
    write_events(events, path, force, bucket_ns)
    n.write.mode("append").parquet(log)
    return n


def path_exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return False
        raise
    return True


def session_exists(spark: SparkSession, path: str, session_id: str) -> bool:
    return path_exists(spark, path) and spark.read.parquet(path).where(F.col("session_id") == session_id).limit(1).count() > 0


def without_session(df: DataFrame, session_id: str) -> DataFrame:
    """All rows but those of a session; apply it to each table for a cascade."""
    return df.where(F.col("session_id") != session_id)


def delete_session(spark: SparkSession, tables: dict[str, str], session_id: str, out: str) -> dict[str, str]:
    """Every table (name -> path) without a session, written beside the old ones under out; returns the new paths."""
    paths = {}
    for name, path in tables.items():
        paths[name] = f"{out}/{name}"
        without_session(spark.read.parquet(path), session_id).write.parquet(paths[name])
    return paths


def replace_table(df: DataFrame, path: str, *keys: str) -> None:
    """Write a table partitioned by keys, in place of the partitions that df holds; others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def save_graph(vertices: DataFrame, edges: DataFrame, session_id: str, scope: str, path: str, replace: bool = False, actor: str = "") -> None:
    """Vertices and edges of one scope of a session; edges are unique by (src, dst, rel), the least row of each stays. An existing scope fails unless replaced.

    Counts of both and the kind of change are appended to the log of mutations.
    """
    keys = {"session_id": F.lit(session_id), "scope": F.lit(scope)}
    spark = vertices.sparkSession
    if not replace and graph_exists(spark, path, session_id, scope):
        raise ValueError(f"graph {session_id}/{scope} exists")
    by = [c for c in ("src", "dst", "rel") if c in edges.columns]
    rest = [c for c in edges.columns if c not in by]
    edges = written(edges.groupBy(*by).agg(F.min(F.struct(*rest)).alias("r")).select(*by, "r.*") if rest else edges.distinct(), "edges")
    for name, df in (("vertices", vertices), ("edges", edges)):
        df.withColumns(keys).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("session_id", "scope").parquet(f"{path}/{name}")
    meta = vertices.agg(F.count(F.lit(1)).alias("vertices")).withColumn("edges", F.lit(edges.count())).withColumns({"op": F.lit("replace" if replace else "save"), "actor": F.lit(actor)}).withColumns(keys)
    meta.write.mode("append").parquet(f"{path}/mutations")


def graph_exists(spark: SparkSession, path: str, session_id: str, scope: str) -> bool:
    try:
        rows = spark.read.parquet(f"{path}/vertices")
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e):
            return False
        raise
    return rows.where((F.col("session_id") == session_id) & (F.col("scope") == scope)).limit(1).count() > 0


def load_graph(spark: SparkSession, path: str, session_id: str, scope: str) -> tuple[DataFrame, DataFrame]:
    at = (F.col("session_id") == session_id) & (F.col("scope") == scope)
    return tuple(spark.read.parquet(f"{path}/{n}").where(at).drop("session_id", "scope") for n in ("vertices", "edges"))


def list_graphs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/vertices").groupBy("session_id", "scope").agg(F.count(F.lit(1)).alias("vertices"))


def list_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Sessions that have a graph, with their scopes and vertices; the latest by id first."""
    per = spark.read.parquet(f"{path}/vertices").groupBy("session_id").agg(F.count_distinct("scope").alias("scopes"), F.count(F.lit(1)).alias("vertices"))
    return per.orderBy(F.col("session_id").desc())


def graph_json(rows: DataFrame, attributes: str = "attrs") -> DataFrame:
    """One JSON text per row; a map of attributes is lifted to the top level, columns win over attributes of the same name."""
    plain = [c for c in rows.columns if c != attributes]
    own = F.map_filter(F.create_map(*[x for c in plain for x in (F.lit(c), F.col(c).cast("string"))]), lambda k, v: v.isNotNull())
    rest = F.map_filter(F.col(attributes), lambda k, v: v.isNotNull() & ~F.array_contains(F.map_keys(own), k))
    return rows.select(F.to_json(F.map_concat(own, rest)).alias("value"))


def export_spans(spans: DataFrame, nodes: DataFrame, session_id: str, shift_ns: int = 0) -> DataFrame:
    """Spans for a trace store: deterministic ids, one resource per process and node, times shifted."""
    out = spans.join(nodes.groupBy("vpid").agg(F.min("node").alias("node")), "vpid", "left").withColumn("node", F.coalesce("node", F.lit("(unknown)")))
    return out.select(
        trace_id(F.lit(session_id), F.col("vpid").cast("string")).alias("trace_id"), span_id(F.lit(session_id), F.col("span_id").cast("string")).alias("span"),
        F.concat_ws("/", F.col("vpid").cast("string"), "node").alias("resource"), F.col("cb").alias("name"), (F.col("t0") + shift_ns).alias("start_ns"), (F.col("t1") + shift_ns).alias("end_ns"),
    )


def write_span_batches(exported: DataFrame, path: str, batch: int = 1000) -> None:
    """Exported spans as JSON lines, one folder per trace, at most `batch` spans in a file."""
    exported.repartition("trace_id").sortWithinPartitions("trace_id", "start_ns", "span").write.option("maxRecordsPerFile", batch).partitionBy("trace_id").json(path)


def kernel_catalog(kernels: DataFrame) -> DataFrame:
    """Least launch dimensions, registers and shared memory of each kernel name."""
    cols = [c for c in kernels.columns if c.startswith(("grid_", "block_", "registers", "static_smem", "dynamic_smem"))]
    return kernels.groupBy("kernel_name").agg(*[F.min(c).alias(c) for c in cols], F.count(F.lit(1)).alias("launches"))


def kernel_streams(kernels: DataFrame) -> DataFrame:
    return kernels.select("kernel_name", "stream_id").distinct()


def stream_owner(kernels: DataFrame) -> DataFrame:
    return kernels.select("stream_id", decode_pid(F.col("global_pid")).alias("pid")).distinct()


def promote(rows: DataFrame, known: list[str], attributes: str = "attrs") -> DataFrame:
    """Known attributes as columns, the other non-null ones stay in the map."""
    wanted = F.array(*[F.lit(k) for k in known])
    rest = F.map_filter(F.col(attributes), lambda k, v: v.isNotNull() & ~F.array_contains(wanted, k))
    return rows.select(*[c for c in rows.columns if c != attributes], *[F.try_element_at(attributes, F.lit(k)).alias(k) for k in known], rest.alias(attributes))
