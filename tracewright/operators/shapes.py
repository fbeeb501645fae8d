"""Typed call graphs per invocation, their shapes, and what sequences of calls have in common.

Calls: (inv, pos, token, stream, cost); pos is 1, 2, ... in time order inside an invocation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions.scalars import copy_direction
from tracewright.operators.scale import running_sum, written
from tracewright.operators.stats import medians
from tracewright.shipping import ship_package


def correlated(calls: DataFrame, activity: DataFrame) -> DataFrame:
    """Calls (inv, pos, token, corr, cost) with the processing element, name and stream of the activity they started: kernel before copy before fill.

    activity: corr, kind (kernel, memcpy, memset), stream, name (of kernels), copy_kind, bytes, duration. Kernels and fills run on SM, copies on CE.
    """
    rank = F.when(F.col("kind") == "kernel", 0).when(F.col("kind") == "memcpy", 1).otherwise(2)
    best = activity.groupBy("corr").agg(F.min_by(F.struct("kind", "stream", "name", "copy_kind", "bytes", "duration"), F.struct(rank, "stream", "name")).alias("a"))
    kind = F.col("a.kind")
    name = F.when(kind == "kernel", F.coalesce("a.name", F.lit("<anon>"))).when(kind == "memcpy", F.concat(F.lit("memcpy_"), copy_direction(F.coalesce("a.copy_kind", F.lit(0))))).when(kind == "memset", "memset_fill")
    pe = F.when(kind == "memcpy", "CE").when(kind.isNotNull(), "SM")
    return calls.join(best, "corr", "left").select(*calls.columns, pe.alias("gpu_pe"), name.alias("gpu_name"), F.when(kind.isNotNull(), F.coalesce("a.stream", F.lit(0))).alias("stream"), F.col("a.bytes").alias("bytes"), F.col("a.duration").alias("duration"))


def typed_dag(calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (inv, idx, pe, name, stream) and edges (inv, src, dst, kind) of each invocation.

    Every call is a CPU node; a call with a stream also launches an accelerator node right after it, of the element and name that
    correlated() gives (SM and the call's token without these columns). Edges: cpu_order along the CPU nodes, launch from a call to its
    node, stream_fifo along a stream.
    """
    pe, name = (F.col(c) if c in calls.columns else F.lit(d) for c, d in (("gpu_pe", "SM"), ("gpu_name", None)))
    cpu = F.struct(F.lit(0).alias("o"), F.lit("CPU").alias("pe"), F.col("token").alias("name"))
    gpu = F.struct(F.lit(1).alias("o"), pe.alias("pe"), F.coalesce(name, F.col("token")).alias("name"))
    both = calls.select("inv", "pos", "stream", F.explode(F.when(F.col("stream").isNull(), F.array(cpu)).otherwise(F.array(cpu, gpu))).alias("x")).select("inv", "pos", "stream", "x.*")
    nodes = both.withColumn("idx", F.row_number().over(Window.partitionBy("inv").orderBy("pos", "o")) - 1).select("inv", "idx", "pe", "name", F.when(F.col("o") == 1, F.col("stream")).alias("stream"), "o")
    before = F.lag("idx").over(Window.partitionBy("inv", "o", "stream").orderBy("idx"))  # CPU nodes have no stream
    edge = lambda src, kind: F.struct(src.alias("src"), F.col("idx").alias("dst"), F.lit(kind).alias("kind"))
    own, near = F.col("idx") - 1, F.col("before")
    pairs = F.when(F.col("o") == 0, F.array(edge(near, "cpu_order"))).otherwise(F.array(edge(own, "launch"), edge(near, "stream_fifo")))
    edges = nodes.withColumn("before", before).select("inv", F.explode(pairs).alias("x")).select("inv", "x.*").where("src IS NOT NULL")  # all kinds in one pass
    return nodes.drop("o"), edges


def dag_signature(nodes: DataFrame, edges: DataFrame, digits: int = 16) -> DataFrame:
    """inv, sig: a hash of the ordered (element, name) pairs and the sorted edges of each graph."""
    listed = lambda df, item, *by: df.groupBy("inv").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*by, item.alias("t")))), lambda x: x["t"]), ",").alias("t"))
    a = listed(nodes, F.concat_ws(":", "pe", "name"), "idx").withColumnRenamed("t", "nodes")
    b = listed(edges, F.concat_ws("-", "src", "dst", "kind"), "src", "dst", "kind").withColumnRenamed("t", "edges")
    return a.join(b, "inv", "left").select("inv", F.substring(F.sha1(F.concat("nodes", F.lit("|"), F.coalesce("edges", F.lit("")))), 1, digits).alias("sig"))


def invocations_by_owner(calls: DataFrame, attributed: DataFrame) -> DataFrame:
    """Calls grouped by the span that owns them: inv (span), pos (1, 2, ... in time), corr, token. calls: corr, t, token; attributed: corr, span_id."""
    own = calls.join(attributed.where("span_id IS NOT NULL").select("corr", F.col("span_id").alias("inv")), "corr")
    return own.withColumn("pos", F.row_number().over(Window.partitionBy("inv").orderBy("t", "corr")))


def sequences(calls: DataFrame, cut: int = 20) -> DataFrame:
    """Token list of each invocation in order, long names cut, with its signature (16 hex digits)."""
    listed = calls.groupBy("inv").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "token", "stream", "cost"))), lambda x: F.struct(F.substring(x["token"], 1, cut).alias("token"), x["stream"].alias("stream"), x["cost"].alias("cost"))).alias("rows"))
    tokens = F.transform("rows", lambda r: r["token"])
    return listed.select("inv", tokens.alias("tokens"), F.size("rows").alias("n"), F.substring(F.sha1(F.array_join(tokens, ",")), 1, 16).alias("sig"), F.array_size(F.array_distinct(F.transform("rows", lambda r: r["stream"]))).alias("streams"))


def node_sequences(nodes: DataFrame, cut: int = 20) -> DataFrame:
    """inv, cpu, every: the names of the CPU nodes, and of all nodes, in order; accelerator names are cut."""
    name = F.when(F.col("pe") == "CPU", F.col("name")).otherwise(F.substring("name", 1, cut))
    rows = nodes.groupBy("inv").agg(F.array_sort(F.collect_list(F.struct("idx", "pe", name.alias("name")))).alias("rows"))
    return rows.select("inv", F.transform(F.filter("rows", lambda r: r["pe"] == "CPU"), lambda r: r["name"]).alias("cpu"), F.transform("rows", lambda r: r["name"]).alias("every"))


def shape_table(seqs: DataFrame) -> DataFrame:
    """Invocations per signature, with the first invocation as template."""
    return seqs.groupBy("sig").agg(F.count(F.lit(1)).alias("invocations"), F.min("inv").alias("template"), F.max("n").alias("n"), F.array_join(F.min_by("tokens", "inv"), ",").alias("tokens"))


def shape_mix(shapes: DataFrame, nodes: DataFrame) -> DataFrame:
    """Per key and signature: count, nodes by element of the first invocation, sorted streams of all its invocations, and beside them the key's invocations and
    number of streams. shapes: key, inv, sig, t0; nodes: inv, pe, stream."""
    n = lambda pe: F.count(F.when(F.col("pe") == pe, 1)).alias(f"n_{pe.lower()}")
    mix = nodes.groupBy("inv").agg(n("CPU"), n("SM"), n("CE"))
    per = shapes.groupBy("key", "sig").agg(F.count(F.lit(1)).alias("count"), F.min_by("inv", F.struct("t0", "inv")).alias("inv"))
    used = shapes.join(nodes.where("stream IS NOT NULL").select("inv", "stream").distinct(), "inv").select("key", "sig", "stream").distinct()
    streams = used.groupBy("key", "sig").agg(F.array_join(F.transform(F.array_sort(F.collect_list("stream")), lambda x: x.cast("string")), ",").alias("streams"))
    whole = shapes.groupBy("key").agg(F.count(F.lit(1)).alias("invocations"))
    many = used.groupBy("key").agg(F.count_distinct("stream").alias("key_streams"))
    out = per.join(mix, "inv").drop("inv").join(streams, ["key", "sig"], "left").join(whole, "key").join(many, "key", "left")
    return out.na.fill("", ["streams"]).na.fill(0, ["key_streams"])


def shape_cost_bounds(calls: DataFrame, seqs: DataFrame) -> DataFrame:
    """Least and largest cost at each position of each shape."""
    return calls.join(seqs.select("inv", "sig"), "inv").groupBy("sig", "pos").agg(F.min("cost").alias("c_min"), F.max("cost").alias("c_max"), F.count(F.lit(1)).alias("n"))


def shape_features(calls: DataFrame, top_k: int = 20) -> DataFrame:
    """Counts per invocation: calls, streams, and one column for each of the most frequent tokens."""
    words = [r["token"] for r in calls.groupBy("token").count().orderBy(F.col("count").desc(), "token").limit(top_k).collect()]
    return calls.groupBy("inv").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("stream").alias("streams"), *[F.sum((F.col("token") == w).cast("int")).alias(f"t_{w}") for w in words])


def dag_features(nodes: DataFrame, edges: DataFrame, top_k: int = 20) -> DataFrame:
    """Thirteen counts per graph (nodes by element, edges by kind, copies by direction, streams, depth and branching) and the most frequent CPU names."""
    n = lambda c: F.count(F.when(c, 1))
    pe, name = F.col("pe"), F.col("name")
    words = [r["name"] for r in nodes.where("pe = 'CPU'").groupBy("name").count().orderBy(F.col("count").desc(), "name").limit(top_k).collect()]
    copy = (pe == "CE") & name.startswith("memcpy_")
    a = nodes.groupBy("inv").agg(
        n(pe == "CPU").alias("n_cpu"), n(pe == "SM").alias("n_sm"), n(pe == "CE").alias("n_ce"), F.count(F.lit(1)).alias("total"),
        n(copy & (name == "memcpy_H2D")).alias("h2d"), n(copy & (name == "memcpy_D2H")).alias("d2h"), n(copy & ~name.isin("memcpy_H2D", "memcpy_D2H")).alias("other_copies"),
        F.count_distinct("stream").alias("n_streams"), *[n((pe == "CPU") & (name == w)).alias(f"t_{w}") for w in words],
    )
    kind = F.col("kind")
    by_source = edges.groupBy("inv", "src").agg(n(kind == "launch").alias("l"), n(kind == "stream_fifo").alias("f"), n(kind == "cpu_order").alias("c"))
    b = by_source.groupBy("inv").agg(F.sum("l").alias("e_launch"), F.sum("f").alias("e_fifo"), F.sum("c").alias("e_order"), F.sum("c").alias("depth"), F.max("l").alias("branch"))
    return a.join(b, "inv", "left").na.fill(0)


#: Calls that tell the start of a program: (part of the name, number from which it counts or None for each, weight).
INIT_SIGNALS = [
    ("cuInit", 1, 100), ("cuLibraryLoadData", 1, 100), ("cuDevicePrimaryCtxRetain", 1, 100), ("cuCtxCreate", 1, 100), ("cudaGetDeviceProperties", 1, 20), ("cuModuleGetLoadingMode", 1, 20),
    ("cuModuleLoadFatBinary", 1, 10), ("cuLibraryUnload", 1, 10), ("cuGetProcAddress", 100, 50), ("cudaMalloc", None, 5), ("cudaStreamCreate", None, 3), ("cudaEventCreate", None, 1), ("cudaEventCreateWithFlags", None, 1),
]


def signal_score(names: Column, signals: list[tuple[str, int | None, int]] = INIT_SIGNALS) -> Column:
    """Sum of weights: per occurrence, or once where a name part occurs often enough."""
    count = lambda t: F.size(F.filter(names, lambda n: n.contains(t)))
    parts = [count(t) * w if least is None else F.when(count(t) >= least, w).otherwise(0) for t, least, w in signals]
    return sum(parts[1:], parts[0])


def shape_stats(nodes: DataFrame, shapes: DataFrame, signals: list[tuple[str, int | None, int]] = INIT_SIGNALS) -> DataFrame:
    """Per key and signature: invocations, first and last time, and of its first invocation the nodes by element, copies by direction, and init score.

    shapes: key, inv, sig, t0, t1.
    """
    per = shapes.groupBy("key", "sig").agg(F.count(F.lit(1)).alias("count"), F.min("t0").alias("first_t"), F.max("t1").alias("last_t"), F.min_by("inv", F.struct("t0", "inv")).alias("inv"))
    n = lambda c: F.count(F.when(c, 1))
    pe, name = F.col("pe"), F.col("name")
    of = nodes.join(per.select("inv").distinct(), "inv", "left_semi").groupBy("inv").agg(
        n(pe == "CPU").alias("n_cpu"), n(pe == "SM").alias("n_sm"), n(pe == "CE").alias("n_ce"), n(name == "memcpy_H2D").alias("h2d"), n(name == "memcpy_D2H").alias("d2h"),
        n((pe == "CE") & name.startswith("memcpy_") & ~name.isin("memcpy_H2D", "memcpy_D2H")).alias("other_copies"), signal_score(F.collect_list(F.when(pe == "CPU", name)), signals).alias("init_score"),
    )
    return per.join(of, "inv").drop("inv")


def process_report(attributed: DataFrame, waits: DataFrame, order: DataFrame, shapes: DataFrame) -> DataFrame:
    """(pid, what, key, n, share): calls by rule with their share, waits per stream, ordered stream pairs and invocations per shape of each process.

    attributed: pid, rule; waits: pid, stream, sync_type; order: pid, stream, before_stream; shapes: pid, sig.
    """
    total = Window.partitionBy("pid")
    rows = attributed.groupBy("pid", F.col("rule").alias("key")).agg(F.count(F.lit(1)).alias("n")).withColumn("share", F.round(F.col("n") / F.sum("n").over(total), 6)).withColumn("what", F.lit("rule"))
    for what, df, key in (
        ("wait", waits.where("sync_type = 2"), F.col("stream").cast("string")), ("sync_type", waits, F.col("sync_type").cast("string")),
        ("order", order.where("before_stream IS NOT NULL"), F.concat_ws("->", "before_stream", "stream")), ("shape", shapes, F.col("sig")),
    ):
        rows = rows.unionByName(df.groupBy("pid", key.alias("key")).agg(F.count(F.lit(1)).alias("n")).withColumn("share", F.lit(None).cast("double")).withColumn("what", F.lit(what)))
    return rows.select("pid", "what", "key", "n", "share")


def _power_axes(m: np.ndarray, k: int, steps: int) -> list[np.ndarray]:
    """The first k axes of a matrix by so many steps of power iteration from 1, 1.1, 1.2, ..., each taken out of the matrix before the next."""
    axes = []
    for _ in range(k):
        v = 1 + 0.1 * np.arange(len(m))
        for _ in range(steps):
            u = m @ v
            size = np.sqrt(u @ u)
            if not size:
                break
            v = u / size
        axes.append(v)
        m = m - (v @ m @ v) * np.outer(v, v)
    return axes


def pca(features: DataFrame, k: int = 2, steps: int | None = None) -> DataFrame:
    """Invocations on the first k principal axes of standardised features (population deviation, 1 where it is 0).

    One aggregation gives means and the matrix of products, whose size depends on the features only; its axes are found on
    the driver, exactly, or by so many steps of power iteration, which differ from it where two axes weigh nearly the same.
    The sign rule: of each axis the entry of the largest size (the first of equals) is positive.
    """
    cols = [c for c in features.columns if c != "inv"]
    x = [F.col(c).cast("double") for c in cols]
    d = len(cols)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    row = features.agg(F.count(F.lit(1)), *[F.avg(c) for c in x], *[F.stddev_pop(c) for c in x], *[F.covar_pop(x[i], x[j]) for i, j in pairs]).first()
    if not row[0]:
        return features.select("inv", *[F.lit(None).cast("double").alias(f"pc{i + 1}") for i in range(k)])
    mean, sd = row[1 : d + 1], [s if s else 1.0 for s in row[d + 1 : 2 * d + 1]]
    gram = np.zeros((d, d))
    for (i, j), c in zip(pairs, row[2 * d + 1 :]):
        gram[i, j] = gram[j, i] = c / sd[i] / sd[j]
    axes = np.linalg.eigh(gram)[1][:, ::-1][:, :k].T if steps is None else _power_axes(gram, k, steps)
    axes = [a * np.sign(a[np.argmax(np.abs(a) > np.abs(a).max() - 1e-9)]) for a in axes]
    scaled = [(c - m) / s for c, m, s in zip(x, mean, sd)]
    return features.select("inv", *[sum((c * float(w) for c, w in zip(scaled[1:], a[1:])), scaled[0] * float(a[0])).alias(f"pc{i + 1}") for i, a in enumerate(axes)])


#: Rows of an alignment that are kept; those between are computed again when the path comes by.
KEPT_ROWS = 64


def common_subsequence(a: list[str], b: list[str]) -> list[str]:
    """A longest common subsequence; on ties the first sequence's token is dropped.

    Bit-parallel: a row of the table is one number of len(b) bits, a zero where the length grows, and the next row follows by one
    addition. The path is walked from the front of both; every KEPT_ROWS-th row is kept and the rows between are made
    again, so memory is len(a) * len(b) / KEPT_ROWS bits.
    """
    n, m = len(a), len(b)
    full = (1 << m) - 1
    places: dict[str, int] = {}
    for j, t in enumerate(reversed(b)):
        places[t] = places.get(t, 0) | 1 << j

    def below(row: int, i: int) -> int:  # the row of a[i:] from that of a[i + 1:]
        u = row & places.get(a[i], 0)
        return ((row + u) | (row - u)) & full

    kept, row = {n: full}, full
    for i in range(n - 1, -1, -1):
        row = below(row, i)
        if i % KEPT_ROWS == 0:
            kept[i] = row
    length = lambda row, j: (m - j) - (row & ((1 << (m - j)) - 1)).bit_count()  # noqa: E731  of the rest of a row and b[j:]
    out, i, j, near = [], 0, 0, {}
    while i < n and j < m:
        if i + 1 not in near:
            last = min(n, (i // KEPT_ROWS + 1) * KEPT_ROWS)
            near, row = {last: kept[last]}, kept[last]
            for r in range(last - 1, i - 1, -1):
                row = near[r] = below(row, r)
        if a[i] == b[j]:
            out.append(a[i])
            i, j = i + 1, j + 1
        elif length(near[i + 1], j) >= length(near[i] if i in near else below(near[i + 1], i), j + 1):
            i += 1
        else:
            j += 1
    return out


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, skeleton, sequences) from rows (key, tokens) that come key by key; only the fold so far is held."""
    now, fold, count, done = None, [], 0, []

    def batch_of():
        out = pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.list_(pa.string())), pa.array([d[2] for d in done], pa.int64())], names=["key", "skeleton", "sequences"])
        done.clear()
        return out

    for batch in batches:
        for key, tokens in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if now is None or now[0] != key:
                if now is not None:
                    done.append((now[0], fold, count))
                now, fold, count = (key,), tokens, 0
            else:
                fold = common_subsequence(fold, tokens) if fold else fold
            count += 1
        if done:
            yield batch_of()
    if now is not None:
        done.append((now[0], fold, count))
        yield batch_of()


def skeleton(seqs: DataFrame, key: str, least: int = 1) -> DataFrame:
    """The common subsequence of all distinct sequences of a key, folded pairwise from the shortest.

    Sequences are made distinct first and stream past the fold in order, so a task holds two sequences, never a group.
    """
    ship_package(seqs.sparkSession)
    distinct = seqs.where(F.size("tokens") >= least).select(F.col(key).cast("string").alias("key"), "tokens").distinct()
    ordered = distinct.repartition("key").sortWithinPartitions("key", F.size("tokens"), "tokens")
    return ordered.mapInArrow(_folded, "key string, skeleton array<string>, sequences long")


def _runs(tokens: Column, length: Column | int) -> Column:
    """All runs of a length in order."""
    length = F.lit(length) if isinstance(length, int) else length
    size = F.size(tokens) - length + 1
    return F.when(size > 0, F.transform(F.sequence(F.lit(1), F.greatest(size, F.lit(1))), lambda i: F.slice(tokens, i, length))).otherwise(F.array().cast("array<array<string>>"))


def _with_run_ids(sequences: DataFrame, longest: int) -> DataFrame:
    """sequences with `levels`: for each power of two the hashes of all runs of that length, each made of the two halves' hashes."""
    rows = sequences.withColumn("__0", F.transform("tokens", lambda t: F.xxhash64(t)))
    names, length = ["__0"], 1
    while 2 * length <= longest:
        below, half = names[-1], length
        count = F.size("tokens") - 2 * half + 1
        pairs = F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), lambda i: F.xxhash64(F.get(below, i), F.get(below, i + half)))  # noqa: B023
        rows = rows.withColumn(f"__{len(names)}", F.when(count > 0, pairs).otherwise(F.array().cast("array<bigint>")))
        names.append(f"__{len(names)}")
        length *= 2
    return rows.withColumn("levels", F.array(*names)).drop(*names)


def _run_ids(length: Column) -> Column:
    """Hashes of all runs of any length, in order: each is named by the two runs of a power of two that cover it."""
    level = F.get("levels", (F.length(F.bin(length)) - 1).cast("int"))
    apart = length - F.pow(F.lit(2), F.length(F.bin(length)) - 1).cast("int")
    count = F.size("tokens") - length + 1
    ids = F.transform(F.sequence(F.lit(0), F.greatest(count, F.lit(1)) - 1), lambda i: F.xxhash64(F.get(level, i), F.get(level, (i + apart).cast("int"))))
    return F.when(count > 0, ids).otherwise(F.array().cast("array<bigint>"))


def common_block(seqs: DataFrame, key: str) -> DataFrame:
    """The longest contiguous run that all distinct sequences of a key hold; the first one in the shortest sequence on ties. Keys without one have no row.

    All keys are searched at once: each bisects the length of its own shortest sequence (a run held by all has shorter ones), and a round is one count
    of runs of the length that each key tries. Rounds grow with the logarithm of the shortest sequence. Runs are counted by 64-bit names made by doubling, so a row is
    of constant width; the run that a key finds is compared token by token in all its sequences. Sequences are shuffled by key as they
    are, once a round; names are made behind that.
    """
    distinct = written(seqs.select(F.col(key).cast("string").alias("key"), "tokens").distinct(), "sequences")
    longest = distinct.agg(F.max(F.size("tokens"))).first()[0] or 0
    total = distinct.groupBy("key").agg(F.count(F.lit(1)).alias("all"), F.min(F.size("tokens")).alias("high"), F.min(F.struct(F.size("tokens"), "tokens")).alias("first"))
    total = written(total, "shortest")
    shortest = total.select("key", "first.tokens")
    state = written(total.select("key", "all", F.lit(0).alias("low"), "high", F.array().cast("array<string>").alias("run")), "bisect")
    while state.where("low < high").limit(1).count():
        tried = state.where("low < high").select("key", "all", F.expr("(low + high + 1) div 2").cast("int").alias("length"))
        with_ids = lambda rows: _with_run_ids(rows, longest).withColumn("ids", _run_ids(F.col("length"))).drop("levels")
        named = with_ids(distinct.repartition("key").join(tried, "key"))
        hits = named.select("key", "all", F.explode(F.array_distinct("ids")).alias("id")).groupBy("key", "all", "id").agg(F.count(F.lit(1)).alias("c")).where("c = all").select("key", "id")
        at = hits.join(with_ids(shortest.join(tried, "key")).select("key", "tokens", "length", "ids"), "key").withColumn("at", F.array_position("ids", F.col("id")))
        best = at.groupBy("key").agg(F.min_by(F.struct("id", F.slice("tokens", F.col("at").cast("int"), F.col("length")).alias("run")), "at").alias("b")).select("key", "b.*")
        place = F.array_position("ids", F.col("id")).cast("int")
        same = named.join(best, "key").where((place > 0) & (F.slice("tokens", F.greatest(place, F.lit(1)), F.col("length")) == F.col("run")))
        held = same.groupBy("key", "all", "run").agg(F.count(F.lit(1)).alias("c")).where("c = all").select("key", F.col("run").alias("found"))
        moved = state.join(tried.select("key", "length"), "key", "left").join(held, "key", "left")
        hit, open_ = F.col("found").isNotNull(), F.col("length").isNotNull()
        state = written(
            moved.select(
                "key", "all", F.when(hit, F.col("length")).otherwise(F.col("low")).alias("low"), F.when(open_ & ~hit, F.col("length") - 1).otherwise(F.col("high")).alias("high"),
                F.when(hit, F.col("found")).otherwise(F.col("run")).alias("run"),
            ), "bisect",
        )
    return state.where("low > 0").select("key", F.col("low").alias("length"), F.array_join("run", ",").alias("block"))


def align(tokens: Column, skeleton_: Column) -> Column:
    """For each token the 0-based skeleton index it matches, greedily from the left, else -1."""
    start = F.struct(F.lit(0).alias("j"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(
        tokens, start,
        lambda s, t: F.struct(
            F.when(F.get(skeleton_, s["j"]) == t, s["j"] + 1).otherwise(s["j"]).alias("j"),
            F.concat(s["out"], F.array(F.when(F.get(skeleton_, s["j"]) == t, s["j"]).otherwise(-1))).alias("out"),
        ),
        lambda s: s["out"],
    )


def insertions(aligned: DataFrame) -> DataFrame:
    """Runs of unmatched tokens with the skeleton index before them (-1 at the start). aligned: inv, tokens, match."""
    rows = aligned.select("inv", F.posexplode(F.arrays_zip("tokens", "match")).alias("pos", "x")).select("inv", "pos", "x.tokens", "x.match")
    w = Window.partitionBy("inv").orderBy("pos")
    rows = rows.withColumn("after", F.coalesce(F.max(F.when(F.col("match") >= 0, F.col("match"))).over(w), F.lit(-1))).where("match < 0")
    return rows.groupBy("inv", "after").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "tokens"))), lambda x: x["tokens"]).alias("block"))


def _trie(blocks: DataFrame) -> DataFrame:
    """after, k, name, before, prefix, class, passes, ends: the weight that passes and ends at each prefix of k tokens of the blocks (after, block, weight, class).

    A row for each token is of constant width: a prefix is named by two hashes, the running bit-wise sums of its tokens' hashes by
    place, and grouped by that name, the name before and the last token. Two prefixes of one name would have to agree in all
    three at every length. The text of a prefix is cut from one of its blocks, once for each prefix.
    """
    distinct = blocks.groupBy("after", "block", "class").agg(F.sum("weight").alias("weight"))
    distinct = written(distinct.withColumn("b", F.monotonically_increasing_id()), "blocks")
    tokens = distinct.select("b", "after", "class", "weight", F.size("block").alias("size"), F.posexplode("block").alias("k", "token")).withColumn("k", F.col("k") + 1)
    w = Window.partitionBy("b").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    own = [F.xxhash64(F.lit(seed), "k", "token") for seed in (1, 2)]
    name = F.struct(*[F.bit_xor(h).over(w).alias(f"h{i}") for i, h in enumerate(own)]).alias("name")
    rows = tokens.select("b", "after", "class", "weight", "k", "token", (F.col("k") == F.col("size")).cast("int").alias("end"), name, *[h.alias(f"own{i}") for i, h in enumerate(own)])
    before = F.struct(*[F.col(f"name.h{i}").bitwiseXOR(F.col(f"own{i}")).alias(f"h{i}") for i in range(2)])
    roots = distinct.select("b", "after", "class", "weight", F.lit(0).alias("k"), F.lit(None).cast("string").alias("token"), (F.size("block") == 0).cast("int").alias("end"), F.struct(F.lit(0).cast("bigint").alias("h0"), F.lit(0).cast("bigint").alias("h1")).alias("name"))
    rows = rows.withColumn("before", before).drop("own0", "own1").unionByName(roots.withColumn("before", F.col("name")))
    per = rows.groupBy("after", "k", "name", "before", "token", "class").agg(F.sum("weight").alias("passes"), F.sum(F.col("weight") * F.col("end")).alias("ends"), F.min("b").alias("b"))
    text = F.array_join(F.slice("block", 1, F.col("k")), ",").alias("prefix")
    return per.join(distinct.select("b", "block"), "b").select("after", "k", "name", "before", "token", text, "class", "passes", "ends")


def insertion_trie(blocks: DataFrame) -> DataFrame:
    """Prefixes of insertion blocks at each skeleton index: how many pass, how many end, and the share that ends."""
    rows = _trie(blocks.select("after", "block", F.lit(1).alias("weight"), F.lit("").alias("class"))).where("k > 0")
    return rows.select("after", "prefix", "passes", F.col("ends"), F.round(F.col("ends") / F.col("passes"), 6).alias("end_share"))


def weighted_trie(blocks: DataFrame) -> DataFrame:
    """The trie of blocks (after, block, weight, class): per prefix the weight that passes and ends, the share that ends, the share of the prefix before
    that enters it, and the weight by class as `class:weight` in order of class."""
    node = ["after", "k", "name", "before", "token"]
    per = _trie(blocks).groupBy(*node).agg(
        F.min("prefix").alias("prefix"), F.sum("passes").alias("passes"), F.sum("ends").alias("ends"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("class", "passes"))), lambda x: F.concat_ws(":", x["class"], x["passes"])), ",").alias("classes"),
    )
    up = per.groupBy("after", (F.col("k") + 1).alias("k"), F.col("name").alias("before")).agg(F.sum("passes").alias("from"))
    out = per.where("k > 0").join(up, ["after", "k", "before"])
    return out.select("after", "prefix", "passes", "ends", "classes", F.round(F.col("ends") / F.col("passes"), 6).alias("end_share"), F.round(F.col("passes") / F.col("from"), 6).alias("enter_share"))


def majority_insertions(blocks: DataFrame, k: int = 15) -> DataFrame:
    """The k blocks of the largest weight, with the class that has most of it (the first by name on ties). blocks: block, weight, class."""
    mix = blocks.groupBy(F.array_join("block", ",").alias("block"), "class").agg(F.sum("weight").alias("w"))
    per = mix.groupBy("block").agg(F.sum("w").alias("n"), F.min_by("class", F.struct(-F.col("w"), F.col("class"))).alias("majority"))
    return per.orderBy(F.col("n").desc(), "block").limit(k)


def top_insertions(blocks: DataFrame, k: int = 15) -> DataFrame:
    return blocks.groupBy(F.array_join("block", ",").alias("block")).agg(F.count(F.lit(1)).alias("n"), F.min("after").alias("first_after")).orderBy(F.col("n").desc(), "block").limit(k)


def position_in(tokens: Column, part: list[str]) -> Column:
    """0-based start of a run inside tokens, else -1."""
    return F.array_position(_runs(tokens, len(part)), F.array(*[F.lit(p) for p in part])).cast("int") - 1


def token_stats(calls: DataFrame) -> DataFrame:
    """Per token: calls, cost least / median (element n // 2) / largest, streams. Costs are counted first and ranked over range partitions."""
    at = F.expr("total div 2")
    counts = running_sum(calls.groupBy("token", "cost").agg(F.count(F.lit(1)).alias("c")), ["token"], ["cost"], "c")
    per = counts.groupBy("token").agg(F.max("total").alias("n"), F.min("cost").alias("c_min"), F.max(F.when((F.col("before") <= at) & (at < F.col("before") + F.col("c")), F.col("cost"))).alias("c_median"), F.max("cost").alias("c_max"))
    return per.join(calls.groupBy("token").agg(F.count_distinct("stream").alias("streams")), "token")


def activity_stats(activity: DataFrame) -> DataFrame:
    """Per activity name: n, duration least / median / largest, median bytes and the throughput of the medians (null without bytes or time). activity: name, duration, bytes."""
    def middle(value: str) -> DataFrame:
        counts = activity.where(F.col(value).isNotNull()).groupBy("name", value).agg(F.count(F.lit(1)).alias("c"))
        at = F.expr("total div 2")
        return running_sum(counts, ["name"], [value], "c").where((F.col("before") <= at) & (at < F.col("before") + F.col("c"))).select("name", F.col(value).alias(f"{value}_median"))

    per = activity.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("duration").alias("d_min"), F.max("duration").alias("d_max"))
    out = per.join(middle("duration"), "name", "left").join(middle("bytes"), "name", "left")
    return out.withColumn("throughput", F.col("bytes_median") / (F.nullif("duration_median", F.lit(0)) / F.lit(1e9)))


def classify_periods(seqs: DataFrame, least: int = 10, late: int = 3, early: int = 3, init: int = 100, warm: int = 20, share: float = 0.95) -> DataFrame:
    """Phase of each period of a key. seqs: key, inv (its place in time), tokens, sig, and score (of initialisation; 0 without that column).

    INIT: score of `init` or more. STEADY: the dominant signature, the most frequent among periods with a score below `warm` (the earliest on ties).
    COALESCED(n): the dominant sequence n times over. TAIL: among the last `late`, shorter than the dominant sequence, of `least` tokens
    or more, `share` of which match it from the start while the rest are sync calls. WARMUP: among the first `early` with a score of `warm` or more. Else UNKNOWN.
    """
    rows = seqs if "score" in seqs.columns else seqs.withColumn("score", F.lit(0))
    counts = rows.where(F.col("score") < warm).groupBy("key", "sig").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("inv", "tokens")).alias("r"))
    best = counts.groupBy("key").agg(F.min_by(F.struct("sig", F.col("r.tokens").alias("main")), F.struct(-F.col("c"), F.col("r.inv"))).alias("b")).select("key", F.col("b.sig").alias("main_sig"), F.col("b.main").alias("main"))
    rows = running_sum(rows.withColumn("one", F.lit(1)), ["key"], ["inv"], "one")  # before: periods ahead of this one; total: of the key
    n, m = F.size("tokens"), F.size("main")
    match = F.coalesce(F.array_position(F.zip_with(F.col("tokens"), F.slice("main", 1, n), lambda a, b: a.eqNullSafe(b)), F.lit(False)) - 1, F.lit(-1))
    match = F.when(match < 0, n).otherwise(match)
    rest_sync = F.forall(F.slice("tokens", match.cast("int") + 1, F.greatest(n, F.lit(1))), lambda t: t.contains("Synchronize"))
    times = F.expr("size(tokens) div greatest(size(main), 1)")
    phase = (
        F.when(F.col("score") >= init, "INIT").when(F.col("sig") == F.col("main_sig"), "STEADY")
        .when((n > m) & (n % m == 0) & (F.col("tokens") == F.flatten(F.array_repeat("main", times.cast("int")))), F.concat(F.lit("COALESCED("), times, F.lit(")")))
        .when((F.col("total") - F.col("before") <= late) & (n >= least) & (n < m) & (match >= share * n) & rest_sync, "TAIL")
        .when((F.col("score") >= warm) & (F.col("before") < early), "WARMUP").otherwise("UNKNOWN")
    )
    return rows.join(best, "key", "left").select("key", "inv", "sig", phase.alias("phase"))


def classify_shapes(stats: DataFrame, axes: list[str], sigma: float = 2.0, tail: float = 0.05) -> DataFrame:
    """Class of each shape of a key: shutdown, init, dominant, anomaly or variant, in that order.

    stats: key, sig, count, first_t, last_t, init_score, total, and numeric axes. shutdown: seen only in the last `tail` of the key's
    time; init: score of 100 or more; dominant: the most frequent. anomaly: on an axis more than sigma deviations from the
    mean, or a modified z score above 3.5, or a total below a fifth of the median.
    """
    per = stats.groupBy("key").agg(
        F.min("first_t").alias("t0"), F.max("last_t").alias("t1"), F.max_by("sig", F.struct("count", "sig")).alias("main"),
        *[f.alias(f"{a}_{n}") for a in axes for n, f in (("mean", F.avg(a)), ("std", F.stddev_pop(a)))],
    )
    middle = medians(stats, {"median_total": "total"} | {f"{a}_median": a for a in axes}, "key")
    j = stats.join(per, "key").join(middle, "key")
    j = j.join(medians(j, {f"{a}_mad": F.abs(F.col(a) - F.col(f"{a}_median")) for a in axes}, "key"), "key")
    odd = F.col("total") < F.col("median_total") / 5
    for a in axes:
        odd = odd | (F.abs(F.col(a) - F.col(f"{a}_mean")) > sigma * F.nullif(f"{a}_std", F.lit(0.0))) | (0.6745 * F.abs(F.col(a) - F.col(f"{a}_median")) / F.nullif(f"{a}_mad", F.lit(0.0)) > 3.5)
    late = F.col("first_t") >= F.col("t1") - tail * (F.col("t1") - F.col("t0"))
    return j.select("key", "sig", F.when(late, "shutdown").when(F.col("init_score") >= 100, "init").when(F.col("sig") == F.col("main"), "dominant").when(F.coalesce(odd, F.lit(False)), "anomaly").otherwise("variant").alias("class"))


def init_score(names: Column, hard: list[str], weights: dict[str, int]) -> Column:
    """100 if a name holds a hard token, else the weighted number of names that hold each soft token."""
    count = lambda t: F.size(F.filter(names, lambda n: n.contains(t)))
    out = F.lit(0)
    for t, w in weights.items():
        out = out + count(t) * w
    for t in hard:
        out = F.when(count(t) > 0, F.greatest(out, F.lit(100))).otherwise(out)
    return out
