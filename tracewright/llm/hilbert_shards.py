"""Sharding along a Hilbert curve over quantised metadata, cut into runs of equal row counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm.common import BROADCAST_ROWS, body, materialise, offsets, salted_join, table
from tracewright.operators.scale import running_sum

SHARDS = 40
BITS = 5
FEW_NAMES = 10_000


def hilbert_index(dims: list[Column], bits: int) -> Column:
    """Position on the Hilbert curve of a cell given by integer coordinates below 2**bits.

    The axes are transformed to the transposed index level by level (the published bit-twiddling
    form of the curve), then the bits are interleaved. Everything is one JVM-side expression: the
    walk over (level, axis) is an aggregate over a constant array.
    """
    n = len(dims)
    steps = F.array(*[F.struct(F.lit(1 << b).alias("q"), F.lit(i).alias("i")) for b in range(bits - 1, 0, -1) for i in range(n)])

    def step(a: Column, s: Column) -> Column:
        low, first, here = s["q"] - 1, a[0], F.get(a, s["i"])
        swap = first.bitwiseXOR(here).bitwiseAND(low)
        up = here.bitwiseAND(s["q"]) != 0
        return F.transform(
            a,
            lambda v, j: F.when(up & (j == 0), v.bitwiseXOR(low)).when(~up & ((j == 0) != (j == s["i"])), v.bitwiseXOR(swap)).otherwise(v),
        )

    def gray(a: Column) -> Column:
        return F.transform(a, lambda v, j: F.aggregate(F.slice(a, 1, j + 1), F.lit(0), lambda x, y: x.bitwiseXOR(y)))

    def settle(a: Column) -> Column:
        last = F.element_at(a, -1)
        turn = F.lit(0)
        for b in range(bits - 1, 0, -1):
            turn = turn.bitwiseXOR(F.when(last.bitwiseAND(F.lit(1 << b)) != 0, (1 << b) - 1).otherwise(0))
        return F.transform(a, lambda v: v.bitwiseXOR(turn))

    def interleave(a: Column) -> Column:
        parts = [F.shiftleft(F.shiftright(a[i], b).bitwiseAND(F.lit(1)).cast("long"), b * n + n - 1 - i) for b in range(bits) for i in range(n)]
        out = parts[0]
        for p in parts[1:]:
            out = out + p
        return out

    walked = F.aggregate(steps, F.array(*[d.cast("int") for d in dims]), step)
    # Each stage is bound once by a one-element transform, so no expression is repeated in the tree.
    bound = F.transform(F.array(walked), gray)
    bound = F.transform(bound, settle)
    return F.transform(bound, interleave)[0]


def _level(col: str, cuts: list) -> Column:
    """Number of the cell of an ascending list of cuts (2**bits - 1 at most) that a value falls into."""
    kind = "array<string>" if cuts and isinstance(cuts[0], str) else "array<long>"
    return F.size(F.filter(F.lit(cuts).cast(kind), lambda c: c < F.col(col)))


def _size_cuts(meta: DataFrame, cells: int) -> list[int]:
    return meta.agg(F.percentile_approx("size", [i / cells for i in range(1, cells)], 10_000).alias("cuts")).first()["cuts"] or []


def _name_cuts(meta: DataFrame, col: str, cells: int) -> list[str]:
    """Names that end a cell if all names are sorted and cut where their rows sum to a new share of 1 / cells.

    Names are counted first. Up to FEW_NAMES counts are summed on the driver; the running sums of more are range partitioned, and
    only the last name of each cell reaches the driver.
    """
    names = meta.groupBy(col).agg(F.count(F.lit(1)).alias("rows"))
    few = names.limit(FEW_NAMES + 1).collect()
    if len(few) <= FEW_NAMES:
        total, before, ends = sum(r["rows"] for r in few), 0, {}
        for r in sorted(few):
            ends[before * cells // total] = r[col]
            before += r["rows"]
        return _spread(ends, cells)
    ranked = running_sum(names, [], [col], "rows").withColumn("cell", F.expr(f"cast((before * {cells}) div total as int)"))
    return _spread({r["cell"]: r["last"] for r in ranked.groupBy("cell").agg(F.max(col).alias("last")).collect()}, cells)


def _spread(ends: dict[int, str], cells: int) -> list[str]:
    """The last name before each cell from the second on, so that a name's cell is the number of cuts below it; ends: last name by cell."""
    return [max(n for c, n in ends.items() if c < k) for k in range(1, cells)] if ends else []


def _metadata(docs: DataFrame, more: list[Column]) -> DataFrame:
    text = body("text")
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
        F.md5(F.encode(text, "UTF-8")).alias("text_md5"),
        F.coalesce("lang", F.lit("")).alias("lang"),
        F.coalesce("source", F.lit("")).alias("source"),
        *more,
    )


def _ordered(docs: DataFrame, bits: int, whole_rows: bool) -> tuple[DataFrame, DataFrame, int]:
    """Rows along the curve with (part, pos), the rows before each part, and their number; with whole_rows also the columns of docs as one struct."""
    meta = materialise(_metadata(docs, []), "shard-meta")
    cells, total = 1 << bits, meta.count()
    # A group of equal texts takes its lang and source from its first row; only groups whose rows differ there need it.
    names = F.struct("lang", "source")
    mixed = (
        meta.groupBy("text_md5").agg(F.min(F.struct("doc_id", "lang", "source")).alias("first"), F.min(names).alias("lo"), F.max(names).alias("hi"))
        .where("lo <> hi").select("text_md5", F.col("first.lang").alias("group_lang"), F.col("first.source").alias("group_source"))
    )
    rows = _metadata(docs, [F.struct(*[F.col(c) for c in docs.columns]).alias("row")]) if whole_rows else meta
    rows = salted_join(rows, mixed, "text_md5", how="left", total=total, counted=meta)
    rows = rows.withColumn("lang", F.coalesce("group_lang", "lang")).withColumn("source", F.coalesce("group_source", "source"))
    dims = [_level("lang", _name_cuts(meta, "lang", cells)), _level("source", _name_cuts(meta, "source", cells)), _level("size", _size_cuts(meta, cells))]
    keyed = rows.select("doc_id", "size", "text_crc32", "text_md5", hilbert_index(dims, bits).alias("hilbert"), *(["row"] if whole_rows else []))
    order = ["hilbert", "text_md5", "doc_id"]
    ranked = keyed.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    ranked = materialise(
        ranked.select("*", F.shiftright("at", 33).cast("int").alias("part"), F.col("at").bitwiseAND(F.lit((1 << 33) - 1)).alias("pos"), F.xxhash64("text_md5").alias("text_key")).drop("at", "text_md5"),
        "shard-sorted",
    )
    before = offsets(ranked.groupBy("part").agg(F.count(F.lit(1)).alias("rows")), "rows", "base")
    return ranked, before.select("part", "base"), total


def _exchanged(rows: DataFrame, start: Callable[[str], str]) -> DataFrame:
    """(rank, other): rows that change places so that no cut parts a group of equal texts; rows: rank, shard, text_key.

    A group that a cut parts goes to the later shard as a whole: those of its rows before the cut change places with the
    first rows behind the group, in that shard, whose text is theirs alone. Where there are too few, or where a
    group reaches over more than two shards, it stays parted. start gives the rank that a shard begins with, as an expression.
    """
    ends = rows.where(f"rank = {start('shard')} OR rank + 1 = {start('(shard + 1)')}")
    parted = ends.groupBy("text_key").agg(F.min("shard").alias("low"), F.max("shard").alias("high")).where("high = low + 1").select("text_key", "low")
    parted = F.broadcast(materialise(parted, "parted", compact=True))  # one group at a cut at most
    cut = F.expr(start("(low + 1)"))
    groups = rows.join(parted, "text_key").groupBy("text_key", "low").agg(F.min("rank").alias("first"), (F.max("rank") + 1).alias("behind")).withColumn("need", cut - F.col("first"))
    groups = F.broadcast(materialise(groups.select((F.col("low") + 1).alias("shard"), "first", "behind", "need"), "groups", compact=True))
    alone = rows.join(groups, "shard").where("rank >= behind").groupBy("shard", "first", "need", "text_key").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("rank"))
    alone = alone.where("n = 1").join(parted, "text_key", "left_anti").select("shard", "first", "need", "rank", F.lit(1).alias("one"))
    chosen = materialise(running_sum(alone, ["shard"], ["rank"], "one").where("before < need AND total >= need").select("rank", (F.col("first") + F.col("before")).alias("other")), "exchanged", compact=True)
    return chosen.unionByName(chosen.select(F.col("other").alias("rank"), F.col("rank").alias("other")))


def _placed(ranked: DataFrame, before: DataFrame, total: int, shards: int) -> DataFrame:
    """ranked with shard and slot: the sorted run is cut where rank * shards / total reaches a new number. before has one row per file part."""
    n = max(total, 1)
    out = ranked.join(F.broadcast(before), "part").withColumn("rank", F.col("base") + F.col("pos"))
    number = F.expr(f"cast((rank * {shards}) div {n} as int)")
    start = lambda shard: f"((cast({shard} as long) * {n} + {shards - 1}) div {shards})"
    swaps = _exchanged(out.select("rank", number.alias("shard"), "text_key"), start)
    swaps = F.broadcast(swaps) if swaps.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else swaps
    out = out.join(swaps, "rank", "left").withColumn("rank", F.coalesce("other", "rank")).drop("other", "text_key").withColumn("shard", number)
    return out.withColumn("slot", F.expr(f"rank - {start('shard')}"))


def hilbert_shards(docs: DataFrame, shards: int = SHARDS, bits: int = BITS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, hilbert, for every row of docs.

    Three axes are quantised to 2**bits cells of equal depth over all rows: size by its quantiles, lang and
    source by the order of their names, so a cell is a range of names. Rows are sorted by (curve index, md5 of
    the text, doc_id), and the sorted run is cut into shards whose row counts differ by one at most (law
    `rows`). Equal texts take the lang and source of the first of them (smallest doc_id), so they have one place on the
    curve and are neighbours; where a cut falls inside a group, the group's rows before it change places with
    single rows behind it (see _exchanged), so only groups larger than a shard stay parted, or those of a shard with too few single rows.
    The global rank is local position + rows of earlier file parts, which are joined as a table of one row per
    part. Texts are read once and never shuffled.

    Null text counts as empty, null lang or source as an empty name; a null doc_id sorts first;
    repeated rows get slots of their own. Other columns are ignored. An empty table gives an empty result.
    """
    return _placed(*_ordered(docs, bits, False), shards).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert"
    )


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, bits: int = BITS) -> str:
    """Write all columns of docs as one folder per shard, rows in curve order inside each file; the folder column's name is returned.

    The rows themselves are sorted and cut as in hilbert_shards (written twice, shuffled once), so repeated and null
    doc_ids are kept as they are. Each task writes the run it holds, so a large shard is the work of several tasks and has
    several files. A file holds a narrow range of every axis, so footers prune scans on lang, source and size together. The
    folder column is `shard`, with underscores added where docs has that column.
    """
    name = "shard"
    while name in docs.columns:
        name += "_"
    ranked, before, total = _ordered(docs, bits, True)
    out = _placed(ranked, before, total, shards).select(F.col("shard").alias("__shard"), "part", "pos", "row.*")
    out.drop("part", "pos").withColumnRenamed("__shard", name).write.partitionBy(name).parquet(path)
    return name


def op10_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_shards(table(spark, sf_dir, "documents"))


QUERIES = {"op10_hilbert_shards": op10_hilbert_shards}
ORACLES: dict[str, str] = {}
