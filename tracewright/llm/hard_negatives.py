"""Hard negatives for contrastive training: Hilbert-ordered blocks of candidates with zone maps, searched block by block."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.llm.common import light_batches, materialise, new_path, released, table

#: Bytes of the vectors of a candidate block and of a chunk of anchors.
BLOCK_BYTES, CHUNK_BYTES = 131_072, 524_288
#: Dimensions of the Hilbert curve (those of the largest variance) and bits of each.
CURVE_DIMS, CURVE_BITS = 6, 5
#: Positives of an anchor, negatives of an anchor and positive, and the window of a negative's score in hundredths of the positive's.
POSITIVES, NEGATIVES, WINDOW = 5, 10, (30, 90)
#: Zone maps that stand in a row.
ZONES = 128
#: No score, and beyond any score.
NONE = -(1 << 62)


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place on the Hilbert curve of each row of cells (dimensions in columns, values below 2**bits).

    Gray-code form: from the highest bit down, a dimension whose bit is set turns the first one over, else the lower bits of
    both are exchanged; the transposed bits then are the place in Gray code.
    """
    x = cells.astype(np.int64).copy()
    dims = x.shape[1]
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for d in range(dims):
            turned = (x[:, d] >> b) & 1 == 1
            swap = np.where(turned, 0, (x[:, 0] ^ x[:, d]) & low)
            x[:, 0] ^= np.where(turned, low, swap)
            x[:, d] ^= swap
    for d in range(1, dims):
        x[:, d] ^= x[:, d - 1]
    flips = np.zeros(len(x), np.int64)
    for b in range(bits - 1, 0, -1):
        flips ^= np.where((x[:, -1] >> b) & 1 == 1, (1 << b) - 1, 0)
    x ^= flips[:, None]
    place = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for d in range(dims):
            place = (place << 1) | ((x[:, d] >> b) & 1)
    return place


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two integer matrices: in doubles where no sum can reach 2**53, else in 64-bit integers."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if top < 2.0**53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def bounds(anchors: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest score that each anchor can have with a row of each box (interval arithmetic by dimension)."""
    up, down = np.maximum(anchors, 0), np.minimum(anchors, 0)
    return product(up, low) + product(down, high), product(up, high) + product(down, low)


def vectors(embeddings: DataFrame) -> tuple[DataFrame, int]:
    """(vec_id, label, v) of the rows that take part, components as floor(256 * x), and the number of dimensions.

    Rows without vec_id, label or vector or with a null or non-finite component take no part. Of rows with one vec_id the one
    with the least (label, vector) stays. Shorter vectors are filled up with zeros. Components are held within
    +-sqrt(2**56 / dimensions), so that no window leaves 64 bits (with 64 dimensions, x beyond 131,072).
    """
    x = F.col("embedding").cast("array<double>")
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    rows = embeddings.where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL").where(F.coalesce(fine, F.lit(False)))
    rows = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), x.alias("x"))
    rows = materialise(rows.groupBy("vec_id").agg(F.min(F.struct("label", "x")).alias("r")).select("vec_id", "r.label", "r.x"), "valid")
    dims = max(1, rows.agg(F.max(F.size("x"))).first()[0] or 1)
    most = float(int((2**56 / dims) ** 0.5))
    v = F.transform("x", lambda e: F.floor(F.least(F.greatest(256 * e, F.lit(-most)), F.lit(most))))
    return rows.select("vec_id", "label", F.concat(v, F.array_repeat(F.lit(0).cast("bigint"), dims - F.size("x"))).alias("v")), dims


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def _placed(dims: int, axes: list[int], start: list[float], step: list[float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch.column(2), dims)[:, axes]
            cells = np.clip(np.floor((v - np.array(start)) / np.array(step)), 0, 2**CURVE_BITS - 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(hilbert(cells, CURVE_BITS))], names=["vec_id", "label", "v", "place"])

    return run


def on_curve(rows: DataFrame, dims: int) -> DataFrame:
    """rows with their place on a Hilbert curve over the CURVE_DIMS dimensions of the largest variance, each cut into equal parts of +-2.5 deviations."""
    spread = rows.select(F.posexplode("v").alias("d", "x")).groupBy("d").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("sd")).collect()
    best = sorted(spread, key=lambda r: (-r["sd"], r["d"]))[:CURVE_DIMS]
    start, step = [r["mean"] - 2.5 * r["sd"] for r in best], [max(5 * r["sd"], 1e-9) / 2**CURVE_BITS for r in best]
    axes = [r["d"] for r in best] or [0]
    return rows.mapInArrow(released(_placed(dims, axes, start or [0.0], step or [1.0])), "vec_id bigint, label bigint, v array<bigint>, place bigint")


def _best(scores: np.ndarray, ids: np.ndarray, fits: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row of scores the k best that fit (score descending, id ascending; ids ascend by column): scores (NONE where there are fewer) and ids."""
    k_here = min(k, scores.shape[1])
    width = scores.shape[1]
    if width and np.abs(scores).max(initial=0) < (1 << 61) // width:
        key = np.where(fits, scores * width + np.arange(width - 1, -1, -1), NONE)
        at = np.argpartition(-key, k_here - 1, axis=1)[:, :k_here] if k_here < width else np.tile(np.arange(width), (len(key), 1))
    else:
        key = np.where(fits, scores, NONE)
        at = np.argsort(-key, axis=1, kind="stable")[:, :k_here]
    top, who = np.full((len(scores), k), NONE), np.zeros((len(scores), k), np.int64)
    top[:, :k_here] = np.where(np.take_along_axis(fits, at, 1), np.take_along_axis(scores, at, 1), NONE)
    who[:, :k_here] = ids[at]
    return top, who


def _merged(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    scores, ids = np.concatenate([a[0], b[0]], 1), np.concatenate([a[1], b[1]], 1)
    order = np.lexsort((ids, -scores), axis=1)[:, :k]
    return np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


_BLOCK = "block bigint, ids binary, labels binary, v binary, low binary, high binary, label_low bigint, label_high bigint, anchors array<bigint>, floors array<bigint>"


def _named(fields: str) -> list[str]:
    return [c.split()[0] for c in fields.split(", ")]


def _collected(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.Table]:
    """The rows of batches, size at a time."""
    held, rows = [], 0
    for batch in batches:
        at = 0
        while at < len(batch):
            part = batch.slice(at, size - rows)
            held.append(part)
            rows, at = rows + len(part), at + len(part)
            if rows == size:
                yield pa.Table.from_batches(held).combine_chunks()
                held, rows = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _blocks(dims: int, every: int, k: int):
    """Candidate blocks from rows in the order of the curve. Each anchor in a block gets the score of its k-th positive there, a floor for its positives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for n, rows in enumerate(_collected(batches, max(16, BLOCK_BYTES // (4 * dims)))):
            rows = rows.sort_by("vec_id").combine_chunks()
            ids, labels = rows["vec_id"].to_numpy(), rows["label"].to_numpy()
            v = _matrix(rows["v"].combine_chunks(), dims)
            here = np.flatnonzero(ids % every == 0)
            fits = (labels[here, None] == labels[None, :]) & (ids[here, None] != ids[None, :])
            floors = _best(product(v[here], v), ids, fits, k)[0].min(axis=1, initial=1 << 62)
            raw = lambda a, t: pa.array([np.ascontiguousarray(a, t).tobytes()], pa.binary())
            lists = [pa.array([x.tolist()], pa.list_(pa.int64())) for x in (ids[here], floors)]
            number = lambda x: pa.array([int(x)], pa.int64())
            columns = [number((part << 32) + n), raw(ids, "<i8"), raw(labels, "<i8"), raw(v, "<i4"), raw(v.min(axis=0), "<i4"), raw(v.max(axis=0), "<i4"), number(labels.min()), number(labels.max()), *lists]
            yield pa.RecordBatch.from_arrays(columns, names=_named(_BLOCK))

    return run


_CHUNK = "chunk bigint, ids binary, labels binary, v binary, homes binary, slots binary"


def _chunks(dims: int):
    """Anchors in the order of the curve, packed; slots holds lowest score, highest score and floor of each of an anchor's searches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        for n, rows in enumerate(_collected(batches, max(16, CHUNK_BYTES // (4 * dims)))):
            raw = lambda a, t: pa.array([np.ascontiguousarray(a, t).tobytes()], pa.binary())
            flat = lambda c: rows[c].combine_chunks().flatten().to_numpy(zero_copy_only=False)
            columns = [raw(rows[c].to_numpy(), "<i8") for c in ("vec_id", "label")] + [raw(_matrix(rows["v"].combine_chunks(), dims), "<i4"), raw(rows["home"].to_numpy(), "<i8"), raw(flat("slots"), "<i8")]
            yield pa.RecordBatch.from_arrays([pa.array([(part << 32) + n]), *columns], names=_named(_CHUNK))

    return run


@dataclass
class Anchors:
    """A chunk of anchors with their searches."""

    ids: np.ndarray
    labels: np.ndarray
    v: np.ndarray
    homes: np.ndarray
    slots: np.ndarray  # anchors x searches x (lowest, highest, floor)

    @staticmethod
    def of(ids: bytes, labels: bytes, v: bytes, homes: bytes, slots: bytes, dims: int) -> Anchors:
        number = lambda x: np.frombuffer(x, "<i8")
        many = number(ids)
        return Anchors(many, number(labels), np.frombuffer(v, "<i4").reshape(-1, dims).astype(np.int64), number(homes), number(slots).reshape(len(many), -1, 3))

    def needs(self, low: np.ndarray, high: np.ndarray, label_low: np.ndarray, label_high: np.ndarray, same: bool, floors: np.ndarray | None = None) -> np.ndarray:
        """Which anchors (rows) need which blocks (columns): some window and floor meets what the box allows, and so do its labels."""
        least, most = bounds(self.v, low, high)
        own = self.labels[:, None]
        labels = (own >= label_low) & (own <= label_high) if same else ~((own == label_low) & (own == label_high))
        out = np.zeros(labels.shape, bool)
        for s in range(self.slots.shape[1]):
            lowest, highest, floor = (self.slots[:, s, c, None] for c in range(3))
            floor = np.maximum(floor, floors[:, s, None]) if floors is not None else floor
            out |= (lowest <= highest) & (most >= np.maximum(lowest, floor)) & (least <= highest)
        return out & labels


_TILE = "chunk bigint, block bigint, need binary"


def _chosen(dims: int, same: bool):
    """Tiles from rows (chunk, kind, ...): a chunk of anchors (kind 0), then all zone maps (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors, chunk = None, None
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                if not row["kind"]:
                    anchors, chunk = Anchors.of(row["ids"], row["labels"], row["v"], row["homes"], row["slots"], dims), row["chunk"]
                    continue
                blocks, label_low, label_high = np.frombuffer(row["ids"], "<i8").reshape(3, -1)
                low, high = np.frombuffer(row["v"], "<i4").reshape(2, -1, dims).astype(np.int64)
                need = anchors.needs(low, high, label_low, label_high, same)
                out += [(chunk, int(blocks[b]), np.packbits(need[:, b]).tobytes()) for b in np.flatnonzero(need.any(axis=0)).tolist()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.binary()))], names=_named(_TILE))

    return run


def _homes(dims: int):
    """Tiles of a chunk's anchors with the blocks they stand in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                a = Anchors.of(row["ids"], row["labels"], row["v"], row["homes"], row["slots"], dims)
                blocks = np.unique(a.homes)
                need = [np.packbits(a.homes == b).tobytes() for b in blocks]
                yield pa.RecordBatch.from_arrays([pa.array([row["chunk"]] * len(blocks), pa.int64()), pa.array(blocks), pa.array(need, pa.binary())], names=_named(_TILE))

    return run


_FOUND = "anchor_id bigint, slot int, vec_id bigint, score bigint"


def _searched(dims: int, same: bool, k: int):
    """The best of each anchor's searches, from rows (chunk, part, kind, ...): a chunk of anchors (kind 0), then blocks (kind 1) with the anchors that need them.

    Anchors whose k-th score so far is beyond a block's bound pass it by.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, top, who = None, None, None

        def results():
            anchor, slot, _ = (x := np.nonzero(top > NONE))
            return pa.RecordBatch.from_arrays([pa.array(a.ids[anchor]), pa.array(slot.astype(np.int32)), pa.array(who[x]), pa.array(top[x])], names=_named(_FOUND))

        for batch in batches:
            for row in batch.to_pylist():
                if not row["kind"]:
                    if a is not None:
                        yield results()
                    a = Anchors.of(row["ids"], row["labels"], row["v"], row["homes"], row["slots"], dims)
                    top, who = np.full((*a.slots.shape[:2], k), NONE), np.zeros((*a.slots.shape[:2], k), np.int64)
                    continue
                ids, labels = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["labels"], "<i8")
                v = np.frombuffer(row["v"], "<i4").reshape(-1, dims).astype(np.int64)
                asked = np.unpackbits(np.frombuffer(row["slots"], np.uint8), count=len(a.ids)).astype(bool)
                box = [x[None, :] for x in (v.min(axis=0), v.max(axis=0))]
                asked &= a.needs(*box, labels[:1] * 0 + labels.min(), labels[:1] * 0 + labels.max(), same, top[:, :, -1])[:, 0]
                at = np.flatnonzero(asked)
                if not len(at):
                    continue
                scores = product(a.v[at], v)
                fits = (a.labels[at, None] == labels) & (a.ids[at, None] != ids) if same else a.labels[at, None] != labels
                for s in range(a.slots.shape[1]):
                    lowest, highest = a.slots[at, s, 0, None], a.slots[at, s, 1, None]
                    found = _best(scores, ids, fits & (scores >= lowest) & (scores <= highest), k)
                    top[at, s], who[at, s] = _merged((top[at, s], who[at, s]), found, k)
        if a is not None:
            yield results()

    return run


def _zones(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Zone maps of ZONES blocks in a row."""
    for rows in _collected(batches, ZONES):
        ids = np.stack([rows[c].to_numpy() for c in ("block", "label_low", "label_high")]).astype("<i8").tobytes()
        boxes = b"".join(rows["low"].to_pylist()) + b"".join(rows["high"].to_pylist())
        yield pa.RecordBatch.from_arrays([pa.array([ids], pa.binary()), pa.array([boxes], pa.binary())], names=["ids", "v"])


@dataclass
class Index:
    """Candidates in Parquet blocks in the order of a Hilbert curve, with zone maps and the anchors among them."""

    blocks: DataFrame
    zones: DataFrame
    rows: DataFrame  # vec_id, label, v, place
    anchors: DataFrame  # vec_id, home (block), floor
    dims: int

    def chunks(self, slots: DataFrame) -> DataFrame:
        """Packed anchors with their searches; slots: vec_id, slots (an array of lowest, highest, floor for each search)."""
        rows = self.rows.join(self.anchors.select("vec_id", "home"), "vec_id").join(slots, "vec_id").select("vec_id", "label", "v", "home", "slots", "place")
        ordered = rows.repartitionByRange("place", "vec_id").sortWithinPartitions("place", "vec_id").drop("place")
        return materialise(ordered.mapInArrow(released(_chunks(self.dims)), _CHUNK), "chunks")

    def tiles(self, chunks: DataFrame, same: bool) -> DataFrame:
        """The blocks that the anchors of each chunk need by the zone maps; every zone map streams past every chunk, blocks are not read."""
        blank = F.lit(None).cast("binary")
        count = self.zones.agg(F.max("zone")).first()[0]
        pairs = chunks.select("chunk", F.explode(F.sequence(F.lit(0), F.lit(count))).alias("zone"))
        maps = pairs.join(self.zones, "zone").select("chunk", F.lit(1).alias("kind"), "ids", blank.alias("labels"), "v", blank.alias("homes"), blank.alias("slots"))
        stream = chunks.select("chunk", F.lit(0).alias("kind"), "ids", "labels", "v", "homes", "slots").unionByName(maps)
        stream = stream.repartition("chunk").sortWithinPartitions("chunk", "kind")
        return materialise(stream.mapInArrow(released(_chosen(self.dims, same)), _TILE), "tiles")

    def search(self, chunks: DataFrame, tiles: DataFrame, same: bool, k: int) -> DataFrame:
        """(anchor_id, slot, vec_id, score): the k best of each search, those within the chosen blocks."""
        spark = chunks.sparkSession
        met = tiles.agg(F.countDistinct("chunk").alias("chunks"), F.countDistinct("block").alias("blocks"), F.min("block").alias("lo"), F.max("block").alias("hi")).first()
        parts = max(1, min(met["blocks"], -(-4 * spark.sparkContext.defaultParallelism // max(1, met["chunks"]))))
        tiles = tiles.withColumn("part", F.pmod(F.xxhash64("block"), F.lit(parts)))
        blank = F.lit(None).cast("binary")
        read = self.blocks.where(F.col("block").between(met["lo"] or 0, met["hi"] or 0)).select("block", "ids", "labels", "v")
        needed = tiles.join(read, "block").select("chunk", "part", F.lit(1).alias("kind"), "ids", "labels", "v", blank.alias("homes"), F.col("need").alias("slots"))
        heads = tiles.select("chunk", "part").distinct().join(chunks, "chunk").select("chunk", "part", F.lit(0).alias("kind"), "ids", "labels", "v", "homes", "slots")
        stream = heads.unionByName(needed).repartition("chunk", "part").sortWithinPartitions("chunk", "part", "kind")
        found = materialise(stream.mapInArrow(released(_searched(self.dims, same, k)), _FOUND), "found")
        first = F.row_number().over(Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "vec_id"))
        return found.withColumn("rank", first).where(F.col("rank") <= k)


def index(embeddings: DataFrame, every: int = 100, positives: int = POSITIVES) -> Index:
    """Candidate blocks of all rows that take part (see vectors()), written as Parquet with small row groups; anchors are the rows whose vec_id is divisible by `every`."""
    light_batches(embeddings.sparkSession)
    rows, dims = vectors(embeddings)
    rows = materialise(on_curve(rows, dims), "on-curve")
    ordered = rows.repartitionByRange("place", "vec_id").sortWithinPartitions("place", "vec_id").select("vec_id", "label", "v")
    path = new_path(embeddings.sparkSession, "blocks")
    ordered.mapInArrow(released(_blocks(dims, every, positives)), _BLOCK).write.option("parquet.block.size", 8 * BLOCK_BYTES).parquet(path)
    blocks = embeddings.sparkSession.read.schema(_BLOCK).parquet(path)
    zones = blocks.select("block", "label_low", "label_high", "low", "high").repartitionByRange("block").sortWithinPartitions("block").mapInArrow(_zones, "ids binary, v binary")
    zones = materialise(zones, "zone-maps")
    zones = materialise(zones.withColumn("zone", F.row_number().over(Window.orderBy(F.xxhash64("ids"))) - 1), "zones")
    anchors = blocks.select(F.col("block").alias("home"), F.explode(F.arrays_zip("anchors", "floors")).alias("a")).select(F.col("a.anchors").alias("vec_id"), "home", F.col("a.floors").alias("floor"))
    return Index(blocks, zones, rows, materialise(anchors, "anchors", compact=True), dims)


def hard_negatives(embeddings: DataFrame, every: int = 100, positives: int = POSITIVES, negatives: int = NEGATIVES, window: tuple[int, int] = WINDOW) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Scores are integer inner products. An anchor (vec_id divisible by `every`) has its best other rows of the same label as positives;
    for each of them come the best rows of other labels whose score is within the window, in hundredths of the positive's.
    Higher scores come first, ties by smaller vec_id. What takes part is said at vectors().

    1. Candidates are sorted along a Hilbert curve and written in Parquet blocks with the least and largest value of
       each dimension (zone maps).
    2. Interval arithmetic on the zone maps bounds the scores an anchor can have with a block. A block is read for an anchor
       only if the bounds meet its windows and reach its floor: the k-th best of the block it stands in, which is searched first.
    3. Chunks of anchors meet the chosen blocks in a stream, so a task holds one chunk and one block; the best of each
       part are merged.

    An empty table, or one where no row takes part, gives an empty result.
    """
    at = index(embeddings, every, positives)
    number = lambda x: F.lit(x).cast("bigint")
    chunks = at.chunks(at.anchors.select("vec_id", F.array(number(NONE), number(-NONE), F.col("floor")).alias("slots")))
    best = at.search(chunks, at.tiles(chunks, True), True, positives)
    best = materialise(best.select("anchor_id", F.col("rank").alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives", compact=True)

    def searches(floors: DataFrame | None) -> DataFrame:
        low, high = F.expr(f"({window[0]} * positive_score + 99) div 100"), F.expr(f"{window[1]} * positive_score div 100")
        rows = best.join(floors, ["anchor_id", "place"], "left") if floors is not None else best.withColumn("floor", number(NONE))
        some = F.col("positive_score") >= 0
        slot = F.struct("place", F.when(some, low).otherwise(number(1)).alias("low"), F.when(some, high).otherwise(number(0)).alias("high"), F.coalesce("floor", number(NONE)).alias("floor"))
        slots = F.array_sort(F.collect_list(slot))
        full = F.concat(F.flatten(F.transform(slots, lambda s: F.array(s["low"], s["high"], s["floor"]))), F.flatten(F.array_repeat(F.array(number(1), number(0), number(NONE)), positives - F.size(slots))))
        return rows.groupBy(F.col("anchor_id").alias("vec_id")).agg(full.alias("slots"))

    chunks = at.chunks(searches(None))
    near = at.search(chunks, materialise(chunks.mapInArrow(released(_homes(at.dims)), _TILE), "homes"), False, negatives)
    floors = near.where(F.col("rank") == negatives).select("anchor_id", (F.col("slot") + 1).alias("place"), F.col("score").alias("floor"))
    chunks = at.chunks(searches(materialise(floors, "floors", compact=True)))
    found = at.search(chunks, at.tiles(chunks, False), False, negatives)
    found = found.select("anchor_id", (F.col("slot") + 1).alias("place"), F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), F.col("score").alias("negative_score"))
    return found.join(best, ["anchor_id", "place"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", moved))


SQL = """
WITH d AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, d.vec_id, a.label = d.label AS same, list_dot_product(a.v, d.v)::BIGINT AS score
  FROM d a JOIN d ON a.vec_id <> d.vec_id WHERE a.vec_id % 100 = 0),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank, s.vec_id AS negative_id,
       positive_score, s.score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score
QUALIFY rank <= 10
"""

QUERIES = {"op11_hard_negatives": op11_hard_negatives}
ORACLES = {"op11_hard_negatives": SQL}
