"""Near-duplicate documents by SimHash: pivot distance tables find the pairs of fingerprints a few bits apart."""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import cache, reduce
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm.common import BROADCAST_ROWS, body, light_batches, materialise, released, salted_join, table
from tracewright.llm.words import mix
from tracewright.operators.graph import components

#: Reference fingerprints (pivots), 16 at most since the distances of a segment are packed into 64 bits.
PIVOTS = 16
#: Shingles whose hashes are held at a time.
SHINGLES = 32_768
#: A bucket of more fingerprints is first joined through centres, one for each of CENTRES parts of it.
HOT_BUCKET, CENTRES = 1_000, 8
_BLANKS = re.compile(rb"[\x20\x09-\x0D]+")


def fingerprint(text: str | None, width: int = 4) -> int:
    """The SimHash of a text: a bit is set if it is set in over half the XXH64 (seed 42) of its word shingles, repeats included.

    A-Z is lower-cased, words stand between ASCII white space and are joined by one space; fewer words than width
    are one shingle; null or blank text has fingerprint 0.
    """
    line = _BLANKS.sub(b" ", (text or "").encode("utf-8", "replace").lower()).strip(b" ")
    if not line:
        return 0
    blanks = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    ends = np.append(blanks, len(line))[min(width, len(blanks) + 1) - 1 :]
    starts = np.append(0, blanks + 1)[: len(ends)]
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(ends), SHINGLES):
        some = slice(at, at + SHINGLES)
        hashes = np.array([digest(line[a:b], 42) for a, b in zip(starts[some].tolist(), ends[some].tolist())], ">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(ends)).tobytes(), "big")


def _fingerprints(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), width) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return run


def references(pivots: int = PIVOTS) -> np.ndarray:
    """The reference fingerprints: scrambled counters, so unrelated to any text."""
    return mix(np.arange(1, pivots + 1, dtype=np.uint64), 64)


@cache
def _tables(segments: int, pivots: int) -> list[tuple[int, int, np.ndarray, np.ndarray]]:
    """For each segment of the 64 bits: shift, mask, and by segment value the distances to the pivots, as nibbles of one number and as bytes of two."""
    out, shift = [], 0
    for s in range(segments):
        size = 64 // segments + (s < 64 % segments)
        values = np.arange(1 << size, dtype=np.uint64)
        refs = (references(pivots) >> np.uint64(shift)) & np.uint64((1 << size) - 1)
        far = np.bitwise_count(values[:, None] ^ refs[None, :]).astype(np.uint64)
        nibbles = (far << np.arange(0, 4 * pivots, 4, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        wide = np.zeros((len(values), 2), np.uint64)
        for p in range(pivots):
            wide[:, p // 8] += far[:, p] << np.uint64(8 * (p % 8))
        out.append((shift, (1 << size) - 1, nibbles, wide))
        shift += size
    return out


def segment_count(rows: int, distance: int) -> int:
    """The number of segments for which rows and expected chance pairs are fewest together."""
    def cost(s: int) -> float:
        kept = sum(sorted(64 // s + (i < 64 % s) for i in range(s))[: s - distance])
        return comb(s, distance) * (rows + rows * rows / 2 / 2.0**kept)

    return min(range(max(5, distance + 1), distance + 7), key=cost)


def _filed(segments: int, distance: int, pivots: int):
    """Rows (key, fp, near, far) of each fingerprint: one for each choice of segments that may be untouched. The key is a
    hash of the choice and its segments' distances to all pivots; near and far hold the whole distances, a byte each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.asarray(batch.column(0)).view(np.uint64)
            codes, wide = [], np.zeros((len(fp), 2), np.uint64)
            for shift, most, nibbles, bytes_ in _tables(segments, pivots):
                value = (fp >> np.uint64(shift)) & np.uint64(most)
                codes.append(nibbles[value])
                wide += bytes_[value]
            keys = [mix(sum((mix(codes[s], s + 1) for s in kept), np.zeros(len(fp), np.uint64)), 100 + c) for c, kept in enumerate(combinations(range(segments), segments - distance))]
            number = lambda a: pa.array(np.ascontiguousarray(a).view(np.int64))
            many = lambda a: number(np.tile(a, len(keys)))
            yield pa.RecordBatch.from_arrays([number(np.concatenate(keys)), many(fp), many(wide[:, 0]), many(wide[:, 1])], names=["key", "fp", "near", "far"])

    return run


def _close(distance: int, pivots: int, x: str = "x", y: str = "y") -> Column:
    """No pivot's distances differ by more than `distance`, and neither do the fingerprints themselves."""
    at = lambda side, p: F.shiftright(f"{side}.{'near' if p < 8 else 'far'}", 8 * (p % 8)).bitwiseAND(F.lit(255))
    coordinates = reduce(lambda c, p: c & (F.abs(at(x, p) - at(y, p)) <= distance), range(1, pivots), F.abs(at(x, 0) - at(y, 0)) <= distance)
    return coordinates & (F.bit_count(F.col(f"{x}.fp").bitwiseXOR(F.col(f"{y}.fp"))) <= distance)


def _met(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Rows whose key is in groups, with its columns; broadcast only after the groups are counted."""
    few = groups.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(groups), "key") if few else salted_join(rows, groups, "key")


def near_fingerprints(distinct: DataFrame, distance: int = 4, pivots: int = PIVOTS) -> DataFrame:
    """(a, b), a < b: links between the distinct numbers fp of a table, enough to join all that are at most `distance` bits apart.

    1. Pivot table: each fingerprint's distances to the reference fingerprints are looked up by segment. The distance to a
       pivot is the sum of the segments' distances, and a segment without a differing bit has equal distances to all pivots.
    2. With s segments at least s - distance are untouched, so a pair that links agrees in all pivot coordinates of some
       choice of that many segments: this is the join key. s is chosen by cost, and only keys met twice go on.
    3. Pairs under one key whose whole distances to any pivot differ by more than `distance` are discarded (triangle
       inequality); the others are verified bit by bit.

    In buckets of more than HOT_BUCKET fingerprints all are first compared with a few centres; pairs that those links already
    put into one component are not met again, all others are. Every link between different components is found.
    """
    spark = distinct.sparkSession
    light_batches(spark)
    distinct = materialise(distinct.select("fp"), "fingerprints", compact=True)
    filed = distinct.mapInArrow(released(_filed(segment_count(distinct.count(), distance), distance, pivots)), "key bigint, fp bigint, near bigint, far bigint")
    groups = filed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = materialise(_met(filed, materialise(groups, "keys", compact=True)), "pivot-rows")
    pair = lambda a, b: [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]
    few = rows.where(F.col("n") <= HOT_BUCKET)
    links = few.alias("x").join(few.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.fp") < F.col("y.fp")) & _close(distance, pivots)).select(*pair("x.fp", "y.fp")).distinct()
    links = materialise(links, "near-links", compact=True)
    hot = rows.where(F.col("n") > HOT_BUCKET)
    if not hot.limit(1).count():
        return links
    centres = hot.groupBy("key", F.pmod(F.xxhash64("fp"), F.lit(CENTRES)).alias("part")).agg(F.min(F.struct("fp", "near", "far")).alias("c")).select("key", "c.*")
    centres = materialise(centres, "centres", compact=True)
    stars = salted_join(hot, centres.select("key", F.struct("fp", "near", "far").alias("y")), "key").select("y", F.struct("fp", "near", "far").alias("x"))
    stars = stars.where((F.col("x.fp") != F.col("y.fp")) & _close(distance, pivots)).select(*pair("x.fp", "y.fp")).distinct()
    links = materialise(links.unionByName(stars), "near-links", compact=True)
    parts = materialise(components(links.select(F.col("a").alias("src"), F.col("b").alias("dst"))), "near-parts", compact=True)
    hot = salted_join(hot, parts.select(F.col("node").alias("fp"), "component"), "fp", how="left").withColumn("component", F.coalesce("component", "fp"))
    hot = materialise(hot, "hot-rows")
    rest = hot.alias("x").join(
        hot.alias("y"), (F.col("x.key") == F.col("y.key")) & (F.col("x.fp") < F.col("y.fp")) & (F.col("x.component") != F.col("y.component")) & _close(distance, pivots)
    ).select(*pair("x.fp", "y.fp")).distinct()
    return links.unionByName(materialise(rest, "hot-links", compact=True))


def simhash_components(docs: DataFrame, width: int = 4, distance: int = 4, pivots: int = PIVOTS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of docs.

    Documents whose fingerprints (see fingerprint()) differ in at most `distance` bits are linked; component_id is the
    smallest doc_id reachable by links, itself included. Equal fingerprints are one class; only classes are compared,
    as in near_fingerprints().

    Null or blank text has fingerprint 0 and is linked like any other. Rows with a null doc_id get their fingerprint, link
    nothing and have a null component_id. Repeated rows are returned as often as they occur, and rows of one doc_id with
    different texts each with their own component. Other columns are ignored; an empty table gives an empty result.
    """
    light_batches(docs.sparkSession)
    prints = materialise(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), body().alias("text")).mapInArrow(released(_fingerprints(width)), "doc_id bigint, fp bigint"), "prints")
    classes = materialise(prints.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("first")), "classes", compact=True)
    links = near_fingerprints(classes, distance, pivots)
    parts = components(links.select(F.col("a").alias("src"), F.col("b").alias("dst"))).withColumnRenamed("node", "fp")
    classes = classes.join(parts, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = classes.groupBy("component").agg(F.min("first").alias("component_id"))
    named = materialise(classes.join(least, "component").select("fp", "component_id"), "named", compact=True)
    out = salted_join(prints, named, "fp", how="left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))


def op12_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(table(spark, sf_dir, "documents"))


QUERIES = {"op12_simhash": op12_simhash}
#: XXH64 has no form in SQL; the query is tested against all pairs.
ORACLES: dict[str, str] = {}
