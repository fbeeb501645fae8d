"""Exact Jaccard self-join of word n-gram sets, size-aware: subsets for small sets, inverted lists for large ones."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb, log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from tracewright.llm.common import BROADCAST_ROWS, anti_by_id, light_batches, materialise, released, salted_join, semi_by_id, table
from tracewright.llm.words import BLANK, mix, shingles, words
from tracewright.operators.graph import components as graph_components

#: Tokens that are counted together in a task before frequent ones are passed on.
COUNT_TOKENS = 2_000_000
#: Tokens in the broadcast table of frequent tokens (16 bytes each). Where more have long lists, those lists are counted and dealt out by a join.
FREQUENT_TOKENS = 400_000
#: Rows of one list above which it is dealt out to several tasks.
LIST_ROWS = 4_000
#: A salted subset list's number is lower by SALT for each salt; subsets are smaller than SALT.
SALT = 1_000


def overlap(n: int, m: int, percent: int) -> int:
    """Least intersection with which sets of n and m tokens reach the similarity."""
    return -(-percent * (n + m) // (100 + percent))


def deletions(n: int, light: int, percent: int) -> set[int]:
    """How many tokens a set of n may lack in a shared subset, over all partners where the smaller set is light."""
    low, high = -(-percent * n // 100), 100 * n // percent
    return {n - o for m in range(max(1, low), high + 1) if min(n, m) <= light and (o := overlap(n, m, percent)) <= min(n, m)}


def light_bound(percent: int, list_rows: float) -> int:
    """Largest set size for which enumerating subsets costs no more than scanning lists.

    Enumeration sends one row for each subset; scanning sends one row for each prefix token, and each row
    meets list_rows others (the measured size of a list as a token sees it), which are then compared.
    """
    n = 1
    while n < 64 and sum(comb(n, k) for k in deletions(n, n, percent)) <= (n - -(-percent * n // 100) + 1) * (1 + list_rows):
        n += 1
    return n - 1


_SIGNED = lambda a: pa.array(np.ascontiguousarray(a, np.uint64).view(np.int64))


def _set_id(s: np.ndarray, bits: int) -> bytes:
    """A set's id: two 64-bit sums of its tokens; the first one cut to `bits` bits (less than 64 only to force equal ones in tests)."""
    return (int(mix(s, 1).sum(dtype=np.uint64)) & ((1 << bits) - 1)).to_bytes(8, "big") + int(mix(s, 2).sum(dtype=np.uint64)).to_bytes(8, "big")


def _sketch(s: np.ndarray) -> bytes:
    """Tokens per bucket (256 buckets, 255 at most). Between two sets the counts differ by no more in all than the sets do."""
    return np.minimum(np.bincount((s >> np.uint64(56)).astype(np.int64), minlength=256), 255).astype(np.uint8).tobytes()


def _close(percent: int):
    """Pairs (a, b) whose sketches do not rule out the similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, 256).astype(np.int16) for k in (4, 5))
            both = np.asarray(batch.column(2)) + np.asarray(batch.column(3))
            keep = np.abs(left - right).sum(axis=1, dtype=np.int64) * (100 + percent) <= both * (100 - percent)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return run


def _survey(width: int, letters, bits: int):
    """Rows (0, doc_id, n, set id) of documents and (1, token, count) of tokens met twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, seen = [], 0, set()

        def tokens():
            nonlocal held, size, seen
            if held:
                token, n = np.unique(np.concatenate(held), return_counts=True)
                token, n = token[n > 1], n[n > 1].astype(np.int64)
                held, size, seen = [], 0, set()
                if len(n):
                    z = np.zeros(len(n), np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(z + 1), _SIGNED(token), pa.array(n), pa.nulls(len(z), pa.binary()), pa.nulls(len(z), pa.binary())], names=_SURVEY)

        for batch in batches:
            names, n, sketches = [], [], []
            for w in words(batch.column(1), letters):
                for _, s, _ in shingles(w, width):
                    cid = _set_id(s, bits)
                    names.append(cid)
                    n.append(len(s))
                    sketches.append(_sketch(s))
                    if len(s) and cid not in seen:
                        seen.add(cid)
                        held.append(s)
                        size += len(s)
                if size >= COUNT_TOKENS:
                    yield from tokens()
            if n:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.zeros(len(n), np.int64)), batch.column(0), pa.array(n, pa.int64()), pa.array(names, pa.binary()), pa.array(sketches, pa.binary())], names=_SURVEY
                )
        yield from tokens()

    return run


_SURVEY = ["kind", "id", "n", "cid", "sketch"]


def _salted(df: np.ndarray, cid: bytes, list_rows: int) -> np.ndarray:
    """The salt + 1 of lists whose tokens occur df times, 0 where a list needs none."""
    parts = df // list_rows + 1
    return np.where(parts > 1, (np.uint64(int.from_bytes(cid[8:], "big")) % parts.astype(np.uint64)).astype(np.int64) + 1, 0)


def _entries(width: int, letters, percent: int, light: int, frequent, bits: int, list_rows: int):
    """List rows of each distinct set: prefix tokens of heavy sets, subset hashes of light ones.

    A row is (token, list, cid, place). A token list has list 0, or the salt + 1 if its token is frequent;
    a subset list has minus the subset's size, less SALT for each salt: it can hold no more sets than its least
    frequent token, so only subsets of frequent tokens are salted. place holds the set's size and, below,
    the token's position in the set's order. The order puts frequent tokens last and, before them, long ones
    first: long words are rare words, and the order must only depend on the token.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, counts = frequent.value
        seen: set[bytes] = set()
        bridge = 100 * light // percent  # the largest set that can meet a light one
        for batch in batches:
            for w in words(batch.column(0), letters):
                out: list[tuple] = []
                for _, s, long in shingles(w, width):
                    n = len(s)
                    if not n:
                        continue
                    cid = _set_id(s, bits)
                    if cid in seen:
                        continue
                    if len(seen) < 500_000:
                        seen.add(cid)
                    at = np.minimum(np.searchsorted(names, s), max(len(names) - 1, 0))
                    df = np.where(names[at] == s, counts[at], 0) if len(names) else np.zeros(n, np.int64)
                    if n <= bridge:
                        m = mix(s, 3)
                        total = m.sum(dtype=np.uint64)
                        for k in deletions(n, light, percent):
                            gone = list(combinations(range(n), k))
                            less = [m[list(c)].sum(dtype=np.uint64) for c in gone] if k else [np.uint64(0)]
                            key = mix(total - np.array(less, np.uint64), 1000 + n - k)
                            salt = np.zeros(len(key), np.int64)
                            if np.partition(df, min(k, n - 1))[min(k, n - 1)] >= list_rows:
                                salt = _salted(np.array([np.delete(df, c).min(initial=df.max()) for c in gone]), cid, list_rows)
                            out.append((key, k - n - SALT * salt, cid, np.full(len(key), n << 32)))
                    if n > light:
                        length = n - -(-percent * n // 100) + 1
                        order = np.lexsort((s, -long, df))[:length]
                        out.append((s[order], _salted(df[order], cid, list_rows), cid, (n << 32) + np.arange(length)))
                if out:
                    cids = pa.array([x[2] for x in out], pa.binary()).take(pa.array(np.repeat(np.arange(len(out)), [len(x[0]) for x in out])))
                    join = lambda i: np.concatenate([x[i] for x in out])  # noqa: B023, E731
                    yield pa.RecordBatch.from_arrays([_SIGNED(join(0)), pa.array(join(1).astype(np.int64)), cids, pa.array(join(3).astype(np.int64))], names=["token", "list", "cid", "place"])

    return run


def _sets(width: int, letters, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in words(batch.column(0), letters):
                sets = [s for _, s, _ in shingles(w, width) if len(s)]
                if sets:
                    ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
                    cids = pa.array([_set_id(s, bits) for s in sets], pa.binary())
                    yield pa.RecordBatch.from_arrays([cids, pa.ListArray.from_arrays(pa.array(ends), _SIGNED(np.concatenate(sets)))], names=["cid", "tokens"])

    return run


def _with_ids(width: int, letters, bits: int):
    """Whole rows with the id of their text's set, null for an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cids: list[bytes | None] = [None] * len(batch)
            for w in words(batch.column(batch.schema.names.index("text")), letters):
                for row, s, _ in shingles(w, width):
                    if len(s):
                        cids[row] = _set_id(s, bits)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cids, pa.binary())], names=[*batch.schema.names, "__set"])

    return run


def _reaches(a: Column, b: Column, common: Column, percent: int) -> Column:
    return 100 * common >= percent * (a + b - common)


def _may_link(x: str, y: str, percent: int) -> Column:
    """Bounds that every linking pair passes at its first common token: sizes, and what is left of both sets there."""
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    left = F.least(n - F.col(f"{x}.pos"), m - F.col(f"{y}.pos"))
    return (100 * F.least(n, m) >= percent * F.greatest(n, m)) & _reaches(n, m, left, percent)


def _band(n: str, percent: int) -> Column:
    """Number of a size band; the sizes of two sets that link are in one band or in bands side by side."""
    return F.floor(F.log(F.col(n).cast("double")) / max(1.001 * log(100 / percent), 1e-3)).cast("int")


def components(links: DataFrame) -> DataFrame:
    return graph_components(links.select(F.col("a").alias("src"), F.col("b").alias("dst")))


def _verified(rows: DataFrame, first_doc: DataFrame, pairs: DataFrame, sets_of, percent: int, tag: str) -> DataFrame:
    """Those of the pairs (a, b) whose sets reach the similarity; counted on the whole sets.

    Pairs whose token counts per bucket differ by more than the similarity allows go first. Only documents
    that stand in one of the other pairs are read and hashed again. The pairs of a centre with very many members are dealt
    to many tasks, each of which gets the centre's sketch or set.
    """
    pairs = materialise(pairs, f"{tag}-candidates", compact=True)
    total = pairs.count()
    sketch = lambda end, n, s: first_doc.select(F.col("cid").alias(end), F.col("n").alias(n), F.col("sketch").alias(s))
    both = lambda left, right: salted_join(salted_join(pairs, left, "a", total=total), right, "b", total=total, counted=pairs)
    sketched = both(sketch("a", "n", "left"), sketch("b", "m", "right")).select("a", "b", "n", "m", "left", "right")
    pairs = materialise(sketched.mapInArrow(released(_close(percent)), "a binary, b binary"), f"{tag}-pairs", compact=True)
    total = pairs.count()
    ids = pairs.select(F.col("a").alias("cid")).unionByName(pairs.select(F.col("b").alias("cid"))).distinct()
    needed = materialise(first_doc.join(ids, "cid", "left_semi").select("doc_id"), f"{tag}-needed", compact=True)
    sets = semi_by_id(rows, needed, "doc_id").select("text").mapInArrow(sets_of, "cid binary, tokens array<bigint>")
    sets = materialise(sets, f"{tag}-sets")
    counted = both(sets.select(F.col("cid").alias("a"), F.col("tokens").alias("left")), sets.select(F.col("cid").alias("b"), F.col("tokens").alias("right")))
    counted = counted.select("a", "b", F.size("left").alias("n"), F.size("right").alias("m"), F.size(F.array_intersect("left", "right")).alias("common"))
    links = counted.where(_reaches(F.col("n"), F.col("m"), F.col("common"), percent)).select("a", "b").distinct()
    return materialise(links, f"{tag}-links", compact=True)


def _frequent_tokens(survey: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, float, int]:
    """The most frequent tokens with counts (`most` at most), the list size as a token sees it, and the count from which on a token is in the table."""
    counts = materialise(survey.where("kind = 1").groupBy("id").agg(F.sum("n").alias("df")), "token-counts", compact=True)
    by_power = sorted((r["p"], r["c"], r["s"]) for r in counts.groupBy(F.floor(F.log2("df")).alias("p")).agg(F.count(F.lit(1)).alias("c"), F.sum("df").alias("s")).collect())
    least, room = 64, most
    for p, c, _ in reversed(by_power):
        room -= c
        if room < 0:
            least = max(least, 2 ** (p + 1))
            break
    top = counts.where(F.col("df") >= least).select("id", "df").toPandas().sort_values("id")
    names, df = top["id"].to_numpy(np.int64).view(np.uint64), top["df"].to_numpy(np.int64)
    order = np.argsort(names)
    rare = [(c, s) for p, c, s in by_power if 2**p < least]
    return names[order], df[order], sum(s for _, s in rare) / max(1, sum(c for c, _ in rare)), least


def _dealt(entries: DataFrame, list_rows: int) -> DataFrame:
    """List rows where every list with more than list_rows rows that is still whole is dealt out by salt; the counts are a joined table, broadcast only if small."""
    entries = materialise(entries, "entries")
    whole = (F.col("list") <= 0) & (F.col("list") > -SALT)
    long = entries.where(whole).groupBy("token", "list").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > list_rows)
    long = materialise(long.select("token", "list", F.floor(F.col("rows") / list_rows + 1).alias("parts")), "long-lists", compact=True)
    long = F.broadcast(long) if long.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else long
    salt = F.pmod(F.xxhash64("cid"), F.col("parts")) + 1
    dealt = F.when(F.col("parts").isNull(), F.col("list")).when(F.col("list") < 0, F.col("list") - SALT * salt).otherwise(salt)
    return entries.join(long, ["token", "list"], "left").select("token", dealt.alias("list"), "cid", "place")


@dataclass
class Sets:
    """What a join leaves behind: rows (doc_id, n, cid) and (cid, component, component_id) of classes, and how to name the set of a text."""

    members: DataFrame
    classes: DataFrame
    with_ids: Callable


def _joined(docs: DataFrame, width: int, percent: int, letters, bits: int, list_rows: int = LIST_ROWS, frequent_tokens: int = FREQUENT_TOKENS) -> Sets:
    """See ngram_components."""
    spark = docs.sparkSession
    light_batches(spark)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text"))
    survey = materialise(rows.mapInArrow(released(_survey(width, letters, bits)), "kind bigint, id bigint, n bigint, cid binary, sketch binary"), "survey")
    members = survey.where("kind = 0").select(F.col("id").alias("doc_id"), "n", "cid", "sketch")
    names, df, seen_rows, least = _frequent_tokens(survey, frequent_tokens)
    light = light_bound(percent, seen_rows)
    frequent = spark.sparkContext.broadcast((names, df))

    entries = rows.where("doc_id is not null").select("text").mapInArrow(
        released(_entries(width, letters, percent, light, frequent, bits, list_rows)), "token bigint, list bigint, cid binary, place bigint"
    )
    if least > list_rows:  # tokens outside the table may have long lists
        entries = _dealt(entries, list_rows)
    # Lists of two or more sets, each row with the list's centre: the smallest set of a subset list, else the set with most left after pos.
    n, pos = F.shiftright("place", 32).cast("int"), F.col("place").bitwiseAND(F.lit((1 << 32) - 1)).cast("int")
    rank = F.struct(F.when(F.col("list") < 0, n).otherwise(pos - n).alias("rank"), F.col("cid").alias("cid"), n.alias("n"), pos.alias("pos"))
    w = Window.partitionBy("token", "list")
    salted = (F.col("list") > 0) | (F.col("list") <= -SALT)
    listed = (
        entries.withColumn("centre", F.min(rank).over(w)).withColumn("far", F.max("cid").over(w)).withColumn("near", F.min("cid").over(w))
        .where((F.col("near") != F.col("far")) | salted).select("token", "list", "cid", n.alias("n"), pos.alias("pos"), "centre")
        .distinct()  # copies met in different tasks; the rows of a list are together already
    )
    listed = materialise(listed, "lists")
    # The parts of a list that was dealt out take one centre; such lists belong to frequent tokens, so they are few.
    whole = listed.where(salted).groupBy(F.col("token").alias("dealt")).agg(F.min("centre").alias("head"))
    whole = F.broadcast(whole) if whole.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else whole
    listed = listed.join(whole, (F.col("token") == F.col("dealt")) & salted, "left").withColumn("centre", F.coalesce("head", "centre")).drop("head", "dealt")
    named = members.where("doc_id IS NOT NULL").groupBy("cid").agg(F.min(F.struct("doc_id", "n", "sketch")).alias("r"))
    first_doc = materialise(named.select("cid", "r.*"), "classes", compact=True)

    near = F.when(F.col("x.list") < 0, _reaches(F.col("x.n"), F.col("x.centre.n"), F.pmod(-F.col("x.list"), F.lit(SALT)), percent)).otherwise(
        (100 * F.least("x.n", "x.centre.n") >= percent * F.greatest("x.n", "x.centre.n"))
        & _reaches(F.col("x.n"), F.col("x.centre.n"), F.least(F.col("x.n") - F.col("x.pos"), F.col("x.centre.n") - F.col("x.centre.pos")), percent)
    )
    stars = listed.alias("x").where("x.cid <> x.centre.cid").where(near).select(F.least("x.cid", "x.centre.cid").alias("a"), F.greatest("x.cid", "x.centre.cid").alias("b")).distinct()
    sets_of = released(_sets(width, letters, bits))
    links = _verified(rows, first_doc, stars, sets_of, percent, "star")
    grouped = materialise(components(links), "groups", compact=True)

    # Token lists that still hold sets of different components.
    open_ = listed.where("list >= 0").select("token", "cid", "n", "pos", F.col("centre.cid").alias("centre"))
    open_ = open_.join(grouped.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    open_ = materialise(open_, "open")
    mixed = (
        open_.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("rows"))
        .where("lo <> hi and rows > 2").select("token", (F.col("rows") / list_rows).cast("int").alias("more"))
    )
    open_ = salted_join(open_, mixed, "token").withColumn("parts", F.col("more") + 1).withColumn("band", _band("n", percent))
    # The smaller set of a pair stands in the other's size band or the one below; so far sizes never meet.
    left = open_.withColumn("part", F.pmod(F.xxhash64("cid"), F.col("parts"))).withColumn("band", F.explode(F.array(F.col("band"), F.col("band") + 1)))
    right = open_.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts").cast("bigint") - 1)))
    rest = (
        left.alias("x").join(
            right.alias("y"),
            (F.col("x.token") == F.col("y.token")) & (F.col("x.part") == F.col("y.part")) & (F.col("x.band") == F.col("y.band")) & (F.struct("x.n", "x.cid") < F.struct("y.n", "y.cid"))
            & (F.col("x.component") != F.col("y.component")) & (F.col("x.cid") != F.col("x.centre")) & (F.col("y.cid") != F.col("x.centre"))
            & _may_link("x", "y", percent),
        ).select(F.least("x.cid", "y.cid").alias("a"), F.greatest("x.cid", "y.cid").alias("b")).distinct()
    )
    more = _verified(rows, first_doc, rest, sets_of, percent, "more")
    if more.limit(1).count():
        star = grouped.select(F.col("node").alias("a"), F.col("component").alias("b"))
        grouped = materialise(components(star.unionByName(more)), "groups", compact=True)

    classes = first_doc.select("cid", "doc_id").join(grouped.withColumnRenamed("node", "cid"), "cid", "left").withColumn("component", F.coalesce("component", "cid"))
    first = classes.groupBy("component").agg(F.min(F.struct(F.col("doc_id").alias("component_id"), F.col("cid").alias("kept"))).alias("first"))
    by_class = classes.select("cid", "component").join(first, "component").select("cid", "first.component_id", "first.kept")
    return Sets(members.select("doc_id", "n", "cid"), by_class, _with_ids(width, letters, bits))


def ngram_components(docs: DataFrame, width: int = 3, percent: int = 90, letters=BLANK, bits: int = 64, list_rows: int = LIST_ROWS, frequent_tokens: int = FREQUENT_TOKENS) -> DataFrame:
    """doc_id, n_shingles, component_id for every row of docs.

    A document's set holds its distinct word shingles; documents whose sets have a Jaccard similarity of
    at least percent / 100 are linked, and component_id is the smallest doc_id reachable by links.

    1. One pass hashes the shingles to 64 bits, folds equal sets into one class and finds tokens that
       are frequent in the corpus. A class is named by two 64-bit sums of its tokens.
    2. A second pass emits list rows. Light sets (size up to a bound where subset enumeration is
       cheaper than scanning, from the measured list size) emit the hash of each fixed-size subset
       through which a link can run. Heavy sets emit their prefix tokens, frequent tokens last.
    3. Lists with one set are dropped. In every other list all sets are compared with one centre only
       (the least disturbed one); components of those links join what belongs together, so a group of k
       near copies costs k comparisons. In subset lists the centre is enough. In token lists
       pairs that are still in different components are compared too, if they are in one size band or in bands side by
       side and their positions allow a link.
    4. Every candidate is verified by intersecting the whole sets. Lists of frequent tokens are
       dealt out by salt; so are the pairs of a centre that has very many.

    Equality of shingles is equality of 64-bit hashes. Null or blank text has an empty set: n_shingles
    0, component_id its own doc_id. Rows with a null doc_id take no part in links and get their
    n_shingles and a null component. Rows of one doc_id with different texts are classes of their own and are
    each returned with their own component. Repeated rows are returned as often as they occur. Other columns of
    docs are ignored; an empty table gives an empty result. bits narrows the first sum, list_rows the parts of dealt lists and frequent_tokens
    the broadcast table, for tests; lists of frequent tokens outside that table are counted and dealt out by a join.
    """
    sets = _joined(docs, width, percent, letters, bits, list_rows, frequent_tokens)
    return salted_join(sets.members, sets.classes, "cid", how="left").select(
        "doc_id", F.col("n").alias("n_shingles"),
        F.when((F.col("n") == 0) | F.col("doc_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
    )


def drop_near_copies(docs: DataFrame, width: int = 5, percent: int = 80, letters=BLANK, bits: int = 64) -> DataFrame:
    """docs with one document of each component: the one with the smallest doc_id (of that, the first class); columns unchanged.

    Rows, not ids, are judged: where one doc_id stands on several texts, each text stays or goes with its own
    component, and rows with equal doc_id and equal set are reduced to one. Rows without words stay, as do rows with a null doc_id.
    """
    sets = _joined(docs, width, percent, letters, bits)
    verdicts = salted_join(sets.members.where("n > 0 AND doc_id IS NOT NULL"), sets.classes, "cid").select("doc_id", "cid", ((F.col("doc_id") != F.col("component_id")) | (F.col("cid") != F.col("kept"))).alias("lost"))
    verdicts = materialise(verdicts, "near-copies", compact=True)
    losers = verdicts.where("lost")
    if not verdicts.groupBy("doc_id").count().where("count > 1").limit(1).count():
        return anti_by_id(docs, losers.select("doc_id"), "doc_id").select(docs.columns)
    named = docs.mapInArrow(sets.with_ids, StructType([*docs.schema.fields, StructField("__set", BinaryType())]))
    lost = losers.select(F.col("doc_id").alias("__doc"), F.col("cid").alias("__lost")).distinct()
    left = named.join(lost, (F.col("doc_id") == F.col("__doc")) & (F.col("__set") == F.col("__lost")), "left_anti")
    free = F.col("__set").isNull() | F.col("doc_id").isNull()
    return left.where(free).unionByName(left.where(~free).dropDuplicates(["doc_id", "__set"])).select(docs.columns)


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_components(table(spark, sf_dir, "documents"))


SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
        ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM d),
sets AS (SELECT doc_id, len(g) AS n, md5(array_to_string(list_sort(g), chr(1))) AS h, g FROM s),
reps AS (SELECT min(doc_id) AS rep, h, any_value(n) AS n, any_value(g) AS g FROM sets WHERE n > 0 GROUP BY h),
t AS (SELECT rep, n, unnest(g) AS x FROM reps),
rare AS (SELECT x FROM t GROUP BY x HAVING count(*) > 1),
u AS (SELECT t.* FROM t JOIN rare USING (x)),
pairs AS (SELECT a.rep AS a, b.rep AS b FROM u a JOIN u b ON a.x = b.x AND a.rep < b.rep AND 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
          GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
r(node, seen) AS (SELECT rep, rep FROM reps UNION SELECT e.b, r.seen FROM r JOIN e ON e.a = r.node),
c AS (SELECT node, min(seen) AS component FROM r GROUP BY node)
SELECT sets.doc_id, sets.n AS n_shingles, coalesce(c.component, sets.doc_id) AS component_id
FROM sets LEFT JOIN reps ON reps.h = sets.h AND sets.n > 0 LEFT JOIN c ON c.node = reps.rep
"""

QUERIES = {"op9_ngram_join": op9_ngram_join}
ORACLES = {"op9_ngram_join": SQL}
