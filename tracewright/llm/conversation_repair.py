"""Repair of conversation structure: turns are aligned to the alternating grammar at least cost, and each edit is audited."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.llm.common import light_batches, materialise, released, table

#: Costs of the edits; an undeleted truncated turn adds TRUNCATED.
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
#: Turns that are aligned at a time; longer conversations are put together from such blocks.
BLOCK = 16
#: Alignments of equal blocks that a worker remembers.
REMEMBERED = 100_000
#: States of the grammar (s?(ua)+)?: nothing yet, after the system turn, a user turn may follow, an assistant turn must follow.
START, SYSTEM, USER, ASSISTANT = range(4)
NEVER = 1 << 60
_ROLES = {"u": "user", "a": "assistant"}


def _align(turns: str, target: str, limit: int, last: bool) -> tuple[int, str] | None:
    """Least cost of aligning turns to a target string and the ASCII-least of its audits, or None beyond limit.

    turns holds a letter per turn: its role's initial (x for none that the grammar has), upper case if truncated, - if it must
    go. The Wagner-Fischer table of what is left to align holds only cells that a path within limit can pass (Ukkonen's
    band); it is walked forward by the least letter that stays on a cheapest path. Only the last block may end with inserted
    turns; elsewhere they begin the next block.
    """
    n, m = len(turns), len(target)
    least = lambda d: DELETE * d if d > 0 else -INSERT * d  # noqa: E731  to lose d turns
    rows: list[dict[int, int]] = [{} for _ in range(n + 1)]
    for i in range(n, -1, -1):
        here, below = rows[i], rows[i + 1] if i < n else {}
        turn = turns[i] if i < n else ""
        keep, late = turn.lower(), TRUNCATED * turn.isupper()
        for j in range(m, -1, -1):
            if least(i - j) + least((n - i) - (m - j)) > limit:
                continue
            best = 0 if i == n and j == m else NEVER
            if j < m and target[j] != "s" and (i < n or last):
                best = min(best, INSERT + here.get(j + 1, NEVER))
            if i < n:
                best = min(best, DELETE + below.get(j, NEVER))
                if j < m and turn != "-" and (keep == target[j] or target[j] != "s"):
                    best = min(best, (0 if keep == target[j] else REROLE) + late + below.get(j + 1, NEVER))
            if best < NEVER:
                here[j] = best
    if rows[0].get(0, NEVER) > limit:
        return None
    i, j, audit = 0, 0, []
    while i < n or j < m:
        left = rows[i][j]
        turn = turns[i] if i < n else "-"
        same = j < m and turn.lower() == target[j]
        if i < n and rows[i + 1].get(j, NEVER) + DELETE == left:
            i, letter = i + 1, "D"
        elif j < m and target[j] != "s" and (i < n or last) and rows[i].get(j + 1, NEVER) + INSERT == left:
            j, letter = j + 1, "I"
        else:
            i, j, letter = i + 1, j + 1, "K" if same else "R"
        audit.append(letter)
    return rows[0][0], "".join(audit)


def _end(state: int, length: int, system: bool) -> int:
    """The state after a target of so many letters from a state."""
    if not length:
        return state
    if system and length == 1:
        return SYSTEM
    flips = length - system + (state == ASSISTANT)
    return ASSISTANT if flips % 2 else USER


@lru_cache(REMEMBERED)
def _block(turns: str, state: int, last: bool) -> dict[int, tuple[int, str]]:
    """For each end state that a block can reach from a state: the least cost and its ASCII-least audit.

    Every feasible length of the alternating string is tried, nearest first; the best so far for an end state is the
    incumbent whose cost limits the band, and a length whose difference alone costs more is not feasible.
    """
    found: dict[int, tuple[int, str]] = {}
    n = len(turns)
    for system in (False, True) if state == START else (False,):
        for length in sorted(range(system, 3 * n + 4), key=lambda k: (abs(k - n), k)):
            end = _end(state, length, system)
            cost = found.get(end, (DELETE * n + INSERT * (3 + n),))[0]
            if DELETE * max(0, n - length) + INSERT * max(0, length - n) > cost:
                continue
            letters = "s" * system + "".join("au"[(k + (state != ASSISTANT)) % 2] for k in range(length - system))
            if (got := _align(turns, letters, cost, last)) and (end not in found or got < found[end]):
                found[end] = got
    return found


@dataclass
class Alignment:
    """The cheapest alignment of a conversation whose turns come one by one.

    Turns are aligned in blocks; for each state that a block can end in one cost, one piece of audit and one way back are
    kept, so memory is a few letters a turn. Audits of different states hold as many turns and end with one, so
    none begins with another, and ranks are enough to compare what lies before a block.
    """

    held: list[str] = field(default_factory=list)
    best: dict[int, tuple[int, int, int]] = field(default_factory=lambda: {START: (0, 0, -1)})  # cost, rank of the audit, node
    nodes: list[tuple[int, str]] = field(default_factory=list)  # node before, audit of the block

    def add(self, turn: str) -> None:
        if len(self.held) == BLOCK:
            self._close(False)
        self.held.append(turn)

    def _close(self, last: bool) -> None:
        turns, self.held = "".join(self.held), []
        ways: dict[int, tuple[int, int, str, int]] = {}
        for state, (cost, rank, node) in self.best.items():
            for end, (more, audit) in _block(turns, state, last).items():
                way = (cost + more, rank, audit, node)
                ways[end] = min(way, ways.get(end, way))
        order = sorted({(rank, audit) for _, rank, audit, _ in ways.values()})
        self.best = {}
        for end, (cost, rank, audit, node) in ways.items():
            self.nodes.append((node, audit))
            self.best[end] = (cost, order.index((rank, audit)), len(self.nodes) - 1)

    def result(self) -> tuple[int, str]:
        """Cost and audit; inserted turns may end it."""
        self._close(True)
        cost, _, node = min(way for end, way in self.best.items() if end in (START, USER))
        parts = []
        while node >= 0:
            node, part = self.nodes[node]
            parts.append(part)
        return cost, "".join(reversed(parts))


def letter(initial: str, fault: str | None) -> str:
    """A turn as the alignment sees it."""
    if fault in ("blank", "duplicate"):
        return "-"
    known = initial if initial in ("s", "u", "a") else "x"
    return known.upper() if fault == "truncated" else known


_PLAN = "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"


def _plans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each conversation; its turns come one after the other."""
    names = [c.split()[0] for c in _PLAN.split(", ")]
    done: list[list] = [[] for _ in names]
    now, align, stats = None, Alignment(), {}

    def close():
        cost, audit = align.result()
        gaps = stats["last"] - stats["first"] + 1 - stats["turns"] if stats["turns"] else 0
        for column, value in zip(done, [now[0], gaps, stats["blank"], stats["duplicate"], stats["truncated"], stats["illegal"], cost, audit]):
            column.append(value)

    def batch_of():
        types = [pa.int64()] * 7 + [pa.string()]
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(done, types)], names=names)
        for c in done:
            c.clear()
        return out

    for batch in batches:
        for conv, turn, initial, fault in zip(*(batch.column(k).to_pylist() for k in range(4))):
            if now is None or now[0] != conv:
                if now is not None:
                    close()
                now, align = (conv,), Alignment()
                stats = {"first": None, "last": None, "turns": 0, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "before": None}
            if turn is not None and turn != stats["last"]:
                stats["first"] = turn if stats["first"] is None else stats["first"]
                stats["last"], stats["turns"] = turn, stats["turns"] + 1
            if fault:
                stats[fault] += 1
            if stats["before"] is not None and stats["before"] + initial not in ("su", "ua", "au"):
                stats["illegal"] += 1
            stats["before"] = initial
            align.add(letter(initial, fault))
        if done[0]:
            yield batch_of()
    if now is not None:
        close()
        yield batch_of()


def faults(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text (nulls: one space) with initial and fault: blank, duplicate, truncated or null, the first that fits.

    Blank: no character but ASCII white space. Duplicate: role and text stand in an earlier turn. Truncated: the last
    character that is not white space is none of . ! ?
    """
    text = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    rows = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), text("role"), text("text"))
    core = F.rtrim("text", F.lit(" \t\n\x0b\x0c\r"))
    again = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy("turn")) > 1
    fault = F.when(core == "", "blank").when(F.col("again"), "duplicate").when(~F.substring(core, -1, 1).isin(".", "!", "?"), "truncated")
    return rows.withColumn("again", again).select("conv_id", "turn", "role", "text", F.substring("role", 1, 1).alias("initial"), fault.alias("fault"))


_ORDER = ["turn", "role", "text"]


def repair_plans(found: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit of each conversation in a table of faults().

    Turns are taken in the order of turn (nulls first), role, text; of equal ones the first is no duplicate. gaps: numbers missing between the least and the largest turn.
    illegal: neighbours whose roles' initials are not su, ua or au. audit: the letters of the cheapest edits in order (Keep,
    Rerole to user or assistant, Delete, Insert an empty turn of the user or the assistant) that make the roles'
    initials fit (s?(ua)+)?; of equally cheap ones the ASCII-least. Blank and duplicate turns must go. A role that is
    empty or begins with another letter cannot be kept.

    A conversation's turns stream through one task in order; kept are some letters a turn, never a text.
    """
    ordered = found.select("conv_id", "turn", "initial", "fault", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", *_ORDER, F.col("fault").eqNullSafe("duplicate"))
    return ordered.select("conv_id", "turn", "initial", "fault").mapInArrow(released(_plans), _PLAN)


_TURN = "conv_id bigint, place bigint, edit string, turn bigint, role string, text string"


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The turns that stay, from rows (conv_id, kind, turn, role, text): a conversation's audit (kind 0, in text), then its turns."""
    names = [c.split()[0] for c in _TURN.split(", ")]
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()]
    audit, at, place, expected = "", 0, 0, "u"
    for batch in batches:
        out: list[tuple] = []

        def put(conv, edit, turn, role, text):
            nonlocal place, expected
            out.append((conv, place, edit, turn, role, text))
            place += 1
            expected = "a" if role[:1] == "u" else "u"

        def inserted(conv):
            nonlocal at
            while at < len(audit) and audit[at] == "I":
                put(conv, "I", None, _ROLES[expected], "")
                at += 1

        for conv, kind, turn, role, text in zip(*(batch.column(k).to_pylist() for k in range(5))):
            if not kind:
                audit, at, place, expected = text, 0, 0, "u"
            else:
                edit, at = audit[at], at + 1
                if edit != "D":
                    put(conv, edit, turn, role if edit == "K" else _ROLES[expected], text)
            inserted(conv)
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)


def repaired_turns(found: DataFrame, plans: DataFrame) -> DataFrame:
    """conv_id, place, edit, turn, role, text of the turns that stand after repair, in order within a partition (one per conversation)."""
    rows = found.select("conv_id", F.lit(1).alias("kind"), "turn", "role", "text")
    rows = rows.unionByName(plans.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("bigint").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text")))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "kind", *_ORDER).mapInArrow(released(_edited), _TURN)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(conv_id, sha256 of the newline-joined role:text) of turns that come in order."""
    now, digest, done = None, None, []

    def batch_of():
        out = pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.string())], names=["conv_id", "repaired_sha256"])
        done.clear()
        return out

    for batch in batches:
        for conv, place, role, text in zip(*(batch.column(k).to_pylist() for k in range(4))):
            line = f"{role}:{text}".encode("utf-8", "replace")
            if place:
                digest.update(b"\n" + line)
                continue
            if digest:
                done.append((now, digest.hexdigest()))
            now, digest = conv, hashlib.sha256(line)
        if done:
            yield batch_of()
    if digest:
        done.append((now, digest.hexdigest()))
        yield batch_of()


def damaged(conversations: DataFrame) -> DataFrame:
    """Turns damaged by crc32 of conv_id:turn modulo 20: 0 drops a turn, 1 empties its text, 2 removes its . ! ?, 3 repeats it, 4 makes the user its speaker."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20
    rows = conversations.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    body = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", role.alias("role"), body.alias("text"), "kind")
    twice = rows.where("kind = 3")
    return rows.unionByName(twice).drop("kind")


def repaired_conversations(turns: DataFrame, conversations: DataFrame) -> DataFrame:
    """conv_id, the columns of repair_plans and repaired_sha256 (of the repaired role:text, newline-joined) for every conv_id of conversations.

    Conversations without turns: zeros, an empty audit and the hash of the empty string. A null conv_id is a conversation
    like any other; null roles and texts are one space, so such roles cannot be kept and such texts are blank. Repeated rows are
    duplicates. Other columns are ignored; empty tables give an empty result.
    """
    light_batches(turns.sparkSession)
    found = materialise(faults(turns), "turns")
    plans = materialise(repair_plans(found), "plans")
    digests = repaired_turns(found, plans).select("conv_id", "place", "role", "text").mapInArrow(released(_digests), "conv_id bigint, repaired_sha256 string")
    every = conversations.select(F.col("conv_id").cast("bigint").alias("id")).distinct()
    plans, digests = plans.withColumnRenamed("conv_id", "p"), digests.withColumnRenamed("conv_id", "d")
    out = every.join(plans, every["id"].eqNullSafe(plans["p"]), "left").join(digests, F.col("id").eqNullSafe(digests["d"]), "left")
    zero = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select(F.col("id").alias("conv_id"), *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    conversations = table(spark, sf_dir, "conversations")
    return repaired_conversations(damaged(conversations), conversations)


#: One turn at a time over the states of the grammar (0 start, 1 after the system turn, 2 user next, 3 assistant next).
SQL = r"""
WITH RECURSIVE base AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
keyed AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(k, ''), lambda c: ord(c)::BIGINT)), lambda h, c:
      list_reduce(list_prepend(xor(h, c), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT) % 20 AS kind FROM base),
rows_ AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
         CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM keyed, (VALUES (1), (2)) v(copy) WHERE kind <> 0 AND (copy = 1 OR kind = 3)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM rows_),
marked AS (
  SELECT *, substr(role, 1, 1) AS init, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS core,
         row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS seen FROM placed),
f AS (
  SELECT *, CASE WHEN core = '' THEN 'blank' WHEN seen > 1 THEN 'duplicate' WHEN right(core, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS fault,
         lag(init) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM marked),
stats AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
         count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before IS NOT NULL AND before || init NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM f GROUP BY conv_id),
ins(q, q2, cost, audit, made) AS (VALUES
  (0, 0, 0, '', ''), (1, 1, 0, '', ''), (2, 2, 0, '', ''), (3, 3, 0, '', ''), (0, 3, 3, 'I', chr(10) || 'user:'), (1, 3, 3, 'I', chr(10) || 'user:'), (2, 3, 3, 'I', chr(10) || 'user:'),
  (3, 2, 3, 'I', chr(10) || 'assistant:'), (0, 2, 6, 'II', chr(10) || 'user:' || chr(10) || 'assistant:'), (1, 2, 6, 'II', chr(10) || 'user:' || chr(10) || 'assistant:')),
op(q, q2, edit) AS (VALUES (0, 0, 'D'), (1, 1, 'D'), (2, 2, 'D'), (3, 3, 'D'), (0, 1, 'S'), (0, 3, 'U'), (1, 3, 'U'), (2, 3, 'U'), (3, 2, 'A')),
walk(conv_id, i, q, b) AS (
  SELECT conv_id, 0::BIGINT, 0, {'cost': 0, 'audit': '', 'made': ''} FROM stats
  UNION ALL
  SELECT w.conv_id, w.i + 1, op.q2, min({
      'cost': b.cost + ins.cost + CASE WHEN edit = 'D' THEN 4 ELSE (CASE WHEN f.init = lower(edit) THEN 0 ELSE 3 END) + (CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END) END,
      'audit': b.audit || ins.audit || CASE WHEN edit = 'D' THEN 'D' WHEN f.init = lower(edit) THEN 'K' ELSE 'R' END,
      'made': b.made || ins.made || CASE WHEN edit = 'D' THEN '' ELSE chr(10) || CASE WHEN f.init = lower(edit) THEN role WHEN edit = 'U' THEN 'user' ELSE 'assistant' END || ':' || text END})
  FROM walk w JOIN f ON f.conv_id IS NOT DISTINCT FROM w.conv_id AND f.i = w.i + 1 JOIN ins ON ins.q = w.q JOIN op ON op.q = ins.q2
  WHERE edit = 'D' OR fault NOT IN ('blank', 'duplicate') AND (edit <> 'S' OR f.init = 's')
  GROUP BY w.conv_id, w.i + 1, op.q2),
best AS (
  SELECT w.conv_id, min({'cost': b.cost + ins.cost, 'audit': b.audit || ins.audit, 'made': b.made || ins.made}) AS b
  FROM walk w JOIN stats s ON s.conv_id IS NOT DISTINCT FROM w.conv_id AND s.n = w.i JOIN ins ON ins.q = w.q WHERE ins.q2 IN (0, 2) GROUP BY w.conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(best.b.cost, 0)::BIGINT AS cost, coalesce(best.b.audit, '') AS audit, sha256(coalesce(substr(best.b.made, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN stats ON stats.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM c.conv_id
"""

QUERIES = {"op13_conversation_repair": op13_conversation_repair}
ORACLES = {"op13_conversation_repair": SQL}
