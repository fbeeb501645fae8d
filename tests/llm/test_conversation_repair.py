import hashlib
import itertools
import random
import re
import zlib

import duckdb
import pytest

from tracewright.llm import conversation_repair as cr

#: state, letter written -> next state
GRAMMAR = {(0, "s"): 1, (0, "u"): 3, (1, "u"): 3, (2, "u"): 3, (3, "a"): 2}


def plain_repair(turns):
    """Cheapest (cost, audit) by trying every edit from every state; turns are letters as in cr.letter()."""
    insert = [(q, q2) for (q, x), q2 in GRAMMAR.items() if x != "s"]

    def with_inserts(best):
        for _ in range(3):
            for q, q2 in insert:
                if q in best:
                    way = (best[q][0] + 3, best[q][1] + "I")
                    best[q2] = min(way, best.get(q2, way))
        return best

    # Inserting may lead back to a state by a dearer way only, so min over (cost, audit) is enough.
    best = with_inserts({0: (0, "")})
    for t in turns:
        after = {}
        for q, (cost, audit) in best.items():
            ways = [(q, cost + 4, audit + "D")]
            for (p, x), q2 in GRAMMAR.items():
                if p == q and t != "-":
                    same = t.lower() == x
                    if same or x != "s":
                        ways.append((q2, cost + (0 if same else 3) + 3 * t.isupper(), audit + ("K" if same else "R")))
            for q2, c, a in ways:
                after[q2] = min((c, a), after.get(q2, (c, a)))
        best = with_inserts(after)
    return min(v for q, v in best.items() if q in (0, 2))


def aligned(turns):
    a = cr.Alignment()
    for t in turns:
        a.add(t)
    return a.result()


def test_alignment_of_all_short_conversations():
    for n in range(5):
        for turns in itertools.product("suaxUA-", repeat=n):
            assert aligned(turns) == plain_repair(turns), turns


@pytest.mark.parametrize("block", [1, 3, 16])
def test_alignment_of_long_conversations(monkeypatch, block):
    monkeypatch.setattr(cr, "BLOCK", block)
    r = random.Random(block)
    for _ in range(60):
        n = r.choice([7, 16, 17, 32, 45])
        start = ["s"] * r.randrange(2)
        turns = [r.choice("suaxSUA-") if r.random() < 0.3 else ("ua"[(k + len(start)) % 2]) for k in range(n)]
        assert aligned(start + turns) == plain_repair(start + turns)
    for turns in ("s" * 20, "-" * 33, "x" * 17, "a" * 32, "U" * 16, ""):
        assert aligned(turns) == plain_repair(turns)


def plain(rows):
    """All of the operator in plain Python, from the rows (conv_id, turn, role, text) of conversations."""
    after, ids = {}, {r[0] for r in rows}
    show = lambda x: " " if x is None else str(x)
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        after.setdefault(conv, []).extend([(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1))
    out = []
    for conv in ids:
        turns = sorted(after.get(conv, []), key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
        seen, letters, count = set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        for _, role, text in turns:
            core = text.strip(" \t\n\x0b\x0c\r")
            fault = "blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                count[fault] += 1
            letters.append(cr.letter(role[:1], fault))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        known = [t[0] for t in turns if t[0] is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        cost, audit = plain_repair(letters)
        lines, at, state = [], iter(turns), "u"
        for edit in audit:
            turn = None if edit == "I" else next(at)
            if edit == "D":
                continue
            role = turn[1] if edit == "K" else {"u": "user", "a": "assistant"}[state]
            lines.append(f"{role}:{'' if edit == 'I' else turn[2]}")
            state = "a" if role[:1] == "u" else "u"
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines))
        out.append((conv, gaps, *count.values(), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


SCHEMA = "conv_id long, turn long, role string, text string, fault string, place string"


def test_repair_equals_plain_python(spark):
    r = random.Random(5)
    rows = []
    for conv in range(60):
        for turn in range(r.choice([1, 2, 5, 8, 40])):
            role = ["user", "assistant"][turn % 2] if r.random() < 0.8 else r.choice(["system", "tool", "", "user", "assistant", None])
            text = r.choice(["Yes.", "No!", "Well", " \t", "", None, "Long. text?\n", "x" * 3000 + ".", "é ", "Good.\u0085"]) if r.random() < 0.5 else f"Text {turn}."
            rows.append((conv, turn if r.random() < 0.9 else None, role, text, "f", "p"))
    rows += [(None, 0, "user", "Hi.", None, None), (None, 1, "assistant", "Ho.", None, None), (None, None, None, None, None, None), (77, None, "user", "a.", None, None)]
    rows += [(99, 3, "user", "twice.", None, None)] * 5 + [(98, t, "user", "x" * 400_000 + ".", None, None) for t in range(3)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sorted((tuple(x) for x in cr.repaired_conversations(cr.damaged(df), df).collect()), key=str)
    assert got == plain([x[:4] for x in rows])


def test_repaired_turns_and_empty_tables(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "assistant", "Hello."), (1, 2, "user", "Bye"), (2, 0, "user", "  ")]
    found = cr.faults(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    plans = cr.repair_plans(found)
    assert [(p["conv_id"], p["cost"], p["audit"]) for p in plans.orderBy("conv_id").collect()] == [(1, *plain_repair("saU")), (2, 4, "D")]
    turns = [tuple(t)[1:] for t in cr.repaired_turns(found, plans).orderBy("conv_id", "place").collect()]
    assert "".join(t[3][0] for t in turns) in ("sua", "ua", "suaua") and [t[0] for t in turns] == list(range(len(turns)))
    none = spark.createDataFrame([], SCHEMA)
    assert cr.repaired_conversations(cr.damaged(none), none).count() == 0


def test_op13_equals_its_sql_and_plain_python(spark):
    sf = "/root/testdata/sf0.01"
    got = cr.op13_conversation_repair(spark, sf)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    want = con.execute(cr.SQL)
    assert got.columns == [d[0] for d in want.description]
    rows = sorted((tuple(x) for x in got.collect()), key=str)
    assert rows == sorted(want.fetchall(), key=str)
    assert rows == plain([tuple(x) for x in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()])
