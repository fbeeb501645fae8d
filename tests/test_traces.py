"""Pairing and temporal joins against plain stacks, bisection and loops."""

import bisect
import random

import pytest

from tracewright.operators import attribution, pairing, stats, temporal


def trace(seed, n=400):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        event = r.choice(["callback_start", "callback_end", "publish", "take", "sync"])
        rows.append((i, r.randrange(3000), r.randrange(2), r.randrange(5), str(r.randrange(3)), event))
    return rows


SCHEMA = "id long, ts_ns long, vpid long, vtid long, cb string, event string"


@pytest.mark.parametrize("seed", [1, 2])
def test_pair_nested_is_a_stack(spark, seed):
    rows = trace(seed)
    want, stacks = [], {}
    for i, t, p, d, cb, e in sorted(rows, key=lambda r: (r[1], r[0])):
        stack = stacks.setdefault((p, d), [])
        if e == "callback_start":
            stack.append((i, t))
        elif e == "callback_end" and stack:
            want.append((stack[-1][0], stack.pop()[1], t))
    df = spark.createDataFrame(rows, SCHEMA)
    for parts, chunk in ((1, None), (7, None), (3, 5), (2, 40), (1, 90)):
        got = pairing.pair_nested(df.repartition(parts), chunk).select("span_id", "t0", "t1").collect()
        assert sorted(map(tuple, got)) == sorted(want)


def test_long_threads_are_cut_into_chunks(spark):
    r = random.Random(8)
    rows = [(i, r.randrange(10**6), 1 if i % 10 else None, None if i % 17 == 0 else 1, str(r.randrange(3)), r.choice(["callback_start"] * 3 + ["callback_end"] * 3 + ["sync", "take"])) for i in range(1500)]
    deep = [(5000 + i, 10**7 + i, 2, 2, "c", "callback_start" if i < 300 else "callback_end") for i in range(700)]
    df = spark.createDataFrame(rows + deep, SCHEMA).repartition(3)
    for f, more in ((pairing.pair_nested, ()), (pairing.pair_adjacent, ()), (pairing.pair_by_key, ()), (pairing.pair_thread_last, ()), (pairing.pair_single, ("1",))):
        want = sorted(map(tuple, f(df, *more).collect()), key=str)
        for chunk in (20, 400):
            assert sorted(map(tuple, f(df, *more, chunk_rows=chunk).collect()), key=str) == want
    want = sorted(map(tuple, pairing.sync_gap_periods(df, 500, "vtid").select("id", "period").collect()))
    assert sorted(map(tuple, pairing.sync_gap_periods(df, 500, "vtid", chunk_rows=50).select("id", "period").collect())) == want
    plan = pairing.pair_nested(df, 100)._jdf.queryExecution().optimizedPlan().toString()
    windows = [w.rsplit("], [", 2)[-2:] for w in plan.split("\n") if "Window [" in w]
    assert windows and all("__chunk" in by or "lvl" in by or "__chunk" in order for by, order in windows)  # whole threads: summaries and level ends only


def test_pairing_variants(spark):
    marks = [(1, 10, "a", "s"), (2, 20, "b", "s"), (3, 30, "b", "e"), (4, 40, "a", "e"), (5, 40, "a", "e"), (6, 50, "a", "s"), (7, 50, "a", "e")]
    df = spark.createDataFrame([(i, t, 1, 1, cb, "callback_start" if e == "s" else "callback_end") for i, t, cb, e in marks], SCHEMA)
    ids = lambda x: sorted((r["span_id"], r["t1"]) for r in x.collect())
    assert ids(pairing.pair_nested(df)) == [(1, 40), (2, 30), (6, 50)]
    assert ids(pairing.pair_adjacent(df)) == [(2, 30), (6, 50)]
    assert ids(pairing.pair_by_key(df)) == [(1, 40), (2, 30), (6, 50)]
    assert ids(pairing.pair_thread_last(df)) == [(2, 30), (6, 50)]
    assert ids(pairing.pair_single(df, "a")) == [(1, 40), (6, 50)]


@pytest.mark.parametrize("chunk", [7, 100, 10**9])
def test_asof_against_bisect(spark, chunk):
    r = random.Random(4)
    left = [(i, r.randrange(2), r.randrange(300)) for i in range(150)]
    right = [(1000 + i, r.randrange(2), r.randrange(300)) for i in range(40)]
    a, b = spark.createDataFrame(left, "id long, k long, t long"), spark.createDataFrame(right, "id long, k long, t long")
    times = {k: sorted(t for _, q, t in right if q == k) for k in (0, 1)}

    def want(k, t, strict, forward):
        s = times[k]
        if forward:
            at = bisect.bisect_left(s, t)
            return s[at] if at < len(s) else None
        at = bisect.bisect_left(s, t) if strict else bisect.bisect_right(s, t)
        return s[at - 1] if at else None

    for strict, forward in ((False, False), (True, False), (False, True)):
        got = temporal.asof(a, b, ["k"], strict=strict, forward=forward, chunk_ns=chunk).collect()
        assert len(got) == len(left)
        assert all(x["r_t"] == want(x["k"], x["t"], strict, forward) for x in got)


def test_intervals_against_loops(spark):
    r = random.Random(6)
    spans = [(i, r.randrange(2), t0, t0 + r.choice([0, 5, 100, 10**7, 10**10])) for i, t0 in enumerate(r.randrange(10**10) for _ in range(80))]
    points = [(i, r.randrange(2), r.choice(spans)[2] + r.choice([0, 1, 10**6])) for i in range(120)]
    s, p = spark.createDataFrame(spans, "span_id long, k long, t0 long, t1 long"), spark.createDataFrame(points, "id long, k long, t long")
    hold = {i: [x for x in spans if x[1] == k and x[2] <= t <= x[3]] for i, k, t in points}
    own = {x["id"]: x["span_id"] for x in temporal.interval_owner(p, s, ["k"]).collect()}
    assert own == {i: max(h, key=lambda x: (x[2], x[0]))[0] if h else None for i, h in hold.items()}
    assert {x["id"]: x["overlaps"] for x in temporal.interval_overlaps(p, s, ["k"]).collect()} == {i: len(h) for i, h in hold.items()}
    assert {x["span_id"] for x in temporal.interval_semi(s, p, ["k"]).collect()} == {x[0] for h in hold.values() for x in h}


def test_attribution_rules(spark):
    spans = spark.createDataFrame([(1, 1, 1, "a", 100, 200)], "span_id long, vpid long, vtid long, cb string, t0 long, t1 long")
    calls = spark.createDataFrame([(1, 1, 1, 150, "k"), (2, 1, 2, 250, "k"), (3, 1, 2, 350, "k"), (4, 1, 2, 50, "k"), (5, 1, 2, 300, "k")], "corr long, pid long, tid long, t long, api_name string")
    acts = spark.createDataFrame([(c, 1, "kernel", 7, 0, 1) for c in range(1, 6)], "corr long, pid long, kind string, stream long, t_start long, t_end long")
    sync = spark.createDataFrame([(9, 1, 7, 300, 3), (10, 1, 8, 120, 2)], "id long, pid long, stream long, t long, sync_type long")
    rule = lambda **k: {r["corr"]: r["rule"] for r in attribution.attribute_runtime(calls, spans, acts, sync, **k).collect()}
    assert rule() == {1: "time", 2: "stream", 3: "post_release", 4: "residual", 5: "post_release"}
    assert rule(sync_aware=False) == {1: "time", 2: "stream", 3: "stream", 4: "residual", 5: "stream"}


def test_rank_statistics(spark):
    values = [5, 1, 9, 3, 7, 7, 2]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 4), ("c", None)], "k string, v long")
    got = {r["k"]: tuple(r)[1:] for r in stats.exec_stats(df, "v", "k").collect()}
    s = sorted(values)
    assert got == {"a": (7, sum(s) // 7, s[3], s[6], 9), "b": (1, 4, 4, 4, 4)}
    assert {r["k"]: r["q"] for r in stats.quantile_low(df, "v", 0.9, "k").collect()} == {"a": s[5], "b": 4}


def test_window_counts_and_periods(spark):
    points = spark.createDataFrame([("a", t) for t in (1, 2, 35, 39)], "k string, t long")
    r = pairing.window_counts(points, 10, 0, "k").first()
    assert (r["n"], r["min_count"], r["max_count"], r["mean"], r["std"]) == (4, 0, 2, 1.0, 1.0)
    rows = [(1, 0, 1, 1, "x", "sync"), (2, 3, 1, 1, "x", "take"), (3, 4, 1, 1, "x", "sync"), (4, 20, 1, 1, "x", "take")]
    got = pairing.sync_gap_periods(spark.createDataFrame(rows, SCHEMA), 5, "vtid").collect()
    assert {r["id"]: r["period"] for r in got} == {1: 0, 2: 0, 3: 0, 4: 1}


def test_shift_sweep_equals_the_grid_at_every_shift(spark):
    r = random.Random(12)
    spans = [(i, r.randrange(2), r.randrange(2), "c", t0, t0 + r.choice([3, 10, 40, 300])) for i, t0 in enumerate(r.randrange(400) for _ in range(40))]
    calls = [(i, r.randrange(2), r.randrange(3), r.randrange(500), "k") for i in range(80)]
    s = spark.createDataFrame(spans, "span_id long, vpid long, vtid long, cb string, t0 long, t1 long")
    c = spark.createDataFrame(calls, "corr long, pid long, tid long, t long, api_name string")
    low, high = -30, 45
    want = {x: sum(any(p == q and d == e and b - a >= 10 and a <= t + x <= b for _, q, e, _, a, b in spans) for _, p, d, t, _ in calls) for x in range(low, high + 1)}
    steps = {x["shift"]: x["covered"] for x in attribution.coverage_steps(c, s, 10, low, high).collect()}
    assert low in steps
    for x in want:
        assert steps[max(k for k in steps if k <= x)] == want[x]
    best = attribution.best_shift(c, s, 10, low, high).first()
    top = max(want.values())
    first = min(x for x in want if want[x] == top)
    last = next((x for x in range(first, high + 1) if want[x] != top), high + 1) - 1
    assert tuple(best) == (first, last, top, len(calls))
    grid = attribution.coverage(c, s, 10, [-30, 0, 7, 45]).collect()
    assert {x["shift"]: x["covered"] for x in grid} == {x: want[x] for x in (-30, 0, 7, 45)} and sum(x["best"] for x in grid) == 1
    assert attribution.best_shift(c, s, 10_000, low, high).first()["covered"] == 0
