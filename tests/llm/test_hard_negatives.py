import math

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.llm import hard_negatives as hn


def plain(rows, every=100, positives=5, negatives=10):
    """All pairs. rows: vec_id, embedding, label."""
    fine = [(i, [math.floor(256 * x) for x in v], lab) for i, v, lab in rows if None not in (i, v, lab) and all(x is not None and math.isfinite(x) for x in v)]
    known = {}
    for i, v, lab in fine:
        known[i] = min((lab, v), known.get(i, (lab, v)))
    score = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = []
    for a, (label, v) in known.items():
        if a % every:
            continue
        scored = sorted((-score(v, w), i, lab == label) for i, (lab, w) in known.items() if i != a)
        for s, p, _ in [x for x in scored if x[2]][:positives]:
            hard = [(n, -t) for t, n, same in scored if not same and 30 * -s <= 100 * -t <= 90 * -s][:negatives]
            out += [(a, p, r + 1, n, -s, t) for r, (n, t) in enumerate(hard)]
    return sorted(out)


SCHEMA = "vec_id long, embedding array<float>, label int, home string, place string"


def clustered(n, dims, seed):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(12, dims))
    at = r.integers(0, 12, n)
    v = centres[at] + r.normal(size=(n, dims)) * 0.3
    return [(i, x.tolist(), int(c % 4 if k else 3)) for i, (x, c, k) in enumerate(zip(v.astype(np.float32), at, r.random(n) < 0.9))]


def test_hilbert_curve_visits_every_cell_in_steps_of_one():
    for dims, bits in ((2, 4), (3, 3), (5, 2), (1, 4)):
        cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims), -1).reshape(-1, dims)
        place = hn.hilbert(cells, bits)
        assert sorted(place.tolist()) == list(range(len(cells)))
        assert (np.abs(np.diff(cells[np.argsort(place)], axis=0)).sum(axis=1) == 1).all()


def test_bounds_hold_for_every_row_of_a_box():
    r = np.random.default_rng(1)
    v, a = r.integers(-300, 300, (50, 7)), r.integers(-300, 300, (20, 7))
    low, high = hn.bounds(a, v.min(axis=0)[None, :], v.max(axis=0)[None, :])
    s = hn.product(a, v)
    assert (low <= s).all() and (s <= high).all() and (s == a @ v.T).all()
    big = np.full((1, 4), 1 << 29)
    assert hn.product(big, big)[0, 0] == 4 << 58


@pytest.mark.parametrize(("block", "chunk", "zones"), [(16 * 4 * 6, 16 * 4 * 6, 2), (131_072, 524_288, 128)])
def test_hard_negatives_equal_all_pairs(spark, monkeypatch, block, chunk, zones):
    monkeypatch.setattr(hn, "BLOCK_BYTES", block)
    monkeypatch.setattr(hn, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(hn, "ZONES", zones)
    rows = clustered(900, 6, 2)
    df = spark.createDataFrame([(*x, "h", "p") for x in rows], SCHEMA).repartition(3)
    got = sorted(tuple(x) for x in hn.hard_negatives(df, every=20).collect())
    assert got == plain([(i, v, lab) for i, v, lab in rows], every=20) and len(got) > 300


def test_blocks_are_passed_by_where_the_bounds_allow(spark, monkeypatch):
    monkeypatch.setattr(hn, "BLOCK_BYTES", 16 * 4 * 3)
    rows = clustered(3000, 3, 4)
    at = hn.index(spark.createDataFrame([(*x, "h", "p") for x in rows], SCHEMA), every=100)
    number = lambda x: F.lit(x).cast("bigint")
    chunks = at.chunks(at.anchors.select("vec_id", F.array(number(hn.NONE), number(-hn.NONE), F.col("floor")).alias("slots")))
    need = sum(int(np.unpackbits(np.frombuffer(t["need"], np.uint8)).sum()) for t in at.tiles(chunks, True).collect())
    assert need < 0.5 * 30 * at.blocks.count()
    assert {b["block"] for b in at.blocks.collect()} == {int(b) for z in at.zones.collect() for b in np.frombuffer(z["ids"], "<i8").reshape(3, -1)[0]}


def test_edge_cases(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [float(i % 7), 1.0 - i % 3, 0.5], i % 2) for i in range(60)]
    rows += [(100, [1.0, 1.0], 0), (200, [], 1), (300, [1e9, -1e9, 1.0], 1), (400, None, 1), (500, [1.0, None, 2.0], 1), (600, [nan, 1.0, 1.0], 0), (700, [1.0, inf, 0.0], 0), (800, [1.0, 1.0, 1.0], None), (None, [1.0, 1.0, 1.0], 1)]
    rows += [(900, [1.0, 2.0, 3.0], 0)] * 3 + [(1000, [2.0, 2.0, 2.0], 1), (1000, [1.0, 2.0, 2.0], 0), (1100, [0.0, 0.0, 0.0], 0), (1200, [-1.0, -1.0, -1.0], 1)]
    df = spark.createDataFrame([(*x, "h", None) for x in rows], SCHEMA).repartition(2)
    got = sorted(tuple(x) for x in hn.hard_negatives(df).collect())
    known = [(i, None if v is None else v + [0.0] * (3 - len(v)), lab) for i, v, lab in rows]
    most = int((2**56 / 3) ** 0.5) / 256
    known = [(i, v and [x if x is None or not math.isfinite(x) else max(-most, min(most, x)) for x in v], lab) for i, v, lab in known]
    assert got == plain(known)
    assert hn.hard_negatives(df.where("vec_id < 0")).count() == 0 and hn.hard_negatives(df.where("vec_id = 100")).count() == 0


def test_op11_equals_its_sql(spark):
    sf = "/root/testdata/sf0.01"
    got = hn.op11_hard_negatives(spark, sf)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    want = con.execute(hn.SQL)
    assert got.columns == [d[0] for d in want.description]
    rows = sorted(tuple(x) for x in got.collect())
    assert rows == sorted(want.fetchall()) and len(rows) > 100
