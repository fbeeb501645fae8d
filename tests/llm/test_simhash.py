import random

import numpy as np
import pytest
import xxhash

from tracewright.llm import simhash


def plain_fingerprint(text, width=4):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for blank in "\t\n\x0b\x0c\r":
        w = w.replace(blank, " ")
    w = [x for x in w.split(" ") if x]
    if not w:
        return 0
    shingles = [" ".join(w[i : i + width]) for i in range(len(w) - width + 1)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(ids, prints, distance=4):
    known = {}
    for i, f in zip(ids, prints):
        known[f] = min(i, known.get(f, i))
    seen, out = set(), {}
    for f in known:
        if f in seen:
            continue
        group, todo = {f}, [f]
        while todo:
            x = todo.pop()
            for y in known:
                if y not in group and (x ^ y).bit_count() <= distance:
                    group.add(y)
                    todo.append(y)
        seen |= group
        out |= {g: min(known[x] for x in group) for g in group}
    return out


def test_fingerprint(spark):
    from pyspark.sql import functions as F

    texts = ["", None, " \t", "One", "a b c", "a b c d", "É b\x0bC  d\ne f g\x1ch i", "x " * 500, " ".join(str(k % 97) for k in range(70_000)), "    a"]
    assert [simhash.fingerprint(t) for t in texts] == [plain_fingerprint(t) for t in texts]
    assert [simhash.fingerprint(t, 1) for t in texts[:8]] == [plain_fingerprint(t, 1) for t in texts[:8]]
    jvm = spark.createDataFrame([("a b c d",)], "t string").select(F.xxhash64("t")).first()[0]
    assert jvm & (2**64 - 1) == plain_fingerprint("a b c d")


@pytest.mark.parametrize(("distance", "pivots", "hot"), [(4, 16, 1000), (4, 3, 5), (2, 16, 3), (0, 8, 2)])
def test_near_fingerprints_join_all_that_links(spark, monkeypatch, distance, pivots, hot):
    monkeypatch.setattr(simhash, "HOT_BUCKET", hot)
    monkeypatch.setattr(simhash, "CENTRES", 2)
    r = random.Random(distance + hot)
    prints = {0, 2**64 - 1, 1, 2**63}
    for _ in range(60):
        base = r.getrandbits(64)
        for _ in range(r.choice([1, 2, 12])):
            for _ in range(r.randrange(7)):
                base ^= 1 << r.randrange(64)
            prints.add(base)
    prints = sorted(prints)
    rows = [(int(np.array(p, np.uint64).view(np.int64)),) for p in prints]
    got = [(x["a"] & (2**64 - 1), x["b"] & (2**64 - 1)) for x in simhash.near_fingerprints(spark.createDataFrame(rows, "fp long"), distance, pivots).collect()]
    assert all((a ^ b).bit_count() <= distance for a, b in got)
    want = plain_components(range(len(prints)), prints, distance)
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in got:
        root[find(a)] = find(b)
    assert len({find(p) for p in prints}) == len(set(want.values()))
    if hot == 1000:  # without hot buckets every link is returned
        assert len(set(map(frozenset, got))) == sum((a ^ b).bit_count() <= distance for i, a in enumerate(prints) for b in prints[i + 1 :])


def test_segments_follow_the_cost():
    assert simhash.segment_count(10, 4) == 5 and simhash.segment_count(200_000, 4) == 6 and simhash.segment_count(10**10, 4) >= 8


def test_simhash_edge_cases(spark, docs, nothing):
    got = simhash.simhash_components(docs).collect()
    rows = docs.collect()
    assert len(got) == len(rows)
    ids = [r["doc_id"] for r in rows if r["doc_id"] is not None]
    prints = [plain_fingerprint(r["text"]) for r in rows if r["doc_id"] is not None]
    part = plain_components(ids, prints)
    want = sorted((i, f"{p:016x}", part[p]) for i, p in zip(ids, prints))
    assert sorted(tuple(r) for r in got if r["doc_id"] is not None) == want
    assert sorted((r["fingerprint"], r["component_id"]) for r in got if r["doc_id"] is None) == sorted((f"{plain_fingerprint(r['text']):016x}", None) for r in rows if r["doc_id"] is None)
    assert simhash.simhash_components(nothing).count() == 0


def test_op12_equals_all_pairs(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    prints = [plain_fingerprint(r["text"]) for r in rows]
    part = plain_components([r["doc_id"] for r in rows], prints)
    assert sorted(tuple(r) for r in simhash.op12_simhash(spark, sf).collect()) == sorted((r["doc_id"], f"{p:016x}", part[p]) for r, p in zip(rows, prints))
