import random
import re
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracewright.llm import decontaminate, language_id, ngram_join, toxicity, url_filter
from tracewright.llm.ftrl import Sparse, fit, softmax, temperature
from tracewright.llm.words import ALNUM, BLANK, shingles, words


def lowered(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def test_word_hashes_tell_words_apart():
    texts = ["The cat, the CAT. Été", None, "", "a1-b2 漢字"]
    got = list(words(pa.array(texts), ALNUM))
    counts = np.concatenate([w.counts for w in got]).tolist()
    assert counts == [len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(t))) for t in texts]
    h = got[0].hashes
    assert h[0] == h[2] and h[1] == h[3] and len(set(h.tolist())) == 6
    assert sum(w.counts.sum() for w in words(pa.array([" a  b\tc\x0bd "]), BLANK)) == 4
    assert [len(s) for w in words(pa.array(["a b c d a b c", "a b", "a", ""]), BLANK) for _, s, _ in shingles(w, 3)] == [4, 1, 1, 0]


def brute_components(rows, width, percent):
    sets = {}
    for i, t in rows:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", lowered(t)) if x]
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= percent * len(sets[a] | sets[b]):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80)])
def test_ngram_components_against_all_pairs(spark, width, percent):
    r = random.Random(width)
    rows = []
    for g in range(12):
        base = [f"w{r.randrange(400)}" for _ in range(r.choice([1, 2, 4, 9, 11, 14, 20, 24, 40, 90]))]
        for _ in range(r.randrange(1, 14)):
            t = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3])):
                k = r.randrange(len(t)) if t else 0
                kind = r.randrange(3)
                if kind == 0 and t:
                    t[k] = f"e{r.randrange(60)}"
                elif kind == 1:
                    t.insert(k, f"e{r.randrange(60)}")
                elif len(t) > 1:
                    del t[k]
            rows.append((len(rows), " ".join(t)))
    shared = " ".join(f"p{k}" for k in range(30))
    rows += [(len(rows) + k, shared + " " + " ".join(f"u{r.randrange(10**6)}" for _ in range(60))) for k in range(30)]
    got = ngram_join.ngram_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), width, percent).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(rows, width, percent)


@pytest.mark.parametrize("how", [{"bits": 5}, {"list_rows": 3}, {"bits": 3, "list_rows": 2}, {"list_rows": 20, "frequent_tokens": 10}])
def test_ngram_components_with_clashing_sums_and_dealt_lists(spark, how):
    r = random.Random(11)
    rows, base = [], [f"b{k}" for k in range(11)]
    for i in range(150):
        t = list(base)
        t[r.randrange(11)] = f"x{r.randrange(40)}"
        t[r.randrange(11)] = f"x{r.randrange(40)}"
        rows.append((i, " ".join(t if i % 2 else [*t, *[f"l{k}" for k in range(40)], *[f"m{r.randrange(9)}" for _ in range(3)]])))
    rows += [(1000 + k, "a b c" if k % 2 else "") for k in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for width, percent in ((1, 80), (3, 90)):
        got = ngram_join.ngram_components(docs, width, percent, **how).collect()
        assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in got} == brute_components(rows, width, percent)


def test_words_whose_letters_cancel_out_differ():
    for size in (64, 128, 256, 512, 1024, 2048, 4096):
        word = "".join("ab"[bin(k).count("1") % 2] for k in range(size))
        other = word.translate(str.maketrans("ab", "ba"))
        for letters in (ALNUM, BLANK):
            (w,) = words(pa.array([f"{word} {other} {word[:-1]} {word}b"]), letters, twice=True)
            assert len(set(w.hashes.tolist())) == len(set(w.second.tolist())) == 4 and not set(w.hashes.tolist()) & set(w.second.tolist())
            a, b = (next(shingles(next(words(pa.array([f"{x} two three four"]), letters)), 3))[1] for x in (word, other))
            assert len(set(a.tolist()) & set(b.tolist())) == 1


def test_salted_join_equals_a_join(spark):
    from pyspark.sql import functions as F

    from tracewright.operators.scale import salted_join

    rows = spark.range(6000).select(F.when(F.col("id") < 3000, 7).when(F.col("id") % 50 == 0, None).otherwise(F.col("id") % 900).alias("k"), "id")
    side = spark.range(800).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("inner", "left"):
        assert sorted(salted_join(rows, side, "k", how=how).collect(), key=str) == sorted(rows.join(side, "k", how).collect(), key=str)


def test_near_copies_are_judged_by_row(spark):
    a, b = " ".join(f"a{k}" for k in range(60)), " ".join(f"b{k}" for k in range(60))
    rows = [(1, a), (5, a + " end"), (5, b), (6, b + " end"), (7, a), (7, a.upper()), (8, None), (8, ""), (None, a), (None, a), (9, b.title() + " x y"), (9, "only here")]
    docs = spark.createDataFrame([(*r, {"k": "v"}) for r in rows], "doc_id long, text string, extra map<string,string>").repartition(2)
    got = ngram_join.drop_near_copies(docs)
    left = sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str)
    assert got.columns == docs.columns and left == sorted([(1, a), (5, b), (8, None), (8, ""), (None, a), (None, a), (9, "only here")], key=str)
    twice = spark.createDataFrame([(3, a), (3, a), (3, a + " end"), (4, b)], "doc_id long, text string")
    assert len(ngram_join.drop_near_copies(twice).collect()) == 2


def test_ngram_edge_cases(docs, nothing):
    got = ngram_join.ngram_components(docs).collect()
    assert len(got) == docs.count()
    by = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got if r["doc_id"] is not None}
    assert by[6] == (0, 6) and by[7] == (0, 7) and by[8] == (0, 8) and by[9] == (1, 9) and by[10] == (1, 9)
    assert by[2] == (118, 1) and by[3] == (118, 1) and by[4] == (118, 1) and by[5][1] == 5 and by[20] == (11, 19)
    assert [r["component_id"] for r in got if r["doc_id"] is None] == [None, None]
    assert ngram_join.ngram_components(nothing).count() == 0
    kept = ngram_join.drop_near_copies(docs)
    assert kept.columns == docs.columns and 1 in {r["doc_id"] for r in kept.collect()} and 2 not in {r["doc_id"] for r in kept.collect()}


def test_light_sets_share_enough_subsets():
    assert ngram_join.light_bound(90, 0.5) >= 8
    for percent in (80, 90):
        for n in range(1, 40):
            for m in range(n, 40):
                o = ngram_join.overlap(n, m, percent)
                assert o == min(k for k in range(100) if 100 * k >= percent * (n + m - k))
                if o <= n:
                    assert n - o in ngram_join.deletions(n, 40, percent) and m - o in ngram_join.deletions(m, 40, percent)


def test_components(spark):
    links = spark.createDataFrame([(5, 4), (4, 3), (3, 2), (2, 1), (9, 8), (8, 7), (20, 20), (1, 5)], "a long, b long")
    got = {r["node"]: r["component"] for r in ngram_join.components(links).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 7: 7, 8: 7, 9: 7, 20: 20}


def plain_distance(item, text):
    best = list(range(len(item) + 1))
    found = best[-1]
    for t in text:
        new = [0]
        for i, x in enumerate(item):
            new.append(min(best[i] + (x != t), best[i + 1] + 1, new[i] + 1))
        best = new
        found = min(found, best[-1])
    return found


def test_decontamination_against_all_pairs(spark, nothing):
    r = random.Random(3)
    items = [[f"w{r.randrange(3000)}" for _ in range(r.randrange(12, 50))] for _ in range(25)] + [["tiny"], []]
    rows, planted = [], set()
    for d in range(120):
        text = [f"w{r.randrange(3000)}" for _ in range(r.randrange(0, 200))]
        if d % 3 == 0:
            k = r.randrange(25)
            part = list(items[k])
            for _ in range(r.choice([0, 0, 1, 2])):
                at = r.randrange(len(part))
                part[at : at + r.randrange(2)] = [f"z{r.randrange(99)}"] * r.randrange(2)
            text[len(text) // 2 : len(text) // 2] = part
        rows.append((d, " ".join(text).title() if d % 2 else ", ".join(text)))
        for k, item in enumerate(items[:25]):
            if plain_distance(item, text) <= decontaminate.allowed(len(item)):
                planted.add((d, k))
    docs = spark.createDataFrame([*rows, (500, None), (501, ""), (None, "x")], "doc_id long, text string")
    bench = spark.createDataFrame([*[(k, " ".join(x)) for k, x in enumerate(items)], (99, None), (None, "a b")], "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]) for x in decontaminate.contaminated(docs, bench).collect()}
    assert got <= planted and len(got & planted) >= 0.95 * len(planted) and len(planted) >= 35
    exact = {(d, k) for d, k in planted if " ".join(items[k]) in re.sub("[^a-z0-9]+", " ", lowered(dict(rows)[d]))}
    assert exact <= got
    left = {x["doc_id"] for x in decontaminate.drop_contaminated(docs, bench).collect()}
    assert left == {x["doc_id"] for x in docs.collect()} - {d for d, _ in got}
    assert decontaminate.contaminated(nothing, bench).count() == 0 and decontaminate.contaminated(docs, bench.limit(0)).count() == 0


def test_decontamination_by_row_in_many_blocks(spark, docs, monkeypatch):
    r = random.Random(21)
    items = [(k // 2, " ".join(f"i{k}w{j}" for j in range(14))) for k in range(24)]  # two texts for each item id
    bench = spark.createDataFrame([*items, (0, items[0][1])], "item_id long, text string")
    rows, want = [], []
    for d in range(60):
        k = r.randrange(24)
        text = " ".join(f"z{r.randrange(9999)}" for _ in range(d * 40))
        bad = d % 3 == 0
        rows.append((None if d % 10 == 0 else d % 7, f"{text} {items[k][1]} {items[k ^ 1][1]}" if bad else text, "clash"))
        want += [(rows[-1][0], k // 2)] if bad else []
    rows += [rows[0], (1, None, "clash"), (1, "", "clash"), (2, "long " * 200000, "clash")]
    want.append(want[0])
    table = spark.createDataFrame(rows, "doc_id long, text string, item_id string").repartition(3)
    for block, blocks in ((decontaminate.BLOCK_BYTES, 8), (200, 2)):
        monkeypatch.setattr(decontaminate, "BLOCK_BYTES", block)
        monkeypatch.setattr(decontaminate, "PASS_BLOCKS", blocks)
        got = [(x["doc_id"], x["item_id"]) for x in decontaminate.contaminated(table, bench).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
        left = decontaminate.drop_contaminated(table, bench)
        assert left.columns == table.columns
        assert sorted((tuple(x) for x in left.collect()), key=str) == sorted((x for x in rows if not x[1] or " i" not in x[1]), key=str)
    assert decontaminate.drop_contaminated(docs, bench).count() == docs.count()


def test_recall_is_measured(spark):
    r = np.random.default_rng(1)
    items = [r.integers(1, 2**62, n).astype(np.uint64) for n in (15, 20, 30, 40, 55) * 10]
    assert all(c.recall >= decontaminate.TARGET for c in decontaminate.build(items))


@pytest.mark.parametrize("n", [5, 9, 14, 25, 45, 63, 64, 99, 180, 500])
def test_recall_in_other_text_for_short_and_long_items(n):
    """Items with as many edits as are allowed, in the midst of other words; edits and first word are those of the nearest run."""
    r = random.Random(n)
    items = [np.array([r.randrange(1, 2**62) for _ in range(n)], np.uint64) for _ in range(40)]
    s = decontaminate.Searcher(np.arange(len(items)), items)
    found = 0
    for i, item in enumerate(items):
        copy = item.tolist()
        for _ in range(decontaminate.allowed(n)):
            at, kind = r.randrange(len(copy)), r.randrange(3)
            copy[at : at + (kind != 1)] = [r.randrange(1, 2**62)] * (kind != 2)
        lead = [r.randrange(1, 2**62) for _ in range(r.randrange(90))]
        text = np.array([*lead, *copy, *[r.randrange(1, 2**62) for _ in range(r.randrange(90))]], np.uint64)
        got = {k: (d, at) for _, k, d, at in s.hits(text, np.array([len(text)]))}
        assert set(got) <= {i}
        if i in got:
            found += 1
            assert got[i] == (plain_distance(item.tolist(), text.tolist()), decontaminate._nearest_run(item, text))
    assert found >= 0.9 * len(items), found


def test_long_items_are_found_with_all_allowed_edits(spark):
    r = random.Random(4)
    word = lambda: f"w{r.randrange(4000)}"
    items = [[word() for _ in range(n)] for n in (100, 130, 150, 200, 250, 300, 400, 600, 800, 1000)]
    items.append(["la"] * 300)
    rows, edits = [], {}
    for k, item in enumerate(items[:-1]):
        for copy in range(6):
            text = list(item)
            for _ in range(decontaminate.allowed(len(item))):
                at, kind = r.randrange(len(text)), r.randrange(3)
                text[at : at + (kind != 1)] = [word()] * (kind != 2)
            lead = [word() for _ in range(copy * 20)]
            edits[len(rows)] = k, plain_distance(item, [*lead, *text])
            rows.append((len(rows), " ".join([*lead, *text, *[word() for _ in range(r.randrange(60))]])))
    far = list(items[4])
    far[::4] = [f"z{x}" for x in range(len(far[::4]))]  # 63 of 250 words, 50 are allowed
    rows += [(900, " ".join(far)), (901, "la " * 2000), (902, " ".join(word() for _ in range(3000)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(k, " ".join(x)) for k, x in enumerate(items)], "item_id long, text string")
    got = {(x["doc_id"], x["item_id"]): x for x in decontaminate.contaminated(docs, bench).collect()}
    long = {(d, k) for d, (k, _) in edits.items() if len(items[k]) >= 200}
    assert long <= set(got) and len(set(got) & {(d, k) for d, (k, _) in edits.items()}) >= 0.95 * len(edits)
    assert all(got[d, k]["edits"] == edits[d][1] for d, k in long)
    assert {x for x in got if x[0] >= 900} == {(901, 10)} and got[901, 10]["edits"] == 0 and got[901, 10]["first_word"] == 0


def test_ftrl_learns_and_temperature_calibrates():
    r = np.random.default_rng(0)
    y = r.integers(0, 3, 600)
    x = Sparse.of([(np.array([c, 3 + r.integers(50)]), np.ones(2)) for c in y])
    w = fit(x, y, 3, 60, l1=0.01)
    assert (x.times(w).argmax(1) == y).mean() > 0.99
    logits = r.normal(size=(2000, 3))
    labels = np.array([r.choice(3, p=p) for p in softmax(logits)])
    assert abs(temperature(logits * 4, labels) - 4) < 0.6


def test_language_id(spark, nothing):
    r = random.Random(5)
    alphabet = {"aa": "abcde", "bb": "fghij", "cc": "éüñß"}
    rows = [(i, " ".join("".join(r.choice(alphabet[g]) for _ in range(r.randrange(2, 9))) for _ in range(r.randrange(3, 60))), g) for i in range(400) for g in [r.choice("abc") * 2]]
    rows += [(1000, None, "aa"), (1001, "", None), (1002, "123 ...", "bb"), (None, "abc abc", "aa"), (1003, "ffgg", None)]
    rows += [rows[3], rows[3], (1004, "abcde cabbed " * 60_000, "aa"), (1004, "fghij jig " * 60_000, "bb")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'x' AS score")
    got = language_id.identify_languages(docs).collect()
    assert len(got) == len(rows)
    truth = {i: g for i, t, g in rows}
    held = [x for x in got if x["held_out"] and x["doc_id"] < 1000]
    assert len(held) > 50 and sum(x["lang_pred"] == truth[x["doc_id"]] for x in held) >= 0.97 * len(held)
    by = {x["doc_id"]: (x["lang_pred"], x["score"]) for x in got}
    assert by[1000] == by[1001] == by[1002] == ("und", 0.0) and by[1003][0] == "bb"
    assert all(0 <= x["score"] <= 1 for x in got)
    kept = {x["doc_id"] for x in language_id.drop_unidentified(docs).collect()}
    assert not {1000, 1001, 1002} & kept and len(kept) >= 390
    assert language_id.identify_languages(nothing.select("doc_id", "text", "lang")).count() == 0


def test_toxicity_chain(spark, nothing):
    r = random.Random(9)
    rows, marks = [], []
    for i in range(900):
        bad, poor = r.random() < 0.2, r.random() < 0.2
        text = [f"w{r.randrange(300)}" for _ in range(r.randrange(20, 60))]
        if bad:
            text[3:3] = r.sample(["vile", "scum", "moronx"], 2)
        if poor:
            text += ["junk"] * 3
        rows.append((i, " ".join(text)))
        marks.append((i, 0 if poor else 1, int(bad)) if i < 700 else (i, None, None))
    docs = spark.createDataFrame([*rows, (2000, None), (2001, ""), (None, "scum vile")], "doc_id long, text string")
    labels = spark.createDataFrame([*marks, (None, 1, 1)], "doc_id long, quality int, toxic int")
    p = {x["doc_id"]: x["p_toxic"] for x in toxicity.toxicity(docs, labels).collect()}
    unseen = range(700, 900)
    truth = {i: any(w in t.split() for w in ("vile", "scum", "moronx")) for i, t in rows}
    assert sum((p[i] > 0.5) == truth[i] for i in unseen) >= 0.97 * len(unseen)
    assert len(p) == len(rows) + 3 and p[2000] == p[2001] < 0.5
    flagged = {x["doc_id"] for x in toxicity.toxic_documents(docs, labels).collect()}
    assert all(p[i] > 0.5 for i in flagged) and 2000 not in flagged
    assert {x["p_toxic"] for x in toxicity.toxicity(docs, labels.limit(0)).collect()} == {0.5}
    assert toxicity.toxicity(nothing, labels).count() == 0


def test_toxicity_chain_equals_a_plain_chain(spark):
    """The chain from Spark tasks against the same chain fitted in a row with dense probabilities, on three categories."""
    r = np.random.default_rng(3)
    rows = [np.unique(r.integers(0, 40, 12)) for _ in range(200)]
    labels = np.stack([[3 in b for b in rows], [3 in b and 5 in b for b in rows], [7 in b or 5 in b for b in rows]], 1).astype(int)
    chain = toxicity.train_chain(spark, rows, labels, ["a", "b", "c"])
    size, earlier, plain = toxicity.BUCKETS + 4, [[] for _ in rows], []
    for k in range(3):
        x = [(np.append(b, toxicity.BUCKETS + np.arange(1 + k)).astype(np.int32), np.array([1.0] * (len(b) + 1) + e, np.float32)) for b, e in zip(rows, earlier)]
        plain.append(toxicity._fit(Sparse.of(x), labels[:, k], size))
        for f in range(toxicity.FOLDS):
            inside = [i for i in range(200) if i % toxicity.FOLDS != f]
            w = toxicity._fit(Sparse.of([x[i] for i in inside]), labels[inside, k], size)
            for i in range(f, 200, toxicity.FOLDS):
                earlier[i] = [*earlier[i], 1 / (1 + np.exp(-(x[i][1] @ w[x[i][0]])))]
    assert all(np.allclose(a, b, atol=1e-4) for a, b in zip(chain.weights, plain)) and any(w[toxicity.BUCKETS + 1] for w in plain[1:])


def test_toxicity_edges(spark):
    text = ["nice calm words here"] * 40 + ["vile scum words here"] * 40
    rows = [(i, t, 1) for i, t in enumerate(text)] + [(3, "vile scum", 2), (3, "nice calm words here", 3), (None, None, 4), (90, "scum " * 300000, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, p_toxic int")
    labels = spark.createDataFrame([(i, 1, int(i >= 40)) for i in range(80)] + [(5, 1, 0), (5, 1, 1), (6, None, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= x["p_toxic"] <= 1 for x in got)
    assert {x["doc_id"] for x in toxicity.toxic_documents(docs, labels).collect()} >= set(range(40, 80)) | {90}
    nobody = labels.withColumn("doc_id", F.col("doc_id") + 1000)  # labels of documents that are not there
    assert {x["p_toxic"] for x in toxicity.toxicity(docs, nobody).collect()} == {0.5}


def test_language_model_equals_dense_algebra(spark):
    """Counts, TF-IDF, probabilities and temperature recomputed with plain dictionaries on the labelled rows."""
    import zlib
    from collections import Counter
    from math import exp, log, sqrt

    r = random.Random(8)
    alphabet = {"aa": "abcd", "bb": "cdef", "cc": "éüab"}
    rows = [(i, " ".join("".join(r.choice(alphabet[g]) for _ in range(r.randrange(2, 9))) for _ in range(20)), g) for i in range(300) for g in [r.choice("abc") * 2]]
    rows += [(i, t, g) for i, t, g in rows[:5]] + [(900, "a" * 300000, "aa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("held_out", F.lit("clash"))
    model = language_id.train(docs)
    learn = [t for i, t, _ in rows if zlib.crc32(str(i).encode()) % 4 != 2]

    def grams(t):
        code = lambda g, n: int(language_id.mix(np.array([g], np.uint64), n)[0] >> np.uint64(49))
        t = "".join(c if ord(c) >= 128 or c.isalpha() else " " for c in t.lower())
        out = Counter()
        for n in language_id.LENGTHS:
            for k in range(len(t) - n + 1):
                h = 0
                for c in t[k : k + n]:
                    h = (h * 1_114_113 + ord(c)) % 2**64
                out[code(h, n)] += 1
        return out

    few = [t for t in learn if len(t) < 1000]
    df = Counter(g for t in few for g in grams(t))
    df.update(grams("a" * 3000).keys() if len(few) < len(learn) else [])
    assert all(abs(model.idf[g] - (log((1 + len(learn)) / (1 + n)) + 1)) < 1e-9 for g, n in df.items())
    got = {(x["doc_id"]): (x["lang_pred"], x["score"]) for x in language_id.identify_languages(docs).collect()}
    for i, t, _ in rows[:60]:
        v = {g: (1 + log(n)) * model.idf[g] for g, n in grams(t).items()}
        norm = sqrt(sum(x * x for x in v.values()))
        z = [sum(x / norm * model.weights[g, k] for g, x in v.items()) / model.temperature for k in range(3)]
        p = [exp(x - max(z)) / sum(exp(y - max(z)) for y in z) for x in z]
        assert got[i][0] == model.languages[int(np.argmax(p))] and abs(got[i][1] - max(p)) < 1e-5


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="no tables")
def test_language_scores_are_calibrated_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    held = [x for x in language_id.identify_languages(docs).collect() if x["held_out"] and x["lang_pred"] != "und" and truth[x["doc_id"]]]
    right = np.array([truth[x["doc_id"]] == x["lang_pred"] for x in held])
    score = np.array([x["score"] for x in held])
    assert len(held) > 150 and right.mean() >= 0.97 and abs(score.mean() - right.mean()) < 0.05


@pytest.mark.skipif(not Path("/root/testdata/sf0.1").exists(), reason="no tables")
def test_toxicity_on_labels_that_were_not_learned_from(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{d}/{n}.parquet") for n in ("documents", "labels"))
    rest = {r["doc_id"]: r["toxic"] for r in labels.where("doc_id % 4 = 3").collect()}
    flagged = {x["doc_id"] for x in toxicity.toxic_documents(docs, labels.where("doc_id % 4 <> 3")).collect()}
    bad = {i for i, t in rest.items() if t == 1}
    assert len(bad) > 50 and len(bad & flagged) >= 0.7 * len(bad) and len(flagged & (rest.keys() - bad)) <= 0.03 * len(rest)


def test_pipeline_stages(spark, docs, tmp_path):
    import corpus_pipeline

    data = docs.select("doc_id", "text", "lang", "source", "n_chars").where("doc_id IS NOT NULL")
    data.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(0, "totally different benchmark item with enough words to be found in nothing at all")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    at = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, at, str(tmp_path))
        assert out.columns == at.columns, name
        out.write.parquet(str(tmp_path / name))
        at = spark.read.parquet(str(tmp_path / name))
    left = {r["doc_id"] for r in at.collect()}
    twice = data.where("doc_id = 5").unionByName(data.where("doc_id IN (1, 4, 17)").withColumn("doc_id", F.lit(5).cast("long")))
    for name, stage in corpus_pipeline.STAGES[1:-1]:
        twice = stage(spark, twice, str(tmp_path)).cache()
    assert {r["doc_id"] for r in twice.collect()} == {5} and twice.count() == 3  # 1 and 4 are near copies, the others stay
    assert 1 in left and not left & {2, 3, 4, 6, 7, 8, 12}
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == left


def test_url_rules_match_only_where_their_words_fetch_them(spark):
    urls = ["http://ad.shop.test/", "http://ads.shop.test/", "http://a.test/x/ad/y", "http://a.test/ads/y", "http://a.test/x?utm_source=1", "http://a.test/x;sessionid=2",
            "http://a.test/login", "http://a.test/cart?x", "http://a.test/calendar/2020", "http://a.test/f.exe", "http://a.test/f.zip?q", "http://a.test/add/ad", "http://b.test/dexter"]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    got = {r["page_id"]: r for r in url_filter.judge_urls(pages, [*url_filter.HOST_RULES, ("block", "b.test", "/de")]).collect()}
    for k, url in enumerate(urls[:-1]):
        fits = sorted(n for n, _, p in url_filter.PATTERN_RULES if re.search(p, url[7:]))
        assert (got[k]["pattern"], got[k]["verdict"]) == ((fits[0], "block") if fits else (None, "allow"))
        for n, tokens, p in url_filter.PATTERN_RULES:
            words = re.split("[^a-z0-9]+", url[7:].lower())
            assert not re.search(p, url[7:]) or all(set(t.split("|")) & set(words) for t in tokens)
    assert {got[k]["pattern"] for k in got} >= {n for n, _, _ in url_filter.PATTERN_RULES} and got[12]["rule"] == "b.test/de"
