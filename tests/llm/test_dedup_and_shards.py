import hashlib
import random
import re
import zlib
from collections import Counter

import pyarrow.parquet as pq
from pyspark.sql import functions as F

from tracewright.llm import exact_dedup, hilbert_shards, license_scan, url_filter


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_exact_duplicates_against_plain_grouping(docs):
    rows = [(r["doc_id"], norm(r["text"])) for r in docs.collect()]
    got = exact_dedup.exact_duplicates(docs).collect()
    assert len(got) == len(rows)
    want = []
    for i, t in rows:
        group = [j for j, u in rows if u == t]
        keep = min((j for j in group if j is not None), default=None)
        want.append((i, keep, len(group), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    key = lambda r: (r[0] is None, r[0] or 0, r[4])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_colliding_hash_keeps_texts_apart(docs):
    a = exact_dedup.exact_duplicates(docs).select("doc_id", "keep_id", "group_size").collect()
    b = exact_dedup.exact_duplicates(docs, lambda c: F.lit("one hash for all")).select("doc_id", "keep_id", "group_size").collect()
    assert sorted(a, key=str) == sorted(b, key=str)


def test_drop_exact_duplicates(docs, nothing):
    out = exact_dedup.drop_exact_duplicates(docs)
    assert out.columns == docs.columns
    texts = [norm(r["text"]) for r in out.collect()]
    assert len(texts) == len(set(texts)) == len({norm(r["text"]) for r in docs.collect()})
    assert exact_dedup.drop_exact_duplicates(nothing).count() == 0
    assert exact_dedup.exact_duplicates(nothing).count() == 0


def _hilbert(x, bits):
    """Textbook transposition of axes to a Hilbert index."""
    x, n = list(x), len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            if x[i] & q:
                x[0] ^= p
            else:
                t = (x[0] ^ x[i]) & p
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, 1 << (bits - 1)
    while q > 1:
        if x[n - 1] & q:
            t ^= q - 1
        q >>= 1
    x = [v ^ t for v in x]
    out = 0
    for b in range(bits - 1, -1, -1):
        for v in x:
            out = out << 1 | (v >> b) & 1
    return out


def test_hilbert_index_is_a_curve(spark):
    cells = spark.range(512).select((F.col("id") % 8).alias("a"), (F.expr("id div 8") % 8).alias("b"), F.expr("id div 64").alias("c"))
    got = cells.withColumn("h", hilbert_shards.hilbert_index([F.col("a"), F.col("b"), F.col("c")], 3)).collect()
    assert {r["h"] for r in got} == set(range(512))
    assert all(r["h"] == _hilbert((r["a"], r["b"], r["c"]), 3) for r in got)
    by = {r["h"]: (r["a"], r["b"], r["c"]) for r in got}
    assert all(sum(abs(p - q) for p, q in zip(by[k], by[k + 1])) == 1 for k in range(511))


def check_shards(rows, got, shards):
    """The law, gapless slots, the digest columns, and the order along the curve but for what plain_exchange moves."""
    assert len(got) == len(rows)
    counts = {s: [r["slot"] for r in got if r["shard"] == s] for s in range(shards)}
    assert max(map(len, counts.values())) - min(map(len, counts.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in counts.values())
    raw = lambda t: (t or "").encode()
    assert sorted((r["doc_id"] or -1, r["size"], r["text_crc32"]) for r in got) == sorted((i or -1, len(raw(t)) + 16, zlib.crc32(raw(t))) for i, t, *_ in rows)
    key = {}
    for i, t, *_ in rows:
        key.setdefault((i, zlib.crc32(raw(t))), hashlib.md5(raw(t)).hexdigest())
    run = sorted((r["hilbert"], key[r["doc_id"], r["text_crc32"]], -1 if r["doc_id"] is None else r["doc_id"]) for r in got)
    run = plain_exchange(run, shards)
    start = [-(-k * len(run) // shards) for k in range(shards + 1)]
    want = [(h, d, s, k - start[s]) for s in range(shards) for k, (h, _, d) in enumerate(run[start[s] : start[s + 1]], start[s])]
    assert sorted((r["hilbert"], -1 if r["doc_id"] is None else r["doc_id"], r["shard"], r["slot"]) for r in got) == sorted(want)


def plain_exchange(run, shards):
    """Rows (hilbert, md5, doc_id) along the curve, where groups that a cut parts have changed places with single rows of the later shard."""
    n, out = len(run), list(run)
    start = [-(-k * n // shards) for k in range(shards + 1)]
    size = Counter(r[1] for r in run)
    for s in range(1, shards):
        c = start[s]
        if not 0 < c < n or run[c - 1][1] != run[c][1]:
            continue
        at = [k for k in range(n) if run[k][1] == run[c][1]]
        if at[0] < start[s - 1] or at[-1] >= start[s + 1]:
            continue
        alone = [k for k in range(at[-1] + 1, start[s + 1]) if size[run[k][1]] == 1][: c - at[0]]
        if len(alone) == c - at[0]:
            for j, k in enumerate(alone):
                out[at[0] + j], out[k] = run[k], run[at[0] + j]
    return out


def test_groups_that_fit_are_not_parted(spark):
    r = random.Random(6)
    data = [(k, f"text {r.randrange(250) if r.random() < 0.4 else 1000 + k} " + "x " * r.randrange(9), r.choice(["de", "en"]), f"s{r.randrange(9)}", k) for k in range(1200)]
    data += [(5000 + k, "many copies", "en", "s1", k) for k in range(25)] + [(6000 + k, None if k % 2 else "", "de", "s2", k) for k in range(20)]
    table = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, text_key int").repartition(3)
    got = hilbert_shards.hilbert_shards(table, 40).collect()
    check_shards(data, got, 40)
    texts = dict((i, t or "") for i, t, *_ in data)
    of = {}
    for x in got:
        of.setdefault(texts[x["doc_id"]], set()).add(x["shard"])
    assert all(len(v) == 1 for v in of.values())
    cut = sorted((x["hilbert"], hashlib.md5(texts[x["doc_id"]].encode()).hexdigest(), x["doc_id"]) for x in got)
    start = [-(-k * len(cut) // 40) for k in range(41)]
    assert any(cut[c - 1][1] == cut[c][1] for c in start[1:40])  # without the exchange some would be


def test_hilbert_shards_law(docs, nothing):
    got = hilbert_shards.hilbert_shards(docs, 5).collect()
    assert {r["law"] for r in got} == {"rows"} and {r["grown_shard"] for r in got} == {None}
    check_shards([(r["doc_id"], r["text"]) for r in docs.collect()], got, 5)
    assert hilbert_shards.hilbert_shards(nothing).count() == 0


def table_of_groups(spark, rows=3000):
    r = random.Random(2)
    texts = [("t%d " % k) * r.randrange(1, 90) for k in range(rows // 3)]
    data = [(r.randrange(rows), r.choice(texts), r.choice(["de", "en", "fr", "es", None]), f"site{r.randrange(300):03d}", k) for k in range(rows)]
    data += [(7, "hot text", r.choice(["de", "en"]), "x", k) for k in range(rows // 2)]
    return data, spark.createDataFrame(data, "doc_id long, text string, lang string, source string, shard int")


def test_equal_texts_stay_together_and_cells_are_ranges_of_names(spark, monkeypatch):
    data, table = table_of_groups(spark)
    got = hilbert_shards.hilbert_shards(table, 9).collect()
    check_shards(data, got, 9)
    # The cuts by hand: names sorted, cut where the rows before them reach a new 32nd.
    names = sorted((s or "") for _, _, _, s, _ in data)
    ends = {names.index(n) * 32 // len(names): n for n in sorted(set(names))}
    want = [max(n for c, n in ends.items() if c < k) for k in range(1, 32)]
    meta = table.select("source")
    assert hilbert_shards._name_cuts(meta, "source", 32) == want
    monkeypatch.setattr(hilbert_shards, "FEW_NAMES", 3)
    assert hilbert_shards._name_cuts(meta, "source", 32) == want


def test_write_shards_keeps_rows_and_prunes(spark, tmp_path):
    data, table = table_of_groups(spark)
    name = hilbert_shards.write_shards(table, str(tmp_path / "out"), 40)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert name == "shard_" and back.select(name).distinct().count() == 40
    assert sorted(map(str, back.select(table.columns).collect())) == sorted(map(str, table.collect()))
    per = back.groupBy(name).count().collect()
    assert max(r["count"] for r in per) - min(r["count"] for r in per) <= 1
    r = random.Random(4)
    own = [(k, f"t{k} " * r.randrange(1, 90), r.choice(["de", "en", "fr", "es"]), f"site{r.randrange(300):03d}") for k in range(3000)]
    hilbert_shards.write_shards(spark.createDataFrame(own, "doc_id long, text string, lang string, source string"), str(tmp_path / "own"), 40)
    opened = {}
    for what, low, high in (("source", "site100", "site120"), ("lang", "fr", "fr"), ("size", 20, 40)):
        hit = total = 0
        for f in (tmp_path / "own").rglob("*.parquet"):
            rows = pq.read_table(f, columns=["lang", "source", "text"]).to_pylist()
            values = [len(r["text"].encode()) + 16 if what == "size" else (r[what] or "") for r in rows]
            total += 1
            hit += min(values) <= high and max(values) >= low
        opened[what] = hit / total
    # A sort by one column would leave the others at 1.0.
    assert all(x < 0.8 for x in opened.values()), opened


def test_license_scan_places(docs, nothing):
    got = {r["doc_id"]: r for r in license_scan.scan_licenses(docs).collect()}
    for r in docs.collect():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or ""))
        starts = [k for t in license_scan.TEMPLATES if t.base for k in range(len(words)) if words[k : k + len(t.key.split())] == t.key.split()]
        g = got[r["doc_id"]]
        if r["doc_id"] is not None:
            assert (g["n_words"], g["n_base"], g["first_word"], g["last_word"]) == (len(words), len(starts), min(starts, default=None), max(starts, default=None))
    assert got[14]["base_labels"] == "apache-2,mit" and got[14]["score"] == 1.0
    assert got[22]["labels"] == "all-rights-reserved,cc-by-nc" and got[6]["score"] == 0.0
    assert license_scan.scan_licenses(nothing).count() == 0


def brute_scan(text, templates):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    labels, base, starts, score = set(), set(), [], 0.0
    for t in templates:
        key, line = t.key.split(), t.text.split()
        found = [k for k in range(len(words)) if words[k : k + len(key)] == key]
        if found:
            labels.add(t.label)
            at = found[0] - t.before()
            score = max(score, sum(0 <= at + k < len(words) and words[at + k] == w for k, w in enumerate(line)) / len(line))
            if t.base:
                base.add(t.label)
                starts += found
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score


def test_license_scan_against_a_plain_scan(spark):
    r = random.Random(5)
    many = list(license_scan.TEMPLATES)
    for k in range(86):
        line = [r.choice(["the", "of", "license", f"w{r.randrange(400)}"]) for _ in range(r.randrange(3, 60))]
        at = r.randrange(len(line) - 1)
        many.append(license_scan.Template(f"t{k % 30}", " ".join(line), " ".join(line[at : at + r.randrange(1, 9)])))
    rows = []
    for d in range(150):
        text = [r.choice(["the", "of", "license", "MIT", "x1", f"w{r.randrange(400)}"]) for _ in range(r.randrange(0, 60))]
        for _ in range(r.randrange(4)):
            line = r.choice(many).text.split()
            if r.random() < 0.5:
                line[r.randrange(len(line))] = "changed"
            text[r.randrange(len(text) + 1) : 0] = line
        rows.append((d, ", ".join(text).title() if d % 2 else " ".join(text), "clash"))
    rows += [(500, None, "c"), (500, "", "c"), (None, "All Rights Reserved", "c"), (501, "under the mit license " * 20000, "c"), (501, "under the mit license " * 20000, "c")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, labels string").repartition(3)
    for templates in (license_scan.TEMPLATES, many):
        got = sorted((tuple(x) for x in license_scan.scan_licenses(docs, templates).collect()), key=str)
        want = sorted(((i, *brute_scan(t, templates)) for i, t, _ in rows), key=str)
        assert [g[:-1] for g in got] == [w[:-1] for w in want]
        assert all(abs(g[-1] - w[-1]) < 1e-9 for g, w in zip(got, want))


def test_url_rules_as_a_table_judge_alike(spark):
    r = random.Random(7)
    hosts = ["a.example.net", "b.net", "EXAMPLE.com", "m.org", "ads.site.test", "x.test"]
    urls = [f"http://{r.choice(hosts)}{r.choice(['/en/x', '/de/', '/fr/a', '/login', '/x/ad/y', '/f.exe', ''])}{r.choice(['', '?utm_source=1', '#z'])}" for _ in range(200)]
    urls += [None, "", "no scheme", "http://a.test/" + "long/" * 100000 + "login", "http://b.net/" + "y" * 200000]
    pages = spark.createDataFrame([(k // 2, u, "clash") for k, u in enumerate(urls * 2)], "page_id long, url string, host string")
    more = [*url_filter.HOST_RULES, *[("block", f"h{k}.test", "/") for k in range(300)]]
    for rules in (url_filter.HOST_RULES, more):
        a, b = (sorted((tuple(x) for x in url_filter.judge_urls(pages, rules, plan_rules=n).collect()), key=str) for n in (10**6, 0))
        assert a == b and len(a) == len(urls) * 2 and {x[4] for x in a} == {"allow", "block"}
    assert url_filter.judge_urls(pages, [], []).where("verdict <> 'allow'").count() == 0


def test_url_verdicts(spark):
    cases = [
        ("https://a.example.net/en/x", "a.example.net", "/en/x", "example.net/en/", "allow"), ("http://b.net/", "b.net", "/", "net/", "block"), ("http://b.net", "b.net", "", None, "allow"),
        ("https://EXAMPLE.com/de/1?q#f", "example.com", "/de/1", "example.com/de/", "block"), ("https://notexample.com/de/", "notexample.com", "/de/", None, "allow"),
        ("x.org/fr/", "", "", None, "allow"), (None, "", "", None, "allow"), ("https://m.org/fr/a", "m.org", "/fr/a", "org/fr/", "allow"), ("https://a.com/x?utm_source=y", "a.com", "/x", None, "block"),
        ("https://net/", "net", "/", "net/", "block"), ("http://xnet/", "xnet", "/", None, "allow"),
    ]
    pages = spark.createDataFrame([(k, u, "clash") for k, (u, *_) in enumerate(cases)] * 2, "page_id long, url string, host string")
    got = sorted({(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge_urls(pages).collect()})
    assert got == [(k, *c[1:]) for k, c in enumerate(cases)]
    assert url_filter.judge_urls(pages).count() == 2 * len(cases)
    assert url_filter.judge_urls(pages.limit(0)).count() == 0


def test_repeated_ids_lose_no_text(spark):
    rows = [(1, "a b"), (2, "a b"), (2, "only here"), (3, "x  y"), (3, "x y"), (4, "p"), (4, "q"), (None, "only here"), (None, "z"), (None, "z")]
    left = exact_dedup.drop_exact_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = [(r["doc_id"], " ".join(r["text"].split())) for r in left]
    assert len(got) == len(set(got)) and set(got) == {(1, "a b"), (2, "only here"), (3, "x y"), (4, "p"), (4, "q"), (None, "z")}
