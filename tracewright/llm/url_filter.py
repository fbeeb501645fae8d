"""URL verdicts: rules indexed by their rarest literal token, regular expressions for candidates only."""

from __future__ import annotations

import json
import re
import zlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm.common import BROADCAST_ROWS, table

#: Fixed by the contract: (verdict, host, path).
HOST_RULES = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]
#: The method's own rules, asked where no host rule fits: (name, literal tokens, pattern over host, path and query).
#: A match must hold every token as a whole word; of a token with '|', one of the words between.
PATTERN_RULES = [
    ("tracking", ["utm", "source"], r"[?&]utm_source="),
    ("session", ["sessionid"], r"[?&;]sessionid="),
    ("login", ["login"], r"/login(/|\?|$)"),
    ("cart", ["cart"], r"/cart(/|\?|$)"),
    ("calendar", ["calendar"], r"/calendar/[0-9]{4}"),
    ("download", ["exe"], r"\.exe(\?|$)"),
    ("archive", ["zip"], r"\.zip(\?|$)"),
    ("ads", ["ad|ads"], r"^ads?\.|/ads?/"),
]
_RULE = "struct<word:string,size:int,name:string,verdict:string,kind:string,pattern:string>"
#: Rules that may be part of the plan.
PLAN_RULES = 2_000


def url_parts(url: Column) -> tuple[Column, Column, Column]:
    """host, path and path with query of a URL; empty where the URL is null or has no '://'."""
    url = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), _UPPER, _UPPER.lower())
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^#]*)", 1)
    return host, rest, query


_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _compiled(host_rules, pattern_rules) -> list[dict]:
    rules = []
    for verdict, host, path in host_rules:
        pattern = rf"^([^/?#]*\.)?{re.escape(host)}{re.escape(path)}"
        # A path fits by its start, so its last word may go on in the URL.
        words = re.findall("[a-z0-9]+", host.lower()) + re.findall("[a-z0-9]+(?=[^a-z0-9])", path.lower())
        rules.append({"size": len(host + path), "name": host + path, "verdict": verdict, "kind": "host", "pattern": pattern, "words": words})
    for name, words, pattern in pattern_rules:
        rules.append({"size": 0, "name": name, "verdict": "block", "kind": "pattern", "pattern": pattern, "words": words})
    return rules


def _filed(rules: list[dict], counts: dict[str, int]) -> list[tuple[str, dict]]:
    """(word, rule): each rule under its rarest word, or under each of the words that stand for it."""
    out = []
    for r in rules:
        rarest = min(r["words"], key=lambda w: (sum(counts.get(x, 0) for x in w.split("|")), w))
        out += [(word, {k: v for k, v in r.items() if k != "words"}) for word in rarest.split("|")]
    return out


def _fetched(words: Column, filed: list[tuple[str, dict]]) -> Column:
    """The rules that a URL's words fetch, from an index in the plan: a word's crc32 names its slot, so a look-up does not depend on the number of rules."""
    slots: list = [[] for _ in range(max(16, 4 * len(filed)))]
    for word, rule in filed:
        slots[zlib.crc32(word.encode()) % len(slots)].append({"word": word} | rule)
    index = F.from_json(F.lit(json.dumps({"v": slots})), f"v array<array<{_RULE}>>")["v"]
    fetch = lambda w: F.get(index, (F.crc32(w.cast("binary")) % len(slots)).cast("int"))
    return F.flatten(F.transform(words, lambda w: F.filter(fetch(w), lambda r: r["word"] == w)))


def judge_urls(pages: DataFrame, host_rules=HOST_RULES, pattern_rules=PATTERN_RULES, plan_rules: int = PLAN_RULES) -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, verdict, pattern.

    How often each rule word occurs is counted over all URLs; every rule is filed under its rarest
    word, or under each of the words that stand for it. A URL's words fetch the rules filed under them and only those run their
    expression. Up to plan_rules rules the index is part of the plan and judging needs no shuffle; more rules are a table, joined
    with the words of all URLs (broadcast only if it has at most BROADCAST_ROWS rows), and each URL's fits are gathered again.
    Of the counts one number per rule word reaches the driver, where the rules are. The longest host rule that fits wins (ties: by text); else the
    first fitting pattern (by name) blocks; else the verdict is allow.

    A null or malformed url has empty host and path and verdict allow. Repeated rows are judged one by
    one; very long URLs are searched whole. Columns of pages other than page_id and url are ignored.
    """
    spark = pages.sparkSession
    host, path, full = url_parts(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"), F.concat(host, full).alias("subject"))
    parts = parts.withColumn("words", F.array_distinct(F.split(F.lower("subject"), "[^a-z0-9]+")))
    rules = _compiled(host_rules, pattern_rules)
    vocabulary = sorted({w for r in rules for words in r["words"] for w in words.split("|")})
    seen = parts.select(F.explode("words").alias("word"))
    if len(rules) <= plan_rules:
        seen = parts.select(F.explode(F.array_intersect("words", F.array(*[F.lit(w) for w in vocabulary]).cast("array<string>"))).alias("word")) if vocabulary else None
    else:
        seen = seen.join(spark.createDataFrame([(w,) for w in vocabulary], "word string"), "word", "left_semi")
    filed = _filed(rules, {r["word"]: r["count"] for r in seen.groupBy("word").count().collect()} if seen is not None else {})
    if len(rules) <= plan_rules:
        fits = parts.withColumn("fits", F.filter(_fetched(F.col("words"), filed), lambda r: F.regexp_like("subject", r["pattern"])))
        best = F.array_max(F.transform(F.filter("fits", lambda r: r["kind"] == "host"), lambda r: F.struct(r["size"].alias("size"), r["name"].alias("name"), r["verdict"].alias("verdict"))))
        pattern = F.array_min(F.transform(F.filter("fits", lambda r: r["kind"] == "pattern"), lambda r: r["name"]))
        judged = fits.select("page_id", "host", "path", best.alias("best"), pattern.alias("hit"))
    else:
        index = spark.createDataFrame([(w, r["size"], r["name"], r["verdict"], r["kind"], r["pattern"]) for w, r in filed], "word string, size int, name string, verdict string, kind string, pattern string")
        index = F.broadcast(index) if len(filed) <= BROADCAST_ROWS else index
        rows = parts.withColumn("row", F.monotonically_increasing_id())
        fits = rows.select("row", "subject", F.explode("words").alias("word")).join(index, "word").where(F.regexp_like("subject", F.col("pattern")))
        fits = fits.groupBy("row").agg(F.max(F.when(F.col("kind") == "host", F.struct("size", "name", "verdict"))).alias("best"), F.min(F.when(F.col("kind") == "pattern", F.col("name"))).alias("hit"))
        judged = rows.join(fits, "row", "left").select("page_id", "host", "path", "best", "hit")
    return judged.select(
        "page_id", "host", "path",
        F.col("best.name").alias("rule"),
        F.coalesce(F.col("best.verdict"), F.when(F.col("hit").isNotNull(), "block").otherwise("allow")).alias("verdict"),
        F.when(F.col("best").isNull(), F.col("hit")).alias("pattern"),
    )


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


def _sql() -> str:
    cases = sorted(HOST_RULES, key=lambda r: -len(r[1] + r[2]))
    fits = [f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))" for _, h, p in cases]
    rule = " ".join(f"WHEN {f} THEN '{h}{p}'" for f, (_, h, p) in zip(fits, cases))
    verdict = " ".join(f"WHEN {f} THEN '{v}'" for f, (v, _, _) in zip(fits, cases))
    hits = " ".join(f"WHEN regexp_matches(subject, '{p}') THEN '{n}'" for n, _, p in sorted(PATTERN_RULES))
    return rf"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
p AS (SELECT page_id,
        translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_UPPER.lower()}') AS host,
        regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
        regexp_extract(url, '(?s)^.*?://[^/?#]*([^#]*)', 1) AS q FROM u),
s AS (SELECT page_id, host, path, host || q AS subject FROM p),
j AS (SELECT page_id, host, path, CASE {rule} END AS rule, CASE {verdict} END AS said, CASE {hits} END AS hit FROM s)
SELECT page_id, host, path, rule,
       coalesce(said, CASE WHEN hit IS NULL THEN 'allow' ELSE 'block' END) AS verdict,
       CASE WHEN rule IS NULL THEN hit END AS pattern
FROM j
"""


QUERIES = {"op8_url_filter": op8_url_filter}
ORACLES = {"op8_url_filter": _sql()}
