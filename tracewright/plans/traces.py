"""Queries over the trace views (pairing, temporal joins, attribution, statistics) with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.operators import attribution as at
from tracewright.operators import pairing as pr
from tracewright.operators import stats as st
from tracewright.operators import temporal as tp
from tracewright.plans.bindings import sql, v_gpu, v_runtime, v_span, v_sync, v_trace

HOUR = 3_600_000_000_000
QUERIES, ORACLES = {}, {}


def query(oracle: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if oracle:
            ORACLES[f.__name__] = oracle
        return f

    return add


_SPANS = "span_id, vpid, vtid, cb, t0, t1"
_STATS = """count(*) AS n, min(t1 - t0) AS min_ns, max(t1 - t0) AS max_ns, CAST(round(avg(t1 - t0), 0) AS BIGINT) AS mean_ns, round(stddev_pop(t1 - t0) / 1e9, 3) AS std_s"""


def _last(keys: str, where: str = "true") -> str:
    return sql("v_trace", f""", n AS (SELECT *, lead(event) OVER w AS e2, lead(ts_ns) OVER w AS t1 FROM v_trace WHERE event IN ('callback_start', 'callback_end') AND {where}
      WINDOW w AS (PARTITION BY {keys} ORDER BY ts_ns, id))
      SELECT id AS span_id, vpid, vtid, cb, ts_ns AS t0, t1 FROM n WHERE event = 'callback_start' AND e2 = 'callback_end'""")


@query(sql("v_span", f"SELECT cb, {_STATS} FROM v_span GROUP BY cb"))
def span_stats(spark, d):
    return pr.span_stats(v_span(spark, d))


@query(_last("vtid"))
def w1_pair_adjacent(spark, d):
    return pr.pair_adjacent(v_trace(spark, d))


@query(sql("v_span", f"SELECT {_SPANS}, lvl FROM v_span"))
def w2_pair_nested(spark, d):
    return pr.pair_nested(v_trace(spark, d))


@query(_last("vpid, vtid, cb"))
def w3_pair_by_key(spark, d):
    return pr.pair_by_key(v_trace(spark, d))


@query(_last("vpid, vtid"))
def w4_pair_thread_last(spark, d):
    return pr.pair_thread_last(v_trace(spark, d))


@query(_last("cb", "cb = '7'"))
def w5_pair_single(spark, d):
    return pr.pair_single(v_trace(spark, d), "7")


@query(sql("v_span", """, g AS (SELECT *, t0 - lag(t0) OVER (PARTITION BY vtid ORDER BY t0, span_id) AS gap FROM v_span),
  r AS (SELECT *, row_number() OVER (PARTITION BY vtid ORDER BY gap, span_id) - 1 AS rn, count(*) OVER (PARTITION BY vtid) AS n FROM g WHERE gap IS NOT NULL)
  SELECT vtid, gap AS period_ns, n + 1 AS arrivals FROM r WHERE rn = n // 2 AND n >= 5"""))
def w6_empirical_period(spark, d):
    return pr.empirical_period(v_span(spark, d), 5, "vtid")


_PERIODS = f""", f AS (SELECT *, CASE WHEN event = 'sync' AND lead(ts_ns) OVER w - ts_ns > {2 * HOUR} THEN 1 ELSE 0 END AS c FROM v_trace WINDOW w AS (PARTITION BY vtid ORDER BY ts_ns, id)),
  p AS (SELECT *, CAST(coalesce(sum(c) OVER (PARTITION BY vtid ORDER BY ts_ns, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS period FROM f)"""


@query(sql("v_trace", _PERIODS + " SELECT id, vtid, period FROM p"))
def w7_sync_gap_periods(spark, d):
    return pr.sync_gap_periods(v_trace(spark, d), 2 * HOUR, "vtid").select("id", "vtid", "period")


@query(sql("v_trace", _PERIODS + " SELECT vtid, period, CAST(count(*) FILTER (event IN ('publish', 'take')) AS BIGINT) AS ops, count(*) AS events FROM p GROUP BY ALL HAVING ops >= 2"))
def w8_productive(spark, d):
    return pr.productive(pr.sync_gap_periods(v_trace(spark, d), 2 * HOUR, "vtid"), ["publish", "take"], 2, "vtid")


@query(sql("v_span", f""", f AS (SELECT cb, floor(t0 / {24 * HOUR}.0) AS b, count(*) AS c FROM v_span GROUP BY ALL),
  s AS (SELECT cb, CAST(max(b) - min(b) + 1 AS BIGINT) AS n, count(*) AS k, CAST(sum(c) AS BIGINT) AS total, sum(c * c) AS q, min(c) AS lo, max(c) AS max_count FROM f GROUP BY cb)
  SELECT cb, n, total, CASE WHEN k < n THEN 0 ELSE lo END AS min_count, max_count, round(total / n, 3) AS mean, round(sqrt(greatest(0.0, q / n - (total / n) * (total / n))), 3) AS std FROM s"""))
def w9_window_counts(spark, d):
    return pr.window_counts(v_span(spark, d).withColumn("t", F.col("t0")), 24 * HOUR, 0, "cb")


def _whole(df, *cols):
    """Nullable ns columns with -1 for null, so that no client turns them into floating point."""
    return df.withColumns({c: F.coalesce(c, F.lit(-1)) for c in cols})


def _points(spark, d, event):
    return v_trace(spark, d).where(F.col("event") == event).select("id", "vpid", "vtid", "cb", F.col("ts_ns").alias("t"))


@query(sql("v_trace", """, l AS (SELECT id, vpid, ts_ns AS t FROM v_trace WHERE event = 'take'), r AS (SELECT vpid, ts_ns AS t FROM v_trace WHERE event = 'publish')
  SELECT l.id, l.vpid, l.t, coalesce(r.t, -1) AS r_t, coalesce(l.t - r.t, -1) AS age FROM l ASOF LEFT JOIN r ON l.vpid = r.vpid AND l.t > r.t"""))
def j8_asof_last(spark, d):
    return _whole(tp.asof_last(_points(spark, d, "take").select("id", "vpid", "t"), _points(spark, d, "publish"), ["vpid"]), "r_t", "age")


@query(sql("v_trace", f""", l AS (SELECT id, vpid, ts_ns AS t FROM v_trace WHERE event = 'take'), r AS (SELECT vpid, ts_ns AS t FROM v_trace WHERE event = 'publish')
  SELECT l.id, l.vpid, l.t, r.t AS r_t FROM l ASOF JOIN r ON l.vpid = r.vpid AND l.t >= r.t WHERE l.t - r.t <= {6 * HOUR}"""))
def j9_asof_tolerance(spark, d):
    return tp.asof_tolerance(_points(spark, d, "take").select("id", "vpid", "t"), _points(spark, d, "publish"), ["vpid"], 6 * HOUR)


@query(sql("v_trace", f""", l AS (SELECT id, vpid, ts_ns AS t, CASE WHEN id % 3 = 0 THEN 0 WHEN id % 3 = 1 THEN ts_ns - {HOUR} END AS ref FROM v_trace WHERE event = 'take'),
  k AS (SELECT *, CASE WHEN coalesce(ref, 0) = 0 THEN t ELSE ref END AS x FROM l), r AS (SELECT vpid, ts_ns AS t FROM v_trace WHERE event = 'publish'),
  b AS (SELECT k.*, r.t AS b FROM k ASOF LEFT JOIN r ON k.vpid = r.vpid AND k.x >= r.t), a AS (SELECT b.*, r.t AS a FROM b ASOF LEFT JOIN r ON b.vpid = r.vpid AND b.x <= r.t),
  m AS (SELECT *, CASE WHEN a IS NULL OR x - b <= a - x THEN b ELSE a END AS match_t FROM a)
  SELECT id, vpid, t, coalesce(ref, -1) AS ref, match_t FROM m WHERE abs(x - match_t) <= {6 * HOUR} AND t >= match_t"""))
def j10_nearest_tolerance(spark, d):
    left = _points(spark, d, "take").select("id", "vpid", "t", F.expr(f"CASE WHEN id % 3 = 0 THEN 0 WHEN id % 3 = 1 THEN t - {HOUR} END").alias("ref"))
    return _whole(tp.nearest_tolerance(left, _points(spark, d, "publish"), ["vpid"], 6 * HOUR), "ref")


@query(sql("v_span", """, p AS (SELECT id, vpid, vtid, ts_ns AS t FROM v_trace WHERE event IN ('publish', 'take')),
  m AS (SELECT p.id, max(struct_pack(t0 := s.t0, span_id := s.span_id)) AS b FROM p JOIN v_span s ON p.vpid = s.vpid AND p.vtid = s.vtid AND p.t BETWEEN s.t0 AND s.t1 GROUP BY p.id)
  SELECT p.id, p.vpid, p.vtid, p.t, coalesce(m.b.span_id, -1) AS span_id, coalesce(m.b.t0, -1) AS t0 FROM p LEFT JOIN m ON p.id = m.id"""))
def j11_interval_owner(spark, d):
    p = v_trace(spark, d).where("event IN ('publish', 'take')").select("id", "vpid", "vtid", F.col("ts_ns").alias("t"))
    return _whole(tp.interval_owner(p, v_span(spark, d), ["vpid", "vtid"]), "span_id", "t0")


@query(sql("v_span", """, p AS (SELECT id, vpid, ts_ns AS t FROM v_trace WHERE event = 'publish')
  SELECT p.id, p.vpid, p.t, count(s.span_id) AS overlaps FROM p LEFT JOIN v_span s ON p.vpid = s.vpid AND p.t BETWEEN s.t0 AND s.t1 GROUP BY ALL"""))
def j12_interval_overlaps(spark, d):
    return tp.interval_overlaps(_points(spark, d, "publish").select("id", "vpid", "t"), v_span(spark, d), ["vpid"])


@query(sql("v_span", "SELECT s.* FROM v_span s WHERE EXISTS (SELECT 1 FROM v_trace p WHERE p.event = 'publish' AND p.vpid = s.vpid AND p.vtid = s.vtid AND p.ts_ns BETWEEN s.t0 AND s.t1)"))
def j13_interval_semi(spark, d):
    return tp.interval_semi(v_span(spark, d), _points(spark, d, "publish"), ["vpid", "vtid"])


@query(sql("v_span", f""", p AS (SELECT id, vpid, vtid, ts_ns AS t FROM v_trace WHERE event = 'take'),
  r AS (SELECT vpid, vtid, t0, min(span_id) AS span_id FROM v_span GROUP BY ALL)
  SELECT p.id, p.vpid, p.vtid, p.t, r.t0 AS r_t, r.span_id AS r_span_id FROM p ASOF JOIN r ON p.vpid = r.vpid AND p.vtid = r.vtid AND p.t <= r.t0 WHERE r.t0 - p.t <= {6 * HOUR}"""))
def j14_next_start(spark, d):
    return tp.next_start(_points(spark, d, "take").select("id", "vpid", "vtid", "t"), v_span(spark, d), ["vpid", "vtid"], 6 * HOUR)


@query(sql("v_trace", """, o AS (SELECT vpid, ts_ns AS t, min(id) AS oid FROM v_trace WHERE event = 'publish' GROUP BY ALL), k AS (SELECT id, vpid, ts_ns AS t, event_name FROM (SELECT *, CAST(id % 3 AS VARCHAR) AS event_name FROM v_trace WHERE event = 'take')),
  m AS (SELECT o.oid, k.event_name, count(*) AS c FROM k ASOF JOIN o ON k.vpid = o.vpid AND k.t <= o.t GROUP BY ALL),
  s AS (SELECT oid, array_to_string(list_sort(list(event_name || ':' || c)), ',') AS inputs FROM m GROUP BY oid) SELECT inputs, count(*) AS outputs FROM s GROUP BY inputs"""))
def j28_bucket_between(spark, d):
    takes = _points(spark, d, "take").select("id", "vpid", "t", F.expr("cast(id % 3 AS string)").alias("item"))
    return tp.bucket_between(takes, _points(spark, d, "publish").select("id", "vpid", "t"), ["vpid"], "item")


@query(sql("v_trace", f""", o AS (SELECT id, vpid, ts_ns AS t, unnest(['0', '1', '2']) AS m FROM v_trace WHERE event = 'publish'), a AS (SELECT vpid, ts_ns AS t, CAST(id % 3 AS VARCHAR) AS m FROM v_trace WHERE event = 'take'),
  j AS (SELECT o.id, o.m, coalesce(o.t - a.t <= {12 * HOUR}, false) AS here FROM o ASOF LEFT JOIN a ON o.vpid = a.vpid AND o.m = a.m AND o.t > a.t)
  SELECT id, coalesce(array_to_string(list_sort(list(m) FILTER (NOT here)), ','), '') AS missing, bool_and(here) AS complete FROM j GROUP BY id"""))
def j29_recent_members(spark, d):
    takes = _points(spark, d, "take").select("id", "vpid", "t", F.expr("cast(id % 3 AS string)").alias("m"))
    return tp.recent_members(_points(spark, d, "publish").select("id", "vpid", "t"), takes, "m", ["0", "1", "2"], 12 * HOUR, ["vpid"])


_OWN = """, own AS (SELECT r.corr, max(struct_pack(t0 := s.t0, span_id := s.span_id)) AS b FROM v_runtime r JOIN v_span s ON r.pid = s.vpid AND r.tid = s.vtid AND r.t BETWEEN s.t0 AND s.t1 GROUP BY r.corr),
  claims AS (SELECT DISTINCT g.pid, g.stream, own.b.t0 AS t, own.b.span_id AS span_id FROM own JOIN v_gpu g ON own.corr = g.corr)"""
_RELEASE = """, rel AS (SELECT pid, stream, t FROM v_sync WHERE sync_type IN (1, 3) UNION SELECT s.pid, g.stream, s.t FROM v_sync s JOIN (SELECT DISTINCT pid, stream FROM v_gpu) g ON s.pid = g.pid WHERE s.sync_type = 4)"""
_ATTR = _OWN + _RELEASE + """, c1 AS (SELECT pid, stream, t, max(span_id) AS span_id FROM claims GROUP BY ALL),
  p AS (SELECT r.corr, r.pid, r.t, g.stream, own.b.span_id AS own FROM v_runtime r JOIN v_gpu g ON r.corr = g.corr LEFT JOIN own ON own.corr = r.corr),
  q AS (SELECT p.*, c1.t AS ct, c1.span_id AS cs FROM p ASOF LEFT JOIN c1 ON p.pid = c1.pid AND p.stream = c1.stream AND p.t >= c1.t),
  z AS (SELECT q.*, rel.t AS rt FROM q ASOF LEFT JOIN rel ON q.pid = rel.pid AND q.stream = rel.stream AND q.t >= rel.t),
  att AS (SELECT corr, pid, t, CASE WHEN own IS NOT NULL THEN 'time' WHEN cs IS NULL THEN 'residual' WHEN coalesce(rt >= ct, false) THEN 'post_release' ELSE 'stream' END AS rule,
    coalesce(own, CASE WHEN NOT coalesce(rt >= ct, false) THEN cs END) AS span_id FROM z)"""


def _attributed(spark, d):
    return at.attribute_runtime(v_runtime(spark, d), v_span(spark, d), v_gpu(spark, d), v_sync(spark, d))


@query(sql("v_span v_gpu", _OWN + " SELECT pid, stream, t, span_id FROM claims"))
def j15_stream_claims(spark, d):
    return at.stream_claims(v_runtime(spark, d), v_span(spark, d), v_gpu(spark, d))


@query(sql("v_span v_gpu v_sync", _ATTR + " SELECT corr, pid, t, rule, coalesce(span_id, -1) AS span_id FROM att"))
def j16_attribute_runtime(spark, d):
    return _whole(_attributed(spark, d), "span_id")


@query(sql("v_gpu v_sync", _RELEASE + " SELECT pid, stream, t FROM rel"))
def j17_releases(spark, d):
    return at.releases(v_sync(spark, d), v_gpu(spark, d))


@query(sql("v_gpu v_sync", """, w AS (SELECT * FROM v_sync WHERE sync_type = 2), b AS (SELECT w.id, max(struct_pack(t := g.t_end, corr := g.corr, stream := g.stream)) AS b FROM w JOIN v_gpu g ON w.pid = g.pid AND w.stream <> g.stream AND g.t_end < w.t GROUP BY w.id)
  SELECT w.id, w.pid, w.stream, w.t, coalesce(b.b.stream, -1) AS before_stream, coalesce(b.b.corr, -1) AS before_corr, coalesce(b.b.t, -1) AS before_t FROM w LEFT JOIN b ON w.id = b.id"""))
def j18_stream_precedence(spark, d):
    return _whole(at.stream_precedence(v_sync(spark, d), v_gpu(spark, d)), "before_stream", "before_corr", "before_t")


@query(sql("v_gpu", "SELECT r.t, r.tid, r.api_name, r.value, r.pid, r.corr, g.kind, coalesce(g.stream, -1) AS stream, coalesce(g.t_start, -1) AS t_start, coalesce(g.t_end, -1) AS t_end FROM v_runtime r LEFT JOIN v_gpu g ON r.pid = g.pid AND r.corr = g.corr"))
def j19_correlate(spark, d):
    return _whole(at.correlate(v_runtime(spark, d), v_gpu(spark, d)), "stream", "t_start", "t_end")


@query(sql("v_span v_gpu v_sync", _ATTR + " SELECT pid, rule, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY pid), 6) AS share FROM att GROUP BY pid, rule"))
def a23_attribution_fractions(spark, d):
    return at.attribution_fractions(_attributed(spark, d))


@query(sql("v_span v_gpu v_sync", _ATTR + """, r AS (SELECT a.t, v.api_name, v.tid FROM att a JOIN v_runtime v ON a.corr = v.corr WHERE rule = 'residual'), e AS (SELECT min(t) AS lo, max(t) AS hi FROM r)
  SELECT api_name, CAST(least(9, (t - lo) * 10 // greatest(hi - lo, 1)) AS INT) AS bin, count(*) AS n, count(DISTINCT tid) AS threads FROM r, e GROUP BY ALL"""))
def a24_residual_summary(spark, d):
    return at.residual_summary(_attributed(spark, d), v_runtime(spark, d))


@query(sql("v_span v_runtime", f""", s AS (SELECT * FROM v_span WHERE t1 - t0 >= {6 * HOUR}), m AS (SELECT corr, pid, tid, unnest([{-HOUR}, 0, {HOUR}]) AS shift, t FROM v_runtime),
  h AS (SELECT shift, EXISTS (SELECT 1 FROM s WHERE s.vpid = m.pid AND s.vtid = m.tid AND m.t + m.shift BETWEEN s.t0 AND s.t1) AS held FROM m),
  c AS (SELECT shift, count(*) AS calls, count(*) FILTER (held) AS covered FROM h GROUP BY shift)
  SELECT shift, calls, covered, round(covered / calls, 6) AS share, shift = first_value(shift) OVER (ORDER BY covered DESC, shift) AS best FROM c"""))
def a34_coverage(spark, d):
    return at.coverage(v_runtime(spark, d), v_span(spark, d), 6 * HOUR, [-HOUR, 0, HOUR])


@query(sql("v_span v_runtime", f""", s AS (SELECT vpid, vtid, t0, t1 FROM v_span WHERE t1 - t0 >= {6 * HOUR}),
  r AS (SELECT pid, tid, corr, t, greatest(t0 - t, {-HOUR}) AS a, least(t1 - t, {HOUR}) AS b FROM v_runtime JOIN s ON pid = vpid AND tid = vtid AND t0 - t <= {HOUR} AND t1 - t >= {-HOUR}),
  c AS (SELECT a AS shift FROM r UNION SELECT b + 1 FROM r WHERE b < {HOUR} UNION SELECT {-HOUR}),
  m AS (SELECT shift, count(DISTINCT corr) AS covered FROM c LEFT JOIN r ON shift BETWEEN a AND b GROUP BY shift), w AS (SELECT min(shift) AS shift, max(covered) AS covered FROM m WHERE covered = (SELECT max(covered) FROM m))
  SELECT shift, (SELECT coalesce(min(m.shift) - 1, {HOUR}) FROM m WHERE m.shift > w.shift AND m.covered <> w.covered) AS until, covered, (SELECT count(*) FROM v_runtime) AS calls FROM w"""))
def a34_best_shift(spark, d):
    """The best shift of the clock within an hour, without a grid of candidates."""
    return at.best_shift(v_runtime(spark, d), v_span(spark, d), 6 * HOUR, -HOUR, HOUR)


@query(sql("v_span v_gpu v_sync", _ATTR + """, r AS (SELECT v.api_name, v.tid FROM att a JOIN v_runtime v ON a.corr = v.corr WHERE rule = 'residual')
  (SELECT api_name AS key, count(*) AS n, 'api' AS what FROM r GROUP BY api_name ORDER BY n DESC, api_name LIMIT 15) UNION ALL SELECT CAST(tid AS VARCHAR), count(*), 'tid' FROM r GROUP BY tid"""))
def a24_residual_tops(spark, d):
    return at.residual_tops(_attributed(spark, d), v_runtime(spark, d))


@query(sql("v_span v_runtime", """, w AS (SELECT vpid, vtid, min(t0) AS a, max(t1) AS b FROM v_span GROUP BY ALL), r AS (SELECT corr, CASE WHEN corr % 7 = 0 THEN pid + 1 ELSE pid END AS pid, tid, t FROM v_runtime),
  o AS (SELECT r.corr, arg_max(s.span_id, struct_pack(a := s.t0, b := s.span_id)) AS o FROM r JOIN v_span s ON r.pid = s.vpid AND r.tid = s.vtid AND r.t BETWEEN s.t0 AND s.t1 GROUP BY r.corr)
  SELECT r.*, coalesce(o, -1) AS span_id, CASE WHEN a IS NULL THEN 'no_callback_thread' WHEN o IS NOT NULL THEN 'inside' WHEN t < a THEN 'before' WHEN t > b THEN 'after' ELSE 'gap' END AS place FROM r LEFT JOIN w ON r.pid = w.vpid AND r.tid = w.vtid LEFT JOIN o ON r.corr = o.corr"""))
def a34_call_places(spark, d):
    r = v_runtime(spark, d).select("corr", F.when(F.col("corr") % 7 == 0, F.col("pid") + 1).otherwise(F.col("pid")).alias("pid"), "tid", "t")
    return _whole(at.call_places(r, v_span(spark, d)), "span_id")


@query(sql("v_span", """, p AS (SELECT id, vpid, vtid, ts_ns AS t FROM v_trace WHERE event = 'publish'), o AS (SELECT p.id, arg_max(s.cb, struct_pack(a := s.t0, b := s.span_id)) AS cb FROM p JOIN v_span s ON p.vpid = s.vpid AND p.vtid = s.vtid AND p.t BETWEEN s.t0 AND s.t1 GROUP BY p.id)
  SELECT coalesce(cb, '') AS cb, count(*) AS outputs FROM p LEFT JOIN o USING (id) GROUP BY 1"""))
def a30_completer_distribution(spark, d):
    return st.completer_distribution(_points(spark, d, "publish"), v_span(spark, d)).na.fill("", ["cb"])


@query(sql("v_span", """, m AS (SELECT * FROM v_span WHERE CAST(cb AS INT) % 2 = 0), x AS (SELECT cb, t1 - t0 AS v, CASE WHEN EXISTS (SELECT 1 FROM v_trace p WHERE p.event = 'publish' AND p.vpid = m.vpid AND p.vtid = m.vtid AND p.ts_ns BETWEEN m.t0 AND m.t1) THEN 'completer' ELSE 'deposit_only' END AS role FROM m),
  r AS (SELECT *, row_number() OVER (PARTITION BY cb, role ORDER BY v) - 1 AS rn, count(*) OVER (PARTITION BY cb, role) AS n FROM x)
  SELECT cb, role, any_value(n) AS n, max(v) FILTER (rn = floor(0.5 * (n - 1))) AS p50, max(v) FILTER (rn = floor(0.9 * (n - 1))) AS p90, max(v) AS max FROM r GROUP BY cb, role"""))
def a30_exec_by_role(spark, d):
    cbs = v_trace(spark, d).where("cast(cb AS int) % 2 = 0").select("cb")
    return st.exec_by_role(v_span(spark, d), _points(spark, d, "publish"), cbs)


_TASKS = "SELECT DISTINCT cb, CAST(cb AS INT) % 4 AS executor, CASE WHEN CAST(cb AS INT) % 3 = 0 THEN 'tmr-nominal' ELSE 'measured' END AS period_source, (1 + CAST(cb AS INT) % 6) * 7200000000000 AS period_ns FROM v_trace WHERE cb IS NOT NULL"


@query(sql("v_trace", f""", k AS ({_TASKS}), f AS (SELECT cb, ts_ns AS t FROM v_trace WHERE event = 'callback_start' AND cb IS NOT NULL), z AS (SELECT max(ts_ns) AS z FROM v_trace),
  nom AS (SELECT * FROM k WHERE period_source = 'tmr-nominal'), hyp AS (SELECT executor, list_sort(list(DISTINCT period_ns)) AS p FROM nom GROUP BY executor),
  he AS (SELECT executor, CAST(list_reduce(p, lambda a, b: CASE WHEN a > 3600000000000 THEN a ELSE lcm(a, b) END) AS BIGINT) AS h FROM hyp), hs AS (SELECT list_sort(list(DISTINCT period_ns))[1] AS h FROM nom),
  ae AS (SELECT executor, min(t) AS a FROM f JOIN nom USING (cb) GROUP BY executor), asess AS (SELECT min(t) AS a FROM f JOIN nom USING (cb)),
  both_ AS (SELECT cb, 'executor' AS scope, h, a, t FROM f JOIN k USING (cb) JOIN he USING (executor) JOIN ae USING (executor) UNION ALL SELECT cb, 'session', h, a, t FROM f JOIN k USING (cb), hs, asess),
  c AS (SELECT cb, scope, h, (t - a) // h AS b, count(*) AS c FROM both_, z WHERE t >= a AND t < z GROUP BY ALL), s AS (SELECT cb, scope, h, max(b) - min(b) + 1 AS n, count(*) AS k, CAST(sum(c) AS BIGINT) AS total, sum(c * c) AS q, min(c) AS lo, max(c) AS max_count FROM c GROUP BY ALL)
  SELECT cb, scope, h AS hyperperiod_ns, CAST(n AS BIGINT) AS n, total, CASE WHEN k < n THEN 0 ELSE lo END AS min_count, max_count, round(total / n, 3) AS mean, round(sqrt(greatest(0.0, q / n - (total / n) * (total / n))), 3) AS std FROM s"""))
def w10_callback_window_stats(spark, d):
    t = v_trace(spark, d).where("cb IS NOT NULL")
    k = F.col("cb").cast("int")
    tasks = t.select("cb", (k % 4).alias("executor"), F.when(k % 3 == 0, "tmr-nominal").otherwise("measured").alias("period_source"), ((1 + k % 6) * 7_200_000_000_000).cast("bigint").alias("period_ns")).distinct()
    end = v_trace(spark, d).agg(F.max("ts_ns")).first()[0] or 0
    return st.callback_window_stats(t.where("event = 'callback_start'").select("cb", F.col("ts_ns").alias("t")), tasks, end)


@query(sql("v_gpu", "SELECT kind, count(*) AS n, CAST(sum(count(*)) OVER () AS BIGINT) AS total FROM v_gpu GROUP BY kind"))
def a36_count_vs_total(spark, d):
    return st.share_of_total(v_gpu(spark, d), "kind")


@query(sql("v_trace", "SELECT event, count(*) AS n FROM v_trace GROUP BY event"))
def a1_event_histogram(spark, d):
    return st.count_by(v_trace(spark, d), "event")


@query(sql("v_gpu", "SELECT kind, count(*) AS n FROM (SELECT kind FROM v_gpu UNION ALL SELECT 'runtime' FROM v_runtime) GROUP BY kind"))
def a2_measurement_counts(spark, d):
    return st.count_by(v_gpu(spark, d).select("kind").unionByName(v_runtime(spark, d).select(F.lit("runtime").alias("kind"))), "kind")


@query(sql("v_trace", """, b AS (SELECT vtid FROM v_trace GROUP BY vtid ORDER BY count(*) DESC, vtid LIMIT 10), m AS (SELECT vtid, event, count(*) AS n FROM v_trace SEMI JOIN b USING (vtid) GROUP BY ALL),
  r AS (SELECT *, row_number() OVER (PARTITION BY vtid ORDER BY n DESC, event) AS rn FROM m) SELECT vtid, event, n, round(100 * n / sum(n) OVER (PARTITION BY vtid), 3) AS pct FROM r WHERE rn <= 10"""))
def a3_thread_mix(spark, d):
    return st.thread_mix(v_trace(spark, d))


@query(sql("v_trace", "SELECT cb, count(*) AS n FROM v_trace WHERE event = 'callback_start' GROUP BY cb ORDER BY n DESC, cb LIMIT 10"))
def a4_top_callbacks(spark, d):
    return st.top(st.count_by(v_trace(spark, d).where("event = 'callback_start'"), "cb"), 10, "n", "cb")


@query(sql("v_trace", """, t AS (SELECT vpid, vtid, cb, count(*) AS n FROM v_trace WHERE event = 'callback_start' AND cb IS NOT NULL GROUP BY ALL ORDER BY n DESC, vpid, vtid, cb LIMIT 10)
  SELECT vpid, vtid, cb, n, CASE WHEN cb LIKE '%1' THEN 'sym' || cb ELSE '?' END AS symbol FROM t"""))
def a4_top_callback_symbols(spark, d):
    t = v_trace(spark, d)
    symbols = t.where("event = 'callback_start' AND cb LIKE '%1'").select("cb", F.concat(F.lit("sym"), "cb").alias("symbol"))
    return st.top_callbacks(t, symbols)


_DUR = "count(*) AS n, CAST(sum(t_end - t_start) AS BIGINT) AS total_ns, CAST(sum(t_end - t_start) // count(*) AS BIGINT) AS mean_ns, min(t_end - t_start) AS min_ns, max(t_end - t_start) AS max_ns"


@query(sql("v_gpu", f"SELECT stream, {_DUR} FROM v_gpu WHERE kind = 'kernel' GROUP BY stream ORDER BY n DESC, stream LIMIT 15"))
def a5_kernel_breakdown(spark, d):
    return st.top(st.activity_breakdown(v_gpu(spark, d).where("kind = 'kernel'"), "stream"), 15, "n", "stream")


@query(sql("v_gpu", f"SELECT kind, {_DUR} FROM v_gpu GROUP BY kind"))
def a6_copy_breakdown(spark, d):
    return st.activity_breakdown(v_gpu(spark, d), "kind")


@query(sql("v_runtime", "SELECT api_name, count(*) AS n FROM v_runtime GROUP BY api_name ORDER BY n DESC, api_name LIMIT 10"))
def a7_api_breakdown(spark, d):
    return st.top(st.count_by(v_runtime(spark, d), "api_name"), 10, "n", "api_name")


@query(sql("v_gpu", """, r AS (SELECT pid, CAST(tid AS VARCHAR) AS thread, 'runtime' AS kind FROM v_runtime UNION ALL SELECT pid, 'GPU', kind FROM v_gpu)
  SELECT pid, thread, count(*) FILTER (kind = 'runtime') AS runtime, count(*) FILTER (kind = 'kernel') AS kernel, count(*) FILTER (kind = 'memcpy') AS memcpy, count(*) FILTER (kind = 'memset') AS memset FROM r GROUP BY ALL"""))
def a8_thread_counts(spark, d):
    return st.thread_counts(v_runtime(spark, d), v_gpu(spark, d))


@query(sql("v_trace", "SELECT vpid, min(ts_ns) AS first_ns FROM v_trace WHERE event = 'publish' AND vpid IS NOT NULL GROUP BY vpid"))
def a9_processes(spark, d):
    return st.processes_by_first_seen(v_trace(spark, d), "publish")


_RANK = ", r AS (SELECT cb, t1 - t0 AS v, row_number() OVER (PARTITION BY cb ORDER BY t1 - t0) - 1 AS rn, count(*) OVER (PARTITION BY cb) AS n FROM v_span)"


@query(sql("v_span", _RANK + """ SELECT cb, any_value(n) AS n, CAST(sum(v) // count(*) AS BIGINT) AS mean, max(v) FILTER (rn = n // 2) AS p50, max(v) FILTER (rn = least(n - 1, floor(0.99 * n))) AS p99, max(v) AS max FROM r GROUP BY cb"""))
def a10_exec_stats(spark, d):
    return st.exec_stats(v_span(spark, d).withColumn("v", F.col("t1") - F.col("t0")), "v", "cb")


@query(sql("v_span", _RANK + " SELECT cb, v AS q, n FROM r WHERE rn = floor(0.9 * (n - 1))"))
def a12_quantile_low(spark, d):
    return st.quantile_low(v_span(spark, d).withColumn("v", F.col("t1") - F.col("t0")), "v", 0.9, "cb")


@query(sql("v_trace", """, l AS (SELECT id, vpid, ts_ns AS t FROM v_trace WHERE event = 'take'), p AS (SELECT vpid, ts_ns AS t FROM v_trace WHERE event = 'publish'),
  a AS (SELECT l.vpid, l.t - p.t AS age FROM l ASOF JOIN p ON l.vpid = p.vpid AND l.t > p.t), r AS (SELECT *, row_number() OVER (PARTITION BY vpid ORDER BY age) - 1 AS rn, count(*) OVER (PARTITION BY vpid) AS n FROM a)
  SELECT vpid, any_value(n) AS n, max(age) FILTER (rn = floor(0.5 * (n - 1))) AS p50, max(age) FILTER (rn = floor(0.9 * (n - 1))) AS p90, max(age) AS max FROM r GROUP BY vpid"""))
def a13_flow_stats(spark, d):
    return st.flow_stats(tp.asof_last(_points(spark, d, "take").select("id", "vpid", "t"), _points(spark, d, "publish"), ["vpid"]), "age", "vpid")


@query(sql("v_trace", "SELECT cb, min(ts_ns) AS first_ns, max(ts_ns) AS last_ns, count(*) AS fires FROM v_trace WHERE event = 'callback_start' GROUP BY cb"))
def a14_fire_bounds(spark, d):
    return st.fire_bounds(v_trace(spark, d))


@query(sql("v_span", f""", e AS (SELECT min(t0) AS lo, max(t1) AS hi FROM v_span), i AS (SELECT *, least(t1, hi) - greatest(t0, lo) AS busy, CAST(least(49, (greatest(t0, lo) - lo) // greatest((hi - lo) // 50, 1)) AS INT) AS bin FROM v_span, e),
  p AS (SELECT vpid, vtid, bin, cb, count(*) AS c, sum(busy) AS busy FROM i GROUP BY ALL)
  SELECT vpid, vtid, bin, CAST(sum(c) AS BIGINT) AS n, CAST(sum(busy) AS BIGINT) AS busy_ns, arg_min(cb, struct_pack(a := -c, b := cb)) AS modal FROM p GROUP BY ALL"""))
def a20_density_bins(spark, d):
    spans = v_span(spark, d)
    lo, hi = spans.agg(F.min("t0"), F.max("t1")).first()
    return st.density_bins(spans, lo or 0, hi or 0, 50)


_MIDDLE = "e AS (SELECT min(t0) AS lo, max(t1) AS hi FROM v_span), m AS (SELECT lo, lo + (hi - lo) // 3 AS upto FROM e)"


@query(sql("v_span", f""", {_MIDDLE}, i AS (SELECT v_span.*, CAST(least(49, (greatest(t0, lo) - lo) // greatest((upto - lo) // 50, 1)) AS INT) AS bin, least(t1, upto) - greatest(t0, lo) AS busy FROM v_span, m WHERE t1 >= lo AND t0 <= upto)
  SELECT 'spans' AS mode, vpid, vtid, count(*) AS rows, CAST(sum(t1 - t0) AS BIGINT) AS ns FROM i GROUP BY ALL UNION ALL SELECT 'density', vpid, vtid, count(DISTINCT bin), CAST(sum(busy) AS BIGINT) FROM i GROUP BY ALL"""))
def a20_lanes(spark, d):
    """Both forms of a lane view over the first third of the time: spans where they are few, bins where they are many."""
    spans = v_span(spark, d)
    lo, hi = spans.agg(F.min("t0"), F.max("t1")).first()
    lo, hi = lo or 0, hi or 0
    upto = lo + (hi - lo) // 3
    few, many = st.lanes(spans, lo, upto, 50, max_spans=1_000_000_000), st.lanes(spans, lo, upto, 50, max_spans=0)
    whole = few.groupBy("vpid", "vtid").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("t1") - F.col("t0")).alias("ns")).withColumn("mode", F.lit("spans"))
    return whole.unionByName(many.groupBy("vpid", "vtid").agg(F.count(F.lit(1)).alias("rows"), F.sum("busy_ns").alias("ns")).withColumn("mode", F.lit("density")))


@query(sql("v_sync", "SELECT sync_type, stream, count(*) AS n FROM v_sync GROUP BY ALL"))
def a22_sync_counts(spark, d):
    return st.count_by(v_sync(spark, d), "sync_type", "stream")


@query(sql("v_trace", "SELECT min(ts_ns) AS start_ns, max(ts_ns) AS end_ns, min(ts_ns) // 1000000 - 1000 AS from_ms, max(ts_ns) // 1000000 + 1000 AS to_ms FROM v_trace"))
def s15_session_bounds(spark, d):
    return st.session_bounds(v_trace(spark, d))


@query(sql("v_trace", "SELECT id, ts_ns, vtid, cb FROM v_trace WHERE event = 'publish' ORDER BY ts_ns, id LIMIT 500"))
def s17_events(spark, d):
    return v_trace(spark, d).where("event = 'publish'").select("id", "ts_ns", "vtid", "cb").orderBy("ts_ns", "id").limit(500)
