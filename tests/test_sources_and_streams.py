"""Text readers, writers and streaming forms."""

import os
import random

from tracewright.operators.pairing import pair_nested
from tracewright.sources import readers, sinks
from tracewright.streaming import streams

TRACE = """[23:59:59.000000001] (+0.1) host1 ros2:callback_start: { cpu_id = 3 }, { procname = "my proc", vpid = 7, vtid = 8 }, { callback = 0xAB, is = 1, name = "a, b = c", arr = [ [0] = 1, [1] = 2 ] }
garbage
[00:00:01.500000000] (+?.?) host1 ros2:callback_end: { cpu_id = 0 }, { procname = "p", vpid = 7, vtid = 8 }, { callback = 0xAB }
"""


def test_trace_text(spark, tmp_path):
    (tmp_path / "t.txt").write_text(TRACE)
    a, b = readers.read_trace_text(spark, str(tmp_path / "t.txt"), "s", "1970-01-01").orderBy("ts_ns").collect()
    day = 86_400_000_000_000
    assert (a["ts_ns"], b["ts_ns"]) == (day - 1_000_000_000 + 1, day + 1_500_000_000)
    assert (a["event"], a["cpu_id"], a["vpid"], a["vtid"], a["procname"], a["host_name"]) == ("ros2:callback_start", 3, 7, 8, "my proc", "host1")
    assert a["payload"] == {"callback": "0xAB", "is": "1", "name": "a, b = c", "arr": "1,2"}


def test_snapshots(spark, tmp_path):
    (tmp_path / "ps").write_text("PID PPID LWP UID USER CMD\n5 1 5 0 root run it now\n5 1 6 0 root thread\n9 1 10 0 root lost\n")
    p, t = readers.parse_process_tree(readers.lines(spark, str(tmp_path / "ps")))
    assert [(r["pid"], r["cmd"]) for r in p.collect()] == [(5, "run it now")] and [r["lwp"] for r in t.collect()] == [6]
    (tmp_path / "c").write_text("/box\n  1  /box/a\n  2  /box/b\n/other\n  1  /other/x\n")
    assert sorted(map(tuple, readers.parse_component_list(readers.lines(spark, str(tmp_path / "c"))).collect())) == [("/box", 1, "/box/a"), ("/box", 2, "/box/b"), ("/other", 1, "/other/x")]
    (tmp_path / "d").write_text("# log\n100 kill talker 44 - why not\n200 up talker - 45 x\nshort\n")
    got = sorted((r["ts_ns"], r["killed_pid"], r["resurrected_pid"], r["cmd"]) for r in readers.parse_daemon_log(readers.lines(spark, str(tmp_path / "d")), 1000).collect())
    assert got == [(1100, 44, None, "why not"), (1200, None, 45, "x")]
    node = spark.createDataFrame([('{"/n": "Subscribers:\\n  /a: std/S\\n  /a: std/S\\nPublishers:\\n  /b: std/T\\n  none"}',)], "value string")
    assert sorted(map(tuple, readers.parse_node_info(node).collect())) == [("/n", "Publishers", "/b", "std/T"), ("/n", "Subscribers", "/a", "std/S")]
    topic = spark.createDataFrame([('{"/a": {"type": "T", "publisher_count": 2, "subscription_count": 0}}',)], "value string")
    assert tuple(readers.parse_topic_info(topic).first()) == ("/a", "T", 2, 0)


def test_activity_and_clock(spark):
    rows = spark.createDataFrame([(5, 9, 1, (3 << 24) | 7), (6, None, 2, 8), (None, 1, 1, 9)], "start long, end long, name long, global_tid long")
    strings = spark.createDataFrame([(1, "kern")], "id long, value string")
    got = sorted((r["ts_ns"], r["duration_ns"], r["name_text"], r["tid"]) for r in readers.read_activity(rows, strings, 100, "name").collect())
    assert got == [(105, 4, "kern", 7), (106, None, None, 8)]
    clock = spark.createDataFrame([("1970-01-01T00:00:05Z", None, None, 4_123_456_789), (None, "1970-01-01 01:00:05", "Europe/Paris", None), (None, None, None, 42)], "utc_text string, local_text string, zone string, epoch_ns long")
    assert [r["start_ns"] for r in readers.session_clock_offset(clock).collect()] == [5_123_456_789, 5_000_000_000, 42]
    frames = spark.createDataFrame([(1, 0, None, 255), (1, 1, "f", 3)], "callchain_id long, depth int, symbol string, ip long")
    assert [(r["symbol"], r["ts_ns"]) for r in readers.read_callchains(frames, 10).orderBy("ts_ns").collect()] == [("0xff", 1010), ("f", 1011)]


def test_sessions_and_graphs(spark, tmp_path):
    ev = spark.createDataFrame([("a", 1, "x"), ("a", 400_000_000_000, "y"), ("b", 2, "z")], "session_id string, ts_ns long, event string")
    path = str(tmp_path / "events")
    sinks.write_events(ev, path)
    sinks.write_events(ev.where("session_id = 'b'").withColumn("event", ev["session_id"]), path, replace=True)
    back = spark.read.parquet(path)
    assert sorted((r["session_id"], r["event"]) for r in back.collect()) == [("a", "x"), ("a", "y"), ("b", "b")]
    assert sinks.session_exists(spark, path, "a") and not sinks.session_exists(spark, path, "q")
    v, e = spark.createDataFrame([("n1", {"k": "v"})], "id string, attrs map<string,string>"), spark.createDataFrame([("n1", "n1", "r")] * 2, "src string, dst string, rel string")
    g = str(tmp_path / "graph")
    sinks.save_graph(v, e, "s", "main", g)
    try:
        sinks.save_graph(v, e, "s", "main", g)
        raise AssertionError("saved twice")
    except ValueError:
        pass
    sinks.save_graph(v, e, "s", "main", g, replace=True)
    v2, e2 = sinks.load_graph(spark, g, "s", "main")
    assert v2.count() == 1 and e2.count() == 1 and sinks.list_graphs(spark, g).count() == 1
    assert sinks.graph_json(v).first()["value"] == '{"id":"n1","k":"v"}'
    p = sinks.promote(v, ["k"]).first()
    assert (p["k"], p["attrs"]) == ("v", {})
    merged = readers.register(spark.createDataFrame([("h", "1", "x")], "id string, a string, b string"), spark.createDataFrame([("h", None, "y"), ("i", "2", None)], "id string, a string, b string"), "id")
    assert sorted(map(tuple, merged.collect())) == [("h", "1", "y"), ("i", "2", None)]


def test_stream_pair_equals_batch(spark, tmp_path):
    r = random.Random(2)
    base = 1_700_000_000_000_000_000
    rows = [(i, base + i * 60_000_000_000 + r.randrange(10**9), 1, r.randrange(2), "c", r.choice(["callback_start", "callback_end"])) for i in range(120)]
    schema = "id long, ts_ns long, vpid long, vtid long, cb string, event string"
    end = [(10_000, base + 10**16, 1, 9, "c", "callback_start")]
    for k, part in enumerate((rows[:50], rows[50:], end)):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{k}"))
    live = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
    q = streams.stream_pair(live, "1 minute").writeStream.format("memory").queryName("pairs").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((x["span_id"], x["t0"], x["t1"]) for x in spark.sql("SELECT * FROM pairs").collect())
    want = sorted((x["span_id"], x["t0"], x["t1"]) for x in pair_nested(spark.createDataFrame(rows, schema)).collect())
    assert got == want and len(want) > 20


def test_stream_ingest(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text(TRACE)
    events = streams.stream_ingest(spark.readStream.text(str(tmp_path / "in")), "s", 0)
    streams.write_stream(events, str(tmp_path / "out"), str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(r["event"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["ros2:callback_end", "ros2:callback_start"]


def test_sync_sessions_with_late_rows_and_silent_keys(spark, tmp_path):
    """Three files, one a batch: periods close at the next row, by the watermark or after the time to live; rows behind the watermark are dropped."""
    minute = 60_000_000_000
    schema = "id long, ts_ns long, event string, k string"
    batches = [
        [(1, 0, "take", "a"), (2, 1, "sync", "a"), (3, 3, "take", "a"), (4, 4, "sync", "a"), (5, 0, "take", "b"), (6, 2, "take", "c"), (7, 30, "take", "x")],
        [(8, 12, "take", "a"), (9, 29, "take", "a"), (10, 60, "take", "x"), (11, 31, "sync", "b")],
        [(12, 5, "take", "a"), (13, 45, "take", "b"), (14, 200, "take", "x")],
    ]
    (tmp_path / "in").mkdir()
    for k, rows in enumerate(batches):
        spark.createDataFrame([(i, (t + 1000) * minute, e, key) for i, t, e, key in rows], schema).coalesce(1).write.parquet(str(tmp_path / f"b{k}"))
        part = next((tmp_path / f"b{k}").glob("*.parquet"))
        part.rename(tmp_path / "in" / f"{k}.parquet")
        os.utime(tmp_path / "in" / f"{k}.parquet", (1_000_000 + k, 1_000_000 + k))
    live = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = streams.stream_sync_sessions(live, 5 * minute, "k", delay="1 minute", ttl_ns=60 * minute)
    q = out.writeStream.format("memory").queryName("periods").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r["k"], r["start_ns"] // minute - 1000, r["end_ns"] // minute - 1000, r["n"], r["closed"]) for r in spark.table("periods").collect())
    # a: 0 to 4 ends with a sync and a gap; row 8 comes behind the watermark (29) and is dropped, as is row 12; 29 is left open and then silent.
    # b: 0 to 31 ends with a sync, 45 comes behind the watermark (59); c: 2 is silent; x: 30 and 60 are one silent period, 200 is not passed yet.
    assert got == [("a", 0, 4, 4, True), ("a", 29, 29, 1, False), ("b", 0, 31, 2, True), ("c", 2, 2, 1, False), ("x", 30, 60, 2, False)]


def test_stream_ingest_puts_lines_at_the_day_nearest_to_their_arrival(spark):
    from pyspark.sql import functions as F

    line = '[%s.000000005] (+0.1) host1 ev:x: { cpu_id = 3 }, { procname = "my proc", vpid = 7, vtid = 8 }, { n = 1 }'
    rows = [(line % "23:59:59", "2024-05-01 23:59:59"), (line % "23:59:59", "2024-05-02 00:00:03"), (line % "00:00:01", "2024-05-02 00:00:03"), (line % "12:30:00", "2024-05-02 13:00:00"), ("noise", "2024-05-02 13:00:00")]
    df = spark.createDataFrame(rows, "value string, t string").withColumn("at", F.to_timestamp("t"))
    got = streams.stream_ingest(df, "s", arrived="at").collect()
    seen = [r["ts"] for r in streams.stream_ingest(df, "s", arrived="at").select(F.date_format(F.timestamp_micros(F.expr("ts_ns div 1000")), "yyyy-MM-dd HH:mm:ss").alias("ts")).collect()]
    assert seen == ["2024-05-01 23:59:59", "2024-05-01 23:59:59", "2024-05-02 00:00:01", "2024-05-02 12:30:00"]
    assert all((r["host_name"], r["cpu_id"], r["procname"], r["vpid"], r["vtid"], r["ts_ns"] % 1000) == ("host1", 3, "my proc", 7, 8, 5) for r in got)
    fixed = streams.stream_ingest(df, "s", 0).first()
    assert fixed["ts_ns"] == ((23 * 60 + 59) * 60 + 59) * 10**9 + 5
