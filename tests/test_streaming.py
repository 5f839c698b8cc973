"""Streaming forms give the rows of their batch forms, over files that arrive one by one."""

import datetime as dt

from pyspark.sql import functions as F

from harborlight.operators import desk, upsert
from harborlight.streaming import queries

SCHEMA = "symbol string, id long, price double, at long, fetched_at timestamp"


def land(spark, path, rows):
    for i in range(3):
        spark.createDataFrame(rows[i * len(rows) // 3 : (i + 1) * len(rows) // 3], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def quotes():
    start = dt.datetime(2024, 1, 1)
    return [(f"S{i % 4}", i, float(i * 37 % 100), i * 60, start + dt.timedelta(minutes=i)) for i in range(90)]


def collect(df, name, mode, tmp_path):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / f"ck-{name}")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return df.sparkSession.table(name).collect()


def test_edge_alerts(spark, tmp_path):
    got = collect(queries.edge_alerts(land(spark, str(tmp_path / "in"), quotes()), 60.0), "alerts", "append", tmp_path)
    want = desk.edge_alerts(spark.createDataFrame(quotes(), SCHEMA), 60.0).collect()
    assert {r.id for r in got} == {r.id for r in want} and want


def test_latest_rows(spark, tmp_path):
    got = collect(queries.latest_rows(land(spark, str(tmp_path / "in"), quotes()), "symbol", "fetched_at", "id"), "latest", "complete", tmp_path)
    assert {r.symbol: r.id for r in got} == {f"S{k}": max(i for i in range(90) if i % 4 == k) for k in range(4)}


def test_day_counts(spark, tmp_path):
    got = collect(queries.day_counts(land(spark, str(tmp_path / "in"), quotes()), "fetched_at", "symbol"), "days", "complete", tmp_path)
    assert sum(r.n for r in got) == 90 and {r.window.start.hour for r in got} == {16}


def test_exact_dedup(spark, tmp_path):
    rows = [(s, i % 30, p, a, t) for s, i, p, a, t in quotes()]
    got = collect(queries.exact_dedup(land(spark, str(tmp_path / "in"), rows), ["id"], "fetched_at", "10 hours"), "dedup", "append", tmp_path)
    assert sorted(r.id for r in got) == list(range(30))


def test_snapshot_sink(spark, tmp_path):
    stream = land(spark, str(tmp_path / "in"), quotes())
    q = stream.writeStream.foreachBatch(queries.snapshot_sink(str(tmp_path / "out"), ["symbol"])).option("checkpointLocation", str(tmp_path / "ck")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert upsert.read_snapshot(spark, str(tmp_path / "out")).count() == 4


def test_near_title_sink(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    rows = [(1, "alpha beta gamma delta epsilon", start), (2, "alpha beta gamma delta epsilon", start + dt.timedelta(minutes=5)), (3, "quite another headline about things", start), (4, "alpha beta gamma delta epsilon", start + dt.timedelta(hours=3))]
    batch = spark.createDataFrame(rows, "news_id long, title string, effective_at timestamp")
    out = str(tmp_path / "titles")
    sink = queries.near_title_sink(out, out)
    sink(batch, 0)
    sink(batch.withColumn("news_id", F.col("news_id") + 10), 1)
    assert sorted(r.news_id for r in spark.read.parquet(out).collect()) == [1, 3, 4]


def test_due_sources_back_off(spark, tmp_path):
    start = dt.datetime(2024, 1, 1)
    path, schema = str(tmp_path / "in"), "source string, cadence_seconds long, status string, at timestamp"
    # (source, status, minute): the clock is the latest time seen.
    batches = [
        [("a", "success", 0), ("b", "http_error", 0), ("c", "empty", 0)], [("clock", "success", 1)], [("clock", "success", 2)], [("b", "timeout", 3), ("c", "empty", 3)], [("c", "empty", 4), ("b", "timeout", 4)],
        [("c", "empty", 5), ("b", "timeout", 5)], [("clock", "success", 30)], [("clock", "success", 31)],
    ]
    for rows in batches:
        spark.createDataFrame([(s, 60, status, start + dt.timedelta(minutes=m)) for s, status, m in rows], schema).coalesce(1).write.mode("append").parquet(path)
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "ck")

    def run(most):
        stream = queries.due_sources(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path))
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        return [(r.source, r.kind, (r.due_at - int(start.replace(tzinfo=dt.UTC).timestamp())) // 60) for r in spark.read.parquet(out).collect() if r.source != "clock"]

    got = run(0)
    planned = {k: sorted(m for s, kind, m in got if s == k and kind == "next") for k in "abc"}
    assert planned == {"a": [1], "b": [2, 7, 12, 13], "c": [1, 4, 6, 9]}  # 2, 4, 8, 8 times after failures; 1, 1, 2, 4 times after empty results
    due = {k: sorted(m for s, kind, m in got if s == k and kind == "due") for k in "abc"}
    assert due["a"] == [1] and due["b"][-1] == 13 and due["c"][-1] == 9 and set(due["b"]) <= set(planned["b"]) and set(due["c"]) <= set(planned["c"])
    assert sorted(run(0)) == sorted(got)  # after a restart nothing fires again


def test_queue_drain(spark, tmp_path):
    start, path = dt.datetime(2024, 1, 1), str(tmp_path / "queue")
    rows = lambda ids, minute: spark.createDataFrame([(i, start + dt.timedelta(minutes=minute)) for i in ids], "id long, at timestamp")
    waiting = [100, 101, 102, 103]
    sink = queries.queue_drain_sink(path, 3, lambda s: s.createDataFrame([(i,) for i in waiting], "id long"), 300)
    claimed = lambda n: [(r.id, r.from_scan) for r in spark.read.parquet(f"{path}/claimed/batch={n}").orderBy("id").collect()]
    queued = lambda n: sorted(r.id for r in spark.read.parquet(f"{path}/queue/batch={n}").collect())
    plain = lambda *ids: [(i, False) for i in ids]
    sink(rows([5, 9, 7, 8, 6], 0), 0)
    assert claimed(0) == plain(5, 6, 7) and queued(0) == [8, 9]
    sink(rows([1, 9, 2], 1), 1)  # 9 is queued already; 1 and 2 come after what was over
    assert claimed(1) == plain(1, 8, 9) and queued(1) == [2]
    sink(rows([1, 9, 2], 1), 1)  # the batch comes again
    assert claimed(1) == plain(1, 8, 9) and queued(1) == [2]
    again = queries.queue_drain_sink(path, 3, lambda s: s.createDataFrame([(i,) for i in waiting], "id long"), 300)  # a restart
    again(rows([None], 2), 2)
    assert claimed(2) == plain(2) and queued(2) == []
    again(rows([None], 3), 3)  # nothing queued: the first scan
    assert claimed(3) == [(100, True), (101, True), (102, True)]
    again(rows([None], 4), 4)  # the next scan is not due
    assert claimed(4) == [] and queued(4) == []
    waiting[:] = [103]
    again(rows([None], 8), 5)
    assert claimed(5) == [(103, True)]
    again(rows([4], 20), 6)  # what is queued goes first
    assert claimed(6) == plain(4)


def test_edge_alerts_stay_quiet(spark, tmp_path):
    got = collect(queries.edge_alerts(land(spark, str(tmp_path / "in"), quotes()), 60.0, 900), "quiet_alerts", "append", tmp_path)
    want, over, last = set(), {}, {}
    for symbol, i, price, at, _ in quotes():
        if price >= 60 and not over.get(symbol) and at - last.get(symbol, -(10**9)) >= 900:
            want.add(i)
            last[symbol] = at
        over[symbol] = price >= 60
    assert {r.id for r in got} == want and 0 < len(want) < len(desk.edge_alerts(spark.createDataFrame(quotes(), SCHEMA), 60.0).collect())


def test_bounded_stream(spark, tmp_path):
    path = str(tmp_path / "stream")
    sink = queries.bounded_stream_sink(path, 4, "id")
    batch = lambda *ids: spark.createDataFrame([(i, f"e{i}") for i in ids], "id long, event string")
    kept = lambda n: sorted(r.id for r in spark.read.parquet(f"{path}/batch={n}").collect())
    sink(batch(9, 8, 7), 0)
    sink(batch(1, 2), 1)
    assert kept(0) == [7, 8, 9] and kept(1) == [1, 2, 8, 9]
    sink(batch(1, 2), 1)  # the batch comes again
    sink(batch(), 2)
    sink(batch(3, 4, 5, 6, 7), 3)
    assert kept(1) == kept(2) == [1, 2, 8, 9] and kept(3) == [4, 5, 6, 7]
