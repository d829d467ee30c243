"""Streams over files that arrive one by one, with late rows and a restart."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from lakegauge.operators import replay
from lakegauge.streaming import streams

SCHEMA = "request_id string, client string, scope string, ts timestamp, ok boolean, id long"


def put(spark, folder, name, rows):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))


def at(minute, second=0):
    return dt.datetime(2024, 1, 1, 0, 0, second) + dt.timedelta(minutes=minute)


@pytest.fixture()
def feed(spark, tmp_path):
    folder = tmp_path / "in"

    def add(rows):
        put(spark, folder, "x", [(f"r{i}", "c", "anonymous", t, ok, i) for i, t, ok in rows])

    return folder, add


def stream(spark, folder):
    return streams.read_stream(spark, str(folder), spark.createDataFrame([], SCHEMA).schema, files_per_batch=1)


def test_windows_close_and_late_rows_are_dropped(spark, feed, tmp_path):
    folder, add = feed
    add([(1, at(1), True), (2, at(2), False)])
    out, check = str(tmp_path / "out"), str(tmp_path / "check")

    def advance():
        s = streams.error_rate_stream(stream(spark, folder), ["client"], "ts", ~F.col("ok"))
        streams.append_to(s, out, check).awaitTermination()

    advance()
    add([(3, at(40), True)])
    advance()
    add([(4, at(3), False), (5, at(90), True)])  # at(3) is behind the watermark
    advance()
    rows = {r.window_start.minute: (r.requests, r.errors) for r in spark.read.parquet(out).collect()}
    assert rows == {0: (2, 1), 40: (1, 0)}


def test_unlabelled_prediction_comes_out_after_the_horizon(spark, tmp_path):
    p, f = str(tmp_path / "p"), str(tmp_path / "f")
    ps, fs = "request_id string, prediction int, model_version string, timestamp timestamp", "request_id string, ground_truth int, feedback_at timestamp"
    day = lambda d: dt.datetime(2024, 1, 1) + dt.timedelta(days=d)
    put_ = lambda path, rows, schema: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    put_(p, [("a", 1, "v", day(0)), ("b", 0, "v", day(0))], ps)
    put_(f, [("a", 1, day(1)), ("ghost", 1, day(1))], fs)
    put_(p, [("z", 1, "v", day(30))], ps)
    put_(f, [("y", 1, day(30))], fs)
    read = lambda path, schema: streams.read_stream(spark, path, spark.createDataFrame([], schema).schema)
    rows = streams.drain(streams.match_stream(read(p, ps), read(f, fs))).collect()
    assert {(r.request_id, r.status) for r in rows} == {("a", "matched"), ("b", "unlabelled"), ("ghost", "unmatched_feedback")}


def test_token_state_survives_a_restart(spark, feed, tmp_path):
    folder, add = feed
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    rows = [(i, at(0, i), True) for i in range(12)]
    for part in (rows[:7], rows[7:]):
        add(part)
        s = streams.rate_limit_stream(stream(spark, folder), "client", "scope", "ts", "id")
        streams.append_to(s, out, check).awaitTermination()
    got = {r.tie: r.allowed for r in spark.read.parquet(out).collect()}
    batch = spark.createDataFrame([("c", "anonymous", t, i) for i, t, _ in rows], "client string, scope string, ts timestamp, id long")
    want = {r.tie: r.allowed for r in replay.token_bucket(batch, "client", "scope", "ts", "id").collect()}
    assert got == want and not all(got.values())


def test_hold_needs_an_unbroken_run(spark, tmp_path):
    schema = "model string, ts timestamp, bad boolean"
    rows = [("m", at(i), i not in (3,)) for i in range(10)]
    path = str(tmp_path / "w")
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(path)
    s = streams.read_stream(spark, path, spark.createDataFrame([], schema).schema)
    got = streams.drain(streams.hold_stream(s, "model", "ts", "bad", 60, 240)).collect()
    start = int(at(4).replace(tzinfo=dt.timezone.utc).timestamp())
    assert [(r.since, r.fires_at) for r in got] == [(start, start + 240)]


def test_buffer_gauges_and_histograms_over_batches(spark, feed, tmp_path):
    folder, add = feed
    rows = [(i, at(i % 7, i), i % 3 == 0) for i in range(30)]
    for part in (rows[:10], rows[10:20], rows[20:]):
        add(part)
    source = lambda: stream(spark, folder)
    path = lambda name: str(tmp_path / name)
    streams.newest_stream(source(), 8, path("new"), path("new-check"), "ts", "id").awaitTermination()
    got = {r.id for r in streams.read_newest(spark, path("new")).collect()}
    assert got == {i for i, _, _ in sorted(rows, key=lambda r: (r[1], r[0]))[-8:]}
    streams.gauge_stream(source(), ["client"], "id", "ts", "id", path("gauge"), path("gauge-check")).awaitTermination()
    assert [r.value for r in streams.read_gauges(spark, path("gauge"), ["client"], "ts").collect()] == [max(rows, key=lambda r: (r[1], r[0]))[0]]
    streams.histogram_stream(source(), ["client"], "id", path("hist"), path("hist-check")).awaitTermination()
    counts = {r.le: r.cumulative for r in streams.read_histograms(spark, path("hist"), ["client"]).collect()}
    assert counts["10"] == 11 and counts["25"] == 26 and counts["inf"] == 30
