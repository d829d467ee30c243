"""Stateful streams: order of arrival does not matter, silent keys leave the state, last labels win."""

import datetime as dt
import random

import pytest

from lakegauge.operators import replay
from lakegauge.streaming import stateful, streams

START = dt.datetime(2024, 1, 1)
LOG = "client string, scope string, ts timestamp, ok boolean, id long"


def at(seconds):
    return START + dt.timedelta(seconds=seconds)


def feed(spark, path, batches, schema):
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)


def read(spark, path, schema):
    return streams.read_stream(spark, path, spark.createDataFrame([], schema).schema, files_per_batch=1)


@pytest.fixture()
def shuffled_log():
    rng = random.Random(5)
    rows = [(f"c{i % 2}", "anonymous", at(1.5 * i), rng.random() < (0.3 if i % 60 < 30 else 0.9), i) for i in range(160)]
    parts = [rows[:80], rows[80:]]
    for part in parts:
        rng.shuffle(part)
    # a last row far ahead moves the watermark over all others
    return rows, [*parts, [("end", "anonymous", at(90_000), True, 999)], [("end", "anonymous", at(180_000), True, 1000)]]


def test_rate_limits_and_outages_equal_batch(spark, tmp_path, shuffled_log):
    rows, parts = shuffled_log
    path, batch = str(tmp_path / "in"), spark.createDataFrame(rows, LOG)
    feed(spark, path, parts, LOG)
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    streams.append_to(stateful.rate_limits(read(spark, path, LOG), "client", "scope", "ts", "id"), out, check).awaitTermination()
    got = {r.tie: r.allowed for r in spark.read.parquet(out).where("client <> 'end'").collect()}
    want = {r.tie: r.allowed for r in replay.token_bucket(batch, "client", "scope", "ts", "id").collect()}
    assert got == want and 0 < sum(want.values()) < len(want)
    kept = {r.key.client for r in spark.read.format("statestore").option("stateVarName", "memory").load(check).select("key").collect()}
    assert kept <= {"end"}
    assert spark.conf.get(stateful.PROVIDER, "") != stateful.ROCKSDB

    outages = streams.drain(stateful.outage_stream(read(spark, path, LOG), "client", "ts", "id", "ok"))
    want = replay.outages(replay.circuit_breaker(batch, "client", "ts", "id", "ok"), "client").where("closed_us IS NOT NULL")
    assert sorted(map(tuple, outages.collect())) == sorted(map(tuple, want.select("client", "opened_us", "closed_us").collect()))
    assert want.count() > 0


def test_held_alerts_and_expired_state(spark, tmp_path):
    schema = "model string, ts timestamp, bad boolean"
    rows = [("m", at(60 * i), i != 3) for i in range(10)]
    random.Random(1).shuffle(rows)
    path, out, check = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")
    feed(spark, path, [rows[:5], rows[5:], [("other", at(100_000), True)], [("other", at(200_000), True)]], schema)
    streams.append_to(stateful.held_alert_stream(read(spark, path, schema), "model", "ts", "bad", 60, 240), out, check).awaitTermination()
    start = int(at(240).replace(tzinfo=dt.timezone.utc).timestamp())
    assert [tuple(r) for r in spark.read.parquet(out).collect()] == [("m", start, start + 240)]
    kept = {r.key.model for r in spark.read.format("statestore").option("stateVarName", "memory").load(check).select("key").collect()}
    assert "m" not in kept


def test_last_label_wins_and_all_outcomes_come_out(spark, tmp_path):
    ps, fs = "request_id string, prediction int, model_version string, timestamp timestamp", "request_id string, ground_truth int, feedback_at timestamp"
    day = 86_400
    p, f = str(tmp_path / "p"), str(tmp_path / "f")
    feed(spark, p, [[("a", 1, "v", at(0)), ("b", 0, "v", at(5)), ("c", 1, "v", at(9))], [("z", 1, "v", at(30 * day))], [("z2", 1, "v", at(60 * day))]], ps)
    feed(spark, f, [[("a", 0, at(day)), ("ghost", 1, at(day)), ("c", 1, at(8 * day))], [("a", 1, at(2 * day)), ("none", 1, None)], [("y", 1, at(30 * day))], [("y2", 1, at(60 * day))]], fs)
    got = streams.drain(stateful.last_label_stream(read(spark, p, ps), read(spark, f, fs))).where("request_id NOT IN ('y', 'z')").collect()
    assert sorted((r.request_id, r.status, r.ground_truth) for r in got) == [("a", "matched", 1), ("b", "unlabelled", None), ("c", "unlabelled", None), ("c", "unmatched_feedback", 1), ("ghost", "unmatched_feedback", 1)]


def test_last_labels_are_joined_by_the_stream_itself(spark, tmp_path):
    ps, fs = "request_id string, prediction int, model_version string, timestamp timestamp", "request_id string, ground_truth int, feedback_at timestamp"
    p, f = str(tmp_path / "p"), str(tmp_path / "f")
    feed(spark, p, [[("a", 1, "v", at(0))], [("z", 1, "v", at(9_000_000))]], ps)
    feed(spark, f, [[("ghost", 1, at(50)), ("a", 0, at(60))], [("ghost", 0, at(90)), ("y", 1, at(9_000_000))]], fs)
    stream = stateful.last_label_stream(read(spark, p, ps), read(spark, f, fs))
    # one round trip to a Python worker for each request was too slow
    assert "Pandas" not in stream._jdf.queryExecution().analyzed().toString()
    got = stateful.last_unmatched(streams.drain(stream)).where("request_id not in ('y', 'z')").collect()
    assert sorted((r.request_id, r.status, r.ground_truth) for r in got) == [("a", "matched", 0), ("ghost", "unmatched_feedback", 0)]
