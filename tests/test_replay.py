"""Sequential rules: the sliced replay must equal the plain one."""

import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lakegauge.operators import replay


@pytest.mark.parametrize("scope", ["predict", "admin", "anonymous"])
def test_bucket_transfer_equals_replay(scope):
    capacity, rate = replay.bucket_units(scope)
    rng = np.random.default_rng(1)
    for trial in range(20):
        scale = [2e5, 2e6, 8e6][trial % 3]
        times = np.cumsum(rng.exponential(scale, 60)).astype(np.int64)
        pieces = replay.bucket_transfer(times, capacity, rate)
        for x in [0, 1, replay.UNIT - 1, replay.UNIT, capacity - 1, capacity, *rng.integers(0, capacity, 50).tolist()]:
            assert replay.apply_transfer(pieces, int(x)) == replay.bucket_replay(times, int(x), capacity, rate)[1]


def test_breaker_transfer_equals_replay():
    rng = np.random.default_rng(2)
    for trial in range(40):
        times = np.cumsum(rng.exponential(6e6, 80)).astype(np.int64) + 100_000_000
        ok = rng.random(80) < [0.3, 0.6, 0.9][trial % 3]
        t = replay.breaker_transfer(times, ok)
        for s in range(replay.OPEN):
            _, _, state, at = replay.breaker_replay(times, ok, s, 0)
            got = replay.breaker_apply(t, s, 0)
            assert got[0] == state and (state != replay.OPEN or got[1] == at)
        for back in rng.integers(0, 40_000_000, 30):
            _, _, state, at = replay.breaker_replay(times, ok, replay.OPEN, int(times[0] - back))
            got = replay.breaker_apply(t, replay.OPEN, int(times[0] - back))
            assert got[0] == state and (state != replay.OPEN or got[1] == at)


def test_sliced_run_equals_whole_run(spark):
    rng = np.random.default_rng(5)
    n = 1500
    pdf = pd.DataFrame(
        {
            "id": range(n),
            "client": np.where(rng.random(n) < 0.6, "busy", "calm"),
            "scope": "admin",
            "ts": pd.to_datetime(np.cumsum(rng.exponential(4e8, n)).astype("int64") + 1_700_000_000_000_000_000),
            "ok": rng.random(n) < 0.6,
        }
    )
    log = spark.createDataFrame(pdf)
    whole = replay.token_bucket(log, "client", "scope", "ts", "id").orderBy("tie").toPandas()
    cut = replay.token_bucket(log, "client", "scope", "ts", "id", key_rows=100, fan=3).orderBy("tie").toPandas()
    assert 0 < whole.allowed.sum() < n
    pd.testing.assert_frame_equal(whole, cut)
    whole = replay.circuit_breaker(log, "client", "ts", "id", "ok").orderBy("tie").toPandas()
    cut = replay.circuit_breaker(log, "client", "ts", "id", "ok", key_rows=100, fan=3).orderBy("tie").toPandas()
    assert set(whole.state) >= {0, 7}
    pd.testing.assert_frame_equal(whole, cut)
    spans = replay.outages(replay.circuit_breaker(log, "client", "ts", "id", "ok"), "client").toPandas()
    expected = 0
    for _, g in whole.sort_values(["us", "tie"]).groupby("client"):
        is_open = False
        for s in g.state:
            if s == 7 and not is_open:
                is_open = True
                expected += 1
            elif s < 5:
                is_open = False
    assert len(spans) == expected


def test_composed_transfers_equal_one_transfer():
    rng = np.random.default_rng(3)
    for scope in ("predict", "admin", "anonymous"):
        capacity, rate = replay.bucket_units(scope)
        for trial in range(25):
            times = np.cumsum(rng.exponential([2e5, 2e6, 8e6][trial % 3], 60)).astype(np.int64)
            a, b = times[:25], times[25:]
            both = replay.compose_transfers(replay.bucket_transfer(a, capacity, rate), int(b[0] - a[-1]) * rate, replay.bucket_transfer(b, capacity, rate), capacity)
            for x in [0, replay.UNIT - 1, replay.UNIT, capacity - 1, capacity, *rng.integers(0, capacity, 60).tolist()]:
                assert replay.apply_transfer(both, int(x)) == replay.bucket_replay(times, int(x), capacity, rate)[1]
    for trial in range(60):
        times = np.cumsum(rng.exponential([6e6, 6e5][trial % 2], 90)).astype(np.int64) + 100_000_000
        ok = rng.random(90) < [0.3, 0.6, 0.9][trial % 3]
        parts = [(times[i : i + 18], ok[i : i + 18]) for i in range(0, 90, 18)]
        body = replay.breaker_transfer(*parts[0])
        for more in parts[1:]:
            body = replay.compose_breakers(body, int(times[0]) + replay.RECOVERY, replay.breaker_transfer(*more))
        starts = [(s, 0) for s in range(replay.OPEN)] + [(replay.OPEN, int(times[0] - back)) for back in rng.integers(0, 40_000_000, 30)]
        for s, at in starts:
            _, _, state, failed = replay.breaker_replay(times, ok, s, at)
            got = replay.breaker_apply(body, s, at)
            assert got[0] == state and (state != replay.OPEN or got[1] == failed)


def test_burst_is_cut_into_bounded_slices(spark):
    rng = np.random.default_rng(8)
    n = 2000
    us = np.where(rng.random(n) < 0.9, 50_000_000 + rng.integers(0, 40, n), rng.integers(0, 100_000_000, n)) + 1_700_000_000_000_000
    client = np.where(rng.random(n) < 0.7, "busy", None)
    pdf = pd.DataFrame({"id": range(n), "client": client, "scope": "predict", "ts": pd.to_datetime(us, unit="us"), "ok": rng.random(n) < 0.5})
    log = spark.createDataFrame(pdf)
    rows = log.select("client", "scope", F.col("id").alias("tie"), F.unix_micros("ts").alias("us"))
    cut = replay.sliced(rows, ["client", "scope"], 100, n)
    sizes = cut.groupBy("slice").agg(F.count("*").alias("n"), F.countDistinct(F.coalesce("client", F.lit("-"))).alias("k")).collect()
    assert max(r.n for r in sizes) <= 100 and {r.k for r in sizes} == {1} and sum(r.n for r in sizes) == n
    for run in (lambda **kw: replay.token_bucket(log, "client", "scope", "ts", "id", **kw), lambda **kw: replay.circuit_breaker(log, "client", "ts", "id", "ok", **kw)):
        pd.testing.assert_frame_equal(run().orderBy("tie").toPandas(), run(key_rows=100, fan=2).orderBy("tie").toPandas())


def test_newest_rows_by_threshold(spark):
    from lakegauge.operators import monitor

    rng = np.random.default_rng(9)
    ts = pd.to_datetime(rng.integers(0, 60, 900) * 1_000_000 + 1_700_000_000_000_000, unit="us")
    log = spark.createDataFrame(pd.DataFrame({"request_id": [f"r{i:04d}" for i in range(900)], "timestamp": ts}))
    plain = {r.request_id for r in monitor.newest(log, 100).collect()}
    cut = monitor.newest(log, 100, small_rows=10).collect()
    assert len(cut) == 100 and {r.request_id for r in cut} == plain


def test_refused_requests_cost_next_to_nothing():
    """Transfers and replays against a plain loop; a burst of refused requests is passed over."""
    rng = np.random.default_rng(4)

    def plain(times, tokens, capacity, rate):
        allowed, last = [], times[0]
        for now in times:
            tokens, last = min(capacity, tokens + (now - last) * rate), now
            allowed.append(tokens >= replay.UNIT)
            tokens -= replay.UNIT * allowed[-1]
        return allowed, tokens

    for capacity, rate, gap in ((500_000_000, 17, 2_000_000), (500_000_000, 17, 9_000_000), (250_000_001, 100, 700_000), (50_000_000, 17, 5_000_000), (500_000_000, 0, 100)):
        times = np.cumsum(rng.integers(0, gap, 300))
        pieces = replay.bucket_transfer(times, capacity, rate)
        for x in [0, capacity, *rng.integers(0, capacity + 1, 40).tolist(), *[p[0] for p in pieces]]:
            allowed, tokens = replay.bucket_replay(times, x, capacity, rate)
            assert (allowed.tolist(), tokens) == plain(times.tolist(), x, capacity, rate)
            assert replay.apply_transfer(pieces, x) == tokens
    burst = np.arange(200_000) * 400
    start = time.process_time()
    replay.bucket_transfer(burst, 500_000_000, 17)
    assert time.process_time() - start < 1.0
