"""Replay of sequential rules over request logs: token buckets and circuit breakers.

The state after a request depends on all earlier requests of its key. A key with few rows is replayed as one
group. The rows of busy keys are sorted over the cluster and cut into slices of a bounded number of rows, wherever
that falls: in a burst, or among requests of one instant. Each slice is summarised on its own as a function from the
state before it to the state after it. Such functions compose, so a prefix scan over a tree of slices gives the state
at the start of every slice: composed functions go up the tree and start states come down, a bounded number of
children in a group. Then all slices are replayed side by side.
"""

from __future__ import annotations

import json
from bisect import bisect_left
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from ..session import materialize

#: Rows of a key that are replayed as one group, and rows of a slice of a busier key.
KEY_ROWS = 500_000
#: Slices, or nodes of the tree over them, that meet in one group.
FAN = 64

# Scope -> (capacity, tokens per second).
RATE_LIMITS = {"predict": (50.0, 16.67), "admin": (10.0, 1.0), "read": (20.0, 5.0), "development": (100.0, 100.0), "anonymous": (5.0, 0.17)}

# Tokens are counted in units of 1e-8 and time in microseconds, so a rate with two decimals is a whole number
# of units per microsecond and every replay gives the same result in whatever pieces it runs.
UNIT = 100_000_000


def bucket_units(scope: str) -> tuple[int, int]:
    capacity, rate = RATE_LIMITS.get(scope, RATE_LIMITS["anonymous"])
    return round(capacity * UNIT), round(rate * 100)


# ---- token bucket -----------------------------------------------------------------------------------------


def bucket_replay(times: np.ndarray, tokens: int, capacity: int, rate: int) -> tuple[np.ndarray, int]:
    """Which requests pass, and the tokens after the last; ``tokens`` holds at the first request, refilled.

    Requests that find less than a token change nothing: the next one that can pass is found by binary search.
    """
    allowed, stamps = np.zeros(len(times), dtype=bool), times.tolist()
    last, i, passed = stamps[0] if stamps else 0, 0, []
    while i < len(stamps):
        now = stamps[i]
        tokens = min(capacity, tokens + (now - last) * rate)
        last = now
        if tokens >= UNIT:
            tokens -= UNIT
            passed.append(i)
            i += 1
        else:
            i = next_full(stamps, i, now, tokens, rate)
    allowed[passed] = True
    return allowed, min(capacity, tokens + (stamps[-1] - last) * rate) if stamps else tokens


def next_full(stamps: list[int], i: int, now: int, tokens: int, rate: int) -> int:
    """The first request behind ``i`` at which ``tokens`` left at ``now`` make a whole one."""
    return bisect_left(stamps, now + -((tokens - UNIT) // rate), i + 1) if rate > 0 else len(stamps)


def bucket_transfer(times: np.ndarray, capacity: int, rate: int) -> list[list[int]]:
    """Tokens after a slice as a function of the tokens x at its first request.

    Pieces ``[low, kind, value]`` from x = low on: kind 0 is x + value, kind 1 is the constant value. Refills
    move a piece, the capacity turns its upper part constant and a request splits it at one token.
    Once less than a token is left of every x, requests between which less than a token comes in leave the fraction of
    a token: such a run of them is one step.
    """
    pieces, stamps = [[0, 0, 0]], times.tolist()
    last, i = stamps[0], 0
    wide = [*np.flatnonzero(np.diff(times) * rate > UNIT).tolist(), len(stamps) - 1]

    def after(refill: int) -> list[list[int]]:
        """The pieces after a refill and a request."""
        out: list[list[int]] = []

        def add(low: int, kind: int, value: int) -> None:
            if not out or out[-1][1] != kind or out[-1][2] != value:
                out.append([low, kind, value])

        full = capacity - UNIT if capacity >= UNIT else capacity
        for p, (low, kind, value) in enumerate(pieces):
            high = pieces[p + 1][0] if p + 1 < len(pieces) else capacity + 1
            value += refill
            if kind:
                value = min(capacity, value)
                add(low, 1, value - UNIT if value >= UNIT else value)
                continue
            top = min(max(capacity - value, low), high)
            whole = min(max(UNIT - value, low), top)
            if low < whole:
                add(low, 0, value)
            if whole < top:
                add(whole, 0, value - UNIT)
            if top < high:
                add(top, 1, full)
        return out

    while i < len(stamps):
        pieces = after((stamps[i] - last) * rate)
        last = stamps[i]
        highs = [p[0] - 1 for p in pieces[1:]] + [capacity]
        most = max(value if kind else high + value for (_, kind, value), high in zip(pieces, highs))
        end = wide[bisect_left(wide, i)]  # the last request of the run
        if most < UNIT and capacity >= 2 * UNIT and end > i:
            pieces = after((stamps[end] - last) * rate % UNIT)
            last, i = stamps[end], end
        i += 1
    return pieces


def apply_transfer(pieces: list[list[int]], x: int) -> int:
    i = np.searchsorted([p[0] for p in pieces], x, side="right") - 1
    _, kind, value = pieces[i]
    return value if kind else x + value


def compose_transfers(first: list[list[int]], refill: int, second: list[list[int]], capacity: int) -> list[list[int]]:
    """``second`` after ``first`` with ``refill`` units in between, as pieces again."""
    lows = [p[0] for p in second]
    out: list[list[int]] = []

    def add(low: int, kind: int, value: int) -> None:
        if not out or out[-1][1:] != [kind, value]:
            out.append([low, kind, value])

    for i, (low, kind, value) in enumerate(first):
        high = first[i + 1][0] if i + 1 < len(first) else capacity + 1
        value += refill
        if kind or low + value >= capacity:
            add(low, 1, apply_transfer(second, min(capacity, value if kind else capacity)))
            continue
        # x from low on meets the second function at x + value, until the capacity is reached
        full = min(high, capacity - value)
        j = int(np.searchsorted(lows, low + value, side="right")) - 1
        while j < len(second) and lows[j] - value < full:
            _, kind2, value2 = second[j]
            add(max(low, lows[j] - value), kind2, value2 if kind2 else value + value2)
            j += 1
        if full < high:
            add(full, 1, apply_transfer(second, capacity))
    return out


# ---- circuit breaker --------------------------------------------------------------------------------------

# Failures that open, microseconds until a probe, successes that close.
FAILURES, RECOVERY, SUCCESSES = 5, 30_000_000, 2
HALF = FAILURES  # states 0..4: closed with that many failures; 5, 6: half-open with 0, 1 successes; 7: open
OPEN = FAILURES + SUCCESSES


def breaker_step(state: int, failed_at: int, now: int, ok: bool) -> tuple[int, int, bool]:
    """State after a request, time of the last failure, and whether the request was let through."""
    if state == OPEN:
        if now - failed_at < RECOVERY:
            return state, failed_at, False
        state = HALF
    if ok:
        if state >= HALF:
            return (0 if state + 1 == OPEN else state + 1), failed_at, True
        return 0, failed_at, True
    if state >= HALF or state + 1 == FAILURES:
        return OPEN, now, True
    return state + 1, failed_at, True


def breaker_replay(times: np.ndarray, ok: np.ndarray, state: int, failed_at: int) -> tuple[np.ndarray, np.ndarray, int, int]:
    """State before and after each request, whether it was let through, and the final state."""
    states, passed = np.zeros(len(times) + 1, dtype=np.int32), np.zeros(len(times), dtype=bool)
    states[0] = state
    for i, (now, good) in enumerate(zip(times.tolist(), ok.tolist())):
        state, failed_at, passed[i] = breaker_step(state, failed_at, now, good)
        states[i + 1] = state
    return states, passed, state, failed_at


def breaker_transfer(times: np.ndarray, ok: np.ndarray) -> dict:
    """End state for each closed and half-open start state, and for an open one by its time of failure.

    Worked out from the last request backwards: ``end[i][s]`` is the end state when request i meets state s.
    An open state resumes as half-open at the first request after the recovery time.
    """
    n = len(times)
    resume = np.searchsorted(times, times + RECOVERY, side="left")
    end: list[list[list[int]]] = [[]] * (n + 1)
    end[n] = [[s, 0] for s in range(OPEN)]
    for i in range(n - 1, -1, -1):
        opened = end[resume[i]][HALF] if resume[i] < n else [OPEN, int(times[i])]
        if ok[i]:
            end[i] = [end[i + 1][0]] * FAILURES + [end[i + 1][s + 1] if s + 1 < OPEN else end[i + 1][0] for s in range(HALF, OPEN)]
        else:
            end[i] = [end[i + 1][s + 1] if s + 1 < FAILURES else opened for s in range(FAILURES)] + [opened] * SUCCESSES
    # an earlier failure lets the breaker resume at the first request within RECOVERY of the slice start
    steps: list[list] = []
    for i in range(n):
        if steps and steps[-1][1] == end[i][HALF]:
            steps[-1][0] = int(times[i])
        else:
            steps.append([int(times[i]), end[i][HALF]])
        if times[i] >= times[0] + RECOVERY:
            break
    return {"plain": end[0], "open": steps}


def breaker_apply(transfer: dict, state: int, failed_at: int) -> tuple[int, int]:
    if state != OPEN:
        found, at = transfer["plain"][state]
        return found, at
    for upto, (found, at) in transfer["open"]:
        if upto >= failed_at + RECOVERY:
            return found, at
    return OPEN, failed_at


def compose_breakers(first: dict, end: int, second: dict) -> dict:
    """``second`` after ``first``; ``end`` is the first slice's opening time plus the recovery time.

    A breaker that stays open through the first slice meets the second one with its old time of failure.
    """
    plain = [list(breaker_apply(second, *found)) for found in first["plain"]]
    steps = [[upto, list(breaker_apply(second, *found))] for upto, found in first["open"]]
    if not steps or steps[-1][0] < end:
        steps += [[upto, list(found)] for upto, found in second["open"]]
    merged: list[list] = []
    for upto, found in steps:
        if merged and merged[-1][1] == found:
            merged[-1][0] = upto
        elif not merged or merged[-1][0] < end:
            merged.append([upto, found])
    return {"plain": plain, "open": merged}


# ---- running them on Spark --------------------------------------------------------------------------------


class Bucket:
    """Token bucket for keys (client, scope); a start state is the tokens at a slice's first request, refilled."""

    out = "allowed boolean"

    @staticmethod
    def replay(key: tuple, pdf: pd.DataFrame, start: str | None) -> dict[str, np.ndarray]:
        capacity, rate = bucket_units(key[1])
        return {"allowed": bucket_replay(pdf["us"].to_numpy(), capacity if start is None else int(start), capacity, rate)[0]}

    @staticmethod
    def transfer(key: tuple, pdf: pd.DataFrame) -> list:
        return bucket_transfer(pdf["us"].to_numpy(), *bucket_units(key[1]))

    @staticmethod
    def compose(key: tuple, a: list, b: list, times: tuple[int, int, int]) -> list:
        _, last, nxt = times
        capacity, rate = bucket_units(key[1])
        return compose_transfers(a, (nxt - last) * rate, b, capacity)

    @staticmethod
    def begin(key: tuple) -> str:
        return str(bucket_units(key[1])[0])

    @staticmethod
    def advance(key: tuple, start: str, body: list, gap: int) -> str:
        capacity, rate = bucket_units(key[1])
        return str(min(capacity, apply_transfer(body, int(start)) + gap * rate))


class Breaker:
    """Circuit breaker for one key; a start state is "state,time of the last failure"."""

    out = "passed boolean, before int, state int"

    @staticmethod
    def replay(key: tuple, pdf: pd.DataFrame, start: str | None) -> dict[str, np.ndarray]:
        state, failed_at = map(int, (start or "0,0").split(","))
        states, passed, _, _ = breaker_replay(pdf["us"].to_numpy(), pdf["ok"].to_numpy(), state, failed_at)
        return {"passed": passed, "before": states[:-1], "state": states[1:]}

    @staticmethod
    def transfer(key: tuple, pdf: pd.DataFrame) -> dict:
        return breaker_transfer(pdf["us"].to_numpy(), pdf["ok"].to_numpy())

    @staticmethod
    def compose(key: tuple, a: dict, b: dict, times: tuple[int, int, int]) -> dict:
        return compose_breakers(a, times[0] + RECOVERY, b)

    @staticmethod
    def begin(key: tuple) -> str:
        return "0,0"

    @staticmethod
    def advance(key: tuple, start: str, body: dict, gap: int) -> str:
        state, failed_at = breaker_apply(body, *map(int, start.split(",")))
        return f"{state},{failed_at}"


def ordered(pdf: pd.DataFrame) -> pd.DataFrame:
    return pdf.sort_values(["us", "tie"], kind="stable")


def numbered_slices(keys: list[str], most: int):
    """Task function: rows sorted by key, time and tie, with the number of their slice: runs of a key of at most ``most`` rows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        last, held, seq = None, 0, -1
        for pdf in frames:
            if pdf.empty:
                continue
            names = [pdf[k].to_numpy() for k in keys]
            change = np.zeros(len(pdf), dtype=bool)
            change[0] = seq < 0 or [v[0] for v in names] != last
            for v in names:
                change[1:] |= v[1:] != v[:-1]
            at = np.arange(len(pdf))
            place = at - np.maximum.accumulate(np.where(change, at, -held if not change[0] else 0))
            number = seq + np.cumsum(place % most == 0)
            yield pdf.assign(slice=(part << 32) + number)
            last, held, seq = [v[-1] for v in names], int(place[-1]) + 1, int(number[-1])

    return run


def sliced(log: DataFrame, keys: Sequence[str], key_rows: int, rows: int) -> DataFrame:
    """The ``rows`` of ``log`` with the number of their slice; numbers rise with (key, us, tie) and a slice holds ``key_rows`` at most.

    The rows are dealt out by ranges of (key, us, tie), so that a busy key lies in many tasks, and written once.
    """
    parts = max(1, -(-2 * rows // key_rows))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in log.schema.fields)
    dealt = log.repartitionByRange(parts, *keys, "us", "tie").sortWithinPartitions(*keys, "us", "tie")
    return materialize(dealt.mapInPandas(numbered_slices(list(keys), key_rows), f"{fields}, slice long"), "slices")


def starts(functions: DataFrame, keys: list[str], kinds: str, rule, fan: int) -> DataFrame:
    """(keys, slice, start): the state at the start of every slice, by a prefix scan over a tree of their functions.

    A node of the first level holds the slices that one task numbered, ``fan`` at a time; each level above holds ``fan`` nodes of the one below.
    """

    def composed(key, pdf):
        pdf = pdf.sort_values("node")
        body, first, last = json.loads(pdf["body"].iloc[0]), int(pdf["first"].iloc[0]), int(pdf["last"].iloc[0])
        for row in pdf.iloc[1:].itertuples(index=False):
            body = rule.compose(key[:-1], body, json.loads(row.body), (first, last, int(row.first)))
            last = int(row.last)
        return pd.DataFrame([(*key, first, last, json.dumps(body))], columns=[*keys, "node", "first", "last", "body"])

    def handed_down(key, pdf):
        pdf = pdf.sort_values("node")
        start, found = pdf["start"].iloc[0], []
        below = list(pdf.itertuples(index=False))
        for row, nxt in zip(below, [*below[1:], None]):
            found.append((*key[:-1], row.node, start))
            if nxt is not None:
                start = rule.advance(key[:-1], start, json.loads(row.body), int(nxt.first) - int(row.last))
        return pd.DataFrame(found, columns=[*keys, "node", "start"])

    # numbers of one task are turned into places of fixed width, so that dividing by ``fan`` leads up the tree
    width = functions.agg(F.max(F.col("slice").bitwiseAND(0xFFFFFFFF))).first()[0]
    place = F.shiftright("slice", 32) * ((width or 0) + 1) + F.col("slice").bitwiseAND(0xFFFFFFFF)
    level = functions.withColumn("node", place).drop("slice")
    levels = [level]
    while level.groupBy(*keys).count().where("count > 1").limit(1).count():
        parents = level.withColumn("above", F.floor(F.col("node") / fan)).groupBy(*keys, "above").applyInPandas(composed, f"{kinds}, node long, first long, last long, body string")
        level = materialize(parents, "slice-functions")
        levels.append(level)

    def opening(key, pdf):
        return pdf[[*keys, "node"]].assign(start=rule.begin(key))

    down = level.select(*keys, "node").groupBy(*keys).applyInPandas(opening, f"{kinds}, node long, start string")
    for below in reversed(levels[:-1]):
        children = below.withColumn("above", F.floor(F.col("node") / fan))
        given = down.select(*keys, F.col("node").alias("above"), "start")
        down = materialize(joined(children, given, [*keys, "above"]).groupBy(*keys, "above").applyInPandas(handed_down, f"{kinds}, node long, start string"), "slice-starts")
    return down.withColumn("slice", F.shiftleft(F.floor(F.col("node") / ((width or 0) + 1)), 32) + F.col("node") % ((width or 0) + 1)).drop("node")


def joined(rows: DataFrame, other: DataFrame, names: Sequence[str], how: str = "inner") -> DataFrame:
    """A join on equal ``names``, in which null equals null."""
    other = other.select(*[F.col(c).alias(f"_{c}") if c in names else F.col(c) for c in other.columns])
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in names]
    return rows.join(other, on, how).drop(*[f"_{c}" for c in names])


def _replayed(log: DataFrame, keys: Sequence[str], rule, key_rows: int, fan: int) -> DataFrame:
    keys = list(keys)
    kinds = ", ".join(f"`{k}` string" for k in keys)
    schema = f"{kinds}, tie long, us long, {rule.out}"

    def whole(key, pdf):
        pdf = ordered(pdf)
        return pdf[[*keys, "tie", "us"]].assign(**rule.replay(key, pdf, None))

    def transfer(key, pdf):
        pdf = ordered(pdf)
        body = json.dumps(rule.transfer(key[:-1], pdf))
        return pd.DataFrame([(*key, pdf["us"].iloc[0], pdf["us"].iloc[-1], body)], columns=[*keys, "slice", "first", "last", "body"])

    def resume(key, pdf):
        pdf = ordered(pdf)
        return pdf[[*keys, "tie", "us"]].assign(**rule.replay(key[:-1], pdf, pdf["start"].iloc[0]))

    hot = log.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > key_rows)
    rows = hot.agg(F.sum("n")).first()[0]
    if not rows:
        return log.groupBy(*keys).applyInPandas(whole, schema)
    hot = materialize(hot.select(*keys), "busy-keys")  # at most all rows / key_rows
    cold = joined(log, hot, keys, "left_anti").groupBy(*keys).applyInPandas(whole, schema)
    busy = sliced(joined(log, hot, keys), keys, key_rows, rows)
    functions = materialize(busy.groupBy(*keys, "slice").applyInPandas(transfer, f"{kinds}, slice long, first long, last long, body string"), "slice-functions")
    begun = joined(busy, starts(functions, keys, kinds, rule, fan), [*keys, "slice"])
    return cold.unionAll(begun.groupBy(*keys, "slice").applyInPandas(resume, schema))


def token_bucket(log: DataFrame, client: str, scope: str, stamp: str, tie: str, key_rows: int = KEY_ROWS, fan: int = FAN) -> DataFrame:
    """``(client, scope, tie, us, allowed)`` for every request, in the order of time and ``tie``."""
    keys = [client, scope]
    rows = log.select(*[F.col(k).cast("string").alias(k) for k in keys], F.col(tie).cast("long").alias("tie"), F.unix_micros(F.col(stamp)).alias("us"))
    return _replayed(rows, keys, Bucket, key_rows, fan)


def circuit_breaker(log: DataFrame, service: str, stamp: str, tie: str, ok: str, key_rows: int = KEY_ROWS, fan: int = FAN) -> DataFrame:
    """``(service, tie, us, passed, before, state)`` for every call; state 0-4 closed, 5-6 half-open, 7 open."""
    rows = log.select(F.col(service).cast("string").alias(service), F.col(tie).cast("long").alias("tie"), F.unix_micros(F.col(stamp)).alias("us"), F.col(ok).alias("ok"))
    return _replayed(rows, [service], Breaker, key_rows, fan)


def outages(calls: DataFrame, service: str) -> DataFrame:
    """Intervals from opening to closing per service.

    Only the calls that open or close the breaker are sorted; a breaker opens at most once per recovery time.
    """
    was_closed, is_closed = F.col("before") < HALF, F.col("state") < HALF
    turns = calls.where(was_closed != is_closed).select(service, "us", "tie", is_closed.alias("closes"))
    w = Window.partitionBy(service).orderBy("us", "tie")
    return turns.withColumn("closed_us", F.lead("us").over(w)).where("NOT closes").select(service, F.col("us").alias("opened_us"), "closed_us")
