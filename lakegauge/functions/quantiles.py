"""Exact quantiles of many columns without holding a column in one task.

``percentile`` keeps every distinct value of a group in one aggregation buffer. That is fine for small
tables only, so larger ones are narrowed: approximate cut points split each column into buckets, exact
bucket counts tell which buckets hold the wanted ranks, and only those buckets are cut again, until they
are small or hold one value. Only cut points and bucket counts reach the driver.
"""

from __future__ import annotations

import bisect
import math
from collections.abc import Iterable, Mapping, Sequence

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import materialize
from .frames import local_frame

SMALL_ROWS = 500_000
SMALL_TOTAL = 2_000_000
CUTS_PER_ROUND = 256
SAMPLE_PER_CUT = 1000
INF = float("inf")


def clean_double(col: Column) -> Column:
    """The column as double with NaN turned into NULL and -0.0 into 0.0."""
    as_double = col.cast("double") + F.lit(0.0)
    return F.when(~F.isnan(as_double), as_double)


def with_buckets(df: DataFrame, cuts: Mapping[str, Sequence[float]], suffix: str = "__b") -> DataFrame:
    """Add ``<col>__b``: the number of cut points at or below the value (NULL stays NULL)."""
    plain = [c for c in cuts if not cuts[c]]
    cut = [c for c in cuts if cuts[c]]
    for c in plain:
        df = df.withColumn(c + suffix, F.when(F.col(c).isNotNull(), F.lit(0)))
    if cut:
        model = Bucketizer(
            splitsArray=[[-INF, *cuts[c], INF] for c in cut],
            inputCols=cut,
            outputCols=[c + suffix for c in cut],
            handleInvalid="keep",
        )
        df = model.transform(df)
        df = df.withColumns({c + suffix: F.col(c + suffix).cast("int") for c in cut})
    return df


def melt(df: DataFrame, cols: Sequence[str], extra: Sequence[str] = (), keep: Mapping[str, list[int]] | None = None, own: Sequence[str] = ()) -> DataFrame:
    """Unpivot bucketed columns to ``(feature, x, bucket, *extra)``, leaving NULL values out.

    ``own`` names suffixes of columns that each of ``cols`` brings along under the bare suffix.

    ``keep`` names the wanted buckets per column. Missing values become 0/-1 before the unpivot and are
    filtered after it, so that no nullable key invites extra filters that would stop shuffle reuse.
    """
    ready = {}
    for c in cols:
        wanted = F.col(c).isNotNull()
        if keep is not None:
            wanted = wanted & F.col(c + "__b").isin(keep[c])
        ready[c] = F.when(wanted, F.col(c)).otherwise(F.lit(0.0))
        ready[c + "__b"] = F.coalesce(F.when(wanted, F.col(c + "__b")), F.lit(-1))
    brought = {c: [f"{c}{o}" for o in own] for c in cols}
    cells = ", ".join("(" + ", ".join(f"`{name}`" for name in (c, c + "__b", *brought[c])) + f") AS `{c}`" for c in cols)
    wide = df.select(*extra, *[e.alias(name) for name, e in ready.items()], *[name for names in brought.values() for name in names])
    values = ", ".join(["x", "bucket", *[f"`{o}`" for o in own]])
    head = "".join(f"`{e}`, " for e in extra)
    return df.sparkSession.sql(
        f"SELECT {head}feature, {values} FROM {{wide}} UNPIVOT INCLUDE NULLS (({values}) FOR feature IN ({cells})) WHERE bucket >= 0",
        wide=wide,
    )


def tidy_cuts(values: Iterable[float], isolate: bool = True) -> list[float]:
    """Sorted distinct finite cuts; with ``isolate`` a value that repeats a lot gets a bucket of its own."""
    finite = {float(v) + 0.0 for v in values if v is not None and math.isfinite(v)}
    if isolate:
        finite |= {float(np.nextafter(v, INF)) for v in finite}
    return sorted(v for v in finite if math.isfinite(v))


def counts_of(df: DataFrame, cols: Sequence[str]) -> dict[str, int]:
    row = df.agg(*[F.count(F.col(c)).alias(c) for c in cols]).first()
    return {c: row[c] for c in cols}


def approx_cuts(
    df: DataFrame, cols: Sequence[str], parts: Mapping[str, int], n: Mapping[str, int] | None = None, accuracy: int = 5000
) -> dict[str, list[float]]:
    """About ``parts[col]`` equal-count buckets per column; the cut points are bounded and go to the driver.

    With the numbers of values known, the cut points come from a sample, as in a range partitioner: they only
    balance the work, every result is exact for any cut points.
    """
    todo = [c for c in cols if parts[c] > 1]
    found: dict[str, list[float]] = {c: [] for c in cols}
    if todo:
        if n is not None:
            share = max(parts[c] * SAMPLE_PER_CUT / n[c] for c in todo)
            df = df.sample(share, seed=17) if share < 0.5 else df
        aggs = []
        for c in todo:
            probs = [i / parts[c] for i in range(1, parts[c])]
            aggs.append(F.percentile_approx(F.col(c), probs, accuracy).alias(c))
        row = df.agg(*aggs).first()
        for c in todo:
            found[c] = tidy_cuts(row[c] or [])
    return found


def _ranks(n: int, probs: Sequence[float]) -> set[int]:
    """0-based order statistics needed for linear interpolation at ``probs``."""
    need = set()
    for p in probs:
        at = p * (n - 1)
        need.add(math.floor(at))
        need.add(math.ceil(at))
    return need


def _interpolate(n: int, probs: Sequence[float], at_rank: Mapping[int, float]) -> list[float]:
    out = []
    for p in probs:
        at = p * (n - 1)
        low, high = at_rank[math.floor(at)], at_rank[math.ceil(at)]
        part = at - math.floor(at)
        if low == high:
            out.append(low)
        elif math.isinf(low) or math.isinf(high):
            out.append((1 - part) * low + part * high)
        else:
            out.append(low + (high - low) * part)
    return out


def exact_quantiles(
    df: DataFrame,
    probs: Mapping[str, Sequence[float]],
    small_rows: int = SMALL_ROWS,
    n: Mapping[str, int] | None = None,
) -> dict[str, list[float] | None]:
    """Linearly interpolated quantiles per column, ``None`` for a column without values.

    ``n`` gives the known numbers of values per column and saves a pass.
    """
    cols = list(probs)
    if not cols:
        return {}
    df = df.select(*[clean_double(F.col(c)).alias(c) for c in cols])
    n = n or counts_of(df, cols)
    out: dict[str, list[float] | None] = {c: None for c in cols}
    large = [c for c in cols if n[c] > small_rows]
    batch: list[str] = []
    for c in [c for c in cols if 0 < n[c] <= small_rows] + [None]:
        if batch and (c is None or sum(n[b] for b in batch) + n[c] > SMALL_TOTAL):
            row = df.agg(*[F.percentile(F.col(b), [float(p) for p in probs[b]]).alias(b) for b in batch]).first()
            out.update({b: list(row[b]) for b in batch})
            batch = []
        batch.append(c)
    if large:
        found = order_statistics(df.select(*large), {c: _ranks(n[c], probs[c]) for c in large}, n, small_rows)
        out.update({c: _interpolate(n[c], probs[c], found[c]) for c in large})
    return out


def order_statistics(
    df: DataFrame, ranks: Mapping[str, set[int]], n: Mapping[str, int], small_rows: int = SMALL_ROWS
) -> dict[str, dict[int, float]]:
    """The exact values at 0-based sorted positions. Infinite values, where there are any, are counted as the ranks at both ends,
    the others narrowed."""
    cols = list(ranks)
    try:
        return _finite_order_statistics(df, ranks, n, small_rows)
    except _Infinite:
        pass
    ends = df.agg(*[F.count(F.when(F.col(c) == sign * INF, 1)).alias(f"{sign}|{c}") for c in cols for sign in (-1, 1)]).first()
    found: dict[str, dict[int, float]] = {}
    inner: dict[str, set[int]] = {}
    size: dict[str, int] = {}
    for c in cols:
        below, upto = ends[f"-1|{c}"], n[c] - ends[f"1|{c}"]
        found[c] = {k: -INF if k < below else INF for k in ranks[c] if not below <= k < upto}
        if rest := {k - below for k in ranks[c] if below <= k < upto}:
            inner[c], size[c] = rest, upto - below
    if inner:
        finite = df.select(*[F.when(F.abs(F.col(c)) < INF, F.col(c)).alias(c) for c in inner])
        for c, values in _finite_order_statistics(finite, inner, size, small_rows).items():
            found[c].update({k + ends[f"-1|{c}"]: v for k, v in values.items()})
    return found


class _Infinite(Exception):
    """A column holds infinite values."""


def _finite_order_statistics(
    df: DataFrame, ranks: Mapping[str, set[int]], n: Mapping[str, int], small_rows: int
) -> dict[str, dict[int, float]]:
    """The values at sorted positions of columns without infinite values, by narrowing the buckets that hold them."""
    cols = list(ranks)
    cuts = approx_cuts(df, cols, {c: CUTS_PER_ROUND for c in cols}, n)
    found: dict[str, dict[int, float]] = {c: {} for c in cols}
    pending = {c: sorted(ranks[c]) for c in cols}
    while True:
        bucketed = with_buckets(df, cuts)
        stats = melt(bucketed, cols).groupBy("feature", "bucket").agg(
            F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")
        )
        per_col: dict[str, list] = {c: [] for c in cols}
        for r in stats.collect():
            if math.isinf(r.lo) or math.isinf(r.hi):
                raise _Infinite
            per_col[r.feature].append((r.bucket, r.n, r.lo, r.hi))
        targets: dict[str, dict[int, tuple[int, int]]] = {}
        for c in cols:
            buckets = sorted(per_col[c])
            starts, total = [], 0
            for _, size, _, _ in buckets:
                starts.append(total)
                total += size
            left = []
            for k in pending[c]:
                i = bisect.bisect_right(starts, k) - 1
                bucket, size, lo, hi = buckets[i]
                if lo == hi:
                    found[c][k] = lo
                else:
                    left.append(k)
                    targets.setdefault(c, {})[bucket] = (starts[i], size)
            pending[c] = left
        cols = [c for c in cols if pending[c]]
        if not cols:
            return found
        # ``small_rows`` bounds each bucket: a window over it runs in one task.
        if all(size <= small_rows for c in cols for _, size in targets[c].values()):
            break
        keep = {c: list(targets[c]) for c in cols}
        inner = (
            melt(bucketed, cols, keep=keep)
            .groupBy("feature", "bucket")
            .agg(F.percentile_approx("x", [i / CUTS_PER_ROUND for i in range(1, CUTS_PER_ROUND)], 5000).alias("cuts"))
        )
        fresh: dict[str, set[float]] = {c: set(cuts[c]) for c in cols}
        for r in inner.collect():
            fresh[r.feature] |= set(tidy_cuts(r.cuts))
        if all(len(fresh[c]) == len(set(cuts[c])) for c in cols):
            raise RuntimeError(f"no further cut between the values of {cols}")
        cuts = {c: sorted(fresh[c]) for c in cols}
    spark = df.sparkSession
    wanted = []
    for c in cols:
        for bucket, (start, size) in targets[c].items():
            for k in pending[c]:
                if start <= k < start + size:
                    wanted.append((c, bucket, k - start, k))
    want = local_frame(spark, wanted, "feature string, bucket int, inner_rank long, rank long")
    values = melt(bucketed, cols, keep={c: list(targets[c]) for c in cols}).groupBy("feature", "bucket", "x").count()
    upto = F.sum("count").over(_by_bucket())
    values = values.select("feature", "bucket", "x", upto.alias("upto"), (upto - F.col("count")).alias("before"))
    hits = values.join(F.broadcast(want), ["feature", "bucket"]).where("inner_rank >= before AND inner_rank < upto")
    for r in hits.select("feature", "rank", "x").collect():
        found[r.feature][r.rank] = r.x
    return found


def _by_bucket():
    from pyspark.sql import Window

    return Window.partitionBy("feature", "bucket").orderBy("x").rowsBetween(Window.unboundedPreceding, Window.currentRow)


# ---- many groups at once ----------------------------------------------------------------------------------

#: Cut points of a group in a round, and the accuracy of the sketch they come from.
GROUP_CUTS, GROUP_ACCURACY = 64, 1000


def same(left: str, right: str, *names: str) -> Column:
    """Null-safe equality of columns of two aliased tables."""
    on = F.lit(True)
    for c in names:
        on = on & F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}"))
    return on


def grouped_quantiles(df: DataFrame, by: str, value: str, probs: Sequence[float], small_rows: int = SMALL_ROWS) -> DataFrame:
    """``(by, q)``: exact quantiles (linear) of ``value`` for every group, nulls in ``by`` included, groups of any size and number.

    Groups up to ``small_rows`` take one aggregate. The others are narrowed together, the group being part of the key: cut points
    from a sketch for each open bucket, exact counts between and at them, and only the buckets that hold a wanted rank go on. The
    number of jobs depends on the largest group alone, and no group reaches the driver.
    """
    rows = df.select(F.col(by).alias("g"), clean_double(F.col(value)).alias("x")).where("x IS NOT NULL")
    sizes = materialize(rows.groupBy("g").agg(F.count("*").alias("n")), "group-sizes")
    large = sizes.where(F.col("n") > small_rows)
    out = rows.alias("r").join(large.alias("l"), same("r", "l", "g"), "left_anti").groupBy("g").agg(F.percentile("x", list(probs)).alias("q"))
    if not large.isEmpty():
        out = out.unionByName(_narrowed(rows, large, probs, small_rows))
    return out.withColumnRenamed("g", by)


def _narrowed(rows: DataFrame, large: DataFrame, probs: Sequence[float], small_rows: int) -> DataFrame:
    place = [F.col("n").cast("double").__sub__(1) * p for p in probs]
    ranks = F.array_distinct(F.flatten(F.array(*[F.array(F.floor(at), F.ceil(at)) for at in place])))
    pending = large.select("g", F.explode(ranks).alias("rank")).select("g", F.lit(0).cast("long").alias("b"), "rank", F.col("rank").alias("r"))
    live = rows.alias("r").join(large.alias("l"), same("r", "l", "g"), "left_semi").select("g", F.lit(0).cast("long").alias("b"), "x")
    while True:
        buckets = materialize(live.groupBy("g", "b").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")), "group-buckets")
        wide = buckets.where((F.col("n") > small_rows) & (F.col("lo") < F.col("hi")))
        if wide.isEmpty():
            break
        cuts = live.groupBy("g", "b").agg(F.array_distinct(F.percentile_approx("x", [i / GROUP_CUTS for i in range(1, GROUP_CUTS)], GROUP_ACCURACY)).alias("cuts"))
        placed = live.alias("v").join(cuts.alias("c"), same("v", "c", "g", "b")).select("v.g", "v.b", "v.x", "c.cuts")
        # twice the cuts below, and one more at a cut: values equal to a cut have a bucket of their own
        part = F.size(F.filter("cuts", lambda c: c < F.col("x"))) + F.size(F.filter("cuts", lambda c: c <= F.col("x")))
        placed = materialize(placed.select("g", "b", part.alias("part"), "x"), "group-values")
        counts = placed.groupBy("g", "b", "part").agg(F.count("*").alias("m"))
        counts = counts.withColumn("start", F.sum("m").over(Window.partitionBy("g", "b").orderBy("part")) - F.col("m"))
        within = same("p", "c", "g", "b") & (F.col("p.r") >= F.col("c.start")) & (F.col("p.r") < F.col("c.start") + F.col("c.m"))
        found = pending.alias("p").join(counts.alias("c"), within).select("p.g", "p.b", "c.part", "p.rank", (F.col("p.r") - F.col("c.start")).alias("r"))
        found = materialize(found, "group-ranks")
        wanted = found.select("g", "b", "part").distinct()
        name = F.xxhash64("b", "part").alias("b")
        live = materialize(placed.alias("v").join(wanted.alias("w"), same("v", "w", "g", "b", "part"), "left_semi").select("g", name, "x"), "group-live")
        pending = found.select("g", name, "rank", "r")
    known = pending.alias("p").join(buckets.alias("k"), same("p", "k", "g", "b")).select("p.g", "p.b", "p.rank", "p.r", "k.lo", "k.hi")
    flat = known.where("lo = hi").select("g", "rank", F.col("lo").alias("x"))
    narrow = live.alias("v").join(buckets.where("lo < hi").alias("k"), same("v", "k", "g", "b"), "left_semi")
    narrow = narrow.withColumn("i", F.row_number().over(Window.partitionBy("g", "b").orderBy("x")) - 1)
    open_ranks = known.where("lo < hi")
    sorted_ = open_ranks.alias("p").join(narrow.alias("v"), same("p", "v", "g", "b") & (F.col("p.r") == F.col("v.i"))).select("p.g", "p.rank", "v.x")
    values = flat.unionByName(sorted_).groupBy("g").agg(F.map_from_entries(F.collect_list(F.struct("rank", "x"))).alias("at"))
    joined = values.alias("a").join(large.alias("l"), same("a", "l", "g")).select("l.g", "l.n", "a.at")
    q = []
    for p in probs:
        at = (F.col("n") - 1).cast("double") * p
        low, high = F.col("at")[F.floor(at)], F.col("at")[F.ceil(at)]
        q.append(F.when(low == high, low).otherwise(low + (high - low) * (at - F.floor(at))))
    return joined.select("g", F.array(*q).alias("q"))
