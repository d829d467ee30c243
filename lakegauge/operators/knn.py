"""Exact nearest-neighbour imputation with missing-aware Euclidean distances.

Equal donors are merged into one row with a count, and so are equal incomplete rows. The donors lie in blocks
of a quantile grid; the bounding boxes of the blocks are a small table. Each incomplete row first looks into
the blocks nearest to it, which gives a radius, and then into every further block that reaches within the
radius. Large blocks are split, so a task sees a bounded number of donors. Every donor that can matter is
compared: nothing is sampled or capped. A row with one known value has its nearest donors side by side in the order of
that value: there blocks and donors are found by binary search instead of one by one.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.frames import local_frame
from ..functions.quantiles import approx_cuts, clean_double, with_buckets
from ..session import materialize

BLOCK_ROWS = 3_000
TASK_ROWS = 50_000
UNIT_ROWS = 100_000
GRID_COLUMNS = 3
MAX_BLOCKS = 8192
UNITS_AT_ONCE = 500
PAIRS_AT_ONCE = 2_000_000


def knn_impute(df: DataFrame, donors: DataFrame, cols: Sequence[str], k: int = 5, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Fill NULLs of ``cols`` from the ``k`` nearest donors, weighted by inverse distance.

    Donors at distance 0 alone decide where there are any; a row that shares no value with a donor gets the
    donor mean. Equal distances are taken in the order of the donor value.
    """
    cols = list(cols)
    df = df.withColumns({c: clean_double(F.col(c)) for c in cols})
    pool = donors.select(*[clean_double(F.col(c)).alias(c) for c in cols])
    means = pool.agg(*[F.avg(c).alias(c) for c in cols]).first().asDict()
    pool = pool.groupBy(*cols).agg(F.count("*").alias("copies"))
    gaps = df.select(*cols).where(_any(F.col(c).isNull() for c in cols) & _any(F.col(c).isNotNull() for c in cols)).distinct()
    found = _neighbours(gaps, pool, cols, k, block_rows) if len(cols) > 1 else None
    if found is None:
        return df.withColumns({c: F.coalesce(F.col(c), F.lit(means[c])) for c in cols})
    keyed = found.select(*[F.col(c).alias(f"__k_{c}") for c in cols], "fills")
    same = None
    for c in cols:
        cond = df[c].eqNullSafe(keyed[f"__k_{c}"])
        same = cond if same is None else same & cond
    joined = df.join(keyed, same, "left")
    return joined.withColumns({c: F.coalesce(F.col(c), F.col("fills")[c], F.lit(means[c])) for c in cols}).select(*df.columns)


def _any(conditions) -> Column:
    out = F.lit(False)
    for c in conditions:
        out = out | c
    return out


def _neighbours(gaps: DataFrame, pool: DataFrame, cols: list[str], k: int, block_rows: int) -> DataFrame | None:
    """``(cols..., fills)``: the filled values per distinct incomplete row."""
    spark = pool.sparkSession
    pool = materialize(pool, "donor-pool")
    total = pool.count()
    if total == 0:
        return None
    # one unit per incomplete row and missing column
    wanted = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(i)) for i, c in enumerate(cols)]))
    name = F.concat_ws("|", F.col("j"), *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in cols])
    units = materialize(gaps.select(*cols, F.explode(wanted).alias("j")).withColumn("unit", F.md5(name)), "units")

    # the grid takes the columns that incomplete rows have most often
    seen = units.agg(*[F.count(c).alias(c) for c in cols]).first().asDict()
    grid = sorted((c for c in cols if seen[c]), key=lambda c: -seen[c])[:GRID_COLUMNS]
    if not grid:
        return None
    widest = seen[grid[0]]
    grid = [c for c in grid if seen[c] * 4 >= widest]
    blocks = min(MAX_BLOCKS, math.ceil(total / block_rows))
    parts = math.ceil(blocks ** (1 / len(grid)))
    cuts = approx_cuts(pool, grid, {c: parts for c in grid})
    placed = with_buckets(pool, cuts)
    label = F.concat_ws("_", *[F.coalesce(F.col(f"{c}__b"), F.lit(-1)).cast("string") for c in grid])
    placed = placed.select(*cols, "copies", label.alias("block"))
    aggs = [F.count("*").alias("rows")]
    for c in cols:
        aggs += [F.min(c).alias(f"lo|{c}"), F.max(c).alias(f"hi|{c}"), F.count(c).alias(f"n|{c}")]
    boxes = [r.asDict() for r in placed.groupBy("block").agg(*aggs).collect()]
    names = [b["block"] for b in boxes]
    size = np.array([b["rows"] for b in boxes])
    lo = np.array([[np.nan if b[f"lo|{c}"] is None else b[f"lo|{c}"] for c in cols] for b in boxes])
    hi = np.array([[np.nan if b[f"hi|{c}"] is None else b[f"hi|{c}"] for c in cols] for b in boxes])
    have = np.array([[b[f"n|{c}"] for c in cols] for b in boxes])
    subs = {b["block"]: math.ceil(b["rows"] / TASK_ROWS) for b in boxes}
    sub_frame = local_frame(spark, list(subs.items()), "block string, subs int")
    placed = placed.join(F.broadcast(sub_frame), "block").withColumn("sub", F.pmod(F.xxhash64(*cols), "subs").cast("int")).drop("subs")

    # where blocks lie one behind the other: (known column, wanted column) -> the line of blocks
    lines = {(c, j): line for c in range(len(cols)) for j in range(len(cols)) if c != j and (line := Line.of(lo[:, c], hi[:, c], have[:, c], have[:, j], size))}

    def visit(nearest_only: bool):
        def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in (b.iloc[i : i + UNITS_AT_ONCE] for b in batches for i in range(0, len(b), UNITS_AT_ONCE)):
                q = pdf[cols].to_numpy(dtype=float)
                j = pdf["j"].to_numpy()
                seen = ~np.isnan(q)
                if len(lone := set(zip(np.argmax(seen, axis=1).tolist(), j.tolist()))) and (seen.sum(axis=1) == 1).all() and all(pair in lines for pair in lone):
                    rows, picked = [], []
                    for pair in sorted(lone):
                        own = np.flatnonzero((np.argmax(seen, axis=1) == pair[0]) & (j == pair[1]))
                        radius = None if nearest_only else pdf["radius"].to_numpy(dtype=float)[own]
                        done = None if nearest_only else pdf["visited"].iloc[own].tolist()
                        for i, b in lines[pair].blocks(q[own, pair[0]], k, len(cols), radius, done, names):
                            rows.append(own[i])
                            picked.append(b)
                    if rows:
                        yield chosen(pdf, rows, picked)
                    continue
                bound = np.zeros((len(q), len(names)))
                for c in range(len(cols)):
                    gap = np.maximum(np.maximum(lo[None, :, c] - q[:, None, c], q[:, None, c] - hi[None, :, c]), 0.0)
                    usable = seen[:, None, c] & (have[:, c] == size)[None, :]
                    bound += np.where(usable, np.nan_to_num(gap) ** 2, 0.0)
                bound *= len(cols) / np.maximum(seen.sum(axis=1), 1)[:, None]
                bound[have[:, j].T == 0] = np.inf
                rows, picked = [], []
                if nearest_only:
                    order = np.argsort(bound, axis=1, kind="stable")
                    for i in range(len(q)):
                        need = k
                        for b in order[i]:
                            if not np.isfinite(bound[i, b]):
                                break
                            rows.append(i)
                            picked.append(b)
                            need -= have[b, j[i]]
                            if need <= 0:
                                break
                else:
                    # A hair of slack keeps blocks whose bound equals the radius up to rounding.
                    radius = pdf["radius"].to_numpy(dtype=float) * (1 + 1e-9)
                    done = pdf["visited"].tolist()
                    for i in range(len(q)):
                        skip = set(done[i])
                        for b in np.flatnonzero(bound[i] <= radius[i]):
                            if np.isfinite(bound[i, b]) and names[b] not in skip:
                                rows.append(i)
                                picked.append(b)
                if rows:
                    yield chosen(pdf, rows, picked)

        return choose

    def chosen(pdf: pd.DataFrame, rows: list[int], picked: list[int]) -> pd.DataFrame:
        out = pdf.iloc[rows][["unit", "j", *cols]].reset_index(drop=True)
        return out.assign(block=np.array([names[b] for b in picked], dtype=object))

    schema = "unit string, j int, " + ", ".join(f"`{c}` double" for c in cols) + ", block string"

    def compare(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        d = right[cols].to_numpy(dtype=float)
        copies = right["copies"].to_numpy()
        out = []
        known = left[cols].notna().to_numpy()
        lone, found = known.sum(axis=1) == 1, []
        for c, j in sorted(set(zip(np.argmax(known[lone], axis=1).tolist(), left["j"][lone].tolist()))):
            own = left[lone & known[:, c] & (left["j"] == j).to_numpy()]
            i, dist, value, n = along_line(own[cols[c]].to_numpy(dtype=float), d[:, c], d[:, j], copies, k, len(cols))
            found.append(pd.DataFrame({"unit": own["unit"].to_numpy()[i], "d": dist, "v": value, "n": n}))
        left = left[~lone]
        step = max(1, PAIRS_AT_ONCE // max(1, len(d)))
        for start in range(0, len(left), step):
            part = left.iloc[start : start + step]
            q = part[cols].to_numpy(dtype=float)
            total_sq, common = np.zeros((len(q), len(d))), np.zeros((len(q), len(d)))
            for c in range(len(cols)):
                diff = (q[:, None, c] - d[None, :, c]) ** 2
                ok = ~np.isnan(diff)
                total_sq += np.where(ok, diff, 0.0)
                common += ok
            with np.errstate(divide="ignore", invalid="ignore"):
                dist = np.where(common > 0, total_sq * len(cols) / common, np.inf)
            for i, (unit, j) in enumerate(zip(part["unit"], part["j"])):
                value = d[:, j]
                ok = np.flatnonzero(~np.isnan(value) & np.isfinite(dist[i]))
                if len(ok) > k:
                    edge = np.partition(dist[i][ok], k - 1)[k - 1]
                    ok = ok[dist[i][ok] <= edge]
                ok = ok[np.lexsort((value[ok], dist[i][ok]))][:k]
                for m in ok:
                    out.append((unit, dist[i][m], value[m], copies[m]))
        rest = pd.DataFrame(out, columns=["unit", "d", "v", "n"])
        return pd.concat([*found, rest] if out or not found else found, ignore_index=True)

    def evaluate(visits: DataFrame) -> DataFrame:
        """Candidates of each visited block; hot blocks are split on both sides."""
        salts = {r["block"]: math.ceil(r["n"] / UNIT_ROWS) for r in visits.groupBy("block").agg(F.count("*").alias("n")).collect()}
        load = local_frame(spark, [(b, n, subs[b]) for b, n in salts.items()], "block string, salts int, subs int")
        left = visits.join(F.broadcast(load), "block").select(
            "unit", "j", *cols, "block", F.explode(F.sequence(F.lit(0), F.col("subs") - 1)).alias("sub"), F.pmod(F.xxhash64("unit"), "salts").cast("int").alias("salt")
        )
        right = placed.join(F.broadcast(load.select("block", "salts")), "block").select(
            *cols, "copies", "block", "sub", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt")
        )
        keys = ["block", "sub", "salt"]
        return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(compare, "unit string, d double, v double, n long")

    first_visits = materialize(units.mapInPandas(visit(True), schema), "visits")
    first = materialize(evaluate(first_visits), "candidates")
    best = F.sort_array(F.collect_list(F.struct("d", "v", "n")))
    reach = first.groupBy("unit").agg(best.alias("c")).select("unit", _radius(F.col("c"), k).alias("radius"))
    done = first_visits.groupBy("unit").agg(F.collect_set("block").alias("visited"))
    again = units.join(done, "unit").join(reach, "unit", "left").withColumn("radius", F.coalesce("radius", F.lit(float("inf"))))
    second = evaluate(materialize(again.mapInPandas(visit(False), schema), "visits"))
    merged = first.unionAll(second).groupBy("unit").agg(best.alias("c")).select("unit", _weighted(F.col("c"), k).alias("fill"))
    return (
        units.join(merged, "unit")
        .where("fill IS NOT NULL")
        .groupBy(*cols)
        .agg(F.map_from_entries(F.collect_list(F.struct(F.element_at(F.array(*[F.lit(c) for c in cols]), F.col("j") + 1), "fill"))).alias("fills"))
    )


class Line:
    """Blocks that hold a known column throughout and do not overlap in it, in the order of its values."""

    def __init__(self, order: np.ndarray, low: np.ndarray, high: np.ndarray, donors: np.ndarray):
        self.order, self.low, self.high, self.donors = order, low, high, donors

    @staticmethod
    def of(low: np.ndarray, high: np.ndarray, known: np.ndarray, wanted: np.ndarray, size: np.ndarray) -> Line | None:
        use = np.flatnonzero((known > 0) & (wanted > 0))  # others hold no donor
        use = use[np.argsort(low[use], kind="stable")]
        if not len(use) or (known[use] < size[use]).any() or (low[use][1:] < high[use][:-1]).any():
            return None
        return Line(use, low[use], high[use], wanted[use])

    def blocks(self, q: np.ndarray, k: int, p: int, radius: np.ndarray | None, done: list | None, names: list[str]) -> Iterator[tuple[int, int]]:
        """(row, block): the nearest blocks with ``k`` donors, or those within the squared ``radius`` that are not done yet."""
        last = len(self.order) - 1
        if radius is None:
            at = np.clip(np.searchsorted(self.low, q, side="right") - 1, 0, last)
            for i, (x, a) in enumerate(zip(q.tolist(), at.tolist())):
                b, need = a + 1, k
                while need > 0 and (a >= 0 or b <= last):
                    left = max(x - self.high[a], 0.0) if a >= 0 else math.inf
                    right = max(self.low[b] - x, 0.0) if b <= last else math.inf
                    if a >= 0 and left <= right:
                        pick, a = a, a - 1
                    else:
                        pick, b = b, b + 1
                    yield i, self.order[pick]
                    need -= self.donors[pick]
            return
        # a hair of slack keeps blocks that lie at the radius up to rounding
        reach = np.sqrt(radius / p) * (1 + 1e-9) + np.abs(q) * 1e-12
        first, end = np.searchsorted(self.high, q - reach, side="left"), np.searchsorted(self.low, q + reach, side="right")
        for i, (a, b) in enumerate(zip(first.tolist(), end.tolist())):
            skip = set(done[i])
            for pick in range(a, b):
                if names[self.order[pick]] not in skip:
                    yield i, self.order[pick]


def along_line(q: np.ndarray, x: np.ndarray, value: np.ndarray, copies: np.ndarray, k: int, p: int) -> tuple[np.ndarray, ...]:
    """(row, squared distance, value, copies) of the ``k`` nearest donors of each ``q`` by ``x``, equal distances by value.

    The donors around a row in the order of ``x`` are looked at, more of them while the next one is as near as the last taken.
    """
    ok = np.flatnonzero(~np.isnan(x) & ~np.isnan(value))
    ok = ok[np.lexsort((value[ok], x[ok]))]
    x, value, copies = x[ok], value[ok], copies[ok]
    n, width, todo, found = len(x), k, np.arange(len(q) if len(ok) else 0), []
    at = np.searchsorted(x, q, side="left")
    while len(todo):
        again = []
        step = max(1, PAIRS_AT_ONCE // (2 * width))
        for part in (todo[s : s + step] for s in range(0, len(todo), step)):
            place = at[part][:, None] + np.arange(-width, width)
            inside = (place >= 0) & (place < n)
            place = np.clip(place, 0, n - 1)
            dist = np.where(inside, (q[part][:, None] - x[place]) ** 2 * p, np.inf)
            order = np.lexsort((value[place], dist), axis=1)[:, :k]
            near = np.take_along_axis(dist, order, axis=1)
            edge = near[:, -1]
            before, behind = at[part] - width - 1, at[part] + width
            # nothing outside is as near as the last one taken
            shut = (before < 0) | ((q[part] - x[np.maximum(before, 0)]) ** 2 * p > edge)
            shut &= (behind >= n) | ((q[part] - x[np.minimum(behind, n - 1)]) ** 2 * p > edge)
            again.append(part[~shut])
            i, m = np.nonzero(np.isfinite(near) & shut[:, None])
            taken = place[i, order[i, m]]
            found.append((part[i], near[i, m], value[taken], copies[taken]))
        todo, width = np.concatenate(again), min(2 * width, max(n, width))
    if not found:
        return np.array([], dtype=int), np.array([]), np.array([]), np.array([], dtype=int)
    return tuple(np.concatenate(c) for c in zip(*found))


def _radius(candidates: Column, k: int) -> Column:
    """Squared distance of the k-th donor, infinite if there are fewer."""
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(float("inf")).alias("r"))
    return F.aggregate(
        candidates,
        start,
        lambda a, e: F.struct((a["n"] + e["n"]).alias("n"), F.when((a["n"] < k) & (a["n"] + e["n"] >= k), e["d"]).otherwise(a["r"]).alias("r")),
        lambda a: a["r"],
    )


def _weighted(candidates: Column, k: int) -> Column:
    zero = F.lit(0.0)
    start = F.struct(
        F.lit(0).cast("long").alias("n"), zero.alias("w"), zero.alias("wv"), zero.alias("zn"), zero.alias("zv")
    )

    def step(a: Column, e: Column) -> Column:
        take = F.greatest(F.least(e["n"], F.lit(k) - a["n"]), F.lit(0)).cast("double")
        exact = e["d"] == 0
        weight = F.when(exact, 0.0).otherwise(take / F.sqrt(F.when(exact, 1.0).otherwise(e["d"])))
        return F.struct(
            (a["n"] + e["n"]).alias("n"),
            (a["w"] + weight).alias("w"),
            (a["wv"] + weight * e["v"]).alias("wv"),
            (a["zn"] + F.when(exact, take).otherwise(0.0)).alias("zn"),
            (a["zv"] + F.when(exact, take * e["v"]).otherwise(0.0)).alias("zv"),
        )

    return F.aggregate(
        candidates, start, step, lambda a: F.when(a["zn"] > 0, F.try_divide(a["zv"], a["zn"])).otherwise(F.try_divide(a["wv"], a["w"]))
    )
