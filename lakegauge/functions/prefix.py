"""Running totals over a whole sorted column, spread over many tasks.

A plain ``sum().over(partitionBy(feature).orderBy(x))`` puts a feature into one task. Here each feature is
cut into buckets; the running sum runs inside a bucket and the totals of the buckets before it are added.
The table of bucket totals has ``features x buckets`` rows; it is taken to the driver and broadcast.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .frames import local_frame
from .quantiles import approx_cuts, counts_of, melt, with_buckets

ROWS_PER_BUCKET = 100_000
MAX_BUCKETS = 4096


def bucket_cuts(
    df: DataFrame, cols: Sequence[str], rows_per_bucket: int = ROWS_PER_BUCKET, n: Mapping[str, int] | None = None
) -> dict[str, list[float]]:
    """Cut points that leave about ``rows_per_bucket`` rows between them (fewer distinct values still)."""
    n = n or counts_of(df, cols)
    parts = {c: min(MAX_BUCKETS, max(1, -(-n[c] // rows_per_bucket))) for c in cols}
    return approx_cuts(df, cols, parts, n)


def _summed(df: DataFrame, cols: Sequence[str], sums: Mapping[str, Column], cuts: Mapping[str, Sequence[float]], own: Mapping[str, Mapping[str, Column]]) -> DataFrame:
    """Long rows with the summands; ``own`` has a summand's column for each of ``cols``, all built before the unpivot."""
    named = {f"{c}{name}": e for name, each in own.items() for c, e in each.items()}
    wide = with_buckets(df.select(*cols, *[e.alias(name) for name, e in (*sums.items(), *named.items())]), cuts)
    return melt(wide, cols, extra=list(sums), own=list(own))


def value_counts(
    df: DataFrame,
    cols: Sequence[str],
    sums: Mapping[str, Column],
    cuts: Mapping[str, Sequence[float]],
    own: Mapping[str, Mapping[str, Column]] | None = None,
) -> DataFrame:
    """``(feature, bucket, x, <sums>)``: one row per distinct value, summed map-side before the shuffle."""
    long = _summed(df, cols, sums, cuts, own or {})
    return long.groupBy("feature", "bucket", "x").agg(*[F.sum(s).alias(s) for s in (*sums, *(own or {}))])


def bucket_totals(
    df: DataFrame, cols: Sequence[str], sums: Mapping[str, Column], cuts: Mapping[str, Sequence[float]], own: Mapping[str, Mapping[str, Column]] | None = None
) -> dict[str, dict[int, dict]]:
    """Per feature and bucket the sums, smallest and largest value, on the driver (``features x buckets`` rows)."""
    rows = (
        _summed(df, cols, sums, cuts, own or {})
        .groupBy("feature", "bucket")
        .agg(*[F.sum(s).alias(s) for s in (*sums, *(own or {}))], F.min("x").alias("lo"), F.max("x").alias("hi"))
        .collect()
    )
    out: dict[str, dict[int, dict]] = {c: {} for c in cols}
    for r in sorted(rows, key=lambda r: r.bucket):
        out[r.feature][r.bucket] = r.asDict()
    return out


def running_totals(
    counts: DataFrame, sums: Sequence[str], totals: Mapping[str, Mapping[int, dict]], descending: bool = False
) -> DataFrame:
    """Add ``before_<s>`` (total of all smaller values), ``all_<s>`` and ``next_x`` to value counts.

    With ``descending`` the running direction is from the largest value down.
    """
    rows = []
    for feature, buckets in totals.items():
        whole = [sum(b[s] for b in buckets.values()) for s in sums]
        seen = [0] * len(sums)
        order = sorted(buckets, reverse=descending)
        for i, bucket in enumerate(order):
            after = buckets[order[i + 1]]["hi" if descending else "lo"] if i + 1 < len(order) else None
            rows.append((feature, bucket, *seen, *whole, after))
            seen = [have + buckets[bucket][s] for have, s in zip(seen, sums)]
    schema = ["feature string", "bucket int", *[f"off_{s} long" for s in sums], *[f"all_{s} long" for s in sums], "next_edge double"]
    offsets = local_frame(counts.sparkSession, rows, ", ".join(schema))
    order = F.desc if descending else F.asc
    inside = Window.partitionBy("feature", "bucket").orderBy(order("x"))
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = counts.join(F.broadcast(offsets), ["feature", "bucket"])
    return joined.select(
        "feature",
        "bucket",
        "x",
        *sums,
        *[(F.col(f"off_{s}") + F.sum(s).over(upto) - F.col(s)).alias(f"before_{s}") for s in sums],
        *[f"all_{s}" for s in sums],
        F.coalesce(F.lead("x").over(inside), F.col("next_edge")).alias("next_x"),
    )
