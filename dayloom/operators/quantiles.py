"""Exact quantiles of groups of any size by refining histograms.

Values are counted in buckets, and only the buckets that hold a wanted rank are
looked at again: first buckets of a fixed relative width, then equal cuts between the
lowest and the highest value found in one of those, then the values in one of these.
Each step reads the rows and sends counts, so no exchange holds values but the last,
which holds the distinct ones of the cuts with a wanted rank.

A step is given the wanted buckets by a broadcast: at most two for each group and
probability. Their number is checked where they are made, and too many groups
raise; groups that many are small, and `long_series.exact_quantiles` suits them.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F

# Buckets for each doubling of a value, and equal cuts of a bucket.
PER_DOUBLING, CUTS = 64, 16_384
# Wanted buckets that are broadcast at most, about 100 bytes each.
BROADCAST_ROWS = 200_000
# Beyond every logarithm of a double, the bucket of infinity, and that of NaN, which sorts last.
_LEAST, _INFINITE, _NAN = 80_000, 200_000, 300_000


def bucket(v: Column) -> Column:
    """Ascending in the value; zero for zero, NULL for NULL."""
    size = F.abs(v)
    height = F.when(size == float("inf"), _INFINITE).otherwise(F.floor(F.log2(size) * PER_DOUBLING) + _LEAST)
    signed = F.when(v == 0, 0).when(v > 0, height).otherwise(-height)
    return F.when(F.isnan(v), _NAN).otherwise(signed).cast("int")


def cut(v: Column, low: Column, high: Column) -> Column:
    """Which of the equal cuts between low and high a value is in."""
    share = (v - low) / (high - low)
    return F.least(F.floor(share * CUTS), F.lit(CUTS - 1)).cast("int")


def _broadcast(wanted: DataFrame) -> DataFrame:
    """The rows for every task; raises if there are more than the bound."""
    number = F.monotonically_increasing_id()  # of rows in the one partition that a limit leaves
    many = F.raise_error(F.lit(f"more than {BROADCAST_ROWS} buckets: describe so many groups with grain='ranks'"))
    held = wanted.limit(BROADCAST_ROWS + 1)
    checked = held.withColumn("_bucket", F.when(number >= BROADCAST_ROWS, many.cast("int")).otherwise(F.col("_bucket")))
    return F.broadcast(checked)


def _hits(probabilities: Sequence[float]) -> Column:
    """The points (probability q, at rank `at`, after the whole rank `low`) with a rank among the `_n` from `_begin` on."""
    at = {float(p): f"{float(p)!r}D * (_total - 1)" for p in probabilities}
    points = ", ".join(f"struct({p!r}D as q, cast(floor({a}) as bigint) as low, {a} as at)" for p, a in at.items())
    covers = "{0} >= _begin and {0} < _begin + _n".format
    return F.expr(f"filter(array({points}), s -> {covers('s.low')} or {covers('least(s.low + 1, _total - 1)')})")


def _ranked(counts: DataFrame, within: Sequence[Column], by: str, probabilities: Sequence[float]) -> DataFrame:
    """Counts from rank `_from` on become runs with their first rank; runs without a wanted rank are left out."""
    before = Window.partitionBy(*within).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)
    begin = F.col("_from") + F.coalesce(F.sum("_n").over(before), F.lit(0))
    empty = F.col("_total") == 0
    return counts.withColumn("_begin", begin).where((F.size(_hits(probabilities)) > 0) | empty)


def summary(
    tall: DataFrame, group: Sequence[str], value: str, probabilities: Sequence[float], names: Sequence[str]
) -> DataFrame:
    """Per group: count, mean, std, min, max, and the interpolated quantiles as `names`.

    A group whose values are all NULL has a count of 0.
    """
    keys = [f"_k{at}" for at in range(len(group))]
    v, low, high = F.col("_v"), F.col("_low"), F.col("_high")
    rows = tall.select(*[F.col(c).alias(k) for c, k in zip(group, keys)], F.col(value).cast("double").alias("_v")).select(
        *keys, "_v", bucket(v).alias("_bucket")
    )
    of = [F.col(k) for k in keys]
    whole = Window.partitionBy(*of)

    def first(*columns: str) -> list[Column]:
        return [F.first(c).alias(c) for c in columns]

    def wanted(broadcast: DataFrame) -> DataFrame:
        """The rows in one of the buckets; groups may have NULL keys."""
        told = broadcast.select(*[F.col(c).alias(f"{c}_") if c in (*keys, "_bucket") else F.col(c) for c in broadcast.columns])
        same = [F.col(k).eqNullSafe(F.col(f"{k}_")) for k in (*keys, "_bucket")]
        return rows.join(told, reduce(and_, same)).drop(*[f"{c}_" for c in (*keys, "_bucket")])

    # What is known of a group stays on its rows, so that no step counts twice.
    known = ("_total", "_mean", "_std", "_min", "_max")
    counted = rows.groupBy(*keys, "_bucket").agg(
        F.count(v).alias("_n"), F.avg(v).alias("_m"), F.var_pop(v).alias("_spread"), F.min(v).alias("_low"), F.max(v).alias("_high")
    )
    total = F.sum("_n").over(whole)
    placed = counted.select(
        "*", F.lit(0).cast("long").alias("_from"), total.alias("_total"), F.min(low).over(whole).alias("_min"),
        F.max(high).over(whole).alias("_max"),
        (F.sum(F.col("_n") * F.col("_m")).over(whole) / F.nullif(total, F.lit(0))).alias("_mean"),
    )
    off = F.col("_m") - F.col("_mean")
    squares = F.sum(F.col("_n") * (F.col("_spread") + off * off)).over(whole)
    placed = placed.withColumn("_std", F.when(F.col("_total") > 1, F.sqrt(squares / (F.col("_total") - 1))))
    coarse = _ranked(placed, of, "_bucket", probabilities).select(*keys, "_bucket", "_n", "_begin", *known, "_low", "_high")
    begin = F.col("_begin").alias("_from")
    open_coarse = coarse.where(F.coalesce(low < high, F.lit(False))).select(*keys, "_bucket", begin, *known, "_low", "_high")
    fine = _ranked(
        wanted(_broadcast(open_coarse)).withColumn("_cut", cut(v, low, high)).groupBy(*keys, "_bucket", "_cut").agg(
            F.count(v).alias("_n"), F.min(v).alias("_first"), F.max(v).alias("_last"), *first("_from", *known, "_low", "_high")
        ),
        [*of, F.col("_bucket")], "_cut", probabilities,
    ).select(*keys, "_bucket", "_cut", "_n", "_begin", *known, "_low", "_high", "_first", "_last")
    open_fine = fine.where(F.coalesce(F.col("_first") < F.col("_last"), F.lit(False))).select(*keys, "_bucket", "_cut", begin, *known, "_low", "_high")
    each = _ranked(
        wanted(_broadcast(open_fine)).where(cut(v, low, high) == F.col("_cut"))
        .groupBy(*keys, "_bucket", "_cut", "_v").agg(F.count(v).alias("_n"), *first("_from", *known)),
        [*of, F.col("_bucket"), F.col("_cut")], "_v", probabilities,
    )

    run = (*keys, "_n", "_begin", *known)
    equal_low, equal_first = ~F.coalesce(low < high, F.lit(False)), ~F.coalesce(F.col("_first") < F.col("_last"), F.lit(False))
    runs = (
        coarse.where(equal_low).select(*run, low.alias("_x"))
        .unionByName(fine.where(equal_first).select(*run, F.col("_first").alias("_x")))
        .unionByName(each.select(*run, v.alias("_x")))
    )
    points = runs.select(*keys, *known, "_x", F.explode_outer(_hits(probabilities)).alias("_p"))

    def quantile(p: float) -> list[Column]:
        here = F.when(F.col("_p.q") == p, F.col("_x"))
        return [F.min(here), F.max(here), F.max(F.when(F.col("_p.q") == p, F.col("_p.at") - F.col("_p.low")))]

    def between(name: str) -> Column:
        """Infinite neighbours have no difference to go along."""
        a, b, share = (F.col(f"{name}{side}") for side in "abs")
        return F.when(a == b, a).otherwise(a + (b - a) * share).alias(name)

    ends = points.groupBy(*keys).agg(
        *first(*known), *[c.alias(f"{name}{side}") for p, name in zip(probabilities, names) for c, side in zip(quantile(p), "abs")]
    )
    basics = {"count": "_total", "mean": "_mean", "std": "_std", "min": "_min", "max": "_max"}
    return ends.select(
        *[F.col(k).alias(c) for k, c in zip(keys, group)], *[F.col(c).alias(n) for n, c in basics.items()], *map(between, names)
    )
