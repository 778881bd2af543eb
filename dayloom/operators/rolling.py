"""Moments of rolling frames with the same work per row for any frame length.

A sliding frame is summed up anew for every row, so a frame of 365 rows costs 365
steps a row. Here a series is cut into segments as long as the frame. Every frame
is the end of one segment and the beginning of the next, and both are growing frames,
which Spark carries on from row to row: forwards for beginnings, backwards for ends.
The two are merged by their counts, means and centred squares, which only adds, so
large levels do not cancel as they do in differences of running sums.

All windows follow from one exchange by the series keys. `order` must be a total
order within a series.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from dayloom.operators.long_series import ROWS_PER_BLOCK, blocks_with_halo, row_index
from dayloom.operators.windows import EPS, Series, zscore_of


def _seen(c: str, window) -> Column:
    """What is known of the values in a growing frame."""
    x = F.col(c)
    return F.struct(
        F.count(x).over(window).alias("n"), F.avg(x).over(window).alias("mean"), F.var_pop(x).over(window).alias("spread"),
        F.min(x).over(window).alias("low"), F.max(x).over(window).alias("high"),
    )


def _merged(a: Column, b: Column) -> Column:
    """(n, mean, std) of two sets of values, of which either may be empty or missing."""
    n_a, n_b = (F.coalesce(s["n"], F.lit(0)) for s in (a, b))
    n = n_a + n_b

    def weighed(x: Column, y: Column) -> Column:
        return F.coalesce(n_a * x, F.lit(0.0)) + F.coalesce(n_b * y, F.lit(0.0))

    apart = F.coalesce(b["mean"] - a["mean"], F.lit(0.0))
    squares = weighed(a["spread"], b["spread"]) + F.try_divide(apart * apart * n_a * n_b, n)
    constant = F.least(a["low"], b["low"]) == F.greatest(a["high"], b["high"])
    mean = F.when(constant, F.least(a["low"], b["low"])).otherwise(F.try_divide(weighed(a["mean"], b["mean"]), n))
    std = F.when(n > 1, F.when(constant, 0.0).otherwise(F.sqrt(squares / (n - 1))))
    return F.struct(n.alias("n"), mean.alias("mean"), std.alias("std"))


def rolling_moments(df: DataFrame, series: Series, c: str, n: int, out: str) -> DataFrame:
    """Add a struct (n, mean, std) of the known values of `c` in the last n rows."""
    number = F.row_number().over(series.forward) - 1
    cut = df.withColumns({"_segment": F.floor(number / n).cast("long"), "_place": number % n})
    within = Window.partitionBy(*series.keys, "_segment")
    grows = (Window.unboundedPreceding, 0)
    begun = within.orderBy(*series.order).rowsBetween(*grows)
    ended = within.orderBy(*[F.col(o).desc() for o in series.order]).rowsBetween(*grows)
    seen = cut.withColumn("_end", _seen(c, ended)).withColumn("_begin", _seen(c, begun))
    # The row where the frame begins knows the rest of its segment, unless the frame is the whole segment.
    before = F.when(F.col("_place") < n - 1, F.lag("_end", n - 1).over(series.forward))
    both = seen.withColumn("_before", before)
    return both.withColumn(out, _merged(F.col("_before"), F.col("_begin"))).drop("_segment", "_place", "_end", "_begin", "_before")


def rolling_zscores(
    df: DataFrame, series: Series, c: str, n: int, out: str, min_periods: int | None = None, eps: float | None = EPS
) -> DataFrame:
    """`Series.rolling_zscore` at a cost that does not depend on n."""
    rows = rolling_moments(df, series, c, n, "_moments")
    stats = F.col("_moments").withField("x", F.col(c))
    return rows.withColumn(out, zscore_of(stats, n if min_periods is None else min_periods, eps)).drop("_moments")


def long_rolling_zscores(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], c: str, n: int, out: str,
    min_periods: int | None = None, eps: float | None = EPS, pieces: int | None = None, rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """The same for series too long for one task: in blocks, each with the n - 1 rows before it."""
    rows = row_index(df, keys, order, "_index", pieces)
    blocks = blocks_with_halo(rows, "_index", n - 1, max(rows_per_block, n))
    scored = rolling_zscores(blocks, Series([*keys, "_block"], ["_index"]), c, n, out, min_periods, eps)
    return scored.filter(~F.col("_halo")).drop("_halo", "_block", "_index")
