"""Table profiling: describe, null counts, extents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from dayloom.functions.scalar import round_even
from dayloom.operators.clean import limit_head, numeric_columns
from dayloom.operators.long_series import exact_quantiles
from dayloom.operators.quantiles import summary

QUARTILES = (0.25, 0.5, 0.75)
STATISTICS = ("count", "mean", "std", "min", "p25", "p50", "p75", "max")


def melt(df: DataFrame, ids: Sequence[str], columns: Sequence[str], name: str = "feature", value: str = "value") -> DataFrame:
    """Wide columns to tall (ids, name, value) rows as doubles."""
    doubles = df.select(*ids, *[F.col(f"`{c}`").cast("double").alias(c) for c in columns])
    return doubles.unpivot([F.col(c) for c in ids], [F.col(f"`{c}`") for c in columns], name, value)


def describe(
    df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), grain: str = "any"
) -> DataFrame:
    """Count, mean, sample deviation, extremes and quartiles per column.

    One row per (keys, column). With grain='any' the quartiles come from refined
    histograms: no group is held anywhere, and counts are sent instead of values.
    'ranks' is for very many groups of any size, whose ranks are distributed.
    `percentile` keeps the distinct values of a group in memory, so it is used
    only where grain='day' says that a group has one row per day. These are
    exact. With grain='approximate' the quartiles are values of the column near the
    ranks, from one pass and sketches of bounded size.
    """
    if grain not in ("any", "ranks", "day", "approximate"):
        raise ValueError("grain is 'any', 'ranks', 'day' or 'approximate'")
    tall = melt(df, keys, columns)
    group = [*keys, "feature"]
    basics = [
        F.count("value").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    ]
    if grain == "any":
        return summary(tall, group, "value", QUARTILES, STATISTICS[4:7]).select(*group, *STATISTICS)
    if grain != "ranks":
        points = F.array(*[F.lit(p) for p in QUARTILES])
        quartiles = F.percentile("value", points) if grain == "day" else F.percentile_approx("value", points, 10_000)
        rows = tall.groupBy(*group).agg(*basics, quartiles.alias("_q"))
        rows = rows.withColumns({f"p{int(100 * p)}": F.col("_q")[i] for i, p in enumerate(QUARTILES)})
    else:
        wide = exact_quantiles(tall, group, "value", QUARTILES).groupBy(*group).agg(
            *[F.max(F.when(F.col("q") == p, F.col("quantile"))).alias(f"p{int(100 * p)}") for p in QUARTILES]
        )
        rows = tall.groupBy(*group).agg(*basics).join(wide, group, "left")
    return rows.select(*group, *STATISTICS)


def rounded_stats(described: DataFrame, digits: int) -> DataFrame:
    """Half-even rounding of every statistic but the count."""
    return described.withColumns({s: round_even(s, digits) for s in STATISTICS if s != "count"})


def describe_by_era(
    df: DataFrame, columns: Sequence[str], era: str = "era", digits: int = 4, grain: str = "any"
) -> DataFrame:
    """`describe` for each era label, rounded. An era of a wide table has one
    row per day, so grain='day' suits it; a tall panel needs 'any'."""
    return rounded_stats(describe(df, columns, [era], grain), digits)


def day_extent(df: DataFrame, day: str, keys: Sequence[str] = ()) -> DataFrame:
    """First and last day and the number of days seen, per group."""
    return df.groupBy(*keys).agg(
        F.min(day).alias("first_day"), F.max(day).alias("last_day"), F.count(day).alias("days")
    )


def null_counts(df: DataFrame, columns: Sequence[str] | None = None, only_positive: bool = True) -> DataFrame:
    """NULLs per column in one aggregate pass; columns without any are left out."""
    names = list(columns if columns is not None else df.columns)
    counts = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in names])
    rows = counts.unpivot([], [F.col(f"`{c}`") for c in names], "feature", "nulls")
    return rows.filter(F.col("nulls") > 0) if only_positive else rows


def table_extent(df: DataFrame, day: str) -> DataFrame:
    """Row and column counts, first and last day, and the column list."""
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.min(day).alias("first_day"),
        F.max(day).alias("last_day"),
    ).select(
        "rows",
        F.lit(len(df.columns)).alias("columns"),
        "first_day",
        "last_day",
        F.lit(", ".join(df.columns)).alias("column_list"),
    )


def column_info(df: DataFrame) -> DataFrame:
    """Type and non-null count of every column."""
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns])
    rows = counts.unpivot([], [F.col(f"`{c}`") for c in df.columns], "feature", "non_null")
    types = F.create_map(*[F.lit(v) for f in df.schema.fields for v in (f.name, f.dataType.simpleString())])
    return rows.withColumn("type", types[F.col("feature")])


def profile_table(df: DataFrame, order: str, rows: int = 10, grain: str = "any") -> dict[str, DataFrame]:
    """The usual first look: `describe`, `info` and `head` as DataFrames."""
    return {
        "describe": describe(df, numeric_columns(df), grain=grain),
        "info": column_info(df),
        "head": limit_head(df, rows, order),
    }
