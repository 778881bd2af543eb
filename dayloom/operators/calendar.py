"""Daily calendar: spine, alignment of series to it, resampling, eras.

Alignment does not join a generated spine. Each row of a series knows the next
row's day, so it can emit the empty days up to it. That needs one exchange on
the series key, which the later window operators reuse, and never shuffles the
generated days.

Window groups here hold one row per (series, day) -- duplicates are refused --
so a group is never longer than the calendar, however large the panel is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from dayloom.functions.scalar import is_weekend

# The study's calendar and the day its second era starts.
SPINE_START = "2016-12-31"
SPINE_END = "2025-08-01"
ERA_CUT = "2020-03-11"
ERA_LABELS = ("retail", "institutional")


def _date(value: str | Column) -> Column:
    return F.lit(value).cast("date") if isinstance(value, str) else value


def calendar_spine(
    spark: SparkSession, start: str = SPINE_START, end: str = SPINE_END, day: str = "day"
) -> DataFrame:
    """One row per day, both ends included, with a weekend marker."""
    days = F.sequence(_date(start), _date(end), F.expr("interval 1 day"))
    return spark.range(1).select(F.explode(days).alias(day)).withColumn("is_weekend", is_weekend(day))


def _day_runs(
    df: DataFrame,
    keys: Sequence[str],
    day: str,
    values: Sequence[str],
    start: str | None,
    end: str | None,
) -> DataFrame:
    by_series = Window.partitionBy(*keys).orderBy(day)
    following = F.lead(day).over(by_series)
    marked = df.select(
        *keys,
        F.col(day).alias("_day"),
        F.row_number().over(by_series).alias("_rank"),
        following.alias("_next"),
        *values,
    )
    duplicate = F.raise_error(
        F.concat(F.lit("more than one row for a series on "), F.col("_day").cast("string"))
    ).cast("date")
    last = F.when(F.col("_next") == F.col("_day"), duplicate).otherwise(F.date_sub("_next", 1))
    unknown = F.raise_error(F.lit("a row of a series has no day")).cast("date")
    first = F.when(F.col("_day").isNull(), unknown).otherwise(F.col("_day"))
    if start is None:
        last = F.coalesce(last, F.col("_day"))
    else:
        last = F.least(F.coalesce(last, _date(end)), _date(end))
        first = (
            F.when(F.col("_day").isNull(), unknown).when(F.col("_rank") == 1, _date(start))
            .otherwise(F.greatest("_day", _date(start)))
        )
    ranged = marked.withColumns({"_first": first, "_last": last})
    days = F.when(
        F.col("_first") <= F.col("_last"),
        F.sequence("_first", "_last", F.expr("interval 1 day")),
    )
    return ranged.select(*keys, F.explode(days).alias(day), "_day", *values).select(
        *keys,
        day,
        *[F.when(F.col(day) == F.col("_day"), F.col(v)).alias(v) for v in values],
    )


def align_to_spine(
    df: DataFrame,
    keys: Sequence[str],
    day: str,
    values: Sequence[str],
    start: str = SPINE_START,
    end: str = SPINE_END,
) -> DataFrame:
    """Every series on every day of start..end; days without a row are NULL.

    Rows outside the range are lost. A second row for a (series, day) and a row
    without a day raise.
    """
    return _day_runs(df, keys, day, values, start, end)


def resample_daily(df: DataFrame, keys: Sequence[str], day: str, values: Sequence[str]) -> DataFrame:
    """Dense days between each series' own first and last day."""
    return _day_runs(df, keys, day, values, None, None)


def era_label(day: str, cut: str = ERA_CUT, labels: Sequence[str] = ERA_LABELS) -> Column:
    """Label of the era a day belongs to; the cut day opens the second era, and
    no day belongs to none."""
    return F.when(F.col(day) < _date(cut), F.lit(labels[0])).when(F.col(day) >= _date(cut), F.lit(labels[1]))


def assign_era(
    df: DataFrame,
    day: str,
    cut: str = ERA_CUT,
    labels: Sequence[str] = ERA_LABELS,
    boundary: str = "second",
    out: str = "era",
) -> DataFrame:
    """Add the era label. With boundary='both' the cut day appears in each era.
    Rows without a day are in no era and left out, as by slices of days."""
    df = df.filter(F.col(day).isNotNull())
    if boundary == "second":
        return df.withColumn(out, era_label(day, cut, labels))
    if boundary != "both":
        raise ValueError("boundary is 'second' or 'both'")
    shared = F.array(F.lit(labels[0]), F.lit(labels[1]))
    single = F.array(era_label(day, cut, labels))
    return df.withColumn(out, F.explode(F.when(F.col(day) == _date(cut), shared).otherwise(single)))


def era_calendar(
    spark: SparkSession,
    start: str = SPINE_START,
    end: str = SPINE_END,
    cut: str = ERA_CUT,
    labels: Sequence[str] = ERA_LABELS,
) -> DataFrame:
    """Both era calendars in one table; the cut day belongs to each."""
    return assign_era(calendar_spine(spark, start, end).select("day"), "day", cut, labels, "both")
