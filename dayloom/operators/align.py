"""Joins: enrichment by key and consolidation of tall features into one row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from dayloom.operators.windows import Series


def enrich_left(df: DataFrame, other: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Left join on equally named keys (Spark picks the strategy by size)."""
    return df.join(other, on, "left")


def align_many(spine: DataFrame, sources: Sequence[DataFrame], on: Sequence[str]) -> DataFrame:
    """Left-join several sources to a spine on the same key."""
    for source in sources:
        spine = spine.join(source, list(on), "left")
    return spine


def consolidate_wide(
    tall: DataFrame,
    features: Sequence[str],
    keys: Sequence[str] = ("day",),
    feature: str = "feature",
    value: str = "value",
) -> DataFrame:
    """Tall (keys, feature, value) to one row per key in a single exchange.

    The feature list is known, so conditional aggregates replace a pivot, which
    would first shuffle on (keys, feature) and then again on the keys. Two values
    for one cell would multiply rows in a join chain; here they raise.
    """
    aggregates = []
    for f in features:
        mine = F.col(feature) == f
        aggregates += [
            F.max(F.when(mine, F.col(value))).alias(f"{f}_x"),
            F.count(F.when(mine, F.lit(1))).alias(f"{f}_n"),
        ]
    cells = tall.groupBy(*keys).agg(*aggregates)
    return cells.select(
        *keys,
        *[
            F.when(
                F.col(f"`{f}_n`") > 1,
                F.raise_error(F.lit(f"more than one value for {f}")).cast("double"),
            )
            .otherwise(F.col(f"`{f}_x`"))
            .alias(f)
            for f in features
        ],
    )


def consolidate_on_spine(spine: DataFrame, tall: DataFrame, features: Sequence[str], day: str = "day") -> DataFrame:
    """Spine columns followed by the consolidated features, every spine day kept."""
    return spine.join(consolidate_wide(tall, features, [day]), day, "left")


def patch_column(
    table: DataFrame,
    replacement: DataFrame,
    day: str,
    column: str,
    change: str,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Join a replacement series, forward-fill it and recompute its log-return."""
    joined = table.join(replacement, [*keys, day], "left")
    series = Series(list(keys), [day])
    filled = joined.withColumn(column, series.forward_fill(column))
    return filled.withColumn(change, series.log_return(column))
