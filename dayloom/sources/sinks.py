"""Sinks for feature tables and reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F


def write_table(
    df: DataFrame,
    path: str,
    fmt: str = "parquet",
    partition_by: Sequence[str] = (),
    mode: str = "overwrite",
) -> None:
    """Write a table without a row index, as Parquet or header CSV."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer.option("header", True).option("escape", '"').csv(path)
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unknown table format {fmt!r}")


def describe_to_wide(described: DataFrame, features: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Long `describe` output to one row per statistic, one column per feature."""
    stats = [c for c in described.columns if c not in {"feature", *keys}]
    rows = described.unpivot([*keys, "feature"], stats, "statistic", "value")
    return (
        rows.groupBy(*keys, "statistic")
        .pivot("feature", list(features))
        .agg(F.first("value", ignorenulls=True))
    )


def write_describe(described: DataFrame, path: str, features: Sequence[str], keys: Sequence[str] = ()) -> None:
    """Write a describe table as CSV with the statistic in the first column."""
    wide = describe_to_wide(described, features, keys)
    rest = [c for c in wide.columns if c != "statistic"]
    write_table(wide.select("statistic", *rest), path, fmt="csv")
