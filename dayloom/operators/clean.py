"""Projection, filtering and cleaning steps that keep one row per input row."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import NumericType

from dayloom.functions.scalar import nonfinite_to_null, zero_to_null


def select_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for c in columns])


def rename_columns(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))


def derive_column(df: DataFrame, steps: Sequence[tuple[str, Column]]) -> DataFrame:
    """Add columns in order; each step may use the ones before it."""
    for name, expr in steps:
        df = df.withColumn(name, expr)
    return df


def drop_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Drop the listed columns that exist."""
    return df.drop(*columns)


def filter_after(df: DataFrame, day: str, start: str, inclusive: bool = False) -> DataFrame:
    """Keep days after `start`.

    Apply it after windowed columns: Catalyst leaves a filter on the ordering
    column above the window, so the first kept row still sees its lag.
    """
    bound = F.lit(start).cast("date")
    return df.filter(F.col(day) >= bound if inclusive else F.col(day) > bound)


def filter_between(df: DataFrame, day: str, start: str, end: str) -> DataFrame:
    return df.filter(F.col(day).between(F.lit(start).cast("date"), F.lit(end).cast("date")))


def filter_equals_day(df: DataFrame, day: str, value: str) -> DataFrame:
    return df.filter(F.col(day) == F.lit(value).cast("date"))


def filter_not_null(df: DataFrame, column: str) -> DataFrame:
    return df.filter(F.col(column).isNotNull())


def drop_null_rows(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Listwise deletion over `columns` (all when not given)."""
    return df.dropna(how="any", subset=list(columns) if columns is not None else None)


def distinct_rows(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def clean_zero(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: zero_to_null(c) for c in columns})


def clean_nonfinite(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: nonfinite_to_null(c) for c in columns})


def fill_constant(df: DataFrame, value: float = 0.0, columns: Sequence[str] | None = None) -> DataFrame:
    """NULL to a constant. Before a transform the gap becomes a real value;
    after it, only the transformed result is replaced."""
    return df.fillna(value, subset=list(columns) if columns is not None else None)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NumericType)]


def split_feature_sets(
    df: DataFrame, day: str, transformed: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """(day + transformed columns, everything else)."""
    return df.select(day, *transformed), df.drop(*transformed)


def order_by(df: DataFrame, *columns: str, descending: bool = False) -> DataFrame:
    """Global sort with missing values last."""
    return df.orderBy(
        *[F.col(c).desc_nulls_last() if descending else F.col(c).asc_nulls_last() for c in columns]
    )


def limit_head(df: DataFrame, n: int, *order: str) -> DataFrame:
    """First n rows in the given order (a top-k, never a full sort)."""
    return order_by(df, *order).limit(n)


def limit_tail(df: DataFrame, n: int, *order: str) -> DataFrame:
    """Last n rows in the given order."""
    return order_by(df, *order, descending=True).limit(n)
