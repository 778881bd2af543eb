"""Pearson correlation tables in long form (keys, a, b, r, n)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from dayloom.operators.calendar import ERA_CUT, ERA_LABELS, assign_era
from dayloom.operators.comoments import comoments, varies

def correlation_matrix(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Correlation of every ordered column pair with pairwise NULL deletion.

    NULL for a constant side or fewer than two complete rows.
    """
    names = F.array(*[F.lit(c) for c in columns])
    moments = comoments(df, columns, keys)
    usable = (F.col("n") >= 2) & varies("i") & varies("j")
    r = F.when(
        F.col("i") == F.col("j"), F.when(usable, F.lit(1.0))
    ).otherwise(F.when(usable, F.try_divide(F.col("cp"), F.sqrt(F.col("ss_i")) * F.sqrt(F.col("ss_j")))))
    half = moments.select(*keys, "i", "j", r.alias("r"), F.col("n").cast("long").alias("n"))
    mirrored = F.when(
        F.col("i") == F.col("j"), F.array(F.struct("i", "j"))
    ).otherwise(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"))))
    return half.select(*keys, F.explode(mirrored).alias("_p"), "r", "n").select(
        *keys,
        F.get(names, F.col("_p.i")).alias("a"),
        F.get(names, F.col("_p.j")).alias("b"),
        F.when(F.col("r") > 1, 1.0).when(F.col("r") < -1, -1.0).otherwise(F.col("r")).alias("r"),
        "n",
    )


def lower_triangle(correlations: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each pair once, without the diagonal: rows where a stands after b."""
    names = F.array(*[F.lit(c) for c in columns])
    return correlations.filter(
        F.array_position(names, F.col("a")) > F.array_position(names, F.col("b"))
    )


def correlation_by_era(
    df: DataFrame,
    columns: Sequence[str],
    day: str,
    cut: str = ERA_CUT,
    labels: Sequence[str] = ERA_LABELS,
    boundary: str = "both",
) -> DataFrame:
    """Correlation matrix of each era on a column subset."""
    rows = assign_era(df.select(day, *columns), day, cut, labels, boundary)
    return correlation_matrix(rows, columns, ["era"])


def halves(columns: Sequence[str]) -> tuple[list[str], list[str]]:
    """A column list in two halves, the first the shorter one."""
    middle = len(columns) // 2
    return list(columns[:middle]), list(columns[middle:])
