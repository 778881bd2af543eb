"""Regression diagnostics from one co-moment pass over the rows.

Centred cross-products already account for the intercept, so every model needs
only a small solve per group, done for whole Arrow batches of groups at once.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from dayloom.functions.distributions import f_pvalue
from dayloom.functions.scalar import round_even, significance_label
from dayloom.operators.calendar import ERA_CUT, ERA_LABELS, era_label
from dayloom.operators.comoments import MOMENTS, PAIR, comoments, merge_comoments, scatter_matrices
from dayloom.operators.least_squares import Residuals, stacked

def _fit_udf(order: int):
    """SSR and rank of the last column on all others plus a constant."""

    @F.pandas_udf("ssr double, rank int")
    def fit(scatter: pd.Series) -> pd.DataFrame:
        system = Residuals(stacked(scatter, order))
        for column in range(order - 1):
            system.remove(column)
        return pd.DataFrame({"ssr": system.left(order - 1), "rank": (system.rank + 1).astype("int32")})

    return fit


def ols_ssr(df: DataFrame, y: str, x: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Rows used, rank and sum of squared residuals of y on a constant and x."""
    return _fitted(comoments(df, [*x, y], keys, complete_rows=True), keys, len(x) + 1)


def _fitted(moments: DataFrame, keys: Sequence[str], order: int) -> DataFrame:
    matrices = scatter_matrices(moments, keys, order)
    fitted = matrices.withColumn("_fit", _fit_udf(order)("scatter"))
    return fitted.select(
        *keys, F.col("n").cast("long").alias("n"), F.col("_fit.rank").alias("rank"), F.col("_fit.ssr").alias("ssr")
    )


def chow_test(
    df: DataFrame,
    y: str,
    x: Sequence[str],
    segment: str,
    labels: Sequence[str],
    keys: Sequence[str] = (),
) -> DataFrame:
    """F test that both segments share one regression of y on x.

    Rows whose `segment` is none of the two `labels` are left out. The pooled fit
    comes from the segments' co-moments, not from another pass; its rows have no
    segment.
    """
    rows = df.filter(F.col(segment).isin(list(labels)))
    return _compared(comoments(rows, [*x, y], [*keys, segment], complete_rows=True), segment, labels, keys, len(x) + 1)


def _compared(by_segment: DataFrame, segment: str, labels: Sequence[str], keys: Sequence[str], k: int) -> DataFrame:
    """The test from co-moments of [*x, y], of one row or more for each segment and pair; k = len(x) + 1."""
    group, order = [*keys, segment], k
    pooled = F.lit(None).cast(by_segment.schema[segment].dataType)
    both = by_segment.withColumn(segment, F.explode(F.array(F.col(segment), pooled)))
    fits = _fitted(merge_comoments(both, group), group, order)

    def of(label: str | None, column: str):
        return F.max(F.when(F.col(segment).eqNullSafe(F.lit(label)), F.col(column)))

    sums = fits.groupBy(*keys).agg(
        of(None, "ssr").alias("ssr_pooled"),
        of(labels[0], "ssr").alias("ssr_1"),
        of(labels[1], "ssr").alias("ssr_2"),
        of(labels[0], "n").alias("n_1"),
        of(labels[1], "n").alias("n_2"),
    )
    split = F.col("ssr_1") + F.col("ssr_2")
    d2 = F.col("n_1") + F.col("n_2") - 2 * k
    f = F.when(d2 > 0, F.try_divide((F.col("ssr_pooled") - split) / k, F.try_divide(split, d2)))
    tested = sums.withColumn("f_stat", f).withColumn("df1", F.lit(k)).withColumn("df2", d2.cast("long"))
    return tested.withColumn("p_value", f_pvalue(F.col("f_stat"), F.col("df1"), F.col("df2"))).withColumn(
        "conclusion", significance_label("p_value", "structural break", "no structural break")
    )


def chow_by_day(
    df: DataFrame,
    y: str,
    x: Sequence[str],
    day: str,
    cut: str = ERA_CUT,
    labels: Sequence[str] = ERA_LABELS,
    keys: Sequence[str] = (),
) -> DataFrame:
    """`chow_test` for a break at a day, which opens the second segment."""
    rows = df.withColumn("era", era_label(day, cut, labels))
    return chow_test(rows, y, x, "era", labels, keys)


def chow_rotation(
    df: DataFrame,
    y: str,
    controls: Sequence[str],
    candidates: Sequence[str],
    day: str,
    cut: str = ERA_CUT,
    labels: Sequence[str] = ERA_LABELS,
    keys: Sequence[str] = (),
) -> DataFrame:
    """One break test per collinear candidate added to the control set.

    All models share one pass: co-moments of all columns are taken for each
    pattern of missing candidates, and a model adds up those of the patterns in
    which its candidate is there. So each model deletes only the rows incomplete in
    its own columns, and no row is repeated, however many candidates there are.
    """
    segment, last = "era", len(controls) + len(candidates)
    missing = [F.col(c).isNull() | F.isnan(F.col(c).cast("double")) for c in candidates]
    pattern = F.concat(F.lit(""), *[F.when(m, "1").otherwise("0") for m in missing])
    filled = [F.when(m, 0.0).otherwise(F.col(c).cast("double")).alias(c) for m, c in zip(missing, candidates)]
    rows = df.dropna(how="any", subset=[y, *controls]).select(
        *keys, era_label(day, cut, labels).alias(segment), pattern.alias("_pattern"), *controls, *filled, y
    )
    moments = comoments(
        rows.filter(F.col(segment).isin(list(labels))), [*controls, *candidates, y], [*keys, segment, "_pattern"]
    )
    models = F.array(
        *[F.struct(F.lit(c).alias("model"), F.lit(at).alias("at")) for at, c in enumerate(candidates, len(controls))]
    )

    def in_model(m: Column) -> Column:
        there = F.col("_pattern").substr(m["at"] - len(controls) + 1, F.lit(1)) == "0"
        return reduce(and_, ((F.col(p) < len(controls)) | F.col(p).isin(m["at"], last) for p in PAIR), there)

    def place(p: str) -> Column:
        """Position in [*controls, candidate, y]."""
        return F.when(F.col(p) < len(controls), F.col(p)).when(F.col(p) == last, len(controls) + 1).otherwise(len(controls))

    by_model = moments.withColumn("_m", F.explode(F.filter(models, in_model))).select(
        *keys, segment, "_m.model", *[place(p).cast("int").alias(p) for p in PAIR], *MOMENTS
    )
    return _compared(by_model, segment, labels, [*keys, "model"], len(controls) + 2)


def _vif_udf(order: int):
    @F.pandas_udf("array<double>")
    def inflation(scatter: pd.Series) -> pd.Series:
        cross = stacked(scatter, order)
        factors = np.full((len(cross), order), np.nan)
        for target in range(order):
            system = Residuals(cross)
            for column in range(order):
                if column != target:
                    system.remove(column)
            free = ~system.explained(target)
            factors[free, target] = system.start[free, target] / system.left(target)[free]
        return pd.Series([[None if np.isnan(v) else float(v) for v in row] for row in factors])

    return inflation


def vif(df: DataFrame, x: Sequence[str], keys: Sequence[str] = (), digits: int = 2) -> DataFrame:
    """Variance inflation factor of each column on the others and a constant.

    Complete rows only; NULL for a column the others determine. Sorted from the
    highest.
    """
    matrices = scatter_matrices(comoments(df, x, keys, complete_rows=True), keys, len(x))
    factors = matrices.withColumn("_f", _vif_udf(len(x))("scatter"))
    names = F.array(*[F.lit(c) for c in x])
    return (
        factors.select(*keys, F.posexplode("_f").alias("_at", "_vif"))
        .select(*keys, F.get(names, F.col("_at")).alias("variable"), round_even("_vif", digits).alias("vif"))
        .orderBy(*keys, F.col("vif").desc_nulls_last(), "variable")
    )
