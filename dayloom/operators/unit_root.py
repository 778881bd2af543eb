"""Augmented Dickey-Fuller test with a constant and AIC lag choice."""

from __future__ import annotations

from collections.abc import Sequence
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from dayloom.functions.distributions import with_mackinnon_pvalue
from dayloom.functions.scalar import nonfinite_to_null, round_even, significance_label
from dayloom.operators.clean import numeric_columns, order_by
from dayloom.operators.lagged import LagLimit, lagged_products, past, unpack, with_predecessors
from dayloom.operators.least_squares import Residuals
from dayloom.operators.profile import melt

MIN_ROWS = 20
INSUFFICIENT = "insufficient data"
CONSTANT = "error: constant series"
STATIONARY = "stationary"
NOT_STATIONARY = "not stationary"


def max_lag(n) -> np.ndarray:
    """Longest lag tried for n rows."""
    n = np.asarray(n)
    return np.clip(np.ceil(12.0 * (n / 100.0) ** 0.25), 0, np.maximum(n // 2 - 2, 0)).astype(int)


def _design(lags: int):
    """Columns: 1, lagged differences, lagged level, difference."""

    def rows(values: np.ndarray, halo: int) -> tuple[np.ndarray, int]:
        x = values[:, 0]
        step = np.diff(x)
        table = np.column_stack([np.ones(len(step)), past(step, lags), x[:-1], step])
        # The first row of a series has no difference; in later blocks the halo
        # holds one row more than the lags.
        return (table[halo - 1 :], lags) if halo else (table, 0)

    return rows


def _solve(n: np.ndarray, body: np.ndarray, heads: np.ndarray, lags: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(statistic, lag, rows used) for a stack of series."""
    level, target = lags + 1, lags + 2
    longest = np.minimum(max_lag(n), lags)
    system = Residuals(with_predecessors(body, heads, longest))
    system.remove(0)
    rows = (n - 1 - longest).astype(float)
    best, chosen = np.full(len(n), np.inf), np.zeros(len(n), dtype=int)
    for p in range(lags + 1):
        if p:
            system.remove(p, only=p <= longest)
        fit = Residuals(system.cross[:, [[level], [target]], [level, target]])
        fit.start[:, 0] = system.start[:, level]
        fit.remove(0)
        with np.errstate(divide="ignore", invalid="ignore"):
            aic = rows * np.log(fit.left(1) / rows) + 2.0 * (system.rank + fit.rank)
        better = (p <= longest) & (aic < best)
        best, chosen = np.where(better, aic, best), np.where(better, p, chosen)

    system = Residuals(with_predecessors(body, heads, chosen))
    system.remove(0)
    for p in range(1, lags + 1):
        system.remove(p, only=p <= chosen)
    xx, xy = system.cross[:, level, level], system.cross[:, level, target]
    system.remove(level)
    used = n - 1 - chosen
    with np.errstate(divide="ignore", invalid="ignore"):
        variance = system.left(target) / (used - system.rank)
        statistic = (xy / xx) / np.sqrt(variance / xx)
    return np.where(np.isfinite(statistic), statistic, np.nan), chosen, used


def _solve_udf():
    @F.pandas_udf("statistic double, used_lag int, n_obs long")
    def solve(n: pd.Series, lags: pd.Series, body: pd.Series, heads: pd.Series) -> pd.DataFrame:
        """Series of the same lag limit are solved together."""
        statistic = np.full(len(n), np.nan)
        used_lag, n_obs = np.zeros(len(n), "int32"), np.zeros(len(n), "int64")
        rows, limits = n.to_numpy(), lags.to_numpy()
        for one in np.unique(limits).tolist():
            at = np.flatnonzero(limits == one)
            matrices = unpack(body.iloc[at], heads.iloc[at], one + 3, one)
            statistic[at], used_lag[at], n_obs[at] = _solve(rows[at], *matrices, one)
        out = pd.DataFrame({"statistic": statistic, "used_lag": used_lag, "n_obs": n_obs})
        return out.assign(statistic=out["statistic"].astype(object).where(out["statistic"].notna(), None))

    return solve


# The longest lag tried, from the number of rows of a series.
LIMIT = LagLimit(
    lambda n: max(1, ceil(12.0 * (max(n, MIN_ROWS) / 100.0) ** 0.25)),
    lambda n: F.ceil(F.pow(F.greatest(n, F.lit(MIN_ROWS)) / 100.0, F.lit(0.25)) * 12.0).cast("int"),
)


def adf_test(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    long: bool | None = None,
) -> DataFrame:
    """Unit-root statistic of each series: (keys, n, statistic, p_value,
    used_lag, n_obs, problem).

    The longest lag tried follows from the rows of each series.
    """
    rows = df.select(*keys, *order, nonfinite_to_null(F.col(value).cast("double")).alias(value)).dropna(subset=[value])
    # The difference of the first row of a block needs a row before the lags.
    products = lagged_products(rows, keys, order, [value], _design, LIMIT, 1, long)
    problem = F.when(F.col("n") < MIN_ROWS, INSUFFICIENT).when(F.col("low") == F.col("high"), CONSTANT)
    judged = products.withColumn("problem", problem).withColumn("_s", _solve_udf()("n", "lags", "body", "heads"))
    sound = F.col("problem").isNull()
    return with_mackinnon_pvalue(
        judged.select(
            *keys,
            "n",
            *[F.when(sound, F.col(f"_s.{c}")).alias(c) for c in ("statistic", "used_lag", "n_obs")],
            "problem",
        ),
        "statistic",
    )


def adf_report(
    df: DataFrame,
    order: Sequence[str],
    columns: Sequence[str] | None = None,
    keys: Sequence[str] = (),
    level: float = 0.05,
) -> DataFrame:
    """`adf_test` of every numeric column: (keys, variable, statistic, p_value,
    verdict), sorted by p-value with the untested columns last."""
    names = list(columns if columns is not None else [c for c in numeric_columns(df) if c not in {*keys, *order}])
    tall = melt(df, [*keys, *order], names, "variable", "value")
    tests = adf_test(tall, [*keys, "variable"], order, "value")
    every = F.explode(F.array(*[F.lit(c) for c in names])).alias("variable")
    panel = df.select(*keys).distinct() if keys else df.sparkSession.range(1)
    verdict = F.coalesce("problem", significance_label("p_value", STATIONARY, NOT_STATIONARY, level), F.lit(INSUFFICIENT))
    report = panel.select(*keys, every).join(tests, [*keys, "variable"], "left")
    return order_by(
        report.select(
            *keys,
            "variable",
            round_even("statistic", 4).alias("statistic"),
            round_even("p_value", 6).alias("p_value"),
            verdict.alias("verdict"),
        ),
        *keys,
        "p_value",
        "variable",
    )
