"""Granger causality: do lags of one series help to predict another?"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from dayloom.functions.distributions import with_f_pvalue
from dayloom.functions.scalar import round_even, significance_label
from dayloom.operators.calendar import ERA_CUT, ERA_LABELS, assign_era
from dayloom.operators.clean import order_by
from dayloom.operators.lagged import fixed, lagged_products, past, unpack, with_predecessors
from dayloom.operators.least_squares import Residuals

CAUSES = "causality"
NO_CAUSALITY = "no causality"
INSUFFICIENT = "insufficient rows"
CONSTANT = "constant lag column"
PERFECT = "perfect fit"


def _design(lags: int):
    """Columns: 1, lags of y, lags of x, y."""

    def rows(values: np.ndarray, halo: int) -> tuple[np.ndarray, int]:
        y, x = values[:, 0], values[:, 1]
        table = np.column_stack([np.ones(len(y)), past(y, lags), past(x, lags), y])
        return (table[halo:], lags) if halo else (table, 0)

    return rows


def _solve(n: np.ndarray, lag: int, lags: int, body: np.ndarray, heads: np.ndarray):
    """F statistic, its second degrees of freedom and the problem, if any."""
    target = 2 * lags + 1
    system = Residuals(with_predecessors(body, heads, np.full(len(n), lag)))
    system.remove(0)
    own, other = range(1, lag + 1), range(lags + 1, lags + lag + 1)
    constant = np.any([system.explained(c) for c in (*own, *other)], axis=0)
    for c in own:
        system.remove(c)
    restricted = system.left(target)
    for c in other:
        system.remove(c)
    full = system.left(target)
    df2 = n - lag - system.rank
    short = n <= 3 * lags + 1
    perfect = full <= 1e-14 * system.start[:, target]
    with np.errstate(divide="ignore", invalid="ignore"):
        f = (restricted - full) / full / lag * df2
    problem = np.where(short, INSUFFICIENT, np.where(constant, CONSTANT, np.where(perfect, PERFECT, None)))
    return np.where(np.equal(problem, None), f, np.nan), df2, problem


def _solve_udf(lags: int):
    width = 2 * lags + 2

    @F.pandas_udf("f_stat double, df2 long, problem string")
    def solve(n: pd.Series, lag: pd.Series, body: pd.Series, heads: pd.Series) -> pd.DataFrame:
        body, heads = unpack(body, heads, width, lags)
        rows, tried = n.to_numpy(), lag.to_numpy()
        f, df2 = np.full(len(n), np.nan), np.zeros(len(n), dtype="int64")
        problem = np.full(len(n), None, dtype=object)
        for one in np.unique(tried):
            at = tried == one
            f[at], df2[at], problem[at] = _solve(rows[at], int(one), lags, body[at], heads[at])
        out = pd.DataFrame({"f_stat": f, "df2": df2, "problem": problem})
        return out.assign(f_stat=out["f_stat"].astype(object).where(out["f_stat"].notna(), None))

    return solve


def granger_test(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    y: str,
    x: str,
    max_lag: int = 5,
    long: bool | None = None,
) -> DataFrame:
    """SSR F test for every lag 1..max_lag: (keys, lag, n, f_stat, df1, df2,
    p_value, problem). Rows incomplete in (y, x) are deleted first."""
    products = lagged_products(df, keys, order, [y, x], _design, fixed(max_lag), long=long)
    tried = F.explode(F.sequence(F.lit(1), F.lit(max_lag)))
    solved = products.withColumn("lag", tried).withColumn("_s", _solve_udf(max_lag)("n", "lag", "body", "heads"))
    tests = solved.select(
        *keys,
        "lag",
        "n",
        F.col("_s.f_stat").alias("f_stat"),
        F.col("lag").alias("df1"),
        F.col("_s.df2").alias("df2"),
        F.col("_s.problem").alias("problem"),
    )
    return with_f_pvalue(tests, "f_stat", "df1", "df2")


def best_lag(p: str = "p_value", lag: str = "lag") -> Column:
    """Aggregate: struct(p, lag) of the smallest p below one, the lowest lag on
    a tie, and (1.0, 0) when no lag qualifies."""
    smallest = F.min(F.when(F.col(p) < 1.0, F.struct(F.col(p).alias("p"), F.col(lag).cast("int").alias("lag"))))
    return F.coalesce(smallest, F.struct(F.lit(1.0).alias("p"), F.lit(0).alias("lag")))


def pair_rows(df: DataFrame, ids: Sequence[str], target: str, features: Sequence[str]) -> DataFrame:
    """(ids, feature, y, x): the target next to each feature, complete rows only."""
    offers = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features])
    return (
        df.select(*ids, F.col(target).cast("double").alias("y"), F.explode(offers).alias("_o"))
        .select(*ids, "_o.feature", "y", "_o.x")
        .filter(F.col("y").isNotNull() & F.col("x").isNotNull())
    )


def granger_tests_by_feature(
    df: DataFrame,
    target: str,
    features: Sequence[str],
    order: Sequence[str],
    keys: Sequence[str] = (),
    max_lag: int = 5,
    long: bool | None = None,
) -> DataFrame:
    """`granger_test` of every feature against the target, in one job."""
    rows = pair_rows(df, [*keys, *order], target, features)
    return granger_test(rows, [*keys, "feature"], order, "y", "x", max_lag, long)


def granger_report(tests: DataFrame, keys: Sequence[str] = (), level: float = 0.05) -> DataFrame:
    """Best lag, p-value and verdict per feature, sorted by p-value. A feature
    with a problem at any lag is left out (see `granger_skipped`)."""
    best = (
        tests.groupBy(*keys, "feature")
        .agg(F.max("problem").alias("problem"), best_lag().alias("_b"))
        .filter(F.col("problem").isNull())
    )
    report = best.select(
        *keys,
        "feature",
        F.col("_b.lag").alias("lag_days"),
        round_even("_b.p", 5).alias("p_value"),
        significance_label("_b.p", CAUSES, NO_CAUSALITY, level).alias("conclusion"),
        (F.col("_b.p") < level).alias("significant"),
    )
    return order_by(report, *keys, "p_value", "feature")


def granger_skipped(
    tests: DataFrame, features: Sequence[str], keys: Sequence[str] = (), panel: DataFrame | None = None
) -> DataFrame:
    """Features the report leaves out, with the reason. `panel` holds the key
    values expected, so that features without any complete row are listed."""
    problems = tests.groupBy(*keys, "feature").agg(F.max("problem").alias("reason"), F.lit(1).alias("_seen"))
    groups = panel if panel is not None else (tests.select(*keys).distinct() if keys else tests.sparkSession.range(1))
    every = groups.select(*keys, F.explode(F.array(*[F.lit(f) for f in features])).alias("feature"))
    joined = every.join(problems, [*keys, "feature"], "left")
    return joined.filter(F.col("reason").isNotNull() | F.col("_seen").isNull()).select(
        *keys, "feature", F.coalesce("reason", F.lit(INSUFFICIENT)).alias("reason")
    )


def granger_tests_by_era(
    df: DataFrame,
    target: str,
    features: Sequence[str],
    day: str,
    cut: str = ERA_CUT,
    labels: Sequence[str] = ERA_LABELS,
    max_lag: int = 5,
    boundary: str = "both",
) -> DataFrame:
    """Tests of every feature in both eras; the cut day belongs to each."""
    rows = assign_era(df.select(day, target, *features), day, cut, labels, boundary)
    return granger_tests_by_feature(rows, target, features, [day], ["era"], max_lag)


def granger_by_era(
    df: DataFrame,
    target: str,
    features: Sequence[str],
    day: str,
    cut: str = ERA_CUT,
    labels: Sequence[str] = ERA_LABELS,
    max_lag: int = 5,
    boundary: str = "both",
) -> DataFrame:
    """`granger_report` for both eras."""
    return granger_report(granger_tests_by_era(df, target, features, day, cut, labels, max_lag, boundary), ["era"])
