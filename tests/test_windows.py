"""Window operators against pandas on gappy random walks."""

import numpy as np
import pandas as pd
import pytest
from conftest import assert_close, frame, gappy_panel

from dayloom.operators.windows import Series, vigor_raw
from pyspark.sql import functions as F

S = Series(["series"], ["day"])
SCHEMA = "series string, day date, x double, y double"


def by_day(frame_, column, fn):
    """fn on each series in day order, as one array ordered by (series, day)."""
    return np.concatenate([fn(g.set_index(pd.to_datetime(g["day"]))[column]).to_numpy() for _, g in frame_.groupby("series")])


CASES = {
    "lag": (lambda: S.lag("x", 2), lambda v: v.shift(2)),
    "diff": (lambda: S.diff("x"), lambda v: v.diff()),
    "log_return": (lambda: S.log_return("x"), lambda v: np.log(v).diff()),
    "log_return_ratio": (lambda: S.log_return_ratio("x"), lambda v: np.log(v / v.shift(1))),
    "log_return_shifted": (lambda: S.log_return_shifted("x"), lambda v: np.log(v + 1).diff()),
    "forward_fill": (lambda: S.forward_fill("x"), lambda v: v.ffill()),
    "backward_fill": (lambda: S.backward_fill("x"), lambda v: v.bfill()),
    "interpolate": (lambda: S.interpolate("x", "day"), lambda v: v.interpolate(method="time")),
    "interpolate_both": (
        lambda: S.interpolate("x", "day", both=True),
        lambda v: v.interpolate(method="time", limit_direction="both"),
    ),
    "rolling_mean": (lambda: S.rolling_mean("x", 5), lambda v: v.rolling(5).mean()),
    "rolling_mean_min_periods": (lambda: S.rolling_mean("x", 30, 5), lambda v: v.rolling(30, min_periods=5).mean()),
    "rolling_std": (lambda: S.rolling_std("x", 4), lambda v: v.rolling(4).std()),
    "rolling_zscore": (
        lambda: S.rolling_zscore("x", 30, 8),
        lambda v: (v - v.rolling(30, min_periods=8).mean()) / (v.rolling(30, min_periods=8).std() + 1e-9),
    ),
    "rolling_zscore_no_eps": (
        lambda: S.rolling_zscore("x", 4, eps=None),
        lambda v: (v - v.rolling(4).mean()) / v.rolling(4).std(),
    ),
    "annualised_volatility": (lambda: S.annualised_volatility("x", 3), lambda v: v.rolling(3).std() * np.sqrt(365)),
}


@pytest.fixture(scope="module")
def computed(spark):
    panel = gappy_panel()
    df = frame(spark, panel.sample(frac=1, random_state=3), SCHEMA).repartition(5)
    out = df.select("series", "day", *[make().alias(name) for name, (make, _) in CASES.items()])
    return panel, out.toPandas().sort_values(["series", "day"])


@pytest.mark.parametrize("name", CASES)
def test_against_pandas(computed, name):
    panel, out = computed
    assert_close(out[name], by_day(panel, "x", CASES[name][1]))


def test_rolling_corr(spark):
    panel = gappy_panel()
    out = frame(spark, panel, SCHEMA).select("series", "day", S.rolling_corr("x", "y", 5).alias("r")).toPandas()
    want = np.concatenate([g["x"].rolling(5).corr(g["y"]).to_numpy() for _, g in panel.groupby("series")])
    assert_close(out.sort_values(["series", "day"])["r"], want, 1e-7)


def one_series(spark, values, start="2020-01-01"):
    days = pd.date_range(start, periods=len(values)).date
    return frame(spark, pd.DataFrame({"series": "a", "day": days, "x": values, "y": values}), SCHEMA)


def column(df, expr):
    return [r[0] for r in df.select("day", expr.alias("v")).orderBy("day").select("v").collect()]


N = float("nan")


def test_gap_is_null_on_both_sides(spark):
    df = one_series(spark, [1.0, N, N, 4.0])
    assert column(df, S.diff("x")) == [None] * 4
    assert column(df, S.forward_fill("x")) == [1.0, 1.0, 1.0, 4.0]
    assert column(df, S.interpolate("x", "day")) == pytest.approx([1.0, 2.0, 3.0, 4.0])


def test_interpolation_ends(spark):
    df = one_series(spark, [N, 1.0, N, 3.0, N])
    assert column(df, S.interpolate("x", "day")) == [None, 1.0, 2.0, 3.0, 3.0]
    assert column(df, S.interpolate("x", "day", both=True)) == [1.0, 1.0, 2.0, 3.0, 3.0]


def test_zero_and_negative_under_log_are_null(spark):
    assert column(one_series(spark, [1.0, 0.0, 2.0]), S.log_return("x")) == [None] * 3
    assert column(one_series(spark, [1.0, -1.0, 2.0]), S.log_return_shifted("x")) == [None] * 3


def test_rolling_needs_enough_values(spark):
    values = [float(v) for v in range(30)]
    values[7] = N
    df = one_series(spark, values)
    assert column(df, S.rolling_mean("x", 30))[-1] is None
    assert column(df, S.rolling_mean("x", 30, 29))[-1] is not None


def test_constant_window_does_not_raise(spark):
    df = one_series(spark, [2.0] * 6).withColumn("y", F.rand(1))
    assert column(df, S.rolling_corr("x", "y", 3)) == [None] * 6
    assert column(df, S.rolling_zscore("x", 3, eps=None)) == [None] * 6


def test_rolling_one_is_identity_and_fill_is_idempotent(spark):
    df = one_series(spark, [3.0, N, 5.0, 6.5])
    assert column(df, S.rolling_mean("x", 1)) == [3.0, None, 5.0, 6.5]
    once = df.withColumn("x", S.forward_fill("x"))
    assert column(once, S.forward_fill("x")) == column(once, F.col("x"))


def test_vigor(spark):
    df = spark.createDataFrame([(1.0, 4.0, 0.0, 3.0)], "o double, h double, l double, c double")
    assert df.select(vigor_raw("o", "h", "l", "c")).first()[0] == pytest.approx(2.0 / (4.0 + 1e-9))


def test_one_exchange_serves_all_window_steps(spark):
    df = frame(spark, gappy_panel(), SCHEMA)
    steps = df.withColumn("f", S.forward_fill("x")).withColumn("r", S.log_return("f")).withColumn("m", S.rolling_mean("r", 7))
    plan = steps._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "SinglePartition" not in plan
