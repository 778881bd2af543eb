"""Moments of rolling frames equal pandas, at a cost that does not depend on the frame."""

import time

import numpy as np
import pandas as pd
import pytest
from conftest import assert_close, frame

from dayloom.operators import rolling
from dayloom.operators.windows import Series

S = Series(["series"], ["at"])


def panel(n=500, seed=3):
    rng = np.random.default_rng(seed)
    parts = []
    for k, level in enumerate((0.0, 1e9, -5.0)):
        x = level + np.cumsum(rng.normal(size=n))
        x[rng.random(n) < 0.15] = np.nan
        x[40:60] = level + 0.1
        parts.append(pd.DataFrame({"series": f"s{k}", "at": np.arange(n), "x": x}))
    return pd.concat(parts, ignore_index=True)


@pytest.mark.parametrize("n, need", [(1, 1), (2, 2), (5, 3), (30, 30), (365, 30), (700, 2)])
def test_moments_equal_pandas(spark, n, need):
    pdf = panel()
    df = frame(spark, pdf.sample(frac=1, random_state=2), "series string, at bigint, x double").repartition(4)
    rows = rolling.rolling_moments(df, S, "x", n, "m").select("series", "at", "m.*").toPandas().sort_values(["series", "at"])
    by = pdf.groupby("series")["x"]
    frames = lambda how: by.rolling(n, min_periods=1).agg(how).reset_index(drop=True)
    assert_close(rows["n"], frames("count").fillna(0), 1e-12)
    assert_close(rows["mean"], frames("mean"), 1e-9)
    want = np.concatenate([[np.nanstd(x[max(0, i - n + 1) : i + 1], ddof=1) if np.sum(~np.isnan(x[max(0, i - n + 1) : i + 1])) > 1 else np.nan for i in range(len(x))] for x in (g.to_numpy() for _, g in by)])
    assert_close(rows["std"], want, 1e-6)


def test_a_constant_frame_has_no_deviation(spark):
    df = spark.createDataFrame([("a", i, 0.1 if i < 20 else float(i)) for i in range(40)], "series string, at bigint, x double")
    rows = rolling.rolling_zscores(df, S, "x", 7, "z").orderBy("at").collect()
    assert [r.z for r in rows[6:20]] == [0.0] * 14 and rows[5].z is None and rows[30].z > 0
    assert {r.z for r in rolling.rolling_zscores(df.where("at < 20"), S, "x", 7, "z", eps=None).collect()} == {None}


@pytest.mark.parametrize("eps", [None, 1e-9])
def test_scores_equal_the_expression(spark, eps):
    df = frame(spark, panel(), "series string, at bigint, x double")
    both = rolling.rolling_zscores(df, S, "x", 30, "a", 8, eps).withColumn("b", S.rolling_zscore("x", 30, 8, eps))
    pdf = both.toPandas()
    assert_close(pdf["a"], pdf["b"], 1e-5)


@pytest.mark.parametrize("block", [8, 64])
def test_long_series_in_blocks(spark, block):
    df = frame(spark, panel(), "series string, at bigint, x double").repartition(5)
    long = rolling.long_rolling_zscores(df, ["series"], ["at"], "x", 30, "z", 10, pieces=6, rows_per_block=block)
    plain = rolling.rolling_zscores(df, S, "x", 30, "z", 10)
    a, b = (d.select("series", "at", "z").toPandas().sort_values(["series", "at"])["z"] for d in (long, plain))
    assert len(a) == 1500
    assert_close(a, b, 1e-6)


def test_cost_does_not_depend_on_the_frame(spark):
    """A frame of 365 rows takes about as long as one of 30; the sliding frame takes several times as long."""
    df = spark.range(0, 400_000, 1, 4).selectExpr("cast(id % 20 as string) as series", "id as at", "rand(1) as x").cache()
    df.count()

    def seconds(n):
        taken = []
        for _ in range(3):
            began = time.perf_counter()
            rolling.rolling_zscores(df, S, "x", n, "z").write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - began)
        return min(taken)

    assert seconds(365) < 2 * seconds(30) + 0.5
    df.unpersist()
