"""Regression tests against NumPy least squares, an independent code path."""

import math

import numpy as np
import pandas as pd
import pytest
from conftest import assert_close, frame

from dayloom.functions import distributions
from dayloom.operators import comoments, correlation, granger, regression, unit_root
from dayloom.operators.calendar import assign_era
from dayloom.operators.profile import melt
from pyspark.sql import functions as F


def lstsq(y, x):
    design = np.column_stack([np.ones(len(y)), x])
    beta, *_ = np.linalg.lstsq(design, y, rcond=None)
    residual = y - design @ beta
    return beta, float(residual @ residual), design


@pytest.fixture(scope="module")
def wide():
    rng = np.random.default_rng(11)
    n = 500
    x = rng.normal(size=(n, 4)) * [1, 5, 0.1, 300] + [0, 1000, -3, 1e6]
    x[:, 1] += 2 * x[:, 0]
    y = x @ [0.5, -0.2, 3.0, 0.001] + rng.normal(size=n)
    y[260:] += 0.8 * x[260:, 0]
    pdf = pd.DataFrame(x, columns=list("abcd")).assign(y=y, day=pd.date_range("2019-06-01", periods=n).date)
    for c, share in zip("abc", (0.1, 0.05, 0.2)):
        pdf.loc[rng.random(n) < share, c] = np.nan
    return pdf[["day", "a", "b", "c", "d", "y"]]


SCHEMA = "day date, a double, b double, c double, d double, y double"


@pytest.fixture(scope="module")
def wide_df(spark, wide):
    return frame(spark, wide, SCHEMA).repartition(7).cache()


def test_correlation_deletes_pairwise(wide, wide_df):
    names = ["a", "b", "c", "d", "y"]
    got = correlation.correlation_matrix(wide_df, names).toPandas().pivot(index="a", columns="b", values="r")
    assert_close(got.loc[names, names], wide[names].corr(), 1e-9)
    half = correlation.lower_triangle(correlation.correlation_matrix(wide_df, names), names)
    assert half.count() == 10


def test_correlation_worked_example(spark):
    df = spark.createDataFrame([(1.0, 1.0, 3.0), (2.0, None, 1.0), (3.0, 2.0, 2.0), (None, 5.0, 4.0)], "a double, b double, c double")
    got = {(r["a"], r["b"]): (r["r"], r["n"]) for r in correlation.correlation_matrix(df, ["a", "b", "c"]).collect()}
    assert got["a", "b"] == (pytest.approx(1.0), 2)
    assert got["a", "c"] == (pytest.approx(-0.5), 3)
    assert got["b", "c"][0] == pytest.approx(0.7206, abs=5e-5)
    assert got["c", "b"] == got["b", "c"] and got["a", "a"] == (1.0, 3)


def test_correlation_is_null_without_variation(spark):
    df = spark.createDataFrame([(0.1, 1.0, None), (0.1, 2.0, 1.0), (0.1, 4.0, None)], "k double, x double, lone double")
    got = {(r["a"], r["b"]): r["r"] for r in correlation.correlation_matrix(df, ["k", "x", "lone"]).collect()}
    assert got["k", "x"] is None and got["k", "k"] is None and got["x", "lone"] is None and got["x", "x"] == 1.0


def test_comoments_do_not_depend_on_partitions(wide_df):
    names = ["a", "b", "c", "d"]
    one = comoments.comoments(wide_df.coalesce(1), names).orderBy("i", "j").toPandas()
    many = comoments.comoments(wide_df.repartition(40), names).orderBy("i", "j").toPandas()
    assert_close(one, many, 1e-8)


def test_comoments_merge_as_a_tree(wide_df):
    """Between the merge by parts and the last one there is an exchange; nothing is coalesced into one task."""
    plan = comoments.comoments(wide_df, ["a", "b"])._jdf.queryExecution().sparkPlan().toString()
    steps = [line.strip(" +-:*") for line in plan.splitlines()]
    kinds = [next((k for k in ("MapInPandas unpack", "MapInPandas combine", "Exchange", "Coalesce") if line.startswith(k)), "") for line in steps]
    kinds = [k for k in kinds if k]
    assert kinds[:4] == ["MapInPandas unpack", "Exchange", "MapInPandas combine", "Exchange"] and "Coalesce" not in kinds


@pytest.mark.parametrize("parts", [1, 2, 1024])
def test_comoments_do_not_depend_on_parts(spark, monkeypatch, parts):
    monkeypatch.setattr(comoments, "_PARTS", parts)
    rows = spark.range(0, 3000, 1, 24).select((F.col("id") * 1.5).alias("a"), (1e6 - F.col("id") % 7).alias("b"))
    got = {(r.i, r.j): r for r in comoments.comoments(rows, ["a", "b"]).collect()}
    a, b = np.arange(3000) * 1.5, 1e6 - np.arange(3000) % 7
    assert len(got) == 3 and got[0, 1].n == 3000
    assert got[0, 1].cp == pytest.approx(((a - a.mean()) * (b - b.mean())).sum(), rel=1e-7)
    assert got[1, 1].ss_i == pytest.approx(((b - b.mean()) ** 2).sum(), rel=1e-9)


def test_correlation_by_era(wide, wide_df):
    got = correlation.correlation_by_era(wide_df, ["a", "d"], "day").toPandas()
    cut = pd.Timestamp("2020-03-11").date()
    for era, part in (("retail", wide[wide.day <= cut]), ("institutional", wide[wide.day >= cut])):
        r = got[(got.era == era) & (got.a == "a") & (got.b == "d")]["r"].iloc[0]
        assert r == pytest.approx(part["a"].corr(part["d"]), abs=1e-9)


def test_ols_ssr(wide, wide_df):
    got = regression.ols_ssr(wide_df, "y", ["a", "b", "c", "d"]).first()
    whole = wide.dropna()
    _, ssr, _ = lstsq(whole["y"].to_numpy(), whole[list("abcd")].to_numpy())
    assert (got["n"], got["rank"]) == (len(whole), 5)
    assert got["ssr"] == pytest.approx(ssr, rel=1e-8)


def test_ols_drops_a_redundant_column(wide_df):
    twice = wide_df.withColumn("a2", F.col("a") * 3 + 1)
    one, two = regression.ols_ssr(wide_df, "y", ["a", "b"]).first(), regression.ols_ssr(twice, "y", ["a", "a2", "b"]).first()
    assert two["rank"] == one["rank"] == 3
    assert two["ssr"] == pytest.approx(one["ssr"], rel=1e-8)


def test_a_constant_regressor_changes_nothing(wide_df):
    flat = wide_df.withColumn("k", F.lit(0.1))
    one, two = regression.ols_ssr(wide_df, "y", ["a", "b"]).first(), regression.ols_ssr(flat, "y", ["a", "k", "b"]).first()
    assert two["rank"] == one["rank"] and two["ssr"] == pytest.approx(one["ssr"], rel=1e-10)


def chow_by_hand(part1, part2, names):
    ssr = lambda p: lstsq(p["y"].to_numpy(), p[names].to_numpy())[1]
    k, split = len(names) + 1, ssr(part1) + ssr(part2)
    d2 = len(part1) + len(part2) - 2 * k
    return ((ssr(pd.concat([part1, part2])) - split) / k) / (split / d2), k, d2


def test_chow_and_rotation(wide, wide_df):
    cut = pd.Timestamp("2020-03-11").date()
    got = {r["model"]: r for r in regression.chow_rotation(wide_df, "y", ["d"], ["a", "b"], "day").collect()}
    for model in ("a", "b"):
        whole = wide.dropna(subset=["y", "d", model])
        f, k, d2 = chow_by_hand(whole[whole.day < cut], whole[whole.day >= cut], ["d", model])
        assert got[model]["f_stat"] == pytest.approx(f, rel=1e-7)
        assert (got[model]["df1"], got[model]["df2"]) == (k, d2)
    assert got["a"]["conclusion"] == "structural break"


def test_rotation_equals_one_test_for_each_candidate(wide_df):
    """Also with a candidate that is never there, one that is NaN in places, and several series."""
    keyed = wide_df.withColumn("k", F.when(F.dayofmonth("day") % 2 == 0, "even").otherwise("odd")).withColumns(
        {"none": F.lit(None).cast("double"), "nan": F.when(F.col("b") > 1005, float("nan")).otherwise(F.col("b"))}
    )
    many = regression.chow_rotation(keyed, "y", ["d"], ["a", "b", "c", "none", "nan"], "day", keys=["k"]).collect()
    assert sorted((r.k, r.model) for r in many) == [(k, m) for k in ("even", "odd") for m in ("a", "b", "c", "nan")]
    for r in many:
        alone = regression.chow_by_day(keyed, "y", ["d", r.model], "day", keys=["k"]).where(F.col("k") == r.k).first()
        assert (r.n_1, r.n_2) == (alone.n_1, alone.n_2)
        assert r.f_stat == pytest.approx(alone.f_stat, rel=1e-7) and r.ssr_pooled == pytest.approx(alone.ssr_pooled, rel=1e-9)


def test_rotation_repeats_no_rows(wide_df):
    plan = regression.chow_rotation(wide_df, "y", ["d"], ["a", "b", "c"], "day")._jdf.queryExecution().sparkPlan().toString()
    below = plan[plan.index("reduce_batches"):]
    assert "Generate" not in below and plan.count("reduce_batches") == 1


def test_vif(wide, wide_df):
    got = {r["variable"]: r["vif"] for r in regression.vif(wide_df, ["a", "b", "c", "d"], digits=8).collect()}
    inverse = np.linalg.inv(wide[list("abcd")].dropna().corr().to_numpy())
    for i, c in enumerate("abcd"):
        assert got[c] == pytest.approx(inverse[i, i], rel=1e-6)
    rows = [r["vif"] for r in regression.vif(wide_df, ["a", "b", "c"]).collect()]
    assert rows == sorted(rows, reverse=True)


def test_vif_of_a_determined_column_is_null(wide_df):
    got = regression.vif(wide_df.withColumn("e", F.col("a") + F.col("b")), ["a", "b", "e", "d"])
    assert {r["variable"] for r in got.collect() if r["vif"] is None} == {"a", "b", "e"}


# Unit root


def adf_by_hand(x):
    n = len(x)
    longest = min(int(np.ceil(12 * (n / 100) ** 0.25)), n // 2 - 2)
    step = np.diff(x)

    def fit(p, first):
        t = np.arange(first, len(step))
        lags = [step[t - k] for k in range(1, p + 1)]
        design = np.column_stack([x[t], *lags, np.ones(len(t))])
        beta, *_ = np.linalg.lstsq(design, step[t], rcond=None)
        residual = step[t] - design @ beta
        return beta, float(residual @ residual), design

    aic = [len(d) * math.log(s / len(d)) + 2 * d.shape[1] for _, s, d in (fit(p, longest) for p in range(longest + 1))]
    p = int(np.argmin(aic))
    beta, ssr, design = fit(p, p)
    error = math.sqrt(ssr / (len(design) - design.shape[1]) * np.linalg.inv(design.T @ design)[0, 0])
    return beta[0] / error, p, len(design)


@pytest.fixture(scope="module")
def series():
    rng = np.random.default_rng(21)
    noise = rng.normal(size=700)
    ar = np.zeros(700)
    for t in range(3, 700):
        ar[t] = 0.5 * ar[t - 1] - 0.3 * ar[t - 3] + noise[t]
    return {
        "walk": 5000 + np.cumsum(noise),
        "noise": noise[:300],
        "ar": ar,
        "near": 100 + np.cumsum(noise[:90]) * 0.2 + ar[:90],
        "twenty": noise[:20],
    }


def tall_series(spark, series):
    rows = [(k, pd.Timestamp("2020-01-01") + pd.Timedelta(days=i), float(v)) for k, x in series.items() for i, v in enumerate(x)]
    pdf = pd.DataFrame(rows, columns=["series", "day", "x"])
    pdf["day"] = pdf["day"].dt.date
    return frame(spark, pdf.sample(frac=1, random_state=1), "series string, day date, x double")


@pytest.mark.parametrize("long", [False, True])
def test_adf(spark, series, long):
    df = tall_series(spark, series)
    got = {r["series"]: r for r in unit_root.adf_test(df, ["series"], ["day"], "x", long=long).collect()}
    for name, x in series.items():
        statistic, lag, n_obs = adf_by_hand(x)
        assert got[name]["statistic"] == pytest.approx(statistic, rel=1e-7), name
        assert (got[name]["used_lag"], got[name]["n_obs"], got[name]["n"]) == (lag, n_obs, len(x))


def test_adf_in_small_blocks(spark, series, monkeypatch):
    from dayloom.operators import lagged

    whole = lagged.lagged_products

    def in_blocks(*args, **kwargs):
        return whole(*args, **{**kwargs, "rows_per_block": 64})

    monkeypatch.setattr(unit_root, "lagged_products", in_blocks)
    df = tall_series(spark, series)
    got = {r["series"]: r["statistic"] for r in unit_root.adf_test(df, ["series"], ["day"], "x", long=True).collect()}
    for name, x in series.items():
        assert got[name] == pytest.approx(adf_by_hand(x)[0], rel=1e-7), name


def test_building_the_unit_root_test_runs_no_job(spark, series):
    """The lag limit of a series is found where its rows are."""
    df, context = tall_series(spark, series), spark.sparkContext
    context.setJobGroup("unit root", "")
    tests = unit_root.adf_test(df, ["series"], ["day"], "x")
    context.setJobGroup("other", "")
    assert list(context.statusTracker().getJobIdsForGroup("unit root")) == [] and tests.count() == len(series)


def test_series_of_other_lengths_change_nothing(spark, series):
    """Each series has lags and halo of its own, also next to a much longer one."""
    rng = np.random.default_rng(4)
    more = {**series, "long": np.cumsum(rng.normal(size=40_000))}
    seconds = [(k, i, float(v)) for k, x in more.items() for i, v in enumerate(x)]
    df = spark.createDataFrame(pd.DataFrame(seconds, columns=["series", "at", "x"]))
    got = {r["series"]: r for r in unit_root.adf_test(df, ["series"], ["at"], "x").collect()}
    for name, x in series.items():
        assert got[name]["statistic"] == pytest.approx(adf_by_hand(x)[0], rel=1e-6), name
    assert got["long"]["n_obs"] + got["long"]["used_lag"] + 1 == 40_000


def test_adf_report_rows(spark, series):
    n = 60
    pdf = pd.DataFrame({"day": pd.date_range("2020-01-01", periods=n).date, "noise": series["noise"][:n], "flat": 3.0, "short": np.nan, "never": np.nan})
    pdf.loc[:18, "short"] = series["noise"][:19]
    df = frame(spark, pdf, "day date, noise double, flat double, short double, never double")
    rows = unit_root.adf_report(df, ["day"]).collect()
    assert rows[0]["variable"] == "noise" and rows[0]["verdict"] == "stationary"
    verdicts = {r["variable"]: (r["statistic"], r["p_value"], r["verdict"]) for r in rows}
    assert verdicts["short"] == verdicts["never"] == (None, None, "insufficient data")
    assert verdicts["flat"] == (None, None, "error: constant series")


# Granger


def granger_by_hand(y, x, lag):
    t = np.arange(lag, len(y))
    own = np.column_stack([y[t - k] for k in range(1, lag + 1)])
    other = np.column_stack([x[t - k] for k in range(1, lag + 1)])
    restricted, full = lstsq(y[t], own)[1], lstsq(y[t], np.column_stack([own, other]))[1]
    return (restricted - full) / lag / (full / (len(t) - 2 * lag - 1))


@pytest.fixture(scope="module")
def pairs():
    rng = np.random.default_rng(31)
    n = 400
    x = rng.normal(size=(n, 2))
    y = rng.normal(size=n)
    y[2:] += 0.4 * x[:-2, 0]
    pdf = pd.DataFrame({"day": pd.date_range("2019-09-01", periods=n).date, "y": y, "lead": x[:, 0], "free": x[:, 1]})
    pdf.loc[rng.random(n) < 0.1, "free"] = np.nan
    pdf["flat"], pdf["late"], pdf["last"] = 1.0, np.nan, 2.0
    pdf.loc[n - 1, "last"] = 5.0  # its lags never see the change
    pdf.loc[n - 16 :, "late"] = y[n - 16 :]
    return pdf


PAIR_SCHEMA = "day date, y double, lead double, free double, flat double, late double, last double"


def test_two_rows_for_a_day_are_refused(spark, series):
    df = tall_series(spark, {"ar": series["ar"]})
    with pytest.raises(Exception, match="more than one row for a day"):
        unit_root.adf_test(df.unionByName(df.limit(1)), ["series"], ["day"], "x").collect()


@pytest.mark.parametrize("long", [False, True])
def test_granger(spark, pairs, long):
    df = frame(spark, pairs, PAIR_SCHEMA)
    names = ["lead", "free", "flat", "late", "last"]
    tests = granger.granger_tests_by_feature(df, "y", names, ["day"], long=long).cache()
    got = {(r["feature"], r["lag"]): r for r in tests.collect()}
    for name in ("lead", "free"):
        complete = pairs[["y", name]].dropna()
        for lag in range(1, 6):
            f = granger_by_hand(complete["y"].to_numpy(), complete[name].to_numpy(), lag)
            assert got[name, lag]["f_stat"] == pytest.approx(f, rel=1e-7)
            assert got[name, lag]["df2"] == len(complete) - 3 * lag - 1
    report = granger.granger_report(tests).collect()
    assert [r["feature"] for r in report][0] == "lead" and {r["feature"] for r in report} == {"lead", "free"}
    assert report[0]["lag_days"] == 2 and report[0]["significant"]
    skipped = {r["feature"]: r["reason"] for r in granger.granger_skipped(tests, names).collect()}
    assert skipped == {"flat": granger.CONSTANT, "last": granger.CONSTANT, "late": granger.INSUFFICIENT}


def test_granger_by_era_counts_the_cut_day_twice(spark, pairs):
    df = frame(spark, pairs, PAIR_SCHEMA)
    tests = granger.granger_tests_by_era(df, "y", ["lead"], "day")
    got = {r["era"]: r["n"] for r in tests.filter("lag = 1").collect()}
    assert sum(got.values()) == len(pairs) + 1


def test_best_lag_takes_the_lowest_on_a_tie(spark):
    df = spark.createDataFrame([("a", 2, 0.1), ("a", 4, 0.1), ("a", 1, 0.5), ("b", 1, 1.0), ("b", 2, None)], "k string, lag int, p_value double")
    got = {r["k"]: tuple(r["b"]) for r in df.groupBy("k").agg(granger.best_lag().alias("b")).collect()}
    assert got == {"a": (0.1, 2), "b": (1.0, 0)}


# Probabilities


def test_f_tail_at_published_points():
    # 5 % and 1 % points of printed F tables.
    points = [(161.448, 1, 1, 0.05), (3.0984, 3, 20, 0.05), (4.9646, 1, 10, 0.05), (2.2899, 5, 120, 0.05), (4.9382, 3, 20, 0.01)]
    f, d1, d2, p = (np.array(c, dtype=float) for c in zip(*points))
    assert np.allclose(distributions.f_upper_tail(f, d1, d2), p, atol=2e-5)


def test_f_tail_against_the_jvm(spark):
    new = spark._jvm.org.apache.commons.math3.distribution.FDistribution
    rng = np.random.default_rng(6)
    d1, d2, f = rng.integers(1, 30, 60), rng.integers(1, 4000, 60), rng.exponential(2, 60)
    want = [1 - new(float(a), float(b)).cumulativeProbability(float(x)) for a, b, x in zip(d1, d2, f)]
    assert np.allclose(distributions.f_upper_tail(f, d1, d2), want, atol=1e-9)


def test_f_tail_edges():
    got = distributions.f_upper_tail([0.0, -1.0, np.nan, 5.0, 1e9], [1, 1, 1, 0, 3], [5, 5, 5, 5, 50])
    assert list(got[:2]) == [1.0, 1.0] and np.isnan(got[2]) and np.isnan(got[3]) and got[4] < 1e-100


def test_unit_root_tail():
    got = distributions.unit_root_tail([-3.43, -2.86, -2.57, 3.0, -20.0, np.nan])
    assert np.allclose(got[:3], [0.0100, 0.0502, 0.0994], atol=1e-4)
    assert list(got[3:5]) == [1.0, 0.0] and np.isnan(got[5])


def test_pvalue_columns_give_null_not_nan(spark):
    df = spark.createDataFrame([(3.0984, 3, 20), (None, 3, 20)], "f double, a int, b int")
    got = [r["p_value"] for r in distributions.with_f_pvalue(df, "f", "a", "b").collect()]
    assert got[0] == pytest.approx(0.05, abs=1e-5) and got[1] is None


def test_series_are_invariant_to_row_order(spark, series):
    df = tall_series(spark, {"ar": series["ar"]})
    a = unit_root.adf_test(df.orderBy("x"), ["series"], ["day"], "x").first()
    b = unit_root.adf_test(df.repartition(13), ["series"], ["day"], "x").first()
    assert a["statistic"] == pytest.approx(b["statistic"], rel=1e-9)


def test_melt_and_eras(spark, wide_df):
    tall = melt(assign_era(wide_df, "day"), ["era", "day"], ["a", "b"])
    assert tall.columns == ["era", "day", "feature", "value"] and tall.count() == 2 * wide_df.count()
