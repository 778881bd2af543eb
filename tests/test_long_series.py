"""Piece-wise operators equal the plain windows, also for one hot series."""

import numpy as np
import pandas as pd
import pytest
from conftest import assert_close, frame

from dayloom.operators import long_series, quantiles
from dayloom.operators.profile import describe
from dayloom.operators.windows import Series
from pyspark.sql import functions as F

ORDER = ["ts", "id"]
S = Series(["series"], ORDER)


@pytest.fixture(scope="module")
def rows(spark):
    """One series holds most rows, many of them at the same instant."""
    rng = np.random.default_rng(2)
    n = 1500
    series = np.where(rng.random(n) < 0.8, "hot", np.where(rng.random(n) < 0.5, "mild", "rare"))
    second = np.where(rng.random(n) < 0.4, 1000, rng.integers(0, 5000, n))
    x = np.where(rng.random(n) < 0.5, rng.normal(size=n).round(1), np.nan)
    pdf = pd.DataFrame({"series": series, "second": second, "id": np.arange(n), "x": x})
    df = frame(spark, pdf, "series string, second bigint, id bigint, x double")
    return df.withColumn("ts", F.timestamp_seconds("second")).drop("second").repartition(6).cache()


def ordered(df, column):
    return df.select("series", "id", column).toPandas().sort_values(["series", "id"])[column]


def test_row_index(rows):
    got = long_series.row_index(rows, ["series"], ORDER, pieces=7)
    want = rows.withColumn("row_index", F.row_number().over(S.forward) - 1)
    assert_close(ordered(got, "row_index"), ordered(want, "row_index"))


@pytest.mark.parametrize(
    "method, plain",
    [
        ("forward", lambda: S.forward_fill("x")),
        ("backward", lambda: S.backward_fill("x")),
        ("interpolate", lambda: S.interpolate("x", "ts")),
        ("interpolate_both", lambda: S.interpolate("x", "ts", both=True)),
    ],
)
def test_fills(rows, method, plain):
    got = long_series.fill_long(rows, ["series"], ORDER, "x", method, "v", pieces=9)
    assert_close(ordered(got, "v"), ordered(rows.withColumn("v", plain()), "v"))


@pytest.mark.parametrize("block", [8, 50, 10_000])
def test_bounded_windows(rows, block):
    def step(s):
        return {"d": s.lag("x"), "m": s.rolling_mean("x", 7, 3), "sd": s.rolling_std("x", 5, 2)}

    got = long_series.bounded_windows(rows, ["series"], ORDER, 6, step, pieces=5, rows_per_block=block)
    want = rows.withColumns(step(S))
    for c in ("d", "m", "sd"):
        assert_close(ordered(got, c), ordered(want, c))
    assert got.count() == rows.count()


def test_several_operators_share_one_cut(spark, rows, monkeypatch):
    """Two fills, an index and windows in a row: written once, with the results of each alone."""
    written = []
    whole = long_series.range_pieces
    monkeypatch.setattr(long_series, "range_pieces", lambda *a, **k: written.append(1) or whole(*a, **k))
    pieces = long_series.cut(rows, ["series"], ORDER, 7).fill("x", "forward", "before").fill("x", "interpolate", "between")
    steps = [lambda s: {"d": s.diff("before")}, lambda s: {"m": s.rolling_mean("d", 5, 2)}]
    shared = pieces.index("at").windows(5, *steps, rows_per_block=64)
    got = shared.select("series", "id", "before", "between", "at", "d", "m").toPandas().sort_values(["series", "id"])
    assert len(written) == 1
    plan = shared._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "SinglePartition" not in plan
    alone = {
        "before": ordered(long_series.fill_long(rows, ["series"], ORDER, "x", "forward"), "x"),
        "between": ordered(long_series.fill_long(rows, ["series"], ORDER, "x", "interpolate"), "x"),
        "at": ordered(long_series.row_index(rows, ["series"], ORDER), "row_index"),
    }
    for name, want in alone.items():
        assert_close(got[name], want, 1e-12)
    filled = long_series.fill_long(rows, ["series"], ORDER, "x", "forward", "before")
    assert_close(got["m"], ordered(long_series.bounded_windows(filled, ["series"], ORDER, 5, *steps, rows_per_block=64), "m"), 1e-9)
    assert len(written) == 6


def test_halo_must_fit(rows):
    with pytest.raises(ValueError, match="at least as long"):
        long_series.blocks_with_halo(rows, "id", 10, 5)


def test_quantiles_with_a_hot_value(spark):
    rng = np.random.default_rng(4)
    x = np.where(rng.random(999) < 0.4, 0.0, rng.normal(size=999).round(2))
    pdf = pd.DataFrame({"g": np.where(rng.random(999) < 0.9, "a", "b"), "x": x})
    pdf.loc[::17, "x"] = np.nan
    df = frame(spark, pdf, "g string, x double").repartition(5)
    got = describe(df, ["x"], ["g"], grain="any").toPandas().set_index("g").sort_index()
    want = pdf.groupby("g")["x"].describe()
    for ours, theirs in (("count", "count"), ("mean", "mean"), ("std", "std"), ("min", "min"), ("p25", "25%"), ("p50", "50%"), ("p75", "75%"), ("max", "max")):
        assert_close(got[ours], want[theirs])
    plain = describe(df, ["x"], ["g"], "day").toPandas().set_index("g").sort_index()
    assert_close(plain[["p25", "p50", "p75"]], got[["p25", "p50", "p75"]])


def test_single_value_and_empty_groups(spark):
    df = spark.createDataFrame([("a", 5.0), ("b", None)], "g string, x double")
    got = {r["g"]: r for r in describe(df, ["x"], ["g"], grain="any").collect()}
    assert (got["a"]["p25"], got["a"]["p75"], got["a"]["std"]) == (5.0, 5.0, None)
    assert (got["b"]["count"], got["b"]["p50"]) == (0, None)


def described(df, columns, keys, grain):
    rows = describe(df, columns, keys, grain=grain).collect()
    return {tuple(r[k] for k in (*keys, "feature")): r for r in rows}


def test_refined_histograms_equal_pandas(spark):
    """Ties, both signs, tiny and huge values, a hot value, close values far from zero, NULLs and NULL keys."""
    rng = np.random.default_rng(8)
    n = 4000
    pdf = pd.DataFrame({
        "g": rng.choice(["a", "b", None], n),
        "ties": rng.integers(-3, 4, n).astype(float),
        "wide": rng.normal(size=n) * 10.0 ** rng.integers(-200, 200, n),
        "close": 1e9 + rng.random(n),
        "hot": np.where(rng.random(n) < 0.6, 7.25, rng.normal(size=n)),
    })
    pdf.loc[rng.random(n) < 0.2, "close"] = np.nan
    names = ["ties", "wide", "close", "hot"]
    df = spark.createDataFrame([tuple(None if v != v else v for v in r) for r in pdf.itertuples(index=False)], "g string, ties double, wide double, close double, hot double").repartition(5)
    got = described(df, names, ["g"], "any")
    assert len(got) == 12
    for key, part in pdf.groupby("g", dropna=False):
        for name in names:
            want, r = part[name].describe(), got[None if key != key else key, name]
            for ours, theirs in zip(("count", "min", "p25", "p50", "p75", "max"), ("count", "min", "25%", "50%", "75%", "max")):
                assert r[ours] == pytest.approx(want[theirs], rel=1e-14), (key, name, ours)
            if name != "wide":
                assert r["mean"] == pytest.approx(want["mean"], rel=1e-9) and r["std"] == pytest.approx(want["std"], rel=1e-6)


@pytest.mark.parametrize("cuts, per_doubling", [(1, 1), (7, 2)])
def test_coarse_histograms_are_exact_too(spark, monkeypatch, cuts, per_doubling):
    monkeypatch.setattr(quantiles, "CUTS", cuts)
    monkeypatch.setattr(quantiles, "PER_DOUBLING", per_doubling)
    df = spark.range(0, 997, 1, 6).select((F.col("id") % 311 - 100.5).alias("x"), (F.col("id") % 2).alias("g"))
    fine, ranks = described(df, ["x"], ["g"], "any"), described(df, ["x"], ["g"], "ranks")
    for key, r in fine.items():
        assert [r[c] for c in ("count", "min", "p25", "p50", "p75", "max")] == [ranks[key][c] for c in ("count", "min", "p25", "p50", "p75", "max")]


def test_infinite_and_missing_numbers(spark):
    inf, nan = float("inf"), float("nan")
    df = spark.createDataFrame([(-inf,), (-inf,), (-inf,), (-0.0,), (0.0,), (5e-324,), (inf,), (None,)], "x double")
    (r,) = describe(df, ["x"], grain="any").collect()
    assert (r["count"], r["min"], r["p25"], r["p50"], r["max"]) == (7, -inf, -inf, 0.0, inf)
    (r,) = describe(spark.createDataFrame([(1.0,), (nan,), (nan,)], "x double"), ["x"], grain="any").collect()
    assert r["min"] == 1.0 and np.isnan(r["p50"]) and np.isnan(r["max"])
    assert describe(df.where("false"), ["x"], grain="any").count() == 0


def test_refinement_sends_counts_and_runs_no_job(spark):
    """While the plan is built nothing runs; exchanges hold aggregated rows only."""
    df, context = spark.range(1000).select((F.col("id") * 0.5).alias("x"), (F.col("id") % 3).alias("g")), spark.sparkContext
    context.setJobGroup("describe", "")
    out = describe(df, ["x"], ["g"], grain="any")
    context.setJobGroup("other", "")
    assert list(context.statusTracker().getJobIdsForGroup("describe")) == []
    plan = out._jdf.queryExecution().executedPlan().toString().split("\n")
    for at, line in enumerate(plan):
        if "Exchange hash" in line:
            assert any("HashAggregate" in below or "Window" in below for below in plan[at + 1 : at + 4]), plan[at : at + 4]


def test_too_many_groups_are_refused(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "BROADCAST_ROWS", 20)
    df = spark.range(3000).select(F.rand(1).alias("x"), (F.col("id") % 50).alias("g"))
    with pytest.raises(Exception, match="grain='ranks'"):
        describe(df, ["x"], ["g"], grain="any").collect()
    assert describe(df, ["x"], ["g"], grain="ranks").count() == 50


def test_no_single_partition_and_no_key_only_window(rows):
    pieces = long_series.range_pieces(rows, ["series"], ORDER, 4)
    plan = long_series.indexed(pieces, ["series"])._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan


def test_workers_do_not_need_the_package():
    """A function sent to a worker loads where the package cannot be imported."""
    import subprocess
    import sys

    from dayloom.operators.unit_root import _design
    from pyspark import cloudpickle

    code = (
        "import sys, pickle, numpy as np; f = pickle.loads(bytes.fromhex(sys.stdin.read())); "
        "assert 'dayloom' not in sys.modules; print(f(np.arange(5.0).reshape(-1, 1), 0)[0].shape)"
    )
    done = subprocess.run(
        [sys.executable, "-c", code], input=cloudpickle.dumps(_design(2)).hex(), text=True, capture_output=True, cwd="/"
    )
    assert done.stdout.strip() == "(4, 5)", done.stderr
