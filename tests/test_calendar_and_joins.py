import datetime as dt

import numpy as np
import pandas as pd
import pytest
from conftest import assert_close, frame, gappy_panel

from dayloom.functions import scalar
from dayloom.operators import align, calendar, clean
from dayloom.operators.windows import Series
from dayloom.sources.readers import load_feature_table, parse_day
from pyspark.sql import functions as F

SCHEMA = "series string, day date, x double, y double"
D = dt.date


def panel(spark, rows):
    return spark.createDataFrame(rows, "series string, day date, x double")


def aligned_rows(spark, rows, start="2020-01-01", end="2020-01-05"):
    out = calendar.align_to_spine(panel(spark, rows), ["series"], "day", ["x"], start, end)
    return {(r[0], r[1].isoformat()[8:]): r[2] for r in out.collect()}


def test_spine(spark):
    spine = calendar.calendar_spine(spark)
    assert spine.count() == 3136
    assert spine.filter("is_weekend = 1").count() == 896
    assert dict(calendar.era_calendar(spark).groupBy("era").count().collect()) == {"retail": 1167, "institutional": 1970}


def test_align_keeps_every_day_and_loses_outside_rows(spark):
    got = aligned_rows(spark, [("a", D(2019, 12, 30), 9.0), ("a", D(2020, 1, 2), 2.0), ("a", D(2020, 1, 4), None), ("a", D(2020, 2, 1), 8.0)])
    assert got == {("a", "01"): None, ("a", "02"): 2.0, ("a", "03"): None, ("a", "04"): None, ("a", "05"): None}


@pytest.mark.parametrize("day", [D(2019, 5, 1), D(2021, 5, 1)])
def test_align_series_wholly_outside(spark, day):
    assert list(aligned_rows(spark, [("a", day, 1.0)]).values()) == [None] * 5


def test_align_refuses_duplicates(spark):
    with pytest.raises(Exception, match="more than one row"):
        aligned_rows(spark, [("a", D(2020, 1, 2), 1.0), ("a", D(2020, 1, 2), 2.0)])


def test_align_equals_a_join_with_the_spine(spark):
    rng = np.random.default_rng(5)
    source = gappy_panel(4, 200)
    source = source[rng.random(len(source)) < 0.6]
    got = calendar.align_to_spine(frame(spark, source, SCHEMA), ["series"], "day", ["x", "y"], "2019-12-20", "2020-05-31").toPandas()
    days = pd.date_range("2019-12-20", "2020-05-31").date
    want = pd.MultiIndex.from_product([sorted(source["series"].unique()), days], names=["series", "day"]).to_frame(index=False)
    want = want.merge(source, how="left", on=["series", "day"])
    got = got.sort_values(["series", "day"]).reset_index(drop=True)
    assert got[["series", "day"]].equals(want[["series", "day"]])
    assert_close(got["x"], want["x"])
    assert_close(got["y"], want["y"])


def test_align_then_windows_needs_one_exchange(spark):
    df = frame(spark, gappy_panel(), SCHEMA)
    out = calendar.align_to_spine(df, ["series"], "day", ["x"], "2020-01-01", "2020-12-31")
    out = out.withColumn("x", Series(["series"], ["day"]).forward_fill("x"))
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_resample_uses_own_ends(spark):
    rows = [("a", D(2020, 1, 1), 1.0), ("a", D(2020, 1, 4), 4.0), ("b", D(2020, 1, 2), 7.0)]
    out = calendar.resample_daily(panel(spark, rows), ["series"], "day", ["x"]).orderBy("series", "day").collect()
    assert [(r[0], r[1].day, r[2]) for r in out] == [("a", 1, 1.0), ("a", 2, None), ("a", 3, None), ("a", 4, 4.0), ("b", 2, 7.0)]


def test_boundary_day(spark):
    rows = panel(spark, [("a", D(2020, 3, d), 1.0) for d in (10, 11, 12)])
    count = lambda mode: dict(calendar.assign_era(rows, "day", boundary=mode).groupBy("era").count().collect())
    assert count("both") == {"retail": 2, "institutional": 2}
    assert count("second") == {"retail": 1, "institutional": 2}


def test_filter_stays_above_the_window(spark):
    rows = panel(spark, [("a", D(2020, 1, d), float(d)) for d in (1, 2, 3)])
    out = clean.filter_after(rows.withColumn("c", Series(["series"], ["day"]).diff("x")), "day", "2020-01-01")
    assert [r["c"] for r in out.orderBy("day").collect()] == [1.0, 1.0]


def test_day_encodings(spark):
    df = spark.createDataFrame(
        [(1483228800, "2017-01-03T23:30:00-05:00", "12/31/2016", "2017-01-05", "nonsense")],
        "e bigint, i string, l string, d string, bad string",
    )
    got = df.select(
        parse_day("e", "epoch"), parse_day("i", "iso"), parse_day("l", "local", "MM/dd/yyyy"), parse_day("d", "day"), parse_day("bad", "iso")
    ).first()
    assert tuple(got) == (D(2017, 1, 1), D(2017, 1, 4), D(2016, 12, 31), D(2017, 1, 5), None)


def test_rowwise_mean(spark):
    df = spark.createDataFrame([(1.0, 3.0), (None, 2.0), (None, None)], "a double, b double")
    assert [r[0] for r in df.select(scalar.rowwise_mean("a", "b")).collect()] == [2.0, 2.0, None]


def test_missing_value_rules(spark):
    df = spark.createDataFrame([(0.0,), (float("nan"),), (float("inf"),), (float("-inf"),), (2.0,)], "x double")
    assert [r[0] for r in df.select(scalar.nonfinite_to_null("x")).collect()] == [0.0, None, None, None, 2.0]
    assert df.select(scalar.zero_to_null("x")).first()[0] is None
    assert df.select(scalar.safe_ln("x")).first()[0] is None
    assert spark.range(1).select(scalar.pct_of_total(F.lit(1.0), F.lit(0.0))).first()[0] is None


def test_logs_of_nonpositive_numbers_are_null(spark):
    df = spark.createDataFrame([(0.0,), (-1.0,), (-2.0,)], "x double")
    assert [r[0] for r in df.select(scalar.safe_ln("x")).collect()] == [None] * 3
    assert [r[0] for r in df.select(scalar.log_count("x")).collect()] == [0.0, None, None]


def test_rounding_matches_numpy(spark):
    values = [0.125, 0.375, 2.675, 0.09125, -1.005, 1e6 + 0.005]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    got = [r[0] for r in df.select(scalar.round_even("x", 2)).collect()]
    assert got == list(np.round(values, 2))


def test_consolidate(spark):
    tall = spark.createDataFrame([(D(2020, 1, 1), "a", 1.0), (D(2020, 1, 1), "b", 2.0), (D(2020, 1, 2), "b", 3.0)], "day date, feature string, value double")
    spine = calendar.calendar_spine(spark, "2020-01-01", "2020-01-03")
    out = align.consolidate_on_spine(spine, tall, ["a", "b"]).orderBy("day").select("a", "b").collect()
    assert [tuple(r) for r in out] == [(1.0, 2.0), (None, 3.0), (None, None)]
    with pytest.raises(Exception, match="more than one value for b"):
        align.consolidate_wide(tall.unionByName(tall.filter("feature = 'b'")), ["a", "b"]).collect()


def test_patch_column(spark):
    table = panel(spark, [("a", D(2020, 1, d), 1.0) for d in (1, 2, 3)])
    patch = spark.createDataFrame([("a", D(2020, 1, 1), 10.0), ("a", D(2020, 1, 3), 20.0)], "series string, day date, p double")
    out = align.patch_column(table, patch, "day", "p", "ret", ["series"]).orderBy("day").collect()
    assert [r["p"] for r in out] == [10.0, 10.0, 20.0]
    assert out[1]["ret"] == 0.0 and out[2]["ret"] == pytest.approx(np.log(2))


def test_feature_table_and_column_sets(spark):
    df = spark.createDataFrame([("2017-01-03", 1.0, 2.0), ("2017-01-04", 1.0, None), ("2017-01-04", 1.0, None)], "day string, a double, b double")
    loaded = load_feature_table(df)
    assert loaded.count() == 1 and loaded.first()["day"] == D(2017, 1, 4)
    transformed, raw = clean.split_feature_sets(loaded, "day", ["b"])
    assert transformed.columns == ["day", "b"] and raw.columns == ["day", "a"]
    assert clean.drop_columns(df, ["a", "zzz"]).columns == ["day", "b"]
    assert clean.numeric_columns(df) == ["a", "b"]


def test_sorting_puts_missing_last(spark):
    df = spark.createDataFrame([(None,), (2.0,), (1.0,)], "x double")
    assert [r[0] for r in clean.order_by(df, "x").collect()] == [1.0, 2.0, None]
    assert [r[0] for r in clean.order_by(df, "x", descending=True).collect()] == [2.0, 1.0, None]
    assert [r[0] for r in clean.limit_tail(df, 1, "x").collect()] == [2.0]
