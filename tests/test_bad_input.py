"""Missing and unreadable days, empty files, further labels and columns, wide panels."""

import datetime
import inspect

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from dayloom.functions import scalar
from dayloom.functions.distributions import f_upper_tail
from dayloom.operators import calendar, comoments, lagged, profile, regression, unit_root
from dayloom.plans import catalog, consolidate
from dayloom.sources import readers, sinks

DAY = datetime.date(2020, 1, 2)


def failing(df):
    with pytest.raises(Exception) as caught:
        df.collect()
    return str(caught.value)


def test_rows_without_a_day_are_refused(spark):
    df = spark.createDataFrame([("a", None, 1.0), ("a", None, 2.0), ("a", DAY, 3.0)], "s string, day date, x double")
    assert "no day" in failing(calendar.align_to_spine(df, ["s"], "day", ["x"], "2020-01-01", "2020-01-04"))
    assert "no day" in failing(calendar.resample_daily(df, ["s"], "day", ["x"]))


@pytest.mark.parametrize("boundary", ["second", "both"])
def test_rows_without_a_day_are_in_no_era(spark, boundary):
    df = spark.createDataFrame([(None,), (DAY,), (datetime.date(2020, 3, 11),)], "day date")
    rows = [(r.day, r.era) for r in calendar.assign_era(df, "day", boundary=boundary).collect()]
    assert len(rows) == (2 if boundary == "second" else 3) and all(d is not None for d, _ in rows)
    assert df.select(calendar.era_label("day").alias("e")).where("e is null").count() == 1


def test_lag_matrix_refuses_two_rows_for_a_day(spark):
    df = spark.createDataFrame([("a", DAY, 1.0), ("a", DAY, 2.0)], "s string, day date, x double")
    assert "more than one row" in failing(lagged.lag_matrix(df, ["s"], ["day"], ["x"], 2))


def test_unreadable_days_are_reported(spark):
    df = spark.createDataFrame([("2020-01-02T00:00:00+00:00", 1.0), ("soon", 2.0), (None, 3.0)], "time string, close double")
    sources = {"2014_SP500_PRICE": df}
    # Which of the two raises first depends on the tasks.
    raised = failing(consolidate.tall_values(sources))
    assert "no day in soon" in raised or "no day in NULL" in raised
    assert consolidate.tall_values(sources, bad_days="drop").count() == 1
    assert [r.day_text for r in consolidate.rejected_rows(sources).orderBy("day_text").collect()] == [None, "soon"]


def test_empty_files_count_as_zero(spark):
    empty = {
        n: spark.createDataFrame([], catalog.SOURCES[n].schema)
        for n in ("2010_whale_transaction_count_btc_2", "2012_btc_altcoin_social_metrics", "2014_SP500_PRICE")
    }
    rows = consolidate.consolidated(empty).orderBy("day").collect()
    assert len(rows) == 3136
    assert {r.btc_social_volume for r in rows} == {0.0} == {r.vol_acceleration for r in rows}
    assert {r.whale_100k_log_ret for r in rows if r.day > DAY} == {0.0} == {r.whale_transaction_count_1M_btc for r in rows if r.day > DAY}
    assert rows[0].whale_transaction_count_1M_btc is None and {r.spx_close for r in rows} == {None}


def test_columns_are_found_by_name(spark, tmp_path):
    pd.DataFrame({"extra": ["x", "y"], "close": ["1.5", "bad"], "time": [7, 8], "BTC / USD": [1, 2]}).to_csv(tmp_path / "a.csv", index=False)
    df = readers.read_series_csv(spark, str(tmp_path / "a.csv"), "time bigint, close double")
    assert df.columns == ["time", "close"]
    assert [tuple(r) for r in df.orderBy("time").collect()] == [(7, 1.5), (8, None)]


def csv_file(path, *lines):
    path.write_text("\n".join(lines) + "\n" if lines else "")
    return str(path)


def test_each_file_has_its_own_header(spark, tmp_path):
    a = csv_file(tmp_path / "a.csv", "time,close", "1,10.0")
    b = csv_file(tmp_path / "b.csv", "close,time", "20.0,2")
    c = csv_file(tmp_path / "c.csv", '"odd, name",time,close,more', '"x, y",3,30.0,1', "z,4,,2")
    d, e = csv_file(tmp_path / "d.csv"), csv_file(tmp_path / "e.csv", "time,close")
    want = [(1, 10.0), (2, 20.0), (3, 30.0), (4, None)]
    for path in ([a, b, c, d, e], str(tmp_path), f"{tmp_path}/*.csv"):
        rows = readers.read_series_csv(spark, path, "time bigint, close double")
        assert sorted(map(tuple, rows.collect())) == want
    only = readers.read_series_csv(spark, [b, a], "time bigint, close double", ["close"])
    assert sorted(r.close for r in only.collect()) == [10.0, 20.0] and only.columns == ["close"]
    assert readers.read_series_csv(spark, d, "time bigint, close double").collect() == []
    f = csv_file(tmp_path / "f.csv", "time,open", "5,50.0")
    with pytest.raises(ValueError, match="no column 'close' in the header of .*f.csv"):
        readers.read_series_csv(spark, [a, f], "time bigint, close double")


def test_cells_that_cannot_be_read(spark, tmp_path):
    a = csv_file(tmp_path / "a.csv", "time,close", "1,10.0", '2,"1,234.5"', "x,30.0", "4,")
    b = csv_file(tmp_path / "b.csv", "close,time", '"1,234.5",5', "NaN,6")
    schema = "time bigint, close double"
    rows = readers.read_series_csv(spark, [a, b], schema).collect()
    assert sorted(rows, key=repr) == sorted([(1, 10.0), (2, None), (None, 30.0), (4, None), (5, None), (6, None)], key=repr)
    found = {(r.file.rsplit("/", 1)[1], r.column, r.cell, r.n) for r in readers.rejected_cells(spark, [a, b], schema).collect()}
    assert found == {("a.csv", "close", "1,234.5", 1), ("a.csv", "time", "x", 1), ("b.csv", "close", "1,234.5", 1)}
    raised = failing(readers.read_series_csv(spark, b, schema, bad_values="raise"))
    assert "close is no double in 1,234.5" in raised and "b.csv" in raised
    assert readers.read_series_csv(spark, b, schema, ["time"], bad_values="raise").count() == 2
    with pytest.raises(ValueError, match="bad_values"):
        readers.read_series_csv(spark, b, schema, bad_values="drop")


def test_feature_table_as_csv(spark, tmp_path):
    table = spark.createDataFrame([(DAY, 1.0, None), (DAY, 1.0, None)], "day date, x double, y double")
    path = str(tmp_path / "table.csv")
    sinks.write_table(table, path, "csv")
    rows = readers.read_feature_table(spark, path).collect()
    assert [tuple(r) for r in rows] == [(DAY, 1.0, None)]


def test_every_recipe_file_has_a_source():
    assert len(catalog.SOURCES) == 32
    assert len(catalog.HEAT_MAP_FEATURES) == 22 and catalog.HEAT_MAP_FEATURES[0] == catalog.TARGET


def test_a_third_label_changes_nothing(spark):
    rng = np.random.default_rng(3)
    pdf = pd.DataFrame({"x": rng.normal(size=90), "y": rng.normal(size=90), "part": ["one", "two", "pooled"] * 30})
    whole = spark.createDataFrame(pdf)
    tested = regression.chow_test(whole, "y", ["x"], "part", ["one", "two"]).first()
    alone = regression.chow_test(whole.where("part <> 'pooled'"), "y", ["x"], "part", ["one", "two"]).first()
    assert tested.f_stat == pytest.approx(alone.f_stat) and tested.n_1 + tested.n_2 == 60


def test_unit_root_lags_follow_the_rows():
    assert "max_rows" not in inspect.signature(unit_root.adf_test).parameters
    assert "max_rows" not in inspect.signature(unit_root.adf_report).parameters


def test_tails_settle_or_are_missing():
    big = f_upper_tail(np.array([1.00001, 2.0]), np.array([1e9, 2.0]), np.array([1e9, 20.0]))
    assert big[0] == pytest.approx(0.43718, abs=2e-5) or np.isnan(big[0])
    assert big[1] == pytest.approx(1.2**-10)  # closed form for two degrees of freedom


def test_approximate_quartiles(spark):
    df = spark.range(1, 1002).select(F.col("id").cast("double").alias("x"))
    row = profile.describe(df, ["x"], grain="approximate").first()
    assert (row["min"], row["p25"], row["p50"], row["p75"], row["max"]) == pytest.approx((1, 251, 501, 751, 1001), abs=1)


def test_many_groups_shuffle_less_than_their_rows(spark):
    """20,000 groups of 22 columns: short groups travel as rows, not as matrices."""
    columns = [f"c{i}" for i in range(22)]
    rows = spark.range(0, 200_000, 1, 4).select(
        (F.col("id") % 20_000).alias("g"), *[F.rand(i).alias(c) for i, c in enumerate(columns)]
    )
    partials = comoments._partials_by_block(rows, columns, ["g"])
    sent = partials.agg(F.sum(F.size("_numbers")).alias("numbers"), F.count("*").alias("n")).first()
    assert sent.n < 200_000 and sent.numbers <= 200_000 * 22


def test_groups_in_many_tasks_equal_pandas(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"g": rng.choice(["a", "b", None], 3000), "h": rng.integers(0, 40, 3000), "x": rng.normal(1e6, 1, 3000), "y": rng.normal(size=3000)})
    pdf.loc[rng.random(3000) < 0.1, "y"] = None
    df = spark.createDataFrame(pdf).repartition(9).withColumn("y", F.when(~F.isnan("y"), F.col("y")))
    got = comoments.comoments(df, ["x", "y"], ["g", "h"]).where("i = 0 and j = 1").collect()
    pdf["g"] = pdf["g"].fillna("none")
    want = pdf.dropna(subset=["y"]).groupby(["g", "h"])
    assert len(got) == pdf.groupby(["g", "h"]).ngroups
    for r in got:
        part = want.get_group((r.g or "none", r.h))
        assert r.n == len(part)
        assert r.cp == pytest.approx(((part.x - part.x.mean()) * (part.y - part.y.mean())).sum(), abs=1e-6)


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Tokyo"])
def test_days_do_not_depend_on_the_sessions_zone(spark, zone):
    df = spark.createDataFrame(
        [(0, "2020-01-02"), (86_399, "2020-01-02T00:30:00"), (-1, "2020-01-02T23:30:00-05:00"), (86_400, "2020-01-02 00:30:00+09:00"), (None, "soon")],
        "s bigint, t string",
    )
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        rows = df.select(scalar.day_from_epoch("s").alias("a"), scalar.day_from_iso("t").alias("b")).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    first = datetime.date(1970, 1, 1)
    assert [r.a for r in rows] == [first, first, datetime.date(1969, 12, 31), datetime.date(1970, 1, 2), None]
    assert [r.b for r in rows] == [DAY, DAY, datetime.date(2020, 1, 3), datetime.date(2020, 1, 1), None]
