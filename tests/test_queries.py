"""Registered queries against DuckDB on the smallest test tables."""

import os

import pytest

import __spark_entry__ as registered
from checks.compare import compare, connect

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")

NAMES = (
    "read_series_csv", "align_to_spine", "log_return_ffill", "interpolate_time_both", "rolling_zscore_min_periods",
    "describe_any_grain", "correlation_by_era", "chow_test", "vif", "adf_test", "granger_by_era", "consolidated_table",
    "study_granger_skipped", "long_rolling", "long_interpolate", "with_f_pvalue",
)


@pytest.fixture(scope="module")
def db():
    return connect(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, db, name):
    problem, _, _ = compare(spark, db, registered.queries()[name], registered.oracle_sql().get(name), SF)
    assert problem is None


def test_entry(spark):
    df = registered.entry(spark)
    assert df.columns == ["series", "day", "value", "log_ret"] and df.count() > 0


def test_every_query_of_the_study_has_sql():
    assert set(registered.ORACLES) == set(registered.QUERIES)
