"""Recipes as data: declared columns, known operations, the same results as the functions."""

import numpy as np
import pandas as pd
import pytest
from conftest import frame

from dayloom.plans import catalog, recipes, variants
from pyspark.sql.types import StructType


@pytest.mark.parametrize("name", sorted(recipes.RECIPES))
def test_recipes_name_declared_columns_and_known_operations(spark, name):
    recipe = recipes.RECIPES[name]
    for source, columns in recipe.tables.items():
        declared = {f.name for f in StructType.fromDDL(catalog.SOURCES[source].schema).fields}
        assert set(columns.values()) <= declared
    assert all(step[0] in recipes.ROWS or step[0] in recipes.COLUMNS for step in recipe.steps)


def test_unknown_operations_are_refused(spark):
    raw = {"201404_ssr": spark.createDataFrame([("2020-01-01T00:00:00+00:00", 1.0, 2.0)], "time string, SSR double, close double")}
    wrong = recipes.Recipe("wrong", {"201404_ssr": {"ssr": "SSR"}}, [("squeeze", "ssr")])
    with pytest.raises(ValueError, match="squeeze"):
        recipes.run(wrong, raw)


def test_a_recipe_without_steps_is_a_scan(spark):
    raw = {"201404_ssr": spark.createDataFrame([("2020-01-01T00:00:00+00:00", 1.0, 2.0)], "time string, SSR double, close double")}
    (row,) = recipes.run(recipes.Recipe("scan", {"201404_ssr": {"ssr": "SSR"}}), raw).collect()
    assert (row.recipe, str(row.day), row.ssr) == ("scan", "2020-01-01", 1.0)


def test_from_files_equals_the_function(spark, tmp_path):
    rng = np.random.default_rng(1)
    days = pd.date_range("2020-01-01", periods=90)
    kept = rng.random(90) < 0.8
    pdf = pd.DataFrame({"Date": days.strftime("%Y-%m-%dT00:00:00+00:00"), "more": 1, "Supply on Exchanges (as % of total supply)": rng.normal(size=90).cumsum()})[kept]
    pdf.to_csv(tmp_path / "2010_supply_on_exchanges_perc.csv", index=False)
    got = recipes.run_from_files(spark, str(tmp_path), recipes.RECIPES["exchange_flow"], recipes.Calendar("2020-01-01", "2020-03-30"))
    tall = pd.DataFrame({"day": days[kept].date, "x": pdf.iloc[:, 2]})
    want = variants.flow_trend(frame(spark, tall, "day date, x double"), [], "day", "x", "2020-01-01", "2020-03-30")
    a, b = ([tuple(r) for r in d.select("day", "change", "trend_7", "z_30").orderBy("day").collect()] for d in (got, want))
    assert a == b
