"""Raw CSV files to the consolidated table, against a pandas walk-through."""

import numpy as np
import pandas as pd
import pytest
from conftest import assert_close

from dayloom.operators.profile import describe, null_counts, profile_table, table_extent
from dayloom.plans import catalog, consolidate
from dayloom.sources import readers, sinks
from pyspark.sql.types import StructType

DAYS = pd.date_range("2016-12-20", "2020-06-30")


def raw_frame(source, rng):
    """A file with missing days, missing values and zeros."""
    days = DAYS[rng.random(len(DAYS)) < 0.85]
    out = {}
    for field in StructType.fromDDL(source.schema).fields:
        if field.name == source.day:
            continue
        values = rng.uniform(1, 50, len(days)).round(3)
        values[rng.random(len(days)) < 0.05] = 0.0
        values[rng.random(len(days)) < 0.05] = np.nan
        out[field.name] = values
    text = {
        "epoch": lambda: days.astype("datetime64[s]").astype("int64") + 3600,
        "iso": lambda: days.strftime("%Y-%m-%dT06:00:00+00:00"),
        "local": lambda: days.strftime("%m/%d/%Y" if source.fmt.startswith("MM") else "%Y-%m-%d"),
        "day": lambda: days.strftime("%Y-%m-%d"),
    }[source.encoding]()
    return pd.DataFrame({source.day: text, **out}), days


@pytest.fixture(scope="module")
def files(tmp_path_factory):
    rng = np.random.default_rng(8)
    folder, frames = tmp_path_factory.mktemp("raw"), {}
    for name, source in catalog.SOURCES.items():
        table, days = raw_frame(source, rng)
        table.to_csv(folder / f"{name}.csv", index=False)
        frames[name] = table.assign(day=days)
    return str(folder), frames


@pytest.fixture(scope="module")
def wide(spark, files):
    return consolidate.consolidated(consolidate.read_sources(spark, files[0])).cache()


def walk_through(frames):
    """The same table step by step with pandas, one indicator at a time."""
    spine = pd.DataFrame({"day": pd.date_range("2016-12-31", "2025-08-01")})
    table = spine.copy()
    for f in catalog.FEATURES:
        raw = frames[f.source]
        social = (catalog.SOCIAL_BTC, catalog.SOCIAL_ALT, catalog.SOCIAL_NAMED)
        if f.source.endswith("fundingRateCEXs"):
            v = raw[list(catalog.FUNDING_RATES)].mean(axis=1)
        elif f.source.endswith("social_metrics"):
            own, rest = np.log1p(raw[social[0]]), np.log1p(raw[social[1]] + raw[social[2]])
            v = {"btc_social_volume": raw[social[0]], "btc_log_vol": own, "alt_total_log_vol": rest, "social_vol_spread": own - rest}[f.level]
        else:
            column = {
                "rvi_close": "RVI", "mvrv_close": "Plot", "ssr": "SSR", "dxy_close": "dxy_close_new", "nasdaq_close": "Close/Last",
                "supply_held_by_miners_btc": "Supply held by Miners", "transaction_volume_eth": "Transaction Volume (ETH)",
                "supply_on_exchanges_perc_btc": "Supply on Exchanges (as % of total supply)",
                "whale_transaction_count_100k_btc": "Whale Transaction Count (>100k USD)",
                "whale_transaction_count_1M_btc": "Whale Transaction Count (>1m USD)",
            }.get(f.level, "close")
            v = raw[column]
        part = pd.DataFrame({"day": raw["day"], "v": v})
        part["file_before"] = part["v"].shift(1)
        part = spine.merge(part, how="left", on="day")
        x = part["v"]
        if f.zero_is_missing:
            x = x.replace(0, np.nan)
        if f.fill == "forward":
            x = x.ffill()
        if f.fill == "zero_before":
            x = x.fillna(0)
        before = part["file_before"] if f.grain == "file" else x.shift(1)
        with np.errstate(divide="ignore", invalid="ignore"):
            change = {
                "log_return": lambda: np.log(x) - np.log(before),
                "log_return_shifted": lambda: np.log(x + 1) - np.log(before + 1),
                "difference": lambda: x - before,
                None: lambda: pd.Series(np.nan, index=x.index),
            }[f.transform]()
        change = change.replace([np.inf, -np.inf], np.nan)
        if f.fill == "zero_after":
            x, change = x.fillna(0), change.fillna(0)
        if f.start is not None:
            start = pd.Timestamp(f.start)
            kept = part["day"] >= start if f.inclusive else part["day"] > start
            x, change = x.where(kept), change.where(kept)
        table[f.level] = x
        if f.change:
            table[f.change] = change
    return table


def test_consolidated_matches_the_walk_through(wide, files):
    got = wide.toPandas().sort_values("day").reset_index(drop=True)
    want = walk_through(files[1])
    assert list(got.columns) == list(catalog.CONSOLIDATED_COLUMNS) and len(got.columns) == 47
    assert len(got) == 3136
    for c in catalog.CONSOLIDATED_COLUMNS[2:]:
        assert_close(got[c], want[c])


def test_plan_has_one_exchange_on_the_series_and_one_on_the_day(spark, files):
    # another end day, so that the cached table of the other tests is not used
    df = consolidate.consolidated(consolidate.read_sources(spark, files[0]), end="2025-07-31")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(series") == 1
    assert plan.count("Exchange hashpartitioning(day") == 1
    assert plan.count("Exchange hashpartitioning") == 2 and "SinglePartition" not in plan and "Join" not in plan
    assert plan.count("FileScan csv") == 20 - 1  # the circulation file feeds no feature


def test_catalogue_is_consistent():
    made = {f.level for f in catalog.FEATURES} | {f.change for f in catalog.FEATURES if f.change}
    assert made == set(catalog.CONSOLIDATED_COLUMNS) - {"day", "is_weekend"}
    assert set(catalog.TRANSFORMED) <= made and len(catalog.TRANSFORMED) == 24
    assert len(catalog.CAUSALITY_FEATURES) == 22


def test_panel_columns_are_carried(spark, files):
    source = consolidate.read_sources(spark, files[0], ["201501_VIX", "nasdaq"])
    from pyspark.sql import functions as F

    doubled = {n: d.withColumn("market", F.explode(F.array(F.lit("m1"), F.lit("m2")))) for n, d in source.items()}
    features = [f for f in catalog.FEATURES if f.source in doubled]
    out = consolidate.consolidated(doubled, features, ["market"])
    assert out.count() == 2 * 3136
    one, two = (out.filter(f"market = '{m}'").drop("market").orderBy("day").toPandas() for m in ("m1", "m2"))
    assert one.equals(two)


def test_csv_round_trip_and_describe_sink(spark, wide, tmp_path):
    path = str(tmp_path / "table")
    sinks.write_table(wide, path)
    back = readers.read_feature_table(spark, path)
    assert back.count() == wide.filter("day > '2017-01-03'").count()
    names = ["spx_log_ret", "us10y_diff"]
    sinks.write_describe(describe(back, names), str(tmp_path / "described"), names)
    rows = spark.read.option("header", True).csv(str(tmp_path / "described"))
    assert rows.columns == ["statistic", *names] and rows.count() == 8


def test_header_mismatch_is_noticed(spark, tmp_path):
    (tmp_path / "f.csv").write_text("time,other\n1,2\n")
    with pytest.raises(Exception):
        readers.read_series_csv(spark, str(tmp_path / "f.csv"), "time bigint, close double").collect()


def test_profile(wide):
    extent = table_extent(wide, "day").first()
    assert (extent["rows"], extent["columns"], str(extent["first_day"]), str(extent["last_day"])) == (3136, 47, "2016-12-31", "2025-08-01")
    nulls = {r["feature"]: r["nulls"] for r in null_counts(wide).collect()}
    assert "btc_log_vol" not in nulls and nulls["cb_premium_usd"] > 1000
    parts = profile_table(wide.select("day", "spx_close"), "day")
    assert parts["head"].count() == 10 and {r["feature"]: r["type"] for r in parts["info"].collect()}["day"] == "date"
