"""The study's single recipes as data: from raw files to finished columns.

A `Recipe` names the raw tables it reads, which of their columns it takes under which
names, and an ordered list of steps. A step is the name of an operation and its
arguments; `run` reads the list with one interpreter. Operations that add a column have
the column's name as their first argument; the others change the rows.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from dayloom.functions.scalar import log_count, pct_of_total, percent, rowwise_mean, sum_of_logs
from dayloom.operators.calendar import SPINE_END, SPINE_START, align_to_spine, resample_daily
from dayloom.operators.clean import drop_null_rows, filter_after, filter_between
from dayloom.operators.rolling import rolling_zscores
from dayloom.operators.windows import EPS, Series, vigor_raw
from dayloom.plans.catalog import FUNDING_RATES, SOCIAL_ALT, SOCIAL_BTC, SOCIAL_NAMED, SOURCES
from dayloom.plans.consolidate import read_sources
from dayloom.sources.readers import parse_day

KEY, DAY = "recipe", "day"


@dataclass(frozen=True)
class Recipe:
    """`tables`: raw table -> {name in the steps: column of the file}; the first is the one that is enriched."""

    name: str
    tables: Mapping[str, Mapping[str, str]]
    steps: Sequence[tuple] = field(default=())


@dataclass(frozen=True)
class Calendar:
    """The days of a run: the spine, and the day that `after` cuts behind."""

    start: str = SPINE_START
    end: str = SPINE_END
    after: str = "2017-01-03"


_SERIES = Series([KEY], [DAY])

# Operations that give the column named first, from the columns and numbers that follow.
COLUMNS: dict[str, Callable[..., Column]] = {
    "diff": _SERIES.diff,
    "log_return": _SERIES.log_return,
    "log_return_ratio": _SERIES.log_return_ratio,
    "log_count": log_count,
    "sum_of_logs": sum_of_logs,
    "mean_of": rowwise_mean,
    "percent": percent,
    "share_of": pct_of_total,
    "minus": lambda a, b: F.col(a) - F.col(b),
    "plus": lambda a, b: F.col(a) + F.col(b),
    "vigor": vigor_raw,
    "rolling_mean": _SERIES.rolling_mean,
    "volatility": _SERIES.annualised_volatility,
    "zscore": lambda c, n: _SERIES.rolling_zscore(c, n, eps=EPS),
    "zscore_unguarded": lambda c, n: _SERIES.rolling_zscore(c, n, eps=None),
    "rolling_corr": _SERIES.rolling_corr,
    "forward": _SERIES.forward_fill,
    "backward": _SERIES.backward_fill,
    "interpolate": lambda c: _SERIES.interpolate(c, DAY),
    "interpolate_both": lambda c: _SERIES.interpolate(c, DAY, both=True),
}

# Operations on the rows: (rows, calendar, the other tables, arguments).
ROWS: dict[str, Callable[..., DataFrame]] = {
    "align": lambda rows, days, _, *columns: align_to_spine(rows, [KEY], DAY, list(columns), days.start, days.end),
    "daily": lambda rows, days, _, *columns: resample_daily(rows, [KEY], DAY, list(columns)),
    "enrich": lambda rows, days, tables, name: rows.join(tables[name], [KEY, DAY], "left"),
    "join": lambda rows, days, tables, name: rows.join(tables[name], [KEY, DAY], "full"),
    "zero": lambda rows, days, _, *columns: rows.fillna(0.0, list(columns)),
    "complete": lambda rows, days, _, *columns: drop_null_rows(rows, list(columns)),
    "after": lambda rows, days, _: filter_after(rows, DAY, days.after),
    "between": lambda rows, days, _: filter_between(rows, DAY, days.start, days.end),
    "keep": lambda rows, days, _, *columns: rows.select(KEY, DAY, *columns),
    "year_zscore": lambda rows, days, _, out, c, n, need: rolling_zscores(rows, _SERIES, c, n, out, need, EPS),
}


def apply(step: tuple, rows: DataFrame, days: Calendar, tables: Mapping[str, DataFrame]) -> DataFrame:
    name, *arguments = step
    if name in ROWS:
        return ROWS[name](rows, days, tables, *arguments)
    if name not in COLUMNS:
        raise ValueError(f"no operation {name!r}")
    out, *of = arguments
    return rows.withColumn(out, COLUMNS[name](*of))


def table(recipe: Recipe, source: str, raw: DataFrame) -> DataFrame:
    """The wanted columns of a raw table under their names in the steps, by typed days."""
    known = SOURCES[source]
    day = parse_day(known.day, known.encoding, known.fmt).alias(DAY)
    columns = [F.col(f"`{c}`").alias(name) for name, c in recipe.tables[source].items()]
    return raw.select(F.lit(recipe.name).alias(KEY), day, *columns)


def run(recipe: Recipe, raw: Mapping[str, DataFrame], days: Calendar = Calendar()) -> DataFrame:
    """(recipe, day, finished columns) from the raw tables."""
    tables = {source: table(recipe, source, raw[source]) for source in recipe.tables}
    first = tables[next(iter(tables))]
    return reduce(lambda rows, step: apply(step, rows, days, tables), recipe.steps, first)


def run_from_files(spark: SparkSession, folder: str, recipe: Recipe, days: Calendar = Calendar()) -> DataFrame:
    """The same, from the CSV files of a folder."""
    return run(recipe, read_sources(spark, folder, recipe.tables), days)


def _level(name: str, source: str, column: str = "close") -> Recipe:
    """A market series with closed days: interpolated, then filled backward."""
    return Recipe(name, {source: {"level": column}}, [
        ("align", "level"), ("interpolate", "level", "level"), ("backward", "level", "level"),
    ])


def pair_correlation(n: int = 30) -> Recipe:
    """Rolling correlation of two log-returns, the index filled forward; leading gaps take the first one found."""
    return Recipe("pair_correlation", {"price_btc": {"asset": "close"}, "2014_SP500_PRICE": {"index": "close"}}, [
        ("join", "2014_SP500_PRICE"), ("align", "asset", "index"), ("forward", "index", "index"),
        ("log_return_ratio", "asset_log_ret", "asset"), ("log_return_ratio", "index_log_ret", "index"),
        ("rolling_corr", "corr", "asset_log_ret", "index_log_ret", n), ("backward", "corr", "corr"),
        ("keep", "index", "asset_log_ret", "corr"),
    ])


_RATES = {f"rate_{i}": c for i, c in enumerate(FUNDING_RATES)}
_SOCIAL = {"2012_btc_altcoin_social_metrics": {"own": SOCIAL_BTC, "alt": SOCIAL_ALT, "named": SOCIAL_NAMED}}
_EXCHANGE_SUPPLY = "Supply on Exchanges (as % of total supply)"
_SPREAD = [("log_count", "own_log", "own"), ("sum_of_logs", "rest", "alt", "named"), ("minus", "log_spread", "own_log", "rest")]

RECIPES = {
    r.name: r
    for r in (
        Recipe("target_price", {"price_btc": {"price": "close"}}, [("align", "price"), ("after",)]),
        Recipe("ohlc", {"price_btc": {c: c for c in ("open", "high", "low", "close")}}, [
            ("log_return_ratio", "log_ret", "close"), ("vigor", "vigor", "open", "high", "low", "close"),
            ("rolling_mean", "vigor_ma10", "vigor", 10), ("volatility", "hv10", "log_ret", 10), ("between",),
            ("keep", "close", "log_ret", "vigor_ma10", "hv10"),
        ]),
        Recipe("funding_percent", {"2017_fundingRateCEXs": _RATES}, [
            ("mean_of", "rate", *_RATES), ("keep", "rate"), ("align", "rate"), ("percent", "rate_pct", "rate"),
            ("rolling_mean", "rate_ma7", "rate_pct", 7), ("keep", "rate_pct", "rate_ma7"), ("zero", "rate_pct", "rate_ma7"),
        ]),
        Recipe("share_of_supply", {
            "2010_supply_held_miners_whales": {"held": "Supply held by Miners", "whales": "Percent of Stablecoin Total Supply held by Whales with more than 5 million USD"},
            "2009_supply_circulation_btc": {"total": "Total Supply"},
        }, [
            ("enrich", "2009_supply_circulation_btc"), ("align", "held", "total", "whales"),
            ("share_of", "held_pct", "held", "total"), ("keep", "held_pct", "whales"),
        ]),
        Recipe("exchange_flow", {"2010_supply_on_exchanges_perc": {"supply": _EXCHANGE_SUPPLY}}, [
            ("align", "supply"), ("diff", "change", "supply"), ("rolling_mean", "trend_7", "change", 7),
            ("zscore", "z_30", "change", 30), ("keep", "change", "trend_7", "z_30"), ("complete", "change", "trend_7", "z_30"),
        ]),
        Recipe("divergence_trend", {
            "2011_btcS&P500_divergence_rsi_volatilly": {"divergence": "BTC and S&P 500 Price Divergence", "rsi": "RSI 1d"},
        }, [
            ("align", "divergence", "rsi"), ("rolling_mean", "trend_30", "divergence", 30), ("forward", "rsi", "rsi"),
            ("keep", "divergence", "trend_30", "rsi"),
        ]),
        Recipe("premium_trend", {"2018_coinbase_premium_index": {"premium": "close"}}, [
            ("align", "premium"), ("zero", "premium"), ("rolling_mean", "trend_7", "premium", 7),
            ("zscore", "z_30", "premium", 30), ("zero", "trend_7", "z_30"),
        ]),
        Recipe("mvrv_oscillator", {"2017_mvrv_z_score": {"mvrv": "Plot"}}, [
            ("align", "mvrv"), ("interpolate_both", "mvrv", "mvrv"), ("diff", "change", "mvrv"),
            ("rolling_mean", "ma_30", "mvrv", 30), ("year_zscore", "z_365", "mvrv", 365, 30),
            ("zero", "mvrv", "change", "ma_30", "z_365"),
        ]),
        pair_correlation(),
        Recipe("eth_volume", {"2015_transactionVolumeEth": {"volume": "Transaction Volume (ETH)"}}, [
            ("log_count", "log_level", "volume"), ("diff", "log_diff", "log_level"),
        ]),
        Recipe("eth_exchange_supply", {"2015_supply_held_by_exchanges_top_wallets": {"supply": f"{_EXCHANGE_SUPPLY} (ETH)"}}, [
            ("diff", "change", "supply"), ("zscore_unguarded", "z", "change", 30), ("zero", "supply", "change", "z"),
        ]),
        Recipe("eth_social_breadth", {"2017_eth_social_metrics": {"volume": "Social Volume (ETH)"}}, [
            ("log_count", "log_value", "volume"), ("keep", "log_value"), ("daily", "log_value"),
            ("interpolate", "log_value", "log_value"), ("zscore_unguarded", "z", "log_value", 30), ("backward", "z", "z"),
            ("zero", "z"), ("keep", "z"),
        ]),
        Recipe("eth_social", {"eth_social_metrics": {"dominance": "Social Dominance (ETH)", "volume": "Social Volume (ETH)"}}, [
            ("align", "dominance", "volume"), ("diff", "dominance_diff", "dominance"), ("log_return", "volume_log_ret", "volume"),
            ("after",), ("keep", "dominance", "dominance_diff", "volume", "volume_log_ret"),
        ]),
        _level("sp500_level", "2014_SP500_PRICE"),
        _level("nasdaq_level", "201501_NASDAQ"),
        _level("gold_level", "201501_PRICE_GOLD"),
        _level("us10y_level", "201501_US10Y"),
        _level("vix_level", "201501_VIX"),
        Recipe("total3", {"201501_mkcap_total3": {"total3": "close"}}, [("log_count", "log_level", "total3"), ("diff", "log_diff", "log_level")]),
        Recipe("ssr", {"201404_ssr": {"ssr": "SSR"}}, [("diff", "ssr_diff", "ssr")]),
        Recipe("flippening", {"201809_Flippening_Ratio_Diff": {"ratio": "close"}}, [("diff", "ratio_diff", "ratio")]),
        Recipe("social_spread", _SOCIAL, [
            ("align", "own", "alt", "named"), *_SPREAD, ("diff", "momentum", "log_spread"),
            ("keep", "log_spread", "momentum"), ("zero", "log_spread", "momentum"),
        ]),
        Recipe("market_noise", _SOCIAL, [
            *_SPREAD, ("plus", "noise", "own_log", "rest"), ("diff", "momentum", "log_spread"),
            ("zscore_unguarded", "noise_z", "noise", 30), ("keep", "log_spread", "momentum", "noise_z"),
            ("zero", "log_spread", "momentum", "noise_z"),
        ]),
        Recipe("usdc_dominance", {"201901_dominance_usdc": {"dominance": "close"}}, [
            ("align", "dominance"), ("forward", "dominance", "dominance"), ("log_return", "log_ret", "dominance"), ("after",),
        ]),
    )
}
