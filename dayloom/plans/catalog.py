"""The study's indicators as data: where each comes from and how it is prepared.

A `Feature` says which value to take from which raw table, how gaps are filled
on the calendar, which transform makes it stationary, and from which day on it
is used. `dayloom.plans.consolidate` turns the whole catalogue into one plan.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, functions as F

from dayloom.functions.scalar import log_count, log_of_sum, rowwise_mean


@dataclass(frozen=True)
class Feature:
    """One daily indicator.

    fill: 'none', 'forward', 'zero_before' or 'zero_after' (the transform).
    transform: 'log_return', 'log_return_shifted', 'difference' or None.
    grain: 'spine' transforms between calendar days, 'file' between the rows of
    the raw table.
    """

    level: str
    source: str
    value: Callable[[], Column]
    change: str | None = None
    transform: str | None = None
    fill: str = "none"
    grain: str = "spine"
    start: str | None = None
    inclusive: bool = False
    zero_is_missing: bool = False


@dataclass(frozen=True)
class Source:
    """A raw table: its file name, day column and the encoding of the day."""

    name: str
    day: str
    encoding: str
    schema: str
    fmt: str = "yyyy-MM-dd"


def _column(name: str) -> Callable[[], Column]:
    return lambda: F.col(f"`{name}`")


# Raw file names, column headers, feature names and start days as
# the study publishes them.
FUNDING_RATES = (
    "BitMEX Funding Rate",
    "Binance Funding Rate (USDT)",
    "DyDx Exchange Funding Rates",
    "Deribit Exchange Funding Rates",
)
SOCIAL_BTC = "Social Volume (btc OR bitcoin)"
SOCIAL_ALT = 'Social Volume (altcoin OR altcoins OR "altcoin season" OR "altcoin pump" OR "altcoin rally")'
SOCIAL_NAMED = "Social Volume (ethereum OR eth OR solana OR sol OR cardano OR ada OR polkadot OR dot OR ripple OR xrp OR dogecoin OR doge OR memecoin OR shiba)"

_CLOSE_EPOCH = "time bigint, close double"
_CLOSE_TEXT = "time string, close double"
_EXCHANGE_SUPPLY_ETH = (
    "Date string, `Supply on Exchanges (as % of total supply) (ETH)` double, "
    "`Supply held by top exchange addresses (ETH)` double, "
    "`Supply held by top addresses (as % of total supply) (ETH)` double"
)
_SOCIAL_ETH = (
    "Date string, `Social Volume AI (ETH)` double, `Social Dominance (ETH)` double, `Social Volume (ETH)` double, "
    "`Trending Social Rank (ETH)` double"
)

SOURCES = {
    s.name: s
    for s in (
        Source("price_btc", "time", "epoch", "time bigint, open double, high double, low double, close double, RVI double"),
        Source("2017_fundingRateCEXs", "Date", "local", "Date string, " + ", ".join(f"`{c}` double" for c in FUNDING_RATES)),
        Source("2010_supply_held_miners_whales", "Date", "iso", "Date string, `Supply held by Miners` double, `Percent of Stablecoin Total Supply held by Whales with more than 5 million USD` double"),
        Source("2009_supply_circulation_btc", "Date", "iso", "Date string, `Total Supply` double"),
        Source("2010_supply_on_exchanges_perc", "Date", "iso", "Date string, `Supply on Exchanges (as % of total supply)` double"),
        Source("2015_transactionVolumeEth", "Date", "iso", "Date string, `Transaction Volume (ETH)` double, `Transaction Volume USD (ETH)` double"),
        Source("2018_coinbase_premium_index", "time", "iso", _CLOSE_TEXT),
        Source("2017_mvrv_z_score", "time", "iso", "time string, Plot double"),
        Source("2010_whale_transaction_count_btc_2", "Date", "iso", "Date string, `Whale Transaction Count (>1m USD)` double, `Whale Transaction Count (>100k USD)` double"),
        Source("2014_SP500_PRICE", "time", "iso", _CLOSE_TEXT),
        Source("dxy_new", "Data_UTC", "day", "Data_UTC string, dxy_close_new double"),
        Source("nasdaq", "Date", "local", "Date string, `Close/Last` double", "MM/dd/yyyy"),
        Source("201501_PRICE_GOLD", "time", "epoch", _CLOSE_EPOCH),
        Source("201501_US10Y", "time", "epoch", _CLOSE_EPOCH),
        Source("201501_VIX", "time", "epoch", _CLOSE_EPOCH),
        Source("201501_mkcap_total3", "time", "epoch", _CLOSE_EPOCH),
        Source("201404_ssr", "time", "iso", "time string, SSR double, close double"),
        Source("201809_Flippening_Ratio_Diff", "time", "iso", _CLOSE_TEXT),
        Source("2012_btc_altcoin_social_metrics", "Date", "iso", f"Date string, `{SOCIAL_BTC}` double, `{SOCIAL_ALT}` double, `{SOCIAL_NAMED}` double"),
        Source("201501_dominance_usdt", "time", "epoch", _CLOSE_EPOCH),
        # Files of the single recipes, not of the consolidated table.
        Source("201901_dominance_usdc", "time", "epoch", _CLOSE_EPOCH),
        Source("2010_whale_transaction_count_btc", "Date", "iso", "Date string"),
        Source("2010_whale_transaction_count_eth", "Date", "iso", "Date string"),
        Source("2011_btcS&P500_divergence_rsi_volatilly", "Date", "iso", "Date string, `BTC and S&P 500 Price Divergence` double, `RSI 1d` double"),
        Source("2015_supply_held_by_exchanges_top_wallets", "Date", "iso", _EXCHANGE_SUPPLY_ETH),
        Source("2015_supply_held_by_exchanges_top_wallets_2", "Date", "iso", _EXCHANGE_SUPPLY_ETH),
        Source("2017_eth_social_metrics", "Date", "iso", _SOCIAL_ETH),
        Source("eth_social_metrics", "Date", "iso", _SOCIAL_ETH),
        Source("201501_DXY", "time", "epoch", _CLOSE_EPOCH),
        Source("201501_NASDAQ", "time", "epoch", _CLOSE_EPOCH),
        Source("2015_institutional_Eth_accumulation", "Date", "iso", "Date string, `Social Volume` double"),
        Source("2012_flippening_especulacao_ganancia", "Date", "iso", "Date string"),
    )
}

FEATURES = (
    Feature("btc_price_close", "price_btc", _column("close"), "btc_log_ret", "log_return", grain="file", start="2016-12-31"),
    Feature("rvi_close", "price_btc", _column("RVI"), "rvi_diff", "difference", start="2016-12-31"),
    Feature("total_funding_rate_btc", "2017_fundingRateCEXs", lambda: rowwise_mean(*[f"`{c}`" for c in FUNDING_RATES]), "funding_rate_diff_btc", "difference", grain="file", start="2016-12-31"),
    Feature("supply_held_by_miners_btc", "2010_supply_held_miners_whales", _column("Supply held by Miners"), "miner_net_pos_change_log", "log_return", start="2016-12-31"),
    Feature("supply_on_exchanges_perc_btc", "2010_supply_on_exchanges_perc", _column("Supply on Exchanges (as % of total supply)"), "exchange_supply_diff_btc", "difference", start="2016-12-31"),
    Feature("cb_premium_usd", "2018_coinbase_premium_index", _column("close"), "cb_premium_diff_btc", "difference", start="2020-03-11", inclusive=True),
    Feature("mvrv_close", "2017_mvrv_z_score", _column("Plot"), "mvrv_diff_btc", "difference", start="2017-01-02"),
    Feature("whale_transaction_count_100k_btc", "2010_whale_transaction_count_btc_2", _column("Whale Transaction Count (>100k USD)"), "whale_100k_log_ret", "log_return_shifted", "zero_before", start="2017-01-02"),
    Feature("whale_transaction_count_1M_btc", "2010_whale_transaction_count_btc_2", _column("Whale Transaction Count (>1m USD)"), "whale_1m_log_ret", "log_return_shifted", "zero_before", start="2017-01-02"),
    Feature("transaction_volume_eth", "2015_transactionVolumeEth", _column("Transaction Volume (ETH)"), "eth_vol_log_ret", "log_return", "forward", start="2017-01-02", zero_is_missing=True),
    Feature("spx_close", "2014_SP500_PRICE", _column("close"), "spx_log_ret", "log_return", "forward", start="2017-01-03"),
    Feature("dxy_close", "dxy_new", _column("dxy_close_new"), "dxy_log_ret", "log_return", "forward", start="2017-01-03"),
    Feature("nasdaq_close", "nasdaq", _column("Close/Last"), "nasdaq_log_ret", "log_return", "forward", start="2017-01-03"),
    Feature("gold_close", "201501_PRICE_GOLD", _column("close"), "gold_log_ret", "log_return", "forward", start="2017-01-03"),
    Feature("us10y_close", "201501_US10Y", _column("close"), "us10y_diff", "difference", "forward", start="2017-01-03"),
    Feature("vix_close", "201501_VIX", _column("close"), "vix_log_ret", "log_return", "forward", start="2017-01-03"),
    Feature("total3_close", "201501_mkcap_total3", _column("close"), "total3_log_ret", "log_return", "forward", start="2017-01-03"),
    Feature("ssr", "201404_ssr", _column("SSR"), "ssr_diff", "difference", "forward", start="2017-01-03"),
    Feature("flippening_close", "201809_Flippening_Ratio_Diff", _column("close"), "flippening_close_diff", "difference", "forward", start="2020-01-01"),
    Feature("btc_social_volume", "2012_btc_altcoin_social_metrics", _column(SOCIAL_BTC), fill="zero_after"),
    Feature("btc_log_vol", "2012_btc_altcoin_social_metrics", lambda: log_count(f"`{SOCIAL_BTC}`"), fill="zero_after"),
    Feature("alt_total_log_vol", "2012_btc_altcoin_social_metrics", lambda: log_of_sum(f"`{SOCIAL_ALT}`", f"`{SOCIAL_NAMED}`"), fill="zero_after"),
    Feature("social_vol_spread", "2012_btc_altcoin_social_metrics", lambda: log_count(f"`{SOCIAL_BTC}`") - log_of_sum(f"`{SOCIAL_ALT}`", f"`{SOCIAL_NAMED}`"), "vol_acceleration", "difference", "zero_after"),
    Feature("usdt_dominance", "201501_dominance_usdt", _column("close"), "usdt_log_ret", "log_return", "forward", start="2017-01-03"),
)

# Joined on for the heat maps; not in the consolidated table.
USDC = Feature("usdc_dominance", "201901_dominance_usdc", _column("close"), "usdc_log_ret", "log_return", "forward")

TARGET = "btc_log_ret"

# Column order of the consolidated table.
CONSOLIDATED_COLUMNS = (
    "day", "is_weekend", "btc_price_close", "btc_log_ret", "rvi_close", "rvi_diff",
    "total_funding_rate_btc", "funding_rate_diff_btc", "supply_held_by_miners_btc",
    "miner_net_pos_change_log", "supply_on_exchanges_perc_btc", "exchange_supply_diff_btc",
    "cb_premium_usd", "cb_premium_diff_btc", "mvrv_close", "mvrv_diff_btc",
    "whale_100k_log_ret", "whale_transaction_count_100k_btc", "whale_1m_log_ret",
    "whale_transaction_count_1M_btc", "transaction_volume_eth", "eth_vol_log_ret",
    "spx_close", "spx_log_ret", "dxy_close", "dxy_log_ret", "nasdaq_close", "nasdaq_log_ret",
    "gold_close", "gold_log_ret", "us10y_close", "us10y_diff", "vix_close", "vix_log_ret",
    "total3_close", "total3_log_ret", "ssr", "ssr_diff", "flippening_close",
    "flippening_close_diff", "btc_social_volume", "btc_log_vol", "alt_total_log_vol",
    "social_vol_spread", "vol_acceleration", "usdt_dominance", "usdt_log_ret",
)

# The stationary feature set.
TRANSFORMED = (
    "rvi_diff", "funding_rate_diff_btc", "miner_net_pos_change_log", "exchange_supply_diff_btc",
    "btc_log_ret", "cb_premium_diff_btc", "eth_vol_log_ret", "mvrv_diff_btc", "whale_100k_log_ret",
    "whale_1m_log_ret", "spx_log_ret", "dxy_log_ret", "nasdaq_log_ret", "gold_log_ret",
    "us10y_diff", "vix_log_ret", "total3_log_ret", "ssr_diff", "flippening_close_diff",
    "btc_log_vol", "alt_total_log_vol", "social_vol_spread", "vol_acceleration", "usdt_log_ret",
)

# Features tested for causality, and compared in heat maps.
CAUSALITY_FEATURES = tuple(f for f in TRANSFORMED if f not in ("btc_log_ret", "alt_total_log_vol"))
HEAT_MAP_FEATURES = (
    "btc_log_ret", "rvi_diff", "funding_rate_diff_btc", "miner_net_pos_change_log", "exchange_supply_diff_btc",
    "cb_premium_diff_btc", "mvrv_diff_btc", "whale_100k_log_ret", "whale_1m_log_ret", "spx_log_ret", "dxy_log_ret",
    "nasdaq_log_ret", "gold_log_ret", "us10y_diff", "vix_log_ret", "total3_log_ret", "ssr_diff",
    "flippening_close_diff", "social_vol_spread", "vol_acceleration", "usdt_log_ret", "usdc_log_ret",
)
CORRELATION_FEATURES = (
    "btc_log_ret", "spx_log_ret", "nasdaq_log_ret", "dxy_log_ret", "us10y_diff", "vix_log_ret",
    "total3_log_ret", "cb_premium_diff_btc", "ssr_diff", "funding_rate_diff_btc",
)

# Regressors of the inflation and structural-break diagnostics.
VIF_FEATURES = ("spx_log_ret", "nasdaq_log_ret", "dxy_log_ret", "vix_log_ret", "gold_log_ret", "us10y_diff")
BREAK_CONTROLS = ("dxy_log_ret", "vix_log_ret", "gold_log_ret", "us10y_diff")
BREAK_CANDIDATES = ("spx_log_ret", "nasdaq_log_ret")
