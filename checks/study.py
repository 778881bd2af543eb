"""The indicator catalogue and the feature recipes on stand-in raw tables.

The raw indicator files are not part of the test data. Every one is replaced by
a slice of the daily shipping panel with the file's own column names and day
encoding, moved into the study's calendar.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from checks.panels import (
    EVENTS_END, EVENTS_START, END, OHLC, SHIP, START, W, events_ohlc, ln, r, rows, scratch, ship_daily, table,
)
from checks.registry import ORACLES, query, r6, rounded
from checks.sql_models import adf, f_tail, granger, ols, tau_tail
from checks.profiling import _chow_out, _chow_sql, _corr_sql, _describe_sql, _melted, _report_sql, _vif_sql
from dayloom.functions import scalar
from dayloom.operators import calendar, correlation, profile, regression
from dayloom.operators import granger as causality
from dayloom.operators import unit_root
from dayloom.plans import catalog, consolidate, recipes, variants
from dayloom.session import ensure_checkpoint_dir
from dayloom.sources import sinks
from dayloom.sources.readers import load_feature_table, parse_day

SHIFT = 8034  # days from the test data's first shipping week to the calendar's

FUNDING = dict(zip(catalog.FUNDING_RATES, ("disc", "tax", "case when qty > 100 then disc end", "case when n > 3 then tax end")))

# raw file -> (shipping group, column -> expression valid in both engines)
STANDINS = {
    "price_btc": ("AF", {"open": "lo", "high": "hi", "low": "lo", "close": "price", "RVI": "qty"}),
    "2017_fundingRateCEXs": ("AO", FUNDING),
    "2010_supply_held_miners_whales": ("NF", {"Supply held by Miners": "price"}),
    "2010_supply_on_exchanges_perc": ("NO", {"Supply on Exchanges (as % of total supply)": "disc"}),
    "2015_transactionVolumeEth": ("RF", {"Transaction Volume (ETH)": "case when qty < 60 then 0.0 else price end"}),
    "2018_coinbase_premium_index": ("RO", {"close": "disc - tax"}),
    "2017_mvrv_z_score": ("AF", {"Plot": "case when tax > 0.1 then tax end"}),
    "2010_whale_transaction_count_btc_2": ("AO", {"Whale Transaction Count (>1m USD)": "cast(n as double)", "Whale Transaction Count (>100k USD)": "qty"}),
    "2014_SP500_PRICE": ("NF", {"close": "hi"}),
    "dxy_new": ("NO", {"dxy_close_new": "price"}),
    "nasdaq": ("RF", {"Close/Last": "price"}),
    "201501_PRICE_GOLD": ("RO", {"close": "price"}),
    "201501_US10Y": ("AF", {"close": "disc"}),
    "201501_VIX": ("AO", {"close": "price"}),
    "201501_mkcap_total3": ("NF", {"close": "price"}),
    "201404_ssr": ("NO", {"SSR": "qty"}),
    "201809_Flippening_Ratio_Diff": ("RF", {"close": "disc"}),
    "2012_btc_altcoin_social_metrics": ("RO", {catalog.SOCIAL_BTC: "qty", catalog.SOCIAL_ALT: "cast(n as double)", catalog.SOCIAL_NAMED: "disc"}),
    "201501_dominance_usdt": ("AF", {"close": "hi"}),
}


def _encoded(source: catalog.Source):
    noon = F.unix_timestamp(F.col("day").cast("timestamp")) + 43200
    if source.encoding == "epoch":
        return noon.cast("long")
    if source.encoding == "iso":
        return F.date_format("day", "yyyy-MM-dd'T'12:00:00+00:00")
    return F.date_format("day", source.fmt)


def shipping(spark, sf) -> DataFrame:
    """The shipping panel in the study's calendar, computed once."""
    ensure_checkpoint_dir(spark)
    daily = ship_daily(spark, sf).withColumn("day", F.date_add("day", SHIFT))
    return daily.checkpoint()


def raw_tables(spark, sf, further: dict | None = None) -> dict[str, DataFrame]:
    daily = shipping(spark, sf)
    return {
        name: daily.filter(F.col("series") == group).select(
            _encoded(catalog.SOURCES[name]).alias(catalog.SOURCES[name].day),
            *[F.expr(expr).alias(column) for column, expr in columns.items()],
        )
        for name, (group, columns) in (STANDINS | (further or {})).items()
    }


def wide_table(spark, sf) -> DataFrame:
    return consolidate.consolidated(raw_tables(spark, sf))


# SQL for the same table. What is expected of each indicator is written out here
# and not taken from the catalogue:
# level, change, stand-in group, value, fill, transform, rows before, in use.
_MEAN_OF_FUNDING = (
    "(coalesce(disc, 0) + coalesce(tax, 0) + coalesce(case when qty > 100 then disc end, 0) "
    "+ coalesce(case when n > 3 then tax end, 0)) / nullif(cast(disc is not null as integer) "
    "+ cast(tax is not null as integer) + cast(case when qty > 100 then disc end is not null as integer) "
    "+ cast(case when n > 3 then tax end is not null as integer), 0)"
)
_FROM_2017 = "day > date '2017-01-02'"
_FROM_MARKET = "day > date '2017-01-03'"
_FROM_START = "day > date '2016-12-31'"
EXPECTED = (
    ("btc_price_close", "btc_log_ret", "AF", "price", "", "ratio", "file", _FROM_START),
    ("rvi_close", "rvi_diff", "AF", "qty", "", "step", "day", _FROM_START),
    ("total_funding_rate_btc", "funding_rate_diff_btc", "AO", _MEAN_OF_FUNDING, "", "step", "file", _FROM_START),
    ("supply_held_by_miners_btc", "miner_net_pos_change_log", "NF", "price", "", "ratio", "day", _FROM_START),
    ("supply_on_exchanges_perc_btc", "exchange_supply_diff_btc", "NO", "disc", "", "step", "day", _FROM_START),
    ("cb_premium_usd", "cb_premium_diff_btc", "RO", "disc - tax", "", "step", "day", "day >= date '2020-03-11'"),
    ("mvrv_close", "mvrv_diff_btc", "AF", "case when tax > 0.1 then tax end", "", "step", "day", _FROM_2017),
    ("whale_transaction_count_100k_btc", "whale_100k_log_ret", "AO", "qty", "zero first", "ratio + 1", "day", _FROM_2017),
    ("whale_transaction_count_1M_btc", "whale_1m_log_ret", "AO", "cast(n as double)", "zero first", "ratio + 1", "day", _FROM_2017),
    ("transaction_volume_eth", "eth_vol_log_ret", "RF", "nullif(case when qty < 60 then 0.0 else price end, 0)", "last", "ratio", "day", _FROM_2017),
    ("spx_close", "spx_log_ret", "NF", "hi", "last", "ratio", "day", _FROM_MARKET),
    ("dxy_close", "dxy_log_ret", "NO", "price", "last", "ratio", "day", _FROM_MARKET),
    ("nasdaq_close", "nasdaq_log_ret", "RF", "price", "last", "ratio", "day", _FROM_MARKET),
    ("gold_close", "gold_log_ret", "RO", "price", "last", "ratio", "day", _FROM_MARKET),
    ("us10y_close", "us10y_diff", "AF", "disc", "last", "step", "day", _FROM_MARKET),
    ("vix_close", "vix_log_ret", "AO", "price", "last", "ratio", "day", _FROM_MARKET),
    ("total3_close", "total3_log_ret", "NF", "price", "last", "ratio", "day", _FROM_MARKET),
    ("ssr", "ssr_diff", "NO", "qty", "last", "step", "day", _FROM_MARKET),
    ("flippening_close", "flippening_close_diff", "RF", "disc", "last", "step", "day", "day > date '2020-01-01'"),
    ("btc_social_volume", None, "RO", "qty", "zero last", "", "day", "true"),
    ("btc_log_vol", None, "RO", "ln(1 + qty)", "zero last", "", "day", "true"),
    ("alt_total_log_vol", None, "RO", "ln(1 + n + disc)", "zero last", "", "day", "true"),
    ("social_vol_spread", "vol_acceleration", "RO", "ln(1 + qty) - ln(1 + n + disc)", "zero last", "step", "day", "true"),
    ("usdt_dominance", "usdt_log_ret", "AF", "hi", "last", "ratio", "day", _FROM_MARKET),
)
EXPECTED_USDC = ("usdc_dominance", "usdc_log_ret", "RO", "hi", "last", "ratio", "day", "true")
_LAST = "last_value(v ignore nulls) over (order by day rows between unbounded preceding and current row)"


def _feature_sql(i, level, change, group, value, fill, transform, before, in_use) -> str:
    x = {"last": _LAST, "zero first": "coalesce(v, 0)"}.get(fill, "v")
    b = "fb" if before == "file" else "lag(x) over (order by day)"
    step = {
        "ratio": f"{ln('x')} - {ln('b')}", "ratio + 1": "ln(x + 1) - ln(b + 1)", "step": "x - b",
    }.get(transform, "cast(null as double)")
    held = "coalesce(x, 0)" if fill == "zero last" else "x"
    step = f"coalesce({step}, 0)" if fill == "zero last" else step
    return f"""r{i} as (select cast(day + {SHIFT} as date) as day, cast({value} as double) as v from ship where series = '{group}'),
s{i} as (select *, lag(v) over (order by day) as fb from r{i}),
a{i} as (select c.day, s.v, s.fb from study_days c left join s{i} s on s.day = c.day),
x{i} as (select day, fb, {x} as x from a{i}), b{i} as (select day, x, {b} as b from x{i}),
f{i} as (select day, case when {in_use} then {held} end as level, case when {in_use} then {step} end as change from b{i})"""


def _cons_sql(expected) -> str:
    """All expected columns beside the day."""
    cells = []
    for i, (level, change, *_) in enumerate(expected):
        cells.append(f"f{i}.level as {level}")
        if change:
            cells.append(f"f{i}.change as {change}")
    return (
        f"{SHIP}, {STUDY_DAYS},\n"
        + ",\n".join(_feature_sql(i, *row) for i, row in enumerate(expected))
        + ",\ncons as materialized (select c.day, cast(isodow(c.day) in (6, 7) as integer) as is_weekend, "
        + ", ".join(cells)
        + " from study_days c "
        + " ".join(f"left join f{i} on f{i}.day = c.day" for i in range(len(expected)))
        + ")"
    )


_COLUMNS = [c for level, change, *_ in EXPECTED for c in (level, change) if c]

STUDY_DAYS = f"""study_days as (select cast(unnest(generate_series(date '{calendar.SPINE_START}', date '{calendar.SPINE_END}', interval 1 day)) as date) as day)"""
CONS = _cons_sql(EXPECTED)
# What the analyses read: cut, and each era labelled.
FEAT = f"{CONS}, feat as (select *, case when day < date '{calendar.ERA_CUT}' then 'retail' else 'institutional' end as era from cons where day > date '2017-01-03')"
FEAT_BOTH = f"{FEAT}, eras as (select * from feat union all select * replace ('retail' as era) from feat where day = date '{calendar.ERA_CUT}')"


@query("consolidated_table", f"with {CONS} select day, is_weekend, {', '.join(f'{r(c)} as {c}' for c in _COLUMNS)} from cons")
def consolidated_table(spark, sf):
    return rounded(wide_table(spark, sf), *_COLUMNS)


def features(spark, sf) -> DataFrame:
    return load_feature_table(wide_table(spark, sf))


@query("study_describe_by_era", f"with {FEAT} " + _describe_sql("feat", list(catalog.TRANSFORMED), "era", even=True))
def study_describe_by_era(spark, sf):
    out = profile.describe_by_era(calendar.assign_era(features(spark, sf), "day"), list(catalog.TRANSFORMED), grain="day")
    return out.withColumns({s: F.col(s) + 0.0 for s in profile.STATISTICS if s != "count"})


@query("study_correlation_by_era", f"with {FEAT_BOTH} " + _corr_sql("eras", list(catalog.CORRELATION_FEATURES), "era"))
def study_correlation_by_era(spark, sf):
    return rounded(correlation.correlation_by_era(features(spark, sf), list(catalog.CORRELATION_FEATURES), "day"), "r")


# The first half of the heat map's list, and the second half of the list that
# ends with the target once more; written out.
HALF_1 = [
    "btc_log_ret", "rvi_diff", "funding_rate_diff_btc", "miner_net_pos_change_log", "exchange_supply_diff_btc",
    "cb_premium_diff_btc", "mvrv_diff_btc", "whale_100k_log_ret", "whale_1m_log_ret", "spx_log_ret", "dxy_log_ret",
]
HALF_2 = [
    "nasdaq_log_ret", "gold_log_ret", "us10y_diff", "vix_log_ret", "total3_log_ret", "ssr_diff", "flippening_close_diff",
    "social_vol_spread", "vol_acceleration", "usdt_log_ret", "usdc_log_ret", "btc_log_ret",
]
FEAT_USDC = (
    f"{_cons_sql((*EXPECTED, EXPECTED_USDC))}, feat as (select *, case when day < date '{calendar.ERA_CUT}' then 'retail' "
    f"else 'institutional' end as era from cons where day > date '2017-01-03'), eras as (select * from feat union all "
    f"select * replace ('retail' as era) from feat where day = date '{calendar.ERA_CUT}')"
)


@query(
    "study_correlation_halves",
    f"with {FEAT_USDC} " + " union all ".join(f"select {i} as half, * from ({_corr_sql('eras', half, 'era')})" for i, half in enumerate((HALF_1, HALF_2), 1)),
)
def study_correlation_halves(spark, sf):
    raw = raw_tables(spark, sf, {"201901_dominance_usdc": ("RO", {"close": "hi"})})
    rows_ = load_feature_table(consolidate.consolidated(raw, [*catalog.FEATURES, catalog.USDC]))
    first, _ = correlation.halves(catalog.HEAT_MAP_FEATURES)
    _, second = correlation.halves([*catalog.HEAT_MAP_FEATURES, catalog.TARGET])
    parts = [
        correlation.correlation_by_era(rows_, half, "day").withColumn("half", F.lit(i))
        for i, half in enumerate((first, second), 1)
    ]
    return rounded(parts[0].unionByName(parts[1]), "r")


_STUDY_VIF = _vif_sql("feat", list(catalog.VIF_FEATURES))


@query("study_vif", f"with {FEAT}, {_STUDY_VIF[0]} {_STUDY_VIF[1]}")
def study_vif(spark, sf):
    return regression.vif(features(spark, sf), list(catalog.VIF_FEATURES)).withColumn("vif", F.col("vif") + 0.0)


_ROTATED = "rot as (" + " union all ".join(
    f"select '{c}' as model, day, {catalog.TARGET}, {', '.join(catalog.BREAK_CONTROLS)}, {c} as candidate from feat" for c in catalog.BREAK_CANDIDATES
) + ")"


@query(
    "chow_rotation",
    f"with {FEAT}, {_ROTATED}, "
    + _chow_sql(
        "rot", ["model"], f"case when day < date '{calendar.ERA_CUT}' then 'retail' else 'institutional' end",
        calendar.ERA_LABELS, catalog.TARGET, [*catalog.BREAK_CONTROLS, "candidate"],
    )
    + " select * from chow",
)
def chow_rotation(spark, sf):
    tests = regression.chow_rotation(
        features(spark, sf), catalog.TARGET, list(catalog.BREAK_CONTROLS), list(catalog.BREAK_CANDIDATES), "day"
    )
    return _chow_out(tests, "model")


_ADF_LONG = "lg as (" + " union all ".join(f"select '{c}' as variable, day, {c} as x from feat where {c} is not null" for c in catalog.TRANSFORMED) + ")"


@query(
    "study_adf_report",
    f"""with {FEAT}, {_ADF_LONG}, names as (select unnest({list(catalog.TRANSFORMED)}) as variable),
    kind as (select variable, count(*) as n, min(x) as low, max(x) as high from lg group by 1),
    src as (select lg.* from lg join kind on kind.variable = lg.variable where n >= 20 and low < high),
    {adf('u', 'src', ['variable'], 'day', 29)},
    rep as (select variable, statistic, {tau_tail('statistic')} as p from u)
    select names.variable, round_even(statistic, 4) + 0.0 as statistic, round_even(p, 6) + 0.0 as p_value,
    case when coalesce(kind.n, 0) < 20 then 'insufficient data' when low = high then 'error: constant series'
      when p < 0.05 then 'stationary' else 'not stationary' end as verdict
    from names left join kind on kind.variable = names.variable left join rep on rep.variable = names.variable""",
)
def study_adf_report(spark, sf):
    out = unit_root.adf_report(features(spark, sf), ["day"], list(catalog.TRANSFORMED))
    return out.withColumns({"statistic": F.col("statistic") + 0.0, "p_value": F.col("p_value") + 0.0})


@query(
    "study_granger_by_era",
    f"with {FEAT_BOTH}, {_melted('eras', catalog.TARGET, catalog.CAUSALITY_FEATURES, ['era'])}, "
    f"{granger('g', 'mp', ['era', 'feature'], 'day', 5)}, {_report_sql(['era'])}",
)
def study_granger_by_era(spark, sf):
    out = causality.granger_by_era(features(spark, sf), catalog.TARGET, list(catalog.CAUSALITY_FEATURES), "day")
    return out.withColumn("p_value", F.col("p_value") + 0.0)


# A lag column is constant when the values it can hold, all but the first or
# last few of the series, are one value.
_LAG_RANGES = [(5 - k, k) for k in range(1, 6)]


@query(
    "study_granger_skipped",
    f"""with {FEAT_BOTH}, {_melted('eras', catalog.TARGET, catalog.CAUSALITY_FEATURES, ['era'])},
    every as (select era, feature from (select distinct era from eras) cross join (select unnest({list(catalog.CAUSALITY_FEATURES)}) as feature)),
    num as (select *, row_number() over (partition by era, feature order by day) as rn, count(*) over (partition by era, feature) as n from mp),
    kind as (select era, feature, max(n) as n, """
    + " or ".join(
        f"min({c}) filter (where rn > {a} and rn <= n - {z}) = max({c}) filter (where rn > {a} and rn <= n - {z})"
        for c in "yx"
        for a, z in _LAG_RANGES
    )
    + """ as flat from num group by 1, 2)
    select every.era, every.feature, case when coalesce(kind.n, 0) <= 16 then 'insufficient rows' else 'constant lag column' end as reason
    from every left join kind on kind.era = every.era and kind.feature = every.feature where coalesce(kind.n, 0) <= 16 or flat""",
)
def study_granger_skipped(spark, sf):
    rows_ = features(spark, sf)
    names = list(catalog.CAUSALITY_FEATURES)
    tests = causality.granger_tests_by_era(rows_, catalog.TARGET, names, "day")
    panel = calendar.assign_era(rows_, "day", boundary="both").select("era").distinct()
    return causality.granger_skipped(tests, names, ["era"], panel)


@query(
    "study_era_calendar",
    f"""with {SHIP}, {STUDY_DAYS}, d as (select day, case when day < date '{calendar.ERA_CUT}' then 'retail' else 'institutional' end as era from study_days
      union all select day, 'retail' from study_days where day = date '{calendar.ERA_CUT}'),
    n as (select cast(day + {SHIFT} as date) as day, sum(n) as lines from ship group by 1)
    select d.era, count(*) as days, cast(sum(coalesce(n.lines, 0)) as bigint) as lines from d left join n on n.day = d.day group by 1""",
)
def study_era_calendar(spark, sf):
    lines = table(spark, sf, "lineitem").groupBy(F.date_add(F.to_date("l_shipdate"), SHIFT).alias("day")).agg(F.count(F.lit(1)).alias("lines"))
    eras = calendar.era_calendar(spark).join(lines, "day", "left")
    return eras.groupBy("era").agg(F.count(F.lit(1)).alias("days"), F.sum(F.coalesce("lines", F.lit(0))).alias("lines"))


# Recipes outside the consolidated table

BY = ["series"]
SPINE_SHIP = f"""{SHIP}, cal as (select cast(unnest(generate_series(date '{START}', date '{END}', interval 1 day)) as date) as day),
sp as (select s.series, c.day from (select distinct series from ship) s cross join cal c),
al as (select sp.series, sp.day, qty, price, disc, tax, n, hi, lo from sp left join ship on ship.series = sp.series and ship.day = sp.day)"""
_UP = "(partition by series order by day rows between unbounded preceding and current row)"
_DOWN = "(partition by series order by day rows between current row and unbounded following)"


def _gate(x, n, expr, need=None):
    return f"(case when count({x}) over {rows(n)} >= {need or n} then {expr} end)"


def _z(x, n, need=None, eps=" + 1e-9"):
    spread = _gate(x, n, f"stddev_samp({x}) over {rows(n)}", need)
    z = f"({x} - {_gate(x, n, f'avg({x}) over {rows(n)}', need)}) / nullif({spread}{eps}, 0)"
    return f"(case when {spread} = 0 then {x} * 0 else {z} end)" if eps else f"({z})"


def _ma(x, n):
    return _gate(x, n, f"avg({x}) over {rows(n)}")


def _linear(panel, x):
    return f"""nb as (select *, last_value(case when {x} is not null then day end ignore nulls) over {_UP} as pd, last_value({x} ignore nulls) over {_UP} as pv,
  first_value(case when {x} is not null then day end ignore nulls) over {_DOWN} as nd, first_value({x} ignore nulls) over {_DOWN} as nv from {panel}),
  ip as (select *, coalesce({x}, pv + (nv - pv) * (date_diff('day', pd, day) * 1.0 / nullif(date_diff('day', pd, nd), 0)), pv) as x from nb)"""


@query("target_price", f"with {SPINE_SHIP} select series, day, {r('price')} as price from al where day > date '1995-01-01'")
def target_price(spark, sf):
    return rounded(variants.target_price(ship_daily(spark, sf), BY, "day", "price", START, END, "1995-01-01"), "price")


@query(
    "ohlc_features",
    f"""with {OHLC}, x as (select *, {ln(f'(close / lag(close) over {W})')} as ret, (close - open) / ((high - low) + 1e-9) as vigor from oh)
    select * from (select series, day, {r('close')} as close, {r('ret')} as log_ret, {r(_ma('vigor', 10))} as vigor_ma10,
    {r(_gate('ret', 10, f'stddev_samp(ret) over {rows(10)}') + ' * sqrt(365)')} as hv10 from x)
    where day between date '{EVENTS_START}' and date '{EVENTS_END}'""",
)
def ohlc_features(spark, sf):
    out = variants.ohlc_features(events_ohlc(spark, sf), BY, "day", EVENTS_START, EVENTS_END)
    return rounded(out, "close", "log_ret", "vigor_ma10", "hv10")


@query(
    "funding_percent",
    f"""with {SPINE_SHIP}, p as (select series, day, (coalesce(disc, 0) + coalesce(tax, 0)) / nullif(cast(disc is not null as integer)
      + cast(tax is not null as integer), 0) * 100 as p from al)
    select series, day, {r('coalesce(p, 0)')} as rate_pct, {r(f'coalesce({_ma("p", 7)}, 0)')} as rate_ma7 from p""",
)
def funding_percent(spark, sf):
    out = variants.funding_percent(ship_daily(spark, sf), BY, "day", ["disc", "tax"], START, END)
    return rounded(out, "rate_pct", "rate_ma7")


@query(
    "share_of_supply",
    f"""with {SHIP}, tot as (select day, round(sum(price), 2) as total from ship group by 1), j as (select ship.*, tot.total from ship left join tot on tot.day = ship.day),
    cal as (select cast(unnest(generate_series(date '{START}', date '{END}', interval 1 day)) as date) as day),
    sp as (select s.series, c.day from (select distinct series from ship) s cross join cal c)
    select sp.series, sp.day, {r('price / nullif(total, 0) * 100')} as price_pct, {r('disc')} as disc from sp left join j on j.series = sp.series and j.day = sp.day""",
)
def share_of_supply(spark, sf):
    daily = ship_daily(spark, sf)
    supply = daily.groupBy("day").agg(F.round(F.sum("price"), 2).alias("total"))
    out = variants.share_of_supply(daily, supply, ["day"], BY, "day", "price", "total", ["disc"], START, END)
    return rounded(out, "price_pct", "disc")


@query(
    "flow_trend",
    f"""with {SPINE_SHIP}, c as (select series, day, disc - lag(disc) over {W} as change from al),
    t as (select series, day, change, {_ma('change', 7)} as trend_7, {_z('change', 30)} as z_30 from c)
    select series, day, {r('change')} as change, {r('trend_7')} as trend_7, {r('z_30')} as z_30 from t
    where change is not null and trend_7 is not null and z_30 is not null""",
)
def flow_trend(spark, sf):
    return rounded(variants.flow_trend(ship_daily(spark, sf), BY, "day", "disc", START, END), "change", "trend_7", "z_30")


@query(
    "divergence_trend",
    f"""with {SPINE_SHIP} select series, day, {r('disc')} as disc, {r(_ma('disc', 30))} as trend_30,
    {r(f'last_value(qty ignore nulls) over {_UP}')} as qty from al""",
)
def divergence_trend(spark, sf):
    out = variants.divergence_trend(ship_daily(spark, sf), BY, "day", "disc", "qty", START, END)
    return rounded(out, "disc", "trend_30", "qty")


@query(
    "premium_trend",
    f"""with {SPINE_SHIP}, z as (select series, day, coalesce(disc, 0) as disc from al)
    select series, day, {r('disc')} as disc, {r(f'coalesce({_ma("disc", 7)}, 0)')} as trend_7, {r(f'coalesce({_z("disc", 30)}, 0)')} as z_30 from z""",
)
def premium_trend(spark, sf):
    out = variants.premium_trend(ship_daily(spark, sf).select("series", "day", "disc"), BY, "day", "disc", START, END)
    return rounded(out, "disc", "trend_7", "z_30")


@query(
    "interpolated_oscillator",
    f"""with {SPINE_SHIP}, {_linear('al', 'disc')}, b as (select series, day, coalesce(x, nv) as x from ip)
    select series, day, {r('coalesce(x, 0)')} as disc, {r(f'coalesce(x - lag(x) over {W}, 0)')} as change,
    {r(f'coalesce({_ma("x", 30)}, 0)')} as ma_30, {r(f'coalesce({_z("x", 365, 30)}, 0)')} as z_365 from b""",
)
def interpolated_oscillator(spark, sf):
    rows_ = ship_daily(spark, sf).select("series", "day", "disc")
    out = variants.interpolated_oscillator(rows_, BY, "day", "disc", START, END)
    return rounded(out, "disc", "change", "ma_30", "z_365")


@query(
    "rolling_pair_correlation",
    f"""with {SPINE_SHIP}, f as (select series, day, price, last_value(qty ignore nulls) over {_UP} as qty from al),
    x as (select *, {ln(f'(price / lag(price) over {W})')} as a, {ln(f'(qty / lag(qty) over {W})')} as b from f),
    y as (select series, day, qty, a, case when b is not null then a end as ma, case when a is not null then b end as mb from x),
    c as (select *, case when count(ma) over {rows(5)} >= 5 then covar_samp(ma, mb) over {rows(5)}
      / nullif(stddev_samp(ma) over {rows(5)} * stddev_samp(mb) over {rows(5)}, 0) end as corr from y)
    select series, day, {r('qty')} as qty, {r('a')} as asset_log_ret, {r(f'first_value(corr ignore nulls) over {_DOWN}')} as corr from c""",
)
def rolling_pair_correlation(spark, sf):
    out = variants.rolling_pair_correlation(ship_daily(spark, sf), BY, "day", "price", "qty", START, END, 5)
    return rounded(out, "qty", "asset_log_ret", "corr")


@query(
    "log_level_change",
    f"""with {SHIP}, x as (select series, day, price, ln(price + 1) as l from ship)
    select series, day, {r('price')} as price, {r('l')} as log_level, {r(f'l - lag(l) over {W}')} as log_diff from x""",
)
def log_level_change(spark, sf):
    return rounded(variants.log_level_change(ship_daily(spark, sf), BY, "day", "price"), "price", "log_level", "log_diff")


@query(
    "change_zscore",
    f"""with {SHIP}, c as (select series, day, qty, qty - lag(qty) over {W} as change from ship)
    select series, day, {r('qty')} as qty, {r('coalesce(change, 0)')} as change, {r(f'coalesce({_z("change", 30, eps="")}, 0)')} as z from c""",
)
def change_zscore(spark, sf):
    return rounded(variants.change_zscore(ship_daily(spark, sf), BY, "day", "qty"), "qty", "change", "z")


@query(
    "weekly_breadth",
    f"""with {SHIP}, wk as (select series, cast(date_trunc('week', day) as date) as day, ln(sum(qty) + 1) as v from ship group by 1, 2),
    ends as (select series, min(day) as a, max(day) as b from wk group by 1),
    own as (select series, cast(unnest(generate_series(a, b, interval 1 day)) as date) as day from ends),
    al as (select own.series, own.day, wk.v from own left join wk on wk.series = own.series and wk.day = own.day),
    {_linear('al', 'v')}, z as (select series, day, {_z('x', 30, eps='')} as z from ip)
    select series, day, {r(f'coalesce(first_value(z ignore nulls) over {_DOWN}, 0)')} as z from z""",
)
def weekly_breadth(spark, sf):
    weekly = ship_daily(spark, sf).groupBy("series", F.trunc("day", "week").alias("day")).agg(F.sum("qty").alias("qty"))
    return rounded(variants.weekly_breadth(weekly, BY, "day", "qty"), "z")


@query(
    "level_and_change",
    f"""with {SPINE_SHIP}, x as (select series, day, disc, disc - lag(disc) over {W} as level_diff, qty, {ln('qty')} - {ln(f'lag(qty) over {W}')} as ret from al)
    select series, day, {r('disc')} as disc, {r('level_diff')} as level_diff, {r('qty')} as qty, {r('ret')} as count_log_ret from x where day > date '1995-01-31'""",
)
def level_and_change(spark, sf):
    out = variants.level_and_change(ship_daily(spark, sf), BY, "day", "disc", "qty", START, END, "1995-01-31")
    return rounded(out, "disc", "level_diff", "qty", "count_log_ret")


@query(
    "interpolated_level",
    f"""with {SPINE_SHIP}, {_linear('al', 'disc')} select series, day, {r(f'first_value(x ignore nulls) over {_DOWN}')} as disc from ip""",
)
def interpolated_level(spark, sf):
    return rounded(variants.interpolated_level(ship_daily(spark, sf), BY, "day", "disc", START, END), "disc")


@query(
    "social_spread",
    f"""with {SPINE_SHIP}, l as (select series, day, ln(1 + qty) - (ln(1 + disc) + ln(1 + tax)) as s from al)
    select series, day, {r('coalesce(s, 0)')} as log_spread, {r(f'coalesce(s - lag(s) over {W}, 0)')} as momentum from l""",
)
def social_spread(spark, sf):
    return rounded(variants.social_spread(ship_daily(spark, sf), BY, "day", "qty", ["disc", "tax"], START, END), "log_spread", "momentum")


@query(
    "market_noise",
    f"""with {SHIP}, l as (select series, day, ln(1 + qty) as a, ln(1 + disc) + ln(1 + tax) as b from ship),
    x as (select series, day, a - b as s, a + b as t from l)
    select series, day, {r('s')} as log_spread, {r(f'coalesce(s - lag(s) over {W}, 0)')} as momentum, {r(f'coalesce({_z("t", 30, eps="")}, 0)')} as noise_z from x""",
)
def market_noise(spark, sf):
    out = variants.market_noise(ship_daily(spark, sf), BY, "day", "qty", ["disc", "tax"])
    return rounded(out, "log_spread", "momentum", "noise_z")


@query(
    "filled_log_return",
    f"""with {SPINE_SHIP}, f as (select series, day, last_value(price ignore nulls) over {_UP} as price from al),
    x as (select series, day, price, {ln('price')} - {ln(f'lag(price) over {W}')} as ret from f)
    select series, day, {r('price')} as price, {r('ret')} as log_ret from x where day > date '1995-01-03'""",
)
def filled_log_return(spark, sf):
    out = variants.filled_log_return(ship_daily(spark, sf), BY, "day", "price", START, END, "1995-01-03")
    return rounded(out, "price", "log_ret")


# Files of the single recipes: from CSV, with a further column in front and the
# others in reverse order, to typed days and values.
RECIPE_FILES = {
    "201901_dominance_usdc": ("AF", 1), "2010_whale_transaction_count_btc": ("AO", 0),
    "2010_whale_transaction_count_eth": ("NF", 0), "2011_btcS&P500_divergence_rsi_volatilly": ("NO", 2),
    "2015_supply_held_by_exchanges_top_wallets": ("RF", 3), "2015_supply_held_by_exchanges_top_wallets_2": ("RO", 3),
    "2017_eth_social_metrics": ("AF", 4), "eth_social_metrics": ("AO", 4), "201501_DXY": ("NF", 1),
    "201501_NASDAQ": ("NO", 1), "2015_institutional_Eth_accumulation": ("RF", 1),
    "2012_flippening_especulacao_ganancia": ("RO", 0),
}


@query(
    "recipe_files",
    f"with {SHIP} "
    + " union all ".join(
        f"select '{name}' as source, count(*) as n, min(day) + {SHIFT} as first_day, max(day) + {SHIFT} as last_day, "
        f"{r(f'coalesce(sum({width} * price), 0)', 2)} as total from ship where series = '{group}'"
        for name, (group, width) in RECIPE_FILES.items()
    ),
)
def recipe_files(spark, sf):
    folder, daily = scratch(spark, "recipes"), shipping(spark, sf)
    for name, (group, _) in RECIPE_FILES.items():
        source = catalog.SOURCES[name]
        fields = StructType.fromDDL(source.schema).fields
        columns = [
            (_encoded(source) if f.name == source.day else F.col("price")).alias(f.name) for f in reversed(fields)
        ]
        on_file = daily.filter(F.col("series") == group).select(F.lit("x").alias("not declared"), *columns)
        sinks.write_table(on_file.coalesce(1), f"{folder}/{name}.csv", "csv")
    parts = []
    for name, df in consolidate.read_sources(spark, folder, RECIPE_FILES).items():
        source = catalog.SOURCES[name]
        values = [F.coalesce(F.col(f"`{c}`"), F.lit(0.0)) for c in df.columns if c != source.day]
        day = parse_day(source.day, source.encoding, source.fmt)
        total = F.sum(sum(values, F.lit(0.0)))
        parts.append(
            df.agg(
                F.count(F.lit(1)).alias("n"), F.min(day).alias("first_day"), F.max(day).alias("last_day"),
                r6(total, 2).alias("total"),
            ).withColumn("source", F.lit(name))
        )
    return reduce(DataFrame.unionByName, parts)


# Every recipe from CSV files to its result. A file holds a slice of a panel; what is
# expected is the SQL of the query with the same steps, on that slice.
_LEVELS = {"nasdaq": ("201501_NASDAQ", "AO"), "gold": ("201501_PRICE_GOLD", "NF"), "us10y": ("201501_US10Y", "NO"), "vix": ("201501_VIX", "RF")}
# folder -> raw file -> (panel, group, column -> expression)
RECIPE_TABLES = {
    "main": {
        "price_btc": ("ship", "AF", {"close": "price"}),
        "2014_SP500_PRICE": ("ship", "AF", {"close": "qty"}),
        "2017_fundingRateCEXs": ("ship", "AO", dict(zip(catalog.FUNDING_RATES, ("disc", "tax", "cast(null as double)", "cast(null as double)")))),
        "2010_supply_held_miners_whales": ("ship", "NF", {
            "Supply held by Miners": "price", "Percent of Stablecoin Total Supply held by Whales with more than 5 million USD": "disc",
        }),
        "2009_supply_circulation_btc": ("total", None, {"Total Supply": "total"}),
        "2010_supply_on_exchanges_perc": ("ship", "NO", {"Supply on Exchanges (as % of total supply)": "disc"}),
        "2011_btcS&P500_divergence_rsi_volatilly": ("ship", "RF", {"BTC and S&P 500 Price Divergence": "disc", "RSI 1d": "qty"}),
        "2018_coinbase_premium_index": ("ship", "RO", {"close": "disc"}),
        "2017_mvrv_z_score": ("ship", "AF", {"Plot": "disc"}),
        "2015_transactionVolumeEth": ("ship", "AO", {"Transaction Volume (ETH)": "price"}),
        "2015_supply_held_by_exchanges_top_wallets": ("ship", "NF", {"Supply on Exchanges (as % of total supply) (ETH)": "qty"}),
        "2017_eth_social_metrics": ("weekly", "NO", {"Social Volume (ETH)": "qty"}),
        "eth_social_metrics": ("ship", "RF", {"Social Dominance (ETH)": "disc", "Social Volume (ETH)": "qty"}),
        "201501_mkcap_total3": ("ship", "RO", {"close": "price"}),
        "201404_ssr": ("ship", "AF", {"SSR": "qty"}),
        "201809_Flippening_Ratio_Diff": ("ship", "AO", {"close": "disc"}),
        "2012_btc_altcoin_social_metrics": ("ship", "NF", {catalog.SOCIAL_BTC: "qty", catalog.SOCIAL_ALT: "disc", catalog.SOCIAL_NAMED: "tax"}),
        "201901_dominance_usdc": ("ship", "NO", {"close": "price"}),
        **{source: ("ship", group, {"close": "disc"}) for source, group in _LEVELS.values()},
    },
    "other": {
        "price_btc": ("events", "view", {c: c for c in ("open", "high", "low", "close")}),
        "2014_SP500_PRICE": ("ship", "RO", {"close": "disc"}),
    },
}


def _difference_sql(x):
    return f"with {SHIP} select series, day, {r(x)} as {x}, {r(f'{x} - lag({x}) over {W}')} as diff from ship"


# recipe -> (folder, SQL, group, first day after, {column: the SQL's column})
RECIPE_CASES = {
    "target_price": ("main", "target_price", "AF", "1995-01-01", {"price": "price"}),
    "ohlc": ("other", "ohlc_features", "view", None, {c: c for c in ("close", "log_ret", "vigor_ma10", "hv10")}),
    "funding_percent": ("main", "funding_percent", "AO", None, {c: c for c in ("rate_pct", "rate_ma7")}),
    "share_of_supply": ("main", "share_of_supply", "NF", None, {"held_pct": "price_pct", "whales": "disc"}),
    "exchange_flow": ("main", "flow_trend", "NO", None, {c: c for c in ("change", "trend_7", "z_30")}),
    "divergence_trend": ("main", "divergence_trend", "RF", None, {"divergence": "disc", "trend_30": "trend_30", "rsi": "qty"}),
    "premium_trend": ("main", "premium_trend", "RO", None, {"premium": "disc", "trend_7": "trend_7", "z_30": "z_30"}),
    "mvrv_oscillator": ("main", "interpolated_oscillator", "AF", None, {"mvrv": "disc", "change": "change", "ma_30": "ma_30", "z_365": "z_365"}),
    "pair_correlation": ("main", "rolling_pair_correlation", "AF", None, {"index": "qty", "asset_log_ret": "asset_log_ret", "corr": "corr"}),
    "eth_volume": ("main", "log_level_change", "AO", None, {"volume": "price", "log_level": "log_level", "log_diff": "log_diff"}),
    "eth_exchange_supply": ("main", "change_zscore", "NF", None, {"supply": "qty", "change": "change", "z": "z"}),
    "eth_social_breadth": ("main", "weekly_breadth", "NO", None, {"z": "z"}),
    "eth_social": ("main", "level_and_change", "RF", "1995-01-31", {
        "dominance": "disc", "dominance_diff": "level_diff", "volume": "qty", "volume_log_ret": "count_log_ret",
    }),
    "sp500_level": ("other", "interpolated_level", "RO", None, {"level": "disc"}),
    **{f"{name}_level": ("main", "interpolated_level", group, None, {"level": "disc"}) for name, (_, group) in _LEVELS.items()},
    "total3": ("main", "log_level_change", "RO", None, {"total3": "price", "log_level": "log_level", "log_diff": "log_diff"}),
    "ssr": ("main", _difference_sql("qty"), "AF", None, {"ssr": "qty", "ssr_diff": "diff"}),
    "flippening": ("main", _difference_sql("disc"), "AO", None, {"ratio": "disc", "ratio_diff": "diff"}),
    "social_spread": ("main", "social_spread", "NF", None, {c: c for c in ("log_spread", "momentum")}),
    "market_noise": ("main", "market_noise", "NF", None, {c: c for c in ("log_spread", "momentum", "noise_z")}),
    "usdc_dominance": ("main", "filled_log_return", "NO", "1995-01-03", {"dominance": "price", "log_ret": "log_ret"}),
}


def _expected(recipe: str) -> str:
    _, sql, group, _, columns = RECIPE_CASES[recipe]
    named = ", ".join(f'"{theirs}"::double as "{ours}"' for ours, theirs in columns.items())
    listed = ", ".join(f'"{c}"' for c in columns)
    return (
        f"select '{recipe}' as recipe, day::date as day, name, value from (select day, {named} from ({ORACLES.get(sql, sql)}) "
        f"where series = '{group}') unpivot include nulls (value for name in ({listed}))"
    )


def _recipe_files(spark, sf) -> dict[str, str]:
    """The files of each folder, with a further column in front and the others in reverse order."""
    ship = ship_daily(spark, sf)
    panels = {
        "ship": ship.checkpoint(), "events": events_ohlc(spark, sf).checkpoint(),
        "total": ship.groupBy("day").agg(F.round(F.sum("price"), 2).alias("total")).withColumn("series", F.lit(None).cast("string")),
        "weekly": ship.groupBy("series", F.trunc("day", "week").alias("day")).agg(F.sum("qty").alias("qty")),
    }
    folders = {}
    for name, files in RECIPE_TABLES.items():
        folders[name] = scratch(spark, f"recipes-{name}")
        for file, (panel, group, columns) in files.items():
            source = catalog.SOURCES[file]
            fields = [f.name for f in reversed(StructType.fromDDL(source.schema).fields)]
            cells = [
                (_encoded(source) if c == source.day else F.expr(columns.get(c, "cast(null as double)"))).alias(c) for c in fields
            ]
            rows_ = panels[panel].filter(F.col("series").eqNullSafe(group)).select(F.lit("x").alias("not declared"), *cells)
            sinks.write_table(rows_.coalesce(1), f"{folders[name]}/{file}.csv", "csv")
    return folders


@query("recipes_from_files", " union all ".join(map(_expected, RECIPE_CASES)))
def recipes_from_files(spark, sf):
    ensure_checkpoint_dir(spark)
    folders, parts = _recipe_files(spark, sf), []
    for name, (folder, _, _, after, columns) in RECIPE_CASES.items():
        recipe = recipes.pair_correlation(5) if name == "pair_correlation" else recipes.RECIPES[name]
        start, end = (EVENTS_START, EVENTS_END) if name == "ohlc" else (START, END)
        done = rounded(recipes.run_from_files(spark, folders[folder], recipe, recipes.Calendar(start, end, after or start)), *columns)
        parts.append(done.unpivot(["recipe", "day"], list(columns), "name", "value"))
    return reduce(DataFrame.unionByName, parts)
