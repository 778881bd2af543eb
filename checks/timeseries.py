"""Window operators, row-wise expressions and long-series operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.basics import BY_DAY, aligned, filled
from checks.panels import (
    ALIGNED, EV, FILLED, OD, OHLC, OW, SHIP, W, event_rows, events_ohlc, ln, orders_daily, orders_wide, r, rows, ship_daily,
    table,
)
from checks.registry import query, r6, rounded
from dayloom.functions import scalar
from dayloom.operators import calendar, long_series, rolling
from dayloom.operators.lagged import lag_matrix as lag_matrix_of
from dayloom.operators.windows import Series, vigor_raw


def _window(name, sql, panel, columns, digits=6):
    """Register a query that adds window columns to a (series, day, value) panel."""

    @query(name, sql)
    def run(spark, sf):
        df = panel(spark, sf).withColumns(columns(BY_DAY))
        return rounded(rounded(df, "value"), *columns(BY_DAY), digits=digits)

    return run


def _al(expr, out, digits=6):
    return f"with {ALIGNED} select series, day, {r('value')} as value, {r(expr, digits)} as {out} from al"


def _ff(expr, out, digits=6):
    return f"with {FILLED} select series, day, {r('value')} as value, {r(expr, digits)} as {out} from ff"


def gate(n, value, need=None, x="value"):
    return f"(case when count({x}) over {rows(n)} >= {need or n} then {value} end)"


def mean(n, need=None, x="value"):
    return gate(n, f"avg({x}) over {rows(n)}", need, x)


def std(n, need=None, x="value"):
    return gate(n, f"stddev_samp({x}) over {rows(n)}", need, x)


_window("lag1", _al(f"lag(value) over {W}", "prev"), aligned, lambda s: {"prev": s.lag("value")})
_window("first_difference", _al(f"value - lag(value) over {W}", "diff", 3), aligned, lambda s: {"diff": s.diff("value")}, 3)
_window("log_return", _al(f"{ln('value')} - {ln(f'lag(value) over {W}')}", "ret"), aligned, lambda s: {"ret": s.log_return("value")})
_window("log_return_ratio", _al(ln(f"(value / lag(value) over {W})"), "ret"), aligned, lambda s: {"ret": s.log_return_ratio("value")})
_window(
    "log_return_shifted",
    _al(f"ln(value + 1) - ln(lag(value) over {W} + 1)", "ret"),
    aligned,
    lambda s: {"ret": s.log_return_shifted("value")},
)
_window(
    "forward_fill",
    _al("last_value(value ignore nulls) over (partition by series order by day rows between unbounded preceding and current row)", "known"),
    aligned,
    lambda s: {"known": s.forward_fill("value")},
)
_window(
    "backward_fill",
    _al("first_value(value ignore nulls) over (partition by series order by day rows between current row and unbounded following)", "known"),
    aligned,
    lambda s: {"known": s.backward_fill("value")},
)
_window("rolling_mean", _al(mean(3), "ma", 3), aligned, lambda s: {"ma": s.rolling_mean("value", 3)}, 3)
_window("rolling_mean_filled", _ff(mean(30), "ma", 3), filled, lambda s: {"ma": s.rolling_mean("value", 30)}, 3)
_window("rolling_std", _ff(std(10), "sd", 3), filled, lambda s: {"sd": s.rolling_std("value", 10)}, 3)
_window(
    "rolling_zscore",
    _ff(f"case when {std(30)} = 0 then 0 else (value - {mean(30)}) / ({std(30)} + 1e-9) end", "z"),
    filled,
    lambda s: {"z": s.rolling_zscore("value", 30)},
)
_window(
    "rolling_zscore_no_eps",
    _ff(f"(value - {mean(3)}) / nullif({std(3)}, 0)", "z"),
    filled,
    lambda s: {"z": s.rolling_zscore("value", 3, eps=None)},
)
_window(
    "rolling_zscore_min_periods",
    _al(f"case when {std(365, 30)} = 0 then value * 0 else (value - {mean(365, 30)}) / ({std(365, 30)} + 1e-9) end", "z"),
    aligned,
    lambda s: {"z": s.rolling_zscore("value", 365, 30)},
)


@query(
    "rolling_zscore_long_frame",
    _al(f"case when {std(365, 30)} = 0 then value * 0 else (value - {mean(365, 30)}) / ({std(365, 30)} + 1e-9) end", "z"),
)
def rolling_zscore_long_frame(spark, sf):
    """A frame of a year at the cost of a short one."""
    return rounded(rounded(rolling.rolling_zscores(aligned(spark, sf), BY_DAY, "value", 365, "z", 30), "value"), "z")


@query(
    "log_level_diff",
    f"""with {ALIGNED}, x as (select series, day, ln(value + 1) as log_level from al)
    select series, day, {r('log_level')} as log_level, {r(f'log_level - lag(log_level) over {W}')} as log_diff from x""",
)
def log_level_diff(spark, sf):
    df = aligned(spark, sf).select("series", "day", scalar.log_count("value").alias("log_level"))
    return rounded(df.withColumn("log_diff", BY_DAY.diff("log_level")), "log_level", "log_diff")


_NEIGHBOURS = """nb as (select *,
  last_value(case when value is not null then day end ignore nulls) over b as pd, last_value(value ignore nulls) over b as pv,
  first_value(case when value is not null then day end ignore nulls) over a as nd, first_value(value ignore nulls) over a as nv
  from {panel} window b as (partition by series order by day rows between unbounded preceding and current row),
  a as (partition by series order by day rows between current row and unbounded following))"""
_LINEAR = "case when value is not null then value else pv + (nv - pv) * (date_diff('day', pd, day) * 1.0 / date_diff('day', pd, nd)) end"


# Logs, because fractions of cents end in ties that two engines round apart.
_LOGS = f"{ALIGNED}, lg as (select series, day, ln(value) as value from al)"


def _aligned_logs(spark, sf):
    return aligned(spark, sf).withColumn("value", scalar.safe_ln("value"))


@query(
    "interpolate_time",
    f"with {_LOGS}, {_NEIGHBOURS.format(panel='lg')} select series, day, {r(f'coalesce({_LINEAR}, pv)')} as value from nb",
)
def interpolate_time(spark, sf):
    return rounded(_aligned_logs(spark, sf).withColumn("value", BY_DAY.interpolate("value", "day")), "value")


@query(
    "interpolate_time_both",
    f"with {_LOGS}, {_NEIGHBOURS.format(panel='lg')} select series, day, {r(f'coalesce({_LINEAR}, pv, nv)')} as value from nb",
)
def interpolate_time_both(spark, sf):
    return rounded(_aligned_logs(spark, sf).withColumn("value", BY_DAY.interpolate("value", "day", both=True)), "value")


_RESAMPLED = f"""{OD}, ends as (select series, min(day) as a, max(day) as b from od group by 1),
  own as (select series, cast(unnest(generate_series(a, b, interval 1 day)) as date) as day from ends),
  rs as (select own.series, own.day, od.value from own left join od on od.series = own.series and od.day = own.day)"""


@query("resample_daily", f"with {_RESAMPLED} select series, day, {r('value')} as value from rs")
def resample_daily(spark, sf):
    return rounded(calendar.resample_daily(orders_daily(spark, sf), ["series"], "day", ["value"]), "value")


_PAIR = f"""with {SHIP}, x as (select series, day, {ln('price')} - {ln(f'lag(price) over {W}')} as a,
  {ln('qty')} - {ln(f'lag(qty) over {W}')} as b from ship),
  y as (select series, day, case when b is not null then a end as a, case when a is not null then b end as b from x)"""


@query(
    "rolling_corr",
    f"""{_PAIR} select series, day, {r(f'''case when count(a) over {rows(30)} >= 30 then covar_samp(a, b) over {rows(30)}
    / nullif(stddev_samp(a) over {rows(30)} * stddev_samp(b) over {rows(30)}, 0) end''')} as corr from y""",
)
def rolling_corr(spark, sf):
    df = ship_daily(spark, sf).select(
        "series", "day", BY_DAY.log_return("price").alias("a"), BY_DAY.log_return("qty").alias("b")
    )
    return rounded(df.select("series", "day", BY_DAY.rolling_corr("a", "b", 30).alias("corr")), "corr")


@query(
    "annualised_volatility",
    f"""with {OHLC}, x as (select series, day, {ln(f'(close / lag(close) over {W})')} as value from oh)
    select series, day, {r(std(10) + ' * sqrt(365)')} as hv from x""",
)
def annualised_volatility(spark, sf):
    df = events_ohlc(spark, sf).withColumn("ret", BY_DAY.log_return_ratio("close"))
    return rounded(df.select("series", "day", BY_DAY.annualised_volatility("ret").alias("hv")), "hv")


@query(
    "relative_vigor",
    f"""with {OHLC}, x as (select series, day, (close - open) / ((high - low) + 1e-9) as value from oh)
    select series, day, {r(mean(10))} as rvi from x""",
)
def relative_vigor(spark, sf):
    df = events_ohlc(spark, sf).withColumn("raw", vigor_raw("open", "high", "low", "close"))
    return rounded(df.select("series", "day", BY_DAY.relative_vigor("raw").alias("rvi")), "rvi")


@query(
    "lag_matrix",
    f"""with {SHIP}, x as (select * from ship where qty is not null and price is not null)
    select series, day, row_number() over {W} as row_number, {r('qty')} as qty, {r('price')} as price, """
    + ", ".join(f"{r(f'lag({c}, {k}) over {W}')} as {c}_lag{k}" for c in ("qty", "price") for k in (1, 2, 3))
    + " from x",
)
def lag_matrix(spark, sf):
    df = ship_daily(spark, sf).select("series", "day", "qty", "price")
    out = lag_matrix_of(df, ["series"], ["day"], ["qty", "price"], 3)
    return rounded(out, "qty", "price", *[f"{c}_lag{k}" for c in ("qty", "price") for k in (1, 2, 3)])


# Row-wise expressions

_P4 = ["p1", "p2", "p3", "p4"]


@query(
    "rowwise_mean",
    f"with {OW} select day, {r('(' + ' + '.join(f'coalesce({p}, 0)' for p in _P4) + ') / nullif(' + ' + '.join(f'cast({p} is not null as integer)' for p in _P4) + ', 0)')} as mean from ow",
)
def rowwise_mean(spark, sf):
    return orders_wide(spark, sf).select("day", r6(scalar.rowwise_mean(*_P4)).alias("mean"))


@query(
    "scalar_set",
    f"""select l_orderkey, l_linenumber, {r(ln('l_discount'))} as ln_discount, {r('ln(l_quantity + 1)')} as log_qty,
    {r('sqrt(l_extendedprice)')} as root, {r('l_quantity / nullif(l_discount, 0) * 100')} as pct, {r('l_tax * 100')} as tax_pct,
    {r('ln(l_quantity + 1) - ln(l_extendedprice + 1)')} as spread, {r('ln(l_quantity + l_tax + 1)')} as log_of_sum,
    {r('ln(l_quantity + 1) + ln(l_tax + 1)')} as sum_of_logs from lineitem""",
)
def scalar_set(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        r6(scalar.safe_ln("l_discount")).alias("ln_discount"),
        r6(scalar.log_count("l_quantity")).alias("log_qty"),
        r6(F.sqrt("l_extendedprice")).alias("root"),
        r6(scalar.pct_of_total("l_quantity", "l_discount")).alias("pct"),
        r6(scalar.percent("l_tax")).alias("tax_pct"),
        r6(scalar.log_count("l_quantity") - scalar.log_count("l_extendedprice")).alias("spread"),
        r6(scalar.log_of_sum("l_quantity", "l_tax")).alias("log_of_sum"),
        r6(scalar.sum_of_logs("l_quantity", "l_tax")).alias("sum_of_logs"),
    )


@query("round_even", "select l_orderkey, l_linenumber, round_even(l_quantity / 8, 2) + 0.0 as eighth from lineitem")
def round_even(spark, sf):
    # Eighths are exact doubles, so ties at the third digit are real ties.
    eighth = scalar.round_even(F.col("l_quantity") / 8, 2) + 0.0
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", eighth.alias("eighth"))


# Long series: raw events, whose series are not bounded by a calendar

_WE = "(partition by series order by ts, event_id)"
_EVENT_ORDER = ["ts", "event_id"]


@query("long_row_index", f"with {EV} select series, event_id, row_number() over {_WE} - 1 as row_index from ev")
def long_row_index(spark, sf):
    rows_ = event_rows(spark, sf).select("series", "ts", "event_id")
    return long_series.row_index(rows_, ["series"], _EVENT_ORDER).select("series", "event_id", "row_index")


@query(
    "long_rolling",
    f"""with {EV}, x as (select series, ts, event_id, value, value - lag(value) over {_WE} as diff from ev)
    select series, event_id, {r('diff')} as diff, {r(f'''case when count(diff) over (partition by series order by ts, event_id
      rows between 6 preceding and current row) >= 7 then avg(diff) over (partition by series order by ts, event_id
      rows between 6 preceding and current row) end''')} as ma7 from x""",
)
def long_rolling(spark, sf):
    rows_ = event_rows(spark, sf).drop("sparse")
    out = long_series.bounded_windows(
        rows_,
        ["series"],
        _EVENT_ORDER,
        7,
        lambda s: {"diff": s.diff("value")},
        lambda s: {"ma7": s.rolling_mean("diff", 7)},
    )
    return rounded(out.select("series", "event_id", "diff", "ma7"), "diff", "ma7")


_YEAR = "(partition by series order by ts, event_id rows between 364 preceding and current row)"


@query(
    "long_rolling_zscore",
    f"""with {EV} select series, event_id, {r('value')} as value, {r(f"""case when count(value) over {_YEAR} >= 30 then
      (value - avg(value) over {_YEAR}) / (stddev_samp(value) over {_YEAR} + 1e-9) end""")} as z from ev""",
)
def long_rolling_zscore(spark, sf):
    rows_ = event_rows(spark, sf).drop("sparse")
    out = rolling.long_rolling_zscores(rows_, ["series"], _EVENT_ORDER, "value", 365, "z", 30)
    return rounded(out.select("series", "event_id", "value", "z"), "value", "z")


@query(
    "long_lag_matrix",
    f"""with {EV} select series, event_id, row_number() over {_WE} as row_number, value, lag(value, 1) over {_WE} as value_lag1,
    lag(value, 2) over {_WE} as value_lag2 from ev where value is not null""",
)
def long_lag_matrix(spark, sf):
    out = lag_matrix_of(event_rows(spark, sf).drop("sparse"), ["series"], _EVENT_ORDER, ["value"], 2)
    return out.select("series", "event_id", "row_number", "value", "value_lag1", "value_lag2")


_BEFORE = "(partition by series order by ts, event_id rows between unbounded preceding and current row)"
_AFTER = "(partition by series order by ts, event_id rows between current row and unbounded following)"


@query("long_forward_fill", f"with {EV} select series, event_id, last_value(sparse ignore nulls) over {_BEFORE} as known from ev")
def long_forward_fill(spark, sf):
    rows_ = event_rows(spark, sf).drop("value")
    out = long_series.fill_long(rows_, ["series"], _EVENT_ORDER, "sparse", "forward", "known")
    return out.select("series", "event_id", "known")


@query("long_backward_fill", f"with {EV} select series, event_id, first_value(sparse ignore nulls) over {_AFTER} as known from ev")
def long_backward_fill(spark, sf):
    rows_ = event_rows(spark, sf).drop("value")
    out = long_series.fill_long(rows_, ["series"], _EVENT_ORDER, "sparse", "backward", "known")
    return out.select("series", "event_id", "known")


@query(
    "long_interpolate",
    f"""with {EV}, nb as (select *, last_value(case when sparse is not null then epoch_us(ts) end ignore nulls) over b as pt,
      last_value(sparse ignore nulls) over b as pv, first_value(case when sparse is not null then epoch_us(ts) end ignore nulls) over a as nt,
      first_value(sparse ignore nulls) over a as nv from ev window b as {_BEFORE}, a as {_AFTER})
    select series, event_id, {r('coalesce(sparse, pv + (nv - pv) * ((epoch_us(ts) - pt) * 1.0 / nullif(nt - pt, 0)), pv)')} as known from nb""",
)
def long_interpolate(spark, sf):
    rows_ = event_rows(spark, sf).drop("value")
    out = long_series.fill_long(rows_, ["series"], _EVENT_ORDER, "sparse", "interpolate", "known")
    return rounded(out.select("series", "event_id", "known"), "known")
