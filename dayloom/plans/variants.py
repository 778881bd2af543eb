"""Feature recipes outside the consolidated table.

Each takes a raw or day-grain table and returns the finished columns; `keys`
are the panel columns (may be empty for a single series), `start`/`end` the
calendar. They combine the same operators with other fills and windows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from dayloom.functions.scalar import log_count, pct_of_total, percent, rowwise_mean, sum_of_logs
from dayloom.operators.align import enrich_left
from dayloom.operators.calendar import align_to_spine, resample_daily
from dayloom.operators.clean import drop_null_rows, filter_after, filter_between
from dayloom.operators.rolling import rolling_zscores
from dayloom.operators.windows import EPS, Series, vigor_raw

Keys = Sequence[str]


def target_price(df: DataFrame, keys: Keys, day: str, value: str, start: str, end: str, after: str) -> DataFrame:
    """A price on the calendar from a start day on."""
    return filter_after(align_to_spine(df, keys, day, [value], start, end), day, after)


def ohlc_features(df: DataFrame, keys: Keys, day: str, start: str, end: str, n: int = 10) -> DataFrame:
    """Log-return, relative vigor and annualised volatility of open, high, low
    and close rows, between two days."""
    series = Series(keys, [day])
    rows = df.withColumns(
        {"log_ret": series.log_return_ratio("close"), "vigor": vigor_raw("open", "high", "low", "close")}
    ).withColumns(
        {f"vigor_ma{n}": series.relative_vigor("vigor", n), f"hv{n}": series.annualised_volatility("log_ret", n)}
    )
    return filter_between(rows, day, start, end).select(*keys, day, "close", "log_ret", f"vigor_ma{n}", f"hv{n}")


def funding_percent(df: DataFrame, keys: Keys, day: str, rates: Sequence[str], start: str, end: str) -> DataFrame:
    """Mean of several rates in percent with a 7-row mean, gaps as zero."""
    mean = df.select(*keys, day, rowwise_mean(*[f"`{r}`" for r in rates]).alias("rate"))
    rows = align_to_spine(mean, keys, day, ["rate"], start, end).withColumn("rate_pct", percent("rate"))
    rows = rows.withColumn("rate_ma7", Series(keys, [day]).rolling_mean("rate_pct", 7))
    return rows.select(*keys, day, "rate_pct", "rate_ma7").fillna(0.0, ["rate_pct", "rate_ma7"])


def share_of_supply(
    df: DataFrame, supply: DataFrame, on: Sequence[str], keys: Keys, day: str, part: str, total: str,
    carried: Sequence[str], start: str, end: str,
) -> DataFrame:
    """A holding as a percentage of a total found in another table."""
    rows = enrich_left(df, supply, on)
    spine = align_to_spine(rows.select(*keys, day, part, total, *carried), keys, day, [part, total, *carried], start, end)
    return spine.select(*keys, day, pct_of_total(part, total).alias(f"{part}_pct"), *carried)


def flow_trend(df: DataFrame, keys: Keys, day: str, value: str, start: str, end: str) -> DataFrame:
    """Daily change, its 7-row mean and 30-row z-score; incomplete rows dropped."""
    series = Series(keys, [day])
    rows = align_to_spine(df, keys, day, [value], start, end).withColumn("change", series.diff(value))
    rows = rows.withColumns(
        {"trend_7": series.rolling_mean("change", 7), "z_30": series.rolling_zscore("change", 30, eps=EPS)}
    )
    return drop_null_rows(rows.select(*keys, day, "change", "trend_7", "z_30"), ["change", "trend_7", "z_30"])


def divergence_trend(
    df: DataFrame, keys: Keys, day: str, divergence: str, strength: str, start: str, end: str
) -> DataFrame:
    """30-row mean of one column next to another filled forward."""
    series = Series(keys, [day])
    rows = align_to_spine(df, keys, day, [divergence, strength], start, end)
    return rows.select(
        *keys,
        day,
        divergence,
        series.rolling_mean(divergence, 30).alias("trend_30"),
        series.forward_fill(strength).alias(strength),
    )


def premium_trend(df: DataFrame, keys: Keys, day: str, value: str, start: str, end: str) -> DataFrame:
    """Gaps as zero first, then a 7-row mean and a 30-row z-score, zero-filled."""
    series = Series(keys, [day])
    rows = align_to_spine(df, keys, day, [value], start, end).fillna(0.0, [value])
    rows = rows.withColumns(
        {"trend_7": series.rolling_mean(value, 7), "z_30": series.rolling_zscore(value, 30, eps=EPS)}
    )
    return rows.fillna(0.0, ["trend_7", "z_30"])


def interpolated_oscillator(df: DataFrame, keys: Keys, day: str, value: str, start: str, end: str) -> DataFrame:
    """Interpolated in both directions, then change, 30-row mean and a 365-row
    z-score that starts after 30 rows; what is missing becomes zero."""
    series = Series(keys, [day])
    rows = align_to_spine(df, keys, day, [value], start, end)
    rows = rows.withColumn(value, series.interpolate(value, day, both=True))
    rows = rows.withColumns({"change": series.diff(value), "ma_30": series.rolling_mean(value, 30)})
    rows = rolling_zscores(rows, series, value, 365, "z_365", 30, EPS)
    return rows.fillna(0.0, [value, "change", "ma_30", "z_365"])


def rolling_pair_correlation(
    df: DataFrame, keys: Keys, day: str, asset: str, index: str, start: str, end: str, n: int = 30
) -> DataFrame:
    """Rolling correlation of two log-returns, the second price filled forward;
    leading gaps take the first correlation found."""
    series = Series(keys, [day])
    rows = align_to_spine(df, keys, day, [asset, index], start, end)
    rows = rows.withColumn(index, series.forward_fill(index))
    rows = rows.withColumns(
        {"asset_log_ret": series.log_return_ratio(asset), "index_log_ret": series.log_return_ratio(index)}
    )
    rows = rows.withColumn("corr", series.rolling_corr("asset_log_ret", "index_log_ret", n))
    return rows.withColumn("corr", series.backward_fill("corr")).select(*keys, day, index, "asset_log_ret", "corr")


def log_level_change(df: DataFrame, keys: Keys, day: str, value: str) -> DataFrame:
    """ln(1 + x) of the rows as they are, and its change."""
    rows = df.select(*keys, day, value, log_count(value).alias("log_level"))
    return rows.withColumn("log_diff", Series(keys, [day]).diff("log_level"))


def change_zscore(df: DataFrame, keys: Keys, day: str, value: str, n: int = 30) -> DataFrame:
    """Change between rows and its z-score without a guard, zero-filled."""
    series = Series(keys, [day])
    rows = df.select(*keys, day, value).withColumn("change", series.diff(value))
    rows = rows.withColumn("z", series.rolling_zscore("change", n, eps=None))
    return rows.fillna(0.0, [value, "change", "z"])


def weekly_breadth(df: DataFrame, keys: Keys, day: str, value: str, n: int = 30) -> DataFrame:
    """Sparse counts to daily: log, dense days, interpolation, z-score; leading
    gaps take the next value, the rest zero."""
    series = Series(keys, [day])
    logs = df.select(*keys, day, log_count(value).alias("log_value"))
    rows = resample_daily(logs, keys, day, ["log_value"])
    rows = rows.withColumn("log_value", series.interpolate("log_value", day))
    rows = rows.withColumn("z", series.rolling_zscore("log_value", n, eps=None))
    return rows.withColumn("z", F.coalesce(series.backward_fill("z"), F.lit(0.0))).select(*keys, day, "z")


def level_and_change(
    df: DataFrame, keys: Keys, day: str, level: str, count: str, start: str, end: str, after: str
) -> DataFrame:
    """Change of one column and log-return of another on the calendar."""
    series = Series(keys, [day])
    rows = align_to_spine(df, keys, day, [level, count], start, end)
    rows = rows.withColumns({"level_diff": series.diff(level), "count_log_ret": series.log_return(count)})
    return filter_after(rows, day, after).select(*keys, day, level, "level_diff", count, "count_log_ret")


def interpolated_level(df: DataFrame, keys: Keys, day: str, value: str, start: str, end: str) -> DataFrame:
    """A market series with closed days: interpolated, then filled backward."""
    series = Series(keys, [day])
    rows = align_to_spine(df, keys, day, [value], start, end)
    rows = rows.withColumn(value, series.interpolate(value, day))
    return rows.withColumn(value, series.backward_fill(value))


def social_spread(
    df: DataFrame, keys: Keys, day: str, own: str, others: Sequence[str], start: str, end: str
) -> DataFrame:
    """Log volume against the sum of the others' logs, and its momentum."""
    series = Series(keys, [day])
    rows = align_to_spine(df, keys, day, [own, *others], start, end)
    rows = rows.withColumn("log_spread", log_count(own) - sum_of_logs(*others))
    rows = rows.withColumn("momentum", series.diff("log_spread"))
    return rows.select(*keys, day, "log_spread", "momentum").fillna(0.0, ["log_spread", "momentum"])


def market_noise(df: DataFrame, keys: Keys, day: str, own: str, others: Sequence[str], n: int = 30) -> DataFrame:
    """`social_spread` on the rows as they are, with the z-score of all logs."""
    series = Series(keys, [day])
    logs = df.select(*keys, day, log_count(own).alias("own"), sum_of_logs(*others).alias("rest"))
    rows = logs.withColumns({"log_spread": F.col("own") - F.col("rest"), "_noise": F.col("own") + F.col("rest")})
    rows = rows.withColumns(
        {"momentum": series.diff("log_spread"), "noise_z": series.rolling_zscore("_noise", n, eps=None)}
    )
    columns = ["log_spread", "momentum", "noise_z"]
    return rows.select(*keys, day, *columns).fillna(0.0, columns)


def filled_log_return(
    df: DataFrame, keys: Keys, day: str, value: str, start: str, end: str, after: str, out: str = "log_ret"
) -> DataFrame:
    """Forward fill on the calendar, log-return, cut."""
    series = Series(keys, [day])
    rows = align_to_spine(df, keys, day, [value], start, end).withColumn(value, series.forward_fill(value))
    return filter_after(rows.withColumn(out, series.log_return(value)), day, after)
