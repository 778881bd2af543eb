"""Row-wise column expressions: day parsing, cleaning and arithmetic.

NULL is the only missing value: nothing here returns NaN or an infinity.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _utc_day(seconds: Column) -> Column:
    """Day of epoch seconds, whatever the session's time zone."""
    days = F.floor(seconds / F.lit(86400)).try_cast("int")
    return F.date_add(F.lit("1970-01-01").cast("date"), days)


def day_from_epoch(c: Column | str) -> Column:
    """Epoch seconds to a UTC day."""
    return _utc_day(_col(c))


def day_from_iso(c: Column | str) -> Column:
    """ISO text to a UTC day, text without an offset to its own day; bad text
    gives NULL. The session's time zone plays no part."""
    moment = F.try_to_timestamp(_col(c))
    with_offset = F.rlike(_col(c), F.lit(r"[T ][0-9:.]+ *([Zz]|UTC|GMT|[+-][0-9]{1,2}(:?[0-9]{2})?)$"))
    return F.when(with_offset, _utc_day(F.floor(F.unix_micros(moment) / 1_000_000))).otherwise(F.to_date(moment))


def day_from_local(c: Column | str, fmt: str = "yyyy-MM-dd") -> Column:
    """Date text without a zone to a day; bad text gives NULL."""
    return F.to_date(F.try_to_timestamp(_col(c), F.lit(fmt)))


def is_weekend(day: Column | str) -> Column:
    """1 on Saturday and Sunday, else 0 (weekday counts from Monday = 0)."""
    return (F.weekday(_col(day)) >= 5).cast("int")


def zero_to_null(c: Column | str) -> Column:
    return F.nullif(_col(c), F.lit(0.0))


def nonfinite_to_null(c: Column | str) -> Column:
    x = _col(c)
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), x)


def safe_ln(c: Column | str) -> Column:
    """Natural log; Spark gives NULL, not an infinity, for zero and below."""
    return F.ln(_col(c))


def log_count(c: Column | str) -> Column:
    """ln(1 + x), the log used for counts; NULL for -1 and below."""
    return F.log1p(_col(c))


def rowwise_mean(*cols: Column | str) -> Column:
    """Mean of several columns of one row, ignoring NULLs; NULL when all are."""
    xs = [_col(c).cast("double") for c in cols]
    total = sum((F.coalesce(x, F.lit(0.0)) for x in xs[1:]), F.coalesce(xs[0], F.lit(0.0)))
    present = sum((x.isNotNull().cast("int") for x in xs[1:]), xs[0].isNotNull().cast("int"))
    return F.try_divide(total, present)


def pct_of_total(part: Column | str, total: Column | str) -> Column:
    """`part` as a percentage of `total`; NULL for a zero total."""
    return F.try_divide(_col(part), _col(total)) * 100


def percent(c: Column | str) -> Column:
    """A fraction on the percent scale."""
    return _col(c) * 100


def log_of_sum(*cols: Column | str) -> Column:
    """ln(1 + a + b + ...)."""
    return log_count(sum((_col(c) for c in cols[1:]), _col(cols[0])))


def sum_of_logs(*cols: Column | str) -> Column:
    """ln(1 + a) + ln(1 + b) + ..."""
    return sum((log_count(c) for c in cols[1:]), log_count(cols[0]))


def round_even(c: Column | str, digits: int) -> Column:
    """Half-even rounding of the scaled double, as NumPy and pandas do it
    (`bround` rounds the decimal text of the number instead)."""
    scale = F.lit(10.0**digits)
    return F.rint(_col(c) * scale) / scale


def significance_label(
    p: Column | str,
    below: str = "significant",
    otherwise: str = "not significant",
    level: float = 0.05,
) -> Column:
    """`below` when p < level, `otherwise` when not, NULL without a p-value."""
    x = _col(p)
    return F.when(x < level, F.lit(below)).when(x.isNotNull(), F.lit(otherwise))
