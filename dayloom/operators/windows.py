"""Window expressions over ordered series.

`Series(keys, order)` names the partitioning and ordering once; its methods
return columns. Expressions over the same `Series` share one exchange, one sort
and one Window node. Fills that look ahead run over the reversed order with a
growing frame, because Spark re-reads the rest of the partition for every row
of an `UNBOUNDED FOLLOWING` frame.

These frames suit groups of bounded length (day-grain panels). Rows ordered by
something finer go through `dayloom.operators.long_series`.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import sqrt

from pyspark.sql import Column, Window, WindowSpec, functions as F

from dayloom.functions.scalar import log_count, safe_ln

DAYS_PER_YEAR = 365
EPS = 1e-9


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


@dataclass(frozen=True)
class Series:
    """An ordered panel: rows of one `keys` group in the order of `order`."""

    keys: Sequence[str]
    order: Sequence[str]

    @property
    def forward(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(*self.order)

    @property
    def backward(self) -> WindowSpec:
        return Window.partitionBy(*self.keys).orderBy(*[F.col(c).desc() for c in self.order])

    def last_rows(self, n: int) -> WindowSpec:
        return self.forward.rowsBetween(1 - n, 0)

    # Offsets and returns

    def lag(self, c: Column | str, k: int = 1) -> Column:
        return F.lag(_col(c), k).over(self.forward)

    def diff(self, c: Column | str) -> Column:
        """x - previous x; NULL on both sides of a gap."""
        return _col(c) - self.lag(c)

    def log_return(self, c: Column | str) -> Column:
        return safe_ln(c) - safe_ln(self.lag(c))

    def log_return_ratio(self, c: Column | str) -> Column:
        """ln(x / previous x), the quotient form of the log-return."""
        return safe_ln(F.try_divide(_col(c), self.lag(c)))

    def log_return_shifted(self, c: Column | str) -> Column:
        """Log-return of counts: ln(1 + x) - ln(1 + previous x)."""
        return log_count(c) - log_count(self.lag(c))

    def lags(self, c: str, p: int) -> dict[str, Column]:
        """Columns `<c>_lag1` .. `<c>_lag<p>` from one window pass."""
        return {f"{c}_lag{k}": self.lag(c, k) for k in range(1, p + 1)}

    # Fills

    def forward_fill(self, c: Column | str) -> Column:
        """Last known value; leading NULLs stay."""
        frame = self.forward.rowsBetween(Window.unboundedPreceding, 0)
        return F.last(_col(c), ignorenulls=True).over(frame)

    def backward_fill(self, c: Column | str) -> Column:
        """Next known value; trailing NULLs stay."""
        frame = self.backward.rowsBetween(Window.unboundedPreceding, 0)
        return F.last(_col(c), ignorenulls=True).over(frame)

    def interpolate(self, c: str, day: str, both: bool = False) -> Column:
        """Linear in elapsed time between known values. Trailing NULLs take the
        last value; leading ones stay, or take the first value with `both`."""
        point = F.when(F.col(c).isNotNull(), F.struct(F.col(day).alias("t"), F.col(c).alias("x")))
        return interpolated(c, day, self.forward_fill(point), self.backward_fill(point), both)

    # Rolling frames of n rows; NULL unless enough values are present

    def rolling_mean(self, c: Column | str, n: int, min_periods: int | None = None) -> Column:
        return self._gated(c, n, min_periods, F.avg(_col(c)).over(self.last_rows(n)))

    def rolling_std(self, c: Column | str, n: int, min_periods: int | None = None) -> Column:
        return self._gated(c, n, min_periods, F.stddev_samp(_col(c)).over(self.last_rows(n)))

    def rolling_zscore(
        self, c: Column | str, n: int, min_periods: int | None = None, eps: float | None = EPS
    ) -> Column:
        """Distance from the rolling mean in rolling standard deviations. In a
        constant window it is 0, not the mean's rounding error over `eps`; with
        eps=None it is NULL there."""
        x, frame = _col(c), self.last_rows(n)
        need = n if min_periods is None else min_periods
        # One struct, so that each aggregate stands in the Window node once.
        stats = F.struct(
            x.alias("x"),
            F.count(x).over(frame).alias("n"),
            F.avg(x).over(frame).alias("mean"),
            F.stddev_samp(x).over(frame).alias("std"),
        )

        return F.get(F.transform(F.array(stats), lambda s: zscore_of(s, need, eps)), F.lit(0))

    def rolling_corr(self, a: str, b: str, n: int) -> Column:
        """Pearson correlation of the last n rows; NULL unless all n pairs are
        complete or when either side is constant."""
        frame = self.last_rows(n)
        x = F.when(F.col(b).isNotNull(), F.col(a))
        y = F.when(F.col(a).isNotNull(), F.col(b))
        r = F.try_divide(
            F.covar_samp(x, y).over(frame),
            F.stddev_samp(x).over(frame) * F.stddev_samp(y).over(frame),
        )
        return F.when(F.count(x).over(frame) >= n, r)

    def annualised_volatility(self, log_return: Column | str, n: int = 10) -> Column:
        return self.rolling_std(log_return, n) * F.lit(sqrt(DAYS_PER_YEAR))

    def relative_vigor(self, raw: Column | str, n: int = 10) -> Column:
        """Rolling mean of `vigor_raw`."""
        return self.rolling_mean(raw, n)

    def _gated(self, c: Column | str, n: int, min_periods: int | None, value: Column) -> Column:
        need = n if min_periods is None else min_periods
        return F.when(F.count(_col(c)).over(self.last_rows(n)) >= need, value)


def zscore_of(stats: Column, need: int, eps: float | None) -> Column:
    """Distance of x from the mean in deviations, of a struct (x, n, mean, std) with at least `need` values."""
    distance = stats["x"] - stats["mean"]
    if eps is None:
        z = F.try_divide(distance, stats["std"])
    else:
        z = F.when(stats["std"] == 0, stats["x"] * 0.0).otherwise(distance / (stats["std"] + eps))
    return F.when(stats["n"] >= need, z)


def vigor_raw(open_: str, high: str, low: str, close: str) -> Column:
    """Close-to-open move relative to the day's range."""
    return (F.col(close) - F.col(open_)) / ((F.col(high) - F.col(low)) + F.lit(EPS))


def interpolated(c: str, day: str, prev: Column, nxt: Column, both: bool = False) -> Column:
    """Interpolate from the (t, x) structs of the known neighbours of a row."""
    share = F.try_divide(
        _elapsed(F.col(day), prev.getField("t")), _elapsed(nxt.getField("t"), prev.getField("t"))
    )
    between = prev.getField("x") + (nxt.getField("x") - prev.getField("x")) * share
    ends = [prev.getField("x")] + ([nxt.getField("x")] if both else [])
    return F.coalesce(F.col(c), between, *ends)


def _elapsed(later: Column, earlier: Column) -> Column:
    """Elapsed time in days, with the fraction of a day for timestamps."""
    micros = F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))
    return micros / F.lit(86_400_000_000.0)
