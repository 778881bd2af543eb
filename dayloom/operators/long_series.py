"""Window operators for series too long for one task.

A window partitioned by the series key puts a whole series into one task. That
is fine on a daily calendar and not when one key may hold a third of all rows.
Here rows are range-partitioned on (key, order) -- Spark samples the order
columns too, so a hot key is cut into many pieces -- and the pieces are fixed
with a reliable checkpoint, because a second run of the range exchange could
choose other cut points. What crosses piece borders is small:

* a dense row index needs the row count of each (key, piece);
* fills need the last (or first) known value of each (key, piece);
* bounded frames need the rows just before a block, copied into it.

`order` must be a total order within a key (add a tie-breaker column), and key
columns must not be NULL.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import DateType

from dayloom.operators.windows import Series, interpolated
from dayloom.session import ensure_checkpoint_dir

ROWS_PER_BLOCK = 1 << 15


def is_day_grain(df: DataFrame, order: Sequence[str]) -> bool:
    """Whether rows are ordered by a date alone: with one row per day a series
    is then no longer than the calendar and may stay in one group."""
    types = {f.name: f.dataType for f in df.schema.fields}
    return all(isinstance(types[c], DateType) for c in order)


def range_pieces(df: DataFrame, keys: Sequence[str], order: Sequence[str], pieces: int | None = None) -> DataFrame:
    """Cut into contiguous pieces of the (key, order) sequence; adds `_piece` and
    `_at`, the position in the piece, which stays ordered by (key, order)."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    n = pieces or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = df.repartitionByRange(n, *keys, *order).sortWithinPartitions(*keys, *order)
    # The id holds the partition number above its 33 lower bits.
    in_piece = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return cut.withColumns({"_piece": F.spark_partition_id(), "_at": in_piece}).checkpoint()


@dataclass(frozen=True)
class Pieces:
    """Rows that are cut and written once, for several operators in a row.

    `fill` and `index` add columns and keep the cut; `windows` and `rows` end it. A
    column that is added later does not move rows, so nothing is cut again.
    """

    frame: DataFrame
    keys: Sequence[str]
    order: Sequence[str]

    def fill(self, value: str, method: str, out: str | None = None) -> Pieces:
        """`fill_long` on these pieces."""
        return replace(self, frame=_filled(self, value, method, out))

    def index(self, out: str = "row_index") -> Pieces:
        """`row_index` on these pieces."""
        return replace(self, frame=indexed(self.frame, self.keys, out))

    def windows(
        self, reach: int, *steps: Callable[[Series], Mapping[str, Column]], rows_per_block: int | None = None,
        index: str = "_index",
    ) -> DataFrame:
        """`bounded_windows` on these pieces."""
        rows = self.index(index).rows()
        return _in_blocks(rows, self.keys, reach, steps, rows_per_block or ROWS_PER_BLOCK, index)

    def rows(self) -> DataFrame:
        return self.frame.drop("_piece", "_at")


def cut(df: DataFrame, keys: Sequence[str], order: Sequence[str], pieces: int | None = None) -> Pieces:
    """The rows in pieces, to be handed from operator to operator."""
    return Pieces(range_pieces(df, keys, order, pieces), tuple(keys), tuple(order))


def _piece_window(keys: Sequence[str]) -> Series:
    """Windows over per-piece summaries: at most one row per piece and key."""
    return Series(list(keys), ["_piece"])


def _with_offsets(
    pieces: DataFrame, keys: Sequence[str], weight: Column | None = None
) -> DataFrame:
    """Join on the weight of each key's earlier pieces and of the whole key, and
    the key's first position in the piece."""
    series = _piece_window(keys)
    before = series.forward.rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        pieces.groupBy(*keys, "_piece")
        .agg(F.sum(F.lit(1) if weight is None else weight).alias("_weight"), F.min("_at").alias("_first"))
        .withColumn("_offset", F.coalesce(F.sum("_weight").over(before), F.lit(0)))
        .withColumn("_total", F.sum("_weight").over(Window.partitionBy(*keys)))
        .drop("_weight")
    )
    return pieces.join(offsets, [*keys, "_piece"])


def indexed(pieces: DataFrame, keys: Sequence[str], out: str = "row_index") -> DataFrame:
    """Dense 0-based row index per key over rows cut by `range_pieces`: rows in
    earlier pieces plus the position in the own one. The rows are not shuffled
    again unless the summary is too large to broadcast."""
    rows = _with_offsets(pieces, keys)
    return rows.withColumn(out, F.col("_offset") + F.col("_at") - F.col("_first")).drop("_offset", "_total", "_first")


def row_index(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], out: str = "row_index", pieces: int | None = None
) -> DataFrame:
    """Dense 0-based row index per key, without a whole key in one task."""
    return cut(df, keys, order, pieces).index(out).rows()


def blocks_with_halo(
    df: DataFrame, index: str, reach: int | Column, rows_per_block: int | Column = ROWS_PER_BLOCK
) -> DataFrame:
    """Cut an indexed series into blocks of equal length. Each block also gets
    the `reach` rows before it, marked `_halo`. Both may differ between series;
    as columns they are the caller's to keep in order."""
    if isinstance(reach, int) and isinstance(rows_per_block, int) and reach > rows_per_block:
        raise ValueError("a block must be at least as long as the frame reaches back")
    length = rows_per_block if isinstance(rows_per_block, Column) else F.lit(rows_per_block)
    home = F.floor(F.col(index) / length).cast("long")
    near_end = F.pmod(F.col(index), length) >= length - reach
    copies = F.when(near_end, F.array("_home", F.col("_home") + 1)).otherwise(F.array("_home"))
    return (
        df.withColumn("_home", home)
        .withColumn("_block", F.explode(copies))
        .withColumn("_halo", F.col("_block") != F.col("_home"))
        .drop("_home")
    )


def bounded_windows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    reach: int,
    *steps: Callable[[Series], Mapping[str, Column]],
    pieces: int | None = None,
    rows_per_block: int = ROWS_PER_BLOCK,
    index: str = "_index",
) -> DataFrame:
    """Add window columns that look back at most `reach` rows in total. The
    dense row index is kept when `index` gives it a name of its own.

    Each step maps a `Series` to named columns; later steps see earlier ones,
    so `reach` is the sum over chained steps (a 7-row mean of differences: 7).
    """
    return cut(df, keys, order, pieces).windows(reach, *steps, rows_per_block=rows_per_block, index=index)


def _in_blocks(
    rows: DataFrame, keys: Sequence[str], reach: int, steps: Sequence[Callable], rows_per_block: int, index: str
) -> DataFrame:
    blocks = blocks_with_halo(rows, index, reach, rows_per_block)
    series = Series([*keys, "_block"], [index])
    for step in steps:
        blocks = blocks.withColumns(dict(step(series)))
    return blocks.filter(~F.col("_halo")).drop("_halo", "_block", "_index")


def _known_point(value: str, order: Sequence[str]) -> Column:
    return F.when(
        F.col(value).isNotNull(),
        F.struct(F.col(order[0]).alias("t"), F.col(value).alias("x")),
    )


def _carried(
    pieces: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, directions: Sequence[str]
) -> DataFrame:
    """Per (key, piece): the nearest known points in the pieces before and after,
    `_from_before` and `_from_after`, from one summary for both directions."""
    position = F.when(F.col(value).isNotNull(), F.struct(*order))
    point = _known_point(value, order)
    series = _piece_window(keys)
    sides = {"_from_before": (F.max_by, series.forward), "_from_after": (F.min_by, series.backward)}
    summary = pieces.groupBy(*keys, "_piece").agg(*[sides[d][0](point, position).alias(f"{d}_own") for d in directions])
    return summary.select(
        *keys, "_piece",
        *[
            F.last(f"{d}_own", ignorenulls=True).over(sides[d][1].rowsBetween(Window.unboundedPreceding, -1)).alias(d)
            for d in directions
        ],
    )


def fill_long(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    method: str,
    out: str | None = None,
    pieces: int | None = None,
) -> DataFrame:
    """Fill a long series: method 'forward', 'backward', 'interpolate' or
    'interpolate_both' (linear in the first order column, a day or timestamp)."""
    return cut(df, keys, order, pieces).fill(value, method, out).rows()


def _filled(pieces: Pieces, value: str, method: str, out: str | None) -> DataFrame:
    keys, order = list(pieces.keys), list(pieces.order)
    local = Series([*keys, "_piece"], order)
    point = _known_point(value, order)
    directions = {"forward": ["_from_before"], "backward": ["_from_after"]}.get(method, ["_from_before", "_from_after"])
    rows = pieces.frame.join(_carried(pieces.frame, keys, order, value, directions), [*keys, "_piece"])
    prev = nxt = None
    if method != "backward":
        prev = F.coalesce(local.forward_fill(point), F.col("_from_before"))
    if method != "forward":
        nxt = F.coalesce(local.backward_fill(point), F.col("_from_after"))
    if method == "forward":
        filled = prev.getField("x")
    elif method == "backward":
        filled = nxt.getField("x")
    elif method in ("interpolate", "interpolate_both"):
        rows = rows.withColumns({"_prev": prev, "_next": nxt})
        filled = interpolated(value, order[0], F.col("_prev"), F.col("_next"), method == "interpolate_both")
    else:
        raise ValueError(f"unknown fill method {method!r}")
    return rows.withColumn(out or value, filled).drop("_from_before", "_from_after", "_prev", "_next")


def exact_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probabilities: Sequence[float],
    pieces: int | None = None,
) -> DataFrame:
    """Exact interpolated quantiles of groups of any size.

    Equal values are counted together first, so a value held by a large share
    of the rows is one row; the distinct values are then cut into pieces and
    each learns the ranks it covers. One row (keys, q, quantile) per
    probability.
    """
    counted = (
        df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_copies"))
    )
    pieces_ = range_pieces(counted, keys, [value], pieces)
    upto = Series([*keys, "_piece"], [value]).forward.rowsBetween(Window.unboundedPreceding, 0)
    ranked = _with_offsets(pieces_, keys, F.col("_copies")).withColumn(
        "_end", F.col("_offset") + F.sum("_copies").over(upto)
    )
    points = F.array(
        *[
            F.struct(
                F.lit(float(p)).alias("q"),
                F.floor(F.lit(float(p)) * (F.col("_total") - 1)).cast("long").alias("low"),
                (F.lit(float(p)) * (F.col("_total") - 1)).alias("at"),
            )
            for p in probabilities
        ]
    )

    def covers(rank: Column) -> Column:
        return (rank >= F.col("_end") - F.col("_copies")) & (rank < F.col("_end"))

    hits = F.filter(points, lambda s: covers(s["low"]) | covers(F.least(s["low"] + 1, F.col("_total") - 1)))
    return (
        ranked.select(*keys, value, F.explode(hits).alias("_p"))
        .groupBy(*keys, F.col("_p.q").alias("q"))
        .agg(
            F.min(value).alias("_a"),
            F.max(value).alias("_b"),
            F.max(F.col("_p.at") - F.col("_p.low")).alias("_share"),
        )
        .select(*keys, "q", (F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_share")).alias("quantile"))
    )
