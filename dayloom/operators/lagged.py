"""Cross-products of a series with its own past, per series, additive in blocks.

A lag-p model needs rows with at least p earlier rows. Instead of one matrix per
lag, each series keeps the matrix of the rows with `lags` or more predecessors
and the design rows of the first few, from which the matrix of any shorter lag
follows. One row per series (or block of a long series) leaves a task.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame, functions as F

from dayloom.operators.long_series import (
    ROWS_PER_BLOCK,
    blocks_with_halo,
    bounded_windows,
    indexed,
    is_day_grain,
    range_pieces,
)
from dayloom.operators.windows import Series

# lags -> (values: (rows, columns) in order, rows of halo) -> (design rows, predecessors of the first one)
Design = Callable[[int], Callable[[np.ndarray, int], tuple[np.ndarray, int]]]


@dataclass(frozen=True)
class LagLimit:
    """Lags that follow from the number of rows of a series: in a task, and at most that many as a column."""

    of: Callable[[int], int]
    column: Callable[[Column], Column]


def fixed(lags: int) -> LagLimit:
    return LagLimit(lambda n: lags, lambda n: F.lit(lags))


# Matrices one group adds up, and the levels of such groups before the last:
# enough for 2^24 blocks of a series.
_COMBINE_FANIN = 256
_COMBINE_LEVELS = 2


def lag_matrix(df: DataFrame, keys: Sequence[str], order: Sequence[str], columns: Sequence[str], p: int) -> DataFrame:
    """Columns lag 1..p of each listed column over the complete rows, with the
    row number they refer to. Lags count rows, so gaps collapse."""
    rows = df.dropna(how="any", subset=list(columns))

    def lags(series: Series) -> dict[str, Column]:
        return {name: c for column in columns for name, c in series.lags(column, p).items()}

    if not is_day_grain(df, order):
        counted = bounded_windows(rows, keys, order, p, lags, index="row_number")
        return counted.withColumn("row_number", F.col("row_number") + 1)
    series = Series(list(keys), list(order))
    same = reduce(and_, (F.lead(c).over(series.forward) == F.col(c) for c in order))
    twice = F.raise_error(F.lit("more than one row for a day of a series")).cast("int")
    number = F.when(F.coalesce(same, F.lit(False)), twice).otherwise(F.row_number().over(series.forward))
    return rows.withColumns({"row_number": number, **lags(series)})


def past(values: np.ndarray, lags: int) -> np.ndarray:
    """Row t: values[t-1], ..., values[t-lags], zero where there is none."""
    padded = np.concatenate([np.zeros(lags), values])
    return sliding_window_view(padded, lags + 1)[:, lags - 1 :: -1] if lags else np.empty((len(values), 0))


def _summary(design: np.ndarray, first: int, lags: int) -> tuple[np.ndarray, np.ndarray | None]:
    """Matrix of the rows with all lags, and the design rows with fewer
    predecessors (only the start of a series has those)."""
    if first >= lags:
        return (design.T @ design).ravel(), None
    heads = np.zeros((lags, design.shape[1]))
    short = min(lags - first, len(design))
    heads[first : first + short] = design[:short]
    body = design[short:]
    return (body.T @ body).ravel(), heads.ravel()


def lagged_products(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    columns: Sequence[str],
    design: Design,
    limit: LagLimit,
    further: int = 0,
    long: bool | None = None,
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """One row per series: n, low, high (of the last column), `lags`, `body` (the
    matrix of the rows with all lags, flattened) and `heads` (the first design rows).

    The lags of a series follow from its own length, which its group has in hand,
    so that the input is evaluated once. With `long`, series are cut into blocks of
    `rows_per_block` rows with a halo of the lags and `further` rows; the lengths
    then come from the checkpointed pieces. Otherwise a series is one group, which a
    daily calendar bounds. Unless told, rows ordered by days alone count as short.
    Values are centred per series: the designs hold a constant.
    """
    if long is None:
        long = not is_day_grain(df, order)
    if not keys:
        single = df.withColumn("_all_rows", F.lit(0))
        return lagged_products(
            single, ["_all_rows"], order, columns, design, limit, further, long, rows_per_block
        ).drop("_all_rows")
    keys, order, columns = list(keys), list(order), list(columns)
    rows = df.select(*keys, *order, *[F.col(c).cast("double").alias(c) for c in columns]).dropna(
        how="any", subset=columns
    )
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    key_schema = "".join(f"`{k}` {types[k]}, " for k in keys)
    schema = key_schema + "n long, low double, high double, lags int, body array<double>, heads array<double>"

    def values_of(table: pa.Table, by: str) -> tuple[np.ndarray, np.ndarray]:
        sequence = np.argsort(table[by].to_numpy(), kind="stable")
        return np.column_stack([table[c].to_numpy() for c in columns])[sequence], sequence

    def row(key: tuple, values: np.ndarray, lags: int, body: np.ndarray, heads: np.ndarray | None, **more) -> pa.Table:
        last = values[:, -1]
        cells = {k: pa.array([held.as_py()], held.type) for k, held in zip(keys, key)}
        cells |= {"n": [len(values)], "low": [float(last.min())], "high": [float(last.max())]}
        cells |= {"lags": pa.array([lags], pa.int32())}
        doubles = pa.list_(pa.float64())
        cells |= {"body": pa.array([body], doubles), "heads": pa.array([heads], doubles)}
        return pa.table(cells | more)

    if not long:
        by = "_order"
        daily = len(order) == 1 and is_day_grain(rows, order)
        in_order = F.unix_date(order[0]) if daily else F.row_number().over(Series(keys, order).forward)

        def whole(key: tuple, table: pa.Table) -> pa.Table:
            values, sequence = values_of(table, by)
            if (np.diff(table[by].to_numpy()[sequence]) == 0).any():
                raise ValueError(f"more than one row for a day of series {[k.as_py() for k in key]}")
            lags = limit.of(len(values))
            design_rows, first = design(lags)(values - values.mean(0), 0)
            return row(key, values, lags, *_summary(design_rows, first, lags))

        return rows.select(*keys, in_order.alias(by), *columns).groupBy(*keys).applyInArrow(whole, schema)

    spark = df.sparkSession
    pieces = range_pieces(rows, keys, order)
    known = pieces.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), *[F.avg(c).alias(f"_mean_{c}") for c in columns])
    placed = indexed(pieces, keys, "_index").join(known, keys)
    centred = placed.withColumns({c: F.col(c) - F.col(f"_mean_{c}") for c in columns})
    # One row more than the limit, should a power in the JVM round the other way.
    reach = limit.column(F.col("_n")) + (further + 1)
    blocks = blocks_with_halo(
        centred.select(*keys, "_index", "_n", *columns), "_index", reach, F.greatest(F.lit(rows_per_block), reach)
    )

    def block(key: tuple, table: pa.Table) -> pa.Table:
        values, sequence = values_of(table, "_index")
        halo = int(table["_halo"].to_numpy()[sequence].sum())
        part = {"_part": [key[-1].as_py() // _COMBINE_FANIN]}
        lags = limit.of(table["_n"][0].as_py())
        if halo == len(values):  # the series ended with the block before
            return row(key[:-1], values, lags, np.zeros(0), None, **part).slice(0, 0)
        design_rows, first = design(lags)(values, halo)
        return row(key[:-1], values[halo:], lags, *_summary(design_rows, first, lags), **part)

    # An explicit count keeps adaptive execution from merging blocks by their
    # few bytes: the work per byte is high here.
    spread = blocks.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *keys, "_block")
    parts = spread.groupBy(*keys, "_block").applyInArrow(block, schema + ", _part long")
    for _ in range(_COMBINE_LEVELS):
        summed = _combined(parts, [*keys, "_part"])
        parts = summed.withColumn("_part", F.floor(F.col("_part") / _COMBINE_FANIN).cast("long"))
    return _combined(parts, keys)


def _combined(parts: DataFrame, group: Sequence[str]) -> DataFrame:
    """Add up the matrices of a bounded number of parts per group."""
    total = F.aggregate(
        F.slice("_all", 2, F.size("_all")),
        F.get("_all", F.lit(0)),
        lambda held, one: F.zip_with(held, one, lambda a, b: a + b),
    )
    return (
        parts.groupBy(*group)
        .agg(
            F.sum("n").alias("n"),
            F.min("low").alias("low"),
            F.max("high").alias("high"),
            F.max("lags").alias("lags"),
            F.collect_list("body").alias("_all"),
            F.max("heads").alias("heads"),
        )
        .select(*group, "n", "low", "high", "lags", total.alias("body"), "heads")
    )


def unpack(body: pd.Series, heads: pd.Series, width: int, lags: int) -> tuple[np.ndarray, np.ndarray]:
    """Matrices (systems, width, width) and head rows (systems, lags, width)."""
    return np.stack(body.to_list()).reshape(-1, width, width), np.stack(heads.to_list()).reshape(-1, lags, width)


def with_predecessors(body: np.ndarray, heads: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Matrices over the rows with at least `least` predecessors."""
    chosen = np.arange(heads.shape[1])[None, :] >= least[:, None]
    picked = heads * chosen[:, :, None]
    return body + np.einsum("sti,stj->sij", picked, picked)
