"""Additive cross-products of many columns.

Each task reduces its batches to one packed row per group: for all pairs of
columns the number of complete rows, both means, both centred sums of squares and
the centred cross-product, in one array. A group with so few rows in a task that
the rows themselves are shorter is packed as rows, so what is shuffled is never
longer than the input. Blocks are centred on their own means, so large levels do
not cancel, and merge exactly:

    C = sum(C_b) + sum(n_b (mx_b - mx)(my_b - my))

Packed rows are merged as a tree with an exchange below each level: first the rows of
the tasks of one part, in as many places as there are parts, then one row for each
part and group. So the rows of all tasks meet in one place for no group, not even
where there is only one; a million tasks send a thousand rows to each part.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

# Numbers one task holds before it hands them on, and parts its tasks fall into.
_OPEN_NUMBERS = 2_000_000
_PARTS = 1024

PAIR = ("i", "j")
MOMENTS = ("n", "mean_i", "mean_j", "ss_i", "ss_j", "cp")
_MOMENT_SCHEMA = "i int, j int, n double, mean_i double, mean_j double, ss_i double, ss_j double, cp double"


def _block(x: np.ndarray) -> np.ndarray:
    """Co-moments of every column pair over the rows complete in that pair;
    stacked (moment, i, j)."""
    present = ~np.isnan(x)
    centre = np.where(present.any(0), np.nansum(x, 0) / np.maximum(present.sum(0), 1), 0.0)
    m = present.astype(float)
    z = np.where(present, x - centre, 0.0)
    n = m.T @ m
    s = z.T @ m  # sum of column i over rows where j is present too
    q = (z * z).T @ m
    safe = np.maximum(n, 1.0)
    return np.stack(
        [
            n,
            s / safe + centre[:, None],
            s.T / safe + centre[None, :],
            q - s * s / safe,
            q.T - s.T * s.T / safe,
            z.T @ z - s * s.T / safe,
        ]
    )


def _merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    n = a[0] + b[0]
    safe = np.maximum(n, 1.0)
    di, dj = b[1] - a[1], b[2] - a[2]
    w = a[0] * b[0] / safe
    return np.stack(
        [
            n,
            (a[0] * a[1] + b[0] * b[1]) / safe,
            (a[0] * a[2] + b[0] * b[2]) / safe,
            a[3] + b[3] + w * di * di,
            a[4] + b[4] + w * dj * dj,
            a[5] + b[5] + w * di * dj,
        ]
    )


def _pack(held: list[np.ndarray]) -> np.ndarray:
    """Blocks of rows or moments of one group as one: (rows, columns) or (moment, i, j)."""
    rows = [h for h in held if h.ndim == 2]
    out = [h for h in held if h.ndim == 3]
    if rows:
        table = np.concatenate(rows)
        width = table.shape[1]
        if not out and len(table) < len(MOMENTS) * width:
            return table
        out.append(_block(table))
    return reduce(_merge, out)


def _moments(packed: np.ndarray) -> np.ndarray:
    return packed if packed.ndim == 3 else _block(packed)


def _flat(packed: np.ndarray) -> np.ndarray:
    return packed.ravel()


def _unflat(numbers: np.ndarray, is_rows: bool, width: int) -> np.ndarray:
    return numbers.reshape(-1, width) if is_rows else numbers.reshape(len(MOMENTS), width, width)


def _plain(key) -> tuple:
    """A group key that equals itself also where it is missing."""
    return tuple(None if pd.isna(v) else v for v in (key if isinstance(key, tuple) else (key,)))


def _groups(batch: pd.DataFrame, keys: list[str]):
    """(key, positions of its rows)."""
    if not keys:
        return [((), np.arange(len(batch)))]
    by = batch.groupby(keys if len(keys) > 1 else keys[0], sort=False, dropna=False)
    codes = by.ngroup().to_numpy()
    order = np.argsort(codes, kind="stable")
    cuts = np.flatnonzero(np.diff(codes[order])) + 1
    parts = np.split(order, cuts)
    heads = batch[keys].iloc[[p[0] for p in parts]].itertuples(index=False, name=None)
    return [(_plain(head), part) for head, part in zip(heads, parts)]


def _packed_rows(keys: list[str], part: int, held: dict) -> pd.DataFrame:
    packed = [_pack(blocks) for blocks in held.values()]
    out = pd.DataFrame({
        "_part": np.full(len(held), part, dtype="int32"), "_rows": [p.ndim == 2 for p in packed],
        "_numbers": [_flat(p) for p in packed],
    })
    for at, name in enumerate(keys):
        out.insert(at, name, pd.Series([key[at] for key in held], dtype=object))
    return out


def _partials_by_block(df: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Packed rows (keys, part, whether rows, numbers), one for each group and task."""
    keys, columns = list(keys), list(columns)
    key_types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    schema = "".join(f"`{k}` {key_types[k]}, " for k in keys) + "_part int, _rows boolean, _numbers array<double>"

    def reduce_batches(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId() % _PARTS
        groups: dict = {}
        size = 0
        for batch in batches:
            values = batch[columns].to_numpy(dtype=float)
            for key, rows in _groups(batch, keys):
                mine = groups.setdefault(key, [])
                mine.append(values[rows])
                size += mine[-1].size
                if sum(len(m) for m in mine if m.ndim == 2) >= len(MOMENTS) * len(columns):
                    before = sum(m.size for m in mine)
                    groups[key] = [_pack(mine)]
                    size += groups[key][0].size - before
            if size > _OPEN_NUMBERS:
                yield _packed_rows(keys, part, groups)
                groups, size = {}, 0
        if groups:
            yield _packed_rows(keys, part, groups)

    wanted = df.select(*keys, *[F.col(f"`{c}`").cast("double").alias(c) for c in columns])
    return wanted.mapInPandas(reduce_batches, schema)


def _merged(partials: DataFrame, width: int, keys: Sequence[str]) -> DataFrame:
    """Pair rows (keys, i, j, moments) from packed rows, by parts and then whole."""
    keys = list(keys)
    key_types = {f.name: f.dataType.simpleString() for f in partials.schema.fields}
    key_schema = "".join(f"`{k}` {key_types[k]}, " for k in keys)
    upper = np.triu_indices(width)

    def by_group(batches: Iterator[pd.DataFrame], names: list[str]):
        """(key, packed blocks) of groups that stand together."""
        held: dict = {}
        for batch in batches:
            numbers, is_rows = batch["_numbers"].to_list(), batch["_rows"].to_numpy(bool)
            for key, rows in _groups(batch, names):
                if key not in held and held:
                    yield from held.items()
                    held = {}
                blocks = [_unflat(np.asarray(numbers[r], float), is_rows[r], width) for r in rows]
                held[key] = [_pack([*held.get(key, []), *blocks])]
        yield from held.items()

    def combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        some: dict = {}
        for key, blocks in by_group(batches, [*keys, "_part"]):
            some.setdefault(key[:-1], []).extend(blocks)
            if len(some) >= 512:
                yield _packed_rows(keys, 0, some)
                some = {}
        if some:
            yield _packed_rows(keys, 0, some)

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        some: list = []
        for key, blocks in by_group(batches, keys):
            moments = _moments(blocks[0])
            part = pd.DataFrame(dict(zip(MOMENTS, moments[:, upper[0], upper[1]])))
            part.insert(0, "i", upper[0].astype("int32"))
            part.insert(1, "j", upper[1].astype("int32"))
            for at, (name, value) in enumerate(zip(keys, key)):
                part.insert(at, name, pd.Series([value] * len(part), dtype=object))
            some.append(part)
            if len(some) >= 128:
                yield pd.concat(some, ignore_index=True)
                some = []
        if some:
            yield pd.concat(some, ignore_index=True)

    packed = key_schema + "_part int, _rows boolean, _numbers array<double>"
    in_parts = partials.repartition(*keys, "_part").sortWithinPartitions(*keys, "_part").mapInPandas(combine, packed)
    # Not coalesce: without an exchange here, one task would do the parts' work too.
    whole = in_parts.repartition(*keys) if keys else in_parts.repartition(1)
    return whole.sortWithinPartitions(*keys, "_part").mapInPandas(unpack, key_schema + _MOMENT_SCHEMA)


def merge_comoments(partials: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Merge the pair rows of a few groups into larger ones, per (keys, i, j); the pooled means come from a window
    over the same exchange the aggregate uses."""
    group = [*keys, *PAIR]
    pooled = Window.partitionBy(*group)

    def mean(m: str) -> Column:
        return F.sum(F.col("n") * F.col(m)).over(pooled) / F.greatest(F.sum("n").over(pooled), F.lit(1.0))

    di, dj = F.col("mean_i") - F.col("_mi"), F.col("mean_j") - F.col("_mj")
    return (
        partials.repartition(*group)
        .withColumns({"_mi": mean("mean_i"), "_mj": mean("mean_j")})
        .groupBy(*group)
        .agg(
            F.sum("n").alias("n"),
            F.max("_mi").alias("mean_i"),
            F.max("_mj").alias("mean_j"),
            F.sum(F.col("ss_i") + F.col("n") * di * di).alias("ss_i"),
            F.sum(F.col("ss_j") + F.col("n") * dj * dj).alias("ss_j"),
            F.sum(F.col("cp") + F.col("n") * di * dj).alias("cp"),
        )
    )


def comoments(
    df: DataFrame,
    columns: Sequence[str],
    keys: Sequence[str] = (),
    complete_rows: bool = False,
) -> DataFrame:
    """Co-moments (keys, i, j, n, mean_i, mean_j, ss_i, ss_j, cp), i <= j, where
    i and j are positions in `columns`.

    NULLs are deleted pair by pair, or by row with `complete_rows`.
    """
    if complete_rows:
        df = df.dropna(how="any", subset=list(columns))
    return _merged(_partials_by_block(df, columns, keys), len(columns), keys)


# A centred sum of squares this small next to the squared mean is a constant
# column seen through rounding.
_CONSTANT = 1e-24


def varies(side: str) -> Column:
    """Whether column i or j of a pair is more than a constant."""
    mean = F.col(f"mean_{side}")
    return F.col(f"ss_{side}") > _CONSTANT * F.col("n") * mean * mean


def scatter_matrices(moments: DataFrame, keys: Sequence[str], order: int) -> DataFrame:
    """One row per group: n and the centred cross-product matrix, flattened in
    row order. The list per group has order*(order+1)/2 entries."""
    moments = moments.withColumn("cp", F.when(varies("i") & varies("j"), F.col("cp")).otherwise(0.0))
    both_halves = F.when(
        F.col("i") != F.col("j"),
        F.array(F.struct("i", "j", "cp"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"), "cp")),
    ).otherwise(F.array(F.struct("i", "j", "cp")))
    return (
        moments.select(*keys, "n", F.explode(both_halves).alias("_e"))
        .select(*keys, "n", (F.col("_e.i") * order + F.col("_e.j")).alias("_at"), F.col("_e.cp").alias("_v"))
        .groupBy(*keys)
        .agg(
            F.max("n").alias("n"),
            F.transform(F.array_sort(F.collect_list(F.struct("_at", "_v"))), lambda s: s["_v"]).alias("scatter"),
        )
    )
