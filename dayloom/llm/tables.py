"""Helpers shared by the operators: tables, texts of Arrow batches, text columns."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from dayloom.session import configure, ensure_checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def settle(df: DataFrame, files: int | None = None) -> DataFrame:
    """Cut the lineage through the shared checkpoint folder, with at most so many files.

    On a local file system an executor starts two processes for each file, to set the
    modes of the file and of its checksums.
    """
    ensure_checkpoint_dir(df.sparkSession)
    return (df if files is None else df.coalesce(files)).checkpoint()


# Short rows (a few ids) that one file holds.
FILE_ROWS = 250_000


def files_of(short_rows: int) -> int:
    return short_rows // FILE_ROWS + 1


def in_full_tasks(df: DataFrame, column: str, size: int) -> DataFrame:
    """The rows in no more tasks than have `size` bytes of the column each; larger tasks stay as they are."""
    total = df.agg(F.sum(F.octet_length(column))).first()[0] or 0
    return df.coalesce(total // size + 1)


# Short rows that are small enough to be sent to every executor.
BROADCAST_ROWS = 500_000


def sent_if_small(short_rows: DataFrame) -> DataFrame:
    """Rows of a few ids, marked for a broadcast if there are few; else Spark joins by a shuffle."""
    few = short_rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return F.broadcast(short_rows) if few else short_rows


def crc_of(id_column: Column) -> Column:
    """crc32 of the id as text; of the empty text where it is null."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary"))


def crc32(value) -> int:
    """The same as `crc_of`, in Python."""
    return zlib.crc32(b"" if value is None else str(value).encode())


def texts(column: pa.Array) -> list[str]:
    """Texts of an Arrow column, null as the empty text."""
    return [t or "" for t in column.to_pylist()]


def utf8(column: pa.Array) -> list[bytes]:
    """The same as UTF-8, without decoding."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [t or b"" for t in column.cast(kind).to_pylist()]


# Batches are worked on in slices of about this many bytes.
SLICE_BYTES = 4_000_000


def slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch in slices of rows, so that what is made of one does not grow with long texts."""
    rows = max(1, int(batch.num_rows * SLICE_BYTES / max(batch.nbytes, 1)))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def per_row(
    df: DataFrame, keep: list[str], reads: list[str], compute: Callable[[], Callable[..., Iterable]], schema: str
) -> DataFrame:
    """One row out for each row in: `keep`, and what `compute()(*reads)` returns as columns of `schema`.

    `compute()` is called once in each task and may build tables there. Rows
    keep their order within the batch, so ids may repeat or be null.
    """
    names = [c.split()[0] for c in schema.split(", ")]
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema.fields)
    inner = df.select(*keep, *(F.col(c).alias(f"__in{i}") for i, c in enumerate(reads)))
    whole = f"{kept}, {schema}" if keep else schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = compute()
        for batch in (part for full in batches for part in slices(full)):
            out = work(*(batch.column(len(keep) + i) for i in range(len(reads))))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *out], names=[*keep, *names])

    return inner.mapInArrow(run, whole)


def rows_where(df: DataFrame, reads: list[str], verdict: Callable[[], Callable[..., Iterable[bool]]]) -> DataFrame:
    """The rows for which `verdict()(*reads)` is true, with all their columns whatever their names."""
    places = [df.columns.index(c) for c in reads]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = verdict()
        for batch in (part for full in batches for part in slices(full)):
            yield batch.filter(pa.array(judge(*(batch.column(i) for i in places)), pa.bool_()))

    return df.mapInArrow(run, df.schema)
