"""Scans: header CSV with a declared schema, Parquet, and the feature table."""

from __future__ import annotations

import csv
from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, FloatType, StringType, StructField, StructType

from dayloom.functions.scalar import day_from_epoch, day_from_iso, day_from_local, nonfinite_to_null


def nan_to_null(df: DataFrame) -> DataFrame:
    """Turn NaN and infinities of every floating column into NULL."""
    floating = {f.name for f in df.schema.fields if isinstance(f.dataType, (DoubleType, FloatType))}
    return df.select(
        *[
            nonfinite_to_null(F.col(f"`{c}`")).alias(c) if c in floating else F.col(f"`{c}`")
            for c in df.columns
        ]
    )


# Headers read at the same time.
_READERS = 8


def _by_header(spark: SparkSession, path: str | Sequence[str]) -> dict[tuple[str, ...], list[str]]:
    """The files at a path, grouped by the names in their first line.

    Spark takes one header for all files of a scan and matches the others by
    place, so files of different headers must be scanned apart. Each header is one
    small job over the first line of a file, for the files that the driver lists.
    """
    files = spark.read.text(path).inputFiles()

    def header(file: str) -> tuple[str, ...]:
        first = spark.read.text(file).head(1)
        return tuple(next(csv.reader([first[0][0]]), ())) if first else ()

    with ThreadPoolExecutor(_READERS) as pool:
        found = list(pool.map(header, files))
    groups: dict[tuple[str, ...], list[str]] = {}
    for names, file in zip(found, files):
        groups.setdefault(names, []).append(file)
    return groups


def _cells(spark: SparkSession, path: str | Sequence[str], kept: Sequence[StructField]) -> DataFrame:
    """Text of the declared columns by name, from files that may each have a header of their own, and `_file`."""
    names = [f.name for f in kept]
    parts = []
    for header, files in _by_header(spark, path).items():
        if not header:
            continue  # a file without a line
        lost = [n for n in names if n not in header]
        if lost:
            raise ValueError(f"no column {lost[0]!r} in the header of {files[0]}")
        text = spark.read.option("header", True).option("escape", '"').csv(files)
        parts.append(text.select(*[F.col(f"`{n}`").cast("string").alias(n) for n in names], F.input_file_name().alias("_file")))
    if not parts:
        return spark.createDataFrame([], StructType([StructField(n, StringType()) for n in [*names, "_file"]]))
    return reduce(DataFrame.unionByName, parts)


def read_series_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: StructType | str,
    columns: Sequence[str] | None = None,
    bad_values: str = "null",
) -> DataFrame:
    """Read header CSV with declared types (never inferred).

    Columns are found by the names in the header of each file: it may hold more of
    them, in any order, and the files of a folder or list may differ in that. A
    declared column that a file lacks is refused. What cannot be read as the
    declared type is NULL and listed by `rejected_cells`; with bad_values='raise' it
    raises. `columns` keeps a subset; Spark parses only what is used.
    """
    if bad_values not in ("null", "raise"):
        raise ValueError("bad_values is 'null' or 'raise'")
    declared = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    kept = [f for f in declared.fields if columns is None or f.name in columns]
    text = _cells(spark, path, kept)

    def typed(f: StructField) -> Column:
        cell = F.col(f"`{f.name}`")
        read = cell.try_cast(f.dataType)
        if bad_values == "raise":
            said = F.concat(F.col("_file"), F.lit(f": {f.name} is no {f.dataType.simpleString()} in "), cell)
            read = F.when(_unread(cell, f), F.raise_error(said).cast(f.dataType)).otherwise(read)
        return read.alias(f.name)

    rows = nan_to_null(text.select(*map(typed, kept)))
    return rows if columns is None else rows.select(*[F.col(f"`{c}`") for c in columns])


def _unread(cell: Column, field: StructField) -> Column:
    return cell.isNotNull() & cell.try_cast(field.dataType).isNull()


def rejected_cells(
    spark: SparkSession, path: str | Sequence[str], schema: StructType | str, columns: Sequence[str] | None = None
) -> DataFrame:
    """(file, column, cell, n): texts that `read_series_csv` cannot read as declared, and how often each is there."""
    declared = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    kept = [f for f in declared.fields if columns is None or f.name in columns]
    bad = F.array(*[F.struct(F.lit(f.name).alias("column"), F.when(_unread(F.col(f"`{f.name}`"), f), F.col(f"`{f.name}`")).alias("cell")) for f in kept])
    rows = _cells(spark, path, kept).select(F.col("_file").alias("file"), F.explode(bad).alias("c"))
    return rows.where(F.col("c.cell").isNotNull()).groupBy("file", "c.column", "c.cell").agg(F.count("*").alias("n"))


def parse_day(column: str, encoding: str, fmt: str = "yyyy-MM-dd") -> Column:
    """Day column for one of the encodings `epoch`, `iso`, `local`, `day`."""
    c = F.col(f"`{column}`")
    if encoding == "epoch":
        return day_from_epoch(c)
    if encoding == "iso":
        return day_from_iso(c)
    if encoding == "local":
        return day_from_local(c, fmt)
    if encoding == "day":
        return c.cast("date")
    raise ValueError(f"unknown day encoding {encoding!r}")


def load_feature_table(df: DataFrame, day: str = "day", after: str = "2017-01-03") -> DataFrame:
    """Prepare a consolidated table for study: cut, whole-row dedup, typed day."""
    return (
        df.withColumn(day, F.col(day).cast("date"))
        .filter(F.col(day) > F.lit(after).cast("date"))
        .dropDuplicates()
    )


def read_feature_table(
    spark: SparkSession, path: str, day: str = "day", after: str = "2017-01-03"
) -> DataFrame:
    """`load_feature_table` over a table written by `write_table`, as Parquet or,
    where the path says so, as CSV; all columns but the day are then numbers."""
    if not path.rstrip("/").endswith(".csv"):
        return load_feature_table(spark.read.parquet(path), day, after)
    text = spark.read.option("header", True).csv(path)
    typed = text.select(*[F.col(f"`{c}`").try_cast("date" if c == day else "double").alias(c) for c in text.columns])
    return load_feature_table(nan_to_null(typed), day, after)
