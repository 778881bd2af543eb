"""Catalogue to consolidated table in two exchanges.

All indicators become rows (series, day, value) of one tall table. One exchange
on the series serves the row offsets, the calendar alignment, the forward fill
and the transform; which rule applies is a literal per series. One exchange on
the day turns the result into one wide row per day. Adding an indicator adds
rows, not joins.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping, Sequence
from datetime import date, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from dayloom.functions.scalar import is_weekend, log_count, safe_ln, zero_to_null
from dayloom.operators.calendar import SPINE_END, SPINE_START, align_to_spine, calendar_spine
from dayloom.operators.windows import Series
from dayloom.plans.catalog import CONSOLIDATED_COLUMNS, FEATURES, SOURCES, Feature
from dayloom.sources.readers import parse_day, read_series_csv


def read_sources(spark: SparkSession, folder: str, names: Iterable[str] | None = None) -> dict[str, DataFrame]:
    """Scan the raw CSV files of a folder with their declared schemas."""
    wanted = SOURCES if names is None else {n: SOURCES[n] for n in names}
    return {n: read_series_csv(spark, f"{folder}/{n}.csv", s.schema) for n, s in wanted.items()}


def rejected_rows(sources: Mapping[str, DataFrame], panel: Sequence[str] = ()) -> DataFrame:
    """(source, panel, day_text) of the rows whose day cannot be read."""
    parts = []
    for name, df in sources.items():
        source = SOURCES[name]
        bad = df.filter(parse_day(source.day, source.encoding, source.fmt).isNull())
        parts.append(bad.select(F.lit(name).alias("source"), *panel, F.col(f"`{source.day}`").cast("string").alias("day_text")))
    return reduce(DataFrame.union, parts)


def tall_values(
    sources: Mapping[str, DataFrame],
    features: Sequence[Feature] = FEATURES,
    panel: Sequence[str] = (),
    bad_days: str = "raise",
) -> DataFrame:
    """(panel, day, series, value) of every feature whose source is given; each
    source is scanned once however many features it feeds.

    A day that cannot be read raises; with bad_days='drop' such rows are left
    out, and `rejected_rows` lists them.
    """
    if bad_days not in ("raise", "drop"):
        raise ValueError("bad_days is 'raise' or 'drop'")
    parts = []
    for name, df in sources.items():
        source = SOURCES[name]
        mine = [f for f in features if f.source == name]
        if not mine:
            continue
        cells = F.array(
            *[F.struct(F.lit(f.level).alias("series"), f.value().cast("double").alias("value")) for f in mine]
        )
        day = parse_day(source.day, source.encoding, source.fmt)
        if bad_days == "raise":
            text = F.coalesce(F.col(f"`{source.day}`").cast("string"), F.lit("NULL"))
            day = F.coalesce(day, F.raise_error(F.concat(F.lit(f"{name}: no day in "), text)).cast("date"))
        rows = df.select(*panel, day.alias("day"), F.inline(cells))
        parts.append(rows if bad_days == "raise" else rows.filter(F.col("day").isNotNull()))
    return reduce(DataFrame.union, parts)


# How one series is prepared; `first` is the first day in use.
_RULE = "fill: string, transform: string, on_file: boolean, zero_is_missing: boolean, first: date"


def rules(features: Sequence[Feature]) -> Column:
    """The rule of every series, a map in one literal: rows look theirs up, and no expression grows with the features."""
    table = {
        f.level: {
            "fill": f.fill, "transform": f.transform, "on_file": f.grain == "file",
            "zero_is_missing": f.zero_is_missing, "first": _first_day(f),
        }
        for f in features
    }
    return F.from_json(F.lit(json.dumps(table)), f"map<string, struct<{_RULE}>>")


def _first_day(f: Feature) -> str | None:
    if f.start is None or f.inclusive:
        return f.start
    return (date.fromisoformat(f.start) + timedelta(days=1)).isoformat()


def prepared(
    tall: DataFrame,
    features: Sequence[Feature] = FEATURES,
    panel: Sequence[str] = (),
    start: str = SPINE_START,
    end: str = SPINE_END,
) -> DataFrame:
    """Align, fill, transform and cut: (panel, series, day, level, change)."""
    keys = [*panel, "series"]
    by_day = Series(keys, ["day"])
    on_file = tall.withColumn("_file_before", by_day.lag("value"))
    aligned = align_to_spine(on_file, keys, "day", ["value", "_file_before"], start, end)
    fill, transform = F.col("_rule.fill"), F.col("_rule.transform")
    cleaned = (
        F.when(F.col("_rule.zero_is_missing"), zero_to_null("value"))
        .when(fill == "zero_before", F.coalesce("value", F.lit(0.0)))
        .otherwise(F.col("value"))
    )
    filled = F.when(fill == "forward", by_day.forward_fill("_clean")).otherwise(F.col("_clean"))
    before = F.when(F.col("_rule.on_file"), F.col("_file_before")).otherwise(by_day.lag("level"))
    change = (
        F.when(transform == "log_return", safe_ln("level") - safe_ln("_before"))
        .when(transform == "log_return_shifted", log_count("level") - log_count("_before"))
        .when(transform == "difference", F.col("level") - F.col("_before"))
    )
    in_use = F.coalesce(F.col("day") >= F.col("_rule.first"), F.lit(True))

    def finished(c: str) -> Column:
        return F.when(in_use, F.when(fill == "zero_after", F.coalesce(c, F.lit(0.0))).otherwise(F.col(c))).alias(c)

    ruled = aligned.withColumn("_rule", F.element_at(rules(features), F.col("series"))).withColumn("_clean", cleaned)
    steps = ruled.withColumn("level", filled).withColumn("_before", before).withColumn("change", change)
    return steps.select(*keys, "day", finished("level"), finished("change"))


def consolidated(
    sources: Mapping[str, DataFrame],
    features: Sequence[Feature] = FEATURES,
    panel: Sequence[str] = (),
    start: str = SPINE_START,
    end: str = SPINE_END,
    bad_days: str = "raise",
) -> DataFrame:
    """One row per (panel, day) of the calendar with every level and change.

    Cuts blank cells rather than drop rows, so every calendar day is present
    without joining the spine back. A source without rows counts as one without
    values: its zero-filled features are 0.
    """
    rows = prepared(tall_values(sources, features, panel, bad_days), features, panel, start, end)
    if not panel:
        # Each day once more, without a value: also there if no source has rows.
        days = calendar_spine(rows.sparkSession, start, end)
        blank = [F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("series", "level", "change")]
        rows = rows.unionByName(days.select("day", *blank))
    return widen(rows, features, panel, sources)


def widen(
    rows: DataFrame, features: Sequence[Feature] = FEATURES, panel: Sequence[str] = (), given: Iterable[str] = ()
) -> DataFrame:
    """(series, day, level, change) rows to one wide row per day. Features that
    are filled with zeros are so too where a `given` source has no rows at all.

    A day's cells are gathered into one map, one entry for each feature, so that
    the aggregate is the same for any number of features.
    """
    entry = F.when(F.col("series").isNotNull(), F.struct("series", F.struct("level", "change").alias("cell")))
    days = rows.groupBy(*panel, "day").agg(F.map_from_entries(F.collect_list(entry)).alias("_cells"))
    given, cells = set(given), {"day": "day", "is_weekend": "is_weekend"}
    for f in features:
        zeros = f.source in given and f.fill in ("zero_before", "zero_after")
        first = _first_day(f)
        here = f"element_at(_cells, {f.level!r})"
        empty = f"{here}.level is null" + (f" and day >= date '{first}'" if first else "")
        for name, part in ((f.level, "level"), (f.change, "change")):
            if name is not None:
                cells[name] = f"if({empty}, 0D, {here}.{part})" if zeros else f"{here}.{part}"
    ordered = [c for c in CONSOLIDATED_COLUMNS if c in cells] + [c for c in cells if c not in CONSOLIDATED_COLUMNS]
    dated = days.withColumn("is_weekend", is_weekend("day"))
    return dated.selectExpr(*[f"`{c}`" for c in panel], *[f"{cells[c]} as `{c}`" for c in ordered])
