"""Daily panels derived from the test tables, in Spark and in SQL.

Sums are rounded to cents so that both engines continue from equal doubles.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from dayloom.session import ensure_checkpoint_dir

START, END, CUT = "1995-01-01", "2001-08-01", "1998-04-15"
EVENTS_START, EVENTS_END = "2024-01-01", "2024-01-31"
GROUPS = ("AF", "AO", "NF", "NO", "RF", "RO")
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder next to the checkpoints, which all executors can reach."""
    return f"{ensure_checkpoint_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"


def orders_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series, day, value): order value by priority and day."""
    return (
        table(spark, sf_dir, "orders")
        .groupBy(F.col("o_orderpriority").alias("series"), F.to_date("o_orderdate").alias("day"))
        .agg(F.round(F.sum("o_totalprice"), 2).alias("value"))
    )


def orders_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(day, p1..p5): order value by day, one column per priority."""
    return (
        table(spark, sf_dir, "orders")
        .groupBy(F.to_date("o_orderdate").alias("day"))
        .agg(
            *[
                F.round(F.sum(F.when(F.col("o_orderpriority") == p, F.col("o_totalprice"))), 2).alias(f"p{p[0]}")
                for p in PRIORITIES
            ]
        )
    )


def ship_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series, day, qty, price, hi, lo, disc, tax, n) of shipped lines."""
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.concat("l_returnflag", "l_linestatus").alias("series"), F.to_date("l_shipdate").alias("day"))
        .agg(
            F.round(F.sum("l_quantity"), 2).alias("qty"),
            F.round(F.sum("l_extendedprice"), 2).alias("price"),
            F.max("l_extendedprice").alias("hi"),
            F.min("l_extendedprice").alias("lo"),
            F.round(F.sum("l_discount"), 2).alias("disc"),
            F.round(F.sum("l_tax"), 2).alias("tax"),
            F.count(F.lit(1)).alias("n"),
        )
    )


def ship_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(day, <group>_qty, <group>_price for every group) of shipped lines."""
    cells = []
    for g in GROUPS:
        mine = (F.col("l_returnflag") == g[0]) & (F.col("l_linestatus") == g[1])
        cells.append(F.round(F.sum(F.when(mine, F.col("l_quantity"))), 2).alias(f"{g.lower()}_qty"))
        cells.append(F.round(F.sum(F.when(mine, F.col("l_extendedprice"))), 2).alias(f"{g.lower()}_price"))
    return table(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("day")).agg(*cells)


def events_ohlc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series, day, open, high, low, close) of event values."""
    at = F.struct("ts", "event_id")
    return (
        table(spark, sf_dir, "events")
        .groupBy(F.col("event_type").alias("series"), F.to_date("ts").alias("day"))
        .agg(
            F.min_by("value", at).alias("open"),
            F.max("value").alias("high"),
            F.min("value").alias("low"),
            F.max_by("value", at).alias("close"),
        )
    )


def event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw events with a value that is missing where it is small."""
    return table(spark, sf_dir, "events").select(
        F.col("event_type").alias("series"),
        F.col("ts").cast("timestamp").alias("ts"),
        "event_id",
        "value",
        F.when(F.col("value") >= 20, F.col("value")).alias("sparse"),
    )


# The same panels for the SQL side, as CTE bodies.

OD = """od as (select o_orderpriority as series, cast(o_orderdate as date) as day,
  round(sum(o_totalprice), 2) as value from orders group by 1, 2)"""

SPINE = f"""cal as (select cast(unnest(generate_series(date '{START}', date '{END}', interval 1 day)) as date) as day)"""

ALIGNED = f"""{OD}, {SPINE},
sp as (select s.series, c.day from (select distinct series from od) s cross join cal c),
al as (select sp.series, sp.day, od.value from sp left join od on od.series = sp.series and od.day = sp.day)"""

FILLED = f"""{ALIGNED},
ff as (select series, day, last_value(value ignore nulls) over (partition by series order by day
  rows between unbounded preceding and current row) as value from al)"""

OW = """ow as (select cast(o_orderdate as date) as day, """ + ", ".join(
    f"round(sum(case when o_orderpriority = '{p}' then o_totalprice end), 2) as p{p[0]}" for p in PRIORITIES
) + " from orders group by 1)"

SHIP = """ship as (select l_returnflag || l_linestatus as series, cast(l_shipdate as date) as day,
  round(sum(l_quantity), 2) as qty, round(sum(l_extendedprice), 2) as price,
  max(l_extendedprice) as hi, min(l_extendedprice) as lo, round(sum(l_discount), 2) as disc,
  round(sum(l_tax), 2) as tax, count(*) as n from lineitem group by 1, 2)"""

SHIP_WIDE = (
    "sw as (select cast(l_shipdate as date) as day, "
    + ", ".join(
        f"round(sum(case when l_returnflag = '{g[0]}' and l_linestatus = '{g[1]}' then {c} end), 2) as {g.lower()}_{n}"
        for g in GROUPS
        for c, n in (("l_quantity", "qty"), ("l_extendedprice", "price"))
    )
    + " from lineitem group by 1)"
)

OHLC = """oh as (select event_type as series, cast(ts as date) as day,
  arg_min(value, (ts, event_id)) as open, max(value) as high, min(value) as low,
  arg_max(value, (ts, event_id)) as close from events group by 1, 2)"""

EV = """ev as (select event_type as series, ts, event_id, value,
  case when value >= 20 then value end as sparse from events)"""


def ln(x: str) -> str:
    return f"(case when {x} > 0 then ln({x}) end)"


def r(x: str, digits: int = 6) -> str:
    return f"round({x}, {digits}) + 0.0"


W = "(partition by series order by day)"


def rows(n: int) -> str:
    return f"(partition by series order by day rows between {n - 1} preceding and current row)"
