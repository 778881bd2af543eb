"""Sources, projections, filters, cleaning, calendar and joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.panels import (
    ALIGNED, CUT, END, FILLED, GROUPS, OD, OW, SHIP, SHIP_WIDE, SPINE, START, W, ln, orders_daily, orders_wide,
    r, scratch, ship_daily, ship_wide, table,
)
from checks.registry import query, r6, rounded
from dayloom.functions import scalar
from dayloom.operators import align, calendar, clean
from dayloom.operators.profile import describe
from dayloom.operators.windows import Series
from dayloom.sources import readers, sinks

BY_DAY = Series(["series"], ["day"])


def aligned(spark, sf):
    return calendar.align_to_spine(orders_daily(spark, sf), ["series"], "day", ["value"], START, END)


def filled(spark, sf):
    return aligned(spark, sf).withColumn("value", BY_DAY.forward_fill("value"))


# Sources and sinks


@query("read_series_csv", f"with {OD} select series, day, {r('value')} as value from od")
def read_series_csv(spark, sf):
    path = scratch(spark, "series")
    sinks.write_table(orders_daily(spark, sf).withColumn("note", F.lit('a "quoted" note')), path, "csv")
    rows = readers.read_series_csv(spark, path, "series string, day date, value double, note string", ["series", "day", "value"])
    return rounded(rows, "value")


@query("read_series_csv_headers", f"with {OD} select series, day, {r('value')} as value from od")
def read_series_csv_headers(spark, sf):
    """Files of one folder with columns in another order, and with more of them."""
    path, rows = scratch(spark, "headers"), orders_daily(spark, sf)
    early = F.month("day") <= 6
    sinks.write_table(rows.filter(early), f"{path}/early", "csv")
    late = rows.filter(~early).select(F.lit("x, y").alias("a, note"), "value", "day", F.lit(1).alias("more"), "series")
    sinks.write_table(late, f"{path}/late", "csv")
    return rounded(readers.read_series_csv(spark, f"{path}/*", "series string, day date, value double", bad_values="raise"), "value")


@query(
    "rejected_cells",
    f"with {OD} select 'value' as \"column\", series as cell, count(*) as n from od where month(day) <= 2 group by series",
)
def rejected_cells(spark, sf):
    """Words where numbers should be, in some of the files."""
    path, rows = scratch(spark, "rejected"), orders_daily(spark, sf)
    odd = F.when(F.month("day") <= 2, F.col("series")).otherwise(F.col("value").cast("string"))
    sinks.write_table(rows.select("day", odd.alias("value")), path, "csv")
    found = readers.rejected_cells(spark, path, "day date, value double")
    return found.groupBy("column", "cell").agg(F.sum("n").alias("n"))


@query("write_table", f"with {OD} select series, day, {r('value')} as value from od")
def write_table(spark, sf):
    path = scratch(spark, "panel")
    sinks.write_table(orders_daily(spark, sf), path, partition_by=["series"])
    return rounded(spark.read.parquet(path), "value").select("series", "day", "value")


_DAYS = "select cast(ts as date) as day, event_type, count(*) as n, round(sum(value), 2) as total from events group by 1, 2"


def _by_day(df):
    return df.groupBy("day", "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("day_from_epoch", _DAYS)
def day_from_epoch(spark, sf):
    seconds = F.unix_seconds(F.col("ts").cast("timestamp"))
    return _by_day(table(spark, sf, "events").withColumn("day", scalar.day_from_epoch(seconds)))


@query("day_from_iso", _DAYS)
def day_from_iso(spark, sf):
    wall = F.col("ts") - F.expr("interval 5 hours")
    text = F.concat(F.date_format(wall, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("-05:00"))
    return _by_day(table(spark, sf, "events").withColumn("day", scalar.day_from_iso(text)))


@query("day_from_local", _DAYS)
def day_from_local(spark, sf):
    text = F.date_format("ts", "MM/dd/yyyy")
    return _by_day(table(spark, sf, "events").withColumn("day", scalar.day_from_local(text, "MM/dd/yyyy")))


@query(
    "calendar_spine",
    f"""with {SPINE}, n as (select cast(o_orderdate as date) as day, count(*) as orders from orders group by 1)
    select cal.day, cast(isodow(cal.day) in (6, 7) as integer) as is_weekend, coalesce(n.orders, 0) as orders
    from cal left join n on n.day = cal.day""",
)
def calendar_spine(spark, sf):
    counts = table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count(F.lit(1)).alias("orders"))
    spine = calendar.calendar_spine(spark, START, END)
    return align.enrich_left(spine, counts, "day").fillna(0, ["orders"])


@query(
    "load_feature_table",
    f"with {OW} select distinct day, {', '.join(r(f'p{i}') + f' as p{i}' for i in range(1, 6))} from ow where day > date '1995-02-01'",
)
def load_feature_table(spark, sf):
    wide = orders_wide(spark, sf)
    doubled = wide.unionByName(wide).withColumn("day", F.col("day").cast("string"))
    return rounded(readers.load_feature_table(doubled, "day", "1995-02-01"), *[f"p{i}" for i in range(1, 6)])


_STATS = (
    ("count", "count(value)"), ("mean", "avg(value)"), ("std", "stddev_samp(value)"), ("min", "min(value)"),
    ("p25", "quantile_cont(value, 0.25)"), ("p50", "quantile_cont(value, 0.5)"),
    ("p75", "quantile_cont(value, 0.75)"), ("max", "max(value)"),
)


@query(
    "write_describe",
    f"with {OW} "
    + " union all ".join(
        f"select '{name}' as statistic, "
        + ", ".join(f"{r('cast(' + agg.replace('value', f'p{i}') + ' as double)', 4)} as p{i}" for i in range(1, 6))
        + " from ow"
        for name, agg in _STATS
    ),
)
def write_describe(spark, sf):
    path, features = scratch(spark, "describe"), [f"p{i}" for i in range(1, 6)]
    sinks.write_describe(describe(orders_wide(spark, sf), features, grain="day"), path, features)
    back = readers.read_series_csv(spark, path, "statistic string, " + ", ".join(f"{f} double" for f in features))
    return rounded(back, *features, digits=4)


# Projections, filters and cleaning


@query("select_columns", "select o_orderkey, o_totalprice from orders")
def select_columns(spark, sf):
    return clean.select_columns(table(spark, sf, "orders"), ["o_orderkey", "o_totalprice"])


@query("rename_columns", "select o_orderkey as key, o_totalprice as price from orders")
def rename_columns(spark, sf):
    rows = clean.select_columns(table(spark, sf, "orders"), ["o_orderkey", "o_totalprice"])
    return clean.rename_columns(rows, {"o_orderkey": "key", "o_totalprice": "price"})


@query(
    "derive_column",
    f"""select l_orderkey, l_linenumber, {r('l_extendedprice * (1 - l_discount)')} as net,
    {r('l_extendedprice * (1 - l_discount) * (1 + l_tax)')} as gross from lineitem""",
)
def derive_column(spark, sf):
    rows = clean.derive_column(
        table(spark, sf, "lineitem"),
        [
            ("net", F.col("l_extendedprice") * (1 - F.col("l_discount"))),
            ("gross", F.col("net") * (1 + F.col("l_tax"))),
        ],
    )
    return rounded(rows.select("l_orderkey", "l_linenumber", "net", "gross"), "net", "gross")


@query("drop_columns", "select s_suppkey, s_name, s_nationkey from supplier")
def drop_columns(spark, sf):
    return clean.drop_columns(table(spark, sf, "supplier"), ["s_acctbal", "not_there"])


@query(
    "filter_after",
    f"""with {OD}, x as (select series, day, value, lag(value) over {W} as prev from od)
    select series, day, {r('value')} as value, {r('prev')} as prev from x where day > date '1997-01-01'""",
)
def filter_after(spark, sf):
    rows = orders_daily(spark, sf).withColumn("prev", BY_DAY.lag("value"))
    return rounded(clean.filter_after(rows, "day", "1997-01-01"), "value", "prev")


@query("filter_between", f"with {OD} select series, day, {r('value')} as value from od where day between date '1996-03-01' and date '1999-02-28'")
def filter_between(spark, sf):
    return rounded(clean.filter_between(orders_daily(spark, sf), "day", "1996-03-01", "1999-02-28"), "value")


@query("filter_equals_day", "select o_orderkey, o_custkey, o_totalprice from orders where cast(o_orderdate as date) = date '1998-04-15'")
def filter_equals_day(spark, sf):
    rows = table(spark, sf, "orders").withColumn("day", F.to_date("o_orderdate"))
    return clean.filter_equals_day(rows, "day", "1998-04-15").select("o_orderkey", "o_custkey", "o_totalprice")


@query("filter_not_null", f"with {ALIGNED} select series, day, {r('value')} as value from al where value is not null")
def filter_not_null(spark, sf):
    return rounded(clean.filter_not_null(aligned(spark, sf), "value"), "value")


_P = [f"p{i}" for i in range(1, 6)]


@query(
    "drop_null_rows",
    f"with {OW} select day, {', '.join(f'{r(p)} as {p}' for p in _P)} from ow where " + " and ".join(f"{p} is not null" for p in _P),
)
def drop_null_rows(spark, sf):
    return rounded(clean.drop_null_rows(orders_wide(spark, sf), _P), *_P)


@query("distinct_rows", "select distinct l_returnflag, l_linestatus, l_linenumber, l_discount, l_tax from lineitem")
def distinct_rows(spark, sf):
    names = ["l_returnflag", "l_linestatus", "l_linenumber", "l_discount", "l_tax"]
    return clean.distinct_rows(table(spark, sf, "lineitem").select(*names))


@query("zero_to_null", "select l_orderkey, l_linenumber, nullif(l_discount, 0) as l_discount, nullif(l_tax, 0) as l_tax from lineitem")
def zero_to_null(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_tax")
    return clean.clean_zero(rows, ["l_discount", "l_tax"])


@query(
    "nonfinite_to_null",
    f"""select l_orderkey, l_linenumber, {r('case when l_discount > 0 then l_tax / l_discount end')} as ratio from lineitem""",
)
def nonfinite_to_null(spark, sf):
    ratio = (
        F.when(F.col("l_discount") > 0, F.try_divide("l_tax", "l_discount"))
        .when(F.col("l_tax") > 0, F.lit(float("inf")))
        .otherwise(F.lit(float("nan")))
    )
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", ratio.alias("ratio"))
    return rounded(clean.clean_nonfinite(rows, ["ratio"]), "ratio")


@query(
    "fill_constant_before",
    f"""with {ALIGNED}, z as (select series, day, coalesce(value, 0) as value from al)
    select series, day, {r('value')} as value, {r(f'ln(value + 1) - ln(lag(value) over {W} + 1)')} as ret from z""",
)
def fill_constant_before(spark, sf):
    rows = clean.fill_constant(aligned(spark, sf), 0.0, ["value"])
    return rounded(rows.withColumn("ret", BY_DAY.log_return_shifted("value")), "value", "ret")


@query(
    "fill_constant_after",
    f"""with {ALIGNED}, z as (select series, day, value, ln(value + 1) - ln(lag(value) over {W} + 1) as ret from al)
    select series, day, {r('coalesce(value, 0)')} as value, {r('coalesce(ret, 0)')} as ret from z""",
)
def fill_constant_after(spark, sf):
    rows = aligned(spark, sf).withColumn("ret", BY_DAY.log_return_shifted("value"))
    return rounded(clean.fill_constant(rows, 0.0, ["value", "ret"]), "value", "ret")


@query("is_weekend", "select o_orderkey, cast(isodow(o_orderdate) in (6, 7) as integer) as is_weekend from orders")
def is_weekend(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", scalar.is_weekend(F.to_date("o_orderdate")).alias("is_weekend"))


_ERA = f"case when day < date '{CUT}' then 'retail' else 'institutional' end"


@query("assign_era_second", f"with {OD} select {_ERA} as era, series, count(*) as days, {r('sum(value)', 2)} as total, min(day) as first_day from od group by 1, 2")
def assign_era_second(spark, sf):
    rows = calendar.assign_era(orders_daily(spark, sf), "day", CUT)
    return rows.groupBy("era", "series").agg(
        F.count(F.lit(1)).alias("days"), r6(F.sum("value"), 2).alias("total"), F.min("day").alias("first_day")
    )


@query(
    "assign_era_both",
    f"""with {OD}, b as (select {_ERA} as era, series, day, value from od
      union all select 'retail', series, day, value from od where day = date '{CUT}')
    select era, series, count(*) as days, {r('sum(value)', 2)} as total, min(day) as first_day, max(day) as last_day from b group by 1, 2""",
)
def assign_era_both(spark, sf):
    rows = calendar.assign_era(orders_daily(spark, sf), "day", CUT, boundary="both")
    return rows.groupBy("era", "series").agg(
        F.count(F.lit(1)).alias("days"),
        r6(F.sum("value"), 2).alias("total"),
        F.min("day").alias("first_day"),
        F.max("day").alias("last_day"),
    )


@query("numeric_columns", "select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax from lineitem")
def numeric_columns(spark, sf):
    rows = table(spark, sf, "lineitem")
    return clean.select_columns(rows, clean.numeric_columns(rows))


_CHANGES = [f"p{i}_diff" for i in range(1, 6)]
_WIDE_DIFF = f"""with {ALIGNED}, x as (select *, value - lag(value) over {W} as diff from al),
d as (select day, {', '.join(f"max(case when series like '{i}-%' then value end) as p{i}, max(case when series like '{i}-%' then diff end) as p{i}_diff" for i in range(1, 6))}
  from x group by 1)"""


def _wide_changes(spark, sf):
    both = aligned(spark, sf).withColumn("diff", BY_DAY.diff("value"))
    short = F.concat(F.lit("p"), F.substring("series", 1, 1))
    cells = F.array(
        F.struct(short.alias("feature"), F.col("value").alias("x")),
        F.struct(F.concat(short, F.lit("_diff")).alias("feature"), F.col("diff").alias("x")),
    )
    tall = both.select("day", F.explode(cells).alias("c")).select("day", "c.feature", "c.x")
    return align.consolidate_wide(tall, [*_P, *_CHANGES], value="x")


@query("split_feature_sets_transformed", f"{_WIDE_DIFF} select day, {', '.join(f'{r(c)} as {c}' for c in _CHANGES)} from d")
def split_feature_sets_transformed(spark, sf):
    return rounded(clean.split_feature_sets(_wide_changes(spark, sf), "day", _CHANGES)[0], *_CHANGES)


@query("split_feature_sets_raw", f"{_WIDE_DIFF} select day, {', '.join(f'{r(c)} as {c}' for c in _P)} from d")
def split_feature_sets_raw(spark, sf):
    return rounded(clean.split_feature_sets(_wide_changes(spark, sf), "day", _CHANGES)[1], *_P)


@query("order_by", f"with {OW} select day, {r('p1')} as p1 from ow order by p1 asc nulls last, day")
def order_by(spark, sf):
    return rounded(clean.order_by(orders_wide(spark, sf).select("day", "p1"), "p1", "day"), "p1")


@query("limit_head", "select o_orderkey, o_orderdate from orders order by o_orderdate, o_orderkey limit 10")
def limit_head(spark, sf):
    return clean.limit_head(table(spark, sf, "orders"), 10, "o_orderdate", "o_orderkey").select("o_orderkey", "o_orderdate")


@query("limit_tail", "select o_orderkey, o_orderdate from orders order by o_orderdate desc, o_orderkey desc limit 10")
def limit_tail(spark, sf):
    return clean.limit_tail(table(spark, sf, "orders"), 10, "o_orderdate", "o_orderkey").select("o_orderkey", "o_orderdate")


# Joins


@query("align_to_spine", f"with {ALIGNED} select series, day, {r('value')} as value from al")
def align_to_spine(spark, sf):
    return rounded(aligned(spark, sf), "value")


@query(
    "enrich_left",
    f"""select c_mktsegment as series, cast(o_orderdate as date) as day, count(*) as n, {r('sum(o_totalprice)', 2)} as value
    from orders left join customer on c_custkey = o_custkey group by 1, 2""",
)
def enrich_left(spark, sf):
    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("series"))
    rows = align.enrich_left(table(spark, sf, "orders"), customers, "o_custkey")
    return rows.groupBy("series", F.to_date("o_orderdate").alias("day")).agg(
        F.count(F.lit(1)).alias("n"), r6(F.sum("o_totalprice"), 2).alias("value")
    )


@query(
    "align_many",
    f"""with {SPINE}, o as (select cast(o_orderdate as date) as day, round(sum(o_totalprice), 2) as ordered from orders group by 1),
    l as (select cast(l_shipdate as date) as day, round(sum(l_quantity), 2) as shipped from lineitem group by 1)
    select cal.day, {r('ordered')} as ordered, {r('shipped')} as shipped
    from cal left join o on o.day = cal.day left join l on l.day = cal.day""",
)
def align_many(spark, sf):
    ordered = table(spark, sf, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.round(F.sum("o_totalprice"), 2).alias("ordered"))
    shipped = table(spark, sf, "lineitem").groupBy(F.to_date("l_shipdate").alias("day")).agg(F.round(F.sum("l_quantity"), 2).alias("shipped"))
    spine = calendar.calendar_spine(spark, START, END).select("day")
    return rounded(align.align_many(spine, [ordered, shipped], ["day"]), "ordered", "shipped")


_WIDE_COLUMNS = [g.lower() + "_qty" for g in GROUPS]


@query(
    "consolidate_wide",
    f"""with {SHIP_WIDE}, {SPINE} select cal.day, cast(isodow(cal.day) in (6, 7) as integer) as is_weekend,
    {', '.join(f'{r(c)} as {c}' for c in _WIDE_COLUMNS)} from cal left join sw on sw.day = cal.day""",
)
def consolidate_wide(spark, sf):
    tall = ship_daily(spark, sf).select("day", F.concat(F.lower("series"), F.lit("_qty")).alias("feature"), F.col("qty").alias("value"))
    wide = align.consolidate_on_spine(calendar.calendar_spine(spark, START, END), tall, _WIDE_COLUMNS)
    return rounded(wide, *_WIDE_COLUMNS)


@query(
    "patch_column",
    f"""with {ALIGNED}, {SHIP}, t as (select day, round(sum(price), 2) as patch from ship where isodow(day) < 6 group by 1),
    j as (select al.series, al.day, al.value, t.patch from al left join t on t.day = al.day),
    f as (select series, day, value, last_value(patch ignore nulls) over (partition by series order by day
      rows between unbounded preceding and current row) as patch from j)
    select series, day, {r('value')} as value, {r('patch')} as patch,
      {r(f'{ln("patch")} - {ln(f"lag(patch) over {W}")}')} as patch_ret from f""",
)
def patch_column(spark, sf):
    patch = (
        ship_daily(spark, sf)
        .filter(F.weekday("day") < 5)
        .groupBy("day")
        .agg(F.round(F.sum("price"), 2).alias("patch"))
    )
    every_series = F.explode(F.array(*[F.lit(s) for s in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")]))
    patch = patch.select(every_series.alias("series"), "day", "patch")
    rows = align.patch_column(aligned(spark, sf), patch, "day", "patch", "patch_ret", ["series"])
    return rounded(rows, "value", "patch", "patch_ret").select("series", "day", "value", "patch", "patch_ret")


@query(
    "log_return_ffill",
    f"""with {FILLED}, x as (select series, day, value, {ln('value')} - {ln(f'lag(value) over {W}')} as log_ret from ff)
    select series, day, {r('value')} as value, {r('log_ret')} as log_ret from x where day > date '1995-01-03'""",
)
def log_return_ffill(spark, sf):
    rows = filled(spark, sf).withColumn("log_ret", BY_DAY.log_return("value"))
    return rounded(clean.filter_after(rows, "day", "1995-01-03"), "value", "log_ret")
