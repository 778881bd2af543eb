"""Profiling, correlation and regression diagnostics on panels and raw rows."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from checks.basics import filled
from checks.panels import CUT, EV, FILLED, GROUPS, OD, OW, SHIP, SHIP_WIDE, W, event_rows, ln, orders_daily, orders_wide, r, ship_daily, ship_wide, table
from checks.registry import query, r6, rounded
from checks.sql_models import adf, f_tail, granger, ols, tau_tail
from dayloom.functions import distributions, scalar
from dayloom.operators import calendar, correlation, profile, regression
from dayloom.operators import granger as causality
from dayloom.operators import unit_root
from dayloom.operators.windows import Series

BY_DAY = Series(["series"], ["day"])

# Profiling


def _describe_sql(source, columns, keys="", digits=4, even=False):
    def r(x, digits):
        return f"round_even({x}, {digits}) + 0.0" if even else f"round({x}, {digits}) + 0.0"

    group = f"{keys}, " if keys else ""
    by = f" group by {keys}" if keys else ""
    return " union all ".join(
        f"select {group}'{c}' as feature, count({c}) as count, {r(f'avg({c})', digits)} as mean, "
        f"{r(f'stddev_samp({c})', digits)} as std, {r(f'min({c})', digits)} as min, "
        + ", ".join(f"{r(f'quantile_cont({c}, {q})', digits)} as p{int(100 * q)}" for q in (0.25, 0.5, 0.75))
        + f", {r(f'max({c})', digits)} as max from {source}{by}"
        for c in columns
    )


_NUMBERS = [s for s in profile.STATISTICS if s != "count"]
_P = [f"p{i}" for i in range(1, 6)]


@query("describe", f"with {OD} " + _describe_sql("od", ["value"], "series"))
def describe(spark, sf):
    return rounded(profile.describe(orders_daily(spark, sf), ["value"], ["series"], "day"), *_NUMBERS, digits=4)


_LINE = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("describe_any_grain", _describe_sql("lineitem", _LINE, "l_returnflag"))
def describe_any_grain(spark, sf):
    rows = table(spark, sf, "lineitem")
    return rounded(profile.describe(rows, _LINE, ["l_returnflag"]), *_NUMBERS, digits=4)


_RETURNS = f"""with {FILLED}, x as (select series, day, case when day < date '{CUT}' then 'retail' else 'institutional' end as era,
  {ln('value')} - {ln(f'lag(value) over {W}')} as ret from ff) """


def returns(spark, sf):
    return filled(spark, sf).select("series", "day", BY_DAY.log_return("value").alias("ret"))


@query("describe_by_era", _RETURNS + _describe_sql("x", ["ret"], "era", even=True))
def describe_by_era(spark, sf):
    rows = calendar.assign_era(returns(spark, sf), "day", CUT)
    described = profile.describe_by_era(rows, ["ret"])
    return described.withColumns({c: F.col(c) + 0.0 for c in _NUMBERS})


@query("describe_transposed", f"with {SHIP_WIDE} " + _describe_sql("sw", [g.lower() + "_qty" for g in GROUPS]))
def describe_transposed(spark, sf):
    return rounded(profile.describe(ship_wide(spark, sf), [g.lower() + "_qty" for g in GROUPS], grain="day"), *_NUMBERS, digits=4)


@query("day_extent_by_era", f"with {OD}, e as (select *, case when day < date '{CUT}' then 'retail' else 'institutional' end as era from od) select era, min(day) as first_day, max(day) as last_day, count(day) as days from e group by 1")
def day_extent_by_era(spark, sf):
    return profile.day_extent(calendar.assign_era(orders_daily(spark, sf), "day", CUT), "day", ["era"])


@query(
    "null_counts",
    f"with {OW}, u as (" + " union all ".join(f"select '{c}' as feature, count(*) - count({c}) as nulls from ow" for c in ["day", *_P]) + ") select * from u where nulls > 0",
)
def null_counts(spark, sf):
    return profile.null_counts(orders_wide(spark, sf))


@query(
    "table_extent",
    f"with {OW} select count(*) as rows, 6 as columns, min(day) as first_day, max(day) as last_day, 'day, p1, p2, p3, p4, p5' as column_list from ow",
)
def table_extent(spark, sf):
    return profile.table_extent(orders_wide(spark, sf), "day")


@query(
    "profile_table",
    f"with {OW} " + " union all ".join(f"select '{c}' as feature, count({c}) as non_null, '{t}' as type from ow" for c, t in [("day", "date"), *[(p, "double") for p in _P]]),
)
def profile_table(spark, sf):
    return profile.profile_table(orders_wide(spark, sf), "day")["info"]


@query("profile_table_head", f"with {OW} select day, {', '.join(f'{r(p)} as {p}' for p in _P)} from ow order by day limit 10")
def profile_table_head(spark, sf):
    return rounded(profile.profile_table(orders_wide(spark, sf), "day")["head"], *_P)


# Correlation


def _corr_sql(source, columns, keys=""):
    group = f"{keys}, " if keys else ""
    by = f" group by {keys}" if keys else ""
    return " union all ".join(
        f"select {group}'{a}' as a, '{b}' as b, {r(f'case when var_pop(case when {b} is not null then {a} end) > 0 and var_pop(case when {a} is not null then {b} end) > 0 then corr({a}, {b}) end')} as r, "
        f"regr_count({a}, {b}) as n from {source}{by}"
        for a in columns
        for b in columns
    )


_CORR = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "l_partkey", "l_suppkey"]


@query("correlation_matrix", _corr_sql("lineitem", _CORR))
def correlation_matrix(spark, sf):
    return rounded(correlation.correlation_matrix(table(spark, sf, "lineitem"), _CORR), "r")


@query("correlation_matrix_grouped", _corr_sql("lineitem", _CORR[:4], "l_returnflag"))
def correlation_matrix_grouped(spark, sf):
    return rounded(correlation.correlation_matrix(table(spark, sf, "lineitem"), _CORR[:4], ["l_returnflag"]), "r")


_SHIPPED = [f"{g.lower()}_{c}" for g in GROUPS for c in ("qty", "price")]
_BOTH = f"""with {SHIP_WIDE}, e as (select *, case when day < date '{CUT}' then 'retail' else 'institutional' end as era from sw
  union all select *, 'retail' as era from sw where day = date '{CUT}') """


@query("correlation_by_era", _BOTH + _corr_sql("e", _SHIPPED, "era"))
def correlation_by_era(spark, sf):
    return rounded(correlation.correlation_by_era(ship_wide(spark, sf), _SHIPPED, "day", CUT), "r")


@query(
    "lower_triangle",
    f"with {OW}, c as ({_corr_sql('ow', _P)}) select * from c where a > b",
)
def lower_triangle(spark, sf):
    table_ = correlation.correlation_matrix(orders_wide(spark, sf), _P)
    return rounded(correlation.lower_triangle(table_, _P), "r")


# Regression diagnostics on raw rows

_X = ["l_quantity", "l_discount", "l_tax"]


@query("ols_ssr", f"with {ols('o', 'lineitem', ['l_returnflag'], 'l_extendedprice', _X)} select l_returnflag, n, 4 as rank, {r('ssr / 1e9')} as ssr from o")
def ols_ssr(spark, sf):
    fitted = regression.ols_ssr(table(spark, sf, "lineitem"), "l_extendedprice", _X, ["l_returnflag"])
    return fitted.withColumn("ssr", r6(F.col("ssr") / 1e9))


def _chow_sql(source, keys, segment, labels, y, x):
    k, group = len(x) + 1, ", ".join(keys)
    lead = f"{group}, " if keys else ""
    by = f"group by {group}" if keys else ""
    return f"""ends as (select *, {segment} as part from {source} union all select *, 'pooled' as part from {source}),
{ols('o', 'ends', [*keys, 'part'], y, x)},
t as (select {lead}max(case when part = 'pooled' then ssr end) as s0, max(case when part = '{labels[0]}' then ssr end) as s1,
  max(case when part = '{labels[1]}' then ssr end) as s2, max(case when part = '{labels[0]}' then n end) as n_1,
  max(case when part = '{labels[1]}' then n end) as n_2 from o {by}),
f as (select *, ((s0 - (s1 + s2)) / {k}) / ((s1 + s2) / (n_1 + n_2 - {2 * k})) as f_stat, {k} as df1, n_1 + n_2 - {2 * k} as df2 from t),
chow as (select {lead}n_1, n_2, {r('f_stat', 5)} as f_stat, df1, df2, {r(f_tail('f_stat', 'df1', 'df2'))} as p_value,
  case when {f_tail('f_stat', 'df1', 'df2')} < 0.05 then 'structural break' else 'no structural break' end as conclusion from f)"""


def _chow_out(tests, *keys):
    out = tests.select(*keys, "n_1", "n_2", "f_stat", "df1", "df2", "p_value", "conclusion")
    return rounded(rounded(out, "f_stat", digits=5), "p_value")


_SEGMENT = f"case when l_shipdate < date '{CUT}' then 'retail' else 'institutional' end"


@query("chow_test", f"with {_chow_sql('lineitem', ['l_returnflag'], _SEGMENT, calendar.ERA_LABELS, 'l_extendedprice', _X)} select * from chow")
def chow_test(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("day", F.to_date("l_shipdate"))
    return _chow_out(regression.chow_by_day(rows, "l_extendedprice", _X, "day", CUT, keys=["l_returnflag"]), "l_returnflag")


_VIF = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_linenumber", "l_suppkey"]


def _vif_sql(source, columns):
    parts, picks = [], []
    for i, c in enumerate(columns):
        others = [x for x in columns if x != c]
        parts.append(ols(f"v{i}", "base", ["g"], c, others))
        picks.append(
            f"select '{c}' as variable, round_even((select var_pop({c}) * count(*) from base) / ssr, 2) + 0.0 as vif from v{i}"
        )
    complete = " and ".join(f"{c} is not null" for c in columns)
    return f"base as (select 1 as g, {', '.join(columns)} from {source} where {complete}),\n" + ",\n".join(parts), " union all ".join(picks)


_VIF_SQL = _vif_sql("lineitem", _VIF)


@query("vif", f"with {_VIF_SQL[0]} {_VIF_SQL[1]}")
def vif(spark, sf):
    out = regression.vif(table(spark, sf, "lineitem"), _VIF)
    return out.withColumn("vif", F.col("vif") + 0.0)


# Probabilities

_F_TABLE = f"""with {SHIP}, t as (select series, day, price / (qty * 1000) as f, cast(n as bigint) as d1, cast(round(qty) as bigint) as d2 from ship)
select series, day, {r(f_tail('f', 'd1', 'd2'))} as p_value from t"""


@query("with_f_pvalue", _F_TABLE)
def with_f_pvalue(spark, sf):
    rows = ship_daily(spark, sf).select(
        "series", "day", (F.col("price") / (F.col("qty") * 1000)).alias("f"), F.col("n").alias("d1"), F.round("qty").cast("long").alias("d2")
    )
    return rounded(distributions.with_f_pvalue(rows, "f", "d1", "d2"), "p_value").select("series", "day", "p_value")


@query(
    "with_mackinnon_pvalue",
    f"""with {SHIP}, t as (select series, day, 3.5 - price / 20000.0 as tau from ship)
    select series, day, {r(tau_tail('tau'))} as p_value from t""",
)
def with_mackinnon_pvalue(spark, sf):
    rows = ship_daily(spark, sf).select("series", "day", (3.5 - F.col("price") / 20000.0).alias("tau"))
    return rounded(distributions.with_mackinnon_pvalue(rows, "tau"), "p_value").select("series", "day", "p_value")


@query(
    "significance_label",
    """select l_orderkey, l_linenumber, case when l_discount < 0.05 then 'significant' else 'not significant' end as verdict,
    l_discount < 0.05 as significant from lineitem""",
)
def significance_label(spark, sf):
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", scalar.significance_label("l_discount").alias("verdict"), (F.col("l_discount") < 0.05).alias("significant")
    )


@query(
    "best_lag",
    """select l_orderkey, coalesce(arg_min(l_linenumber, (l_discount * 20, l_linenumber)) filter (where l_discount * 20 < 1), 0) as lag,
    coalesce(min(l_discount * 20) filter (where l_discount * 20 < 1), 1.0) as p from lineitem group by 1""",
)
def best_lag(spark, sf):
    rows = table(spark, sf, "lineitem").withColumn("p_value", F.col("l_discount") * 20)
    best = rows.groupBy("l_orderkey").agg(causality.best_lag("p_value", "l_linenumber").alias("b"))
    return best.select("l_orderkey", F.col("b.lag").alias("lag"), F.col("b.p").alias("p"))


# Unit root and causality on daily panels

LAGS = 27
_ADF = f"with {FILLED}, src as (select series, day, value as x from ff), {adf('u', 'src', ['series'], 'day', LAGS)} "


@query(
    "adf_test",
    _ADF + f"select series, n, used_lag, n_obs, {r('statistic', 5)} as statistic, {r(tau_tail('statistic'))} as p_value from u",
)
def adf_test(spark, sf):
    out = unit_root.adf_test(filled(spark, sf), ["series"], ["day"], "value")
    out = rounded(rounded(out, "statistic", digits=5), "p_value")
    return out.select("series", "n", "used_lag", "n_obs", "statistic", "p_value")


_CUMULATED = f"""{SHIP}, lv as (select series, day, sum(qty - 100) over (partition by series order by day
  rows between unbounded preceding and current row) as x from ship)"""


@query(
    "adf_report",
    f"""with {_CUMULATED}, {adf('u', 'lv', ['series'], 'day', LAGS)}, rep as (select series, statistic, {tau_tail('statistic')} as p from u)
    select series, 'x' as variable, round(statistic, 4) + 0.0 as statistic, round(p, 6) + 0.0 as p_value,
    case when p < 0.05 then 'stationary' else 'not stationary' end as verdict from rep
    union all select distinct series, 'few' as variable, null, null, 'insufficient data' from ship""",
)
def adf_report(spark, sf):
    level = F.sum(F.col("qty") - 100).over(BY_DAY.forward.rowsBetween(Window.unboundedPreceding, 0))
    rows = ship_daily(spark, sf).select("series", "day", level.alias("x"), F.when(F.col("day") < "1995-01-10", F.col("qty")).alias("few"))
    out = unit_root.adf_report(rows, ["day"], ["x", "few"], ["series"])
    return out.withColumns({"statistic": F.col("statistic") + 0.0, "p_value": F.col("p_value") + 0.0})


_PAIRS = f"""{SHIP}, ret as (select series, day, {ln('price')} - {ln(f'lag(price) over {W}')} as y, {ln('qty')} - {ln(f'lag(qty) over {W}')} as x from ship),
  pr as (select * from ret where x is not null and y is not null)"""


def _pairs(spark, sf):
    return ship_daily(spark, sf).select("series", "day", BY_DAY.log_return("price").alias("y"), BY_DAY.log_return("qty").alias("x"))


@query(
    "granger_test",
    f"""with {_PAIRS}, {granger('g', 'pr', ['series'], 'day', 5)}
    select series, lag, n, {r('f_stat', 5)} as f_stat, df1, df2, {r(f_tail('f_stat', 'df1', 'df2'))} as p_value from g""",
)
def granger_test(spark, sf):
    out = causality.granger_test(_pairs(spark, sf), ["series"], ["day"], "y", "x")
    return rounded(rounded(out.drop("problem"), "f_stat", digits=5), "p_value")


_TARGET, _FEATURES = "af_qty", [c for c in _SHIPPED if c != "af_qty"]


def _melted(source, target, features, keys, day="day"):
    return "mp as (" + " union all ".join(
        f"select {', '.join(keys)}, '{f}' as feature, {day}, cast({target} as double) as y, cast({f} as double) as x from {source} where {target} is not null and {f} is not null"
        for f in features
    ) + ")"


def _report_sql(keys):
    group = ", ".join([*keys, "feature"])
    return f"""pv as (select *, {f_tail('f_stat', 'df1', 'df2')} as p from g),
  best as (select {group}, coalesce(arg_min(lag, (p, lag)) filter (where p < 1), 0) as lag_days, coalesce(min(p) filter (where p < 1), 1.0) as p from pv group by {group})
  select {group}, lag_days, round(p, 5) + 0.0 as p_value, case when p < 0.05 then 'causality' else 'no causality' end as conclusion, p < 0.05 as significant from best"""


@query(
    "granger_report",
    f"with {SHIP_WIDE}, {_melted('sw', _TARGET, _FEATURES, ['1 as one_group'])}, {granger('g', 'mp', ['feature'], 'day', 5)}, {_report_sql([])}",
)
def granger_report(spark, sf):
    tests = causality.granger_tests_by_feature(ship_wide(spark, sf), _TARGET, _FEATURES, ["day"])
    return causality.granger_report(tests).withColumn("p_value", F.col("p_value") + 0.0)


@query(
    "granger_by_era",
    _BOTH + f", {_melted('e', _TARGET, _FEATURES, ['era'])}, {granger('g', 'mp', ['era', 'feature'], 'day', 5)}, {_report_sql(['era'])}",
)
def granger_by_era(spark, sf):
    out = causality.granger_by_era(ship_wide(spark, sf), _TARGET, _FEATURES, "day", CUT)
    return out.withColumn("p_value", F.col("p_value") + 0.0)


@query(
    "granger_skipped",
    f"""with {SHIP_WIDE}, pairs as (
      select 'ro_qty' as feature, day, af_qty as y, ro_qty as x from sw
      union all select 'constant', day, af_qty, nf_qty * 0 + 1 from sw
      union all select 'few', day, af_qty, case when day < date '1995-01-15' then nf_qty end from sw
      union all select 'nothing', day, af_qty, case when day < date '1990-01-01' then nf_qty end from sw),
    numbered as (select feature, y, x, row_number() over (partition by feature order by day) - 1 as i,
      count(*) over (partition by feature) as n from pairs where y is not null and x is not null),
    lagged as (select feature, n, lags, back, min(x) = max(x) or min(y) = max(y) as flat
      from numbered, range(1, 6) a(lags), range(1, 6) b(back)
      where back <= lags and i between lags - back and n - 1 - back group by all),
    seen as (select feature, max(n) as n, bool_or(flat) as flat from lagged group by feature)
    select feature, case when coalesce(n, 0) <= 3 * 5 + 1 then 'insufficient rows' else 'constant lag column' end as reason
    from (values ('ro_qty'), ('constant'), ('few'), ('nothing')) f(feature) left join seen using (feature)
    where coalesce(n, 0) <= 3 * 5 + 1 or flat""",
)
def granger_skipped(spark, sf):
    rows = ship_wide(spark, sf).select(
        "day",
        "af_qty",
        "ro_qty",
        (F.col("nf_qty") * 0 + 1).alias("constant"),
        F.when(F.col("day") < "1995-01-15", F.col("nf_qty")).alias("few"),
        F.when(F.col("day") < "1990-01-01", F.col("nf_qty")).alias("nothing"),
    )
    features = ["ro_qty", "constant", "few", "nothing"]
    tests = causality.granger_tests_by_feature(rows, "af_qty", features, ["day"])
    return causality.granger_skipped(tests, features)


# The same tests on raw events, cut into blocks

_EVENT_LAGS = 27


@query(
    "long_adf",
    f"""with {EV}, src as (select series, ts, event_id, value as x from ev), {adf('u', 'src', ['series'], 'ts, event_id', _EVENT_LAGS)}
    select series, n, used_lag, n_obs, {r('statistic', 5)} as statistic from u""",
)
def long_adf(spark, sf):
    out = unit_root.adf_test(event_rows(spark, sf), ["series"], ["ts", "event_id"], "value")
    return rounded(out.select("series", "n", "used_lag", "n_obs", "statistic"), "statistic", digits=5)


@query(
    "long_granger",
    f"""with {EV}, pr as (select series, ts, event_id, value as y, cast(event_id % 97 as double) * value as x from ev),
    {granger('g', 'pr', ['series'], 'ts, event_id', 3)}
    select series, lag, n, {r('f_stat', 5)} as f_stat, df1, df2, {r(f_tail('f_stat', 'df1', 'df2'))} as p_value from g""",
)
def long_granger(spark, sf):
    rows = event_rows(spark, sf).select(
        "series", "ts", "event_id", F.col("value").alias("y"), ((F.col("event_id") % 97).cast("double") * F.col("value")).alias("x")
    )
    out = causality.granger_test(rows, ["series"], ["ts", "event_id"], "y", "x", 3)
    return rounded(rounded(out.drop("problem"), "f_stat", digits=5), "p_value")
