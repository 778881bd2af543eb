"""SQL for regression models, so that DuckDB can check the fitted statistics.

A cross-product matrix is a long table (key, i, j, v). Regressing column k out
of the rest is one self-join; a chain of such steps leaves residual sums of
squares. Written apart from the library's solver, as a second opinion.
"""

from __future__ import annotations


def products(name: str, source: str, keys: str, columns: list[str], where: str = "true") -> str:
    """CTE: cross-products of `columns` per key group, both halves."""
    cells = ", ".join(
        f"{{'i': {i}, 'j': {j}, 'v': sum({a} * {b})}}" for i, a in enumerate(columns) for j, b in enumerate(columns)
    )
    return f"""{name}_u as materialized (select {keys}, unnest([{cells}]) as c from {source} where {where} group by {keys}),
{name} as materialized (select {keys}, c.i as i, c.j as j, cast(c.v as double) as v from {name}_u)"""


def without(name: str, source: str, keys: list[str], k: int, only: str = "true") -> str:
    """CTE: `source` after regressing out column k (of groups where `only`)."""
    same = lambda t: " and ".join(f"{t}.{key} is not distinct from a.{key}" for key in keys)
    return f"""{name} as materialized (select {', '.join('a.' + key for key in keys)}, a.i, a.j,
  case when {only} and p.v > 0 then a.v - x.v * y.v / p.v else a.v end as v
  from {source} a join {source} x on {same('x')} and x.i = a.i and x.j = {k}
  join {source} y on {same('y')} and y.i = {k} and y.j = a.j
  join {source} p on {same('p')} and p.i = {k} and p.j = {k}
  where a.i <> {k} and a.j <> {k})"""


def chain(prefix: str, source: str, keys: list[str], removed: list[int], only: dict[int, str] | None = None) -> tuple[list[str], str]:
    """CTEs regressing out columns one after the other; the last CTE's name."""
    ctes, current = [], source
    for k in removed:
        name = f"{prefix}_{k}"
        ctes.append(without(name, current, keys, k, (only or {}).get(k, "true")))
        current = name
    return ctes, current


def f_tail(f: str, d1: str, d2: str, terms: int = 400) -> str:
    """P(F > f): the incomplete beta's continued fraction from the far end."""

    def tail(x: str, a: str, b: str) -> str:
        step = (
            f"case when k % 2 = 0 then (k // 2) * ({b} - k // 2) * {x} / (({a} + k - 1) * ({a} + k)) "
            f"else -({a} + k // 2) * ({a} + {b} + k // 2) * {x} / (({a} + k - 1) * ({a} + k)) end"
        )
        fraction = (
            f"list_reduce(list_concat([1.0::double], list_transform(range({terms}, 0, -1), lambda k: cast({step} as double))), "
            "lambda acc, t: 1 + t / acc)"
        )
        front = f"exp(lgamma({a} + {b}) - lgamma({a}) - lgamma({b}) + {a} * ln({x}) + {b} * ln(1 - {x}))"
        return f"({front} / ({a} * {fraction}))"

    a, b = f"({d2} / 2.0)", f"({d1} / 2.0)"
    x, y = f"({d2} / ({d2} + {d1} * {f}))", f"({d1} * {f} / ({d2} + {d1} * {f}))"
    return (
        f"(case when {f} is null then null when {f} <= 0 then 1.0 when {x} > ({a} + 1) / ({a} + {b} + 2) "
        f"then 1 - {tail(y, b, a)} else {tail(x, a, b)} end)"
    )


def normal_below(z: str, terms: int = 150) -> str:
    """Normal distribution function from its power series."""
    series = (
        f"list_reduce(list_concat([1.0::double], list_transform(range({terms}, 0, -1), lambda k: cast(k as double))), "
        f"lambda acc, k: 1 + ({z}) * ({z}) / (2 * k + 1) * acc)"
    )
    inner = f"0.5 + ({z}) * exp(-({z}) * ({z}) / 2) / sqrt(2 * pi()) * {series}"
    return f"(case when ({z}) < -8 then 0.0 when ({z}) > 8 then 1.0 else {inner} end)"


def tau_tail(tau: str) -> str:
    """Approximate p-value of a unit-root statistic with a constant."""
    small = f"2.1659 + 1.4412 * {tau} + 0.038269 * {tau} * {tau}"
    large = f"1.7339 + 0.93202 * {tau} - 0.12745 * {tau} * {tau} - 0.010368 * {tau} * {tau} * {tau}"
    return (
        f"(case when {tau} > 2.74 then 1.0 when {tau} < -18.83 then 0.0 "
        f"when {tau} <= -1.61 then {normal_below(small)} else {normal_below(large)} end)"
    )


def ols(prefix: str, source: str, keys: list[str], y: str, x: list[str]) -> str:
    """CTE `<prefix>`: n and ssr of y on a constant and x per key group."""
    grouped = ", ".join(keys)
    complete = " and ".join(f"{c} is not null" for c in (*x, y))
    same = " and ".join(f"m.{key} is not distinct from s.{key}" for key in keys)
    means = ", ".join(f"avg({c}) as m_{c}" for c in (*x, y))
    centred = ", ".join(f"s.{c} - m.m_{c} as {c}" for c in (*x, y))
    steps, last = chain(f"{prefix}_w", f"{prefix}_g", keys, list(range(len(x))))
    parts = [
        f"{prefix}_m as (select {grouped}, {means}, count(*) as n from {source} where {complete} group by {grouped})",
        f"{prefix}_c as (select {', '.join('s.' + key for key in keys)}, {centred} from {source} s join {prefix}_m m on {same} where "
        + " and ".join(f"s.{c} is not null" for c in (*x, y))
        + ")",
        products(f"{prefix}_g", f"{prefix}_c", grouped, [*x, y]),
        *steps,
        f"{prefix} as (select {', '.join('m.' + key for key in keys)}, m.n, s.v as ssr from {prefix}_m m join {last} s on {same})",
    ]
    return ",\n".join(parts)


def adf(prefix: str, source: str, keys: list[str], order: str, lags: int) -> str:
    """CTE `<prefix>`: n, statistic, used_lag, n_obs per series of
    `source` (keys, order columns, x). `lags` must reach the longest lag tried."""
    grouped = ", ".join(keys)
    over = f"(partition by {grouped} order by {order})"
    same = lambda a, b: " and ".join(f"{a}.{key} is not distinct from {b}.{key}" for key in keys)
    columns = ["one", *[f"d{k}" for k in range(1, lags + 1)], "level", "step"]
    level, target = lags + 1, lags + 2
    parts = [
        f"{prefix}_x as (select {grouped}, {order}, x - avg(x) over (partition by {grouped}) as x, "
        f"count(*) over (partition by {grouped}) as n, row_number() over {over} as rn from {source} where x is not null)",
        f"{prefix}_d as (select *, x - lag(x) over {over} as step, lag(x) over {over} as level, 1.0 as one, "
        f"least(cast(ceil(12.0 * power(n / 100.0, 0.25)) as bigint), n // 2 - 2) as longest from {prefix}_x)",
        f"{prefix}_l as materialized (select *, "
        + ", ".join(f"coalesce(lag(step, {k}) over {over}, 0) as d{k}" for k in range(1, lags + 1))
        + f" from {prefix}_d)",
        f"{prefix}_n as (select {grouped}, max(n) as n, max(longest) as longest from {prefix}_l group by {grouped})",
        products(f"{prefix}_g", f"{prefix}_l", grouped, columns, "rn - 2 >= longest"),
    ]
    steps, current = chain(f"{prefix}_a", f"{prefix}_g", keys, list(range(lags + 1)))
    parts += steps
    fits = []
    for p in range(lags + 1):
        stage = f"{prefix}_a_{p}"
        fits.append(
            f"select {', '.join('n.' + key for key in keys)}, {p} as p, (n.n - 1 - n.longest) * "
            f"ln((yy.v - xy.v * xy.v / xx.v) / (n.n - 1 - n.longest)) + 2.0 * ({p} + 2) as aic "
            f"from {prefix}_n n join {stage} yy on {same('n', 'yy')} and yy.i = {target} and yy.j = {target} "
            f"join {stage} xy on {same('n', 'xy')} and xy.i = {level} and xy.j = {target} "
            f"join {stage} xx on {same('n', 'xx')} and xx.i = {level} and xx.j = {level} where n.longest >= {p}"
        )
    parts.append(f"{prefix}_f as (" + " union all ".join(fits) + ")")
    parts.append(
        f"{prefix}_p as materialized (select f.*, n.n from (select *, row_number() over (partition by {grouped} order by aic, p) as pick "
        f"from {prefix}_f) f join {prefix}_n n on {same('n', 'f')} where pick = 1)"
    )
    parts.append(
        f"{prefix}_q as (select l.*, p.p from {prefix}_l l join {prefix}_p p on {same('p', 'l')} where l.rn - 2 >= p.p)"
    )
    parts.append(products(f"{prefix}_h", f"{prefix}_q", f"{grouped}, p", columns))
    steps, current = chain(
        f"{prefix}_b", f"{prefix}_h", [*keys, "p"], list(range(lags + 1)), {k: f"a.p >= {k}" for k in range(1, lags + 1)}
    )
    parts += steps
    parts.append(
        f"{prefix} as (select {', '.join('p.' + key for key in keys)}, p.n, p.p as used_lag, p.n - 1 - p.p as n_obs, "
        f"(xy.v / xx.v) / sqrt((yy.v - xy.v * xy.v / xx.v) / (p.n - 1 - p.p - (p.p + 2)) / xx.v) as statistic "
        f"from {prefix}_p p join {current} yy on {same('p', 'yy')} and yy.i = {target} and yy.j = {target} "
        f"join {current} xy on {same('p', 'xy')} and xy.i = {level} and xy.j = {target} "
        f"join {current} xx on {same('p', 'xx')} and xx.i = {level} and xx.j = {level})"
    )
    return ",\n".join(parts)


def granger(prefix: str, source: str, keys: list[str], order: str, lags: int) -> str:
    """CTE `<prefix>`: (keys, lag, n, f_stat, df1, df2) for every lag, of
    `source` (keys, order columns, y, x) with complete rows."""
    grouped = ", ".join(keys)
    over = f"(partition by {grouped} order by {order})"
    same = lambda a, b: " and ".join(f"{a}.{key} is not distinct from {b}.{key}" for key in keys)
    parts = [
        f"{prefix}_x as (select {grouped}, {order}, y - avg(y) over (partition by {grouped}) as y, "
        f"x - avg(x) over (partition by {grouped}) as x, count(*) over (partition by {grouped}) as n, "
        f"row_number() over {over} as rn, 1.0 as one from {source})",
        f"{prefix}_l as materialized (select *, "
        + ", ".join(f"lag({c}, {k}) over {over} as {c}{k}" for c in "yx" for k in range(1, lags + 1))
        + f" from {prefix}_x where n > {3 * lags + 1})",
        f"{prefix}_n as (select {grouped}, max(n) as n from {prefix}_l group by {grouped})",
    ]
    fits = []
    for lag in range(1, lags + 1):
        columns = ["one", *[f"y{k}" for k in range(1, lag + 1)], *[f"x{k}" for k in range(1, lag + 1)], "y"]
        name, target = f"{prefix}_g{lag}", 2 * lag + 1
        parts.append(products(name, f"{prefix}_l", grouped, columns, f"rn > {lag}"))
        steps, full = chain(f"{prefix}_s{lag}", name, keys, list(range(2 * lag + 1)))
        parts += steps
        restricted = f"{prefix}_s{lag}_{lag}"
        fits.append(
            f"select {', '.join('n.' + key for key in keys)}, {lag} as lag, n.n, (r.v - u.v) / {lag} / (u.v / (n.n - {3 * lag + 1})) as f_stat, "
            f"{lag} as df1, n.n - {3 * lag + 1} as df2 from {prefix}_n n "
            f"join {restricted} r on {same('n', 'r')} and r.i = {target} and r.j = {target} "
            f"join {full} u on {same('n', 'u')} and u.i = {target} and u.j = {target}"
        )
    parts.append(f"{prefix} as materialized (" + " union all ".join(fits) + ")")
    return ",\n".join(parts)
