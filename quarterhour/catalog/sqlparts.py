"""SQL fragments shared by the twins."""

from __future__ import annotations


def interp(src: str, keys: str, pos: str, val: str) -> str:
    """Rows of ``src`` with ``filled``: linear interpolation of val over pos, ends held."""
    w = f"PARTITION BY {keys} ORDER BY {pos}"
    return f"""SELECT *, coalesce({val}, CASE WHEN pp IS NOT NULL AND np IS NOT NULL
        THEN pv + (nv - pv) * ({pos} - pp) / (np - pp) END, pv, nv) AS filled FROM (
      SELECT *,
        last_value({val} IGNORE NULLS) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pv,
        last_value(CASE WHEN {val} IS NOT NULL THEN CAST({pos} AS DOUBLE) END IGNORE NULLS) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pp,
        first_value({val} IGNORE NULLS) OVER ({w} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nv,
        first_value(CASE WHEN {val} IS NOT NULL THEN CAST({pos} AS DOUBLE) END IGNORE NULLS) OVER ({w} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS np
      FROM {src})"""


def spearman(src: str, keys: str, pairs: dict[str, tuple[str, str]]) -> str:
    """Rows (keys, pair, rho, n) of Spearman correlations with average ranks; 0 when undefined."""
    union = "\n UNION ALL ".join(
        f"SELECT {keys}, '{p}' AS pair, CAST({x} AS DOUBLE) AS x, CAST({y} AS DOUBLE) AS y FROM {src} WHERE {x} IS NOT NULL AND {y} IS NOT NULL"
        for p, (x, y) in pairs.items())
    return f"""SELECT {keys}, pair, coalesce(CASE WHEN stddev_pop(rx) > 0 AND stddev_pop(ry) > 0 THEN corr(rx, ry) END, 0) AS rho, count(*) AS n FROM (
      SELECT {keys}, pair,
        rank() OVER (PARTITION BY {keys}, pair ORDER BY x) + (count(*) OVER (PARTITION BY {keys}, pair, x) - 1) / 2.0::DOUBLE AS rx,
        rank() OVER (PARTITION BY {keys}, pair ORDER BY y) + (count(*) OVER (PARTITION BY {keys}, pair, y) - 1) / 2.0::DOUBLE AS ry
      FROM ({union})) GROUP BY {keys}, pair"""


def spearman_wide(src: str, keys: str, pairs: dict[str, tuple[str, str]]) -> str:
    picks = ", ".join(f"coalesce(max(rho) FILTER (WHERE pair = '{p}'), 0) AS {p}" for p in pairs)
    return f"SELECT {keys}, {picks} FROM ({spearman(src, keys, pairs)}) GROUP BY {keys}"


def slope(y: str, x: str) -> str:
    return (f"(covar_pop({y}, {x}) / nullif(var_pop(CASE WHEN {y} IS NOT NULL THEN {x} END), 0))")


def grid(src: str, keys: str = "state") -> str:
    return f"""SELECT {keys}, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date, b.block
        FROM {src} CROSS JOIN (SELECT CAST(unnest(range(1, 97)) AS INTEGER) AS block) b GROUP BY {keys}, b.block"""


def melt(src: str, keys: str, names: list[str]) -> str:
    """(keys, metric, value) rows from columns."""
    return " UNION ALL ".join(f"SELECT {keys}, '{n}' AS metric, CAST({n} AS DOUBLE) AS value FROM {src}" for n in names)


def _det(m: list[list[str]]) -> str:
    if len(m) == 1:
        return m[0][0]
    if len(m) == 2:
        return f"({m[0][0]} * {m[1][1]} - {m[0][1]} * {m[1][0]})"
    out = []
    for j in range(3):
        minor = [[m[i][k] for k in range(3) if k != j] for i in (1, 2)]
        out.append(("-" if j % 2 else "+") + f" {m[0][j]} * {_det(minor)}")
    return "(" + " ".join(out) + ")"


def ols(src: str, y: str, xs: list[str], keys: str, min_rows: int = 10) -> str:
    """Least squares on up to three features by Cramer's rule, as in the DataFrame operator."""
    k = len(xs)
    where = " AND ".join(f"{c} IS NOT NULL" for c in [y, *xs])
    aggs = [f"avg({x}) AS m{i}, covar_pop({x}, {y}) AS c{i}y" for i, x in enumerate(xs)]
    aggs += [f"covar_pop({xs[i]}, {xs[j]}) AS c{i}{j}" for i in range(k) for j in range(i, k)]
    cov = [[f"c{min(i, j)}{max(i, j)}" for j in range(k)] for i in range(k)]
    scale = " * ".join(cov[i][i] for i in range(k))
    betas = []
    for j in range(k):
        m = [[f"c{i}y" if c == j else cov[i][c] for c in range(k)] for i in range(k)]
        betas.append(f"{_det(m)} / d AS beta_{xs[j]}")
    fit = " - ".join(["my", *[f"beta_{x} * m{i}" for i, x in enumerate(xs)]])
    expl = " + ".join(f"beta_{x} * c{i}y" for i, x in enumerate(xs))
    return f"""SELECT {keys}, {fit} AS intercept, {', '.join(f'beta_{x}' for x in xs)}, ({expl}) / nullif(vy, 0) AS r2, n FROM (
      SELECT *, {', '.join(betas)} FROM (SELECT *, CASE WHEN abs({_det(cov)}) > 1e-12 * abs({scale}) THEN {_det(cov)} END AS d FROM (
        SELECT {keys}, count(*) AS n, avg({y}) AS my, var_pop({y}) AS vy, {', '.join(aggs)} FROM {src} WHERE {where} GROUP BY {keys} HAVING count(*) >= {min_rows})))"""
