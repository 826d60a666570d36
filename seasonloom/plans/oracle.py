"""DuckDB SQL of the model, composed from common table expressions."""

from __future__ import annotations

from seasonloom.functions.expressions import kernel_weight
from seasonloom.operators.fit import WIDE
from seasonloom.operators.solve import PIVOT
from seasonloom.plans.proxies import DAILY_SQL


def with_(*ctes: str) -> str:
    """A WITH clause."""
    return "WITH " + ",\n".join(ctes) + "\n"


def rounded(columns, digits: int = 6) -> str:
    """columns (name or expression AS name) rounded."""
    out = []
    for c in columns:
        expression, _, name = c.rpartition(" AS ")
        out.append(f"round({expression or name}, {digits}) AS {name}")
    return ", ".join(out)


def features_sql(names, source: str = "series", clim: str | None = None) -> list[str]:
    """CTEs clim, anom, lagged and feats (f0.. and target) of a source."""
    lags = {n: int(n.rpartition("_lag")[2]) for n in names if "_lag" in n}
    column = lambda n: "1.0" if n == "const" else f'lag({n.split("_anom")[0].lower()}a, {lags[n]}) OVER w' if n in lags else f"{n.split('_anom')[0].lower()}a"
    cols = ", ".join(f"{column(n)} AS f{i}" for i, n in enumerate(names))
    full = " AND ".join(f"f{i} IS NOT NULL" for i in range(len(names)))
    return [
        clim or f'clim AS MATERIALIZED (SELECT "ID", doy, avg("TD") AS td_clim, avg("TMIN") AS tmin_clim FROM {source} GROUP BY 1, 2)',
        f'anom AS (SELECT s."ID", s."FECHA", s.doy, s."TD" - c.td_clim AS tda, s."TMIN" - c.tmin_clim AS tmina FROM {source} s LEFT JOIN clim c ON s."ID" = c."ID" AND s.doy = c.doy)',
        f'lagged AS (SELECT "ID", "FECHA", doy, CAST(year("FECHA") AS INTEGER) AS yr, tda AS target, {cols} FROM anom WINDOW w AS (PARTITION BY "ID" ORDER BY "FECHA"))',
        f"feats AS MATERIALIZED (SELECT * FROM lagged WHERE target IS NOT NULL AND {full})",
    ]


def stat_list(n: int) -> list[str]:
    """Names of the statistics."""
    return [f"a_{i}_{j}" for i in range(n) for j in range(i, n)] + [f"b_{i}" for i in range(n)] + ["yy"]


def gram_sql(n: int, keys: str = '"ID", doy') -> str:
    """CTE gram: day sums of feats."""
    parts = [f"sum(f{i} * f{j}) AS a_{i}_{j}" for i in range(n) for j in range(i, n)] + [f"sum(f{i} * target) AS b_{i}" for i in range(n)] + ["sum(target * target) AS yy", "count(*) AS n"]
    return f"gram AS MATERIALIZED (SELECT {keys}, {', '.join(parts)} FROM feats GROUP BY {keys})"


def kernel_sql(h: int, kernel: str) -> str:
    """CTE kernel: weights by offset."""
    return "kernel(delta, w) AS (VALUES " + ", ".join(f"({d}, CAST({kernel_weight(abs(d), h, kernel)!r} AS DOUBLE))" for d in range(-h, h + 1)) + ")"


def conv_sql(n: int, keys: str = '"ID"', where: str = "true") -> str:
    """CTE conv: kernel-weighted sums by target day."""
    sums = ", ".join(f"sum(w * {c}) AS {c}" for c in stat_list(n))
    return f"conv AS MATERIALIZED (SELECT {keys}, target AS doy, {sums}, CAST(sum(n) AS BIGINT) AS n FROM (SELECT *, ((doy - 1 + delta) % 366 + 366) % 366 + 1 AS target FROM gram, kernel) WHERE {where} GROUP BY {keys}, target)"


def solve_sql(n: int, source: str = "conv", where: str = "n >= 15") -> list[str]:
    """CTEs of the Cholesky steps, ending in solved with beta_i and r2."""
    a = lambda i, j: f"a_{min(i, j)}_{max(i, j)}"
    ctes, last = [], f"(SELECT * FROM {source} WHERE {where})"
    for j in range(n):
        pivot = a(j, j) + "".join(f" - l{j}{k} * l{j}{k}" for k in range(j))
        ctes.append(f"p{j} AS (SELECT *, CASE WHEN {pivot} > {PIVOT!r} * {a(j, j)} THEN sqrt({pivot}) END AS l{j}{j} FROM {last})")
        below = "".join(f", ({a(i, j)}{''.join(f' - l{i}{k} * l{j}{k}' for k in range(j))}) / l{j}{j} AS l{i}{j}" for i in range(j + 1, n))
        ctes.append(f"c{j} AS (SELECT *{below} FROM p{j})")
        last = f"c{j}"
    for i in range(n):
        ctes.append(f"z{i}_ AS (SELECT *, (b_{i}{''.join(f' - l{i}{k} * z{k}' for k in range(i))}) / l{i}{i} AS z{i} FROM {last})")
        last = f"z{i}_"
    for i in reversed(range(n)):
        ctes.append(f"be{i} AS (SELECT *, (z{i}{''.join(f' - l{k}{i} * beta_{k}' for k in range(i + 1, n))}) / l{i}{i} AS beta_{i} FROM {last})")
        last = f"be{i}"
    fitted = " + ".join(f"beta_{i} * b_{i}" for i in range(n))
    square = " + ".join(f"{1 if i == j else 2} * beta_{i} * beta_{j} * a_{i}_{j}" for i in range(n) for j in range(i, n))
    ctes.append(f"tot AS (SELECT *, yy - b_0 * b_0 / a_0_0 AS tss, yy - 2 * ({fitted}) + ({square}) AS rss FROM {last})")
    ctes.append(f"solved AS (SELECT *, CASE WHEN tss > {PIVOT!r} * yy THEN 1 - rss / tss END AS r2 FROM tot)")
    return ctes


def fit_ctes(names, h: int = 11, kernel: str = "Tricube", source: str = "series", doys: str = "true", extra=(), clim: str | None = None) -> list[str]:
    """CTEs from the tables to solved."""
    n = len(names)
    return [DAILY_SQL, *extra, *features_sql(names, source, clim), gram_sql(n), kernel_sql(h, kernel), conv_sql(n, where=doys), *solve_sql(n)]


def wide_select(names) -> str:
    """The standard coefficient table from solved."""
    return "SELECT " + ", ".join(f'round(beta_{i}, 6) AS "{WIDE.get(x, x)}"' for i, x in enumerate(names)) + ', CAST(doy AS INTEGER) AS doy, round(r2, 6) AS r_squared_anom, "ID" FROM solved'


def pearson_sql(x: str, y: str) -> str:
    """Guarded correlation of two columns without nulls."""
    vx, vy = f"(avg({x} * {x}) - avg({x}) * avg({x}))", f"(avg({y} * {y}) - avg({y}) * avg({y}))"
    return f"CASE WHEN count(*) >= 2 AND {vx} > 1e-12 * abs(avg({x} * {x})) AND {vy} > 1e-12 * abs(avg({y} * {y})) THEN (avg({x} * {y}) - avg({x}) * avg({y})) / sqrt({vx} * {vy}) END"


def scores_sql(p: str, o: str) -> str:
    """n, rmse, mae, bias, r, cosine of two columns without nulls, rounded."""
    return f"count(*) AS n, round(sqrt(avg(({p} - {o}) * ({p} - {o}))), 6) AS rmse, round(avg(abs({p} - {o})), 6) AS mae, round(avg({p} - {o}), 6) AS bias, round({pearson_sql(p, o)}, 6) AS r, round(sum({p} * {o}) / nullif(sqrt(sum({p} * {p}) * sum({o} * {o})), 0), 6) AS cosine"
