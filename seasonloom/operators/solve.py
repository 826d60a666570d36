"""Solvers of the small symmetric systems: Cholesky as column expressions, and a batched one for any size."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seasonloom.operators.gram import stat_names

#: A pivot at or below this share of its diagonal means a singular system.
PIVOT = 1e-9


def cholesky(df: DataFrame, n: int) -> DataFrame:
    """df with beta_0 .. beta_{n-1} and r2, by unrolled Cholesky steps; all null where a system is singular.

    Every step is a projection, which whole-stage code generation compiles; meant for up to about five features.
    """
    a = lambda i, j: F.col(f"a_{min(i, j)}_{max(i, j)}")
    for j in range(n):
        pivot = a(j, j)
        for k in range(j):
            pivot = pivot - F.col(f"_l{j}{k}") * F.col(f"_l{j}{k}")
        df = df.withColumn("_p", pivot).withColumn(f"_l{j}{j}", F.when(F.col("_p") > PIVOT * a(j, j), F.sqrt("_p")))
        below = {}
        for i in range(j + 1, n):
            value = a(i, j)
            for k in range(j):
                value = value - F.col(f"_l{i}{k}") * F.col(f"_l{j}{k}")
            below[f"_l{i}{j}"] = value / F.col(f"_l{j}{j}")
        df = df.withColumns(below) if below else df
    for i in range(n):
        value = F.col(f"b_{i}")
        for k in range(i):
            value = value - F.col(f"_l{i}{k}") * F.col(f"_z{k}")
        df = df.withColumn(f"_z{i}", value / F.col(f"_l{i}{i}"))
    for i in reversed(range(n)):
        value = F.col(f"_z{i}")
        for k in range(i + 1, n):
            value = value - F.col(f"_l{k}{i}") * F.col(f"beta_{k}")
        df = df.withColumn(f"beta_{i}", value / F.col(f"_l{i}{i}"))
    return with_r2(df.drop(*[c for c in df.columns if c.startswith("_")]), n)


def with_r2(df: DataFrame, n: int) -> DataFrame:
    """df with r2 = 1 - residual / total, both weighted; null where the total is not positive or a coefficient is null."""
    fitted = sum((F.col(f"beta_{i}") * F.col(f"b_{i}") for i in range(n)), F.lit(0.0))
    square = sum(((1.0 if i == j else 2.0) * F.col(f"beta_{i}") * F.col(f"beta_{j}") * F.col(f"a_{i}_{j}") for i in range(n) for j in range(i, n)), F.lit(0.0))
    residual = F.col("yy") - 2 * fitted + square
    total = F.col("yy") - F.col("b_0") * F.col("b_0") / F.col("a_0_0")
    return df.withColumn("r2", F.when(total > PIVOT * F.col("yy"), 1 - F.try_divide(residual, total)))


def solve_masked(stats: np.ndarray, keep: np.ndarray, n: int, pinv: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients (0 for features left out) and r2 of systems in rows of statistics; keep: which features take part.

    Left-out rows and columns become those of a unit matrix, which equals solving the rest alone. Singular systems give
    NaN, or with pinv their least-norm solution.
    """
    m = len(stats)
    upper = np.triu_indices(n)
    a = np.zeros((m, n, n))
    a[:, upper[0], upper[1]] = stats[:, : len(upper[0])]
    a = np.maximum.reduce([a, np.zeros_like(a)]) + np.minimum(a, 0)
    a = a + np.transpose(a, (0, 2, 1)) - a * np.eye(n)
    b, yy = stats[:, len(upper[0]) : len(upper[0]) + n], stats[:, len(upper[0]) + n]
    k = keep.astype(float)
    masked = a * k[:, :, None] * k[:, None, :]
    full = masked + np.eye(n) * (1 - k)[:, None, :]
    rhs = b * k
    beta = np.full((m, n), np.nan)
    scale = np.sqrt(np.maximum(np.einsum("mii->mi", full), 1e-300))
    unit = full / scale[:, :, None] / scale[:, None, :]
    good = np.isfinite(unit).all((1, 2)) & np.isfinite(rhs).all(1)
    lowest = np.full(m, -1.0)
    if good.any():
        lowest[good] = np.linalg.eigvalsh(unit[good])[:, 0]
    sound = good & (lowest > PIVOT)
    if sound.any():
        beta[sound] = np.linalg.solve(unit[sound], (rhs[sound] / scale[sound])[:, :, None])[:, :, 0] / scale[sound]
    if pinv and (rest := good & ~sound).any():
        beta[rest] = np.einsum("mij,mj->mi", np.linalg.pinv(full[rest], hermitian=True), rhs[rest])
    beta = np.where(keep, beta, np.where(np.isnan(beta), np.nan, 0.0))
    residual = yy - 2 * (beta * rhs).sum(1) + np.einsum("mi,mij,mj->m", np.nan_to_num(beta), masked, np.nan_to_num(beta))
    with np.errstate(divide="ignore", invalid="ignore"):
        total = yy - b[:, 0] ** 2 / a[:, 0, 0]
        r2 = np.where((total > PIVOT * yy) & ~np.isnan(beta).any(1), 1 - residual / total, np.nan)
    return beta, r2


def batched(df: DataFrame, n: int, keep_col: str | None = None, pinv: bool = False) -> DataFrame:
    """df with betas (array<double>) and r2 by batches; keep_col: an array<boolean> column of features to keep (all without)."""
    names = stat_names(n)

    def work(frames):
        for frame in frames:
            keep = np.stack(frame[keep_col].to_numpy()).astype(bool) if keep_col and len(frame) else np.ones((len(frame), n), bool)
            beta, r2 = solve_masked(frame[names].to_numpy(float), keep, n, pinv)
            yield frame.assign(betas=pd.Series(list(beta), index=frame.index), r2=r2)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    solved = df.mapInPandas(work, f"{schema}, betas array<double>, r2 double")
    null = F.lit(None).cast("double")
    return solved.withColumn("betas", F.transform("betas", lambda x: F.nanvl(x, null))).withColumn("r2", F.nanvl("r2", null))
