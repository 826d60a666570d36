"""Analysis of scaling measurements: medians, speedup, efficiency, weak diagonals, contention."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GROUP = ("dataset", "hw", "mode", "phase")
FAMILY = ("dataset", "hw", "phase")


def medians(runs: DataFrame, keys=GROUP) -> DataFrame:
    """keys, p, wall_s (median over trials), n_ids and B (of the first trial)."""
    first = lambda c: F.min_by(c, "trial").alias(c)
    return runs.groupBy(*keys, "p").agg(F.median("wall_s").alias("wall_s"), first("n_ids"), first("B"))


def speedup(table: DataFrame, keys=GROUP) -> DataFrame:
    """table with speedup (null for weak runs) and efficiency, against the smallest p of each group."""
    base = F.first_value("wall_s").over(Window.partitionBy(*keys).orderBy("p"))
    strong = F.col("mode") == "strong" if "mode" in table.columns else F.lit(True)
    ratio = base / F.col("wall_s")
    return table.withColumn("speedup", F.when(strong, ratio)).withColumn("efficiency", F.when(strong, ratio / F.col("p")).otherwise(ratio))


def family(runs: DataFrame) -> DataFrame:
    """Strong runs by problem size B: median wall_s, n_ids, speedup, efficiency over p."""
    strong = runs.where("mode = 'strong'")
    table = strong.groupBy(*FAMILY, "B", "p").agg(F.median("wall_s").alias("wall_s"), F.min_by("n_ids", "trial").alias("n_ids"))
    return speedup(table, (*FAMILY, "B"))


def weak_diagonals(sizes: DataFrame) -> DataFrame:
    """n0, p, B, wall_s, efficiency along B = n0 * p, for diagonals of two points or more."""
    points = sizes.select(*FAMILY, "B", "p", "wall_s")
    starts = points.groupBy(*FAMILY).agg(F.collect_set("B").alias("n0s")).select(*FAMILY, F.explode("n0s").alias("n0"))
    rows = points.join(starts, list(FAMILY)).where(F.col("B") == F.col("n0") * F.col("p"))
    line = Window.partitionBy(*FAMILY, "n0")
    rows = rows.withColumn("points", F.count(F.lit(1)).over(line)).where("points >= 2")
    return rows.select(*FAMILY, "n0", "p", "B", "wall_s", (F.first_value("wall_s").over(line.orderBy("p")) / F.col("wall_s")).alias("efficiency"))


def contention(p: Column, gamma: Column) -> Column:
    """Efficiency of p cores that share one memory bus."""
    return (1 + gamma) / (1 + gamma * p)


def fit_gamma(points: DataFrame, low: float = 1e-4, high: float = 10.0, tolerance: float = 1e-7) -> float:
    """The gamma from low to high of least squares over (p, efficiency).

    Efficiency is an average by p, as the squares' sum differs from that over averages by a constant only; what reaches
    the driver is one row for each number of cores. On a logarithmic scale the sum is searched by golden section, from
    the best of a few starts.
    """
    rows = points.groupBy(F.col("p").cast("double").alias("p")).agg(F.avg("efficiency").alias("e"), F.count(F.lit(1)).alias("n")).collect()

    def loss(x: float) -> float:
        gamma = math.exp(x)
        return sum(r["n"] * (r["e"] - (1 + gamma) / (1 + gamma * r["p"])) ** 2 for r in rows)

    a, b = math.log(low), math.log(high)
    starts = [a + (b - a) * k / 32 for k in range(33)]
    k = min(range(33), key=lambda i: loss(starts[i]))
    a, b = starts[max(k - 1, 0)], starts[min(k + 1, 32)]
    share = (math.sqrt(5) - 1) / 2
    x, y = b - share * (b - a), a + share * (b - a)
    fx, fy = loss(x), loss(y)
    while b - a > tolerance:
        if fx <= fy:
            b, y, fy = y, x, fx
            x = b - share * (b - a)
            fx = loss(x)
        else:
            a, x, fx = x, y, fy
            y = a + share * (b - a)
            fy = loss(y)
    return math.exp((a + b) / 2)


def best_block(runs: DataFrame) -> DataFrame:
    """size, block, time_ms: the block of the least median time for each size (smaller block if equal)."""
    m = runs.groupBy("size", "block").agg(F.median("time_ms").alias("time_ms"))
    return m.groupBy("size").agg(F.min(F.struct("time_ms", "block")).alias("b")).select("size", F.col("b.block").alias("block"), F.col("b.time_ms").alias("time_ms"))


def hardware(runs: DataFrame, fits_each: int = 366) -> DataFrame:
    """B, n_ids, median wall_s of each kind of hardware (hw) at its best p, seconds a fit, and the gain over the slowest."""
    best = runs.groupBy("B", "hw", "p").agg(F.median("wall_s").alias("wall_s"), F.min_by("n_ids", "trial").alias("n_ids")).groupBy("B", "hw").agg(F.min(F.struct("wall_s", "p", "n_ids")).alias("best"))
    rows = best.select("B", "hw", F.col("best.p").alias("p"), F.col("best.n_ids").alias("n_ids"), F.col("best.wall_s").alias("wall_s"))
    return rows.withColumn("s_per_fit", F.try_divide("wall_s", F.col("n_ids") * fits_each)).withColumn("gain", F.max("wall_s").over(Window.partitionBy("B")) / F.col("wall_s"))


def cost_model(sizes: DataFrame, n_rows: str = "n_rows", n_ids: str = "n_ids", features: int = 5, h: int = 11) -> DataFrame:
    """sizes with flops and bytes of assembly, convolution and solution: products by row, weighted sums by day, and a Cholesky solve."""
    stats = features * (features + 1) // 2 + features + 2
    fits = F.col(n_ids) * 366.0
    return sizes.withColumns({"assemble_flops": F.col(n_rows) * 2.0 * stats, "assemble_bytes": F.col(n_rows) * 8.0 * (features + 1) + fits * 8.0 * stats, "convolve_flops": fits * 2.0 * stats * (2 * h + 1), "convolve_bytes": fits * 16.0 * stats, "solve_flops": fits * (features**3 / 3.0 + 2.0 * features**2), "solve_bytes": fits * 8.0 * (stats + features + 1)})
