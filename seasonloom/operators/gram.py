"""Sufficient statistics of the seasonal regressions: sums by day, circular convolution, leave-one-year-out.

The kernel depends on the distance in days alone, so a fit's weighted products are day sums, spread over their window
and added up: the fan-out of 2h + 1 meets one row per location and day of year, never the raw rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seasonloom.functions.expressions import kernel_rows, shifted_doy


def stat_names(n: int) -> list[str]:
    """Columns of the statistics of n features: the upper triangle of the products, those with the target, and its square."""
    return [f"a_{i}_{j}" for i in range(n) for j in range(i, n)] + [f"b_{i}" for i in range(n)] + ["yy"]


def day_sums(frame: DataFrame, names, keys=("ID", "doy")) -> DataFrame:
    """keys, the statistics, and n: sums over a feature frame's rows."""
    names = list(names)
    products = [F.sum(F.col(x) * F.col(y)).alias(f"a_{i}_{j}") for i, x in enumerate(names) for j, y in enumerate(names) if j >= i]
    targets = [F.sum(F.col(x) * F.col("target")).alias(f"b_{i}") for i, x in enumerate(names)]
    return frame.groupBy(*keys).agg(*products, *targets, F.sum(F.col("target") * F.col("target")).alias("yy"), F.count(F.lit(1)).alias("n"))


def convolved(stats: DataFrame, n: int, h: int, kernel: str, keys=("ID",), doys=None) -> DataFrame:
    """The statistics of each target day (doy): kernel-weighted over the window, n as the plain count of its rows.

    doys restricts the targets before their sums are made.
    """
    spread = stats.withColumn("k", F.explode(kernel_rows(h, kernel))).withColumn("target_doy", shifted_doy(F.col("doy"), F.col("k.delta")))
    if doys is not None:
        spread = spread.where(F.col("target_doy").isin(list(doys)))
    sums = [F.sum(F.col("k.w") * F.col(c)).alias(c) for c in stat_names(n)]
    return spread.groupBy(*keys, "target_doy").agg(*sums, F.sum("n").alias("n")).withColumnRenamed("target_doy", "doy")


def leave_one_year(stats: DataFrame, n: int) -> DataFrame:
    """From convolved statistics by (ID, year, doy): those of all other years, by subtraction from the sum over years."""
    every = Window.partitionBy("ID", "doy")
    return stats.select("ID", "year", "doy", *[(F.sum(c).over(every) - F.col(c)).alias(c) for c in [*stat_names(n), "n"]])
