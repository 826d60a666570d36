"""Zoned training: every location fits with its zone's recipe of features and bandwidth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seasonloom.config import POOL, FitConfig
from seasonloom.functions.expressions import kernel_weight, shifted_doy
from seasonloom.operators.gram import day_sums, stat_names
from seasonloom.operators.series import feature_frame, years
from seasonloom.operators.solve import batched

ALL_DOYS = -1


def recipe_lookup(targets: DataFrame, manifest: DataFrame) -> DataFrame:
    """targets (with zone_id, doy) with h and feature_list: the zone's recipe of the day, else that of all days; others go.

    The manifest has at most 367 rows a zone; its joins are left to the planner, which broadcasts it while it is small.
    """
    day = manifest.where(F.col("doy") != ALL_DOYS).select("zone_id", "doy", F.col("h").alias("h1"), F.col("feature_list").alias("f1"))
    all_ = manifest.where(F.col("doy") == ALL_DOYS).select("zone_id", F.col("h").alias("h2"), F.col("feature_list").alias("f2"))
    found = targets.join(day, ["zone_id", "doy"], "left").join(all_, "zone_id", "left")
    return found.withColumn("h", F.coalesce("h1", "h2")).withColumn("feature_list", F.coalesce("f1", "f2")).where("h is not null").drop("h1", "h2", "f1", "f2")


def zoned_fit(series: DataFrame, zones: DataFrame, manifest: DataFrame, config: FitConfig = FitConfig(), pool=POOL, clim: DataFrame | None = None) -> DataFrame:
    """ID, zone_id, doy, feature_name, coeff, r_squared_anom, h of the kept features of every fit.

    Rows are complete in the whole pool. Statistics of all pool features are added up by day once; each target day takes
    the window of its recipe's h, and features outside the recipe are masked in the batched solve.
    """
    names = list(pool)
    n = len(names)
    frame = feature_frame(years(series, config.train_years).repartition("ID"), names, clim)
    stats = day_sums(frame, names).join(zones.select("ID", "zone_id"), "ID")
    widest = manifest.agg(F.max("h")).first()[0]
    if widest is None:
        return batched_empty(stats)
    targets = stats.sparkSession.range(1, 367).select(F.col("id").cast("int").alias("doy")).join(manifest.select("zone_id").distinct().withColumn("k", F.lit(1)).alias("z"), F.lit(True))
    recipes = recipe_lookup(targets.select("zone_id", "doy"), manifest).withColumnRenamed("doy", "target_doy")
    # weights by bandwidth and distance, as a literal table
    weights = F.create_map(*[x for h in sorted(r["h"] for r in manifest.select("h").distinct().collect()) for x in (F.lit(h), F.array(*[F.lit(kernel_weight(d, h, config.kernel)) for d in range(h + 1)]))])
    spread = stats.withColumn("delta", F.explode(F.sequence(F.lit(-int(widest)), F.lit(int(widest))))).withColumn("target_doy", shifted_doy(F.col("doy"), F.col("delta")))
    met = spread.join(recipes, ["zone_id", "target_doy"]).where(F.abs("delta") <= F.col("h"))
    met = met.withColumn("w", F.element_at(F.element_at(weights, F.col("h")), F.abs("delta") + 1))
    sums = met.groupBy("ID", "zone_id", "target_doy", "h", "feature_list").agg(*[F.sum(F.col("w") * F.col(c)).alias(c) for c in stat_names(n)], F.sum("n").alias("n")).where(F.col("n") >= config.min_samples)
    keep = F.array(*[F.array_contains(F.split("feature_list", ","), f) for f in names])
    solved = batched(sums.withColumn("keep", keep), n, "keep")
    long = solved.select("ID", "zone_id", F.col("target_doy").alias("doy"), "h", "keep", "r2", F.posexplode("betas").alias("i", "coeff")).where(F.col("keep")[F.col("i")])
    return long.select("ID", "zone_id", "doy", F.element_at(F.array(*[F.lit(f) for f in names]), F.col("i") + 1).alias("feature_name"), "coeff", F.col("r2").alias("r_squared_anom"), "h")


def batched_empty(like: DataFrame) -> DataFrame:
    """A tidy table without rows."""
    from seasonloom.schema import TIDY

    return like.sparkSession.createDataFrame([], TIDY)


def feature_retention(manifest: DataFrame) -> DataFrame:
    """feature, n: in how many recipes each feature stands."""
    return manifest.select(F.explode(F.split("feature_list", ",")).alias("feature")).groupBy("feature").agg(F.count(F.lit(1)).alias("n"))
