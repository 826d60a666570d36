"""Zone regressions, the ladder of baselines, and backtests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seasonloom.config import SPLITS
from seasonloom.operators.metrics import score_columns
from seasonloom.operators.series import climatology, years

METHODS = {"climatology": "pred_clim", "td_eq_tmin": "pred_tmin", "zone_ols": "pred_ols", "tuned": "pred_tuned"}


def zone_ols(series: DataFrame) -> DataFrame:
    """zone_id, intercept, slope of TD on TMIN by moment sums; (mean, 0) below two rows or where TMIN doesn't vary."""
    rows = series.where("TD is not null and TMIN is not null")
    s = rows.groupBy("zone_id").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("TMIN").alias("sx"), F.sum("TD").alias("sy"), F.sum(F.col("TMIN") * F.col("TMIN")).alias("sxx"), F.sum(F.col("TMIN") * F.col("TD")).alias("sxy"))
    s = s.withColumn("det", F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx"))
    flat = (F.col("n") < 2) | (F.abs("det") < 1e-9)
    s = s.withColumn("slope", F.when(flat, 0.0).otherwise(F.try_divide(F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy"), F.col("det"))))
    return s.select("zone_id", F.when(flat, F.col("sy") / F.col("n")).otherwise((F.col("sy") - F.col("slope") * F.col("sx")) / F.col("n")).alias("intercept"), "slope")


def ladder(series: DataFrame, zones: DataFrame, tuned: DataFrame, train_end: int, holdout: tuple[int, int]) -> DataFrame:
    """Backtest rows: observed TD of the holdout with the predictions of all methods, where a tuned one exists."""
    placed = series.join(zones.select("ID", "zone_id"), "ID")
    train, held = placed.where(F.year("FECHA") <= train_end), years(placed, holdout)
    clim = climatology(train, nan_policy="skip")
    rows = held.join(tuned.select("ID", "FECHA", F.col("TD_predicted").alias("pred_tuned")), ["ID", "FECHA"])
    rows = rows.join(clim.select("ID", "doy", F.col("TD_clim").alias("pred_clim")), ["ID", "doy"], "left").join(zone_ols(train), "zone_id", "left")
    return rows.where("TD is not null").select("ID", "zone_id", "FECHA", "doy", F.col("TD").alias("TD_obs"), "pred_tuned", "pred_clim", F.col("TMIN").alias("Tmin_hold"), F.col("TMIN").alias("pred_tmin"), (F.col("intercept") + F.col("slope") * F.col("TMIN")).alias("pred_ols"))


def ladder_scores(rows: DataFrame, split: str = "ll1", methods=METHODS) -> DataFrame:
    """split, method, n, rmse, mae, bias, r, skill_vs_clim: each method against the observed values."""
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.col(c).cast("double").alias("pred")) for m, c in methods.items()])).alias("p")
    scores = rows.select(F.col("TD_obs").cast("double").alias("obs"), pairs).groupBy("p.method").agg(*score_columns(F.col("p.pred"), F.col("obs"))).drop("cosine")
    clim = scores.where("method = 'climatology'").select(F.col("rmse").alias("clim_rmse"), F.lit(split).alias("split"))
    return scores.withColumn("split", F.lit(split)).join(clim, "split", "left").select("split", "method", "n", "rmse", "mae", "bias", "r", (1 - F.try_divide("rmse", "clim_rmse")).alias("skill_vs_clim"))


def backtest(series: DataFrame, zones: DataFrame, forecaster, splits=SPLITS) -> DataFrame:
    """Scores of all splits; forecaster(training series, held series, holdout years) returns ID, FECHA, TD_predicted."""
    out = None
    for name, (train_end, holdout) in splits.items():
        tuned = forecaster(series.where(F.year("FECHA") <= train_end), years(series, holdout), holdout)
        scores = ladder_scores(ladder(series, zones, tuned, train_end, holdout), name)
        out = scores if out is None else out.unionByName(scores)
    return out


def lead_curve(scores: DataFrame) -> DataFrame:
    """lead, method, rmse: by years ahead (split ll<k> is k)."""
    return scores.select(F.regexp_extract("split", r"(\d+)", 1).cast("int").alias("lead"), "method", "rmse")
