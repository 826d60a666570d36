"""Whole runs: prepare, fit, repair, forecast, select recipes, train and forecast by zone, backtest, score; and their command line."""

from __future__ import annotations

import argparse
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seasonloom.config import SPLITS, FitConfig, TuningConfig, max_lag
from seasonloom.functions.expressions import bucket_of
from seasonloom.operators import baselines, forecast, metrics, quality, selection, series, zoned
from seasonloom.operators.fit import failures, failures_in_order, fit
from seasonloom.sources import readers, sinks


def run_prepare(spark: SparkSession, base: str, out: str, years: tuple[int, int], buckets: int = 1024, td_var: str = "td", tmin_var: str = "tmin_v12") -> None:
    """Prepared rows and climatology, by bucket."""
    sinks.build_training(spark, base, f"{out}/training", years, td_var, tmin_var, buckets)
    sinks.shard_climatology(series.climatology(training(spark, out)), f"{out}/climatology", buckets)


def training(spark: SparkSession, out: str) -> DataFrame:
    """The prepared rows of a run."""
    return spark.read.parquet(f"{out}/training").select("ID", "FECHA", "TD", "TMIN", "doy")


def climatology(spark: SparkSession, out: str) -> DataFrame:
    """The written climatology of a run, which fits, repairs and forecasts share."""
    return spark.read.parquet(f"{out}/climatology").select("ID", "doy", "TD_clim", "TMIN_clim")


def run_fit(spark: SparkSession, out: str, config: FitConfig, buckets: int = 1024, doys=None, resume: bool = False) -> None:
    """Coefficients and failure records of the prepared rows; resume: buckets that are there already are left alone."""
    rows, target = training(spark, out), f"{out}/coefficients"
    done = readers.bucket_ids(spark, target) if resume else []
    if done:
        if readers.known_buckets(spark, target) != buckets:
            raise ValueError(f"{target} has another number of buckets")
        rows = rows.where(~bucket_of(F.col("ID"), buckets).isin(done))
    sinks.write_bucketed(fit(rows, config, climatology(spark, out), doys=doys), target, buckets, order=("ID", "doy"), whole=not done)
    write_failures(spark, out)


def write_failures(spark: SparkSession, out: str) -> None:
    """The failure records of a run's coefficients, in order; the folder goes if there are none."""
    found = failures(spark.read.parquet(f"{out}/coefficients"))
    if found.head(1):
        failures_in_order(found).write.mode("overwrite").parquet(f"{out}/failures")
    else:
        path, fs = sinks.filesystem(spark, f"{out}/failures")
        fs.delete(path, True)


def repaired(base: DataFrame, rows: DataFrame, expected: int, config: FitConfig = FitConfig(), clim: DataFrame | None = None) -> tuple[DataFrame, list[int]]:
    """Coefficients with the incomplete days fitted again, and these days."""
    days = quality.incomplete_doys(base, expected)
    return (quality.patch(base, fit(rows, config, clim, doys=days), days), days) if days else (base, days)


def run_repair(spark: SparkSession, out: str, expected: int, config: FitConfig = FitConfig()) -> list[int]:
    """Detects, fits again, patches in place with the same buckets; the days that are still incomplete."""
    target = f"{out}/coefficients"
    whole, days = repaired(spark.read.parquet(target).drop("id_bucket"), training(spark, out), expected, config, climatology(spark, out))
    if days:
        sinks.replace_staged(whole, target, readers.known_buckets(spark, target))
        write_failures(spark, out)
    return quality.incomplete_doys(spark.read.parquet(target), expected)


def future_rows(spark: SparkSession, base: str, years: tuple[int, int], tmin_var: str) -> DataFrame:
    """ID, FECHA, TMIN of the forecast years."""
    return readers.read_raw(spark, readers.yearly_files(spark, base, tmin_var, years)).withColumnRenamed("Value", "TMIN")


def history_rows(spark: SparkSession, out: str, year: int, lag: int = 0) -> DataFrame:
    """Training rows up to the end of a year, as far back as its first day and the longest lag reach."""
    first = F.date_sub(F.lit(f"{year}-01-01").cast("date"), lag)
    return training(spark, out).where((F.col("FECHA") >= first) & (F.col("FECHA") <= F.lit(f"{year}-12-31").cast("date")))


def run_forecast(spark: SparkSession, base: str, out: str, years: tuple[int, int], history_year: int, tmin_var: str = "tmin_v12") -> list[str]:
    """Forecasts of the years as monthly files; their paths."""
    made = forecast.recursive(spark.read.parquet(f"{out}/coefficients"), climatology(spark, out), history_rows(spark, out, history_year), future_rows(spark, base, years, tmin_var), years)
    return sinks.write_monthly(forecast.monthly(made), f"{out}/predictions")


def run_forecast_zoned(spark: SparkSession, base: str, out: str, years: tuple[int, int], history_year: int, tmin_var: str = "tmin_v12") -> list[str]:
    """Forecasts by zone recipes as monthly files; their paths. History reaches back as far as the recipes' longest lag."""
    recipes = readers.read_manifest(spark, f"{out}/manifest").select(F.explode(F.split("feature_list", ",")).alias("f"))
    names = [r["f"] for r in recipes.distinct().collect()]  # features of the pool
    lag = max_lag(["const", *sorted(n for n in names if n != "const")])
    made = forecast.zoned(spark.read.parquet(f"{out}/zoned_coefficients"), climatology(spark, out), history_rows(spark, out, history_year, lag), future_rows(spark, base, years, tmin_var), years)
    return sinks.write_monthly(forecast.monthly(made), f"{out}/predictions_zoned")


def run_select(spark: SparkSession, out: str, zones: DataFrame, tuning: TuningConfig) -> None:
    """Selects recipes by zone."""
    sinks.write_manifest(selection.select(training(spark, out), zones, tuning, climatology(spark, out)), f"{out}/manifest")


def run_zoned(spark: SparkSession, out: str, zones: DataFrame, tuning: TuningConfig) -> None:
    """Trains with the recipes of the zones."""
    made = zoned.zoned_fit(training(spark, out), zones, readers.read_manifest(spark, f"{out}/manifest"), tuning.base, tuning.pool, climatology(spark, out))
    made.write.mode("overwrite").parquet(f"{out}/zoned_coefficients")


def run_tuned(spark: SparkSession, out: str, zones: DataFrame, tuning: TuningConfig) -> None:
    """Selects recipes by zone and trains with them."""
    run_select(spark, out, zones, tuning)
    run_zoned(spark, out, zones, tuning)


def run_backtest(spark: SparkSession, out: str, zones: DataFrame, config: FitConfig = FitConfig(), splits=SPLITS) -> DataFrame:
    """Scores of all splits, written too: fits and climatology of each are made of its training years alone."""

    def forecaster(train: DataFrame, held: DataFrame, holdout: tuple[int, int]) -> DataFrame:
        clim = series.climatology(train, nan_policy="skip")
        return forecast.recursive(fit(train, replace(config, train_years=None), clim), clim, train, held, holdout)

    baselines.backtest(training(spark, out), zones, forecaster, splits).write.mode("overwrite").parquet(f"{out}/backtest")
    return spark.read.parquet(f"{out}/backtest")


def run_score(spark: SparkSession, predictions: str, observed: str) -> str:
    """A Markdown report of the skill of monthly files against observations."""
    pred = spark.read.parquet(predictions).withColumnRenamed("Value", "TD_predicted")
    return sinks.markdown(metrics.skill(pred, readers.read_observed(spark, observed)).orderBy("month"), "Skill")


def parser() -> argparse.ArgumentParser:
    """The command line."""
    p = argparse.ArgumentParser(prog="seasonloom", description=__doc__)
    p.add_argument("phases", help="comma-separated: prepare, fit, repair, forecast, select, train-zoned, forecast-zoned, backtest, score")
    p.add_argument("--base", required=True, help="folder of the raw monthly files")
    p.add_argument("--out", required=True)
    p.add_argument("--years", default="1981:2016")
    p.add_argument("--forecast-years", default="2017:2020")
    p.add_argument("--buckets", type=int, default=1024)
    p.add_argument("--h", type=int, default=11)
    p.add_argument("--kernel", default="Tricube")
    p.add_argument("--min-samples", type=int, default=15)
    p.add_argument("--td-var", default="td")
    p.add_argument("--tmin-var", default="tmin_v12")
    p.add_argument("--expected", type=int, help="locations per day of year; by default those of the training rows")
    p.add_argument("--resume", action="store_true", help="fit only the buckets that aren't there yet")
    p.add_argument("--zones", help="zone table (ID, zone_id, zone_label), for select, train-zoned and backtest")
    p.add_argument("--granularity", default="doy", help="recipes by doy or zone")
    p.add_argument("--per-zone", type=int, default=2000, help="locations of a zone that selection looks at")
    p.add_argument("--observed", help="observations (ID, FECHA, Value), for score")
    p.add_argument("--master", help="by default that of spark-submit")
    return p


def main(argv=None) -> int:
    """Runs phases; 1 if days stay incomplete."""
    from seasonloom.session import get_session

    a = parser().parse_args(argv)
    span = lambda s: tuple(int(x) for x in s.split(":"))
    spark, years = get_session(a.master), span(a.years)
    config, status = FitConfig(a.h, a.kernel, a.min_samples, train_years=years), 0
    tuning = TuningConfig(config, granularity=a.granularity, per_zone_n=a.per_zone)
    zones = spark.read.parquet(a.zones) if a.zones else None
    for phase in a.phases.split(","):
        if phase in ("select", "train-zoned", "backtest") and zones is None:
            raise SystemExit(f"{phase} needs --zones")
        if phase == "prepare":
            run_prepare(spark, a.base, a.out, years, a.buckets, a.td_var, a.tmin_var)
        elif phase == "fit":
            run_fit(spark, a.out, config, a.buckets, resume=a.resume)
        elif phase == "repair":
            expected = a.expected or training(spark, a.out).select("ID").distinct().count()
            status = int(bool(run_repair(spark, a.out, expected, config)))
        elif phase == "forecast":
            run_forecast(spark, a.base, a.out, span(a.forecast_years), years[1], a.tmin_var)
        elif phase == "select":
            run_select(spark, a.out, zones, tuning)
        elif phase == "train-zoned":
            run_zoned(spark, a.out, zones, tuning)
        elif phase == "forecast-zoned":
            run_forecast_zoned(spark, a.base, a.out, span(a.forecast_years), years[1], a.tmin_var)
        elif phase == "backtest":
            print(sinks.markdown(run_backtest(spark, a.out, zones, config).orderBy("split", "method"), "Backtest"))
        elif phase == "score":
            print(run_score(spark, f"{a.out}/predictions", a.observed))
        else:
            raise SystemExit(f"unknown phase {phase}")
    return status


if __name__ == "__main__":
    raise SystemExit(main())
