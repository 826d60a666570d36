"""Seasonal fits: one weighted local regression per location and day of year."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seasonloom.config import STANDARD, FitConfig, doy_list
from seasonloom.operators.gram import convolved, day_sums
from seasonloom.operators.series import RAW, feature_frame, years
from seasonloom.operators.solve import batched, cholesky

#: Column of a standard coefficient table by feature.
WIDE = {"const": "const_anom", "TMIN_anom": "TMIN_anom_coeff"}


def fit(series: DataFrame, config: FitConfig = FitConfig(), clim: DataFrame | str | None = None, doys=None, solver: str = "auto") -> DataFrame:
    """Wide coefficients: one column per feature, doy, r_squared_anom, ID.

    Every (location, day of year) with at least min_samples rows in its window gets a row, null where its system is
    singular. doys restricts the targets, days that there are not being left out. clim: means of its own by default, or
    RAW for plain values. The series is partitioned by ID once; window climatology, lags and sums follow
    without another shuffle. solver: native (expressions), batched (Arrow), pinv (batched, least norm), or auto.
    """
    names = list(config.features)
    own = years(series, config.train_years).repartition("ID")
    stats = day_sums(feature_frame(own, names, clim), names)
    stats = convolved(stats, len(names), config.h, config.kernel, doys=None if doys is None else doy_list(doys, drop=True)).where(F.col("n") >= config.min_samples)
    if solver == "native" or solver == "auto" and len(names) <= 5:
        solved = cholesky(stats, len(names))
        betas = [F.col(f"beta_{i}") for i in range(len(names))]
    else:
        solved = batched(stats, len(names), pinv=solver == "pinv")
        betas = [F.col("betas")[i] for i in range(len(names))]
    row = F.struct(*[b.alias(WIDE.get(n, n)) for b, n in zip(betas, names)], F.col("doy").cast("int").alias("doy"), F.col("r2").alias("r_squared_anom"), "ID")
    # a generator, through which no filter on a coefficient is pushed: it would repeat the whole chain of steps
    return solved.select(F.explode(F.array(row)).alias("fit")).select("fit.*")


def tidy(coefficients: DataFrame, names=STANDARD, h: int = 11, zone: str = "cast(null as int)") -> DataFrame:
    """Long coefficients: ID, zone_id, doy, feature_name, coeff, r_squared_anom, h."""
    columns = [F.struct(F.lit(n).alias("name"), F.col(WIDE.get(n, n)).alias("value")) for n in names]
    long = coefficients.withColumn("f", F.explode(F.array(*columns)))
    return long.select("ID", F.expr(zone).cast("int").alias("zone_id"), "doy", F.col("f.name").alias("feature_name"), F.col("f.value").alias("coeff"), "r_squared_anom", F.lit(h).alias("h"))


def compared(series: DataFrame, names=STANDARD, config: FitConfig = FitConfig()) -> DataFrame:
    """model (raw or anomaly), n, rmse, r2: in-sample one-step predictions of the model of plain values and that of
    anomalies, on the (ID, FECHA) that both predict."""
    raw = one_step(series, fit(series, config, RAW), RAW, names).withColumnRenamed("TD_predicted", "raw")
    anomaly = one_step(series, fit(series, config), None, names).withColumnRenamed("TD_predicted", "anomaly")
    rows = raw.join(anomaly, ["ID", "FECHA"]).join(series.select("ID", "FECHA", F.col("TD").alias("obs")), ["ID", "FECHA"])
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("p")) for m in ("raw", "anomaly")])).alias("x")
    sums = rows.select("obs", pairs).select("obs", "x.*").where("p is not null and obs is not null")
    error = F.col("p") - F.col("obs")
    return sums.groupBy("model").agg(F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(error * error)).alias("rmse"), (1 - F.try_divide(F.sum(error * error), F.var_pop("obs") * F.count(F.lit(1)))).alias("r2"))


def failure_summary(records: DataFrame) -> DataFrame:
    """phase, exception_type, failures, locations, first_doy, last_doy of failure records."""
    return records.groupBy("phase", "exception_type").agg(F.count(F.lit(1)).alias("failures"), F.countDistinct("ID").alias("locations"), F.min("doy").alias("first_doy"), F.max("doy").alias("last_doy"))


def failures(coefficients: DataFrame, bucket_id: int | None = None, phase: str = "fit") -> DataFrame:
    """Failure records of singular fits."""
    bad = coefficients.where("const_anom is null")
    return bad.select(F.lit(phase).alias("phase"), F.lit(bucket_id).cast("int").alias("bucket_id"), "ID", "doy", F.lit("SingularSystem").alias("exception_type"), F.lit("the window's products are singular").alias("message"))


def failures_in_order(records: DataFrame) -> DataFrame:
    """Failure records as they are stored: by location and day, nulls last."""
    return records.orderBy(F.asc_nulls_last("ID"), F.asc_nulls_last("doy"))


def one_step(series: DataFrame, coefficients: DataFrame, clim: DataFrame | str | None = None, names=STANDARD) -> DataFrame:
    """ID, FECHA, TD_predicted: in-sample one-step predictions, from observed lags."""
    from seasonloom.operators.series import anomalies

    frame = feature_frame(series, names, clim)
    means = anomalies(series, clim).select("ID", "FECHA", "TD_clim")
    joined = frame.join(coefficients.select("ID", "doy", *[F.col(WIDE.get(n, n)).alias(f"c_{i}") for i, n in enumerate(names)]), ["ID", "doy"]).join(means, ["ID", "FECHA"])
    total = sum((F.col(f"c_{i}") * F.col(n) for i, n in enumerate(names)), F.col("TD_clim"))
    return joined.select("ID", "FECHA", total.alias("TD_predicted"))
