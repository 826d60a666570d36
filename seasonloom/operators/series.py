"""Prepared series, climatology, anomalies and lags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seasonloom.config import features as parsed
from seasonloom.functions.expressions import known
from seasonloom.schema import require_columns


def prepared(td: DataFrame, tmin: DataFrame) -> DataFrame:
    """ID, FECHA, TD, TMIN, doy: the days on which both variables have a row (ID, FECHA, Value each)."""
    side = lambda df, name: require_columns(df, ("ID", "FECHA", "Value")).select(F.col("ID").try_cast("long").alias("ID"), F.to_date("FECHA").alias("FECHA"), known(F.col("Value")).alias(name)).where("ID is not null")
    return side(td, "TD").join(side(tmin, "TMIN"), ["ID", "FECHA"]).withColumn("doy", F.dayofyear("FECHA"))


def years(series: DataFrame, span: tuple[int, int] | None) -> DataFrame:
    """The rows of the years in span, both included."""
    return series if span is None else series.where(F.year("FECHA").between(*span))


def mean_of(c: Column, nan_policy: str) -> Column:
    """A slot's mean: skip leaves out missing values; poison makes the slot null for one of them."""
    mean = F.avg(known(c))
    return mean if nan_policy == "skip" else F.when(F.count(known(c)) == F.count(F.lit(1)), mean)


def climatology(series: DataFrame, span: tuple[int, int] | None = None, nan_policy: str = "poison") -> DataFrame:
    """ID, doy, TD_clim, TMIN_clim: means by location and day of year over the years in span; absent slots have no row."""
    if nan_policy not in ("skip", "poison"):
        raise ValueError("nan_policy is skip or poison")
    return years(series, span).groupBy("ID", "doy").agg(mean_of(F.col("TD"), nan_policy).alias("TD_clim"), mean_of(F.col("TMIN"), nan_policy).alias("TMIN_clim"))


#: In place of a climatology: none, plain values.
RAW = "raw"


def anomalies(series: DataFrame, clim: DataFrame | str | None = None) -> DataFrame:
    """series with TD_clim, TMIN_clim, TD_anom and TMIN_anom. With RAW the means are 0 and the anomalies plain values.

    Without clim the series' own means serve, as a window over (ID, doy): it shares the partitioning by ID of the lags
    and the sums that follow, where a join by (ID, doy) would shuffle once more.
    """
    if isinstance(clim, str):
        series = series.withColumn("TD_clim", F.lit(0.0)).withColumn("TMIN_clim", F.lit(0.0))
    elif clim is None:
        slot = Window.partitionBy("ID", "doy")
        series = series.withColumn("TD_clim", F.avg(known(F.col("TD"))).over(slot)).withColumn("TMIN_clim", F.avg(known(F.col("TMIN"))).over(slot))
    else:
        series = series.join(clim.select("ID", "doy", "TD_clim", "TMIN_clim"), ["ID", "doy"], "left")
    return series.withColumn("TD_anom", F.col("TD") - F.col("TD_clim")).withColumn("TMIN_anom", F.col("TMIN") - F.col("TMIN_clim"))


def raw_lags(series: DataFrame, lags=(("TD", 1), ("TD", 2), ("TMIN", 1))) -> DataFrame:
    """ID, FECHA, td, and the values of the previous present rows (td1, td2, tm1), for rows that have the longest."""
    order = Window.partitionBy("ID").orderBy("FECHA")
    short = {"TD": "td", "TMIN": "tm"}
    names = [f"{short[v]}{k}" for v, k in lags]
    rows = series.select("ID", "FECHA", F.col("TD").alias("td"), *[F.lag(v, k).over(order).alias(n) for (v, k), n in zip(lags, names)])
    return rows.dropna(subset=[max(zip([k for _, k in lags], names))[1]])


def feature_frame(series: DataFrame, names, clim: DataFrame | str | None = None, complete: bool = True) -> DataFrame:
    """ID, FECHA, doy, year, target and one column per feature. Lags are those of the previous present rows of a location;
    rows that miss the target or a feature go after lagging."""
    order = Window.partitionBy("ID").orderBy("FECHA")
    specs = parsed(names)
    frame = anomalies(series, clim)
    columns = []
    for f in specs:
        base = F.lit(1.0) if f.var is None else F.col(f"{f.var}_anom")
        columns.append((F.lag(base, f.lag).over(order) if f.lag else base).cast("double").alias(f.name))
    frame = frame.select("ID", "FECHA", "doy", F.year("FECHA").alias("year"), F.col("TD_anom").alias("target"), *columns)
    return frame.dropna(subset=["target", *[f.name for f in specs]]) if complete else frame


def last_rows(series: DataFrame, n: int = 2) -> DataFrame:
    """Each location's last n rows, with rn = 1 for the last."""
    order = Window.partitionBy("ID").orderBy(F.desc("FECHA"))
    return series.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= n)


def deduplicated(df: DataFrame, keys: list[str], order: list, keep: str = "first") -> DataFrame:
    """One row per key: the first or last by an explicit order."""
    flip = {"first": order, "last": [c.desc() if isinstance(c, Column) else F.desc(c) for c in order]}[keep]
    ranked = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*flip)))
    return ranked.where("_rn = 1").drop("_rn")
