"""Readers of raw, prepared and grid data."""

from __future__ import annotations

import datetime as dt
import re
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seasonloom.schema import RAW, SCALING, require_columns

LEGACY_VAR, LEGACY_NAME = "tmin_v1", "tmin"


def month_path(base: str, variable: str, year: int, month: int, legacy: bool = True) -> list[str]:
    """Possible files of a month, best first: the older name of one variable wins where both exist."""
    names = [variable]
    if legacy and variable == LEGACY_VAR:
        names.insert(0, LEGACY_NAME)
    return [f"{base}/{variable}/Outputs/{n}_daily_{year:04d}_{month:02d}.parquet" for n in names]


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path exists, in any store that Spark reads."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def monthly_files(spark: SparkSession, base: str, variable: str, start: dt.date, end: dt.date, legacy: bool = True) -> list[str]:
    """Existing files of the months whose first day lies from start to end."""
    out, year, month = [], start.year, start.month
    if start.day > 1:
        year, month = (year + 1, 1) if month == 12 else (year, month + 1)
    while dt.date(year, month, 1) <= end:
        found = next((p for p in month_path(base, variable, year, month, legacy) if exists(spark, p)), None)
        if found:
            out.append(found)
        year, month = (year + 1, 1) if month == 12 else (year, month + 1)
    return out


def yearly_files(spark: SparkSession, base: str, variable: str, years: tuple[int, int], legacy: bool = True) -> list[str]:
    """Existing monthly files of the years, both included."""
    return monthly_files(spark, base, variable, dt.date(years[0], 1, 1), dt.date(years[1], 12, 31), legacy)


def read_raw(spark: SparkSession, files: list[str]) -> DataFrame:
    """ID, FECHA (date), Value (double; NaN is null) of raw files; other columns are never read."""
    if not files:
        return spark.createDataFrame([], "ID long, FECHA date, Value double")
    df = require_columns(spark.read.parquet(*files), ("ID", "FECHA", "Value"), "raw file")
    return df.select(F.col("ID").try_cast("long").alias("ID"), F.to_date("FECHA").alias("FECHA"), F.nanvl(F.col("Value").cast("double"), F.lit(None).cast("double")).alias("Value")).where("ID is not null")


def read_location(spark: SparkSession, files: list[str], location: int, value_name: str = "Value") -> DataFrame:
    """The rows of one location; the filter reaches the scan. Files that lack a column are left out."""
    whole = [f for f in files if {"ID", "FECHA", "Value"} <= set(spark.read.parquet(f).columns)]
    return read_raw(spark, whole).where(F.col("ID") == location).withColumnRenamed("Value", value_name)


def read_tree(spark: SparkSession, path: str, columns=None, where: str | None = None) -> DataFrame:
    """A Parquet file or tree without its bucket column; columns and filter reach the scan."""
    df = spark.read.parquet(path)
    if where:
        df = df.where(where)
    return df.select(*columns) if columns else df.drop("id_bucket")


def read_observed(spark: SparkSession, path: str, value_col: str = "Value") -> DataFrame:
    """ID, FECHA, Value with one row per key: the smallest value of repeated keys."""
    df = spark.read.parquet(path)
    return df.select("ID", F.to_date("FECHA").alias("FECHA"), F.col(value_col).cast("double").alias("Value")).groupBy("ID", "FECHA").agg(F.min("Value").alias("Value"))


def read_grid_ids(spark: SparkSession, path: str, id_column: str = "ID", fallback_to_index: bool = True) -> DataFrame:
    """ID of each grid cell, distinct: numbers as they are, other text by its rank from 0; without the column, row ranks."""
    df = spark.read.option("header", True).csv(path) if path.endswith(".csv") else spark.read.parquet(path)
    if id_column not in df.columns:
        if not fallback_to_index:
            raise KeyError(f"{path} has no column {id_column}")
        return spark.range(df.count()).select(F.col("id").alias("ID"))
    ids = df.select(F.col(id_column).cast("string").alias("text")).where("text is not null").distinct().withColumn("ID", F.col("text").try_cast("double").cast("long"))
    if ids.where("ID is null").head(1):
        from pyspark.sql import Window

        return ids.select((F.row_number().over(Window.orderBy("text")) - 1).cast("long").alias("ID"))
    return ids.select("ID").distinct()


def read_coords(spark: SparkSession, path: str) -> DataFrame:
    """ID, lon, lat of a point table, whatever the case of its column names."""
    df = spark.read.parquet(path)
    names = {c.lower(): c for c in df.columns}
    pick = lambda *options: F.col(next(names[o] for o in options if o in names))
    return df.select(pick("id").cast("long").alias("ID"), pick("lon", "longitude", "x").cast("double").alias("lon"), pick("lat", "latitude", "y").cast("double").alias("lat"))


def bucket_ids(spark: SparkSession, root: str) -> list[int]:
    """Buckets of a bucketed tree, from its folder names."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
    return sorted(int(m[1]) for n in names if (m := re.fullmatch(r"id_bucket=(\d+)", n)))


def known_buckets(spark: SparkSession, root: str) -> int | None:
    """How many buckets a tree has: as its writer has noted, else one more than its greatest bucket; None without any."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/_buckets")
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    noted = [int(s.getPath().getName()) for s in fs.listStatus(p)] if fs.exists(p) else []
    found = bucket_ids(spark, root)
    return max(noted) if noted else found[-1] + 1 if found else None


def choose_buckets(spark: SparkSession, root: str, first: int | None = None, sample: int | None = None, seed: int = 0) -> list[int]:
    """Buckets of a tree: the first so many by number, or a sample of so many that the seed determines; else all."""
    import random

    found = bucket_ids(spark, root)
    if first is not None:
        return found[:first]
    return sorted(random.Random(seed).sample(found, min(sample, len(found)))) if sample is not None else found


def load_buckets(spark: SparkSession, root: str, buckets: list[int]) -> DataFrame:
    """The rows of some buckets of a tree; other folders aren't read."""
    return spark.read.parquet(root).where(F.col("id_bucket").cast("int").isin(list(buckets))).drop("id_bucket")


def global_max_id(spark: SparkSession, files: list[str]) -> int | None:
    """The greatest ID in files; the footers' statistics answer where the reader can push the aggregate down."""
    return spark.read.parquet(*files).select("ID").agg(F.max("ID")).first()[0] if files else None


def checked_manifest(manifest: DataFrame) -> DataFrame:
    """A recipe table with the columns and kinds that zoned training reads; recipes that can't be used are an error."""
    rows = require_columns(manifest, ("zone_id", "doy", "h", "feature_list"), "manifest")
    kinds = {"zone_id": "int", "doy": "int", "h": "int"}
    rows = rows.select(*[F.col(c).cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in rows.columns])
    bad = rows.where("zone_id is null or h is null or h < 1 or h > 182 or doy is null or not (doy = -1 or doy between 1 and 366) or feature_list is null or not (feature_list = 'const' or feature_list like 'const,%')")
    if (example := bad.first()) is not None:
        raise ValueError(f"not a recipe: {example}")
    if rows.groupBy("zone_id", "doy").count().where("count > 1").head(1):
        raise ValueError("a zone has two recipes for one day")
    return rows


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A recipe table, checked."""
    return checked_manifest(spark.read.parquet(path))


def load_dataset(spark: SparkSession, path: str, label: str) -> DataFrame:
    """A Parquet file or tree without its bucket column, each row with its dataset's label."""
    return read_tree(spark, path).withColumn("dataset", F.lit(label))


def load_for_ids(spark: SparkSession, root: str, ids: DataFrame, buckets: int) -> DataFrame:
    """Prepared rows of some locations: only their buckets' folders are read, by dynamic partition pruning."""
    wanted = ids.select("ID", F.pmod("ID", F.lit(buckets)).cast("int").alias("id_bucket"))
    return spark.read.parquet(root).join(wanted, ["ID", "id_bucket"], "left_semi").drop("id_bucket")


def read_scaling(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Scaling measurements of CSV files."""
    return spark.read.schema(SCALING).option("header", True).csv(paths)


def year_of_file(path: str) -> int | None:
    """The year in a monthly file's name."""
    m = re.search(r"_(\d{4})_\d{2}\.parquet$", Path(path).name)
    return int(m[1]) if m else None


def synthetic_raw(spark: SparkSession, n_ids: int, years: tuple[int, int], variable: str = "TD", seed: int = 1234) -> DataFrame:
    """ID, FECHA, Value: a yearly sinusoid with an offset by location and daily noise, seeded."""
    level, swing = (15.0, 8.0) if variable == "TD" else (8.0, 6.0)
    normal = lambda *key: F.sqrt(-2 * F.log(unit(*key, "r"))) * F.cos(2 * 3.141592653589793 * unit(*key, "a"))
    unit = lambda *key: (F.pmod(F.xxhash64(F.lit(seed), F.lit(variable), *[k if not isinstance(k, str) else F.lit(k) for k in key]), F.lit(1 << 30)) + 1) / F.lit(float((1 << 30) + 1))
    days = F.explode(F.sequence(F.lit(f"{years[0]}-01-01").cast("date"), F.lit(f"{years[1]}-12-31").cast("date")))
    rows = spark.range(1, n_ids + 1).select(F.col("id").alias("ID"), days.alias("day"))
    value = level + swing * F.sin(2 * 3.141592653589793 * F.dayofyear("day") / 365.0) + 3 * normal(F.col("ID"), "id") + normal(F.col("ID"), F.col("day"))
    return rows.select("ID", F.col("day").cast("timestamp_ntz").alias("FECHA"), value.alias("Value"))


RAW_SCHEMA = RAW
