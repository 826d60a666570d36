"""Writers: bucketed trees, monthly exports, subsets, staged replacement and incremental builds."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seasonloom.functions.expressions import bucket_name
from seasonloom.operators.series import prepared
from seasonloom.sources.readers import checked_manifest, exists, known_buckets, monthly_files, read_raw, yearly_files


def filesystem(spark: SparkSession, path: str):
    """Hadoop's path and file system of a path."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def note_buckets(spark: SparkSession, path: str, buckets: int) -> None:
    """Notes a tree's number of buckets in its folder, as a file whose name tells it."""
    p, fs = filesystem(spark, f"{path}/_buckets")
    fs.delete(p, True)
    fs.create(filesystem(spark, f"{path}/_buckets/{buckets}")[0], True).close()


def write_bucketed(df: DataFrame, path: str, buckets: int, by: tuple[str, ...] = (), order=("ID", "FECHA"), whole: bool = True) -> None:
    """df under id_bucket=NNNN (and further partition columns), sorted within files.

    whole: df is the whole tree, and nothing of an older one stays; else it replaces the folders that it has rows for, in
    a tree with the same number of buckets (another number is an error: rows would be in two buckets).
    """
    spark = df.sparkSession
    there = known_buckets(spark, path)
    if not whole and there not in (None, buckets):
        raise ValueError(f"{path} has {there} buckets, not {buckets}")
    tagged = df.withColumn("id_bucket", bucket_name(F.col("ID"), buckets))
    keys = [c for c in order if c in df.columns]
    writer = tagged.repartition("id_bucket", *by).sortWithinPartitions("id_bucket", *by, *keys).write
    writer.mode("overwrite").option("partitionOverwriteMode", "static" if whole else "dynamic").partitionBy("id_bucket", *by).parquet(path)
    note_buckets(spark, path, buckets)


def done_years(spark: SparkSession, path: str) -> set[int]:
    """Years that a build has finished."""
    p, fs = filesystem(spark, f"{path}/_done")
    return {int(s.getPath().getName()) for s in fs.listStatus(p)} if fs.exists(p) else set()


def mark_done(spark: SparkSession, path: str, year: int) -> None:
    """Notes a finished year."""
    p, fs = filesystem(spark, f"{path}/_done/{year}")
    fs.create(p, True).close()


def build_training(spark: SparkSession, base: str, out: str, years: tuple[int, int], td_var: str = "td", tmin_var: str = "tmin_v12", buckets: int = 1024, overwrite: bool = False) -> list[int]:
    """Prepared rows by bucket and year; finished years are left alone unless overwrite. The years that were built."""
    built = []
    finished = set() if overwrite else done_years(spark, out)
    for year in range(years[0], years[1] + 1):
        if year in finished:
            continue
        sides = [read_raw(spark, yearly_files(spark, base, v, (year, year))) for v in (td_var, tmin_var)]
        write_bucketed(prepared(*sides).withColumn("year", F.lit(year)), out, buckets, ("year",), whole=False)
        mark_done(spark, out, year)
        built.append(year)
    return built


def shard_climatology(clim: DataFrame, out: str, buckets: int = 1024) -> None:
    """A climatology by bucket, sorted by location and day."""
    write_bucketed(clim, out, buckets, order=("ID", "doy"))


def shard_future(spark: SparkSession, base: str, out: str, years: tuple[int, int], tmin_var: str = "tmin_v12", buckets: int = 1024) -> None:
    """ID, FECHA, TMIN of the forecast years by bucket and year."""
    import datetime as dt

    raw = read_raw(spark, monthly_files(spark, base, tmin_var, dt.date(years[0], 1, 1), dt.date(years[1], 12, 31)))
    write_bucketed(raw.withColumnRenamed("Value", "TMIN").withColumn("year", F.year("FECHA")), out, buckets, ("year",))


def combine(spark: SparkSession, root: str, out: str, order=("ID", "FECHA")) -> None:
    """A bucketed tree as one sorted dataset."""
    df = spark.read.parquet(root)
    df.drop("id_bucket", "year").orderBy(*[c for c in order if c in df.columns]).write.mode("overwrite").parquet(out)


def write_monthly(monthly: DataFrame, out: str, prefix: str = "td_daily") -> list[str]:
    """One file <prefix>_yyyy_MM.parquet a month from rows with year_month; the files' paths."""
    spark = monthly.sparkSession
    staging = f"{out}/_staging-{uuid.uuid4().hex}"
    monthly.repartition("year_month").sortWithinPartitions("year_month", "ID", "FECHA").write.partitionBy("year_month").parquet(staging)
    p, fs = filesystem(spark, staging)
    made = []
    for folder in fs.listStatus(p):
        name = folder.getPath().getName()
        if not name.startswith("year_month="):
            continue
        parts = [s.getPath() for s in fs.listStatus(folder.getPath()) if s.getPath().getName().endswith(".parquet")]
        for k, part in enumerate(parts):
            target = f"{out}/{prefix}_{name.split('=')[1]}{f'_{k}' if k else ''}.parquet"
            t, _ = filesystem(spark, target)
            fs.delete(t, False)
            fs.rename(part, t)
            made.append(target)
    fs.delete(p, True)
    return sorted(made)


def write_subset(spark: SparkSession, base: str, out: str, n_ids: int, variables, years: tuple[int, int]) -> DataFrame:
    """Copies the rows with ID < n_ids month by month; variable, files, rows of what was written."""
    counts = []
    for variable in variables:
        files = yearly_files(spark, base, variable, years)
        rows = 0
        for f in files:
            part = spark.read.parquet(f).select("ID", "FECHA", "Value").where(F.col("ID") < n_ids)
            target = f"{out}/{variable}/Outputs/{f.rsplit('/', 1)[1]}"
            part.coalesce(1).write.mode("overwrite").parquet(target)
            rows += spark.read.parquet(target).count()
        counts.append((variable, len(files), rows))
    return spark.createDataFrame(counts, "variable string, files int, rows long")


def replace_staged(df: DataFrame, path: str, buckets: int | None = None, order=("ID", "doy")) -> None:
    """Writes df beside path and swaps the two, so that df may read path; buckets: df is written as a bucketed tree.

    The old table is moved aside before the new one takes its place and deleted after that: whenever a run ends, one of
    the two is whole, at path or at path.old-*.
    """
    spark = df.sparkSession
    mark = uuid.uuid4().hex
    staging, aside = f"{path.rstrip('/')}.staging-{mark}", f"{path.rstrip('/')}.old-{mark}"
    if buckets:
        write_bucketed(df, staging, buckets, order=order)
    else:
        df.write.parquet(staging)
    target, fs = filesystem(spark, path)
    old, source = filesystem(spark, aside)[0], filesystem(spark, staging)[0]
    if fs.exists(target) and not fs.rename(target, old):
        raise OSError(f"{path} can't be moved aside")
    if not fs.rename(source, target):
        raise OSError(f"{staging} can't be moved to {path}")
    fs.delete(old, True)


def missing_buckets(spark: SparkSession, done_root: str, wanted: DataFrame) -> DataFrame:
    """Wanted buckets (id_bucket) that a tree doesn't hold yet."""
    if not exists(spark, done_root):
        return wanted
    done = spark.read.parquet(done_root).select(F.col("id_bucket").cast("int").alias("id_bucket")).distinct()
    return wanted.join(done, "id_bucket", "left_anti")


def append_csv(path: str, rows: list[dict], columns: list[str]) -> None:
    """Appends measurements to a CSV file on the driver; the first call writes the header."""
    import csv
    import os

    fresh = not os.path.exists(path) or os.path.getsize(path) == 0
    with open(path, "a", newline="") as f:
        out = csv.DictWriter(f, columns, extrasaction="ignore")
        if fresh:
            out.writeheader()
        out.writerows(rows)


def write_manifest(manifest: DataFrame, path: str) -> None:
    """A recipe table, checked, as one Parquet dataset sorted by zone and day."""
    checked_manifest(manifest).orderBy("zone_id", "doy").write.mode("overwrite").parquet(path)


def markdown(df: DataFrame, title: str, limit: int = 1000) -> str:
    """A small table as Markdown: a report of up to limit rows."""
    rows = df.limit(limit).collect()
    show = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v)
    return "\n".join([f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *["| " + " | ".join(show(v) for v in r) + " |" for r in rows], ""])


def histogram(df: DataFrame, column: str, low: float, high: float, bins: int) -> DataFrame:
    """bin, n: the data behind a histogram (0 and bins + 1 hold what lies outside)."""
    return df.groupBy(F.width_bucket(F.col(column), F.lit(low), F.lit(high), F.lit(bins)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
