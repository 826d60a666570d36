"""The model's inputs, stood in for by the order tables: location is the supplier, day the ship date, TD and TMIN the
mean price and quantity of the day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ID, FECHA, TD, TMIN, doy."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("ID"), F.to_date("l_shipdate").alias("FECHA")).agg(F.avg("l_extendedprice").alias("TD"), F.avg("l_quantity").alias("TMIN"))
    return rows.withColumn("doy", F.dayofyear("FECHA"))


def raw(spark: SparkSession, sf_dir: str, column: str, where: str = "true") -> DataFrame:
    """ID, FECHA, Value of one variable."""
    return table(spark, sf_dir, "lineitem").where(where).groupBy(F.col("l_suppkey").alias("ID"), F.to_date("l_shipdate").alias("FECHA")).agg(F.avg(column).alias("Value"))


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ID, zone_id, zone_label: a supplier's nation."""
    names = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("zone_id"), F.col("n_name").alias("zone_label"))
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("ID"), F.col("s_nationkey").cast("int").alias("zone_id")).join(names, "zone_id").select("ID", "zone_id", "zone_label")


DAILY_SQL = """daily AS (SELECT l_suppkey AS "ID", CAST(l_shipdate AS DATE) AS "FECHA", avg(l_extendedprice) AS "TD", avg(l_quantity) AS "TMIN" FROM lineitem GROUP BY 1, 2),
series AS (SELECT *, CAST(dayofyear("FECHA") AS INTEGER) AS doy FROM daily)"""


def raw_sql(column: str, where: str = "true") -> str:
    """raw() in SQL."""
    return f"""SELECT l_suppkey AS "ID", CAST(l_shipdate AS DATE) AS "FECHA", avg({column}) AS "Value" FROM lineitem WHERE {where} GROUP BY 1, 2"""
