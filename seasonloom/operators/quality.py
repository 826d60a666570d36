"""Completeness of coefficient tables, and repair by patching."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seasonloom.config import DOYS, doy_list
from seasonloom.operators.series import deduplicated


def completeness(coefficients: DataFrame, expected: int, span: tuple[int, int] = (1, DOYS), include_missing: bool = True, strict: bool = True) -> DataFrame:
    """doy, n_ids, expected, missing, incomplete for each day of year in span: distinct locations against those expected.

    strict: any other number is incomplete, else only a smaller one. include_missing: days without a row count too.
    """
    if expected <= 0:
        raise ValueError("expected must be positive")
    doy_list(span)
    rows = coefficients.select("ID", F.col("doy").try_cast("int").alias("doy")).where(F.col("doy").between(*span) & F.col("ID").isNotNull())
    counts = rows.groupBy("doy").agg(F.countDistinct("ID").alias("n_ids"))
    days = coefficients.sparkSession.range(span[0], span[1] + 1).select(F.col("id").cast("int").alias("doy"))
    found = days.join(counts, "doy", "left").withColumn("missing", F.col("n_ids").isNull()).withColumn("n_ids", F.coalesce("n_ids", F.lit(0)))
    wrong = F.col("n_ids") != expected if strict else F.col("n_ids") < expected
    return found.select("doy", "n_ids", F.lit(expected).cast("long").alias("expected"), "missing", F.when(F.col("missing"), F.lit(include_missing)).otherwise(wrong).alias("incomplete"))


def incomplete_doys(coefficients: DataFrame, expected: int, **options) -> list[int]:
    """The incomplete days of year."""
    return sorted(r["doy"] for r in completeness(coefficients, expected, **options).where("incomplete").select("doy").collect())  # 366 at most


def row_counts(models: DataFrame, expected: int) -> DataFrame:
    """doy, rows, status (missing, wrong_count or ok) of models kept by day of year."""
    days = models.sparkSession.range(1, DOYS + 1).select(F.col("id").cast("int").alias("doy"))
    counts = models.groupBy(F.col("doy").cast("int").alias("doy")).agg(F.count(F.lit(1)).alias("rows"))
    status = F.when(F.col("rows").isNull(), "missing").when(F.col("rows") != expected, "wrong_count").otherwise("ok")
    return days.join(counts, "doy", "left").select("doy", F.coalesce("rows", F.lit(0)).alias("rows"), status.alias("status"))


def expected_count(ids: DataFrame, id_col: str = "ID") -> DataFrame:
    """expected: distinct locations of a grid."""
    return ids.agg(F.countDistinct(id_col).alias("expected"))


def patch(base: DataFrame, patch_: DataFrame, doys) -> DataFrame:
    """base with the rows of the days in doys replaced by those of the patch; of equal (ID, doy) the patch's counts."""
    days = doy_list(doys)
    columns = base.columns
    kept = base.where(~F.col("doy").isin(days)).withColumn("_patch", F.lit(0))
    used = patch_.where(F.col("doy").isin(days)).withColumn("_patch", F.lit(1))
    both = kept.unionByName(used, allowMissingColumns=True)
    rest = [F.col(c).desc_nulls_last() for c in columns if c not in ("ID", "doy")]
    return deduplicated(both, ["ID", "doy"], [F.desc("_patch"), *rest]).select(*columns)


def patch_summary(base: DataFrame, patch_: DataFrame, doys) -> DataFrame:
    """rows_before, rows_removed, rows_loaded, rows_used, rows_out of a patch, in one pass over the tagged union."""
    days = doy_list(doys)
    hit = F.col("doy").isin(days)
    tagged = base.select("ID", "doy", F.lit(0).alias("side")).unionByName(patch_.select("ID", "doy", F.lit(1).alias("side")))
    keys = tagged.groupBy("ID", "doy").agg(*[F.sum((F.col("side") == s).cast("long")).alias(n) for s, n in ((0, "b"), (1, "p"))])
    out = F.when(hit, F.col("p") > 0).otherwise(F.col("b") > 0).cast("long")
    return keys.agg(*[F.coalesce(F.sum(x), F.lit(0)).cast("long").alias(n) for x, n in ((F.col("b"), "rows_before"), (F.when(hit, F.col("b")), "rows_removed"), (F.col("p"), "rows_loaded"), (F.when(hit, F.col("p")), "rows_used"), (out, "rows_out"))])


def bucket_summary(coefficients: DataFrame, failures: DataFrame, buckets: int) -> DataFrame:
    """id_bucket, id_count, coeff_rows, failure_rows, status (ok or empty)."""
    b = F.pmod("ID", F.lit(buckets)).cast("int").alias("id_bucket")
    made = coefficients.groupBy(b).agg(F.countDistinct("ID").alias("id_count"), F.count(F.lit(1)).alias("coeff_rows"))
    failed = failures.groupBy(b).agg(F.count(F.lit(1)).alias("failure_rows"))
    joined = made.join(failed, "id_bucket", "full_outer")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return joined.select("id_bucket", zero("id_count"), zero("coeff_rows"), zero("failure_rows"), F.when(F.coalesce("coeff_rows", F.lit(0)) > 0, "ok").otherwise("empty").alias("status"))
