"""Incremental day sums from a stream of raw rows (an extension; batch results are the same).

Rows of a feature frame arrive in any order; their sums by (location, day of year) add up, so a running aggregation in
complete or update mode holds at any time what the fit of all rows so far needs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from seasonloom.operators.gram import day_sums


def streaming_day_sums(frames: DataFrame, names) -> DataFrame:
    """Running day sums of a streaming feature frame (ID, doy, target, features)."""
    return day_sums(frames, names)


def start(frames: DataFrame, names, out: str, checkpoint: str):
    """Writes each batch's changed sums to out as Parquet (the last row of a key counts); the running query."""

    def save(batch: DataFrame, number: int) -> None:
        batch.selectExpr("*", f"{number}L as batch").write.mode("overwrite").parquet(f"{out}/batch={number}")

    return streaming_day_sums(frames, names).writeStream.outputMode("update").foreachBatch(save).option("checkpointLocation", checkpoint).start()
