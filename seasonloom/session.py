"""Session helper with the settings that the plans are designed for."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: Python workers solve many small systems side by side: one thread each, or every worker would start as many as there are cores.
THREADS = {name: "1" for name in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "MKL_NUM_THREADS")}
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
    **{f"spark.executorEnv.{name}": value for name, value in THREADS.items()},
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None, **extra: str) -> SparkSession:
    """A session in UTC with adaptive execution; extra holds further settings by name.

    master and shuffle_partitions stay as spark-submit and the cluster have them unless they are given: adaptive
    execution joins small partitions, but can't make more of them than there are.
    """
    for name, value in THREADS.items():
        os.environ.setdefault(name, value)  # workers of a local session have the driver's environment
    builder = SparkSession.builder
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
