"""Helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import contextvars
import os
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The words of all operators: maximal runs of characters other than these.
SPACE = r"\x20\x09-\x0D"


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share.

    Where it is unset, a local session (tests) gets a folder of its own; on a cluster that is an error, as executors
    would each write to a disk that no other sees.
    """
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not where:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="seasonloom-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


#: Tables that stored() has written and nobody has deleted yet, by run.
WRITTEN: dict[str, list[str]] = {}
_RUN = contextvars.ContextVar("run", default="")


@contextlib.contextmanager
def run(name: str):
    """Tables that are stored inside belong to the run of this name: release() of another run leaves them alone."""
    token = _RUN.set(name)
    try:
        yield
    finally:
        _RUN.reset(token)


def stored(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet to the shared folder and read back: its lineage ends there, and lost executors cost nothing.

    The table stays until forget() or release() deletes it, as results that are read later depend on it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    WRITTEN.setdefault(_RUN.get(), []).append(path)
    back = spark.read.schema(df.schema).parquet(path)
    back.stored_path = path
    return back


def _delete(spark: SparkSession, paths: list[str]) -> None:
    for where in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession, name: str = "") -> None:
    """Deletes the tables that a run has stored; for callers whose results are written elsewhere by now."""
    _delete(spark, WRITTEN.pop(name, []))


def forget(*tables: DataFrame) -> None:
    """Deletes these stored tables; nothing may read them any more."""
    for df in tables:
        _delete(df.sparkSession, [df.stored_path])
        for paths in WRITTEN.values():
            if df.stored_path in paths:
                paths.remove(df.stored_path)


def doc_hash(c: Column, modulus: int) -> Column:
    """crc32 of an id as text, modulo: the folds of the learned operators."""
    return F.crc32(c.cast("string").cast("binary")) % modulus


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def worker_cache(owner: str) -> dict:
    """A dictionary that lives as long as the Python worker: models are built once for many tasks.

    It is that of one operator: workers outlive stages, so what another has left is dropped, and its memory given back.
    """
    import sys
    import types

    kept = sys.modules.setdefault("_seasonloom_worker", types.ModuleType("_seasonloom_worker")).__dict__.setdefault("models", {})
    if any(name != owner for name in kept):
        kept.clear()
        give_back()
    return kept.setdefault(owner, {})


def give_back() -> None:
    """Returns a Python worker's free memory to the system: what is freed otherwise stays with the allocators."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # other C libraries than glibc
        ctypes.CDLL(None).malloc_trim(0)


def read_file(path: str) -> bytes:
    """A local vocabulary file, read on the driver."""
    with open(os.fspath(path), "rb") as f:
        return f.read()


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, teaches: Column | None = None) -> DataFrame:
    """doc_id, text, label of at most most labelled documents, chosen by a hash of doc_id; one row for each doc_id.

    The chosen label rows (no more than most, two numbers each) are broadcast, so that other texts needn't be shuffled. Of
    contradicting labels of one document the larger counts, of repeated documents the smallest text; null texts are empty.
    teaches: which label rows may teach.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    if teaches is not None:
        usable = usable.where(teaches)
    chosen = usable.groupBy("doc_id").agg(F.max(label).cast("int").alias("label")).orderBy(F.xxhash64("doc_id", F.lit("sample")), "doc_id").limit(most)
    found = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("label").alias("label"))


def fitted(sample: DataFrame, fit) -> bytes:
    """What fit(list of (doc_id, text, label)) returns, as bytes, run in one task on a bounded sample in doc_id order.

    The scan and the choice of the sample run in as many tasks as there are; only the sample comes to the one that fits.
    """
    import pandas as pd

    def work(frames):
        rows = [r for f in frames for r in zip(f["doc_id"], f["text"], f["label"])]
        rows.sort(key=lambda r: (r[0], r[1]))
        yield pd.DataFrame({"model": [fit(rows)]})

    found = sample.select("doc_id", "text", "label").repartition(1).mapInPandas(work, "model binary").first()
    return bytes(found["model"]) if found else fit([])  # a plan without rows may have no task


#: Bits for each id in a filter of ids, and the most ids that one is made for (16 MB of bits).
FILTER_BITS, FILTER_IDS = 16, 1 << 23


def maybe_among(df: DataFrame, ids: DataFrame, id_col: str, most: int = FILTER_IDS) -> DataFrame:
    """df with maybe: false for rows whose id_col is surely not among ids (one column, no nulls), so that they needn't
    be shuffled to find out. A bitmap of id hashes is broadcast if there are at most most ids; beyond, all rows may be."""
    (name,) = ids.columns
    n = ids.count()
    if n > most:
        return df.withColumn("maybe", F.col(id_col).isNotNull())
    words = max(1, n * FILTER_BITS // 64)
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(64 * words))
    bits = ids.select(place(F.col(name)).alias("p")).groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 as int))")).alias("bits"))
    found = df.withColumn("_place", place(F.col(id_col))).withColumn("_word", F.shiftright("_place", 6)).join(F.broadcast(bits.toDF("_word", "_bits")), "_word", "left")
    maybe = F.coalesce((F.expr("shiftright(_bits, cast(_place % 64 as int)) & 1L") == 1) & F.col(id_col).isNotNull(), F.lit(False))
    return found.select(*df.columns, maybe.alias("maybe"))
