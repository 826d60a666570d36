"""The corpus pipeline: language ID, near-duplicates, secrets, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and read again as the next
stage's docs. All stages but the last return the columns of docs. Rows with a null doc_id pass; null texts are empty
(and so have no language and go). An empty table stays empty through all stages.
"""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seasonloom.llm import bpe, langid, mixing, neardup, secrets
from seasonloom.llm.common import maybe_among, release, shared_dir, stored, table
from seasonloom.llm.common import run as run_of_tables


def own_tables(stage):
    """stage, after the tables that the stage before it has stored are deleted; those of its own belong to the pipeline."""

    @functools.wraps(stage)
    def call(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark, "pipeline")
        with run_of_tables("pipeline"):
            return stage(spark, docs, sf_dir)

    return call


@own_tables
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the learned languages: those without any letter (und) go. Texts are read whole, of any length."""
    model = langid.train(docs.where(~langid.held_out()))
    # numbered names: no column of docs can clash
    plain = docs.toDF(*[f"_c{k}" for k in range(len(docs.columns))])
    text = f"_c{docs.columns.index('text')}"
    found = langid.predict(plain, model, text_col=text, keep=tuple(plain.columns))
    return found.where("lang_pred != 'und'").select(*[F.col(f"_c{k}").alias(c) for k, c in enumerate(docs.columns)])


@own_tables
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component, that with the smallest doc_id; of its rows, if repeated, the smallest.

    Texts stay where they are, whole and of any length, unless their id may be one that goes or is repeated: only those
    rows are shuffled to find out.
    """
    found = stored(neardup.deduplicate(docs.select("doc_id", "text")), "classes-of-documents")
    gone = found.where("not kept and doc_id is not null").select(F.col("doc_id").alias("gone_id")).distinct()
    repeated = found.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("doc_id")
    asked = stored(gone.union(repeated).distinct(), "asked-ids")
    marked = maybe_among(docs, asked, "doc_id")
    stay = marked.where("maybe").drop("maybe").join(gone.hint("merge"), F.col("doc_id") == F.col("gone_id"), "left_anti")
    rest = [c for c in docs.columns if c != "doc_id"]
    stay = stay.groupBy("doc_id").agg(F.min(F.struct(*rest)).alias("row"))
    stay = stay.select(*["doc_id" if c == "doc_id" else F.col(f"row.{c}").alias(c) for c in docs.columns])
    return stay.unionByName(marked.where("not maybe").drop("maybe"))


@own_tables
def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced by its kind."""
    clean = secrets.redacted(docs)
    return clean.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else clean


@own_tables
def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as a mix of their sources takes them."""
    return mixing.mixed_documents(docs)


@own_tables
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids and the digest of the decoded text of every row."""
    import public_tokenizers

    found = bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return found.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("secret_scans", secret_scans), ("source_mixing", source_mixing), ("tokens", tokens)]

#: Models and hashes take part, which SQL can't express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over the table documents, each one's result stored in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = f"{shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
