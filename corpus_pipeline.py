"""A training corpus from ``documents``: toxicity, line quality, near-duplicates, benchmark
leaks, and tokens, in this order.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept; all but
the last return the columns of ``documents``.  Models are learned from ``sf_dir``'s labels and
documents, never from scores.

Defined results: a null or empty text goes at the quality rules; rows with a null id have no copies
and no hits to be dropped by; exact repeats of a row stay or go together; empty tables give no rows;
a text of any length is worked on whole; columns that are named like an operator's own pass through all
stages but the last unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import bpe, decontaminate, minhash, quality_rules, toxicity
from tracewright.llm._work import Work


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go; without any labels there is no model, and all stay."""
    model = toxicity.trained(spark, _documents(spark, sf_dir), sf_dir)
    if model.empty:
        return docs
    plain = docs.select(*[F.col(c).alias(f"_{c}") for c in docs.columns])  # no clash with new columns
    scored = toxicity.score(plain, model, text_col="_text").where("predicted = 0")
    return scored.select(*[F.col(f"_{c}").alias(c) for c in docs.columns])


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line rules reject go; the others keep their whole text."""
    plain = docs.select(*[F.col(c).alias(f"_{c}") for c in docs.columns])
    judged = quality_rules.judge(plain, quality_rules.PROSE, text_col="_text").where("kept")
    return judged.select(*[F.col(f"_{c}").alias(c) for c in docs.columns])


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates the document with the least id stays."""
    gone = minhash.near_duplicates(docs).where("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Count and digests of the ids of each remaining text, and of what they decode to."""
    return bpe.digests(docs.select("doc_id", "text"))


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", keep_quality),
    ("near-duplicates", one_of_each_group),
    ("benchmark decontamination", without_benchmark),
    ("BPE", tokens),
]

#: SQL cannot express the learned weights of the first stage.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written to the shared folder and read again."""
    work = Work(spark, "pipeline")
    docs = _documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = work.table(docs, name.replace(" ", "-"))
    return docs
