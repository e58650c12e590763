"""Stages of the corpus pipeline: each works on what the stage before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotweave.llm.common import table
from plotweave.llm.decontaminate import contaminated
from plotweave.llm.packing import pack_documents
from plotweave.llm.simhash import similar_documents
from plotweave.llm.templates import drop_lines
from plotweave.llm.toxicity import score_toxicity
from plotweave.session import scratch, ship


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted to be toxic. Documents that share an id stay or go together."""
    scores = score_toxicity(docs, table(spark, sf_dir, "labels"))
    return _without(docs, scores.filter("predicted = 1"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines of recurring templates; ``n_chars`` follows the text. Those with no text left go."""
    kept = drop_lines(docs)
    changed = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    left = (F.col("n_removed") == 0) | (F.trim("text") != "")
    return kept.filter(left).withColumn("n_chars", changed).select(*docs.columns)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of five-word similarity 0.8 or more. Null ids stay."""
    return _without(docs, similar_documents(docs, 5, 80).filter("component_id <> doc_id"))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item."""
    return _without(docs, contaminated(docs, table(spark, sf_dir, "benchmark")))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed pieces of what the stages before kept."""
    return pack_documents(docs)


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """Null ids are an id like any other: their rows stay or go together."""
    ids = gone.select(F.col("doc_id").alias("_gone_id")).distinct()
    return docs.join(ids, F.col("doc_id").eqNullSafe(F.col("_gone_id")), "left_anti")


STAGES = [
    ("toxicity", toxicity), ("line_dedup", line_dedup), ("simhash_near_dedup", simhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination), ("best_fit_packing", best_fit_packing),
]
# learnt scores, fingerprints and tokens are beyond SQL: tests compare the run with plain versions
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    ship(spark)
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
