"""Small helpers shared by the text operators."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plotweave.session import scratch

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pd.DataFrame], column: str, chars: int = 4_000_000) -> Iterator[pd.DataFrame]:
    """Batches cut into runs of rows whose texts have about ``chars`` characters, to bound what a task holds."""
    for pdf in batches:
        size = pdf[column].str.len().fillna(0).astype("int64").cumsum() // chars
        for _, part in pdf.groupby(size, sort=False):
            yield part


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id`` and ``text`` with null texts as empty ones; further columns on demand."""
    return docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def drawn(df: DataFrame, n: int, most: int, *key: str) -> DataFrame:
    """About ``most`` of the ``n`` rows, chosen by a hash of ``key``; all if there are fewer."""
    if n <= most:
        return df
    return df.filter(F.pmod(F.xxhash64(*key, F.lit(7)), F.lit(1 << 30)) < int(most / n * (1 << 30)))


def cut(df: DataFrame) -> DataFrame:
    """Rows of ``df`` as a table in the shared folder. The shuffle files behind it go as soon as it is written."""
    spark = df.sparkSession
    path, was = scratch(spark, "step"), spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, was)
    return spark.read.schema(df.schema).parquet(path)
