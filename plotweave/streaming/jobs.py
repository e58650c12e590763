"""Incremental paths as Structured Streaming jobs: arriving pages, a growing correction log, learned adjustments.

State that outlives a batch is a Parquet log with one folder per batch. A batch that is run again
overwrites its own folder, so results do not depend on how often it was tried.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from plotweave.sources import store

C = F.col


def file_stream(spark: SparkSession, folder: str, name: str = "*.parquet", files_per_batch: int | None = None) -> DataFrame:
    """Stream over the Parquet files of a folder, with the schema of what is there."""
    schema = spark.read.option("pathGlobFilter", name).parquet(folder).schema
    r = spark.readStream.schema(schema).option("pathGlobFilter", name)
    if files_per_batch:
        r = r.option("maxFilesPerTrigger", files_per_batch)
    return r.parquet(folder)


def timed(stream: DataFrame, delay: str) -> DataFrame:
    """Event time for the watermark; times without a zone are read in the session's zone."""
    return stream.withColumn("created_at", C("created_at").cast("timestamp")).withWatermark("created_at", delay)


def ingest_pages(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Pages replace their former version as they arrive; other pages of the plan stay."""
    def put(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            store.upsert_elements(batch, path, by=["layout_id", "page"])

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def dedupe_corrections(stream: DataFrame, path: str, checkpoint: str, delay: str = "1 day") -> StreamingQuery:
    """Correction log without repeated entries, however late within ``delay`` they are repeated."""
    d = timed(stream, delay).dropDuplicatesWithinWatermark(["corr_id"])
    return d.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def correction_counts(stream: DataFrame, path: str, checkpoint: str, width: str = "1 day", slide: str | None = None, delay: str = "1 day") -> StreamingQuery:
    """Corrections per plan, column and time window. Changed windows are logged per batch."""
    win = F.window("created_at", width, slide) if slide else F.window("created_at", width)
    g = timed(stream, delay).groupBy(win.alias("w"), "layout_id", "column_name").agg(
        F.count(F.lit(1)).alias("corrections"), F.max("created_at").alias("last_correction"))

    def put(batch: DataFrame, no: int) -> None:
        out = batch.select(C("w.start").alias("window_start"), C("w.end").alias("window_end"), "layout_id", "column_name", "corrections", "last_correction")
        out.write.mode("overwrite").parquet(f"{path}/batch={no}")

    return g.writeStream.foreachBatch(put).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """Last logged state of every window."""
    key = ["window_start", "window_end", "layout_id", "column_name"]
    last = spark.read.parquet(path).groupBy(*key).agg(F.max_by(F.struct("corrections", "last_correction"), "batch").alias("m"))
    return last.select(*key, "m.corrections", "m.last_correction")


SUMS = ["offset_x", "offset_y", "width_delta", "height_delta"]


#: Suggestions whose counts one row of a batch is spread to before they are listed.
SPAN = 10_000


def passed_counts(both: DataFrame) -> DataFrame:
    """``cls, at_count``: the third and every fifth count in ``(was, n]``, as stretches that tasks list apart."""
    first, last = F.floor(C("was") / 5), F.floor(C("n") / 5)
    fifths = both.filter(last > first).select("cls", (first + 1).alias("a"), last.alias("b"))
    starts = fifths.select("cls", "b", F.explode(F.sequence("a", "b", F.lit(SPAN).cast("long"))).alias("a"))
    spread = starts.repartition("cls", "a")
    listed = spread.select("cls", F.explode(F.sequence("a", F.least(C("a") + SPAN - 1, "b"))).alias("k"))
    fives = listed.select("cls", (C("k") * 5).alias("at_count"))
    return fives.unionByName(both.filter((C("was") < 3) & (C("n") >= 3)).select("cls", F.lit(3).cast("long").alias("at_count")))


def learn_adjustments(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Running sums per class, and a suggestion at the third and at every fifth adjustment.

    A batch is summed before it meets the stored state, and the counts it passes are derived from the
    count before and after, so no class is handled row by row. Every batch stores the state of all classes, and
    the next one reads that folder alone.
    """
    def put(batch: DataFrame, no: int) -> None:
        spark = batch.sparkSession
        new = batch.groupBy("cls").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).cast("long").alias(c) for c in SUMS])
        both = new.withColumn("was", F.lit(0).cast("long"))
        if no > 0:
            old = spark.read.schema("cls string, n long, " + ", ".join(f"{c} long" for c in SUMS)).parquet(f"{path}/state/batch={no - 1}")
            both = both.unionByName(old.withColumn("was", C("n"))).groupBy("cls").agg(*[F.sum(c).alias(c) for c in ("n", *SUMS, "was")])
        both = both.select("cls", "n", *SUMS, "was")
        both.drop("was").write.mode("overwrite").parquet(f"{path}/state/batch={no}")
        passed_counts(both).write.mode("overwrite").parquet(f"{path}/suggestions/batch={no}")

    return stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_adjustments(spark: SparkSession, path: str) -> DataFrame:
    """Learned adjustment per class from the last stored state."""
    last = spark.read.parquet(f"{path}/state").groupBy("cls").agg(F.max_by(F.struct("n", *SUMS), "batch").alias("m"))
    n = C("m.n")
    return last.select("cls", n.alias("n"), *[(C(f"m.{c}") / n).cast("int").alias(c) for c in SUMS], F.least(F.lit(0.95), n / 10.0).alias("confidence"), (n >= 3).alias("usable"))
