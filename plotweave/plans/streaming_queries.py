"""Streaming jobs run to the end of the given files; results equal the batch question."""

from __future__ import annotations

from pyspark.sql import functions as F

from plotweave.plans.fixtures import VIEWS
from plotweave.plans.registry import query
from plotweave.session import scratch
from plotweave.sources import store as S
from plotweave.streaming import jobs as J

C = F.col


def view_of(stream, name: str, source: str):
    """A fixture view over a stream of its source table."""
    sql = VIEWS[name][1].replace(f"FROM {source}", "FROM {src}")
    return stream.sparkSession.sql(sql, src=stream)


@query("st1_ingest_pages", sql="SELECT layout_id, page, count(*) AS n, sum(row_id) AS ids FROM det GROUP BY ALL")
def st1(t):
    p = scratch(t.spark, "stream")
    d = view_of(J.file_stream(t.spark, t.sf_dir, "orders.parquet"), "det", "orders")
    J.ingest_pages(d.select("layout_id", "page", "row_id", "cls", "conf"), f"{p}/store", f"{p}/ckpt").awaitTermination()
    return S.read_elements(t.spark, f"{p}/store").groupBy("layout_id", "page").agg(F.count(F.lit(1)).alias("n"), F.sum("row_id").alias("ids"))


@query("st2_correction_counts", "corr", sql="SELECT date_trunc('hour', created_at) AS window_start, layout_id, column_name, count(*) AS corrections, max(created_at) AS last_correction FROM corr GROUP BY ALL")
def st2(t):
    p = scratch(t.spark, "stream")
    d = view_of(J.file_stream(t.spark, t.sf_dir, "events.parquet"), "corr", "events")
    J.correction_counts(d, f"{p}/counts", f"{p}/ckpt", width="1 hour").awaitTermination()
    d = J.read_counts(t.spark, f"{p}/counts").drop("window_end")
    return d.withColumns({c: C(c).cast("timestamp_ntz") for c in ("window_start", "last_correction")})


@query("st2_dedupe_corrections", "corr", sql="SELECT corr_id, layout_id, row_id, column_name FROM corr")
def st2b(t):
    p = scratch(t.spark, "stream")
    d = view_of(J.file_stream(t.spark, t.sf_dir, "events.parquet"), "corr", "events")
    J.dedupe_corrections(d.unionAll(d), f"{p}/log", f"{p}/ckpt").awaitTermination()
    return t.spark.read.parquet(f"{p}/log").select("corr_id", "layout_id", "row_id", "column_name")


@query("st3_learn_adjustments", "adjust", sql="SELECT cls, count(*) AS n, CAST(trunc(avg(offset_x)) AS INT) AS offset_x, CAST(trunc(avg(offset_y)) AS INT) AS offset_y, CAST(trunc(avg(width_delta)) AS INT) AS width_delta, CAST(trunc(avg(height_delta)) AS INT) AS height_delta, least(0.95, count(*) / 10.0) AS confidence, count(*) >= 3 AS usable FROM adjust GROUP BY cls")
def st3(t):
    p = scratch(t.spark, "stream")
    d = view_of(J.file_stream(t.spark, t.sf_dir, "events.parquet"), "adjust", "events")
    J.learn_adjustments(d, f"{p}/learn", f"{p}/ckpt").awaitTermination()
    return J.read_adjustments(t.spark, f"{p}/learn")


@query("st3_suggestions", "adjust", sql="SELECT cls, k AS at_count FROM (SELECT cls, row_number() OVER (PARTITION BY cls ORDER BY adjust_id) AS k FROM adjust) WHERE k = 3 OR (k > 3 AND k % 5 = 0)")
def st3b(t):
    p = scratch(t.spark, "stream")
    d = view_of(J.file_stream(t.spark, t.sf_dir, "events.parquet"), "adjust", "events")
    J.learn_adjustments(d, f"{p}/learn", f"{p}/ckpt").awaitTermination()
    return t.spark.read.parquet(f"{p}/learn/suggestions").select("cls", "at_count")
