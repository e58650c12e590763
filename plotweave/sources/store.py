"""Parquet tables of a plan store: elements, layouts, logs, metrics, symbols, track pixels.

Rows of a table are only ever added, with the time of their write. A replaced plan gets its new rows
first and then a marker with the same time: readers show exactly the rows of the plan's last marker,
so the marker is the commit, and rows of a failed write are never seen. A single page has a marker of its
own, so a page that arrives writes its rows and nothing else. Deleting adds a marker without rows.
``compact`` writes the live rows to a fresh folder.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

from plotweave.session import cut

C = F.col
ROWS_PER_FILE = 1_000_000
REPLACED = ["elements", "validation_log", "track_pixels"]
APPENDED = ["quality_metrics", "manual_corrections"]
TABLES = [*REPLACED, *APPENDED]


def _now() -> Column:
    """Time of one write, the same for its rows and its marker."""
    return F.timestamp_micros(F.lit(time.time_ns() // 1000))


def _at(path: str, table: str) -> str:
    return f"{path.rstrip('/')}/{table}"


def _read(spark: SparkSession, path: str, table: str) -> DataFrame | None:
    try:
        return spark.read.option("mergeSchema", "true").parquet(_at(path, table))
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


def spread(df: DataFrame) -> DataFrame:
    """Few files per plan, but no task gets more than a stretch of a large plan's rows."""
    if "row_id" not in df.columns:
        return df.repartition("layout_id")
    return df.repartition("layout_id", F.floor(C("row_id") / ROWS_PER_FILE))


def _append(df: DataFrame, path: str, table: str, stamp: Column | None = None, parts: bool = True) -> None:
    d = df.withColumn("stored_at", _now() if stamp is None else stamp)
    w = (spread(d) if parts else d).write.mode("append")
    (w.partitionBy("layout_id") if parts else w).parquet(_at(path, table))


def _mark(spark: SparkSession, touched: DataFrame | None, path: str, tables: list[str], stamp: Column, pages: bool = False) -> None:
    """Markers of the plans, or with ``pages`` of the single pages, in ``touched``; ``None`` stands for all plans."""
    names = F.explode(F.array(*[F.lit(t) for t in tables]))
    ids = spark.range(1).select(F.lit(None).cast("long").alias("layout_id")) if touched is None else touched
    page = C("page").cast("int") if pages else F.lit(None).cast("int")
    ids = ids.select(C("layout_id").cast("long").alias("layout_id"), page.alias("page"), F.lit(not pages).alias("whole")).distinct()
    ids.select("layout_id", "page", "whole", names.alias("tbl"), stamp.alias("stored_at")).write.mode("append").parquet(_at(path, "markers"))


def _replace(df: DataFrame, path: str, table: str, pages: bool = False) -> DataFrame:
    """New rows for every plan (or page) in ``df``; visible once their marker is written.

    Gives what was touched. Its ids are taken from ``df`` before the write, so no stored file is read again.
    """
    stamp = _now()
    touched = cut(df.select("layout_id", *["page"] * pages).distinct())
    _append(df, path, table, stamp)
    _mark(df.sparkSession, touched, path, [table], stamp, pages)
    return touched


def read_table(spark: SparkSession, path: str, table: str, layout: int | None = None) -> DataFrame | None:
    """Live rows of a table; a plan filter reaches the folder list."""
    d = _read(spark, path, table)
    if d is None:
        return None
    d = d.withColumn("layout_id", C("layout_id").cast("long"))
    if layout is not None:
        d = d.filter(C("layout_id") == layout)
    m = _read(spark, path, "markers")
    if m is None:
        return d.limit(0) if table in REPLACED else d
    m = m.filter(C("tbl") == table)
    for c, t in (("page", "int"), ("whole", "boolean")):  # stores from before there were pages
        m = m if c in m.columns else m.withColumn(c, F.lit(None).cast(t))
    whole = F.coalesce("whole", F.lit(True))
    own = m.filter(whole & C("layout_id").isNotNull()).groupBy("layout_id").agg(F.max("stored_at").alias("_own"))
    every = m.filter(C("layout_id").isNull() & whole).agg(F.max(F.unix_micros("stored_at")).alias("t")).first()["t"]
    if table not in REPLACED:
        d = d.join(own, "layout_id", "left").filter(C("_own").isNull() | (C("stored_at") > C("_own"))).drop("_own")
    elif "page" not in d.columns:
        d = d.join(own, "layout_id").filter(C("stored_at") == C("_own")).drop("_own")
    else:
        # the later of the plan's and the page's marker decides; -1 stands for a missing page
        of_page = F.coalesce(C("page").cast("int"), F.lit(-1)).alias("_page")
        paged = m.filter(~whole).groupBy("layout_id", of_page).agg(F.max("stored_at").alias("_mine"))
        d = d.withColumn("_page", of_page).join(own, "layout_id", "left").join(paged, ["layout_id", "_page"], "left")
        d = d.filter(C("stored_at") == F.greatest("_own", "_mine")).drop("_own", "_mine", "_page")
    return d if every is None else d.filter(F.unix_micros("stored_at") > every)


# --- elements ----------------------------------------------------------------------------------
def read_elements(spark: SparkSession, path: str, layout: int | None = None) -> DataFrame | None:
    d = read_table(spark, path, "elements", layout)
    return None if d is None else d.drop("stored_at")


def elements_from_json(df: DataFrame, column: str, schema: T.StructType | str) -> DataFrame:
    """Rows of plans whose records are stored as one JSON list per plan."""
    item = schema if isinstance(schema, str) else schema.simpleString()
    return df.select(*[c for c in df.columns if c != column], F.inline(F.from_json(column, f"array<{item}>")))


def upsert_elements(df: DataFrame, path: str, by: list[str] = ("layout_id",)) -> None:
    """Replace the rows of every plan in ``df``. With ``by=[layout_id, page]`` other pages stay, and are not written again."""
    touched = _replace(df, path, "elements", "page" in by)
    layouts = touched.select("layout_id").distinct().withColumn("last_modified", F.current_timestamp())
    layouts.write.mode("append").parquet(_at(path, "layouts"))


def delete_layout(spark: SparkSession, path: str, layouts: DataFrame | None) -> None:
    """Delete plans with everything that belongs to them; ``None`` empties all tables."""
    _mark(spark, layouts, path, TABLES, _now())


def compact(spark: SparkSession, path: str, target: str) -> None:
    """Write the live rows of all tables to a new store."""
    for t in TABLES:
        d = read_table(spark, path, t)
        if d is not None:
            (_replace if t in REPLACED else _append)(d.drop("stored_at"), target, t)
    plans = _read(spark, path, "layouts")
    live = read_table(spark, path, "elements")
    if plans is not None and live is not None:
        plans.join(live.select("layout_id").distinct(), "layout_id", "left_semi").write.mode("append").parquet(_at(target, "layouts"))
    s = read_symbols(spark, path)
    if s is not None:
        upsert_symbols(s, target)


# --- logs --------------------------------------------------------------------------------------
def write_validation_log(issues: DataFrame, path: str) -> None:
    """Replace the validation log of the plans in ``issues``; the type is the text before the first colon."""
    m = C("message")
    kind = F.when(m.contains(":"), F.substring_index(m, ":", 1)).otherwise("general")
    d = issues.select("layout_id", "row_id", kind.alias("validation_type"), F.upper("severity").alias("severity"), "message",
                      F.to_json(F.struct(*[c for c in issues.columns if c not in ("layout_id", "row_id", "message", "severity")])).alias("details"),
                      F.current_timestamp().alias("created_at"))
    _replace(d, path, "validation_log")


def append_metrics(metrics: DataFrame, path: str) -> None:
    """Long metric rows ``layout_id, metric_name, metric_value[, metric_data]``."""
    d = metrics if "metric_data" in metrics.columns else metrics.withColumn("metric_data", F.lit(None).cast("string"))
    _append(d.select("layout_id", "metric_name", C("metric_value").cast("double"), "metric_data", F.current_timestamp().alias("computed_at")), path, "quality_metrics")


def append_wide_metrics(metrics: DataFrame, path: str) -> None:
    """One row per plan with a column per metric, stored as long rows."""
    values = [c for c in metrics.columns if c != "layout_id"]
    d = metrics.select("layout_id", *[C(c).cast("double").alias(c) for c in values]).unpivot("layout_id", values, "metric_name", "metric_value")
    append_metrics(d, path)


def append_corrections(df: DataFrame, path: str) -> None:
    """Correction-log rows; values are stored as text."""
    def opt(name: str, default: str | None) -> Column:
        return C(name).cast("string") if name in df.columns else F.lit(default).cast("string")

    at = C("created_at") if "created_at" in df.columns else F.current_timestamp()
    _append(df.select("layout_id", "row_id", "column_name", opt("old_value", None).alias("old_value"), opt("new_value", None).alias("new_value"),
                      opt("correction_type", "manual_edit").alias("correction_type"), opt("corrected_by", "user").alias("corrected_by"),
                      opt("correction_reason", None).alias("correction_reason"), at.alias("created_at")), path, "manual_corrections")


# --- symbols -----------------------------------------------------------------------------------
def upsert_symbols(df: DataFrame, path: str) -> None:
    _append(df.withColumn("deleted", F.lit(False)), path, "custom_symbols", parts=False)


def delete_symbols(names: DataFrame, path: str) -> None:
    _append(names.select("name").withColumn("deleted", F.lit(True)), path, "custom_symbols", parts=False)


def read_symbols(spark: SparkSession, path: str, name: str | None = None) -> DataFrame | None:
    """Latest definition per name."""
    d = _read(spark, path, "custom_symbols")
    if d is None:
        return None
    d = d if name is None else d.filter(C("name") == name)
    cols = [c for c in d.columns if c not in ("name", "stored_at", "deleted")]
    last = d.groupBy("name").agg(F.max_by(F.struct("deleted", *cols), "stored_at").alias("m"))
    return last.filter(~C("m.deleted")).select("name", *[C(f"m.{c}").alias(c) for c in cols])


# --- track pixels ------------------------------------------------------------------------------
def write_track_pixels(pixels: DataFrame, path: str) -> None:
    """Replace the pixels of the plans in ``pixels``; sorted lines compress well."""
    stamp = _now()
    d = pixels.select("layout_id", "page", "y", "x").distinct().withColumn("stored_at", stamp)
    d = d.repartition("layout_id", "page", F.floor(C("y") / 1024)).sortWithinPartitions("layout_id", "page", "y", "x")
    d.write.mode("append").partitionBy("layout_id").parquet(_at(path, "track_pixels"))
    _mark(pixels.sparkSession, pixels, path, ["track_pixels"], stamp)


def read_track_pixels(spark: SparkSession, path: str, layout: int | None = None) -> DataFrame | None:
    d = read_table(spark, path, "track_pixels", layout)
    return None if d is None else d.select("layout_id", "page", "y", "x")


# --- overview ----------------------------------------------------------------------------------
def store_stats(spark: SparkSession, path: str) -> DataFrame:
    """Live rows per table."""
    out = spark.createDataFrame([], "tbl STRING, n LONG")
    for t in TABLES:
        d = read_table(spark, path, t)
        if d is not None:
            out = out.unionByName(d.agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("tbl"), "n"))
    return out


def layout_sizes(df: DataFrame) -> DataFrame:
    """Rows and bytes of JSON per plan."""
    return df.groupBy("layout_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length(F.to_json(F.struct(*df.columns)))).alias("bytes"))


def list_workspaces(spark: SparkSession, path: str) -> DataFrame:
    """Stored plans, newest first, with number of rows and whether they have track pixels and page sizes."""
    last = spark.read.parquet(_at(path, "layouts")).groupBy("layout_id").agg(F.max("last_modified").alias("last_modified"))
    el = read_table(spark, path, "elements").groupBy("layout_id").agg(F.count(F.lit(1)).alias("n_rows"))
    out = last.join(el, "layout_id")
    for name, flag in (("track_pixels", "has_skeleton"), ("page_dims", "has_dims")):
        d = read_table(spark, path, name)
        if d is None:
            out = out.withColumn(flag, F.lit(False))
        else:
            out = out.join(d.select("layout_id").distinct().withColumn(flag, F.lit(True)), "layout_id", "left").withColumn(flag, F.coalesce(flag, F.lit(False)))
    return out.orderBy(F.desc("last_modified"), "layout_id")
