"""Corrections: applying, logging, propagating and replaying them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotweave.functions import text as T

C = F.col
ROW = ["layout_id", "row_id"]
FIELDS = ["anchor_text", "coord_text", "fahrtrichtung", "notes"]


def _reparse(df: DataFrame, changed) -> DataFrame:
    """Value and track id follow a new coordinate text."""
    return df.withColumns({
        "coord_value": F.when(changed, T.coord_value(C("coord_text"))).otherwise(C("coord_value")),
        "gi_gl": F.when(changed, T.coord_track(C("coord_text"))).otherwise(C("gi_gl"))})


def wide(fixes: DataFrame, field: str = "field", value: str = "suggested_value", rank: str = "confidence", fields: list[str] = FIELDS) -> DataFrame:
    """One row per element with the winning value per field: highest ``rank``, then the larger value."""
    best = fixes.groupBy(*ROW, field).agg(F.max(F.struct(C(rank).alias("k"), C(value).alias("v"))).alias("m"))
    return best.groupBy(*ROW).agg(*[F.max(F.when(C(field) == f, C("m.v"))).alias("new_" + f) for f in fields])


def apply_corrections(df: DataFrame, issues: DataFrame, fields: list[str] = FIELDS) -> DataFrame:
    """Rows with every safe suggestion applied; changed coordinate texts are parsed again."""
    fixes = issues.filter(C("auto_correctable") & C("suggested_value").isNotNull() & C("field").isin(fields))
    d = df.join(wide(fixes, fields=fields), ROW, "left")
    touched = F.coalesce(C("new_coord_text") != F.coalesce("coord_text", F.lit("")), F.lit(False))
    d = d.withColumn("_touched", touched).withColumns({f: F.coalesce("new_" + f, f) for f in fields})
    return _reparse(d, C("_touched")).drop("_touched", *["new_" + f for f in fields])


def corrections_log(df: DataFrame, issues: DataFrame, fields: list[str] = FIELDS) -> DataFrame:
    """What :func:`apply_corrections` changes: row, column, old and new value."""
    fixes = issues.filter(C("auto_correctable") & C("suggested_value").isNotNull() & C("field").isin(fields))
    d = df.select(*ROW, *fields).join(wide(fixes, fields=fields), ROW)
    items = F.array(*[F.struct(F.lit(f).alias("column_name"), C(f).cast("string").alias("old_value"), C("new_" + f).alias("new_value")) for f in fields])
    return d.select(*ROW, F.inline(items)).filter(C("new_value").isNotNull() & ~C("new_value").eqNullSafe(C("old_value")))


def propagate_coordinates(df: DataFrame, corrections: DataFrame) -> DataFrame:
    """Corrected coordinates (``layout_id, page, old_text, new_text``) reach all rows of the page that show the old text."""
    key = ["layout_id", "page", "_t"]
    c = corrections.select("layout_id", "page", T.strip(C("old_text")).alias("_t"), "new_text").groupBy(*key).agg(F.max("new_text").alias("_new"))
    d = df.withColumn("_t", T.text_or_empty(C("coord_text"))).join(c, key, "left")
    hit = C("_new").isNotNull() & (C("cls") != "coordinate")
    d = d.withColumn("_hit", hit).withColumn("coord_text", F.when(C("_hit"), C("_new")).otherwise(C("coord_text")))
    return _reparse(d, C("_hit")).drop("_t", "_new", "_hit")


def apply_links(df: DataFrame, links: DataFrame) -> DataFrame:
    """Manual links ``(layout_id, row_id, coord_row)``: text, value, track id and box of the coordinate move to the anchor."""
    boxes = [c for c in ("cx1", "cy1", "cx2", "cy2") if c in df.columns]
    copied = ["coord_text", "coord_value", "gi_gl", *boxes]
    c = df.filter((C("cls") == "coordinate") & (F.coalesce("coord_text", F.lit("")) != ""))
    c = links.join(c.select("layout_id", C("row_id").alias("coord_row"), *[C(x).alias("_" + x) for x in copied]), ["layout_id", "coord_row"])
    d = df.join(c, ROW, "left")
    hit = C("coord_row").isNotNull()
    old = C("link_coord_row_id") if "link_coord_row_id" in df.columns else F.lit(None).cast("long")
    d = d.withColumns({x: F.when(hit, C("_" + x)).otherwise(C(x)) for x in copied} | {"link_coord_row_id": F.when(hit, C("coord_row")).otherwise(old)})
    return d.drop("coord_row", *["_" + x for x in copied])


def propagate_links(df: DataFrame, edits: DataFrame) -> DataFrame:
    """Coordinate-text edits ``(layout_id, row_id, new_text)`` along the stored links.

    An edited coordinate reaches all anchors linked to it; an edited anchor reaches its coordinate,
    but not the other anchors of that coordinate.
    """
    e = edits.groupBy(*ROW).agg(F.max("new_text").alias("new_text"))
    own = df.select(*ROW, "cls", "link_coord_row_id").join(e, ROW)
    down = e.select("layout_id", C("row_id").alias("link_coord_row_id"), C("new_text").alias("_down"))
    up = own.filter((C("cls") != "coordinate") & C("link_coord_row_id").isNotNull())
    up = up.groupBy("layout_id", C("link_coord_row_id").alias("row_id")).agg(F.max(F.struct(own["row_id"], "new_text")).alias("m")).select("layout_id", "row_id", C("m.new_text").alias("_up"))
    d = df.join(e.withColumnRenamed("new_text", "_own"), ROW, "left").join(down, ["layout_id", "link_coord_row_id"], "left").join(up, ROW, "left")
    anchor = C("cls") != "coordinate"
    new = F.coalesce(C("_own"), F.when(anchor, C("_down")), F.when(~anchor, C("_up")))
    d = d.withColumn("_new", new).withColumn("coord_text", F.coalesce("_new", "coord_text"))
    return _reparse(d, C("_new").isNotNull()).drop("_own", "_down", "_up", "_new")


def state_at(df: DataFrame, log: DataFrame, until, fields: list[str] = FIELDS) -> DataFrame:
    """Rows as they were at ``until``: the log is replayed up to then, the last entry per cell wins."""
    seen = log.filter((C("created_at") <= F.lit(until).cast("timestamp")) & C("column_name").isin(fields))
    rank = seen.withColumn("_at", F.struct("created_at", "corr_id"))
    w = wide(rank, "column_name", "new_value", "_at", fields)
    d = df.join(w, ROW, "left").withColumn("_touched", C("new_coord_text").isNotNull())
    d = d.withColumns({f: F.coalesce("new_" + f, f) for f in fields})
    return _reparse(d, C("_touched")).drop("_touched", *["new_" + f for f in fields])


# --- log reports -------------------------------------------------------------------------------
def correction_stats(log: DataFrame) -> DataFrame:
    """Corrections, distinct rows, first and last time per plan and column."""
    per_row = log.groupBy("layout_id", "column_name", "row_id").agg(F.count(F.lit(1)).alias("k"), F.min("created_at").alias("a"), F.max("created_at").alias("z"))
    return per_row.groupBy("layout_id", "column_name").agg(
        F.sum("k").alias("correction_count"), F.count(F.lit(1)).alias("affected_rows"), F.min("a").alias("first_correction"), F.max("z").alias("last_correction"))


def top_corrected(log: DataFrame, n: int = 10) -> DataFrame:
    """Most corrected columns over all plans."""
    per_row = log.groupBy("column_name", "layout_id", "row_id").agg(F.count(F.lit(1)).alias("k"))
    g = per_row.groupBy("column_name").agg(F.sum("k").alias("correction_count"), F.count(F.lit(1)).alias("affected_rows"))
    return g.orderBy(F.desc("correction_count"), "column_name").limit(n)


def latest(log: DataFrame, n: int = 500, layout: int | None = None, order: list = None) -> DataFrame:
    d = log if layout is None else log.filter(C("layout_id") == layout)
    return d.orderBy(*(order or [F.desc("created_at"), F.desc("corr_id")])).limit(n)


def correction_history(log: DataFrame, layout: int, row: int | None = None) -> DataFrame:
    d = log.filter(C("layout_id") == layout)
    return (d if row is None else d.filter(C("row_id") == row)).orderBy(F.desc("created_at"), F.desc("corr_id"))


SEVERITIES = ["ERROR", "WARNING", "INFO"]


def validation_history(log: DataFrame) -> DataFrame:
    """Errors first, then warnings and notes; newest first within each."""
    rank = F.when(F.upper("severity") == "ERROR", 1).when(F.upper("severity") == "WARNING", 2).when(F.upper("severity") == "INFO", 3)
    return log.withColumn("severity_rank", rank).orderBy("severity_rank", F.desc("created_at"))


def validation_summary(log: DataFrame) -> DataFrame:
    """Entries per severity, zero where there are none, and the total."""
    return log.groupBy("layout_id").agg(*[F.count_if(F.upper("severity") == s).alias(s) for s in SEVERITIES], F.count(F.lit(1)).alias("total"))


def metric_history(metrics: DataFrame, layout: int, name: str | None = None) -> DataFrame:
    d = metrics.filter(C("layout_id") == layout)
    return (d if name is None else d.filter(C("metric_name") == name)).orderBy("metric_name", F.desc("computed_at"))
