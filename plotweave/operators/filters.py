"""Projections, filters and row edits on element tables. All of them are lazy and run in one pass
unless they add or drop rows by id."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotweave import rules as R
from plotweave.functions import geometry as G
from plotweave.functions import text as T
from plotweave.operators.ordered import id_cell, rank_in_group

KEYS = ["layout_id", "page"]


def conform(df: DataFrame) -> DataFrame:
    """Default page, and centre and size from the coordinate box if there is one, else the anchor box."""
    have = set(df.columns)

    def col(n: str) -> Column:
        return F.col(n) if n in have else F.lit(None).cast("double")

    def mid(a: str, b: str) -> Column:
        return F.coalesce((col("c" + a) + col("c" + b)) / 2, (col("a" + a) + col("a" + b)) / 2)

    def span(a: str, b: str) -> Column:
        return F.coalesce(col("c" + b) - col("c" + a), col("a" + b) - col("a" + a))

    page = F.coalesce(col("page").cast("int"), F.lit(1))
    return df.withColumns({"page": page, "xc": mid("x1", "x2"), "yc": mid("y1", "y2"),
                           "w": span("x1", "x2"), "h": span("y1", "y2")})


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN means missing in incoming tables; the operators only know NULL."""
    cols = {f.name: F.nanvl(F.col(f.name), F.lit(None).cast(f.dataType)) for f in df.schema if f.dataType.typeName() in ("double", "float")}
    return df.withColumns(cols) if cols else df


def gate_threshold(cls: Column, table: dict = R.GATE) -> Column:
    return R.lookup(cls, table, R.GATE_DEFAULT)


def gate_confidence(df: DataFrame, table: dict = R.GATE) -> DataFrame:
    """Mark rows as confirmed or uncertain by class threshold; drop what is below both."""
    thr = gate_threshold(F.col("cls"), table)
    floor = F.least(R.lookup(F.col("cls"), R.UNCERTAIN_MIN, R.UNCERTAIN_MIN_DEFAULT), thr * 0.9)
    unsure = F.greatest(thr * R.UNCERTAIN_FACTOR, floor)
    status = F.when(F.col("conf") >= thr, "confirmed").when(F.col("conf") >= unsure, "uncertain")
    return df.withColumn("detection_status", status).filter(F.col("detection_status").isNotNull())


def exclude_strip(df: DataFrame, sheets: DataFrame, percent: float = 12, most: int = 4200) -> DataFrame:
    """Drop detections whose centre lies in the legend strip at the right edge."""
    strip = F.least((F.col("width") * percent / 100).cast("int"), F.lit(most))
    return df.join(sheets, KEYS).filter(F.col("cx") < F.col("width") - strip).drop("width", "height")


def tile_grid(sheets: DataFrame, tile: int = 2048, overlap: float = 40) -> DataFrame:
    """Overlapping tiles of every page; the last one of a row or column is flush with the edge."""
    step = int(tile * (1 - overlap / 100))

    def starts(size: str) -> Column:
        n = F.col(size)
        base = F.sequence(F.lit(0), F.greatest(F.lit(0), n - tile), F.lit(step))
        flush = F.when((n > tile) & ((n - tile) % step != 0), F.array(n - tile)).otherwise(F.array().cast("array<int>"))
        return F.concat(base, flush)

    return (
        sheets.withColumn("x0", F.explode(starts("width"))).withColumn("y0", F.explode(starts("height")))
        .withColumns({"x1": F.col("x0") + tile, "y1": F.col("y0") + tile})
    )


def stitch_tiles(raw: DataFrame, tiles: DataFrame, on: list[str], margin: float = 2.0) -> DataFrame:
    """Tile-local boxes to page boxes. A detection is kept only by tiles that hold its centre.

    ``tiles`` has the tile origin ``x0, y0``, its end ``x1, y1`` and the page's width and height.
    """
    d = raw.join(tiles, on)
    bx1, by1, bx2, by2 = (F.col("lx1") + F.col("x0"), F.col("ly1") + F.col("y0"),
                          F.col("lx2") + F.col("x0"), F.col("ly2") + F.col("y0"))
    cx, cy = (bx1 + bx2) / 2, (by1 + by2) / 2
    inside = cx.between(F.col("x0") - margin, F.col("x1") + margin) & cy.between(F.col("y0") - margin, F.col("y1") + margin)
    out = d.filter(inside).select(
        *raw.columns, F.greatest(F.lit(0.0), bx1).alias("px1"), F.greatest(F.lit(0.0), by1).alias("py1"),
        F.least(F.col("width").cast("double"), bx2).alias("px2"), F.least(F.col("height").cast("double"), by2).alias("py2"),
    )
    return out.filter((F.col("px2") > F.col("px1")) & (F.col("py2") > F.col("py1")))


def canon_class(df: DataFrame, table: dict = R.CLASS_ALIAS, remap: dict | None = None) -> DataFrame:
    """Alias, then remap, to the canonical class name."""
    def through(c: Column, t: dict) -> Column:
        out = c
        for k, v in t.items():
            out = F.when(c == k, F.lit(v)).otherwise(out)
        return out

    return df.withColumn("cls", through(through(F.col("cls"), table), remap or {}))


def visible(df: DataFrame, excluded: list[str] = R.EXCLUDED, hidden: str = "hidden") -> DataFrame:
    keep = ~F.col("cls").isin(excluded)
    return df.filter(keep & ~F.coalesce(F.col(hidden), F.lit(False)) if hidden in df.columns else keep)


def filter_thresholds(df: DataFrame, table: dict, overall: float = 0.0) -> DataFrame:
    return df.filter((F.col("conf") >= overall) & (F.col("conf") >= R.lookup(F.col("cls"), table, 0.0)))


def reapply_thresholds(df: DataFrame, uncertain: DataFrame, table: dict) -> DataFrame:
    """Hide rows now below their threshold, show again what a threshold had hidden, add promoted rows."""
    thr = gate_threshold(F.col("cls"), table)
    low = (F.col("conf") < thr) & ~F.coalesce("hidden", F.lit(False))
    back = (F.col("conf") >= thr) & F.coalesce("hidden_by_threshold", F.lit(False))
    kept = df.withColumns({
        "hidden": F.when(low, True).when(back, False).otherwise(F.coalesce("hidden", F.lit(False))),
        "hidden_by_threshold": F.when(low, True).when(back, False).otherwise(F.coalesce("hidden_by_threshold", F.lit(False))),
    })
    new = uncertain.filter(F.col("conf") >= thr).withColumns({"hidden": F.lit(False), "hidden_by_threshold": F.lit(False)})
    return kept.unionByName(new, allowMissingColumns=True)


# --- searching ---------------------------------------------------------------------------------
def column_predicate(c: Column, op: str, value: str = "", case: bool = False, regex: bool = False) -> Column:
    """One of contains, not_contains, equals, not_equals, starts, ends, empty, not_empty. NULL reads as ''."""
    s = F.coalesce(c.cast("string"), F.lit(""))
    t, v = (s, value) if case else (F.lower(s), value.lower())
    hit = s.rlike(value if case else "(?i)" + value) if regex else t.contains(v)
    return {
        "contains": hit, "not_contains": ~hit, "equals": t == v, "not_equals": t != v,
        "starts": t.startswith(v), "ends": t.endswith(v), "empty": ~T.filled(s), "not_empty": T.filled(s),
    }[op]


def filter_column(df: DataFrame, col: str, op: str, value: str = "", case: bool = False, regex: bool = False) -> DataFrame:
    return df.filter(column_predicate(F.col(col), op, value, case, regex))


def search(df: DataFrame, class_re: str = "", text_re: str = "", cls: str | None = None,
           texts: tuple = ("anchor_text", "coord_text", "fahrtrichtung")) -> DataFrame:
    """Class pattern, a pattern in any of the text columns, and one selected class; case is ignored."""
    hit = F.lit(False)
    for c in texts:
        hit = hit | F.coalesce(F.col(c), F.lit("")).rlike("(?i)" + text_re)
    keep = hit & F.col("cls").rlike("(?i)" + class_re)
    return df.filter(keep & (F.col("cls") == cls) if cls else keep)


CONF_BANDS = {"low": (None, 0.6), "very_low": (None, 0.4), "medium": (0.6, 0.9), "high": (0.9, None)}


def review_filter(df: DataFrame, cls: str | None = None, conf: str | None = None, risk: str | None = None,
                  page: int | None = None, text: str | None = None) -> DataFrame:
    """Conjunction of the review filters; ``risk`` is high, medium or low and needs ``risk_score``."""
    keep = F.lit(True)
    if cls:
        keep = keep & (F.col("cls") == cls)
    if conf:
        lo, hi = CONF_BANDS[conf]
        keep = keep & (F.col("conf") >= lo if lo is not None else F.lit(True)) & (F.col("conf") < hi if hi is not None else F.lit(True))
    if risk:
        r = F.col("risk_score")
        keep = keep & {"high": r > R.RISK_HIGH, "medium": r.between(R.RISK_MEDIUM, R.RISK_HIGH), "low": r < R.RISK_MEDIUM}[risk]
    if page is not None:
        keep = keep & (F.col("page") == page)
    if text:
        low = text.lower()
        keep = keep & (F.lower(F.coalesce("anchor_text", F.lit(""))).contains(low) | F.lower(F.coalesce("coord_text", F.lit(""))).contains(low))
    return df.filter(keep)


def find_pattern(value: str, case: bool = False, word: bool = False, regex: bool = False) -> str:
    body = value if regex else r"\b" + re.escape(value) + r"\b" if word else re.escape(value)
    return body if case else "(?i)" + body


def find(df: DataFrame, value: str, cols: list[str], case=False, word=False, regex=False) -> DataFrame:
    """Rows with the text in any of the columns."""
    p, hit = find_pattern(value, case, word, regex), F.lit(False)
    for c in cols:
        hit = hit | F.coalesce(F.col(c).cast("string"), F.lit("")).rlike(p)
    return df.filter(hit) if value else df.filter(F.lit(False))


def replace_all(df: DataFrame, value: str, new: str, cols: list[str], case=False, regex=False, count: str = "replaced") -> DataFrame:
    """Replace in every listed column; ``count`` is the number of changed cells of the row."""
    p = find_pattern(value, case, False, regex)
    to = new if regex else re.sub(r"([\\$])", r"\\\1", new)
    fresh = {c: F.regexp_replace(F.col(c), p, to) for c in cols}
    changed = sum((F.when(~v.eqNullSafe(F.col(c)), 1).otherwise(0) for c, v in fresh.items()), F.lit(0))
    return df.withColumn(count, changed).withColumns(fresh)


def bulk_edit(df: DataFrame, where: Column, col: str, op: str, value: str = "") -> DataFrame:
    """set, append, prepend or clear on the selected rows."""
    old = F.coalesce(F.col(col), F.lit(""))
    new = {"set": F.lit(value), "append": F.concat(old, F.lit(value)), "prepend": F.concat(F.lit(value), old), "clear": F.lit("")}[op]
    return df.withColumn(col, F.when(where, new).otherwise(F.col(col)))


# --- columns -----------------------------------------------------------------------------------
# fixed column presets and display names
NARROW = {"anchor_text": "Text/Nummer", "coord_text": "Koordinatentext", "fahrtrichtung": "Fahrtrichtung"}
BASIC = {
    "anchor_text": "Text/Nummer", "coord_text": "Koordinatentext", "coord_value": "Koordinatenwert", "gi_gl": "GI/GL",
    "page": "Seite", "fahrtrichtung": "Fahrtrichtung", "weichen_coordinates": "Weichen Koordinaten", "notes": "Notizen",
}
PRESETS = {"narrow": NARROW, "basic": BASIC}
ONLY_FOR = {"fahrtrichtung": ["signal"]}


def columns_for(cls: str, preset: str = "basic") -> dict[str, str]:
    return {c: n for c, n in PRESETS[preset].items() if cls in ONLY_FOR.get(c, [cls])}


def project_for_class(df: DataFrame, cls: str, preset: str = "basic", rename: bool = True, drop: list[str] = (),
                      extra: list[str] = ()) -> DataFrame:
    """Rows of one class with the columns shown for it, in order, optionally under their display names."""
    cols = {c: n for c, n in columns_for(cls, preset).items() if c in df.columns and c not in drop}
    cols |= {c: c for c in extra}
    return df.filter(F.col("cls") == cls).select(*[F.col(c).alias(n if rename else c) for c, n in cols.items()])


SCALES = {"x1000": 1000.0, "x100": 100.0, "x10": 10.0, "/1000": 0.001, "/100": 0.01}


def export_projection(df: DataFrame, classes: dict[str, dict[str, str]], exclude: DataFrame | None = None,
                      drop: list[str] = (), rename: dict | None = None, scale: str | None = None,
                      scaled: list[str] = (), empty: str = "", numbers: str | None = None,
                      order: list[str] = (), sort: list | None = None) -> DataFrame:
    """Chosen classes with their columns and names as one table of text and numbers.

    One pass over the table: a column exists once and is NULL for classes that do not show it.
    """
    d = df.filter(F.col("cls").isin(list(classes)))
    if exclude is not None:
        d = d.join(exclude, exclude.columns, "left_anti")
    names = list(dict.fromkeys(n for cols in classes.values() for c, n in cols.items() if n not in drop))
    types = dict(d.dtypes)
    out = {}
    for name in names:
        value = None
        for cls, cols in classes.items():
            for c, n in cols.items():
                if n == name and c in types:
                    v = F.array_join(c, ", ") if types[c].startswith("array") else F.col(c)
                    value = F.when(F.col("cls") == cls, v) if value is None else value.when(F.col("cls") == cls, v)
        final = (rename or {}).get(name, name)
        if scale and name in scaled:
            value = value * SCALES[scale]
        out[final] = format_cell(value, empty, numbers)
    ordered = [c for c in order if c in out] + [c for c in out if c not in order]
    res = d.sort(*sort) if sort else d
    return res.select(*[out[c].alias(c) for c in ordered])


def format_cell(c: Column, empty: str = "", numbers: str | None = None) -> Column:
    """Text of a cell: blanks filled; numeric-looking cells with two decimals or as a whole number."""
    s = F.coalesce(c.cast("string"), F.lit(""))
    s = F.when(s == "", F.lit(empty)).otherwise(s)
    if numbers is None:
        return s
    v = s.try_cast("double")
    whole = F.when(v < 0, F.ceil(v)).otherwise(F.floor(v)).cast("string")
    text = F.format_string("%.2f", v) if numbers == "decimals" else whole
    return F.when(v.isNotNull() & ~F.isnan(v), text).otherwise(s)


def format_cells(df: DataFrame, cols: list[str], empty: str = "", numbers: str | None = None) -> DataFrame:
    return df.withColumns({c: format_cell(F.col(c), empty, numbers) for c in cols})


# --- rows --------------------------------------------------------------------------------------
def set_class(df: DataFrame, changes: DataFrame) -> DataFrame:
    """New class for the rows of ``changes(layout_id, row_id, new_cls)``."""
    return (
        df.join(changes, ["layout_id", "row_id"], "left")
        .withColumn("cls", F.coalesce("new_cls", "cls")).drop("new_cls")
    )


def exclude_title_block(pixels: DataFrame, sheets: DataFrame, width_percent: float = 8, height_percent: float = 25) -> DataFrame:
    """Drop track pixels in the bottom-right title block."""
    right = F.col("width") - (F.col("width") * width_percent / 100).cast("int")
    bottom = F.col("height") - (F.col("height") * height_percent / 100).cast("int")
    return pixels.join(sheets, KEYS).filter(~((F.col("x") >= right) & (F.col("y") >= bottom))).drop("width", "height")


def display_label() -> Column:
    cls, coord, name = F.col("cls"), T.text_or_empty(F.col("coord_text")), T.text_or_empty(F.col("anchor_text"))
    return (
        F.when((cls == "coordinate") & (coord != ""), F.concat(F.lit("@ "), coord))
        .when(cls == "coordinate", "[coordinate]")
        .when(cls.isin(R.TEXT_CLASSES) & (name != "") & (coord != ""), F.concat_ws(" @ ", name, coord))
        .when(cls.isin(R.TEXT_CLASSES) & (name != ""), name)
        .when(cls.isin(R.TEXT_CLASSES), F.concat(F.lit("["), cls, F.lit("]")))
        .when(coord != "", F.concat_ws(" @ ", cls, coord))
        .otherwise(F.concat(cls, F.lit(" (Page "), F.coalesce(F.col("page").cast("string"), F.lit("?")), F.lit(")")))
    )


def review_view(df: DataFrame) -> DataFrame:
    """Texts shown per class; unnamed rows of generated-name classes are numbered on their page."""
    cls = F.col("cls")
    named, coord = F.coalesce("anchor_text", F.lit("")), F.coalesce("coord_text", F.lit(""))
    needs = R.is_in(cls, R.GENERATED_NAME) & (named == "")
    no = rank_in_group(df.filter(needs).select("layout_id", "page", "cls", "row_id"), ["layout_id", "page", "cls"], ["row_id"], id_cell(), "_no")
    d = df.join(no, ["layout_id", "page", "cls", "row_id"], "left")
    return d.select(
        "layout_id", "page", "row_id", "cls",
        F.when(cls == "coordinate", coord).when(F.col("_no").isNotNull(), F.concat(cls, F.lit(" "), F.col("_no"))).otherwise(named).alias("primary_text"),
        F.when(cls == "coordinate", "").otherwise(coord).alias("secondary_text"),
        F.when(cls == "signal", F.coalesce("fahrtrichtung", F.lit(""))).otherwise("").alias("direction_text"),
    )


def delete_rows(df: DataFrame, ids: DataFrame) -> DataFrame:
    return df.join(ids.select("layout_id", "row_id"), ["layout_id", "row_id"], "left_anti")


def add_rows(df: DataFrame, rows: DataFrame, order: str) -> DataFrame:
    """Append rows of each plan under ids after its largest one. ``order`` is a running id of the new rows."""
    top = df.groupBy("layout_id").agg(F.max("row_id").alias("_top"))
    fresh = rank_in_group(rows.drop("row_id"), ["layout_id"], [order], id_cell(order), "_n")
    fresh = fresh.join(top, "layout_id", "left").withColumn("row_id", F.coalesce("_top", F.lit(-1)) + F.col("_n"))
    return df.unionByName(fresh.drop("_n", "_top"), allowMissingColumns=True)


def issues_view(issues: DataFrame, severity: str | None = None, correctable: bool = False) -> DataFrame:
    """Issues by severity or correctability, with the part of the system they come from."""
    origin = (
        F.when(F.col("category").startswith("template_") | F.col("message").startswith("Template"), "template")
        .when(F.col("category").isin("format", "duplicate", "missing_data", "confidence"), "text").otherwise("model")
    )
    keep = F.lit(True)
    if severity:
        keep = keep & (F.lower("severity") == severity.lower())
    if correctable:
        keep = keep & F.col("auto_correctable")
    return issues.filter(keep).withColumn("origin", origin)
