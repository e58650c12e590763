"""Projections, filters and row edits."""

from __future__ import annotations

from pyspark.sql import functions as F

from plotweave import rules as R
from plotweave.functions import text as T
from plotweave.operators import filters as P
from plotweave.plans.registry import query, sql_case, sql_list

C = F.col
ID = ["layout_id", "row_id"]
GATE_SQL = sql_case(R.GATE, default=R.GATE_DEFAULT)


def elements(t):
    """det with anchor and coordinate boxes in their own columns."""
    d = t.det
    anchor = C("cls") != "coordinate"
    cols = {"a" + c: F.when(anchor, C(c)) for c in ("x1", "y1", "x2", "y2")}
    half = {"x1": ("lx", -20), "y1": ("ly", -8), "x2": ("lx", 20), "y2": ("ly", 8)}
    cols |= {"c" + c: F.when(anchor, C(m) + h).otherwise(C(c)) for c, (m, h) in half.items()}
    return d.withColumns(cols)


@query("p1_conform", sql="""
SELECT layout_id, row_id, CASE WHEN r % 10 = 0 THEN 1 ELSE page END AS page, coalesce(CASE WHEN cls <> 'coordinate' THEN lx ELSE cx END, cx) AS xc, coalesce(CASE WHEN cls <> 'coordinate' THEN ly ELSE cy END, cy) AS yc,
  CASE WHEN cls <> 'coordinate' AND lx IS NOT NULL THEN 40.0 ELSE w END AS w, CASE WHEN cls <> 'coordinate' AND lx IS NOT NULL THEN 16.0 ELSE h END AS h FROM det""")
def p1(t):
    d = elements(t).withColumn("page", F.when(C("r") % 10 != 0, C("page"))).drop("w", "h")
    return P.conform(d).select(*ID, "page", "xc", "yc", "w", "h")


MINU = sql_case(R.UNCERTAIN_MIN, default=R.UNCERTAIN_MIN_DEFAULT)
STATUS = f"CASE WHEN conf >= {GATE_SQL} THEN 'confirmed' WHEN conf >= greatest({GATE_SQL} * 0.5, least({MINU}, {GATE_SQL} * 0.9)) THEN 'uncertain' END"


@query("p2_gate_confidence", sql=f"SELECT layout_id, row_id, {STATUS} AS detection_status FROM det WHERE {STATUS} IS NOT NULL")
def p2(t):
    return P.gate_confidence(t.det).select(*ID, "detection_status")


@query("p3_exclude_strip", "det sheets", sql="SELECT d.layout_id, d.row_id, d.cx FROM det d JOIN sheets s ON d.layout_id = s.layout_id AND d.page = s.page WHERE d.cx < s.width - least(CAST(trunc(s.width * 12 / 100) AS INT), 4200)")
def p3(t):
    return P.exclude_strip(t.det, t.sheets).select(*ID, "cx")


@query("p4_tile_grid", "det sheets", sql="""
WITH xs AS (SELECT layout_id, page, width, height, unnest(list_concat(range(0, greatest(0, width - 512) + 1, 307), CASE WHEN width > 512 AND (width - 512) % 307 <> 0 THEN [width - 512] ELSE [] END)) AS x0 FROM sheets),
ys AS (SELECT *, unnest(list_concat(range(0, greatest(0, height - 512) + 1, 307), CASE WHEN height > 512 AND (height - 512) % 307 <> 0 THEN [height - 512] ELSE [] END)) AS y0 FROM xs)
SELECT layout_id, page, x0, y0, x0 + 512 AS x1, y0 + 512 AS y1 FROM ys""")
def p4(t):
    return P.tile_grid(t.sheets, 512, 40).select("layout_id", "page", "x0", "y0", "x1", "y1")


@query("p5_stitch_tiles", "raw sheets", sql="""
WITH g AS (SELECT r.*, lx1 + tile_x * 307 AS bx1, ly1 + tile_y * 307 AS by1, lx2 + tile_x * 307 AS bx2, ly2 + tile_y * 307 AS by2, tile_x * 307 AS x0, tile_y * 307 AS y0, width, height
  FROM raw r JOIN sheets s ON r.layout_id = s.layout_id AND r.page = s.page WHERE tile_x * 307 <= width - 512 AND tile_y * 307 <= height - 512)
SELECT layout_id, row_id, tile_x, tile_y, greatest(0.0, bx1) AS px1, greatest(0.0, by1) AS py1, least(width, bx2) AS px2, least(height, by2) AS py2 FROM g
WHERE (bx1 + bx2) / 2 BETWEEN x0 - 2 AND x0 + 514 AND (by1 + by2) / 2 BETWEEN y0 - 2 AND y0 + 514 AND least(width, bx2) > greatest(0.0, bx1) AND least(height, by2) > greatest(0.0, by1)""")
def p5(t):
    tiles = P.tile_grid(t.sheets, 512, 40).filter((C("x0") % 307 == 0) & (C("y0") % 307 == 0))
    tiles = tiles.withColumns({"tile_x": (C("x0") / 307).cast("int"), "tile_y": (C("y0") / 307).cast("int")})
    return P.stitch_tiles(t.raw, tiles, ["layout_id", "page", "tile_x", "tile_y"]).select(*ID, "tile_x", "tile_y", "px1", "py1", "px2", "py2")


@query("p6_canon_class", sql="SELECT layout_id, row_id, CASE cls WHEN 'isolierstoss' THEN 'isolierstoß' WHEN 'weichenende' THEN 'weichengruppenende' ELSE cls END AS cls FROM det")
def p6(t):
    return P.canon_class(t.det, remap={"weichenende": "weichengruppenende"}).select(*ID, "cls")


@query("p7_visible", sql="SELECT layout_id, row_id, cls FROM det WHERE cls NOT IN ('coordinate', 'weichen_block') AND NOT hidden")
def p7(t):
    return P.visible(t.det).select(*ID, "cls")


@query("p8_filter_thresholds", sql=f"SELECT layout_id, row_id, conf FROM det WHERE conf >= 0.3 AND conf >= {sql_case(R.REVIEW, default=0)}")
def p8(t):
    return P.filter_thresholds(t.det, R.REVIEW, 0.3).select(*ID, "conf")


@query("p9_reapply_thresholds", sql=f"""
WITH s AS (SELECT *, {GATE_SQL} AS thr FROM det)
SELECT layout_id, row_id, CASE WHEN conf < thr AND NOT hidden THEN TRUE WHEN conf >= thr AND hidden AND r % 2 = 0 THEN FALSE ELSE hidden END AS hidden,
  CASE WHEN conf < thr AND NOT hidden THEN TRUE WHEN conf >= thr AND hidden AND r % 2 = 0 THEN FALSE ELSE hidden AND r % 2 = 0 END AS hidden_by_threshold FROM s WHERE r % 5 > 0
UNION ALL SELECT layout_id, row_id, FALSE, FALSE FROM s WHERE r % 5 = 0 AND conf >= thr""")
def p9(t):
    d = t.det.select(*ID, "r", "cls", "conf", "hidden")
    rows = d.filter(C("r") % 5 > 0).withColumn("hidden_by_threshold", C("hidden") & (C("r") % 2 == 0))
    return P.reapply_thresholds(rows, d.filter(C("r") % 5 == 0), R.GATE).select(*ID, "hidden", "hidden_by_threshold")


@query("p10_column_filter", sql="""
SELECT layout_id, row_id, contains(lower(anchor_text), 'o1') AS has, NOT regexp_matches(anchor_text, '(?i)^[abn]') AS no_match, lower(cls) = 'signal' AS same, coalesce(coord_text, '') <> '1,0000' AS other,
  starts_with(anchor_text, 'A') AS first, ends_with(coalesce(coord_text, ''), '112)') AS last, trim(coalesce(notes, '')) = '' AS blank FROM det WHERE trim(coalesce(coord_text, '')) <> ''""")
def p10(t):
    p = P.column_predicate
    d = P.filter_column(t.det, "coord_text", "not_empty")
    return d.select(*ID, p(C("anchor_text"), "contains", "O1").alias("has"), p(C("anchor_text"), "not_contains", "^[abn]", regex=True).alias("no_match"),
                    p(C("cls"), "equals", "SIGNAL").alias("same"), p(C("coord_text"), "not_equals", "1,0000").alias("other"),
                    p(C("anchor_text"), "starts", "A", case=True).alias("first"), p(C("coord_text"), "ends", "112)").alias("last"),
                    p(C("notes"), "empty").alias("blank"))


@query("p11_search", sql="SELECT layout_id, row_id, cls FROM det WHERE regexp_matches(cls, '(?i)^GKS') AND (regexp_matches(anchor_text, '(?i)p1[0-3]') OR regexp_matches(coalesce(coord_text, ''), '(?i)p1[0-3]') OR regexp_matches(coalesce(fahrtrichtung, ''), '(?i)p1[0-3]'))")
def p11(t):
    return P.search(t.det, "^GKS", "p1[0-3]").select(*ID, "cls")


@query("p12_review_filter", sql="SELECT layout_id, row_id, conf FROM det WHERE cls = 'signal' AND conf >= 0.6 AND conf < 0.9 AND page = 2 AND (contains(lower(anchor_text), 'n1') OR contains(lower(coalesce(coord_text, '')), 'n1'))")
def p12(t):
    return P.review_filter(t.det, cls="signal", conf="medium", page=2, text="N1").select(*ID, "conf")


@query("p13_find_replace", sql="""
SELECT layout_id, row_id, regexp_replace(anchor_text, '(?i)o', '0', 'g') AS anchor_text, regexp_replace(coord_text, '(?i)o', '0', 'g') AS coord_text,
  CASE WHEN regexp_matches(anchor_text, '(?i)o') THEN 1 ELSE 0 END + CASE WHEN coalesce(regexp_matches(coord_text, '(?i)o'), FALSE) THEN 1 ELSE 0 END AS replaced
FROM det WHERE regexp_matches(anchor_text, '(?i)o1') OR regexp_matches(coalesce(coord_text, ''), '(?i)o1')""")
def p13(t):
    d = P.find(t.det, "o1", ["anchor_text", "coord_text"])
    return P.replace_all(d, "o", "0", ["anchor_text", "coord_text"]).select(*ID, "anchor_text", "coord_text", "replaced")


@query("p14_bulk_edit", sql="""
SELECT layout_id, row_id, CASE WHEN cls = 'signal' THEN concat('S-', anchor_text) ELSE anchor_text END AS anchor_text, CASE WHEN conf < 0.2 THEN concat(coalesce(notes, ''), '?') ELSE notes END AS notes,
  CASE WHEN cls = 'coordinate' THEN '' ELSE fahrtrichtung END AS fahrtrichtung, CASE WHEN conf > 0.9 THEN 'ok' ELSE coord_text END AS coord_text FROM det""")
def p14(t):
    d = P.bulk_edit(t.det, C("cls") == "signal", "anchor_text", "prepend", "S-")
    d = P.bulk_edit(d, C("conf") < 0.2, "notes", "append", "?")
    d = P.bulk_edit(d, C("cls") == "coordinate", "fahrtrichtung", "clear")
    return P.bulk_edit(d, C("conf") > 0.9, "coord_text", "set", "ok").select(*ID, "anchor_text", "notes", "fahrtrichtung", "coord_text")


@query("p15_project_for_class", sql="SELECT row_id, anchor_text AS \"Text/Nummer\", coord_text AS \"Koordinatentext\", coord_value AS \"Koordinatenwert\", gi_gl AS \"GI/GL\", page AS \"Seite\", fahrtrichtung AS \"Fahrtrichtung\" FROM det WHERE cls = 'signal'")
def p15(t):
    return P.project_for_class(t.det, "signal", drop=["notes"], extra=["row_id"])


EXPORT = {
    "signal": {"row_id": "Zeile", "cls": "Klasse", "anchor_text": "Text", "fahrtrichtung": "Fahrtrichtung", "cx": "X", "page": "Seite"},
    "gm_block": {"row_id": "Zeile", "cls": "Klasse", "coord_text": "Text", "cx": "X", "page": "Seite"},
}


@query("p16_export_projection", sql="""
SELECT CAST(row_id AS STRING) AS "Zeile", cls AS "Art", CASE WHEN coalesce(CASE cls WHEN 'signal' THEN anchor_text ELSE coord_text END, '') = '' THEN '-' ELSE CASE cls WHEN 'signal' THEN anchor_text ELSE coord_text END END AS "Text",
  CASE WHEN cls = 'signal' THEN coalesce(nullif(fahrtrichtung, ''), '-') ELSE '-' END AS "Fahrtrichtung", CAST(CAST(cx * 100.0 AS DOUBLE) AS STRING) AS "X"
FROM det WHERE cls IN ('signal', 'gm_block') AND NOT hidden""")
def p16(t):
    ex = t.det.filter("hidden").select("layout_id", "row_id")
    return P.export_projection(t.det, EXPORT, exclude=ex, drop=["Seite"], rename={"Klasse": "Art"}, scale="x100", scaled=["X"],
                               empty="-", order=["Art", "Zeile"], sort=["cls", "page"])


@query("p17_format_cells", sql="""
SELECT layout_id, row_id, printf('%.2f', conf) AS conf, CASE WHEN coalesce(fahrtrichtung, '') = '' THEN 'n/a' ELSE fahrtrichtung END AS fahrtrichtung,
  CASE WHEN TRY_CAST(coord_text AS DOUBLE) IS NOT NULL THEN CAST(CAST(trunc(TRY_CAST(coord_text AS DOUBLE)) AS BIGINT) AS STRING) ELSE coalesce(nullif(coord_text, ''), '') END AS coord_text FROM det""")
def p17(t):
    d = P.format_cells(t.det, ["conf"], numbers="decimals")
    d = P.format_cells(d, ["fahrtrichtung"], empty="n/a")
    return P.format_cells(d, ["coord_text"], numbers="whole").select(*ID, "conf", "fahrtrichtung", "coord_text")


@query("p18_set_class", "det corr_log", sql="""
SELECT d.layout_id, d.row_id, coalesce(c.n, d.cls) AS cls FROM det d LEFT JOIN (SELECT layout_id, row_id, min('neu_' || correction_type) AS n FROM corr_log GROUP BY ALL) c ON d.layout_id = c.layout_id AND d.row_id = c.row_id""")
def p18(t):
    ch = t.corr_log.groupBy(*ID).agg(F.min(F.concat(F.lit("neu_"), "correction_type")).alias("new_cls"))
    return P.set_class(t.det, ch).select(*ID, "cls")


@query("p19_title_block", "px det sheets", sql="""
SELECT p.layout_id, p.page, p.y, p.x FROM px p JOIN sheets s ON p.layout_id = s.layout_id AND p.page = s.page
WHERE NOT (x >= width - CAST(trunc(width * 8 / 100) AS INT) AND y >= height - CAST(trunc(height * 25 / 100) AS INT))""")
def p19(t):
    return P.exclude_title_block(t.px, t.sheets)


@query("p20_display_label", sql="""
SELECT layout_id, row_id, CASE WHEN cls = 'coordinate' THEN CASE WHEN c <> '' THEN '@ ' || c ELSE '[coordinate]' END
  WHEN cls IN ('signal', 'gks_festkodiert', 'gks_gesteuert') THEN CASE WHEN n <> '' AND c <> '' THEN n || ' @ ' || c WHEN n <> '' THEN n ELSE '[' || cls || ']' END
  WHEN c <> '' THEN cls || ' @ ' || c ELSE cls || ' (Page ' || page || ')' END AS label
FROM (SELECT *, coalesce(trim(coord_text), '') AS c, coalesce(trim(anchor_text), '') AS n FROM det)""")
def p20(t):
    return t.det.select(*ID, P.display_label().alias("label"))


@query("p21_review_view", sql=f"""
WITH m AS (SELECT *, CASE WHEN r % 2 = 0 THEN '' ELSE anchor_text END AS n FROM det),
k AS (SELECT *, CASE WHEN n = '' AND cls IN {sql_list(R.GENERATED_NAME)} THEN row_number() OVER (PARTITION BY layout_id, page, cls, n = '' ORDER BY row_id) END AS no FROM m)
SELECT layout_id, page, row_id, cls, CASE WHEN cls = 'coordinate' THEN coalesce(coord_text, '') WHEN no IS NOT NULL THEN cls || ' ' || no ELSE n END AS primary_text,
  CASE WHEN cls = 'coordinate' THEN '' ELSE coalesce(coord_text, '') END AS secondary_text, CASE WHEN cls = 'signal' THEN coalesce(fahrtrichtung, '') ELSE '' END AS direction_text FROM k""")
def p21(t):
    return P.review_view(t.det.withColumn("anchor_text", F.when(C("r") % 2 == 0, "").otherwise(C("anchor_text"))))


@query("p22_delete_add_rows", "det corr_log", sql="""
WITH kept AS (SELECT layout_id, row_id, cls FROM det d WHERE NOT EXISTS (SELECT 1 FROM corr_log c WHERE c.layout_id = d.layout_id AND c.row_id = d.row_id AND correction_type = 'error')),
top AS (SELECT layout_id, max(row_id) AS m FROM kept GROUP BY layout_id)
SELECT layout_id, row_id, cls FROM kept
UNION ALL SELECT c.layout_id, coalesce(m, -1) + row_number() OVER (PARTITION BY c.layout_id ORDER BY corr_id), 'neu' FROM corr_log c LEFT JOIN top ON c.layout_id = top.layout_id WHERE correction_type = 'signup'""")
def p22(t):
    gone = t.corr_log.filter(C("correction_type") == "error")
    new = t.corr_log.filter(C("correction_type") == "signup").select("layout_id", "row_id", F.lit("neu").alias("cls"), "corr_id")
    kept = P.delete_rows(t.det.select(*ID, "cls"), gone)
    return P.add_rows(kept, new, "corr_id").select(*ID, "cls")
