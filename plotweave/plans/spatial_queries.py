"""Neighbour searches, overlaps, suppression and components."""

from __future__ import annotations

from pyspark.sql import functions as F

from plotweave import rules as R
from plotweave.functions import geometry as G
from plotweave.operators import iterative, spatial
from plotweave.operators import ordered
from plotweave.operators import spatial_checks as X
from plotweave.operators import tracks
from plotweave.plans.check_queries import BLANKS2, LETTERS, LOWC, MISSC, MISST, SIZE, BADSTART, symbol_dim
from plotweave.plans.registry import query, sql_case, sql_list

C = F.col
KEYS = ["layout_id", "page"]
DIST = "sqrt((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy))"
SAMEPAGE = "a.layout_id = b.layout_id AND a.page = b.page"
INTER = "(greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)))"
AA, AB = "((a.x2 - a.x1) * (a.y2 - a.y1))", "((b.x2 - b.x1) * (b.y2 - b.y1))"
IOU = f"({INTER} / ({AA} + {AB} - {INTER}))"
LIM = sql_case(R.NEAR_DUPLICATE, default=R.NEAR_DUPLICATE_DEFAULT)


def coords(t):
    return t.det.filter(C("cls") == "coordinate")


@query("j22_near_duplicates", sql=f"""
WITH d AS (SELECT *, {LIM} AS lim FROM det WHERE {LIM} IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY layout_id, page, cls, cx, cy ORDER BY conf DESC, row_id) AS k, count(*) OVER (PARTITION BY layout_id, page, cls, cx, cy) AS n,
  first_value(row_id) OVER (PARTITION BY layout_id, page, cls, cx, cy ORDER BY conf DESC, row_id) AS best FROM d),
p AS (SELECT * FROM o WHERE k = 1)
SELECT layout_id, page, cls, best AS keep_row, row_id, 0.0::DOUBLE AS dist, 1 AS keep_copies, 1 AS drop_copies FROM o WHERE k > 1
UNION ALL SELECT a.layout_id, a.page, a.cls, CASE WHEN a.conf >= b.conf THEN a.row_id ELSE b.row_id END, CASE WHEN a.conf >= b.conf THEN b.row_id ELSE a.row_id END, round({DIST}, 6),
  CASE WHEN a.conf >= b.conf THEN a.n ELSE b.n END, CASE WHEN a.conf >= b.conf THEN b.n ELSE a.n END
FROM p a JOIN p b ON {SAMEPAGE} AND a.cls = b.cls AND a.row_id < b.row_id AND {DIST} < a.lim""")
def j22(t):
    return X.near_duplicates(t.det).withColumn("dist", F.round("dist", 6))


@query("j20_overlap_pairs", sql=f"""
WITH o AS (SELECT *, row_number() OVER w AS k, first_value(row_id) OVER w AS f, count(*) OVER (PARTITION BY layout_id, page, x1, y1, x2, y2) AS n FROM det WINDOW w AS (PARTITION BY layout_id, page, x1, y1, x2, y2 ORDER BY row_id)), p AS (SELECT * FROM o WHERE k = 1)
SELECT layout_id, page, f AS row_id, row_id AS other_row, f AS smaller_row, 1.0 AS contained, 1 AS n_pairs FROM o WHERE k > 1
UNION ALL SELECT a.layout_id, a.page, a.row_id, b.row_id, CASE WHEN {AA} <= {AB} THEN a.row_id ELSE b.row_id END, round({INTER} / least({AA}, {AB}), 6), a.n * b.n
FROM p a JOIN p b ON {SAMEPAGE} AND a.row_id < b.row_id AND {INTER} / least({AA}, {AB}) >= 0.8""")
def j20(t):
    return X.overlap_pairs(t.det, 0.8).withColumn("contained", F.round("contained", 6))


@query("j21_overlap_clusters", sql=f"""
WITH RECURSIVE e AS (SELECT a.layout_id, a.row_id AS s, b.row_id AS d, {IOU} AS iou FROM det a JOIN det b ON {SAMEPAGE} AND a.row_id <> b.row_id AND {IOU} >= 0.05),
multi AS (SELECT layout_id, s AS row_id FROM e GROUP BY ALL HAVING count(*) >= 2),
ok AS (SELECT * FROM multi WHERE layout_id IN (SELECT layout_id FROM multi GROUP BY layout_id HAVING count(*) >= 3)),
ie AS (SELECT e.* FROM e JOIN ok x ON e.layout_id = x.layout_id AND e.s = x.row_id JOIN ok y ON e.layout_id = y.layout_id AND e.d = y.row_id),
reach(layout_id, n, r) AS (SELECT layout_id, row_id, row_id FROM ok UNION SELECT reach.layout_id, reach.n, ie.d FROM reach JOIN ie ON reach.layout_id = ie.layout_id AND reach.r = ie.s),
comp AS (SELECT layout_id, n, min(r) AS rep FROM reach GROUP BY ALL),
m AS (SELECT c.layout_id, c.rep, count(*) AS size, string_agg(DISTINCT cls, ', ' ORDER BY cls) AS classes FROM comp c JOIN det d ON c.layout_id = d.layout_id AND c.n = d.row_id GROUP BY ALL),
r AS (SELECT c.layout_id, c.rep, avg(iou) AS mi FROM ie JOIN comp c ON ie.layout_id = c.layout_id AND ie.s = c.n GROUP BY ALL)
SELECT m.layout_id, m.rep AS row_id, size, classes, round(coalesce(mi, 0.0), 6) AS mean_iou, CASE WHEN coalesce(mi, 0.0) > 0.5 THEN 'error' ELSE 'warning' END AS severity FROM m LEFT JOIN r ON m.layout_id = r.layout_id AND m.rep = r.rep""")
def j21(t):
    return X.overlap_clusters(t.det).withColumn("mean_iou", F.round("mean_iou", 6))


REL = sql_case({k: v[0] for k, v in R.RELATION.items()}, "a.cls")
RELS = sql_case({k: v[1] for k, v in R.RELATION.items()}, "a.cls")
NEARC = f"SELECT a.layout_id, a.row_id, min({DIST}) AS md FROM det a JOIN det b ON {SAMEPAGE} AND b.cls = 'coordinate' GROUP BY ALL"


@query("j32_relation_issues", sql=f"""
WITH n AS ({NEARC}) SELECT a.layout_id, a.page, a.row_id, a.cls, {RELS} AS severity, round(md, 6) AS min_distance, round(least(1.0, coalesce(md, 1e9) / {REL}), 6) AS confidence
FROM det a LEFT JOIN n ON a.layout_id = n.layout_id AND a.row_id = n.row_id WHERE {REL} IS NOT NULL AND (md IS NULL OR md > {REL})""")
def j32(t):
    d = X.relation_issues(t.det, coords(t), (200.0, 2400.0))
    return d.withColumns({"min_distance": F.round("min_distance", 6), "confidence": F.round("confidence", 6)})


@query("j32_without_coordinate", sql=f"SELECT a.layout_id, a.row_id, a.cls FROM det a WHERE a.cls IN {sql_list(R.NEED_COORDINATE)} AND NOT EXISTS (SELECT 1 FROM det b WHERE {SAMEPAGE} AND b.cls = 'coordinate' AND {DIST} <= 200)")
def j32b(t):
    return X.without_coordinate(t.det, coords(t), 200.0, R.NEED_COORDINATE).select("layout_id", "row_id", "cls")


@query("j33_isolated", sql=f"""
WITH m AS (SELECT layout_id, page, cls FROM det GROUP BY ALL HAVING count(*) >= 3)
SELECT a.layout_id, a.row_id, a.cls FROM det a JOIN m ON a.layout_id = m.layout_id AND a.page = m.page AND a.cls = m.cls
WHERE NOT EXISTS (SELECT 1 FROM det b WHERE {SAMEPAGE} AND a.cls = b.cls AND a.row_id <> b.row_id AND {DIST} <= 600)""")
def j33(t):
    return X.isolated(t.det, 600.0).select("layout_id", "row_id", "cls")


REFS = "nullif(trim(regexp_extract(name_text, '\\(([^)]+)\\)\\s*$', 1)), '')"


@query("j23_dangling_refs", sql=f"""
SELECT layout_id, row_id, signal_name FROM (SELECT *, {REFS} AS signal_name FROM det WHERE cls = 'haltepunkt') s
WHERE signal_name IS NOT NULL AND NOT EXISTS (SELECT 1 FROM det b WHERE b.cls = 'signal' AND b.layout_id = s.layout_id AND b.page = s.page AND trim(b.name_text) = signal_name)""")
def j23(t):
    return X.dangling_refs(t.det, "name_text").select("layout_id", "row_id", "signal_name")


@query("r3_inspector_risk", sql=f"""
WITH f AS (SELECT a.*, EXISTS (SELECT 1 FROM det b WHERE {SAMEPAGE} AND a.cls = b.cls AND a.row_id <> b.row_id AND {DIST} < 50) AS dup, a.cls = 'haltepunkt' AND nullif(trim(regexp_extract(a.name_text, '\\(([^)]+)\\)\\s*$', 1)), '') IS NOT NULL
  AND NOT EXISTS (SELECT 1 FROM det b WHERE b.cls = 'signal' AND {SAMEPAGE} AND trim(b.name_text) = trim(regexp_extract(a.name_text, '\\(([^)]+)\\)\\s*$', 1))) AS bad FROM det a)
SELECT layout_id, row_id, round(least(1.0, {LOWC} + {MISSC} + {MISST} + CASE WHEN dup THEN 0.15 ELSE 0.0 END + {SIZE} + CASE WHEN cls <> 'coordinate' AND {BADSTART} THEN 0.20 ELSE 0.0 END + {LETTERS} + {BLANKS2} + CASE WHEN bad THEN 0.25 ELSE 0.0 END), 6) AS risk_score FROM f""")
def r3(t):
    return X.inspector_risk(t.det, "name_text").select("layout_id", "row_id", F.round("risk_score", 6).alias("risk_score"))


FLAG = f"""(CASE WHEN conf < 0.4 THEN 40 WHEN conf < 0.5 THEN 20 ELSE 0 END + CASE WHEN cls IN {sql_list(R.NEED_TEXT)} AND coalesce(anchor_text, '') = '' THEN 30 ELSE 0 END
  + CASE WHEN cls IN {sql_list(R.NEED_COORDINATE)} AND (md IS NULL OR md > CASE WHEN cls = 'signal' THEN 200 ELSE 150 END) THEN 20 ELSE 0 END)"""


@query("r5_false_positives", sql=f"""WITH n AS ({NEARC}), f AS (SELECT d.*, md, {FLAG.replace('cls', 'd.cls')} AS flag_score FROM det d LEFT JOIN n ON d.layout_id = n.layout_id AND d.row_id = n.row_id WHERE d.cls <> 'coordinate')
SELECT layout_id, page, row_id, cls, flag_score, CASE WHEN flag_score >= 70 THEN 'error' ELSE 'warning' END AS severity FROM f WHERE flag_score >= 50""")
def r5(t):
    return X.false_positives(t.det, coords(t))


GAPS = """g AS (SELECT * FROM (SELECT layout_id, page, cy AS g1, lead(cy) OVER (PARTITION BY layout_id, page ORDER BY cy) AS g2 FROM (SELECT DISTINCT layout_id, page, cy FROM det WHERE cls = 'coordinate')) WHERE g2 - g1 > 100)"""


@query("w2_pattern_breaks", sql=f"""
WITH {GAPS}, k AS (SELECT layout_id, page FROM det GROUP BY ALL HAVING count(*) FILTER (cls IN {sql_list(R.NEED_TEXT)}) >= 3 AND count(*) FILTER (cls = 'coordinate') >= 2),
i AS (SELECT g.layout_id, g.page, g1, g2, avg(cx) AS mx FROM g JOIN k ON g.layout_id = k.layout_id AND g.page = k.page JOIN det d ON d.layout_id = g.layout_id AND d.page = g.page AND d.cls IN {sql_list(R.NEED_TEXT)} AND d.cy > g1 AND d.cy < g2 GROUP BY ALL)
SELECT layout_id, page, 'pattern_break' AS region_type, 'coordinate' AS expected_class, round(mx - 150, 6) AS x1, (g1 + g2) / 2 - 100 AS y1, round(mx + 150, 6) AS x2, (g1 + g2) / 2 + 100 AS y2, round(mx, 6) AS xc, (g1 + g2) / 2 AS yc, 0.8 AS confidence FROM i""")
def w2(t):
    d = X.pattern_breaks(t.det, 100.0)
    return d.withColumns({c: F.round(c, 6) for c in ("x1", "x2", "xc")})


@query("m1_missing_regions", sql=f"""
WITH s AS (SELECT * FROM (SELECT *, lead(coord_value) OVER w AS nv, lead(cx) OVER w AS nx, lead(cy) OVER w AS ny FROM det WHERE cls = 'coordinate' WINDOW w AS (PARTITION BY layout_id, page ORDER BY coord_value, row_id)) WHERE nv - coord_value > 2.0),
o AS (SELECT * FROM det a WHERE cls IN ('signal', 'gks_gesteuert', 'gks_festkodiert', 'weichen_block') AND NOT EXISTS (SELECT 1 FROM det b WHERE {SAMEPAGE} AND b.cls = 'coordinate' AND {DIST} <= 600)),
{GAPS.replace('> 100', '> 800')}, k AS (SELECT layout_id, page FROM det GROUP BY ALL HAVING count(*) FILTER (cls IN {sql_list(R.NEED_TEXT)}) >= 3 AND count(*) FILTER (cls = 'coordinate') >= 2),
i AS (SELECT g.layout_id, g.page, g1, g2, avg(cx) AS mx FROM g JOIN k ON g.layout_id = k.layout_id AND g.page = k.page JOIN det d ON d.layout_id = g.layout_id AND d.page = g.page AND d.cls IN {sql_list(R.NEED_TEXT)} AND d.cy > g1 AND d.cy < g2 GROUP BY ALL),
u AS (SELECT layout_id, page, 'coordinate_gap' AS region_type, (cx + nx) / 2 AS xc, (cy + ny) / 2 AS yc, least(0.9, (nv - coord_value) / 5.0) AS confidence FROM s
UNION ALL SELECT layout_id, page, 'orphaned_object', cx, cy - 150, 0.7 FROM o UNION ALL SELECT layout_id, page, 'pattern_break', mx, (g1 + g2) / 2, 0.8 FROM i)
SELECT layout_id, page, region_type, round(xc, 6) AS xc, yc, round(confidence, 6) AS confidence FROM u""")
def m1(t):
    return X.missing_regions(t.det).select(*KEYS, "region_type", F.round("xc", 6).alias("xc"), "yc", F.round("confidence", 6).alias("confidence"))


@query("j18_prefer_primary", sql=f"SELECT b.layout_id, b.row_id, b.cls FROM det b WHERE b.cls IN ('haltetafel', 'weichenende') AND NOT EXISTS (SELECT 1 FROM det a WHERE a.cls NOT IN ('haltetafel', 'weichenende') AND {SAMEPAGE} AND {IOU} > 0.2)")
def j18(t):
    own = t.det.filter(C("cls").isin("haltetafel", "weichenende"))
    return tracks.prefer_primary(t.det.filter(~C("cls").isin("haltetafel", "weichenende")), own, 0.2).select("layout_id", "row_id", "cls")


@query("j19_only_new", "det det2", sql=f"""
WITH new AS (SELECT * REPLACE (cx + 60 AS cx) FROM det2), f AS (SELECT b.* FROM new b WHERE NOT EXISTS (SELECT 1 FROM det a WHERE {SAMEPAGE} AND a.cls = b.cls AND {DIST} < 100)),
k AS (SELECT *, row_number() OVER (PARTITION BY layout_id, page, round_even(cx / 10, 0), round_even(cy / 10, 0) ORDER BY row_id) AS n FROM new
  WHERE NOT EXISTS (SELECT 1 FROM det a WHERE a.layout_id = new.layout_id AND a.page = new.page AND round_even(a.cx / 10, 0) = round_even(new.cx / 10, 0) AND round_even(a.cy / 10, 0) = round_even(new.cy / 10, 0)))
SELECT layout_id, row_id, 'near' AS rule FROM f UNION ALL SELECT layout_id, row_id, 'grid' FROM k WHERE n = 1""")
def j19(t):
    new, old = t.det2.withColumn("cx", C("cx") + 60), t.det
    a = tracks.only_new(new, old, 100.0).select("layout_id", "row_id", F.lit("near").alias("rule"))
    return a.unionByName(tracks.only_new_on_grid(new, old).select("layout_id", "row_id", F.lit("grid").alias("rule")))


@query("j16_nms")
def j16(t):
    wide = t.det.withColumns({"x1": C("cx") - 60, "x2": C("cx") + 60, "y1": C("cy") - 60, "y2": C("cy") + 60})
    return tracks.nms(wide).select("layout_id", "row_id", "cls", "conf")


@query("j17_suppress_centers")
def j17(t):
    return tracks.suppress_centers(t.det).select("layout_id", "row_id", "cls", "conf")


@query("a18_track_bounds", "px det sheets", sql="""
SELECT s.layout_id, s.page, CAST(coalesce(min(x), 0) AS BIGINT) AS x_min, CAST(coalesce(max(x), any_value(width)) AS BIGINT) AS x_max, CAST(coalesce(min(y), 0) AS BIGINT) AS y_min, CAST(coalesce(max(y), any_value(height)) AS BIGINT) AS y_max
FROM sheets s LEFT JOIN px p ON s.layout_id = p.layout_id AND s.page = p.page GROUP BY s.layout_id, s.page""")
def a18(t):
    return tracks.track_bounds(t.px, t.sheets)


@query("a19_track_components", "px", sql="""
WITH RECURSIVE c AS (SELECT layout_id, page, y, x, x - row_number() OVER (PARTITION BY layout_id, page, y ORDER BY x) AS g FROM px),
r AS (SELECT layout_id, page, y, min(x) AS x0, max(x) AS x1, count(*) AS n FROM c GROUP BY layout_id, page, y, g),
e AS (SELECT a.layout_id, a.page, a.y AS ay, a.x0 AS ax, b.y AS by_, b.x0 AS bx FROM r a JOIN r b ON a.layout_id = b.layout_id AND a.page = b.page AND abs(a.y - b.y) <= 1 AND a.x0 <= b.x1 + 1 AND b.x0 <= a.x1 + 1 AND (a.y <> b.y OR a.x0 <> b.x0)),
q(layout_id, page, y, x, ry, rx) AS (SELECT layout_id, page, y, x0, y, x0 FROM r UNION SELECT q.layout_id, q.page, q.y, q.x, e.by_, e.bx FROM q JOIN e ON q.layout_id = e.layout_id AND q.page = e.page AND q.ry = e.ay AND q.rx = e.ax),
l AS (SELECT layout_id, page, y, x, min(struct_pack(y := ry, x := rx)) AS rep FROM q GROUP BY ALL),
s AS (SELECT l.layout_id, l.page, rep, sum(n) AS area, min(r.x0) AS x1, max(r.x1) AS x2, min(r.y) AS y1, max(r.y) AS y2 FROM l JOIN r ON l.layout_id = r.layout_id AND l.page = r.page AND l.y = r.y AND l.x = r.x0 GROUP BY ALL)
SELECT layout_id, page, CAST(area AS BIGINT) AS area, x1, y1, x2, y2 FROM s WHERE area >= 3""")
def a19(t):
    return tracks.track_components(t.px, min_area=3, min_aspect=0.0, max_fill=1.0).select("layout_id", "page", "area", "x1", "y1", "x2", "y2")


@query("v6_full_validation")
def v6(t):
    return X.validate(t.det, stop_name="name_text")


@query("v6_issue_counts")
def v6c(t):
    return X.validate(t.det, stop_name="name_text").groupBy("layout_id", "severity", "category").agg(F.count(F.lit(1)).alias("n"))
