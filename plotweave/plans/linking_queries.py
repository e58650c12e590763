"""Links, directions, merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from plotweave import rules as R
from plotweave.operators import direction as D
from plotweave.operators import linking as L
from plotweave.operators import metrics as M
from plotweave.operators import tracks
from plotweave.plans.check_queries import symbol_dim
from plotweave.plans.registry import query, sql_case, sql_list

C = F.col
KEYS = ["layout_id", "page"]
NEED = ["layout_id", "page", "row_id"]


def coords(t):
    return t.det.filter(C("cls") == "coordinate")


def anchors(t):
    return t.det.filter(C("cls") != "coordinate")


def signals(t):
    return t.det.filter(C("cls") == "signal")


def gks(t):
    return t.det.filter(C("cls").isin(R.GKS))


def _rule(name, default, key="a.cls"):
    def lit(v):
        return ("TRUE" if v else "FALSE") if isinstance(v, bool) else f"'{v}'" if isinstance(v, str) else str(v)
    rows = " ".join(f"WHEN '{c}' THEN {lit(r[name])}" for c, r in R.with_spellings(R.LINK).items() if name in r)
    return f"CASE {key} {rows} ELSE {lit(default)} END" if rows else lit(default)


def _tier():
    out = "CASE WHEN dy <= 1.6 * ah THEN 0 "
    for c, r in R.LINK.items():
        for k, s in enumerate(r.get("steps", []), 1):
            out += f"WHEN cls = '{c}' AND dy <= 1.6 * ah * {s} THEN {k} "
    return out + "END"


TURNED = "abs(a.angle) > 12.15"
LX = "((b.cx - a.cx) * cos(-radians(a.angle)) - (b.cy - a.cy) * sin(-radians(a.angle)))"
LY = "((b.cx - a.cx) * sin(-radians(a.angle)) + (b.cy - a.cy) * cos(-radians(a.angle)))"
DIRECTED = f"""CASE {_rule('mode', 'either')} WHEN 'either' THEN TRUE WHEN 'inside' THEN b.cx BETWEEN a.x1 AND a.x2 AND b.cy BETWEEN a.y1 AND a.y2
  ELSE CASE WHEN {TURNED} AND NOT {_rule('axis', False)}
    THEN CASE {_rule('mode', 'either')} WHEN 'below' THEN {LY} > 0 WHEN 'above' THEN {LY} < 0 ELSE {LX} >= 0 OR {LY} > 0 END
    ELSE CASE {_rule('mode', 'either')} WHEN 'below' THEN b.cy > a.cy WHEN 'above' THEN b.cy < a.cy ELSE b.x1 >= a.x2 - 0.3 * a.w OR b.cy > a.cy + 0.3 * a.h END END END"""
CANDS = f"""c0 AS (SELECT a.layout_id, a.page, a.row_id, a.cls, b.row_id AS coord_id, a.h AS ah, {TURNED} AS turned, abs(CASE WHEN {TURNED} THEN {LX} ELSE b.cx - a.cx END) AS dx, abs(CASE WHEN {TURNED} THEN {LY} ELSE b.cy - a.cy END) AS dy,
  {DIRECTED} AS ok, greatest(CAST({_rule('dx', 1.0)} AS DOUBLE) * CAST(0.6 AS DOUBLE) * greatest(a.w, b.w), 30.0) * CASE WHEN {_rule('left', False)} AND NOT ({TURNED}) AND b.cx < a.cx THEN 1.3 ELSE 1.0 END AS dmax,
  -greatest(0.0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) AS xo, {_rule('horizontal', False)} AS flat, b.cx - a.cx AS off_x, b.cy - a.cy AS off_y
  FROM det a JOIN det b ON a.layout_id = b.layout_id AND a.page = b.page AND b.cls = 'coordinate' AND a.cls <> 'coordinate'),
cand AS (SELECT *, {_tier()} AS tier, round(CASE WHEN turned THEN sqrt(dx * dx + dy * dy) WHEN flat THEN dx ELSE dy END, 9) AS s1, round(CASE WHEN turned THEN xo WHEN flat THEN dy ELSE dx END, 9) AS s2, CASE WHEN turned THEN 0.0 ELSE xo END AS s3
  FROM c0 WHERE ok AND dx <= dmax AND {_tier()} IS NOT NULL),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY layout_id, row_id ORDER BY tier, s1, s2, s3, coord_id) AS rn FROM cand) WHERE rn = 1)"""


def cands(t):
    return L.link_candidates(anchors(t), coords(t)).withColumns({"s1": F.round("s1", 9), "s2": F.round("s2", 9)})


@query("j1_link_candidates", sql=f"WITH {CANDS} SELECT layout_id, page, row_id, cls, coord_id, tier, s1, s2, s3, off_x, off_y FROM cand")
def j1(t):
    return cands(t)


@query("j2_best_link", sql=f"WITH {CANDS} SELECT layout_id, page, row_id, cls, coord_id, tier, off_x, off_y FROM best")
def j2(t):
    return L.best_link(L.link_candidates(anchors(t), L.coord_shapes(coords(t))))


@query("a17_link_patterns", sql=f"WITH {CANDS} SELECT layout_id, page, cls, count(*) AS n, round(avg(off_x), 6) AS mean_dx, round(stddev_pop(off_x), 6) AS sd_dx, round(avg(off_y), 6) AS mean_dy, round(stddev_pop(off_y), 6) AS sd_dy FROM best GROUP BY ALL")
def a17(t):
    d = L.link_patterns(L.best_link(cands(t)))
    return d.withColumns({c: F.round(c, 6) for c in ("mean_dx", "sd_dx", "mean_dy", "sd_dy")})


PATTERNS = "pat AS (SELECT layout_id, cls, count(*) AS n, avg(off_x) AS mx, stddev_pop(off_x) AS sx, avg(off_y) AS my, stddev_pop(off_y) AS sy FROM best GROUP BY ALL HAVING count(*) >= 2)"


@query("j3_link_adaptive", sql=f"""WITH {CANDS}, {PATTERNS.replace('layout_id, cls', 'layout_id, page, cls')},
u AS (SELECT d.*, mx, sx, my, sy FROM det d JOIN pat p ON d.layout_id = p.layout_id AND d.page = p.page AND d.cls = p.cls WHERE NOT EXISTS (SELECT 1 FROM best b WHERE b.layout_id = d.layout_id AND b.row_id = d.row_id)),
x AS (SELECT u.layout_id, u.page, u.row_id, b.row_id AS coord_id, sqrt((b.cx - u.cx - mx) * (b.cx - u.cx - mx) + (b.cy - u.cy - my) * (b.cy - u.cy - my)) AS dist FROM u JOIN det b ON b.cls = 'coordinate' AND u.layout_id = b.layout_id AND u.page = b.page
  AND abs(b.cx - u.cx - mx) < greatest(3 * sx, 150) AND abs(b.cy - u.cy - my) < greatest(3 * sy, 80))
SELECT layout_id, page, row_id, coord_id, round(dist, 6) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY layout_id, row_id ORDER BY dist, coord_id) AS n FROM x) WHERE n = 1""")
def j3(t):
    best = L.best_link(cands(t))
    left = anchors(t).join(best.select(*NEED), NEED, "left_anti")
    return L.link_adaptive(left, coords(t), L.link_patterns(best)).withColumn("dist", F.round("dist", 6))


@query("j4_assign_coordinates")
def j4(t):
    return L.assign_coordinates(anchors(t), coords(t))


DIST = "sqrt((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy))"


@query("j5_inherit_from_nearest", sql=f"""WITH {CANDS},
n AS (SELECT a.layout_id, a.page, a.row_id, b.row_id AS gks_id, row_number() OVER (PARTITION BY a.layout_id, a.row_id ORDER BY {DIST}, b.row_id) AS k FROM det a JOIN det b ON a.layout_id = b.layout_id AND a.page = b.page AND a.cls = 'haltetafel' AND b.cls = 'gks_festkodiert'
  WHERE {DIST} < 250 AND abs(a.cx - b.cx) < 300 AND abs(a.cy - b.cy) < 100)
SELECT n.layout_id, n.page, n.row_id, gks_id, coord_id FROM n JOIN best ON n.layout_id = best.layout_id AND n.gks_id = best.row_id WHERE k = 1""")
def j5(t):
    links = L.best_link(cands(t)).filter(C("cls") == "gks_festkodiert")
    return L.inherit_from_nearest(t.det.filter(C("cls") == "haltetafel"), t.det.filter(C("cls") == "gks_festkodiert"), links)


TURN6 = "abs(a.angle) > 15"
DX6, DY6 = f"(CASE WHEN {TURN6} THEN {LX} ELSE b.cx - a.cx END)", f"(CASE WHEN {TURN6} THEN {LY} ELSE b.cy - a.cy END)"
AD = "(CASE WHEN abs(a.angle - b.angle) > 180 THEN 360 - abs(a.angle - b.angle) ELSE abs(a.angle - b.angle) END)"
TRIPLES = f"""s6 AS (SELECT * FROM (SELECT a.layout_id, a.page, a.row_id, a.cx, a.cy, a.angle, b.row_id AS signal_id, b.anchor_text AS signal_text, {DY6} AS sdy, row_number() OVER (PARTITION BY a.layout_id, a.row_id ORDER BY {DIST}, b.row_id) AS k
  FROM det a JOIN det b ON a.layout_id = b.layout_id AND a.page = b.page AND a.cls = 'haltepunkt' AND b.cls = 'signal' WHERE {DIST} <= 250 AND (NOT {TURN6} OR {AD} <= 20) AND abs({DY6}) > 30 AND abs({DY6}) < 200 AND abs({DX6}) < 100) WHERE k = 1),
c6 AS (SELECT * FROM (SELECT a.layout_id, a.row_id, b.row_id AS coord_id, b.coord_text, row_number() OVER (PARTITION BY a.layout_id, a.row_id ORDER BY {DIST}, b.row_id) AS k
  FROM s6 a JOIN det b ON a.layout_id = b.layout_id AND a.page = b.page AND b.cls = 'coordinate' WHERE abs({DX6}) < 100 AND CASE WHEN sdy > 0 THEN {DY6} > 0 AND {DY6} < sdy ELSE {DY6} < 0 AND {DY6} > sdy END) WHERE k = 1),
t6 AS (SELECT s6.layout_id, page, s6.row_id, signal_id, signal_text, coord_id, coord_text FROM s6 LEFT JOIN c6 ON s6.layout_id = c6.layout_id AND s6.row_id = c6.row_id)"""


def triples(t):
    stops = t.det.filter(C("cls") == "haltepunkt")
    return L.link_triples(stops, signals(t).withColumn("txt", C("anchor_text")), coords(t).withColumn("txt", C("coord_text")))


@query("j6_link_triples", sql=f"WITH {TRIPLES} SELECT * FROM t6")
def j6(t):
    return triples(t)


@query("j6_drop_referenced", sql=f"WITH {TRIPLES} SELECT layout_id, page, row_id FROM det d WHERE cls = 'signal' AND NOT EXISTS (SELECT 1 FROM t6 WHERE t6.layout_id = d.layout_id AND t6.signal_id = d.row_id)")
def j6b(t):
    return L.drop_referenced(signals(t), triples(t)).select(*NEED)


@query("j7_link_radial", sql=f"""WITH {CANDS}, cl AS (SELECT DISTINCT layout_id, coord_id FROM best WHERE cls IN ('gks_gesteuert', 'gks_festkodiert')),
x AS (SELECT a.layout_id, a.page, a.row_id, b.row_id AS coord_id, {DIST} AS dist FROM det a JOIN det b ON a.layout_id = b.layout_id AND a.page = b.page AND a.cls = 'isolierstoss' AND b.cls = 'coordinate' AND {DIST} <= 300
  WHERE NOT EXISTS (SELECT 1 FROM cl WHERE cl.layout_id = b.layout_id AND cl.coord_id = b.row_id))
SELECT layout_id, page, row_id, coord_id, round(dist, 6) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY layout_id, row_id ORDER BY dist, coord_id) AS n FROM x) WHERE n = 1""")
def j7(t):
    claimed = L.best_link(cands(t)).filter(C("cls").isin(R.GKS))
    return L.link_radial(t.det.filter(C("cls") == "isolierstoss"), coords(t), claimed).withColumn("dist", F.round("dist", 6))


def _symbol_sql(turn: bool):
    lx, ly = (LX, LY) if turn else ("(b.cx - a.cx)", "(b.cy - a.cy)")
    return f"""SELECT layout_id, page, row_id, cls, coord_id, round(d, 6) AS link_distance FROM (SELECT *, row_number() OVER (PARTITION BY layout_id, row_id ORDER BY d, coord_id) AS n FROM (
SELECT a.layout_id, a.page, a.row_id, a.cls, b.row_id AS coord_id, {DIST} AS d FROM sym a JOIN det b ON a.layout_id = b.layout_id AND a.page = b.page AND b.cls = 'coordinate'
WHERE a.cls IN ('raute', 'dreieck') AND {DIST} <= CASE a.cls WHEN 'raute' THEN 150 ELSE 180 END AND (a.cls = 'dreieck' OR {ly} > 0 OR {lx} > 0))) WHERE n = 1"""


@query("j8_link_symbols", "sym", sql=_symbol_sql(True))
def j8(t):
    return L.link_symbols(t.sym, coords(t), symbol_dim(t)).withColumn("link_distance", F.round("link_distance", 6))


@query("j9_link_symbols_axis", "sym", sql=_symbol_sql(False))
def j9(t):
    return L.link_symbols(t.sym, coords(t), symbol_dim(t), rotate=False).withColumn("link_distance", F.round("link_distance", 6))


EXEMPT = "(starts_with(upper(trim(a.anchor_text)), 'V') OR regexp_matches(upper(trim(a.anchor_text)), '^\\p{L}\\d{3,}$'))"
RAW = "(CASE WHEN w > h * 1.2 AND abs(angle) BETWEEN 75 AND 105 THEN angle - 90 WHEN h > w * 1.2 AND (abs(angle) < 15 OR abs(angle - 180) < 15) THEN angle + 90 ELSE angle END)"
SIG = f"""sg AS (SELECT *, {RAW} AS turn, ((({RAW} % 360) + 360) % 360) AS tn FROM det a WHERE cls = 'signal' AND NOT {EXEMPT}),
si AS (SELECT *, CASE WHEN least(tn, 360 - tn) <= 12 OR abs(tn - 180) <= 12 THEN 'horizontal' WHEN abs(tn - 90) <= 12 OR abs(tn - 270) <= 12 THEN 'vertical' ELSE 'angular' END AS kind FROM sg)"""
TLX = "((b.cx - a.cx) * cos(-radians(a.turn)) - (b.cy - a.cy) * sin(-radians(a.turn)))"
TLY = "((b.cx - a.cx) * sin(-radians(a.turn)) + (b.cy - a.cy) * cos(-radians(a.turn)))"
GJOIN = "JOIN det b ON a.layout_id = b.layout_id AND a.page = b.page AND b.cls IN ('gks_gesteuert', 'gks_festkodiert')"
STRICT = f"""d1 AS (SELECT layout_id, page, row_id, gks_id, CASE WHEN v > 30 AND v < 200 AND abs(s) < 120 THEN 'B' WHEN v < -30 AND v > -200 AND abs(s) < 120 THEN 'A' END AS direction FROM (SELECT * FROM (
  SELECT a.layout_id, a.page, a.row_id, b.row_id AS gks_id, CASE kind WHEN 'angular' THEN {TLY} WHEN 'vertical' THEN b.cx - a.cx ELSE b.cy - a.cy END AS v, CASE kind WHEN 'angular' THEN {TLX} WHEN 'vertical' THEN b.cy - a.cy ELSE b.cx - a.cx END AS s,
  row_number() OVER (PARTITION BY a.layout_id, a.row_id ORDER BY {DIST}, b.row_id) AS k FROM si a {GJOIN} WHERE {DIST} <= 250 AND (kind <> 'angular' OR {AD} <= 20)) WHERE k = 1))"""
RELAX = f"""d3 AS (SELECT layout_id, page, row_id, gks_id, CASE WHEN dy < 0 THEN 'A' ELSE 'B' END AS direction FROM (SELECT a.layout_id, a.page, a.row_id, b.row_id AS gks_id, b.cy - a.cy AS dy, row_number() OVER (PARTITION BY a.layout_id, a.row_id ORDER BY abs(b.cy - a.cy), b.row_id) AS k
  FROM si a {GJOIN} WHERE abs(b.cx - a.cx) <= 200 AND abs(b.cy - a.cy) BETWEEN 30 AND 600 AND abs(b.cy - a.cy) >= abs(b.cx - a.cx) AND {AD} <= 25) WHERE k = 1)"""
NEAREST = f"""d4 AS (SELECT layout_id, page, row_id, gks_id, CASE WHEN dy < 0 THEN 'A' ELSE 'B' END AS direction FROM (SELECT a.layout_id, a.page, a.row_id, b.row_id AS gks_id, b.cy - a.cy AS dy, row_number() OVER (PARTITION BY a.layout_id, a.row_id ORDER BY {DIST}, b.row_id) AS k
  FROM si a {GJOIN} WHERE {DIST} <= 800 AND abs(b.cy - a.cy) >= 30 AND abs(b.cy - a.cy) >= abs(b.cx - a.cx) * 0.5 AND {AD} <= 30) WHERE k = 1)"""


@query("j10_direction_strict", sql=f"WITH {SIG}, {STRICT} SELECT * FROM d1 WHERE direction IS NOT NULL")
def j10(t):
    return D.direction_strict(signals(t), gks(t)).select(*NEED, "gks_id", "direction")


def _ray(sign):
    """Smallest seen step over all pixels of the page for one ray."""
    def lo(u, o, p):
        return f"(CASE WHEN abs({u}) < 1e-12 THEN CASE WHEN {p} >= {o} - 25 AND {p} < {o} + 25 THEN 1 ELSE 1e9 END WHEN {u} > 0 THEN ceil(({p} - 24 - {o}) / {u}) ELSE floor(({p} + 26 - {o}) / {u}) + 1 END)"

    def hi(u, o, p):
        return f"(CASE WHEN abs({u}) < 1e-12 THEN CASE WHEN {p} >= {o} - 25 AND {p} < {o} + 25 THEN 1e9 ELSE 0 END WHEN {u} > 0 THEN ceil(({p} + 26 - {o}) / {u}) - 1 ELSE floor(({p} - 24 - {o}) / {u}) END)"

    ux, uy = f"{sign}ux", f"{sign}uy"
    n = "above" if sign == "" else "below"
    length = "len_up" if sign == "" else "len_down"
    return (f"{n} AS (SELECT layout_id, row_id, min(l) AS d FROM (SELECT g.layout_id, g.row_id, sx, sy, {ux} AS vx, {uy} AS vy, width, height, greatest({lo(ux, 'sx', 'x')}, {lo(uy, 'sy', 'y')}, 1) AS l, least({hi(ux, 'sx', 'x')}, {hi(uy, 'sy', 'y')}, {length}) AS h "
            f"FROM ry g JOIN px p ON g.layout_id = p.layout_id AND g.page = p.page) WHERE l <= h AND floor(sx + l * vx) >= 0 AND floor(sx + l * vx) < width AND floor(sy + l * vy) >= 0 AND floor(sy + l * vy) < height GROUP BY ALL)")


TRACK = f"""bd AS (SELECT layout_id, page, min(y) AS py0, max(y) AS py1 FROM px GROUP BY ALL),
ry AS (SELECT a.layout_id, a.page, a.row_id, CAST(trunc(cx) AS INT) AS sx, CAST(trunc(cy) AS INT) AS sy, kind, width, height, CASE WHEN kind = 'angular' THEN cos(radians(turn + 90)) ELSE 0.0 END AS ux, CASE WHEN kind = 'angular' THEN sin(radians(turn + 90)) ELSE -1.0 END AS uy,
  least(1500, CASE WHEN kind = 'angular' OR py0 IS NULL THEN greatest(width, height) ELSE trunc(cy) - py0 END) AS len_up, least(1500, CASE WHEN kind = 'angular' OR py0 IS NULL THEN greatest(width, height) ELSE py1 - trunc(cy) END) AS len_down
  FROM si a JOIN sheets s ON a.layout_id = s.layout_id AND a.page = s.page LEFT JOIN bd ON a.layout_id = bd.layout_id AND a.page = bd.page),
{_ray('')}, {_ray('-')},
d2 AS (SELECT r.layout_id, r.page, r.row_id, CASE WHEN (u.d IS NOT NULL AND (w.d IS NULL OR u.d < w.d)) = (kind <> 'angular') THEN 'A' ELSE 'B' END AS direction, u.d AS above, w.d AS below FROM ry r LEFT JOIN above u ON r.layout_id = u.layout_id AND r.row_id = u.row_id
  LEFT JOIN below w ON r.layout_id = w.layout_id AND r.row_id = w.row_id WHERE u.d IS NOT NULL OR w.d IS NOT NULL)"""


@query("j11_direction_track", "det px sheets", sql=f"WITH {SIG}, {TRACK} SELECT layout_id, page, row_id, direction, CAST(above AS BIGINT) AS above, CAST(below AS BIGINT) AS below FROM d2")
def j11(t):
    return D.direction_track(signals(t), t.px, tracks.track_bounds(t.px, t.sheets), t.sheets)


@query("j12_direction_relaxed", sql=f"WITH {SIG}, {RELAX} SELECT * FROM d3")
def j12(t):
    return D.direction_relaxed(signals(t), gks(t)).select(*NEED, "gks_id", "direction")


@query("j13_direction_nearest", sql=f"WITH {SIG}, {NEAREST} SELECT * FROM d4")
def j13(t):
    return D.direction_nearest(signals(t), gks(t)).select(*NEED, "gks_id", "direction")


@query("j14_resolve_direction", "det px sheets", sql=f"""WITH {SIG}, {STRICT}, {TRACK}, {RELAX}, {NEAREST}
SELECT s.layout_id, s.page, s.row_id, coalesce(nullif(s.fahrtrichtung, ''), d1.direction, d2.direction, d3.direction, d4.direction) AS fahrtrichtung,
  CASE WHEN coalesce(s.fahrtrichtung, '') <> '' THEN direction_source WHEN d1.direction IS NOT NULL THEN 'gks' WHEN d2.direction IS NOT NULL THEN 'track' WHEN d3.direction IS NOT NULL THEN 'gks_relaxed' WHEN d4.direction IS NOT NULL THEN 'gks_nearest' ELSE 'none' END AS direction_source
FROM det s LEFT JOIN d1 ON s.layout_id = d1.layout_id AND s.row_id = d1.row_id LEFT JOIN d2 ON s.layout_id = d2.layout_id AND s.row_id = d2.row_id LEFT JOIN d3 ON s.layout_id = d3.layout_id AND s.row_id = d3.row_id LEFT JOIN d4 ON s.layout_id = d4.layout_id AND s.row_id = d4.row_id
WHERE s.cls = 'signal'""")
def j14(t):
    d = D.resolve_direction(signals(t), t.px, tracks.track_bounds(t.px, t.sheets), t.sheets, gks(t))
    return d.select(*NEED, "fahrtrichtung", "direction_source")


@query("j15_attach_link_ids", sql="""
WITH v AS (SELECT layout_id, row_id, cls, coord_text, x1 AS cx1, y1 AS cy1 FROM det UNION ALL SELECT layout_id, -1 - row_id, 'signal', coord_text, x1, y1 FROM det WHERE cls = 'coordinate'),
c AS (SELECT layout_id, coord_text AS ct, cx1 AS kx, cy1 AS ky, min(row_id) AS id FROM v WHERE cls = 'coordinate' AND coord_text IS NOT NULL GROUP BY ALL)
SELECT v.layout_id, v.row_id, CASE WHEN v.cls <> 'coordinate' THEN id END AS link_coord_row_id FROM v LEFT JOIN c ON v.layout_id = c.layout_id AND v.coord_text = ct AND v.cx1 = kx AND v.cy1 = ky""")
def j15(t):
    # every coordinate is also there as a linked anchor that carries its text and box
    d = t.det.select("layout_id", "row_id", "cls", "coord_text", C("x1").alias("cx1"), C("y1").alias("cy1"))
    linked = d.filter(C("cls") == "coordinate").select("layout_id", (-1 - C("row_id")).alias("row_id"), F.lit("signal").alias("cls"), "coord_text", "cx1", "cy1")
    return L.attach_link_ids(d.unionByName(linked)).select("layout_id", "row_id", "link_coord_row_id")


@query("j28_linked_coordinates", sql="SELECT layout_id, row_id, coord_text FROM det a WHERE cls = 'coordinate' AND EXISTS (SELECT 1 FROM det b WHERE b.cls <> 'coordinate' AND b.layout_id = a.layout_id AND trim(b.coord_text) = trim(a.coord_text))")
def j28(t):
    return L.linked_coordinates(t.det).select("layout_id", "row_id", "coord_text")


@query("u5_unclaimed_coordinates", sql=f"WITH {CANDS} SELECT layout_id, page, row_id FROM det d WHERE cls = 'coordinate' AND NOT EXISTS (SELECT 1 FROM best b WHERE b.layout_id = d.layout_id AND b.coord_id = d.row_id)")
def u5(t):
    return L.unclaimed(coords(t), L.best_link(cands(t))).select(*NEED)


@query("w4_generated_names", sql=f"""WITH {TRIPLES}
SELECT layout_id, page, row_id, cls, cls || ' ' || row_number() OVER (PARTITION BY layout_id, page, cls ORDER BY row_id) AS name FROM det WHERE cls IN {sql_list([c for c in R.GENERATED_NAME if c != 'haltepunkt'])}
UNION ALL SELECT d.layout_id, d.page, d.row_id, cls, 'haltepunkt ' || row_number() OVER (PARTITION BY d.layout_id ORDER BY d.row_id) || CASE WHEN trim(coalesce(signal_text, '')) <> '' THEN ' (' || signal_text || ')' ELSE '' END FROM det d LEFT JOIN t6 ON d.layout_id = t6.layout_id AND d.row_id = t6.row_id WHERE cls = 'haltepunkt'""")
def w4(t):
    return L.generated_names(t.det, triples(t))


RADIUS = """sg20 AS (SELECT layout_id, cy, row_id FROM det WHERE cls = 'signal' AND anchor_text <> ''), gp AS (SELECT * FROM (SELECT layout_id, lead(cy) OVER (PARTITION BY layout_id ORDER BY cy, row_id) - cy AS gap FROM sg20) WHERE gap IS NOT NULL),
md AS (SELECT layout_id, list_sort(list(gap))[len(list(gap)) // 2 + 1] AS mid FROM gp GROUP BY ALL), lg AS (SELECT gp.layout_id, avg(gap) AS ml FROM gp JOIN md ON gp.layout_id = md.layout_id WHERE gap > mid * 3 GROUP BY ALL),
rd AS (SELECT s.layout_id, count(*) AS signals, CASE WHEN count(*) < 10 THEN 1500 WHEN any_value(ml) IS NULL THEN 1000 ELSE greatest(1000, least(2500, CAST(trunc(any_value(ml) * 0.4) AS INT))) END AS radius FROM sg20 s LEFT JOIN lg ON s.layout_id = lg.layout_id GROUP BY ALL)"""


@query("a20_cluster_radius", sql=f"WITH {RADIUS} SELECT * FROM rd")
def a20(t):
    return D.cluster_radius(t.det)


def stop_coords(t):
    tr = triples(t).filter(C("coord_text").isNotNull())
    return tr.groupBy(*KEYS, F.trim("signal_text").alias("name")).agg(F.max(F.struct("row_id", "coord_text")).alias("m")).select(*KEYS, "name", C("m.coord_text").alias("stop_coord"))


NEAR = "sqrt((s.x - c.x / c.n) * (s.x - c.x / c.n) + (s.y - c.y / c.n) * (s.y - c.y / c.n))"
TURN = "{'cy': cy, 'cx': cx, 'row_id': row_id, 'fahrtrichtung': fahrtrichtung, 'x1': x1, 'y2': y2}"
# one position a step; cs holds the sums of the centres so far
MERGED = f"""{RADIUS}, {TRIPLES}, sc AS (SELECT layout_id, page, trim(signal_text) AS name, arg_max(coord_text, row_id) AS stop_coord FROM t6 WHERE coord_text IS NOT NULL GROUP BY ALL),
sn AS (SELECT *, trim(anchor_text) AS name FROM det WHERE cls = 'signal' AND trim(coalesce(anchor_text, '')) <> ''),
sp AS (SELECT *, row_number() OVER (PARTITION BY layout_id, page, name ORDER BY y, x) AS k, sum(n) OVER (PARTITION BY layout_id, page, name) AS total FROM (SELECT layout_id, page, name, cx AS x, cy AS y, count(*) AS n FROM sn GROUP BY ALL)),
so AS MATERIALIZED (SELECT sp.*, CAST(radius AS DOUBLE) AS radius FROM sp JOIN rd ON sp.layout_id = rd.layout_id WHERE total > 1),
cl AS (SELECT layout_id, page, name, k, x, y, CAST(1 AS BIGINT) AS cluster, [{{'x': x * n, 'y': y * n, 'n': n}}] AS cs FROM so WHERE k = 1
  UNION ALL SELECT layout_id, page, name, k, x, y, cluster, CASE WHEN cluster > len(cs) THEN list_append(cs, {{'x': x * n, 'y': y * n, 'n': n}})
    ELSE list_transform(cs, lambda c, i: CASE WHEN i = cluster THEN {{'x': c.x + x * n, 'y': c.y + y * n, 'n': c.n + n}} ELSE c END) END AS cs
  FROM (SELECT *, CAST(CASE WHEN list_min(ds) < radius THEN list_position(ds, list_min(ds)) ELSE len(cs) + 1 END AS BIGINT) AS cluster
    FROM (SELECT s.*, cl.cs, list_transform(cl.cs, lambda c: {NEAR}) AS ds FROM cl JOIN so s ON s.layout_id = cl.layout_id AND s.page = cl.page AND s.name = cl.name AND s.k = cl.k + 1))),
cm AS (SELECT * FROM (SELECT sn.*, cluster, stop_coord, count(*) OVER (PARTITION BY sn.layout_id, sn.page, sn.name, cluster) AS members
  FROM sn JOIN cl ON sn.layout_id = cl.layout_id AND sn.page = cl.page AND sn.name = cl.name AND sn.cx = cl.x AND sn.cy = cl.y
  LEFT JOIN sc ON sn.layout_id = sc.layout_id AND sn.page = sc.page AND sn.name = sc.name) WHERE members > 1),
ro AS (SELECT *, CASE WHEN coalesce(coord_text, '') <> '' THEN CASE WHEN coalesce(fahrtrichtung, '') <> '' THEN 'both' WHEN coord_text IS DISTINCT FROM stop_coord THEN 'coord' ELSE 'stop' END
    WHEN coalesce(fahrtrichtung, '') <> '' THEN 'direction' ELSE 'stop' END AS role,
  abs(TRY_CAST(replace(coord_text, ',', '.') AS DOUBLE) - TRY_CAST(replace(stop_coord, ',', '.') AS DOUBLE)) AS km FROM cm),
pk AS (SELECT layout_id, page, name, cluster, min(CASE WHEN role = 'coord' THEN {TURN} END) AS c, min(CASE WHEN role = 'coord' THEN {{'far': -coalesce(km, 0), 't': {TURN}}} END).t AS cf,
  max(stop_coord) IS NOT NULL AND count(*) FILTER (role = 'coord') > 0 AND count(*) FILTER (role = 'coord' AND km IS NULL) = 0 AS far,
  min(CASE WHEN role = 'both' THEN {TURN} END) AS b, min(CASE WHEN role = 'both' AND direction_source = 'gks' THEN {TURN} END) AS bg,
  min(CASE WHEN role = 'direction' THEN {TURN} END) AS f, min(CASE WHEN role = 'stop' THEN {TURN} END) AS h FROM ro GROUP BY ALL),
pr AS (SELECT *, coalesce(CASE WHEN far THEN cf ELSE c END, b) AS p, coalesce(f.fahrtrichtung, CASE WHEN c IS NOT NULL THEN bg.fahrtrichtung WHEN bg.row_id = b.row_id THEN b.fahrtrichtung END) AS dir FROM pk),
mg AS (SELECT ro.layout_id, ro.row_id, ro.row_id = p.row_id AS own, CASE WHEN p IS NULL THEN role = 'stop' ELSE ro.row_id <> p.row_id AND (role <> 'coord' OR far) END AS gone, dir, p, f, pr.h
  FROM ro JOIN pr ON ro.layout_id = pr.layout_id AND ro.page = pr.page AND ro.name = pr.name AND ro.cluster = pr.cluster)"""


@query("a21_merge_signals", sql=f"""WITH RECURSIVE {MERGED}
SELECT d.layout_id, d.page, d.row_id, d.anchor_text, CASE WHEN own THEN dir ELSE d.fahrtrichtung END AS fahrtrichtung, CASE WHEN own THEN CASE WHEN dir IS NOT NULL THEN 'gks' ELSE 'none' END ELSE d.direction_source END AS direction_source,
  coalesce(own, FALSE) AS merged, coalesce(gone, FALSE) OR d.hidden AS hidden, CASE WHEN own THEN 1 + CAST(f IS NOT NULL AS INT) + CAST(mg.h IS NOT NULL AS INT) END AS n_positions,
  CASE WHEN own THEN p.x1 END AS coordinate_x1, CASE WHEN own THEN f.y2 END AS direction_y2, CASE WHEN own THEN mg.h.row_id END AS stop_row
FROM det d LEFT JOIN mg ON d.layout_id = mg.layout_id AND d.row_id = mg.row_id WHERE d.cls = 'signal'""")
def a21(t):
    d = D.merge_signals(t.det, D.cluster_radius(t.det), stop_coords(t))
    spot = lambda role, value: C("positions")[role][value]
    return d.filter(C("cls") == "signal").select(
        *NEED, "anchor_text", "fahrtrichtung", "direction_source", "merged", "hidden", F.size("positions").alias("n_positions"),
        spot("coordinate_signal", "x1").alias("coordinate_x1"), spot("fahrtrichtung_signal", "y2").alias("direction_y2"), spot("haltepunkt_signal", "row_id").alias("stop_row"))


NEWNAME = "CASE WHEN r % 3 = 0 THEN upper(trim(anchor_text)) ELSE concat(substr('ABN', CAST(1 + r % 3 AS INT), 1), CAST(10 + r % 30 AS STRING)) END"


def renames(t):
    c = t.corr_log.filter(C("column_name") == "anchor_text").select("layout_id", "row_id").distinct()
    return signals(t).join(c, ["layout_id", "row_id"]).select("layout_id", "row_id", F.expr(NEWNAME).alias("new_name"))


SCORE = "(CASE WHEN coalesce(coord_text, '') <> '' THEN 1000.0 ELSE 0.0 END + conf * 10 + CASE WHEN coalesce(fahrtrichtung, '') <> '' THEN 50.0 ELSE 0.0 END)"
PRIO = "CASE direction_source WHEN 'gks' THEN 4 WHEN 'gks_relaxed' THEN 3 WHEN 'gks_nearest' THEN 2 WHEN 'track' THEN 1 ELSE 0 END"
RENAMED = f"""rn AS (SELECT d.layout_id, d.row_id, {NEWNAME} AS new_name FROM det d WHERE cls = 'signal' AND EXISTS (SELECT 1 FROM corr_log c WHERE c.layout_id = d.layout_id AND c.row_id = d.row_id AND column_name = 'anchor_text'))"""


@query("j34_merge_renamed", "det corr_log", sql=f"""WITH {RENAMED}, s AS (SELECT *, {SCORE} AS score, {PRIO} AS prio FROM det WHERE cls = 'signal' AND NOT hidden),
me AS (SELECT s.*, new_name FROM s JOIN rn ON s.layout_id = rn.layout_id AND s.row_id = rn.row_id),
m AS (SELECT me.layout_id, me.row_id AS renamed_row, new_name, s.row_id, s.score, s.fahrtrichtung, s.prio, s.coord_text, FALSE AS own FROM me JOIN s ON me.layout_id = s.layout_id AND me.page = s.page AND upper(trim(s.anchor_text)) = upper(trim(new_name)) AND s.row_id <> me.row_id
    AND sqrt((s.cx - me.cx) * (s.cx - me.cx) + (s.cy - me.cy) * (s.cy - me.cy)) <= 1500 UNION ALL SELECT layout_id, row_id, new_name, row_id, score, fahrtrichtung, prio, coord_text, TRUE FROM me),
o AS (SELECT *, row_number() OVER (PARTITION BY layout_id, renamed_row ORDER BY score DESC, own DESC, row_id) AS k, count(*) OVER (PARTITION BY layout_id, renamed_row) AS n,
  max(CASE WHEN own THEN nullif(fahrtrichtung, '') END) OVER (PARTITION BY layout_id, renamed_row) AS mine, max(CASE WHEN own THEN prio END) OVER (PARTITION BY layout_id, renamed_row) AS myprio,
  arg_min(CASE WHEN NOT own THEN fahrtrichtung END, CASE WHEN NOT own AND coalesce(fahrtrichtung, '') <> '' THEN row_id END) OVER (PARTITION BY layout_id, renamed_row) AS other FROM m)
SELECT layout_id, renamed_row, new_name, row_id AS primary_row, n - 1 AS hidden_rows, CASE WHEN own THEN coalesce(mine, other) WHEN mine IS NOT NULL AND (fahrtrichtung IS NULL OR myprio > prio) THEN mine ELSE fahrtrichtung END AS fahrtrichtung, coord_text FROM o WHERE k = 1""")
def j34(t):
    return D.merge_renamed(t.det, renames(t))


@query("j35_recompute_direction", "det corr_log", sql=f"""WITH {RENAMED}, si0 AS (SELECT d.* REPLACE (new_name AS anchor_text) FROM det d JOIN rn ON d.layout_id = rn.layout_id AND d.row_id = rn.row_id), {SIG.replace('FROM det a', 'FROM si0 a')}, {STRICT}, {RELAX}, {NEAREST},
sm AS (SELECT a.layout_id, a.row_id, min(b.fahrtrichtung) AS lo, max(b.fahrtrichtung) AS hi FROM si0 a JOIN det b ON b.cls = 'signal' AND a.layout_id = b.layout_id AND a.row_id <> b.row_id AND NOT b.hidden AND b.fahrtrichtung IN ('A', 'B') AND upper(trim(b.anchor_text)) = upper(trim(a.anchor_text)) GROUP BY ALL)
SELECT a.layout_id, a.page, a.row_id, a.anchor_text AS new_name, CASE WHEN NOT {EXEMPT} THEN coalesce(CASE WHEN lo = hi THEN lo END, d1.direction, d3.direction, d4.direction) END AS fahrtrichtung
FROM si0 a LEFT JOIN sm ON a.layout_id = sm.layout_id AND a.row_id = sm.row_id LEFT JOIN d1 ON a.layout_id = d1.layout_id AND a.row_id = d1.row_id LEFT JOIN d3 ON a.layout_id = d3.layout_id AND a.row_id = d3.row_id LEFT JOIN d4 ON a.layout_id = d4.layout_id AND a.row_id = d4.row_id""")
def j35(t):
    return D.recompute_direction(t.det, renames(t), gks(t))


@query("a17_adjustment_stats", "adjust", sql="""
SELECT cls, count(*) AS n, CAST(trunc(avg(offset_x)) AS INT) AS offset_x, CAST(trunc(avg(offset_y)) AS INT) AS offset_y, CAST(trunc(avg(width_delta)) AS INT) AS width_delta, CAST(trunc(avg(height_delta)) AS INT) AS height_delta,
  least(0.95, count(*) / 10.0) AS confidence, count(*) >= 3 AS usable, count(*) = 3 OR (count(*) > 3 AND count(*) % 5 = 0) AS suggest FROM adjust GROUP BY cls""")
def a17b(t):
    return M.adjustment_stats(t.adjust)
