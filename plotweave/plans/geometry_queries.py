"""Geometry functions over old and new versions of the elements."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from plotweave import rules as R
from plotweave.functions import geometry as G
from plotweave.plans.registry import query, sql_case, sql_list

C = F.col
ID = ["layout_id", "row_id"]
INTER = "(greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)))"
AREA = "(({0}.x2 - {0}.x1) * ({0}.y2 - {0}.y1))"
AA, AB = AREA.format("a"), AREA.format("b")
TURN = "(((angle % 360) + 360) % 360)"


def _versions(t, *cols):
    a = t.det.select(*ID, *[C(c).alias("a_" + c) for c in cols])
    b = t.det2.select("row_id", *[C(c).alias("b_" + c) for c in cols])
    return a.join(b, "row_id")


@query("g1_iou_containment", "det det2", sql=f"""
SELECT a.layout_id, a.row_id, round({INTER} / ({AA} + {AB} - {INTER}), 6) AS iou, round({INTER} / least({AA}, {AB}), 6) AS contained
FROM det a JOIN det2 b ON a.row_id = b.row_id""")
def g1(t):
    d = _versions(t, "x1", "y1", "x2", "y2")
    a, b = G.box("a_"), G.box("b_")
    return d.select(*ID, F.round(G.iou(a, b), 6).alias("iou"), F.round(G.containment(a, b), 6).alias("contained"))


@query("g2_oriented_box", sql="""
SELECT layout_id, row_id, CAST(trunc(round(cx - (w / 2 * abs(cos(radians(angle))) + h / 2 * abs(sin(radians(angle)))), 6)) AS INT) AS px1,
  CAST(trunc(round(cy + (w / 2 * abs(sin(radians(angle))) + h / 2 * abs(cos(radians(angle)))), 6)) AS INT) AS py2 FROM det""")
def g2(t):
    p = G.polygon(C("cx"), C("cy"), C("w"), C("h"), F.radians("angle"))
    p = F.transform(p, lambda q: F.struct(F.round(q["x"], 6).alias("x"), F.round(q["y"], 6).alias("y")))
    b = G.polygon_box(p)
    return t.det.select(*ID, b[0].alias("px1"), b[3].alias("py2"))


RAD = "radians(CAST(r % 720 AS DOUBLE) - 359.75)"
WRAP = f"({RAD} + pi() - 2 * pi() * floor(({RAD} + pi()) / (2 * pi())) - pi())"


@query("g3_normalise_oriented", sql=f"""
SELECT layout_id, row_id, CASE WHEN abs(tt) > pi() / 4 THEN h ELSE w END AS nw, CASE WHEN abs(tt) > pi() / 4 THEN w ELSE h END AS nh,
  round(CASE WHEN tt > pi() / 4 THEN tt - pi() / 2 WHEN tt < -pi() / 4 THEN tt + pi() / 2 ELSE tt END, 6) AS theta
FROM (SELECT *, {WRAP} AS tt FROM det)""")
def g3(t):
    d = t.det.withColumn("rad", F.radians((C("r") % 720).cast("double") - 359.75))
    w, h, th = G.normalise_oriented(C("w"), C("h"), C("rad"))
    return d.select(*ID, w.alias("nw"), h.alias("nh"), F.round(th, 6).alias("theta"))


DEG = "(CAST(r % 1440 AS DOUBLE) - 720)"
NORM = f"((({DEG} % 360) + 360) % 360)"


@query("g4_angle_class", sql=f"""
SELECT layout_id, row_id, n + 0.0 AS turn, least(n % 90, 90 - n % 90) + 0.0 AS off_axis,
  CASE WHEN least(n, 360 - n) <= 12 OR abs(n - 180) <= 12 THEN 'horizontal' WHEN abs(n - 90) <= 12 OR abs(n - 270) <= 12 THEN 'vertical' ELSE 'angular' END AS kind
FROM (SELECT *, {NORM} AS n FROM det)""")
def g4(t):
    deg = (C("r") % 1440).cast("double") - 720
    return t.det.select(*ID, (G.full_turn(deg) + 0.0).alias("turn"), (G.to_cardinal(deg) + 0.0).alias("off_axis"), G.angle_class(deg).alias("kind"))


@query("g5_local_offset", sql="""
SELECT layout_id, row_id, round((lx - cx) * cos(radians(-angle)) - (ly - cy) * sin(radians(-angle)), 6) + 0.0 AS dx, round((lx - cx) * sin(radians(-angle)) + (ly - cy) * cos(radians(-angle)), 6) + 0.0 AS dy
FROM det WHERE lx IS NOT NULL""")
def g5(t):
    dx, dy = G.local_offset(C("lx") - C("cx"), C("ly") - C("cy"), C("angle"))
    return t.det.filter(C("lx").isNotNull()).select(*ID, (F.round(dx, 6) + 0.0).alias("dx"), (F.round(dy, 6) + 0.0).alias("dy"))


MODES = {c: r["mode"] for c, r in R.LINK.items()}
OX = "((lx - cx) * cos(radians(-angle)) - (ly - cy) * sin(radians(-angle)))"
OY = "((lx - cx) * sin(radians(-angle)) + (ly - cy) * cos(radians(-angle)))"
DIRECTION = f"""CASE m WHEN 'either' THEN TRUE WHEN 'inside' THEN lx BETWEEN x1 AND x2 AND ly BETWEEN y1 AND y2
  ELSE CASE WHEN abs(angle) > 12.15 AND cls <> 'isolierstoss'
    THEN CASE m WHEN 'below' THEN {OY} > 0 WHEN 'above' THEN {OY} < 0 ELSE {OX} >= 0 OR {OY} > 0 END
    ELSE CASE m WHEN 'below' THEN ly > cy WHEN 'above' THEN ly < cy ELSE lx - 20 >= x2 - 0.3 * w OR ly > cy + 0.3 * h END END END"""


@query("g6_direction_test", sql=f"SELECT layout_id, row_id, {DIRECTION} AS ok FROM (SELECT *, {sql_case(MODES)} AS m FROM det WHERE lx IS NOT NULL)")
def g6(t):
    d = t.det.filter(C("lx").isNotNull())
    c = (C("lx") - 20, C("ly") - 8, C("lx") + 20, C("ly") + 8)
    turned = G.tilted(C("angle")) & ~R.is_in(C("cls"), ["isolierstoß"])
    ok = G.in_direction(R.lookup(C("cls"), MODES), G.box(), C("cx"), C("cy"), C("w"), C("h"), C("angle"), c, C("lx"), C("ly"), turned)
    return d.select(*ID, ok.alias("ok"))


@query("g7_quadrant", sql=f"""
SELECT layout_id, row_id, CAST(q AS INT) AS quadrant,
  CASE WHEN n < 5 OR n > 355 OR (n > 85 AND n < 95) OR (n > 265 AND n < 275) THEN w WHEN n > 175 AND n < 185 THEN -w ELSE round(w * cos(radians(-d)) - h * sin(radians(-d)), 6) END + 0.0 AS dx,
  CASE WHEN n < 5 OR n > 355 OR (n > 175 AND n < 185) OR (n > 265 AND n < 275) THEN h WHEN n > 85 AND n < 95 THEN -h ELSE round(w * sin(radians(-d)) + h * cos(radians(-d)), 6) END + 0.0 AS dy,
  CASE WHEN (n > 85 AND n < 95) OR (n > 265 AND n < 275) OR (NOT (n < 5 OR n > 355 OR (n > 175 AND n < 185)) AND q IN (90, 270)) THEN 40.0 ELSE 90.0 END AS region_w
FROM (SELECT *, floor(((n + 45) % 360) / 90) * 90 AS q FROM (SELECT *, {DEG} AS d, {NORM} AS n FROM det))""")
def g7(t):
    deg = (C("r") % 1440).cast("double") - 720
    dx, dy, w, _ = G.turn_offset(C("w"), C("h"), F.lit(90.0), F.lit(40.0), deg)
    return t.det.select(*ID, G.quadrant(deg).alias("quadrant"), (F.round(dx, 6) + 0.0).alias("dx"), (F.round(dy, 6) + 0.0).alias("dy"), w.alias("region_w"))


@query("g7_clamp_region", "det sheets", sql="""
WITH c AS (SELECT d.layout_id, d.row_id, greatest(0, least(x1 - 300, width)) AS bx1, greatest(0, least(x2 - 300, width)) AS bx2, greatest(0, least(y1 + 400, height)) AS by1, greatest(0, least(y2 + 400, height)) AS by2, width, height
  FROM det d JOIN sheets s ON d.layout_id = s.layout_id AND d.page = s.page),
e AS (SELECT *, CASE WHEN bx2 <= bx1 THEN least(bx1 + 10, width) ELSE bx2 END AS ex2, CASE WHEN by2 <= by1 THEN least(by1 + 10, height) ELSE by2 END AS ey2 FROM c)
SELECT layout_id, row_id, bx1, by1, ex2 AS bx2, ey2 AS by2, ex2 - bx1 >= 10 AND ey2 - by1 >= 10 AS usable FROM e""")
def g7c(t):
    d = t.det.join(t.sheets, ["layout_id", "page"])
    b = (C("x1") - 300, C("y1") + 400, C("x2") - 300, C("y2") + 400)
    x1, y1, x2, y2, ok = G.clamp_region(b, C("width"), C("height"))
    return d.select(*ID, x1.alias("bx1"), y1.alias("by1"), x2.alias("bx2"), y2.alias("by2"), ok.alias("usable"))


TILT = f"(least({TURN}, 360 - {TURN}) > 12 AND abs({TURN} - 180) > 12 AND abs({TURN} - 90) > 12 AND abs({TURN} - 270) > 12)"


@query("g8_padding", sql=f"""
SELECT layout_id, row_id, round(greatest(1.0, w * CASE WHEN {TILT} THEN {sql_case(R.EXPAND_X_TILTED, default=1.0)} ELSE {sql_case(R.EXPAND_X_UPRIGHT, default=1.0)} END + 2.0 * pad), 6) AS box_w,
  round(greatest(1.0, h * CASE WHEN {TILT} THEN {sql_case(R.EXPAND_Y_TILTED, default=1.0)} ELSE {sql_case(R.EXPAND_Y_UPRIGHT, default=1.0)} END + 2.0 * pad), 6) AS box_h
FROM (SELECT *, CASE WHEN {TILT} THEN {sql_case(R.PAD_TILTED, default=R.PAD_TILTED_DEFAULT)} ELSE {sql_case(R.PAD_UPRIGHT, default=R.PAD_UPRIGHT_DEFAULT)} END AS pad FROM det)""")
def g8(t):
    w, h = G.pad_box(C("w"), C("h"), C("angle"), C("cls"))
    return t.det.select(*ID, F.round(w, 6).alias("box_w"), F.round(h, 6).alias("box_h"))


def _windows_sql() -> str:
    def side(n):
        return "cls IN " + sql_list([c for c, s in R.WINDOW_SIDES.items() if n in s])

    def px(f, v):
        return f"trunc({f} * {v})"

    dx, dy = "CASE WHEN cls = 'signal' THEN trunc(2.4 * w) ELSE trunc(w) END", "CASE WHEN cls = 'signal' THEN trunc(2.2 * h) ELSE trunc(1.6 * h) END"
    sig = "cls = 'signal'"
    below = (f"greatest(0, x1 - {dx})", "y2", f"least(width, x2 + {dx})", f"least(height, y2 + {dy})", False)
    above = (f"greatest(0, x1 - {dx})", f"greatest(0, y1 - {dy})", f"least(width, x2 + {dx})", "y1", False)
    wins = [
        (side("inside"), f"x1 + {px(0.1, 'w')}", f"y1 + {px(0.1, 'h')}", f"x2 - {px(0.1, 'w')}", f"y2 - {px(0.1, 'h')}", True),
        (side("right"), "x2", f"greatest(0, y1 - {px(0.6, 'h')})", f"least(width, x2 + {px(2.5, 'w')})", f"least(height, y2 + {px(0.6, 'h')})", True),
        (side("left"), f"greatest(0, x1 - {px(4.0, 'w')})", f"greatest(0, y1 - {px(0.6, 'h')})", "x1", f"least(height, y2 + {px(0.6, 'h')})", True),
        (side("below"), *below), (side("above"), *above),
        ("m IN ('below', 'either', 'right_or_below')", *below), ("m IN ('above', 'either')", *above),
        ("m IN ('right', 'right_or_below', 'either')", "x2", f"greatest(0, y1 - {px(0.3, 'h')})", f"least(width, x2 + {px(0.9, 'w')})", f"least(height, y2 + {px(0.3, 'h')})", True),
        (sig, "x2", "greatest(0, y1 - trunc(h))", f"least(width, x2 + {px(5.0, 'w')})", "least(height, y2 + trunc(h))", True),
        (sig, f"greatest(0, x1 - {px(2.0, 'w')})", "y2", f"least(width, x2 + {px(2.0, 'w')})", f"least(height, y2 + {px(5.0, 'h')})", False),
        (sig, f"greatest(0, x1 - {px(5.0, 'w')})", "greatest(0, y1 - trunc(h))", "x1", "least(height, y2 + trunc(h))", True),
    ]
    rows = []
    for i, (cond, a, b, c, d, check) in enumerate(wins):
        rows.append(f"SELECT layout_id, row_id, {i} AS k, {a} AS wx1, {b} AS wy1, {c} AS wx2, {d} AS wy2 FROM b WHERE {cond} AND {d} > {b}" + (f" AND {c} > {a}" if check else ""))
    return (f"WITH b AS (SELECT d.*, width, height, coalesce({sql_case(MODES)}, 'either') AS m FROM det d JOIN sheets s ON d.layout_id = s.layout_id AND d.page = s.page), u AS ("
            + " UNION ALL ".join(rows) + """)
SELECT layout_id, row_id, wx1, wy1, wx2, wy2 FROM (SELECT *, row_number() OVER (PARTITION BY layout_id, row_id, floor(wx1 / 4), floor(wy1 / 4), floor(wx2 / 4), floor(wy2 / 4) ORDER BY k) AS n FROM u) WHERE n = 1""")


@query("g9_text_windows", "det sheets", sql=_windows_sql())
def g9(t):
    d = t.det.join(t.sheets, ["layout_id", "page"])
    wins = G.text_windows(C("cls"), R.lookup(C("cls"), MODES, "either"), G.box(), C("w"), C("h"), C("width"), C("height"))
    d = d.select(*ID, F.posexplode(wins).alias("k", "v")).select(*ID, "k", "v.x1", "v.y1", "v.x2", "v.y2")
    slot = [F.floor(C(c) / 4).alias("q" + c) for c in ("x1", "y1", "x2", "y2")]
    first = F.min(F.struct("k", "x1", "y1", "x2", "y2")).alias("m")
    return d.groupBy(*ID, *slot).agg(first).select(*ID, *[C("m." + c).alias("w" + c) for c in ("x1", "y1", "x2", "y2")])


@query("g10_carry_adjustment", "det sheets", sql=f"""
WITH q AS (SELECT d.*, width, height, CAST(floor((({TURN} + 45) % 360) / 90) * 90 AS INT) AS quad FROM det d JOIN sheets s ON d.layout_id = s.layout_id AND d.page = s.page),
e AS (SELECT *, CASE quad WHEN 90 THEN -3 WHEN 180 THEN -12 WHEN 270 THEN -9 ELSE -8 END AS e1, CASE quad WHEN 90 THEN -12 WHEN 180 THEN -9 WHEN 270 THEN -8 ELSE -3 END AS e2,
  CASE quad WHEN 90 THEN 9 WHEN 180 THEN 8 WHEN 270 THEN 3 ELSE 12 END AS e3, CASE quad WHEN 90 THEN 8 WHEN 180 THEN 3 WHEN 270 THEN 12 ELSE 9 END AS e4 FROM q)
SELECT layout_id, row_id, greatest(0, least(x1 + e1, width)) AS bx1, greatest(0, least(y1 + e2, height)) AS by1, greatest(0, least(x2 + e3, width)) AS bx2, greatest(0, least(y2 + e4, height)) AS by2 FROM e
WHERE greatest(0, least(x2 + e3, width)) > greatest(0, least(x1 + e1, width)) AND greatest(0, least(y2 + e4, height)) > greatest(0, least(y1 + e2, height))""")
def g10(t):
    # one edge adjustment made on an upright symbol, applied to every symbol
    d = t.det.join(t.sheets, ["layout_id", "page"])
    e = G.turn_edges((F.lit(-8.0), F.lit(-3.0), F.lit(12.0), F.lit(9.0)), F.lit(0.0), C("angle"))
    moved = tuple(c + x for c, x in zip(G.box(), e))
    x1, y1, x2, y2, _ = G.clamp_region(moved, C("width"), C("height"))
    raw = tuple(F.greatest(F.lit(0.0), F.least(v, C(s))) for v, s in zip(moved, ("width", "height", "width", "height")))
    return d.filter((raw[2] > raw[0]) & (raw[3] > raw[1])).select(*ID, x1.alias("bx1"), y1.alias("by1"), x2.alias("bx2"), y2.alias("by2"))


@query("g11_spatial_similarity", "det det2", sql="SELECT a.layout_id, a.row_id, round(greatest(0.0, 1 - sqrt((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy)) / 200), 6) AS sim FROM det a JOIN det2 b ON a.row_id = b.row_id")
def g11(t):
    d = _versions(t, "cx", "cy")
    return d.select(*ID, F.round(G.spatial_similarity(G.distance(C("a_cx"), C("a_cy"), C("b_cx"), C("b_cy"))), 6).alias("sim"))


ANG = "((degrees(atan2(ly - cy, lx - cx)) + 360) - 360 * floor((degrees(atan2(ly - cy, lx - cx)) + 360) / 360))"


@query("g12_movement", sql=f"""
SELECT layout_id, row_id, round(sqrt((lx - cx) * (lx - cx) + (ly - cy) * (ly - cy)), 6) AS dist,
  CASE WHEN a < 22.5 OR a >= 337.5 THEN 'right' WHEN a < 67.5 THEN 'down-right' WHEN a < 112.5 THEN 'down' WHEN a < 157.5 THEN 'down-left' WHEN a < 202.5 THEN 'left' WHEN a < 247.5 THEN 'up-left' WHEN a < 292.5 THEN 'up' ELSE 'up-right' END AS direction
FROM (SELECT *, {ANG} AS a FROM det WHERE lx IS NOT NULL AND sqrt((lx - cx) * (lx - cx) + (ly - cy) * (ly - cy)) >= 10)""")
def g12(t):
    d = t.det.filter(C("lx").isNotNull()).withColumn("dist", G.distance(C("cx"), C("cy"), C("lx"), C("ly"))).filter(C("dist") >= 10)
    return d.select(*ID, F.round("dist", 6).alias("dist"), G.compass(C("lx") - C("cx"), C("ly") - C("cy")).alias("direction"))
