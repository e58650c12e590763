"""Linking anchors to coordinates: candidates, fallbacks, exclusive claims, inherited and manual links.

Rows carry ``layout_id, page, row_id, cls, cx, cy, w, h, x1, y1, x2, y2, angle`` (degrees, normalised)
and optionally ``angle_raw``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotweave import rules as R
from plotweave.functions import geometry as G
from plotweave.functions import text as T
from plotweave.operators import iterative
from plotweave.operators.ordered import id_cell, rank_in_group
from plotweave.operators.spatial import BOX, KEYS, near_pairs, nearest, places, reach_pairs
from plotweave.session import cut

C = F.col
SHAPE = ["cx", "cy", "w", "h", *BOX]
RADIAL_TIER = 90


def rule(cls: Column, name: str, default) -> Column:
    return R.lookup(cls, {c: r[name] for c, r in R.LINK.items() if name in r}, default)


def raw_angle(df: DataFrame) -> DataFrame:
    return df if "angle_raw" in df.columns else df.withColumn("angle_raw", C("angle"))


def coord_shapes(coords: DataFrame) -> DataFrame:
    """One row per distinct coordinate box: enough when only the best coordinate is asked for."""
    return places(coords, SHAPE).drop("n")


def _steps(cls: Column) -> Column:
    """Later steps of a class as factors of its base height."""
    out = F.array().cast("array<double>")
    for c, r in R.LINK.items():
        if "steps" in r:
            out = F.when(R.is_in(cls, [c]), F.array(*[F.lit(float(x)) for x in r["steps"]])).otherwise(out)
    return out


def link_candidates(anchors: DataFrame, coords: DataFrame) -> DataFrame:
    """All coordinates an anchor may take, with its liking ``tier, s1, s2, s3`` (smaller is better).

    What a class asks for is looked up once per anchor, so that little code is left for the pairs.
    """
    a = raw_angle(anchors).select(*KEYS, "row_id", "cls", "angle", "angle_raw", *SHAPE).filter(C("cls") != "coordinate")
    turned = G.tilted(C("angle"))
    a = a.withColumns({
        "turned": turned, "mode": rule(C("cls"), "mode", "either"), "wide": rule(C("cls"), "dx", 1.0) * 0.6,
        "left": F.coalesce(rule(C("cls"), "left", False), F.lit(False)) & ~turned, "flat": F.coalesce(rule(C("cls"), "horizontal", False), F.lit(False)),
        "oriented": turned & ~F.coalesce(rule(C("cls"), "axis", False), F.lit(False)), "base": 1.6 * C("h"), "steps": _steps(C("cls"))})
    # how far a class looks: a few sizes, each with its own copy of the coordinates' reach
    far = {c: 0.6 * r.get("dx", 1.0) * (1.3 if r.get("left") else 1.0) for c, r in R.LINK.items()}
    a = a.withColumn("far", R.lookup(C("cls"), far, 0.6))
    b = coords.select(*KEYS, "row_id", *SHAPE, F.explode(F.array(*[F.lit(v) for v in sorted({0.6, *far.values()})])).alias("far"))
    up = 1.6 * C("h") * R.lookup(C("cls"), {c: max(r["steps"]) for c, r in R.LINK.items() if "steps" in r}, 1.0)
    across = F.greatest(F.lit(39.0), C("far") * C("w"))
    round_ = F.sqrt(up * up + across * across)
    rx, ry = F.when(C("turned"), round_).otherwise(across), F.when(C("turned"), round_).otherwise(up)
    rb = C("far") * C("w")
    p = reach_pairs(a, b, (C("cx") - rx, C("cy") - ry, C("cx") + rx, C("cy") + ry), (C("cx") - rb, C("cy") - rb, C("cx") + rb, C("cy") + rb), on=[*KEYS, "far"])
    turned = C("a_turned")
    gx, gy = C("b_cx") - C("a_cx"), C("b_cy") - C("a_cy")
    lx, ly = G.local_offset(gx, gy, C("a_angle_raw"))
    p = p.withColumns({"dx": F.abs(F.when(turned, lx).otherwise(gx)), "dy": F.abs(F.when(turned, ly).otherwise(gy))})
    # 0 within the base height, k for the first later step that reaches dy, NULL beyond
    step = F.filter(F.transform("a_steps", lambda s, k: F.when(C("dy") <= C("a_base") * s, k + 1)), lambda k: k.isNotNull())
    tier = F.when(C("dy") <= C("a_base"), 0).when(F.size("a_steps") > 0, F.get(step, F.lit(0)))
    ok = G.in_direction(C("a_mode"), G.box("a_"), C("a_cx"), C("a_cy"), C("a_w"), C("a_h"), C("a_angle_raw"), G.box("b_"), C("b_cx"), C("b_cy"), C("a_oriented"))
    dx_max = F.greatest(C("a_wide") * F.greatest("a_w", "b_w"), F.lit(30.0))
    dx_max = F.when(C("a_left") & (gx < 0), dx_max * 1.3).otherwise(dx_max)
    shared = -F.greatest(F.lit(0.0), F.least("a_x2", "b_x2") - F.greatest("a_x1", "b_x1"))
    flat = C("a_flat")
    return (
        p.withColumn("tier", tier).filter(C("tier").isNotNull() & ok & (C("dx") <= dx_max))
        .select(
            *KEYS, C("a_row_id").alias("row_id"), C("a_cls").alias("cls"), C("b_row_id").alias("coord_id"), "tier",
            F.when(turned, F.sqrt(C("dx") * C("dx") + C("dy") * C("dy"))).when(flat, C("dx")).otherwise(C("dy")).alias("s1"),
            F.when(turned, shared).when(flat, C("dy")).otherwise(C("dx")).alias("s2"),
            F.when(turned, 0.0).otherwise(shared).alias("s3"),
            gx.alias("off_x"), gy.alias("off_y"),
        )
    )


def best_link(candidates: DataFrame) -> DataFrame:
    """Best coordinate per anchor, whatever the others take."""
    m = F.min(F.struct("tier", "s1", "s2", "s3", "coord_id", "off_x", "off_y"))
    return candidates.groupBy(*KEYS, "row_id", "cls").agg(m.alias("m")).select(*KEYS, "row_id", "cls", C("m.coord_id"), C("m.tier"), C("m.off_x"), C("m.off_y"))


def link_patterns(links: DataFrame) -> DataFrame:
    """Mean and population deviation of the link offsets per page and class."""
    return links.groupBy(*KEYS, "cls").agg(
        F.count(F.lit(1)).alias("n"), F.avg("off_x").alias("mean_dx"), F.stddev_pop("off_x").alias("sd_dx"),
        F.avg("off_y").alias("mean_dy"), F.stddev_pop("off_y").alias("sd_dy"))


def adaptive_pairs(unlinked: DataFrame, coords: DataFrame, patterns: DataFrame) -> DataFrame:
    """Coordinates around the place where the links of the class usually point, with their distance from it."""
    d = unlinked.join(patterns.filter(C("n") >= 2), [*KEYS, "cls"]).withColumns({
        "tx": C("cx") + C("mean_dx"), "ty": C("cy") + C("mean_dy"),
        "rx": F.greatest(3 * C("sd_dx"), F.lit(150.0)), "ry": F.greatest(3 * C("sd_dy"), F.lit(80.0))})
    a = d.select(*KEYS, "row_id", "cls", "tx", "ty", "rx", "ry")
    b = places(coords, ["cx", "cy"]).drop("n")
    p = reach_pairs(a, b, (C("tx") - C("rx"), C("ty") - C("ry"), C("tx") + C("rx"), C("ty") + C("ry")), (C("cx"), C("cy"), C("cx"), C("cy")))
    p = p.filter((F.abs(C("b_cx") - C("a_tx")) < C("a_rx")) & (F.abs(C("b_cy") - C("a_ty")) < C("a_ry")))
    d = G.distance(C("a_tx"), C("a_ty"), C("b_cx"), C("b_cy"))
    return p.select(*KEYS, C("a_row_id").alias("row_id"), C("a_cls").alias("cls"), C("b_row_id").alias("coord_id"), d.alias("d"))


def link_adaptive(unlinked: DataFrame, coords: DataFrame, patterns: DataFrame) -> DataFrame:
    """Coordinate nearest to where the links of the class usually point."""
    p = adaptive_pairs(unlinked, coords, patterns)
    return p.groupBy(*KEYS, "row_id").agg(F.min(F.struct("d", "coord_id")).alias("m")).select(*KEYS, "row_id", "m.coord_id", C("m.d").alias("dist"))


def radial_candidates(anchors: DataFrame, coords: DataFrame, radius: float = 300.0) -> DataFrame:
    """Any coordinate around, nearest first: the last resort of insulating joints."""
    def at(d: DataFrame, *more) -> DataFrame:
        return d.select(*KEYS, "row_id", *more, C("cx").alias("x"), C("cy").alias("y"))

    p = near_pairs(at(anchors, "cls"), at(coords), radius)
    return p.select(*KEYS, C("a_row_id").alias("row_id"), C("a_cls").alias("cls"), C("b_row_id").alias("coord_id"), F.lit(RADIAL_TIER).alias("tier"),
                    C("dist").alias("s1"), F.lit(0.0).alias("s2"), F.lit(0.0).alias("s3"), (C("b_x") - C("a_x")).alias("off_x"), (C("b_y") - C("a_y")).alias("off_y"))


def link_radial(anchors: DataFrame, coords: DataFrame, claimed: DataFrame, radius: float = 300.0) -> DataFrame:
    """Nearest coordinate nobody has claimed."""
    free = coords.join(claimed.select(*KEYS, C("coord_id").alias("row_id")).distinct(), [*KEYS, "row_id"], "left_anti")
    at = [C("cx").alias("x"), C("cy").alias("y")]
    n = nearest(anchors.select(*KEYS, "row_id", *at), places(free, ["cx", "cy"]).select(*KEYS, "row_id", *at), radius)
    return n.select(*KEYS, "row_id", C("b_row_id").alias("coord_id"), "dist")


def link_triples(stops: DataFrame, signals: DataFrame, coords: DataFrame) -> DataFrame:
    """Stop point, nearest signal above or below, and the nearest coordinate between the two.

    ``signals`` and ``coords`` carry their text as ``txt``.
    """
    s = raw_angle(stops).select(*KEYS, "row_id", "angle", "angle_raw", C("cx").alias("x"), C("cy").alias("y"))
    g = signals.select(*KEYS, "row_id", "angle", "txt", C("cx").alias("x"), C("cy").alias("y"))
    turned = F.abs("a_angle") > 15.0
    gx, gy = C("b_x") - C("a_x"), C("b_y") - C("a_y")
    lx, ly = G.local_offset(gx, gy, C("a_angle_raw"))
    dx, dy = F.when(turned, lx).otherwise(gx), F.when(turned, ly).otherwise(gy)
    fits = (F.abs(dy) > 30) & (F.abs(dy) < 200) & (F.abs(dx) < 100) & (~turned | (G.turn_between(C("a_angle"), C("b_angle")) <= 20))
    p = near_pairs(s, g, 250.0, where=fits)
    m = F.min(F.struct("dist", C("b_row_id").alias("signal_id"), C("b_txt").alias("signal_text"), dy.alias("signal_dy")))
    pair = p.groupBy(*KEYS, C("a_row_id").alias("row_id")).agg(m.alias("m")).select(*KEYS, "row_id", "m.signal_id", "m.signal_text", "m.signal_dy")
    s2 = s.join(pair, [*KEYS, "row_id"])
    k = coords.select(*KEYS, "row_id", "txt", C("cx").alias("x"), C("cy").alias("y"))
    between = (F.abs(dx) < 100) & F.when(C("a_signal_dy") > 0, (dy > 0) & (dy < C("a_signal_dy"))).otherwise((dy < 0) & (dy > C("a_signal_dy")))
    mid = near_pairs(s2, k, 225.0, where=between)
    c = F.min(F.struct("dist", C("b_row_id").alias("coord_id"), C("b_txt").alias("coord_text")))
    mid = mid.groupBy(*KEYS, C("a_row_id").alias("row_id")).agg(c.alias("m")).select(*KEYS, "row_id", "m.coord_id", "m.coord_text")
    return pair.join(mid, [*KEYS, "row_id"], "left").drop("signal_dy")


def drop_referenced(signals: DataFrame, triples: DataFrame) -> DataFrame:
    """Signals without the instances that only stand at a stop point."""
    return signals.join(triples.select(*KEYS, C("signal_id").alias("row_id")).distinct(), [*KEYS, "row_id"], "left_anti")


def inherit_from_nearest(boards: DataFrame, gks: DataFrame, gks_links: DataFrame) -> DataFrame:
    """Boards take over the coordinate of the nearest balise, if it has one."""
    at = [C("cx").alias("x"), C("cy").alias("y")]
    close = (C("dist") < 250) & (F.abs(C("b_x") - C("a_x")) < 300) & (F.abs(C("b_y") - C("a_y")) < 100)
    b = places(gks, ["cx", "cy"]).select(*KEYS, "row_id", *at)
    n = nearest(boards.select(*KEYS, "row_id", *at), b, 250.0, where=close)
    g = gks_links.select(*KEYS, C("row_id").alias("b_row_id"), "coord_id")
    return n.join(g, [*KEYS, "b_row_id"]).select(*KEYS, "row_id", C("b_row_id").alias("gks_id"), "coord_id")


def _claim(candidates: DataFrame, coords: DataFrame, size: float = 256.0) -> DataFrame:
    cells = coords.select(*KEYS, C("row_id").alias("coord_id"), F.floor(C("cx") / size).alias("_gx"), F.floor(C("cy") / size).alias("_gy"))
    return iterative.claims(candidates, [*KEYS, "coord_id"], [*KEYS, "row_id"], ["tier", "s1", "s2", "s3"], ["row_id"], cells=cells)


def assign_coordinates(anchors: DataFrame, coords: DataFrame) -> DataFrame:
    """Links in priority order: balises, then links of S-connectors, then stop points, then the rest.

    Balises, connectors and the rest own their coordinate. Stop points only reserve theirs: signals
    and switch ends keep away from it, other classes may still take it. Switch ends take what no
    other class has reserved. What is left without a coordinate looks where the page's links of its class usually point and
    takes the nearest free one there. Boards without a coordinate inherit one.
    """
    anchors = raw_angle(anchors)
    cls = C("cls")
    cands = cut(link_candidates(anchors.filter(cls != "weichen_block"), coords))

    def without(c: DataFrame, taken: DataFrame) -> DataFrame:
        return c.join(taken.select(*KEYS, "coord_id").distinct(), [*KEYS, "coord_id"], "left_anti")

    def tagged(d: DataFrame, how: str) -> DataFrame:
        return d.select(*KEYS, "row_id", "coord_id", F.lit(how).alias("how"))

    gks = tagged(_claim(cands.filter(cls.isin(R.GKS)), coords), "claim")
    conn = tagged(_claim(without(cands.filter(cls == "sverbinder"), gks), coords), "claim")
    owned = gks.unionByName(conn)
    texts = {"signal": "anchor_text", "coordinate": "coord_text"}
    stops = anchors.filter(cls == "haltepunkt")
    triples = cut(link_triples(stops, anchors.filter(cls == "signal").withColumn("txt", C(texts["signal"])), coords.withColumn("txt", C(texts["coordinate"]))))
    triple = tagged(triples.filter(C("coord_id").isNotNull()), "triple")
    alone = without(cands.filter(cls == "haltepunkt"), owned).join(triple.select(*KEYS, "row_id"), [*KEYS, "row_id"], "left_anti")
    soft = cut(triple.unionByName(tagged(best_link(alone), "soft")))
    rest = cands.filter(~cls.isin(*R.GKS, "sverbinder", "haltepunkt"))
    joints = radial_candidates(anchors.filter(R.is_in(cls, ["isolierstoß"])), coords)
    rest = without(rest.unionByName(joints, allowMissingColumns=True), owned)
    rest = rest.join(triples.select(*KEYS, C("signal_id").alias("row_id"), F.lit(True).alias("_gone")).distinct(), [*KEYS, "row_id"], "left").filter(
        C("_gone").isNull()).drop("_gone")
    kept_away = cls.isin("signal", "weichenende", "weichengruppenende")
    rest = rest.filter(~kept_away).unionByName(without(rest.filter(kept_away), soft))
    free = tagged(_claim(rest, coords), "claim")
    links = cut(owned.unionByName(soft).unionByName(free))
    links = links.unionByName(tagged(_adaptive(anchors, coords, links), "adaptive"))
    bare = anchors.filter(cls == "haltetafel").join(links.select(*KEYS, "row_id"), [*KEYS, "row_id"], "left_anti")
    heirs = inherit_from_nearest(bare, anchors.filter(cls == "gks_festkodiert"), gks)
    return links.unionByName(tagged(heirs, "inherited"))


def _adaptive(anchors: DataFrame, coords: DataFrame, links: DataFrame) -> DataFrame:
    """Exclusive links of the remaining anchors by the offsets of the links that were claimed."""
    at = anchors.select(*KEYS, "row_id", "cls", "cx", "cy")
    to = coords.select(*KEYS, C("row_id").alias("coord_id"), C("cx").alias("to_x"), C("cy").alias("to_y"))
    own = links.filter(C("how") == "claim").join(at, [*KEYS, "row_id"]).join(to, [*KEYS, "coord_id"])
    patterns = link_patterns(own.select(*KEYS, "cls", (C("to_x") - C("cx")).alias("off_x"), (C("to_y") - C("cy")).alias("off_y")))
    open_ = at.filter(~C("cls").isin(*R.GKS, "sverbinder", "haltepunkt", "haltetafel", "weichen_block")).join(links.select(*KEYS, "row_id"), [*KEYS, "row_id"], "left_anti")
    free = coords.join(links.select(*KEYS, C("coord_id").alias("row_id")).distinct(), [*KEYS, "row_id"], "left_anti")
    pairs = adaptive_pairs(open_, free, patterns)
    return _claim(pairs.select(*KEYS, "row_id", "coord_id", F.lit(0).alias("tier"), C("d").alias("s1"), F.lit(0.0).alias("s2"), F.lit(0.0).alias("s3")), coords)


# --- user symbols ------------------------------------------------------------------------------
def link_symbols(df: DataFrame, coords: DataFrame, symbols: DataFrame, rotate: bool = True) -> DataFrame:
    """Nearest coordinate on an allowed side of a user symbol, in the symbol's own frame.

    ``rotate=False`` keeps the page's axes. Every symbol is searched on a grid of its own reach: places are measured in
    the power of two above the symbol's link distance, so one unit of the grid is enough for any distance.
    """
    reach = F.pow(F.lit(2.0), F.ceil(F.log2("max_link_distance")))
    s = symbols.filter(C("links_to_coordinate") & (C("max_link_distance") > 0)).select(
        C("name").alias("cls"), C("coordinate_position").alias("sides"), C("max_link_distance").alias("most"), reach.alias("unit"))
    units = [r[0] for r in s.select("unit").distinct().collect()]  # powers of two
    d = df.join(s, "cls").select(*KEYS, "row_id", "cls", "angle", "sides", "most", "unit", (C("cx") / C("unit")).alias("x"), (C("cy") / C("unit")).alias("y"))
    c = places(coords, ["cx", "cy"]).withColumn("unit", F.explode(F.array(*[F.lit(u) for u in units]).cast("array<double>")))
    c = c.select(*KEYS, "row_id", "unit", (C("cx") / C("unit")).alias("x"), (C("cy") / C("unit")).alias("y"))
    gx, gy = C("b_x") - C("a_x"), C("b_y") - C("a_y")
    lx, ly = G.local_offset(gx, gy, C("a_angle")) if rotate else (gx, gy)
    p = near_pairs(d, c, 1.0, [*KEYS, "unit"]).withColumn("dist", C("dist") * C("unit")).filter(C("dist") <= C("a_most"))
    p = p.withColumns({"lx": lx * C("unit"), "ly": ly * C("unit")})
    p = p.filter(F.exists("a_sides", lambda side: G.side_allowed(side, C("lx"), C("ly"))))
    m = F.min(F.struct("dist", "b_row_id"))
    best = p.groupBy(*KEYS, C("a_row_id").alias("row_id"), C("a_cls").alias("cls")).agg(m.alias("m"))
    return best.select(*KEYS, "row_id", "cls", C("m.b_row_id").alias("coord_id"), C("m.dist").alias("link_distance"))


# --- after linking -----------------------------------------------------------------------------
def attach_link_ids(df: DataFrame) -> DataFrame:
    """Coordinate row of each linked anchor by equal text and box corner (``cx1, cy1``)."""
    key = ["layout_id", "coord_text", "cx1", "cy1"]
    c = df.filter(C("cls") == "coordinate").groupBy(*key).agg(F.min("row_id").alias("link_coord_row_id"))
    return df.join(c, key, "left").withColumn("link_coord_row_id", F.when(C("cls") != "coordinate", C("link_coord_row_id")))


def linked_coordinates(df: DataFrame) -> DataFrame:
    """Coordinates whose text some anchor of the plan shows."""
    used = df.filter((C("cls") != "coordinate") & T.filled(C("coord_text"))).select("layout_id", T.strip(C("coord_text")).alias("_t")).distinct()
    return df.filter(C("cls") == "coordinate").withColumn("_t", T.strip(C("coord_text"))).join(used, ["layout_id", "_t"], "left_semi").drop("_t")


def unclaimed(coords: DataFrame, links: DataFrame) -> DataFrame:
    return coords.join(links.select(*KEYS, C("coord_id").alias("row_id")).distinct(), [*KEYS, "row_id"], "left_anti")


def generated_names(df: DataFrame, triples: DataFrame | None = None) -> DataFrame:
    """Running names: class and number per page; stop points over the plan, with their signal in brackets."""
    stop = C("cls") == "haltepunkt"
    own = df.filter(R.is_in(C("cls"), R.GENERATED_NAME) & ~stop).select(*KEYS, "cls", "row_id")
    a = rank_in_group(own, [*KEYS, "cls"], ["row_id"], id_cell(), "no").withColumn("name", F.concat("cls", F.lit(" "), C("no").cast("string")))
    b = rank_in_group(df.filter(stop).select(*KEYS, "cls", "row_id"), ["layout_id"], ["row_id"], id_cell(), "no")
    base = F.concat(F.lit("haltepunkt "), C("no").cast("string"))
    if triples is not None:
        b = b.join(triples.select(*KEYS, "row_id", "signal_text"), [*KEYS, "row_id"], "left")
        base = F.when(T.filled(C("signal_text")), F.concat(base, F.lit(" ("), C("signal_text"), F.lit(")"))).otherwise(base)
    return a.select(*KEYS, "row_id", "cls", "name").unionByName(b.withColumn("name", base).select(*KEYS, "row_id", "cls", "name"))
