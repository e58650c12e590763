"""Checks that look at neighbours: duplicates, overlaps, missing coordinates, isolation, dangling names.

Rows are ``layout_id, page, row_id, cls, conf, cx, cy, x1, y1, x2, y2`` and the text columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotweave import rules as R
from plotweave.functions import geometry as G
from plotweave.functions import scoring as S
from plotweave.functions import text as T
from plotweave.operators import checks, iterative, ordered
from plotweave.operators.filters import visible
from plotweave.operators.spatial import BOX, KEYS, box_groups, near_pairs, nearest, nearest_any, overlapping, places
from plotweave.session import cut

C = F.col


def points(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*KEYS, "row_id", C("cx").alias("x"), C("cy").alias("y"), *cols)


# --- duplicates --------------------------------------------------------------------------------
def near_duplicates(df: DataFrame) -> DataFrame:
    """Rows closer to a better row of their class than the class limit.

    Rows at one position count as one place: each of them is reported once against the place's
    best row, and places are compared by their best rows. ``keep_copies`` and ``drop_copies`` say
    how many rows stand behind a pair, so the number of row pairs is their product.
    """
    limit = R.lookup(C("cls"), R.NEAR_DUPLICATE, R.NEAR_DUPLICATE_DEFAULT)
    d = points(df, "cls", "conf").withColumn("limit", limit).filter(C("limit").isNotNull())
    spot = [*KEYS, "cls", "x", "y"]
    best = F.min(F.struct((-C("conf")).alias("c"), "row_id"))
    p = d.groupBy(*spot, "limit").agg(best.alias("m"), F.count(F.lit(1)).alias("n")).select(
        *spot, "limit", C("m.row_id").alias("row_id"), (-C("m.c")).alias("conf"), "n"
    )
    same = d.join(p.filter(C("n") > 1).select(*spot, C("row_id").alias("keep_row")), spot).filter(C("row_id") != C("keep_row"))
    same = same.select(*KEYS, "cls", "keep_row", "row_id", F.lit(0.0).alias("dist"), F.lit(1).cast("long").alias("keep_copies"), F.lit(1).cast("long").alias("drop_copies"))
    widest = max([v for v in R.NEAR_DUPLICATE.values() if v] + [R.NEAR_DUPLICATE_DEFAULT])
    pairs = near_pairs(p, p, widest, [*KEYS, "cls"], (C("dist") < C("a_limit")) & (C("a_row_id") < C("b_row_id")))
    a_wins = C("a_conf") >= C("b_conf")

    def pick(first, second, name):
        return F.when(a_wins, C(first)).otherwise(C(second)).alias(name)

    apart = pairs.select(*KEYS, "cls", pick("a_row_id", "b_row_id", "keep_row"), pick("b_row_id", "a_row_id", "row_id"), "dist",
                         pick("a_n", "b_n", "keep_copies"), pick("b_n", "a_n", "drop_copies"))
    return same.unionByName(apart)


def has_neighbour(df: DataFrame, radius: float, on: list[str], strict: bool) -> DataFrame:
    """Keys of rows with another row of the same ``on`` group within the radius.

    Places of one small cell are neighbours of each other. Only what is alone in its cell, at most one
    place a cell, is searched for on the wider grid.
    """
    cell = [*on, "_sx", "_sy"]
    small = {"_sx": F.floor(C("x") / (0.7 * radius)), "_sy": F.floor(C("y") / (0.7 * radius))}
    p = places(df, ["x", "y"], on).withColumns(small)
    wide, high = F.max("x") - F.min("x"), F.max("y") - F.min("y")
    ids = F.min("row_id") < F.max("row_id")
    full = p.groupBy(*cell).agg((ids & (F.sqrt(wide * wide + high * high) < radius)).alias("_full")).filter("_full").select(*cell)
    crowded = p.filter(C("n") > 1).select(*on, "x", "y")
    single = p.filter(C("n") == 1)
    close = single.filter(C("row_id").isNotNull()).join(full, cell, "left_semi").select(*on, "x", "y")
    rest = single.join(full, cell, "left_anti").drop("_sx", "_sy", "n")
    limit = C("dist") < radius if strict else C("dist") <= radius
    hit = near_pairs(rest, p.drop("_sx", "_sy", "n"), radius, on, (C("a_row_id") != C("b_row_id")) & limit)
    found = crowded.unionByName(close).unionByName(hit.select(*on, C("a_x").alias("x"), C("a_y").alias("y")).distinct())
    return df.join(found, [*on, "x", "y"], "left_semi")


def isolated(df: DataFrame, radius: float = 1000.0) -> DataFrame:
    """Rows with no row of their class within ``radius``, where the page has at least three of them."""
    on = [*KEYS, "cls"]
    d = points(df, "cls")
    many = d.groupBy(*on).agg(F.count(F.lit(1)).alias("k")).filter(C("k") >= 3).select(*on)
    near = has_neighbour(d, radius, on, strict=False)
    return d.join(many, on, "left_semi").join(near.select("layout_id", "row_id"), ["layout_id", "row_id"], "left_anti")


def dangling_refs(df: DataFrame, name: str = "anchor_text") -> DataFrame:
    """Stop points whose bracketed signal does not exist on their page."""
    stops = df.filter(C("cls") == "haltepunkt").withColumn("signal_name", T.bracket_name(C(name))).filter(T.filled(C("signal_name")))
    signals = df.filter(C("cls") == "signal").select(*KEYS, T.text_or_empty(C(name)).alias("signal_name")).distinct()
    return stops.join(signals, [*KEYS, "signal_name"], "left_anti")


# --- overlaps ----------------------------------------------------------------------------------
def overlap_pairs(df: DataFrame, limit: float = 0.95) -> DataFrame:
    """Boxes of which the smaller lies inside the other. Identical boxes are reported against the first of them."""
    g = box_groups(df, ["cls"])
    whole = box_groups(df, [])
    same = df.select(*KEYS, "row_id", *BOX).join(whole.filter(C("n") > 1).select(*KEYS, *BOX, C("row_id").alias("first")), [*KEYS, *BOX])
    area = (C("x2") - C("x1")) * (C("y2") - C("y1"))
    same = same.filter((C("row_id") != C("first")) & (area > 0)).select(
        *KEYS, C("first").alias("row_id"), C("row_id").alias("other_row"), C("first").alias("smaller_row"), F.lit(1.0).alias("contained"), F.lit(1).cast("long").alias("n_pairs"))
    p = overlapping(whole, whole, where=(C("a_row_id") < C("b_row_id")) & (G.containment(G.box("a_"), G.box("b_")) >= limit))
    a_small = G.area(G.box("a_")) <= G.area(G.box("b_"))
    apart = p.select(*KEYS, C("a_row_id").alias("row_id"), C("b_row_id").alias("other_row"),
                     F.when(a_small, C("a_row_id")).otherwise(C("b_row_id")).alias("smaller_row"),
                     G.containment(G.box("a_"), G.box("b_")).alias("contained"), (C("a_n") * C("b_n")).alias("n_pairs"))
    return same.unionByName(apart)


def overlap_clusters(df: DataFrame, same_class: float = 0.05, other_class: float = 0.05) -> DataFrame:
    """Groups of boxes that each overlap two or more others: size, mean IoU, severity."""
    g = box_groups(df, ["cls"]).filter((C("x2") > C("x1")) & (C("y2") > C("y1")))
    limit = F.when(C("a_cls") == C("b_cls"), same_class).otherwise(other_class)
    rate = G.iou(G.box("a_"), G.box("b_"))
    edges = cut(overlapping(g, g, where=(C("a_row_id") < C("b_row_id")) & (rate >= limit)).select(
        "layout_id", C("a_row_id").alias("src"), C("b_row_id").alias("dst"), rate.alias("iou"), (C("a_n") * C("b_n")).alias("pairs"), C("a_n").alias("an"), C("b_n").alias("bn")))
    ends = edges.select("layout_id", C("src").alias("row_id"), C("bn").alias("k")).unionAll(edges.select("layout_id", C("dst"), C("an")))
    ends = ends.groupBy("layout_id", "row_id").agg(F.sum("k").alias("k"))
    multi = g.join(ends, ["layout_id", "row_id"], "left").withColumn("degree", F.coalesce("k", F.lit(0)) + C("n") - 1).filter(C("degree") >= 2)
    enough = multi.groupBy("layout_id").agg(F.sum("n").alias("t")).filter(C("t") >= 3).select("layout_id")
    multi = cut(multi.join(enough, "layout_id", "left_semi").select("layout_id", "row_id", "cls", "n"))
    node = F.struct("layout_id", "row_id")
    ids = multi.select("layout_id", "row_id")
    inner = (
        edges.join(ids.withColumnRenamed("row_id", "src"), ["layout_id", "src"], "left_semi")
        .join(ids.withColumnRenamed("row_id", "dst"), ["layout_id", "dst"], "left_semi")
    )
    comp = iterative.components(
        multi.select(node.alias("node")),
        inner.select(F.struct("layout_id", C("src").alias("row_id")).alias("src"), F.struct("layout_id", C("dst").alias("row_id")).alias("dst")),
    ).select(C("node.layout_id").alias("layout_id"), C("node.row_id").alias("row_id"), C("component.row_id").alias("rep"))
    members = multi.join(comp, ["layout_id", "row_id"]).groupBy("layout_id", "rep").agg(
        F.sum("n").alias("size"), F.sum(C("n") * (C("n") - 1)).alias("own"), F.array_join(F.array_sort(F.collect_set("cls")), ", ").alias("classes"))
    rates = inner.join(comp.withColumnRenamed("row_id", "src"), ["layout_id", "src"]).groupBy("layout_id", "rep").agg(
        F.sum(C("iou") * C("pairs") * 2).alias("total"), F.sum(C("pairs") * 2).alias("count"))
    out = members.join(rates, ["layout_id", "rep"], "left")
    count = F.coalesce("count", F.lit(0)) + C("own")
    mean = F.when(count > 0, (F.coalesce("total", F.lit(0.0)) + C("own")) / count).otherwise(0.0)
    return out.select("layout_id", C("rep").alias("row_id"), "size", "classes", mean.alias("mean_iou"), F.when(mean > 0.5, "error").otherwise("warning").alias("severity"))


# --- missing coordinates -----------------------------------------------------------------------
def coord_places(coords: DataFrame) -> DataFrame:
    return places(points(coords), ["x", "y"]).drop("n")


def nearest_distance(df: DataFrame, coords: DataFrame, radii: list[float]) -> DataFrame:
    """``min_distance`` of every row to a coordinate of its page; NULL if none is within the last radius."""
    near = nearest_any(points(df), coord_places(coords), radii)
    return df.join(near.select(*KEYS, "row_id", C("dist").alias("min_distance")), [*KEYS, "row_id"], "left")


def relation_issues(df: DataFrame, coords: DataFrame, radii: tuple | None = None) -> DataFrame:
    """Classes that need, or should have, a coordinate within their limit and have none.

    Without ``radii`` the search grows until it spans the largest page.
    """
    if radii is None:
        both = df.select("cx", "cy").unionByName(coords.select("cx", "cy"))
        ends = both.agg(*[f(c) for c in ("cx", "cy") for f in (F.min, F.max)]).first()
        span = sum((hi - lo) for lo, hi in (ends[:2], ends[2:])) if None not in ends else 0.0
        radii = [200.0]
        while radii[-1] < span:
            radii.append(4 * radii[-1])
    limit = R.lookup(C("cls"), {k: v[0] for k, v in R.RELATION.items()})
    level = R.lookup(C("cls"), {k: v[1] for k, v in R.RELATION.items()})
    d = nearest_distance(df.filter(limit.isNotNull()), coords, list(radii))
    far = C("min_distance").isNull() | (C("min_distance") > limit)
    return d.filter(far).select(*KEYS, "row_id", "cls", level.alias("severity"), "min_distance",
                                F.least(F.lit(1.0), F.coalesce("min_distance", F.lit(1e9)) / limit).alias("confidence"))


def without_coordinate(df: DataFrame, coords: DataFrame, radius: float, classes: list[str]) -> DataFrame:
    """Rows of the classes with no coordinate within ``radius`` on their page."""
    d = df.filter(R.is_in(C("cls"), classes))
    near = nearest_any(points(d), coord_places(coords), [radius / 4, radius])
    return d.join(near.select(*KEYS, "row_id"), [*KEYS, "row_id"], "left_anti")


def orphan_regions(df: DataFrame, coords: DataFrame, radius: float = 600.0) -> DataFrame:
    d = without_coordinate(df, coords, radius, ["signal", "gks_gesteuert", "gks_festkodiert", "weichen_block"])
    return checks.region(d, "orphaned_object", C("cx"), C("cy"), 100.0, 200.0, F.lit(0.7), C("cy") - 150.0)


def pattern_breaks(df: DataFrame, limit: float = 800.0) -> DataFrame:
    """Vertical gaps between a page's coordinates that hold signals. A page has few gaps that large."""
    coords = df.filter(C("cls") == "coordinate")
    signals = df.filter(C("cls").isin(R.NEED_TEXT)).select(*KEYS, C("cx").alias("sx"), C("cy").alias("sy"))
    counts = df.groupBy(*KEYS).agg(F.count_if(C("cls").isin(R.NEED_TEXT)).alias("s"), F.count_if(C("cls") == "coordinate").alias("c"))
    steps = ordered.next_value(coords, KEYS, "cy", 256.0).filter(C("next_value") - C("value") > limit)
    steps = steps.join(counts.filter((C("s") >= 3) & (C("c") >= 2)), KEYS, "left_semi")
    inside = steps.join(signals, KEYS).filter((C("sy") > C("value")) & (C("sy") < C("next_value")))
    g = inside.groupBy(*KEYS, "value", "next_value").agg(F.avg("sx").alias("mx"), F.count(F.lit(1)).alias("objects"))
    return checks.region(g, "pattern_break", C("mx"), (C("value") + C("next_value")) / 2, 150.0, 100.0, F.lit(0.8))


def missing_regions(df: DataFrame) -> DataFrame:
    """Where a coordinate was probably missed: sequence gaps, orphans and pattern breaks."""
    coords = df.filter(C("cls") == "coordinate")
    return checks.gap_regions(df).unionByName(orphan_regions(df, coords)).unionByName(pattern_breaks(df))


# --- scores ------------------------------------------------------------------------------------
def false_positives(df: DataFrame, coords: DataFrame) -> DataFrame:
    """Detections with several warning signs at once."""
    near = nearest(points(df), coord_places(coords), 200.0).select(*KEYS, "row_id", C("dist").alias("coord_dist"))
    d = df.filter(C("cls") != "coordinate").join(near, [*KEYS, "row_id"], "left").withColumn("flag_score", S.false_positive(C("coord_dist")))
    return d.filter(C("flag_score") >= 50).select(
        *KEYS, "row_id", "cls", "flag_score", F.when(C("flag_score") >= 70, "error").otherwise("warning").alias("severity"))


def inspector_risk(df: DataFrame, name: str = "anchor_text") -> DataFrame:
    """Row risk with neighbours and stop-point references taken into account."""
    near = has_neighbour(points(df, "cls"), 50.0, [*KEYS, "cls"], strict=True).select("layout_id", "row_id", F.lit(True).alias("_dup"))
    bad = dangling_refs(df, name).select("layout_id", "row_id", F.lit(True).alias("_ref"))
    d = df.join(near, ["layout_id", "row_id"], "left").join(bad, ["layout_id", "row_id"], "left")
    score, factors = S.inspector_risk(F.coalesce("_dup", F.lit(False)), F.coalesce("_ref", F.lit(False)))
    return d.withColumns({"risk_score": score, "risk_factors": factors}).drop("_dup", "_ref")


# --- everything --------------------------------------------------------------------------------
def validate(df: DataFrame, symbols: DataFrame | None = None, reference_filter: bool = False, stop_name: str = "anchor_text") -> DataFrame:
    """All default checks as one issue table.

    With ``reference_filter`` the coordinate rows are removed before the checks that search for
    them, which then find nothing; by default those checks see the coordinates.
    """
    rows = visible(df)
    coords = rows.filter(F.lit(False)) if reference_filter else df.filter((C("cls") == "coordinate") & ~F.coalesce("hidden", F.lit(False)))
    seen = rows.unionByName(coords)
    out = checks.row_issues(rows, checks.DEFAULT_RULES)

    def add(found: DataFrame, severity, category: str, field: str, confidence=0.0, current: Column | None = None):
        as_issue = checks.issue(F.lit(True), severity, category, field, F.lit(category.replace("_", " ")), current, None, False, confidence)
        return out.unionByName(checks.row_issues(found, [[as_issue]]))

    out = add(near_duplicates(rows), "warning", "duplicate", "position", current=F.concat(F.lit("keep "), C("keep_row").cast("string")))
    out = add(overlap_pairs(rows), "warning", "bbox_high_containment", "bbox", C("contained"))
    out = add(overlap_clusters(rows), C("severity"), "bbox_overlap_cluster", "bbox", 1.0 - C("mean_iou"))
    if not reference_filter:
        out = add(without_coordinate(rows, coords, 500.0, R.NEED_COORDINATE), "warning", "missing_coordinate", "coordinate")
    out = add(false_positives(rows, coords), C("severity"), "likely_false_positive", "detection", F.least(F.lit(1.0), C("flag_score") / 100.0))
    out = add(dangling_refs(rows, stop_name), "warning", "reference", "anchor_text")
    for extra in (checks.ratio_checks(rows), checks.pattern_outliers(seen), checks.length_outliers(rows), checks.link_distance_outliers(rows)):
        out = out.unionByName(extra)
    if symbols is not None:
        own = checks.with_symbols(rows, symbols)
        out = out.unionByName(checks.row_issues(own, [checks.symbol_rules, checks.symbol_suspects]))
    return out
