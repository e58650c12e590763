"""Travel direction of signals: balise nearby, track beside, wider searches; merging repeated signals.

``A`` = balise or track above the signal, ``B`` = below, seen in the signal's own orientation.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotweave import rules as R
from plotweave.functions import geometry as G
from plotweave.functions import text as T
from plotweave.operators import ordered
from plotweave.operators.linking import raw_angle
from plotweave.operators.spatial import KEYS, near_pairs, nearest, places
from plotweave.session import cut

C = F.col
NEED = ["layout_id", "page", "row_id"]
#: Rays whose cells go to one task.
RAYS = 10_000


def corrected_angle(raw: Column, w: Column, h: Column) -> Column:
    """Raw angle, turned by 90 degrees where the box shape contradicts it."""
    flat = (w > h * 1.2) & F.abs(raw).between(75.0, 105.0)
    tall = (h > w * 1.2) & ((F.abs(raw) < 15.0) | (F.abs(raw - 180.0) < 15.0))
    return F.when(flat, raw - 90.0).when(tall, raw + 90.0).otherwise(raw)


def _signals(df: DataFrame) -> DataFrame:
    d = raw_angle(df).filter(~T.is_exempt(C("anchor_text")))
    turn = corrected_angle(C("angle_raw"), C("w"), C("h"))
    return d.withColumn("turn", turn).select(*NEED, C("cx").alias("x"), C("cy").alias("y"), "angle", "turn", G.angle_class(C("turn")).alias("kind"))


def _gks(gks: DataFrame) -> DataFrame:
    return places(gks, ["cx", "cy", "angle"]).select(*NEED, C("cx").alias("x"), C("cy").alias("y"), "angle")


def _window(v: Column, lateral: Column, near: float, far: float, side: float) -> Column:
    inside = (lateral > -side) & (lateral < side)
    return F.when((v > near) & (v < far) & inside, "B").when((v > -far) & (v < -near) & inside, "A")


def direction_strict(signals: DataFrame, gks: DataFrame, radius: float = 250.0) -> DataFrame:
    """First tier: the nearest balise decides by its side, if it lies in the window there."""
    fits = (C("a_kind") != "angular") | (G.turn_between(C("a_angle"), C("b_angle")) <= 20)
    s = _signals(signals)
    n = nearest(s, _gks(gks), radius, where=fits, carry=["x", "y"]).drop("dist")
    d = s.join(n, NEED).withColumns({"dx": C("b_x") - C("x"), "dy": C("b_y") - C("y")})
    lx, ly = G.local_offset(C("dx"), C("dy"), C("turn"))
    v = F.when(C("kind") == "angular", ly).when(C("kind") == "vertical", C("dx")).otherwise(C("dy"))
    side = F.when(C("kind") == "angular", lx).when(C("kind") == "vertical", C("dy")).otherwise(C("dx"))
    return d.select(*NEED, _window(v, side, 30, 200, 120).alias("direction"), C("b_row_id").alias("gks_id")).filter(C("direction").isNotNull())


def direction_relaxed(signals: DataFrame, gks: DataFrame) -> DataFrame:
    """Third tier: nearest balise above or below in the signal's column."""
    dx, dy = F.abs(C("b_x") - C("a_x")), F.abs(C("b_y") - C("a_y"))
    fits = (dx <= 200) & dy.between(30, 600) & (dy >= dx) & (G.turn_between(C("a_angle"), C("b_angle")) <= 25)
    s = _signals(signals)
    n = nearest(s, _gks(gks), 633.0, where=fits, carry=["y"], order=[dy])
    return _above_or_below(s, n)


def direction_nearest(signals: DataFrame, gks: DataFrame, radius: float = 800.0) -> DataFrame:
    """Fourth tier: nearest balise that is more above or below than beside."""
    dx, dy = F.abs(C("b_x") - C("a_x")), F.abs(C("b_y") - C("a_y"))
    fits = (dy >= 30) & (dy >= dx * 0.5) & (G.turn_between(C("a_angle"), C("b_angle")) <= 30)
    s = _signals(signals)
    return _above_or_below(s, nearest(s, _gks(gks), radius, where=fits, carry=["y"]))


def _above_or_below(s: DataFrame, n: DataFrame) -> DataFrame:
    d = s.select(*NEED, "y").join(n.drop("dist"), NEED)
    return d.select(*NEED, F.when(C("b_y") < C("y"), "A").otherwise("B").alias("direction"), C("b_row_id").alias("gks_id"))


def direction_track(signals: DataFrame, pixels: DataFrame, bounds: DataFrame, sheets: DataFrame, key: list[str] = NEED,
                    most: int = 1500, window: int = 25, cell: int = 64) -> DataFrame:
    """Second tier: rays to both sides, square to the signal, until a track pixel lies in the window.

    The ray is not stepped: for one pixel the steps that see it form an interval in closed form.
    Only pixels of the grid cells along the ray are looked at. A ray becomes a row for each of its cells, which sizes
    of files do not tell, so rays are counted first and a task gets the cells of some ``RAYS`` of them.
    """
    d = raw_angle(signals).filter(~T.is_exempt(C("anchor_text"))).withColumn("turn", corrected_angle(C("angle_raw"), C("w"), C("h")))
    d = d.join(sheets, KEYS).join(bounds.select(*KEYS, "y_min", "y_max"), KEYS, "left")
    d = d.withColumns({"sx": C("cx").cast("int"), "sy": C("cy").cast("int"), "angular": G.angle_class(C("turn")) == "angular"})
    a = F.radians(C("turn") + 90.0)
    whole = F.greatest("width", "height")
    up = F.when(C("angular") | C("y_min").isNull(), whole).otherwise(C("sy") - C("y_min"))
    down = F.when(C("angular") | C("y_max").isNull(), whole).otherwise(C("y_max") - C("sy"))

    def ray(side: str, sign: float, length: Column) -> Column:
        return F.struct(
            F.lit(side).alias("side"),
            F.when(C("angular"), sign * F.cos(a)).otherwise(0.0).alias("ux"), F.when(C("angular"), sign * F.sin(a)).otherwise(-sign).alias("uy"),
            F.least(length.cast("int"), F.lit(most)).alias("len"),
        )

    d = d.select(*key, "sx", "sy", "angular", "width", "height", F.explode(F.array(ray("above", 1.0, up), ray("below", -1.0, down))).alias("r")).filter(C("r.len") >= 1)
    d = cut(d)
    tasks = max(d.sparkSession.sparkContext.defaultParallelism, math.ceil(d.count() / RAYS))
    # upright rays run inside one or two columns of cells; tilted ones are followed cell by cell
    upright = d.filter(~C("angular"))
    end = C("sy") + C("r.uy") * C("r.len")
    lo_y, hi_y = F.least(C("sy").cast("double"), end) - window - 1, F.greatest(C("sy").cast("double"), end) + window + 1
    upright = upright.withColumn("_gx", F.explode(F.sequence(F.floor((C("sx") - window) / cell), F.floor((C("sx") + window) / cell)))).withColumn(
        "_gy", F.explode(F.sequence(F.floor(lo_y / cell), F.floor(hi_y / cell))))
    tilted = d.filter("angular").withColumn("_s", F.explode(F.sequence(F.lit(0), F.floor(C("r.len") / cell).cast("int") + 1)))
    at_x = F.floor((C("sx") + C("_s") * cell * C("r.ux")) / cell)
    at_y = F.floor((C("sy") + C("_s") * cell * C("r.uy")) / cell)
    tilted = tilted.withColumn("_gx", F.explode(F.sequence(at_x - 1, at_x + 1))).withColumn("_gy", F.explode(F.sequence(at_y - 1, at_y + 1)))
    d = upright.unionByName(tilted.drop("_s").distinct())
    p = pixels.select(*KEYS, C("x").alias("px"), C("y").alias("py"), F.floor(C("x") / cell).alias("_gx"), F.floor(C("y") / cell).alias("_gy"))
    at = [*KEYS, "_gx", "_gy"]
    j = d.repartition(tasks, *at).hint("merge").join(p.repartition(tasks, *at), at)

    def steps(origin: Column, unit: Column, pixel: Column) -> tuple[Column, Column]:
        """First and last step whose window holds the pixel along one axis."""
        still = unit == 0
        hit = (pixel >= origin - window) & (pixel < origin + window)
        # position p = floor(origin + d * unit) must satisfy pixel - window < p <= pixel + window
        lo_pos, hi_pos = (pixel - window + 1).cast("double"), (pixel + window + 1).cast("double")
        first = F.when(unit > 0, F.ceil((lo_pos - origin) / unit)).otherwise(F.floor((hi_pos - origin) / unit) + 1)
        last = F.when(unit > 0, F.ceil((hi_pos - origin) / unit) - 1).otherwise(F.floor((lo_pos - origin) / unit))
        none = F.lit(1 << 30).cast("long")
        return (F.when(still, F.when(hit, F.lit(1).cast("long")).otherwise(none)).otherwise(first),
                F.when(still, F.when(hit, none).otherwise(F.lit(0).cast("long"))).otherwise(last))

    # a zero unit is replaced so that the unused branch cannot divide by zero
    ux = F.when(F.abs("r.ux") < 1e-12, 0.0).otherwise(C("r.ux"))
    uy = F.when(F.abs("r.uy") < 1e-12, 0.0).otherwise(C("r.uy"))
    j = j.withColumns({"ux": ux, "uy": uy})

    def axis(origin, unit, pixel):
        lo, hi = steps(origin, F.when(C(unit) == 0, F.lit(None).cast("double")).otherwise(C(unit)), pixel)
        flat_lo, flat_hi = steps(origin, F.lit(0.0), pixel)
        return F.when(C(unit) == 0, flat_lo).otherwise(lo), F.when(C(unit) == 0, flat_hi).otherwise(hi)

    x_lo, x_hi = axis(C("sx"), "ux", C("px"))
    y_lo, y_hi = axis(C("sy"), "uy", C("py"))
    j = j.withColumns({"lo": F.greatest(x_lo, y_lo, F.lit(1)), "hi": F.least(x_hi, y_hi, C("r.len"))}).filter(C("lo") <= C("hi"))
    # the window's centre has to be on the page
    end_x, end_y = F.floor(C("sx") + C("lo") * C("ux")), F.floor(C("sy") + C("lo") * C("uy"))
    j = j.filter((end_x >= 0) & (end_x < C("width")) & (end_y >= 0) & (end_y < C("height")))
    g = j.groupBy(*key, "angular").agg(F.min(F.when(C("r.side") == "above", C("lo"))).alias("above"), F.min(F.when(C("r.side") == "below", C("lo"))).alias("below"))
    first_above = C("above").isNotNull() & (C("below").isNull() | (C("above") < C("below")))
    side = F.when(C("angular"), F.when(first_above, "B").otherwise("A")).otherwise(F.when(first_above, "A").otherwise("B"))
    return g.select(*key, side.alias("direction"), "above", "below")


def resolve_direction(df: DataFrame, pixels: DataFrame, bounds: DataFrame, sheets: DataFrame, gks: DataFrame) -> DataFrame:
    """Direction and its source for signals: kept, first tier, track, wider searches, or none.

    Signals with stored positions (``positions``: map of name to centre ``cx, cy``) let every position
    but the stop point's vote on the track; more than half of the votes must agree.
    """
    open_ = df.filter(F.coalesce("fahrtrichtung", F.lit("")) == "")
    one = direction_strict(open_, gks).select(*NEED, C("direction").alias("d1"))
    rest = open_.join(one, NEED, "left_anti")
    if "positions" in df.columns:
        spots = rest.filter(C("positions").isNotNull() & (F.size("positions") > 0)).select(
            *[c for c in rest.columns if c not in ("positions", "cx", "cy")], F.explode("positions").alias("spot", "at"))
        spots = spots.filter(C("spot") != "haltepunkt_signal").withColumns({"cx": C("at.cx"), "cy": C("at.cy")})
        single = rest.filter(C("positions").isNull() | (F.size("positions") == 0)).withColumn("spot", F.lit("self"))
        seen = spots.drop("at").unionByName(single.drop("positions"))
    else:
        seen = rest.withColumn("spot", F.lit("self"))
    votes = direction_track(seen, pixels, bounds, sheets, key=[*NEED, "spot"])
    v = votes.groupBy(*NEED).agg(F.count_if(C("direction") == "A").alias("a"), F.count_if(C("direction") == "B").alias("b"))
    two = v.select(*NEED, F.when(C("a") > C("b"), "A").when(C("b") > C("a"), "B").alias("d2")).filter(C("d2").isNotNull())
    rest2 = rest.join(two, NEED, "left_anti")
    three = direction_relaxed(rest2, gks).select(*NEED, C("direction").alias("d3"))
    four = direction_nearest(rest2.join(three, NEED, "left_anti"), gks).select(*NEED, C("direction").alias("d4"))
    d = df
    for tier in (one, two, three, four):
        d = d.join(tier, NEED, "left")
    old = F.nullif(C("fahrtrichtung"), F.lit(""))
    source = (
        F.when(old.isNotNull(), C("direction_source")).when(C("d1").isNotNull(), "gks").when(C("d2").isNotNull(), "track")
        .when(C("d3").isNotNull(), "gks_relaxed").when(C("d4").isNotNull(), "gks_nearest").otherwise("none")
    )
    return d.withColumns({"fahrtrichtung": F.coalesce(old, "d1", "d2", "d3", "d4"), "direction_source": source}).drop("d1", "d2", "d3", "d4")


# --- repeated signals --------------------------------------------------------------------------
def cluster_radius(df: DataFrame) -> DataFrame:
    """Merge radius per plan from the vertical gaps between its named signals."""
    s = df.filter((C("cls") == "signal") & (F.coalesce("anchor_text", F.lit("")) != ""))
    count = s.groupBy("layout_id").agg(F.count(F.lit(1)).alias("signals"))
    steps = ordered.next_value(s, ["layout_id"], "cy", 64.0)
    gaps = steps.filter(C("next_value").isNotNull()).select("layout_id", (C("next_value") - C("value")).alias("gap"), F.lit(1).cast("long").alias("k"))
    gaps = gaps.unionByName(steps.filter(C("n_rows") > 1).select("layout_id", F.lit(0.0).alias("gap"), (C("n_rows") - 1).alias("k")))
    mid = ordered.order_statistics(gaps, ["layout_id"], "gap", 16.0, {"mid": F.floor(C("n") / 2) + 1}, weight="k")
    large = gaps.join(mid, "layout_id").filter(C("gap") > C("mid") * 3).groupBy("layout_id").agg((F.sum(C("gap") * C("k")) / F.sum("k")).alias("mean_large"))
    r = F.when(C("signals") < 10, 1500).when(C("mean_large").isNull(), 1000).otherwise(
        F.greatest(F.lit(1000), F.least(F.lit(2500), (C("mean_large") * 0.4).cast("int"))))
    return count.join(large, "layout_id", "left").select("layout_id", "signals", r.cast("int").alias("radius"))


SPOTS, ROW_HEIGHT = 65536, 16.0
GROUP = [*KEYS, "name", "stretch"]
SCAN = "layout_id LONG, page INT, name STRING, stretch LONG, x DOUBLE, y DOUBLE, n LONG, radius DOUBLE, more BOOLEAN, state BOOLEAN, cluster INT, made INT"


def _ranges(spots: DataFrame, most: int) -> DataFrame:
    """Stretch of every position, and the round in which its range of the stretch is scanned.

    Rows of ``ROW_HEIGHT`` pixels are counted first, so only they are ordered inside a name: a stretch ends where the next row
    is further than the radius, and a range takes whole rows until it has ``most`` positions.
    """
    keys = [*KEYS, "name"]
    d = spots.withColumn("_row", F.floor(C("y") / ROW_HEIGHT))
    rows = d.groupBy(*keys, "_row").agg(F.min("y").alias("lo"), F.max("y").alias("hi"), F.count(F.lit(1)).alias("k"), F.max("radius").alias("r"))
    w = Window.partitionBy(*keys).orderBy("_row")
    rows = rows.withColumn("_cut", F.when(C("lo") - F.lag("hi").over(w) > C("r"), 1).otherwise(0))
    rows = rows.withColumn("stretch", F.sum("_cut").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    before = Window.partitionBy(*GROUP).orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("round", F.floor(F.coalesce(F.sum("k").over(before), F.lit(0)) / most))
    rows = rows.withColumn("more", C("round") < F.max("round").over(Window.partitionBy(*GROUP)))
    return d.join(rows.select(*keys, "_row", "stretch", "round", "more"), [*keys, "_row"]).drop("_row")


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sequential clustering over positions sorted by group, y and x: nearest running centre within the radius, or a new one.

    A centre that has fallen behind by more than the radius can win no later position and is forgotten, so only the open
    centres are held. Rows with ``state`` are open centres (``x``, ``y`` are sums) of the range before; a group with more
    ranges to come ends with such rows.
    """
    group, centres, made, more, radius = None, [], 0, False, 0.0

    def left() -> list[tuple]:
        return [(*group, sx, sy, n, radius, False, True, c, made) for sx, sy, n, c in centres] if more else []

    for pdf in batches:
        out = []
        keys = zip(pdf["layout_id"], pdf["page"], pdf["name"], pdf["stretch"], strict=True)
        rows = zip(pdf["x"], pdf["y"], pdf["n"], pdf["radius"], pdf["more"], pdf["state"], pdf["cluster"], pdf["made"], strict=True)
        for key, (x, y, n, r, goes_on, state, cluster, so_far) in zip(keys, rows, strict=True):
            if key != group:
                out += left()
                group, centres, made, more, radius = key, [], 0, False, r
            if state:
                centres.append([x, y, n, int(cluster)])
                made = int(so_far)
                continue
            more = goes_on
            centres = [c for c in centres if not y - c[1] / c[2] > radius * 1.001]
            best, best_d = None, radius
            for c in centres:
                d = ((x - c[0] / c[2]) ** 2 + (y - c[1] / c[2]) ** 2) ** 0.5
                if d < best_d:
                    best, best_d = c, d
            if best is None:
                best = [0.0, 0.0, 0, made]
                centres.append(best)
                made += 1
            best[0] += x * n
            best[1] += y * n
            best[2] += n
            out.append((*key, x, y, n, radius, goes_on, False, best[3], made))
        yield pd.DataFrame(out, columns=[*GROUP, "x", "y", "n", "radius", "more", "state", "cluster", "made"])
    if rest := left():
        yield pd.DataFrame(rest, columns=[*GROUP, "x", "y", "n", "radius", "more", "state", "cluster", "made"])


def signal_clusters(df: DataFrame, radius: DataFrame, most: int = SPOTS) -> DataFrame:
    """Cluster number of every named signal among its namesakes of one stretch of the page.

    Rows at one position always share a cluster, so only distinct positions are scanned, from top to bottom. A stretch is
    scanned in ranges of about ``most`` positions, one a round: a round scans the next range of all stretches at once and
    hands its open centres to the next. Rows without a page or a position belong to no cluster.
    """
    name = T.strip(C("anchor_text"))
    s = df.filter((C("cls") == "signal") & T.filled(C("anchor_text"))).withColumn("name", name)
    spots = s.dropna(subset=["page", "cx", "cy"]).groupBy(*KEYS, "name", C("cx").alias("x"), C("cy").alias("y")).agg(F.count(F.lit(1)).alias("n"))
    many = spots.groupBy(*KEYS, "name").agg(F.sum("n").alias("k")).filter(C("k") > 1)
    spots = spots.join(many, [*KEYS, "name"], "left_semi").join(radius.select("layout_id", C("radius").cast("double")), "layout_id")
    empty = [F.lit(False).alias("state"), F.lit(None).cast("int").alias("cluster"), F.lit(0).alias("made")]
    spots = cut(_ranges(spots, most).select(*GROUP, "x", "y", "n", "radius", "more", *empty, "round"))
    last = spots.agg(F.max("round")).first()[0] or 0
    steps: list[DataFrame] = []
    for r in range(last + 1):
        part = spots.filter(C("round") == r).drop("round")
        if steps:
            part = part.unionByName(steps[-1].filter("state"))
        part = part.repartition(*GROUP).sortWithinPartitions(*GROUP, F.desc("state"), "cluster", "y", "x")
        steps.append(cut(part.mapInPandas(_scan, SCAN)))
    found = reduce(DataFrame.unionByName, [d.filter("NOT state") for d in steps])
    return s.join(found.select(*GROUP, C("x").alias("cx"), C("y").alias("cy"), "cluster"), [*KEYS, "name", "cx", "cy"])


CLUSTER = [*GROUP, "cluster"]
BOX = ["x1", "y1", "x2", "y2"]


def merge_signals(df: DataFrame, radius: DataFrame, stop_coords: DataFrame) -> DataFrame:
    """One visible row per repeated signal: the row with the coordinate, the direction another row knows.

    ``stop_coords(layout_id, page, name, stop_coord)`` are coordinates that belong to a stop point.
    Adds ``hidden``, ``merged`` and ``positions`` (role -> centre, box and row).
    """
    s = cut(signal_clusters(df, radius))
    size = s.groupBy(*CLUSTER).agg(F.count(F.lit(1)).alias("_size"))
    s = s.join(size.filter(C("_size") > 1), CLUSTER).join(stop_coords, [*KEYS, "name"], "left")
    coord, fahr = F.coalesce("coord_text", F.lit("")) != "", F.coalesce("fahrtrichtung", F.lit("")) != ""
    role = (
        F.when(coord & fahr, "both").when(fahr, "direction")
        .when(coord & ~F.coalesce(C("coord_text") == C("stop_coord"), F.lit(False)), "coord").otherwise("stop")
    )
    km = F.abs(F.replace(C("coord_text"), F.lit(","), F.lit(".")).try_cast("double") - F.replace(C("stop_coord"), F.lit(","), F.lit(".")).try_cast("double"))
    s = s.withColumns({"role": role, "_far": -F.coalesce(km, F.lit(0.0))})
    turn = F.struct("cy", "cx", "row_id", "fahrtrichtung", *BOX)

    def first(r: str, extra: Column | None = None) -> Column:
        return F.min(F.when(C("role") == r if extra is None else (C("role") == r) & extra, turn))

    g = s.groupBy(*CLUSTER).agg(
        first("coord").alias("c"), F.min(F.when(C("role") == "coord", F.struct("_far", turn.alias("t")))).alias("cf"),
        F.max("stop_coord").alias("sc"), F.max(F.when(C("role") == "coord", km.isNull())).alias("unparsed"),
        first("both").alias("b"), first("both", C("direction_source") == "gks").alias("bg"),
        F.min(F.when(C("role") == "both", F.struct(turn.alias("t"), "direction_source"))).alias("bs"),
        first("direction").alias("f"), first("stop").alias("h"),
    )
    far = C("sc").isNotNull() & ~F.coalesce("unparsed", F.lit(True))
    only = F.when(far, C("cf.t")).otherwise(C("c"))
    primary = F.coalesce(only, C("b"))
    from_gks = F.when(C("c").isNotNull(), C("bg.fahrtrichtung")).when(C("bs.direction_source") == "gks", C("b.fahrtrichtung"))

    def spot(c: str, name: str) -> Column:
        p = primary if c == "p" else C(c)
        return F.when(p.isNotNull(), F.struct(F.lit(name).alias("key"), F.struct(*[p[v].alias(v) for v in ("cx", "cy", *BOX, "row_id")]).alias("value")))

    g = g.select(
        *CLUSTER, primary["row_id"].alias("_primary"), far.alias("_far_pick"), C("c").isNotNull().alias("_has_coord"),
        F.coalesce(C("f.fahrtrichtung"), from_gks).alias("_dir"), C("f.row_id").alias("_fid"),
        F.map_from_entries(F.array_compact(F.array(spot("p", "coordinate_signal"), spot("f", "fahrtrichtung_signal"), spot("h", "haltepunkt_signal")))).alias("_pos"),
    )
    m = s.join(g, CLUSTER)
    is_primary = C("row_id") == C("_primary")
    gone = F.when(C("_primary").isNull(), C("role") == "stop").otherwise(
        ~is_primary & (C("role").isin("both", "direction", "stop") | C("_far_pick")))
    m = m.select(
        "layout_id", "row_id", is_primary.alias("_is"), F.coalesce(gone, F.lit(False)).alias("_gone"), "_dir", "_pos")
    is_p = F.coalesce("_is", F.lit(False))
    return (
        df.join(m, ["layout_id", "row_id"], "left")
        .withColumns({
            "fahrtrichtung": F.when(is_p, C("_dir")).otherwise(C("fahrtrichtung")),
            "direction_source": F.when(is_p & C("_dir").isNotNull(), "gks").when(is_p, "none").otherwise(C("direction_source")),
            "positions": F.when(is_p, C("_pos")), "merged": is_p,
            "hidden": F.coalesce("_gone", F.lit(False)) | F.coalesce("hidden", F.lit(False)),
        }).drop("_is", "_gone", "_dir", "_pos")
    )


# --- renaming ----------------------------------------------------------------------------------
def merge_renamed(df: DataFrame, renames: DataFrame, radius: float = 1500.0) -> DataFrame:
    """What a renamed signal becomes among its new namesakes nearby.

    ``renames(layout_id, row_id, new_name)``. One row per rename: the primary row, its direction and
    coordinate, and the number of rows hidden behind it; ``members`` of :func:`renamed_members` list them.
    """
    m = renamed_members(df, renames, radius)
    key = ["layout_id", "renamed_row"]
    own = C("row_id") == C("renamed_row")
    best = F.max(F.struct("score", own.alias("own"), (-C("row_id")).alias("r"), "fahrtrichtung", "prio", "coord_text"))
    me = F.max(F.when(own, F.struct("fahrtrichtung", "prio", "coord_text")))
    known = F.min(F.when(~own & (F.coalesce("fahrtrichtung", F.lit("")) != ""), F.struct("row_id", "fahrtrichtung")))
    g = m.groupBy(*key, "new_name").agg(best.alias("p"), me.alias("me"), known.alias("other"), F.count(F.lit(1)).alias("n"))
    mine = F.nullif(C("me.fahrtrichtung"), F.lit(""))
    theirs = F.nullif(C("p.fahrtrichtung"), F.lit(""))
    swapped = F.when(mine.isNotNull() & (theirs.isNull() | (C("me.prio") > C("p.prio"))), mine).otherwise(theirs)
    return g.select(
        *key, "new_name", (-C("p.r")).alias("primary_row"), (C("n") - 1).alias("hidden_rows"),
        F.when(C("p.own"), F.coalesce(mine, C("other.fahrtrichtung"))).otherwise(swapped).alias("fahrtrichtung"), C("p.coord_text").alias("coord_text"))


def renamed_members(df: DataFrame, renames: DataFrame, radius: float = 1500.0) -> DataFrame:
    """The renamed row and the visible signals of the new name around it, each with its score."""
    score = (
        F.when(F.coalesce("coord_text", F.lit("")) != "", 1000.0).otherwise(0.0) + F.coalesce("conf", F.lit(0.0)) * 10
        + F.when(F.coalesce("fahrtrichtung", F.lit("")) != "", 50.0).otherwise(0.0)
    )
    s = df.filter((C("cls") == "signal") & ~F.coalesce("hidden", F.lit(False))).withColumns({
        "score": score, "prio": R.lookup(F.coalesce("direction_source", F.lit("none")), R.DIRECTION_PRIORITY, 0), "_n": F.upper(T.strip(C("anchor_text")))})
    cols = ["row_id", "score", "fahrtrichtung", "prio", "coord_text", "cx", "cy"]
    me = s.join(renames, ["layout_id", "row_id"]).withColumn("_n", F.upper(T.strip(C("new_name"))))
    here = me.select(*KEYS, "_n", "new_name", C("row_id").alias("renamed_row"), C("cx").alias("mx"), C("cy").alias("my"))
    near = s.select(*KEYS, "_n", *cols).join(here, [*KEYS, "_n"]).filter(
        (C("row_id") != C("renamed_row")) & (G.distance(C("mx"), C("my"), C("cx"), C("cy")) <= radius))
    own = me.select(*KEYS, "_n", *cols, "new_name", C("row_id").alias("renamed_row"), C("cx").alias("mx"), C("cy").alias("my"))
    return near.unionByName(own).drop("mx", "my", "_n")


def recompute_direction(df: DataFrame, renames: DataFrame, gks: DataFrame) -> DataFrame:
    """Direction of renamed signals: none if exempt, unanimous namesakes, else the balise searches."""
    s = df.filter(C("cls") == "signal")
    me = s.join(renames, ["layout_id", "row_id"]).withColumn("anchor_text", C("new_name"))
    name = F.upper(T.strip(C("anchor_text")))
    # per name: how many rows say A and B; a renamed row that already had the name is taken out again
    ok = C("fahrtrichtung").isin("A", "B") & ~F.coalesce("hidden", F.lit(False))
    say = s.filter(ok).groupBy("layout_id", name.alias("_n")).agg(F.count_if(C("fahrtrichtung") == "A").alias("na"), F.count_if(C("fahrtrichtung") == "B").alias("nb"))
    own = s.filter(ok).select("layout_id", "row_id", name.alias("_old"), C("fahrtrichtung").alias("_was"))
    d = me.withColumn("_n", name).join(say, ["layout_id", "_n"], "left").join(own, ["layout_id", "row_id"], "left")
    mine = F.coalesce(C("_old") == C("_n"), F.lit(False))
    na = F.coalesce("na", F.lit(0)) - F.when(mine & (C("_was") == "A"), 1).otherwise(0)
    nb = F.coalesce("nb", F.lit(0)) - F.when(mine & (C("_was") == "B"), 1).otherwise(0)
    same = F.when((na > 0) & (nb == 0), "A").when((nb > 0) & (na == 0), "B")
    one, three, four = direction_strict(me, gks), direction_relaxed(me, gks), direction_nearest(me, gks)
    for k, tier in (("t1", one), ("t3", three), ("t4", four)):
        d = d.join(tier.select(*NEED, C("direction").alias(k)), NEED, "left")
    return d.select(*NEED, "new_name", F.when(~T.is_exempt(C("new_name")), F.coalesce(same, "t1", "t3", "t4")).alias("fahrtrichtung"))
