"""Comparing two versions of plans: match by id, match the rest by score, classify, summarise.

Rows carry ``layout_id, detection_id, row_id, page, cls, anchor_text, coord_text, coord_value,
fahrtrichtung, cx, cy``; ``layout_id`` is the same for both versions.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotweave import rules as R
from plotweave.functions import geometry as G
from plotweave.functions import scoring as S
from plotweave.functions import text as T
from plotweave.operators import iterative
from plotweave.operators.filters import visible
from plotweave.operators.spatial import prefixed
from plotweave.session import cut

C = F.col
ID = ["layout_id", "detection_id"]
FIELDS = ["row_id", "page", "cls", "anchor_text", "coord_text", "coord_value", "fahrtrichtung", "cx", "cy"]
#: Possible pairs of a connected group that one task assigns; larger groups are assigned by rounds over all tasks.
TASK_EDGES = 200_000
#: Cells of the score tables of connected groups that one task gets, besides the rest of a last group.
TASK_CELLS = 100_000
#: Scores count in steps of one part of this.
GRID = 1_000_000


def elements(df: DataFrame) -> DataFrame:
    """One visible row per detection id (the last one), without the classes that are not compared."""
    d = visible(df).filter(T.filled(C("detection_id")))
    cols = [c for c in FIELDS if c != "row_id"]
    return d.groupBy(*ID).agg(F.max(F.struct("row_id", *cols)).alias("m")).select(*ID, "m.*")


def match_ids(old: DataFrame, new: DataFrame) -> DataFrame:
    """Pairs with the same detection id."""
    return old.select(*ID).join(new.select(*ID), ID).select("layout_id", C("detection_id").alias("old_id"), C("detection_id").alias("new_id"))


def unmatched(df: DataFrame, matches: DataFrame, side: str) -> DataFrame:
    return df.join(matches.select("layout_id", C(side).alias("detection_id")), ID, "left_anti")


def _rare_letters(names: DataFrame, counts: DataFrame, limit: float) -> DataFrame:
    """Each name with the rarest of its letters, numbered within the name, as search keys.

    A ratio of ``limit`` means that ``limit / 2`` of both names' letters match, so both share that many numbered letters and
    none is shorter than ``limit / (2 - limit)`` of the other. A name that can leave out only k of its n letters
    shares one of its k + 1 rarest with every partner: the keys are complete for names of any length.
    """
    n = F.length("name")
    letters = names.select("layout_id", "name", n.alias("n"), F.explode(F.split("name", "")).alias("letter")).filter("letter <> ''")
    numbered = letters.groupBy("layout_id", "name", "n", "letter").agg(F.count(F.lit(1)).alias("k"))
    numbered = numbered.select("layout_id", "name", "n", "letter", F.explode(F.sequence(F.lit(1), C("k").cast("int"))).alias("no"))
    ranked = numbered.join(counts, ["letter", "no"]).groupBy("layout_id", "name", "n").agg(F.sort_array(F.collect_list(F.struct("times", "letter", "no"))).alias("all"))
    least = F.ceil(C("n") * (limit / (2 - limit)) - 1e-9)
    keys = F.slice("all", F.lit(1), (C("n") - least + 1).cast("int"))
    return ranked.select("layout_id", "name", F.explode(keys).alias("key")).select("layout_id", "name", F.concat("key.letter", C("key.no").cast("string")).alias("key"))


def similar_names(old: DataFrame, new: DataFrame, limit: float = 0.9) -> DataFrame:
    """Different signal names of a plan with a ratio of at least ``limit``."""
    def names(d):
        return d.filter(C("cls") == "signal").select("layout_id", T.text_or_empty(C("anchor_text")).alias("name")).filter(C("name") != "").distinct()

    both = cut(names(old).withColumn("_old", F.lit(True)).unionByName(names(new).withColumn("_old", F.lit(False))))
    # how many names have a letter so often: as many rows as there are letters in use
    per = both.select("name", F.explode(F.split("name", "")).alias("letter")).filter("letter <> ''").groupBy("name", "letter").agg(F.count(F.lit(1)).alias("k"))
    counts = cut(per.select("letter", F.explode(F.sequence(F.lit(1), C("k").cast("int"))).alias("no")).groupBy("letter", "no").agg(F.count(F.lit(1)).alias("times")))
    a = _rare_letters(both.filter("_old").drop("_old"), counts, limit).withColumnRenamed("name", "a_name")
    b = _rare_letters(both.filter("NOT _old").drop("_old"), counts, limit).withColumnRenamed("name", "b_name")
    la, lb = F.length("a_name"), F.length("b_name")
    p = a.join(b, ["layout_id", "key"]).filter((C("a_name") != C("b_name")) & (2 * F.least(la, lb) >= limit * (la + lb))).select("layout_id", "a_name", "b_name").distinct()
    r = p.select("a_name", "b_name").distinct().withColumn("ratio", T.similarity("a_name", "b_name")).filter(C("ratio") >= limit)
    return p.join(r, ["a_name", "b_name"])


def match_candidates(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old and new rows of one class whose score can be above zero, with that score.

    Every way to score has an equality key of its own: equal or similar names, equal stop-point
    signal, kilometre cells, equal coordinate text, or grid cells where there is no coordinate.
    """
    old, new = cut(old), cut(new)
    a, b = prefixed(old, "a_", ["layout_id"]), prefixed(new, "b_", ["layout_id"])
    text = {"a_": C("a_cls").isin(R.TEXT_CLASSES), "b_": C("b_cls").isin(R.TEXT_CLASSES)}

    def keyed(d: DataFrame, p: str, when: Column, **key: Column) -> DataFrame:
        d = d.filter(when).withColumn("_cls", C(p + "cls"))
        return d.withColumns(key) if key else d

    def name(p):
        return T.text_or_empty(C(p + "anchor_text"))

    def pair(when, keys, **fn):
        left = keyed(a, "a_", when("a_"), **{k: f("a_") for k, f in fn.items()})
        right = keyed(b, "b_", when("b_"), **{k: f("b_") for k, f in fn.items()})
        return left, right, ["layout_id", "_cls", *keys]

    def symbols(p):
        return ~text[p]

    def no_text(p):
        return ~T.filled(C(p + "coord_text"))

    found = []
    l, r, k = pair(lambda p: text[p] & (name(p) != ""), ["_n"], _n=name)
    found.append(l.join(r, k).withColumn("ratio", F.lit(1.0)))
    sim = similar_names(old, new)
    l = keyed(a, "a_", C("a_cls") == "signal", a_name=name("a_"))
    r = keyed(b, "b_", C("b_cls") == "signal", b_name=name("b_"))
    found.append(l.join(sim, ["layout_id", "a_name"]).join(r.drop("_cls"), ["layout_id", "b_name"]).drop("a_name", "b_name"))

    def stop(p):
        return T.bracket_name(C(p + "anchor_text"))

    l, r, k = pair(lambda p: (C(p + "cls") == "haltepunkt") & T.filled(stop(p)), ["_n"], _n=stop)
    found.append(l.join(r, k).withColumn("ratio", F.lit(1.0)))

    def km(p):
        return F.floor(C(p + "coord_value") / 0.1).cast("long")

    l = keyed(a, "a_", symbols("a_") & C("a_coord_value").isNotNull()).withColumn("_k", F.explode(F.sequence(km("a_") - 1, km("a_") + 1)))
    r = keyed(b, "b_", symbols("b_") & C("b_coord_value").isNotNull(), _k=km("b_"))
    found.append(l.join(r, ["layout_id", "_cls", "_k"]).withColumn("ratio", F.lit(1.0)))
    half = C("a_coord_value").isNull() | C("b_coord_value").isNull()
    l, r, k = pair(lambda p: symbols(p) & ~no_text(p), ["_t"], _t=lambda p: T.text_or_empty(C(p + "coord_text")))
    found.append(l.join(r, k).filter(half).withColumn("ratio", F.lit(1.0)))

    def cell(c):
        return F.floor(c / 350.0).cast("long")

    l = keyed(a, "a_", symbols("a_") & no_text("a_"))
    l = l.withColumn("_x", F.explode(F.sequence(cell(C("a_cx")) - 1, cell(C("a_cx")) + 1))).withColumn("_y", F.explode(F.sequence(cell(C("a_cy")) - 1, cell(C("a_cy")) + 1)))
    r = keyed(b, "b_", symbols("b_") & no_text("b_"), _x=cell(C("b_cx")), _y=cell(C("b_cy")))
    found.append(l.join(r, ["layout_id", "_cls", "_x", "_y"]).filter(half).withColumn("ratio", F.lit(1.0)))

    pairs = None
    for f in found:
        s = f.filter(F.abs(C("a_page") - C("b_page")) <= 1).select("layout_id", C("a_detection_id"), C("b_detection_id"), "ratio")
        pairs = s if pairs is None else pairs.unionByName(s)
    pairs = pairs.groupBy("layout_id", "a_detection_id", "b_detection_id").agg(F.max("ratio").alias("ratio"))
    j = pairs.join(a, ["layout_id", "a_detection_id"]).join(b, ["layout_id", "b_detection_id"])
    j = j.withColumn("score", S.match_score(C("ratio"))).filter(C("score") > 0)
    return j.select("layout_id", C("a_detection_id").alias("old_id"), C("b_detection_id").alias("new_id"), "score")


def _best_assignment(gain: np.ndarray) -> list[tuple[int, int]]:
    """Assignment with the largest total gain (rows <= columns), by shortest augmenting paths."""
    n, m = gain.shape
    cost = gain.max() - gain
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    owner = np.zeros(m + 1, dtype=int)
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        low, used, way = np.full(m + 1, np.inf), np.zeros(m + 1, dtype=bool), np.zeros(m + 1, dtype=int)
        while True:
            used[j0] = True
            i0 = owner[j0]
            free = ~used[1:]
            step = cost[i0 - 1] - u[i0] - v[1:]
            better = free & (step < low[1:])
            low[1:][better] = step[better]
            way[1:][better] = j0
            j1 = int(np.argmin(np.where(free, low[1:], np.inf))) + 1
            delta = low[j1]
            u[owner[used]] += delta
            v[used] -= delta
            low[1:][free] -= delta
            j0 = j1
            if owner[j0] == 0:
                break
        while j0:
            j1 = way[j0]
            owner[j0] = owner[j1]
            j0 = j1
    return [(int(owner[j]) - 1, j - 1) for j in range(1, m + 1) if owner[j]]


def _solve(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["old_id", "new_id"])
    olds, i = np.unique(pdf["old_id"].to_numpy(), return_inverse=True)
    news, j = np.unique(pdf["new_id"].to_numpy(), return_inverse=True)
    gain = np.zeros((len(olds), len(news)))
    gain[i, j] = np.rint(pdf["score"].to_numpy() * GRID)
    flip = gain.shape[0] > gain.shape[1]
    pairs = _best_assignment(gain.T if flip else gain)
    pairs = [(b, a) for a, b in pairs] if flip else pairs
    score = dict(zip(zip(i.tolist(), j.tolist()), pdf["score"].tolist(), strict=True))
    rows = [(pdf["layout_id"].iloc[0], olds[a], news[b], score[a, b]) for a, b in pairs if gain[a, b] > 0]
    return pd.DataFrame(rows, columns=["layout_id", "old_id", "new_id", "score"])


PAIR_SCHEMA = "layout_id LONG, old_id STRING, new_id STRING, score DOUBLE"


def auction(edges: DataFrame, steps_per_unit: int = GRID) -> DataFrame:
    """The assignment with the largest total of scores in steps of 1 / ``steps_per_unit``, by rounds of bids over all tasks.

    To stay alone is an object of each old row, worth nothing, and every new row has a bidder of its own that takes it,
    or the alone object of a candidate, for nothing. So all bidders can be served, the total is that of the pairs,
    and prices may start anywhere. Each phase serves all bidders anew at the prices of the phase before: a bid raises
    a price by the lead over the second choice plus epsilon, the highest bid owns the object. An assignment at epsilon
    is within bidders times epsilon of the best; in the last phase that is less than a step, hence it is the best.
    """
    edges = cut(edges.select("layout_id", "old_id", "new_id", "score").withColumn("value", F.round(C("score") * steps_per_unit).cast("long")).filter("value > 0"))
    size = edges.agg(F.count_distinct("layout_id", "old_id").alias("a"), F.count_distinct("layout_id", "new_id").alias("b"), F.max("value").alias("m")).first()
    if not size.m:
        return edges.drop("value")
    unit = size.a + size.b + 1
    old, alone = F.concat(F.lit("o:"), "old_id"), F.concat(F.lit("o:"), "old_id")
    new, keeper = F.concat(F.lit("n:"), "new_id"), F.concat(F.lit("n:"), "new_id")
    none = F.lit(0).cast("long")

    def arcs(who: Column, what: Column, value: Column) -> DataFrame:
        return edges.select("layout_id", who.alias("bidder"), what.alias("object"), value.alias("value"))

    all_ = arcs(old, new, C("value") * unit).union(arcs(old, alone, none)).union(arcs(keeper, new, none)).union(arcs(keeper, alone, none))
    all_ = cut(all_.distinct())
    bidder, thing = ["layout_id", "bidder"], ["layout_id", "object"]
    prices = cut(all_.select(*thing).distinct().withColumn("price", none))
    eps = size.m * unit
    while eps > 1:
        eps = max(1, eps // 32)
        owned = all_.select(*bidder, "object").limit(0)
        while True:
            idle = all_.join(owned.select(*bidder), bidder, "left_anti")
            offers = idle.join(prices, thing).withColumn("net", C("value") - C("price"))
            two = offers.groupBy(*bidder).agg(F.max(F.struct("net", "object", "price")).alias("b"), F.count(F.lit(1)).alias("k"))
            rest = offers.join(two.select(*bidder, C("b.object").alias("_best")), bidder).filter(C("object") != C("_best"))
            second = rest.groupBy(*bidder).agg(F.max("net").alias("next"))
            bids = two.join(second, bidder).select(*bidder, C("b.object").alias("object"), (C("b.price") + C("b.net") - C("next") + eps).alias("bid"))
            won = cut(bids.groupBy(*thing).agg(F.max(F.struct("bid", "bidder")).alias("m")))
            if won.isEmpty():
                break
            prices = cut(prices.join(won, thing, "left").select(*thing, F.coalesce("m.bid", "price").alias("price")))
            kept = owned.join(won.select(*thing), thing, "left_anti")
            owned = cut(kept.select(*bidder, "object").union(won.select("layout_id", C("m.bidder").alias("bidder"), "object")))
    pairs = owned.select("layout_id", F.expr("substr(bidder, 3)").alias("old_id"), F.expr("substr(object, 3)").alias("new_id"), F.left("bidder", F.lit(2)).alias("_a"), F.left("object", F.lit(2)).alias("_b"))
    pairs = pairs.filter("_a = 'o:' AND _b = 'n:'").select("layout_id", "old_id", "new_id")
    return edges.join(pairs, ["layout_id", "old_id", "new_id"]).select("layout_id", "old_id", "new_id", "score")


def _tasks(df: DataFrame, cells: int) -> int:
    """Tasks for so many cells: at least one for every core."""
    return max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(cells / TASK_CELLS))


def assign(edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """One-to-one pairs with the largest total score.

    Rows that share no candidate do not influence each other, so each connected group is solved on
    its own: small ones in one task, larger ones by the distributed auction. Both give the best total in steps of
    1 / ``GRID``; where several assignments have it, either may take any of them.
    """
    edges = cut(edges)
    old, new = F.struct("layout_id", F.lit(0).alias("s"), C("old_id").alias("id")), F.struct("layout_id", F.lit(1).alias("s"), C("new_id").alias("id"))
    ends = edges.select(old.alias("src"), new.alias("dst"))
    nodes = ends.select(C("src").alias("node")).union(ends.select("dst")).distinct()
    comp = iterative.components(nodes, ends)
    e = edges.withColumn("node", old).join(comp, "node").drop("node")
    size = e.groupBy("component").agg(F.count(F.lit(1)).alias("k"), F.count_distinct("old_id").alias("o"), F.count_distinct("new_id").alias("w"))
    e = cut(e.join(size, "component"))
    single = e.filter(C("k") == 1).select("layout_id", "old_id", "new_id", "score")
    small = (C("k") > 1) & (C("o") * C("w") <= task_edges)
    # few bytes are much work here, so the number of tasks follows the work; an explicit one is not coalesced
    work = e.filter(small).groupBy("component").agg((F.first("o") * F.first("w")).alias("cells")).agg(F.sum("cells")).first()[0] or 0
    parted = e.filter(small).select("component", "layout_id", "old_id", "new_id", "score").repartition(_tasks(edges, work), "component")
    solved = parted.groupBy("component").applyInPandas(lambda pdf: _solve(pdf.drop(columns="component")), PAIR_SCHEMA)
    out = single.unionByName(solved)
    big = e.filter((C("k") > 1) & ~small).select("layout_id", "old_id", "new_id", "score")
    return out if big.isEmpty() else out.unionByName(auction(big))


def match_optimal(old: DataFrame, new: DataFrame, limit: float = R.MATCH_MIN) -> DataFrame:
    """Pairs of the best one-to-one assignment whose score is above ``limit``."""
    return assign(match_candidates(old, new)).filter(C("score") > limit)


# --- changes -----------------------------------------------------------------------------------
def pairs_of(old: DataFrame, new: DataFrame, matches: DataFrame) -> DataFrame:
    a = prefixed(old, "a_", ["layout_id"]).withColumn("old_id", C("a_detection_id"))
    b = prefixed(new, "b_", ["layout_id"]).withColumn("new_id", C("b_detection_id"))
    return matches.join(a, ["layout_id", "old_id"]).join(b, ["layout_id", "new_id"])


def change_columns(pairs: DataFrame) -> DataFrame:
    """Field changes of matched rows: identifier, kilometre value with signed metres, direction; and pixels moved."""
    cls = C("a_cls")
    by_name = cls.isin(R.TEXT_CLASSES)

    def same(n: str) -> Column:
        return T.text_or_empty(C("a_" + n)) == T.text_or_empty(C("b_" + n))

    close = F.coalesce(F.abs(C("a_coord_value") - C("b_coord_value")) < R.RENUMBER_KM, F.lit(False))
    renamed = by_name & ~same("anchor_text")
    renumbered = ~by_name & ~same("coord_text") & ~close
    moved = ~T.same_km(C("a_coord_value"), C("b_coord_value"))
    turned = cls.isin(R.TRACK_DIRECTION) & ~same("fahrtrichtung")
    dx, dy = C("b_cx") - C("a_cx"), C("b_cy") - C("a_cy")
    dist = F.sqrt(dx * dx + dy * dy)
    delta = (C("b_coord_value") - C("a_coord_value")) * 1000

    def change(when: Column, field: str, metres: Column | None = None) -> Column:
        return F.when(when, F.struct(F.lit(field).alias("field"), C("a_" + field).cast("string").alias("old"), C("b_" + field).cast("string").alias("new"),
                                     (metres if metres is not None else F.lit(None)).cast("double").alias("delta_meters")))

    return pairs.withColumns({
        "renamed": renamed, "renumbered": renumbered, "moved": moved, "turned": turned,
        "delta_meters": F.when(moved, delta), "moved_px": F.when(dist >= 10, dist), "direction": F.when(dist >= 10, G.compass(dx, dy)),
        "field_changes": F.array_compact(F.array(
            change(renamed, "anchor_text"), change(renumbered, "coord_text"), change(moved, "coord_value", delta), change(turned, "fahrtrichtung"))),
    })


def classify(old: DataFrame, new: DataFrame, matches: DataFrame, emit_modified: bool = False) -> DataFrame:
    """All elements of both versions as added, deleted, moved or unchanged.

    ``emit_modified`` tells rows whose other fields changed apart from unchanged ones.
    """
    p = change_columns(pairs_of(old, new, matches))
    other = C("renamed") | C("renumbered") | C("turned")
    kind = F.when(C("moved"), "moved")
    kind = kind.when(other, "modified") if emit_modified else kind
    severity = F.when(C("moved"), S.change_severity(C("delta_meters"), F.lit(False), F.lit(False), F.lit(None).cast("double"))).when(
        other & F.lit(emit_modified), S.change_severity(F.lit(None).cast("double"), C("renamed"), C("turned"), F.lit(None).cast("double"))).otherwise("minor")
    cols = ["detection_id", *FIELDS]

    def side(pfx: str) -> Column:
        return F.struct(*[C(pfx + c).alias(c) for c in cols])

    empty = F.lit(None).cast(p.select(side("a_").alias("s")).schema["s"].dataType)
    none = F.lit(None).cast(p.schema["field_changes"].dataType)
    both = p.select("layout_id", kind.alias("_k"), severity.alias("severity"), C("b_cls").alias("element_class"), C("b_page").alias("page"),
                    side("a_").alias("old"), side("b_").alias("new"), "field_changes", "delta_meters")
    both = both.withColumn("change_type", F.coalesce("_k", F.lit("unchanged"))).drop("_k")

    def lone(d: DataFrame, name: str) -> DataFrame:
        s = F.struct(*[C(c) for c in cols])
        return d.select("layout_id", F.lit("major").alias("severity"), C("cls").alias("element_class"), "page",
                        (s if name == "deleted" else empty).alias("old"), (s if name == "added" else empty).alias("new"),
                        none.alias("field_changes"), F.lit(None).cast("double").alias("delta_meters"), F.lit(name).alias("change_type"))

    return both.unionByName(lone(unmatched(old, matches, "old_id"), "deleted")).unionByName(lone(unmatched(new, matches, "new_id"), "added"))


def compare(old: DataFrame, new: DataFrame, by_score: bool = True, emit_modified: bool = False) -> DataFrame:
    """Change table of two versions: ids first, the costly match only on what is left."""
    a, b = cut(elements(old)), cut(elements(new))
    m = match_ids(a, b)
    if by_score:
        rest = match_optimal(unmatched(a, m, "old_id"), unmatched(b, m, "new_id")).drop("score")
        m = cut(m.unionByName(rest))
    return classify(a, b, m, emit_modified)


def change_summary(changes: DataFrame) -> DataFrame:
    """Counts per plan: totals, by class and by page, from one grouping-sets pass."""
    t = C("change_type")
    g = changes.groupingSets([["layout_id"], ["layout_id", "element_class"], ["layout_id", "page"]], "layout_id", "element_class", "page").agg(
        F.grouping_id().alias("gid"), *[F.count_if(t == n).alias(n) for n in ("added", "deleted", "moved", "unchanged")],
        *[F.count_if((t == "moved") & (C("severity") == s)).alias("moved_" + s) for s in ("major", "moderate", "minor")])
    level = F.when(C("gid") == 3, "total").when(C("gid") == 1, "class").otherwise("page")
    g = g.filter((C("gid") == 3) | (C("added") + C("deleted") + C("moved") > 0))
    return g.select("layout_id", level.alias("level"), F.when(C("gid") == 1, C("element_class")).when(C("gid") == 2, C("page").cast("string")).alias("key"),
                    "added", "deleted", "moved", "unchanged", "moved_major", "moved_moderate", "moved_minor")


def comparison_tables(changes: DataFrame) -> dict[str, DataFrame]:
    """Result tables for people: added, deleted, moved, modified (one row per field), summary."""
    def text(s: str, f: str) -> Column:
        return F.coalesce(C(f"{s}.{f}"), F.lit(""))

    def ident(s: str) -> Column:
        return F.when(text(s, "anchor_text") != "", text(s, "anchor_text")).otherwise(text(s, "coord_text"))

    def table(kind: str, s: str, label: str, old: Column, new: Column) -> DataFrame:
        return changes.filter(C("change_type") == kind).select(
            "layout_id", C("element_class"), ident(s).alias("identifier"), F.lit(label).alias("change"), old.alias("old_value"), new.alias("new_value"),
            text(s, "coord_text").alias("coordinate"), T.km_text(C(f"{s}.coord_value")).alias("km"), "page")

    empty = F.lit("")
    delta = F.round("delta_meters", 4)
    mod = changes.filter(C("change_type").isin("modified")).withColumn("f", F.explode("field_changes"))
    mod = mod.select("layout_id", "element_class", ident("new").alias("identifier"), F.concat(C("f.field"), F.lit(" changed")).alias("change"),
                     F.coalesce("f.old", empty).alias("old_value"), F.coalesce("f.new", empty).alias("new_value"),
                     text("new", "coord_text").alias("coordinate"), T.km_text(C("new.coord_value")).alias("km"), "page")
    return {
        "added": table("added", "new", "added", empty, text("new", "anchor_text")),
        "deleted": table("deleted", "old", "deleted", text("old", "anchor_text"), empty),
        "moved": table("moved", "new", "moved", T.km_text(C("old.coord_value")), F.concat(T.km_text(C("new.coord_value")), T.metres_text(delta))),
        "modified": mod,
        "summary": changes.groupBy("layout_id", "change_type", "severity").agg(F.count(F.lit(1)).alias("n")),
    }
