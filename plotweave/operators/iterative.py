"""Operators that need rounds: greedy suppression, exclusive claims, connected components.

Each round writes its state to the shared checkpoint folder, so a lost executor costs one round.
"""

from __future__ import annotations

import random
from collections.abc import Callable
from functools import reduce
from itertools import groupby
from math import ceil

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotweave.functions import geometry as G
from plotweave.operators.spatial import prefixed, span_cells
from plotweave.session import cut, discard

HEADS = 64
#: A group of up to so many times ``heads`` rows is suppressed by one task.
CROWD = 16
#: Rows of such groups that one task is given, about.
LOAD = 1 << 17
REACH = ("_rx1", "_ry1", "_rx2", "_ry2")
#: The columns of one of two compared rows, by name.
Side = Callable[[str], Column]
#: Targets that an anchor looks through in one round; with it, targets of a tile and anchors that take turns there, which
#: must be more than twice the targets.
TURNS = 64
TILE, LOT = 16, 64


def greedy_keep(df: DataFrame, group: list[str], reach: G.Box, conflict: Callable[[Side, Side], Column],
                same: list[str], heads: int = HEADS, size: float = 256.0) -> DataFrame:
    """Rows a sequential pass (confidence down, then ``row_id`` up) would keep.

    ``conflict`` is written over the columns of a better and a worse row; conflicting rows must
    have touching ``reach`` boxes. ``same`` are the columns that make two rows interchangeable:
    only the best of such copies can ever be kept.

    A group of up to ``CROWD * heads`` rows is moved once, and its task goes through the pass. Larger groups take rounds,
    after each of which those that have few open rows left are finished so. Open rows and shuffle files of a round go
    with the next one.
    """
    # what lacks a group or a place is not kept and keeps nothing out
    known = [*[F.col(c) for c in group], *reach]
    rest = df.filter(reduce(Column.__and__, [c.isNotNull() for c in known]))
    kept, numbered = [], False
    while True:
        sizes, crowded = cut(rest.groupBy(*group).count(), True), F.col("count") > CROWD * heads
        crowds, rows = cut(sizes.filter(crowded).select(*group)), sizes.filter(~crowded).agg(F.sum("count")).first()[0] or 0
        discard(sizes)
        if rows or not kept:
            parts = max(df.sparkSession.sparkContext.defaultParallelism, ceil(rows / LOAD))
            kept.append(cut(_in_turn(rest.join(crowds, group, "left_anti"), parts, group, reach, conflict, same), True))
        if crowds.isEmpty():
            break
        if not numbered:
            # copies go, and a number stands for the row between rounds
            rest = cut(_best(rest.join(crowds, group, "left_semi"), group, same).withColumn("_id", F.monotonically_increasing_id()), True)
            numbered = True
            continue
        open_ = rest
        if rows:
            open_ = cut(rest.join(crowds, group, "left_semi"), True)
            discard(rest)
        winners, rest = _round(open_, group, reach, conflict, heads, size)
        discard(open_)
        kept.append(winners.select(*group, "row_id"))
    if numbered:
        discard(rest)
    return df.join(reduce(DataFrame.union, kept).hint("merge"), [*group, "row_id"], "left_semi")


def _best(rows: DataFrame, group: list[str], same: list[str]) -> DataFrame:
    """The best of each row's copies: ``group``, ``same``, ``row_id``, ``conf``."""
    first = F.struct((-F.col("conf")).alias("_c"), "row_id")
    best = rows.groupBy(*group, *same).agg(F.min(first).alias("_m"))
    return best.select(*group, *same, F.col("_m.row_id").alias("row_id"), (-F.col("_m._c")).alias("conf"))


def _better(a: Side, b: Side) -> Column:
    return (a("conf") > b("conf")) | ((a("conf") == b("conf")) & (a("row_id") < b("row_id")))


def _in_turn(rows: DataFrame, parts: int, group: list[str], reach: G.Box, conflict: Callable[[Side, Side], Column], same: list[str]) -> DataFrame:
    """``group`` and ``row_id`` of what is kept when each group is one array, taken from its best row on."""
    # moved by group first, so that copies are merged and groups gathered where they are
    nodes = _best(rows.repartition(parts, *group), group, same).withColumns(dict(zip(REACH, reach)))
    place = [(~F.isnan("conf")).alias("_n"), (-F.col("conf")).alias("_c"), "row_id"]
    lots = nodes.groupBy(*group).agg(F.sort_array(F.collect_list(F.struct(*place, *same, "conf", *REACH))).alias("_rows"))

    def step(held: Column, row: Column) -> Column:
        def beats(other: Column) -> Column:
            a, b = other.getField, row.getField
            touch = (a("_rx1") <= b("_rx2")) & (b("_rx1") <= a("_rx2")) & (a("_ry1") <= b("_ry2")) & (b("_ry1") <= a("_ry2"))
            return F.coalesce(touch & _better(a, b) & conflict(a, b), F.lit(False))

        return F.when(F.exists(held, beats), held).otherwise(F.concat(held, F.array(row)))

    held = F.aggregate("_rows", F.slice("_rows", 1, 0), step)
    return lots.select(*group, F.explode(held.getField("row_id")).alias("row_id"))


def _round(open_: DataFrame, group: list[str], reach: G.Box, conflict: Callable[[Side, Side], Column], heads: int,
           size: float) -> tuple[DataFrame, DataFrame]:
    """Rows that are kept, and rows that are still open.

    A round looks at the ``heads`` best open rows of every grid cell. A row that is among them in
    all its cells and has no better open conflict is kept, and everything it beats is dropped. What
    lies behind the heads waits for a later round, so pairs per cell stay below ``heads`` squared.
    """
    cell = [*group, "_gx", "_gy"]
    spread = (F.floor(F.col("_rx2") / size) - F.floor(F.col("_rx1") / size) + 1) * (
        F.floor(F.col("_ry2") / size) - F.floor(F.col("_ry1") / size) + 1
    )

    def wide(rows: DataFrame) -> DataFrame:
        placed = rows.withColumns(dict(zip(REACH, reach))).withColumn("_cells", spread)
        return span_cells(placed, tuple(F.col(c) for c in REACH), size).drop(*REACH)

    def a(c: str) -> Column:
        return F.col("a_" + c)

    def b(c: str) -> Column:
        return F.col("b_" + c)

    beaten = _better(a, b) & conflict(a, b)
    in_cell = Window.partitionBy(*cell).orderBy(F.desc("conf"), "row_id")
    top = wide(open_).withColumn("_rn", F.row_number().over(in_cell)).filter(F.col("_rn") <= heads).drop("_rn")
    blocked = prefixed(top, "a_", cell).join(prefixed(top, "b_", cell), cell).filter(beaten).select(F.col("b__id").alias("_id")).distinct()
    whole = top.groupBy("_id", "_cells").count().filter(F.col("count") == F.col("_cells")).select("_id")
    winners = cut(open_.join(whole.join(blocked, "_id", "left_anti"), "_id", "left_semi"), True)
    lost = prefixed(wide(open_), "b_", cell).join(prefixed(wide(winners), "a_", cell), cell).filter(beaten)
    gone = winners.select("_id").union(lost.select(F.col("b__id").alias("_id"))).distinct()
    return winners, cut(open_.join(gone, "_id", "left_anti"), True)


def claims(candidates: DataFrame, target: list[str], anchor: list[str], rank: list[str], order: list[str], batch: int = TURNS,
           cells: DataFrame | None = None) -> DataFrame:
    """One-to-one picks as if anchors chose their best free target one after the other.

    ``order`` columns give the anchors' turn, ``rank`` columns an anchor's liking (smaller first).
    Targets lie in tiles of bounded size (``_tiles``); the anchors that ask for targets of a tile take turns there, each
    from the target it asks for through the next ones of its list, until the list leaves the tile or ``batch`` were looked at.
    Whoever is passed over is passed over for an earlier anchor that really asked, so a refusal never has to be taken back,
    whatever anchors ask later, and any split of the anchors gives the same picks. A tile with more anchors than take turns
    together is split by chance anew each round, which leaves at most one per target and part. Later rounds look at tiles
    that anchors moved to, only. Lists are ranked and written once; a round writes who asks for what.
    """
    own = [t for t in target if t not in anchor]
    shared = [t for t in target if t in anchor]
    who = [*anchor, *[o for o in order if o not in anchor]]
    turn = [*order, *[a for a in anchor if a not in order]]
    rows = cut(candidates.select(*dict.fromkeys([*who, *own, *rank])))
    liking = Window.partitionBy(*who).orderBy(*rank, *own)
    lists = rows.withColumns({"_who": F.struct(*who), "_r": F.row_number().over(liking), "_more": F.lead(F.lit(True), 1, False).over(liking)}).drop(*rank)
    lists = cut(lists.join(_tiles(rows, shared, own, cells, TILE * batch), target, "left"))
    asked = lists.filter(F.col("_r") == 1).withColumns({"_open": F.col("_tile").isNotNull(), "_left": F.lit(False)})
    kind, rounds = asked.schema, 0
    while True:
        parts = F.ceil(F.count(F.lit(1)) / (LOT * batch))
        busy = asked.groupBy("_tile").agg(F.max("_open").alias("_any"), parts.alias("_parts")).filter("_any and _tile is not null").drop("_any")
        here = asked.join(busy, "_tile").withColumn("_part", F.pmod(F.xxhash64(*who, F.lit(rounds)), F.col("_parts")))
        here = here.withColumn("_turn", F.row_number().over(Window.partitionBy("_tile", "_part").orderBy(*turn)))
        here = here.select("_who", "_tile", "_part", "_parts", "_turn", F.col("_r").alias("_at"))
        wishes = lists.join(here, ["_who", "_tile"]).filter((F.col("_r") >= F.col("_at")) & (F.col("_r") < F.col("_at") + batch)).drop("_at")
        wishes = wishes.withColumn("_open", F.col("_parts") > 1).drop("_parts")
        got = wishes.groupBy("_tile", "_part").applyInArrow(_take_turns(target, kind.names), kind)
        # who found all it looked at taken goes on behind it, if its list does
        asked = cut(asked.join(busy, "_tile", "left_anti").unionByName(got.filter("not _left or _more")))
        if asked.filter("_open or _left").isEmpty():
            return asked.select(*who, *own)
        moved = asked.filter("_left").select("_who", (F.col("_r") + 1).alias("_r"))
        moved = lists.join(moved, ["_who", "_r"]).withColumns({"_open": F.col("_tile").isNotNull(), "_left": F.lit(False)})
        asked = asked.filter("not _left").unionByName(moved)
        rounds += 1


def _tiles(rows: DataFrame, shared: list[str], own: list[str], cells: DataFrame | None, size: int) -> DataFrame:
    """``_tile`` of every target without nulls: neighbouring cells (``_gx, _gy`` of ``cells``) up to some ``size`` targets, a fuller
    cell in parts. Tiles of one hash are worked on together, which changes no pick."""
    spots = rows.select(*shared, *own).distinct().dropna()
    if cells is not None:
        spots = spots.join(cells.groupBy(*shared, *own).agg(F.min(F.struct("_gx", "_gy")).alias("_c")), [*shared, *own], "left")
    cell = F.struct(F.col("_c") if cells is not None else F.lit(0).alias("_c"))
    spots = spots.withColumn("_cell", cell).select(*shared, *own, "_cell")
    before = Window.partitionBy(*shared).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    counts = spots.groupBy(*shared, "_cell").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    part = F.pmod(F.xxhash64(*own), F.ceil(F.col("_n") / size))
    tile = F.xxhash64(*shared, F.floor(F.col("_before") / size), part)
    return spots.join(counts, [*shared, "_cell"]).select(*shared, *own, tile.alias("_tile"))


def _take_turns(target: list[str], columns: list[str]) -> Callable[[pa.Table], pa.Table]:
    """Of the wishes of one tile, the one each anchor gets in its turn, or the last one it looked at (``_left``)."""
    def turns(wishes: pa.Table) -> pa.Table:
        wishes = wishes.sort_by([("_turn", "ascending"), ("_r", "ascending")])
        taken, at, left = set(), [], []
        for _, mine in groupby(enumerate(zip(*(wishes[c].to_pylist() for c in ["_turn", "_r", *target]))), lambda x: x[1][0]):
            at.append(-1)
            left.append(True)
            following = None
            for i, (_, r, *place) in mine:
                if following not in (None, r):  # the list goes on in another tile
                    break
                at[-1], following = i, r + 1
                if tuple(place) not in taken:
                    taken.add(tuple(place))
                    left[-1] = False
                    break
        return wishes.take(at).append_column("_left", pa.array(left, pa.bool_())).select(columns)

    return turns


def components(nodes: DataFrame, edges: DataFrame, node: str = "node") -> DataFrame:
    """Smallest reachable node id per node (``component``). ``edges`` has ``src`` and ``dst``, any direction.

    Nodes are numbered once. In a round every open number moves to the least of itself and its neighbours, in an order
    that is mixed anew (so that no chain is sorted for long), and edges move with their ends; those that meet themselves
    are done. A round leaves about half of the numbers, so all rounds together move some two times the first. The moves
    are then followed from the last round back.
    """
    ids = cut(nodes.select(F.col(node).alias("node")).distinct().withColumn("_id", F.monotonically_increasing_id()))
    ends = edges.select("src", "dst").join(ids.toDF("src", "_u"), "src").join(ids.toDF("dst", "_v"), "dst")
    open_ = cut(_apart(ends))
    moves = []
    while not open_.isEmpty():
        both = open_.union(open_.select("_v", "_u")).toDF("_id", "_by")
        mix = F.lit(random.Random(len(moves)).getrandbits(62))
        least = F.least(F.min(F.col("_by").bitwiseXOR(mix)), F.col("_id").bitwiseXOR(mix)).bitwiseXOR(mix)
        step = both.groupBy("_id").agg(least.alias("_to"))
        moves.append(cut(step))
        u, v = moves[-1].toDF("_u", "_a"), moves[-1].toDF("_v", "_b")
        open_ = cut(_apart(open_.join(u, "_u").join(v, "_v").select(F.col("_a").alias("_u"), F.col("_b").alias("_v"))))
    if not moves:
        return ids.select(F.col("node").alias(node), F.col("node").alias("component"))
    root = moves.pop()
    while moves:
        on = root.toDF("_to", "_root")
        root = cut(moves.pop().join(on, "_to", "left").select("_id", F.coalesce("_root", "_to").alias("_to")))
    linked = ids.join(root, "_id")
    least = linked.groupBy("_to").agg(F.min("node").alias("component"))
    named = linked.join(least, "_to").select("_id", "component")
    return cut(ids.join(named, "_id", "left").select(F.col("node").alias(node), F.coalesce("component", "node").alias("component")))


def _apart(edges: DataFrame) -> DataFrame:
    """Distinct edges between different numbers, smaller end first."""
    return edges.filter("_u <> _v").select(F.least("_u", "_v").alias("_u"), F.greatest("_u", "_v").alias("_v")).distinct()
