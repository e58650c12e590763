"""Neighbour searches: no copies on the driver, and the same rows as by comparing all with all."""

import random

import pytest
from pyspark.sql import functions as F

from plotweave.functions import geometry as G
from plotweave.operators import spatial, spatial_checks

POINTS = "layout_id LONG, page INT, row_id LONG, cls STRING, x DOUBLE, y DOUBLE"
C = F.col
ON = ["layout_id", "page", "cls"]


def _points(seed, n, wide):
    rnd = random.Random(seed)
    rows = [(1, 1, i, rnd.choice("ab"), float(rnd.randint(-wide, wide)), float(rnd.randint(-wide, wide))) for i in range(n)]
    return rows + [(1, 1, 900, "a", None, 3.0), (1, 1, 901, "a", None, 3.0), (1, 1, None, "a", 0.0, 0.0), (1, 1, 3, "b", 7.5, 7.5)]


def _near(a, b, radius, strict=False):
    if None in (a[4], b[4]) or a[3] != b[3]:
        return False
    d = ((a[4] - b[4]) ** 2 + (a[5] - b[5]) ** 2) ** 0.5
    return d < radius if strict else d <= radius


def test_cell_joins_are_not_broadcast(spark):
    d = spark.createDataFrame(_points(1, 20, 50), POINTS)
    box = d.select("layout_id", "page", "row_id", C("x") - 4, C("y") - 4, C("x") + 4, C("y") + 4).toDF("layout_id", "page", "row_id", *spatial.BOX)
    for p in (spatial.near_pairs(d, d, 10.0), spatial.overlapping(box, box), spatial.reach_pairs(box, box, G.box(), G.box())):
        plan = p._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "BroadcastExchange" not in plan


def test_near_pairs_equal_all_pairs(spark):
    rows = _points(2, 120, 60)
    d = spark.createDataFrame(rows, POINTS)
    got = sorted((r.a_row_id, r.b_row_id) for r in spatial.near_pairs(d, d, 10.0, ON, C("a_row_id") < C("b_row_id")).collect())
    assert got == sorted((a[2], b[2]) for a in rows for b in rows if None not in (a[2], b[2]) and a[2] < b[2] and _near(a, b, 10.0))


@pytest.mark.parametrize(("wide", "strict"), [(20, False), (100, False), (100, True), (400, True)])
def test_neighbours_equal_all_pairs(spark, wide, strict):
    rows = _points(wide, 150, wide)
    df = spark.createDataFrame(rows, POINTS)
    got = {r.row_id for r in spatial_checks.has_neighbour(df, 10.0, ON, strict).collect()}
    spots = {}
    for r in rows:
        if r[4] is not None:
            spots.setdefault(r[3:], []).append(r)
    want = set()
    for r in rows:
        other = [q for q in rows if q[2] is not None and r[2] is not None and q[2] != r[2] and _near(r, q, 10.0, strict)]
        if r[4] is not None and (other or len(spots[r[3:]]) > 1):
            want.add(r[2])
    assert got == want


def test_only_lone_places_are_searched(spark, monkeypatch):
    """Places that share a small cell need no search: of 400 crowded ones none is copied to the cells around."""
    seen = []
    search = spatial.near_pairs
    monkeypatch.setattr(spatial_checks, "near_pairs", lambda a, *r: seen.append(a.count()) or search(a, *r))
    rows = [(1, 1, i, "a", float(i % 20), float(i // 20)) for i in range(400)] + [(1, 1, 400, "a", 5000.0, 5000.0)]
    df = spark.createDataFrame(rows, POINTS)
    assert spatial_checks.has_neighbour(df, 600.0, ON, False).count() == 400
    assert seen == [1]
