"""Round-based operators against short sequential versions on random inputs."""

import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from plotweave.functions import geometry as G
from plotweave.operators import compare, direction, iterative, ordered, tracks

BOXES = "layout_id LONG, page INT, row_id LONG, cls STRING, conf DOUBLE, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE, cx DOUBLE, cy DOUBLE, angle DOUBLE"


def _iou(a, b):
    w, h = min(a[7], b[7]) - max(a[5], b[5]), min(a[8], b[8]) - max(a[6], b[6])
    inter = max(0.0, w) * max(0.0, h)
    union = (a[7] - a[5]) * (a[8] - a[6]) + (b[7] - b[5]) * (b[8] - b[6]) - inter
    return inter / union


def _rows(seed, n=120, copies=30):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        cx, cy, w, h = rnd.randint(0, 600), rnd.randint(0, 300), rnd.randint(20, 90), rnd.randint(20, 90)
        out.append((1, 1, i, "signal", round(rnd.random(), 2), cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2, float(cx), float(cy), 0.0))
    for i in range(copies):
        out.append((1, 1, n + i, *out[3][3:4], round(rnd.random(), 2), *out[3][5:]))
    return out


def _greedy(rows, conflict):
    kept = []
    for r in sorted(rows, key=lambda r: (-r[4], r[2])):
        if not any(conflict(k, r) for k in kept):
            kept.append(r)
    return {r[2] for r in kept}


def test_nms_equals_sequential_pass_even_with_few_heads(spark):
    rows = _rows(1)
    df = spark.createDataFrame(rows, BOXES)
    want = _greedy(rows, lambda a, b: _iou(a, b) >= 0.32)
    for heads in (64, 3):
        got = {r.row_id for r in tracks.nms(df, heads=heads).collect()}
        assert got == want


def test_center_suppression_equals_sequential_pass(spark):
    rows = _rows(2, 60, 5)

    def conflict(k, r):
        d = ((k[9] - r[9]) ** 2 + (k[10] - r[10]) ** 2) ** 0.5
        inside = (k[5] <= r[9] <= k[7] and k[6] <= r[10] <= k[8]) or (r[5] <= k[9] <= r[7] and r[6] <= k[10] <= r[8])
        return d < 50 or inside or (k[4] - r[4] > 0.1 and d < 120)

    got = {r.row_id for r in tracks.suppress_centers(spark.createDataFrame(rows, BOXES), reach=120.0).collect()}
    assert got == _greedy(rows, conflict)


def _taking_turns(cand):
    taken, want = set(), {}
    for a in sorted({x[1] for x in cand}):
        for _, _, c, _ in sorted((x for x in cand if x[1] == a), key=lambda x: (x[3], x[2])):
            if c not in taken:
                taken.add(c)
                want[a] = c
                break
    return want


CANDIDATES = "layout_id LONG, row_id LONG, coord_id LONG, s LONG"


def _claims(spark, cand, **more):
    df = spark.createDataFrame(cand, CANDIDATES)
    got = iterative.claims(df, ["layout_id", "coord_id"], ["layout_id", "row_id"], ["s"], ["row_id"], **more).collect()
    assert len(got) == len({r.row_id for r in got}) == len({r.coord_id for r in got})
    return {r.row_id: r.coord_id for r in got}


def test_claims_equal_taking_turns(spark):
    rnd = random.Random(3)
    cand = [(1, a, c, rnd.randint(0, 20)) for a in range(40) for c in rnd.sample(range(30), 6)]
    cand += rnd.sample(cand, 20)  # repeated rows
    for batch in (iterative.TURNS, 2):
        assert _claims(spark, cand, batch=batch) == _taking_turns(cand)
    assert _claims(spark, cand[:0]) == {}


def test_anchors_of_one_liking_need_two_rounds(spark, monkeypatch):
    written = []

    def counted(df):
        written.append(1)
        return cut(df)

    cut = iterative.cut
    monkeypatch.setattr(iterative, "cut", counted)
    cand = [(1, a, c, c) for a in range(12) for c in range(20)]
    assert _claims(spark, cand) == {a: a for a in range(12)}
    assert len(written) == 1 + 2  # the lists, then two rounds
    # more anchors than targets, and more than take turns together
    cand = [(1, a, c, c) for a in range(30) for c in range(25)]
    assert _claims(spark, cand, batch=8) == {a: a for a in range(25)}


def _counting(monkeypatch):
    written, cut = [], iterative.cut
    monkeypatch.setattr(iterative, "cut", lambda df: written.append(1) or cut(df))
    return written


def test_a_chain_of_refusals_is_one_round(spark, monkeypatch):
    written = _counting(monkeypatch)
    # the first anchor keeps the second from its first wish, which takes the first wish of the third, and so on
    cand = [(1, 0, 0, 0)] + [(1, a, c, c) for a in range(1, 40) for c in (a - 1, a)]
    assert _claims(spark, cand) == {a: a for a in range(40)}
    assert len(written) == 3  # the rows, their lists, one round


def test_chains_cross_tiles_and_full_tiles_are_split(spark, monkeypatch):
    written = _counting(monkeypatch)
    # tiles of some 32 targets: the chain crosses three borders
    cand = [(1, 0, 0, 0)] + [(1, a, c, c) for a in range(1, 110) for c in (a - 1, a)]
    cells = spark.createDataFrame([(1, c, c // 8, 0) for c in range(110)], "layout_id LONG, coord_id LONG, _gx LONG, _gy LONG")
    assert _claims(spark, cand, batch=2, cells=cells) == {a: a for a in range(110)}
    assert len(written) <= 2 + 5
    # more anchors of one liking than take turns together, and a list that is longer than an anchor looks at once
    cand = [(1, a, c, c) for a in range(200) for c in range(3)]
    assert _claims(spark, cand, batch=2) == {0: 0, 1: 1, 2: 2}


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 40)] + [(100, 101)], "src LONG, dst LONG")
    nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
    got = {r.node: r.component for r in iterative.components(nodes, edges).collect()}
    assert set(got[i] for i in range(41)) == {0} and got[101] == 100


def test_component_rounds_shrink(spark, monkeypatch):
    """A long path in mixed order: all rounds together write a few times the graph, not the graph each round."""
    rnd, rows = random.Random(5), []

    def counted(df):
        out = cut(df)
        rows.append(out.count())
        return out

    cut = iterative.cut
    monkeypatch.setattr(iterative, "cut", counted)
    n = 300
    names = rnd.sample(range(10 * n), n)
    edges = spark.createDataFrame(list(zip(names, names[1:])) + [(names[7], names[7])], "src LONG, dst LONG")
    nodes = spark.createDataFrame([(x,) for x in [*names, -5, -5]], "node LONG")
    got = {r.node: r.component for r in iterative.components(nodes, edges).collect()}
    assert got == {**dict.fromkeys(names, min(names)), -5: -5}
    assert sum(rows) < 10 * n


def _brute(gain):
    best = 0.0
    n, m = gain.shape

    def go(i, used, total):
        nonlocal best
        best = max(best, total)
        if i < n:
            go(i + 1, used, total)
            for j in range(m):
                if j not in used and gain[i, j] > 0:
                    go(i + 1, used | {j}, total + gain[i, j])

    go(0, frozenset(), 0.0)
    return best


def test_assignment_is_optimal_in_task_and_by_auction(spark):
    rnd = random.Random(5)
    edges = [(1, f"o{i}", f"n{j}", rnd.randint(60, 100) / 100) for i in range(6) for j in range(6) if rnd.random() < 0.6]
    gain = np.zeros((6, 6))
    for _, o, n, s in edges:
        gain[int(o[1:]), int(n[1:])] = s
    want = _brute(gain)
    df = spark.createDataFrame(edges, compare.PAIR_SCHEMA)
    exact = compare.assign(df).collect()
    assert abs(sum(r.score for r in exact) - want) < 1e-9
    assert len({r.old_id for r in exact}) == len(exact) == len({r.new_id for r in exact})
    bids = compare.auction(df, steps_per_unit=1000).collect()
    assert sum(r.score for r in bids) >= want - 6 / 1000


def test_rank_and_median_do_not_depend_on_cells(spark):
    rnd = random.Random(7)
    rows = [(1, i, float(rnd.randint(0, 900))) for i in range(301)] + [(2, i, 5.0) for i in range(4)]
    df = spark.createDataFrame(rows, "layout_id LONG, row_id LONG, v DOUBLE")
    med = {r.layout_id: r.median for r in ordered.median(df, ["layout_id"], "v", 16.0).collect()}
    assert med == {1: float(np.median([r[2] for r in rows if r[0] == 1])), 2: 5.0}
    got = ordered.rank_in_group(df, ["layout_id"], ["row_id"], F.floor(F.col("row_id") / 10), "k").collect()
    assert all(r.k == r.row_id + 1 for r in got)
    nxt = {r.value: r.next_value for r in ordered.next_value(df.filter("layout_id = 1"), ["layout_id"], "v", 50.0).collect()}
    vals = sorted({r[2] for r in rows if r[0] == 1})
    assert nxt == dict(zip(vals, vals[1:] + [None]))


def test_merge_clusters_equal_sequential_clustering(spark):
    rnd = random.Random(11)
    pts = [(1, 1, i, "signal", "A1", float(rnd.randint(0, 900)), float(rnd.randint(0, 900))) for i in range(40)]
    pts += [(1, 1, 40 + i, "signal", "A1", pts[0][5], pts[0][6]) for i in range(5)]
    df = spark.createDataFrame(pts, "layout_id LONG, page INT, row_id LONG, cls STRING, anchor_text STRING, cx DOUBLE, cy DOUBLE")
    radius = spark.createDataFrame([(1, 200)], "layout_id LONG, radius INT")
    groups = []
    for p in sorted(pts, key=lambda p: (p[6], p[5], p[2])):
        near = None
        for g in groups:
            d = ((p[5] - sum(q[5] for q in g) / len(g)) ** 2 + (p[6] - sum(q[6] for q in g) / len(g)) ** 2) ** 0.5
            if near is None or d < near[0]:
                near = (d, g)
        if near and near[0] < 200:
            near[1].append(p)
        else:
            groups.append([p])
    want = {frozenset(q[2] for q in g) for g in groups}
    # the smaller ranges hand open centres from round to round
    for most in (direction.SPOTS, 7):
        got = {}
        for r in direction.signal_clusters(df, radius, most).collect():
            got.setdefault((r.stretch, r.cluster), set()).add(r.row_id)
        assert {frozenset(v) for v in got.values()} == want


def test_clusters_of_far_stretches_and_missing_positions(spark):
    rows = [(1, 1, 1, "signal", "A1", 5.0, 5.0), (1, 1, 2, "signal", " A1", 5.0, 150.0), (1, 1, 3, "signal", "A1", 5.0, 900.0), (1, 1, 4, "signal", "A1", None, 900.0),
            (1, None, 5, "signal", "A1", 5.0, 900.0), (1, 2, 6, "signal", "A1", 5.0, 5.0), (1, 2, 7, "signal", "A1", 5.0, 5.0), (1, 1, 8, "signal", "B2", 5.0, 5.0), (2, 1, 9, "signal", "A1", 5.0, 5.0)]
    df = spark.createDataFrame(rows, "layout_id LONG, page INT, row_id LONG, cls STRING, anchor_text STRING, cx DOUBLE, cy DOUBLE")
    radius = spark.createDataFrame([(1, 200), (2, 200)], "layout_id LONG, radius INT")
    got = {r.row_id: (r.page, r.stretch, r.cluster) for r in direction.signal_clusters(df, radius, 1).collect()}
    assert got == {1: (1, 0, 0), 2: (1, 0, 0), 3: (1, 1, 0), 6: (2, 0, 0), 7: (2, 0, 0)}
    assert direction.signal_clusters(df.limit(0), radius).count() == 0


def test_scan_holds_open_centres_only():
    n = 50_000
    y = np.repeat(np.arange(n // 5) * 10.0, 5)
    pdf = pd.DataFrame({"layout_id": 1, "page": 1, "name": "A1", "stretch": 0, "x": np.tile(np.arange(5) * 300.0, n // 5), "y": y, "n": 1, "radius": 100.0,
                        "more": True, "state": False, "cluster": None, "made": 0})
    out = pd.concat(direction._scan(iter([pdf[:n // 2], pdf[n // 2:]])))
    assert (~out["state"]).sum() == n
    assert out["state"].sum() <= 10
    assert out["cluster"].max() > 1000
