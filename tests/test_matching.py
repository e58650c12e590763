"""Searches that must not lose far or unlike partners."""

import difflib
import random

from plotweave import rules as R
from plotweave.operators import compare, linking, spatial_checks


def test_similar_names_of_any_length_equal_all_pairs(spark):
    rnd = random.Random(4)
    base = ["".join(rnd.choices("ABNP0123456789", k=rnd.choice([1, 2, 3, 4, 8, 30, 60]))) for _ in range(60)]

    def changed(t):
        t = list(t)
        for _ in range(rnd.randint(0, max(1, len(t) // 8))):
            i = rnd.randrange(len(t) + 1)
            t[i:i + rnd.randint(0, 1)] = rnd.choice(["", "A", "7"])
        return "".join(t)

    other = [changed(t) for t in base]
    frame = lambda names: spark.createDataFrame([(1, "signal", n) for n in names], "layout_id long, cls string, anchor_text string")
    for limit in (0.9, 0.75):
        got = {(r.a_name, r.b_name) for r in compare.similar_names(frame(base), frame(other), limit).collect()}
        want = {(a, b) for a in set(base) for b in set(other) if a and b and a != b and difflib.SequenceMatcher(None, a, b).ratio() >= limit}
        assert got == want and len(want) > 10


def test_symbols_link_over_any_distance(spark):
    symbols = spark.createDataFrame([("far", True, ["any"], 700.0), ("near", True, ["any"], 50.0), ("huge", True, ["any"], 9000.0), ("not", False, ["any"], 700.0)],
                                    "name string, links_to_coordinate boolean, coordinate_position array<string>, max_link_distance double")
    marks = [(i, c, 1000.0 * i, 0.0) for i, c in enumerate(["far", "near", "huge", "not"], 1)]
    df = spark.createDataFrame([(1, 1, i, c, 0.0, x, y) for i, c, x, y in marks], "layout_id long, page int, row_id long, cls string, angle double, cx double, cy double")
    coords = spark.createDataFrame([(1, 1, 100, 1000.0, 40.0), (1, 1, 101, 2000.0, 60.0), (1, 1, 102, 3000.0, 8000.0), (1, 1, 103, 1000.0, -690.0)], "layout_id long, page int, row_id long, cx double, cy double")
    got = {r.cls: (r.coord_id, r.link_distance) for r in linking.link_symbols(df, coords, symbols).collect()}
    assert got == {"far": (100, 40.0), "huge": (101, (1000.0**2 + 60.0**2) ** 0.5)}


def test_relation_search_spans_the_page(spark):
    cols = "layout_id long, page int, row_id long, cls string, cx double, cy double"
    df = spark.createDataFrame([(1, 1, 1, next(iter(R.RELATION)), 0.0, 0.0)], cols)
    coords = spark.createDataFrame([(1, 1, 2, "coordinate", 90_000.0, 0.0)], cols)
    assert [r.min_distance for r in spatial_checks.relation_issues(df, coords).collect()] == [90_000.0]


def test_adaptive_links_come_after_the_claims(spark):
    cols = "layout_id long, page int, row_id long, cls string, cx double, cy double, w double, h double, angle double, anchor_text string, coord_text string, x1 double, y1 double, x2 double, y2 double"

    def box(i, cls, x, y):
        return (1, 1, i, cls, x, y, 40.0, 30.0, 0.0, "A1", "1,0", x - 20, y - 15, x + 20, y + 15)

    anchors = [box(i, "gm_block", 400.0 * i, 0.0) for i in range(1, 6)]
    # four of them have a coordinate close below; the fifth's is where only the offsets of the others would look for it
    marks = [box(100 + i, "coordinate", 400.0 * i + 2.0, 40.0) for i in range(1, 5)] + [box(105, "coordinate", 2000.0 + 120.0, 60.0)]
    a, c = spark.createDataFrame(anchors, cols), spark.createDataFrame(marks, cols)
    got = {r.row_id: (r.coord_id, r.how) for r in linking.assign_coordinates(a, c).collect()}
    assert {i: got.get(i) for i in range(1, 5)} == {i: (100 + i, "claim") for i in range(1, 5)}
    assert got[5] == (105, "adaptive")


def test_auction_finds_the_best_total(spark):
    rnd = random.Random(6)
    rows = []
    for plan in (1, 2):
        for a in range(4):
            for b in rnd.sample(range(3), rnd.randint(1, 3)):
                rows.append((plan, f"a{a}", f"b{b}", rnd.choice([0.3, 0.5, 0.5, 0.7, 0.95])))
    edges = spark.createDataFrame(rows, "layout_id long, old_id string, new_id string, score double")
    found = compare.auction(edges, 20).collect()
    for plan in (1, 2):
        value = {(a, b): round(s * 20) for p, a, b, s in rows if p == plan}

        def best(a=0, taken=frozenset()):
            if a == 4:
                return 0
            return max([best(a + 1, taken), *[v + best(a + 1, taken | {b}) for (x, b), v in value.items() if x == f"a{a}" and b not in taken]])

        own = [r for r in found if r.layout_id == plan]
        assert len({r.old_id for r in own}) == len({r.new_id for r in own}) == len(own)
        assert sum(value[r.old_id, r.new_id] for r in own) == best()
    by_task = compare.assign(edges).collect()
    assert round(sum(r.score for r in by_task), 6) == round(sum(r.score for r in found), 6)


def test_assignment_tasks_follow_the_work(spark):
    """Few bytes are much work: more groups make more tasks, whatever the size of their rows."""
    some = spark.sparkContext.defaultParallelism
    assert compare._tasks(spark.range(1), 0) == some
    assert compare._tasks(spark.range(1), 100 * some * compare.TASK_CELLS) == 100 * some


def test_small_groups_are_spread_by_their_cells(spark, monkeypatch):
    monkeypatch.setattr(compare, "TASK_CELLS", 4)
    rows = [(1, f"o{g}{i}", f"n{g}{j}", 0.9 if i == j else 0.5) for g in range(40) for i in range(2) for j in range(2)]
    out = compare.assign(spark.createDataFrame(rows, compare.PAIR_SCHEMA))
    assert {(r.old_id, r.new_id) for r in out.collect()} == {(f"o{g}{i}", f"n{g}{i}") for g in range(40) for i in range(2)}
    assert "REPARTITION_BY_NUM" in out._jdf.queryExecution().executedPlan().toString()
    assert out.rdd.getNumPartitions() >= 40
