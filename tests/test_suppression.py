"""Suppression of small groups in one task and of crowded ones by rounds: the same rows, and what either writes."""

import os
import random
from itertools import cycle

import pytest
from pyspark.sql import functions as F

from plotweave import session
from plotweave.functions import geometry as G
from plotweave.operators import iterative, tracks

BOXES = "layout_id LONG, page INT, row_id LONG, cls STRING, conf DOUBLE, x1 DOUBLE, y1 DOUBLE, x2 DOUBLE, y2 DOUBLE, cx DOUBLE, cy DOUBLE, angle DOUBLE"
SUPPRESS = [tracks.nms, tracks.suppress_centers, tracks.suppress_weaker]


def _rows(seed, n, wide=900, groups=((1, 1, "signal"), (1, 2, "signal"), (2, 1, "coordinate"))):
    rnd = random.Random(seed)
    out = []
    for i, (layout, page, cls) in zip(range(n), cycle(groups)):
        cx, cy, w, h = rnd.randint(0, wide), rnd.randint(0, wide), rnd.randint(20, 90), rnd.randint(20, 90)
        out.append((layout, page, i, cls, round(rnd.random(), 1), cx - w / 2, cy - h / 2, cx + w / 2, cy + h / 2, float(cx), float(cy), float(rnd.choice([0, 30, 200]))))
    return out


def _odd(seed):
    """Copies, repeated ids and missing values in every column."""
    rows = _rows(seed, 120, 500)
    rows += [(*r[:2], 200 + r[2], r[3], round(r[4] + 0.05, 2), *r[5:]) for r in rows[:9]]
    rows += rows[10:14] + [(*r[:2], 5, *r[3:]) for r in rows[20:26]]
    for i in range(len(BOXES.split(","))):
        rows += [(*r[:i], None, *r[i + 1:]) for r in rows[30 + 3 * i:33 + 3 * i]]
    rows += [(*r[:4], float("nan"), *r[5:]) for r in rows[80:84]]
    return rows + [(1, 1, 300 + i, "signal", 0.5, *[None] * 7) for i in range(3)]


def _plain(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("suppress", SUPPRESS)
def test_rounds_equal_one_task_on_odd_rows(spark, monkeypatch, suppress):
    df = spark.createDataFrame(_odd(4), BOXES)
    at_once = _plain(suppress(df))
    assert 0 < len(at_once) < df.count()
    for crowd, heads in ((0, 64), (2, 9)):
        monkeypatch.setattr(iterative, "CROWD", crowd)
        assert _plain(suppress(df, heads=heads)) == at_once
    assert suppress(df.limit(0)).count() == 0


def test_weaker_ones_equal_sequential_pass(spark):
    rows, kept = _rows(6, 150), []
    for r in sorted(rows, key=lambda r: (-r[4], r[2])):
        if not any(k[:2] == r[:2] and k[3] == r[3] and ((k[9] - r[9]) ** 2 + (k[10] - r[10]) ** 2) ** 0.5 < 200 and k[4] - r[4] > 0.05 for k in kept):
            kept.append(r)
    assert {r.row_id for r in tracks.suppress_weaker(spark.createDataFrame(rows, BOXES)).collect()} == {r[2] for r in kept}


def test_small_groups_are_written_as_their_result_only(spark, monkeypatch):
    written, cut = [], iterative.cut

    def counted(df, *more):
        out = cut(df, *more)
        written.append(out.count())
        return out

    monkeypatch.setattr(iterative, "cut", counted)
    df = spark.createDataFrame(_rows(7, 300), BOXES)
    kept = tracks.suppress_centers(df).count()
    assert sum(written) == 3 + kept  # groups and their sizes; not each row in each of its cells, round by round


def test_copies_do_not_make_a_crowd(spark, monkeypatch):
    monkeypatch.setattr(iterative, "_round", None)
    rows = _rows(10, 12) * 50
    df = spark.createDataFrame([(*r[:2], i, *r[3:]) for i, r in enumerate(rows)], BOXES)
    monkeypatch.setattr(iterative, "CROWD", 1)
    assert {r.row_id for r in tracks.nms(df, heads=8).collect()} <= set(range(12))


def test_small_groups_move_once(spark):
    df = spark.createDataFrame(_rows(8, 60), BOXES)
    plan = iterative._in_turn(df, 4, ["layout_id", "page", "cls"], G.box(), lambda a, b: F.lit(True), ["x1", "y1", "x2", "y2"])
    assert plan._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    assert plan.count() <= 60


def test_rounds_leave_no_open_rows_behind(spark, monkeypatch):
    tables, cut = [], iterative.cut

    def noted(df, *more):
        out = cut(df, *more)
        tables.extend({f.rsplit("/", 1)[0].removeprefix("file:").replace("//", "") for f in out.inputFiles()})
        return out

    monkeypatch.setattr(iterative, "cut", noted)
    monkeypatch.setattr(iterative, "CROWD", 4)
    df = spark.createDataFrame(_rows(9, 200, 400, ((1, 1, "signal"),)), BOXES)
    kept = tracks.nms(df, heads=4)
    left = [t for t in tables if os.path.exists(t)]
    assert len(left) < len(tables) > 8
    # what is left are the kept rows, each once, and names of groups
    assert sum(spark.read.parquet(t).count() for t in left if "row_id" in spark.read.parquet(t).columns) == kept.count()


def test_shuffle_files_go_with_the_write(spark):
    context = spark.sparkContext._jsc.sc()
    first = context.newShuffleId()
    assert session.cut(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), True).count() == 7
    last = context.newShuffleId()
    assert last > first + 1
    # the count above is one more, not of a write
    known = context.env().mapOutputTracker().shuffleStatuses()
    assert not known.contains(first + 1)
    assert spark.conf.get(session.CLEANUP, "false") == "false"


def test_only_written_steps_are_discarded(spark, tmp_path):
    own, table = str(tmp_path / "own"), session.cut(spark.range(5))
    spark.range(3).write.parquet(own)
    session.discard(spark.read.parquet(own).union(table))
    assert spark.read.parquet(own).count() == 3
    assert not any(os.path.exists(f.removeprefix("file:").replace("//", "")) for f in table.inputFiles())
