"""Text, geometry and scoring on hand-made values."""

import pytest
from pyspark.sql import functions as F

from plotweave import rules as R
from plotweave.functions import geometry as G
from plotweave.functions import scoring as S
from plotweave.functions import text as T


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


@pytest.mark.parametrize("text,value,track", [
    ("12,3456", 12.3456, None), (" -0.0734 ", -0.0734, None), ("0.0734Gl.112", 0.0734, "112"), ("0.0734(Gl.112)", 0.0734, "112"),
    ("5,8132x", 5.8132, None), ("abc", None, None), (None, None, None), ("1,23", None, None)])
def test_parse_coordinate(spark, text, value, track):
    c = F.lit(text).cast("string")
    assert one(spark, T.coord_value(c)) == value and one(spark, T.coord_track(c)) == track
    if text and "(" in text:
        assert one(spark, T.coord_value(c, strict=True)) is None


@pytest.mark.parametrize("raw,want", [("Q,0294 x", "0.0294"), ("ab 0,0734(GI.112 z", "0.0734(GI.112)"), ("none", ""), ("-O,0294", "-0.0294"), (None, "")])
def test_clean_coordinate(spark, raw, want):
    assert one(spark, T.clean_coord(F.lit(raw).cast("string"))) == want


def test_fix_brackets_and_score(spark):
    assert one(spark, T.fix_brackets(F.lit("0,0734( GI.112 )"))) == "0.0734(Gl.112)"
    assert one(spark, T.coord_score(F.lit("0.0061"))) == pytest.approx(1.8)
    assert one(spark, T.coord_score(F.lit("0.0734(Gl.112)"))) == pytest.approx(1.5 + 0.5 + 0.15)
    assert one(spark, T.coord_score(F.lit("x1"))) == 0.0


def test_signal_ids(spark):
    assert one(spark, T.fix_signal_digits(F.lit("a 1O1"))) == "A101"
    assert one(spark, T.is_strict_signal(F.lit("ÄB 12")))
    assert one(spark, T.is_exempt(F.lit("v1"))) and one(spark, T.is_exempt(F.lit("A123"))) and not one(spark, T.is_exempt(F.lit("AB12")))


def test_base_name_takes_the_first_matching_suffix(spark):
    assert one(spark, T.base_name(F.lit("/a/layout_v2.pdf"))) == "layout"
    assert one(spark, T.base_name(F.lit("plan_rev3.PDF"))) == "plan"
    assert one(spark, T.base_name(F.lit("S_10_01-001_A6Z_D_000.pdf"))) == "S_10_01-001_A6Z"
    assert one(spark, T.base_name(F.lit("plain"))) == "plain"


def test_word_changes_and_generated_names(spark):
    got = one(spark, T.word_changes(F.lit("Hp 0/Hp 1"), F.lit("Hp 0/Hp 2")))
    assert [(r.position, r.old, r.new) for r in got] == [(3, "1", "2")]
    for name, cls, want in [("sverbinder 7", "sverbinder", True), ("GM block 3", "gm_block", True), ("gm", "gm_block", True), ("haltepunkt 1 (MB456)", "haltepunkt", True), ("SV-Alpha", "sverbinder", False)]:
        assert one(spark, T.is_generated(F.lit(name), F.lit(cls))) is want


def test_block_lines(spark):
    assert one(spark, T.block_coords(F.lit("WAHR921\nWA  O,0452\n\nWB 0,OOO1(Gl.1)"))) == ["WA  0,0452", "WB 0,0001(Gl.1)"]


@pytest.mark.parametrize("deg,kind,off", [(-0.2, "horizontal", 0.2), (88, "vertical", 2.0), (45, "angular", 45.0), (102, "vertical", 12.0), (102.5, "angular", 12.5)])
def test_angles(spark, deg, kind, off):
    assert one(spark, G.angle_class(F.lit(float(deg)))) == kind
    assert one(spark, G.to_cardinal(F.lit(float(deg)))) == pytest.approx(off)


def test_risk_levels_at_their_limits(spark):
    for score, want in [(0.2, "medium_risk"), (0.2001, "high_risk"), (0.1, "medium_risk"), (0.0999, "low_risk")]:
        assert one(spark, S.risk_level(F.lit(score))) == want


def test_match_score_of_equal_balises_far_apart_stays_at_the_limit(spark):
    row = dict(cls="gks_gesteuert", anchor_text="0305", coord_text=None, coord_value=None)
    cols = []
    for p, cx in (("a_", 0.0), ("b_", 5000.0)):
        cols += [F.lit(row["cls"]).alias(p + "cls"), F.lit(1).alias(p + "page"), F.lit(row["anchor_text"]).alias(p + "anchor_text"), F.lit(None).cast("string").alias(p + "coord_text"),
                 F.lit(None).cast("double").alias(p + "coord_value"), F.lit(cx).alias(p + "cx"), F.lit(1.0).alias(p + "cy")]
    score = spark.range(1).select(*cols).select(S.match_score().alias("s")).first()["s"]
    assert not score > R.MATCH_MIN and score == pytest.approx(0.7)
