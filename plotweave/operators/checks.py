"""Row rules, pattern and statistics checks, and the full validation.

Row rules are Column expressions that give an issue or NULL. All rules of a run are evaluated in
one pass over the table and exploded once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plotweave import rules as R
from plotweave.functions import scoring as S
from plotweave.functions import text as T
from plotweave.operators import ordered

C = F.col
ISSUE = ["severity", "category", "field", "message", "current_value", "suggested_value", "auto_correctable", "confidence"]


def _text(v) -> Column:
    return (v if isinstance(v, Column) else F.lit(v)).cast("string")


def issue(when: Column, severity, category: str, field: str, message, current=None, suggested=None, auto=False, confidence=0.0) -> Column:
    def col(v, t):
        return (v if isinstance(v, Column) else F.lit(v)).cast(t)

    return F.when(when, F.struct(
        col(severity, "string").alias("severity"), F.lit(category).alias("category"), F.lit(field).alias("field"),
        col(message, "string").alias("message"), col(current, "string").alias("current_value"),
        col(suggested, "string").alias("suggested_value"), col(auto, "boolean").alias("auto_correctable"),
        col(confidence, "double").alias("confidence"),
    ))


def percent(v: Column) -> Column:
    return F.concat(F.format_string("%.0f", v * 100), F.lit("%"))


# --- row rules ---------------------------------------------------------------------------------
def low_confidence() -> list[Column]:
    """Below the class threshold; an error below 60 % of it."""
    thr = R.lookup(C("cls"), R.REVIEW, R.REVIEW_DEFAULT_CHECK)
    very = C("conf") < thr * 0.6
    return [issue(C("conf") < thr, F.when(very, "error").otherwise("warning"), "low_confidence", "conf",
                  F.concat(F.lit("confidence: "), C("cls"), F.when(very, " very low").otherwise(" low")), percent(C("conf")))]


def low_confidence_absolute(limit: float = 0.3) -> list[Column]:
    return [issue((C("conf") < limit) & ~R.is_in(C("cls"), ["isolierstoß"]), "warning", "confidence", "conf",
                  F.concat(C("cls"), F.lit(": low confidence")), C("conf"))]


def missing_data() -> list[Column]:
    """Linkable class without coordinate, and class that needs a text without one."""
    no_text = C("cls").isin(R.NEED_TEXT) & ~T.filled(C("anchor_text"))
    return [
        issue(R.is_in(C("cls"), R.NEED_COORDINATE) & (F.coalesce("coord_text", F.lit("")) == ""), "warning", "missing_data", "coord_text",
              F.concat(C("cls"), F.lit(": no coordinate linked"))),
        issue(no_text, "error", "missing_data", "anchor_text", F.concat(C("cls"), F.lit(": text is empty")), "", confidence=1.0),
        issue(no_text, "warning", "missing_text", "anchor_text", F.concat(C("cls"), F.lit(": text missing"))),
    ]


def value_range(limit: float = 1000) -> list[Column]:
    return [issue((C("cls") == "coordinate") & (F.abs("coord_value") > limit), "warning", "value_range", "coord_value",
                  "coordinate: unusually large value", C("coord_value"))]


def signal_format() -> list[Column]:
    s = T.text_or_empty(C("anchor_text"))
    fix = F.translate(F.upper(s), " -", "")
    ok = fix.rlike(R.SIGNAL_ID)
    return [issue((C("cls") == "signal") & (s != "") & ~s.rlike(R.SIGNAL_ID), "warning", "format", "anchor_text",
                  F.concat(F.lit("signal: invalid format '"), s, F.lit("'")), s, F.when(ok, fix), ok, F.when(ok, 0.8).otherwise(0.0))]


def gks_format() -> list[Column]:
    """Digits-only format with other characters removed (the older check)."""
    s = T.text_or_empty(C("anchor_text"))
    fix = F.regexp_replace(s, r"\D", "")
    ok = fix.rlike(R.GKS_ID)
    return [issue(C("cls").isin(R.GKS) & (s != "") & ~s.rlike(R.GKS_ID), "warning", "format", "anchor_text",
                  F.concat(F.lit("gks: invalid format '"), s, F.lit("'")), s, F.when(ok, fix), ok, F.when(ok, 0.7).otherwise(0.0))]


def gks_lookalikes() -> list[Column]:
    """Letters that look like digits: a safe fix if three or four digits result, else an error."""
    s = T.text_or_empty(C("anchor_text"))
    fix = F.regexp_replace(F.translate(s, "OoIlLSBZ", "00111582"), r"\D", "")
    gks, ok = C("cls").isin(R.GKS) & (s != ""), fix.rlike(R.GKS_ID)
    return [
        issue(gks & ok & (fix != s), "warning", "format", "anchor_text", "gks: look-alike characters", s, fix, True, 0.9),
        issue(gks & ~ok, "error", "format", "anchor_text", "gks: must be three or four digits", s, F.when(fix != s, fix), False, 0.8),
    ]


def wide_blanks() -> list[Column]:
    return [
        issue(S.wide_blank(C(c)), "warning", "format", c, F.concat(C("cls"), F.lit(": several blanks")), C(c), T.squeeze(C(c)), True, 0.95)
        for c in ("anchor_text", "coord_text")
    ]


def linked_coordinate() -> list[Column]:
    """Start, separator and digit count of a coordinate linked to an anchor."""
    s = T.text_or_empty(C("coord_text"))
    on = (C("cls") != "coordinate") & (s != "") & ~F.lower(s).isin("none", "nan", "null")
    fix = F.regexp_replace(s, r"^[^0-9-]+", "")
    can = (fix != "") & fix.contains(".")
    return [
        issue(on & ~s.rlike(r"^[0-9-]"), "error", "format", "coord_text", F.concat(F.lit("coordinate does not start with a digit: "), s),
              s, F.when(can, fix), can, F.when(can, 0.8).otherwise(0.0)),
        issue(on & ~s.contains("."), "error", "format", "coord_text", F.concat(F.lit("coordinate without decimal point: "), s), s, confidence=0.9),
        issue(on & (T.digits_in(s) < 3), "warning", "format", "coord_text", F.concat(F.lit("coordinate with few digits: "), s), s, confidence=0.85),
    ]


def coordinate_format() -> list[Column]:
    """First of: lower-case letters, no number in front, brackets not paired."""
    s = T.text_or_empty(C("coord_text"))
    upper = F.regexp_replace(s, r"Gl(?=\.|\d|\))", "GL")
    number = r"^(-?\d+[.,]\d+)"
    rest = F.btrim(F.regexp_replace(s, number, ""))
    on = (C("cls") == "coordinate") & (s != "")
    lower, bare = upper.rlike(r"\p{Ll}"), ~s.rlike(number)
    return [
        issue(on & lower, "error", "format", "coord_text", F.concat(F.lit("coordinate: lower-case letters '"), s, F.lit("'")), s, F.upper(s), True, 0.95),
        issue(on & ~lower & bare, "error", "format", "coord_text", F.concat(F.lit("coordinate: invalid format '"), s, F.lit("'")), s),
        issue(on & ~lower & ~bare & (rest != "") & ~(rest.startswith("(") & rest.endswith(")")), "warning", "format", "coord_text",
              F.concat(F.lit("coordinate: brackets '"), s, F.lit("'")), s),
    ]


def block_start() -> list[Column]:
    s = T.text_or_empty(C("anchor_text"))
    return [issue((C("cls") == "weichen_block") & (s != "") & ~F.upper(s).startswith("W"), "error", "format", "anchor_text",
                  "switch block does not start with W", s, confidence=0.95)]


def direction_value() -> list[Column]:
    """Direction missing where one is needed, or not A or B."""
    d = C("fahrtrichtung")
    missing = ~T.is_exempt(C("anchor_text")) & (F.coalesce(d, F.lit("")) == "")
    up = F.upper(T.strip(d))
    ok = up.isin("A", "B")
    return [
        issue((C("cls") == "signal") & missing, "warning", "missing_data", "fahrtrichtung", "signal: direction missing"),
        issue((C("cls") == "signal") & d.isNotNull() & ~d.isin("A", "B", ""), "error", "invalid_value", "fahrtrichtung",
              "signal: invalid direction", d, F.when(ok, up), ok, F.when(ok, 0.9).otherwise(0.0)),
    ]


def symbol_rules() -> list[Column]:
    """Checks of a row against its symbol definition (``s_*`` columns)."""
    t = S.symbol_terms()
    name = F.coalesce("anchor_text", F.lit(""))
    fix = T.digits_fix(name)
    can = F.coalesce((C("s_pattern") == "Nur Zahlen") & fix.rlike(r"^\d+$"), F.lit(False))
    return [
        issue(t["no_coordinate"], "error", "template_no_coordinate", "coord_value", F.concat(F.lit("Template "), C("cls"), F.lit(": no coordinate"))),
        issue(t["no_text"], "error", "template_no_text", "anchor_text", F.concat(F.lit("Template "), C("cls"), F.lit(": no text")), name),
        issue(t["borderline"], "warning", "template_low_confidence", "conf", F.concat(F.lit("Template "), C("cls"), F.lit(": borderline confidence")), percent(C("conf"))),
        issue(t["size"], "warning", "template_size_outlier", "size", F.concat(F.lit("Template "), C("cls"), F.lit(": unusual size"))),
        issue(t["far_link"], "warning", "template_link_distance_large", "link_distance", F.concat(F.lit("Template "), C("cls"), F.lit(": coordinate far away"))),
        issue(t["pattern"], "warning", "template_text_pattern_invalid", "anchor_text", F.concat(F.lit("Template "), C("cls"), F.lit(": text does not fit")),
              name, F.when(can, fix), can),
    ]


def symbol_suspects() -> list[Column]:
    score = S.symbol_false_positive()
    return [
        issue(score >= 70, "error", "template_false_positive_high", "detection", F.concat(F.lit("Template "), C("cls"), F.lit(": probably wrong")),
              F.concat(score.cast("string"), F.lit("/100")), confidence=1.0 - score / 100),
        issue((score >= 40) & (score < 70), "warning", "template_false_positive_medium", "detection", F.concat(F.lit("Template "), C("cls"), F.lit(": possibly wrong")),
              F.concat(score.cast("string"), F.lit("/100")), confidence=0.5),
    ]


DEFAULT_RULES = [low_confidence, low_confidence_absolute, missing_data, signal_format, gks_lookalikes, wide_blanks, linked_coordinate, direction_value]


def row_issues(df: DataFrame, rules: list) -> DataFrame:
    """All issues of all row rules, from one pass."""
    found = [c for r in rules for c in (r() if callable(r) else r)]
    return df.select("layout_id", "row_id", F.inline(F.array_compact(F.array(*found))))


def with_symbols(df: DataFrame, symbols: DataFrame) -> DataFrame:
    """Rows of user-defined symbols with their definition; built-in classes are left out."""
    s = symbols.select(
        C("name").alias("cls"), C("similarity_threshold").alias("s_threshold"), C("has_text").alias("s_has_text"),
        C("text_pattern").alias("s_pattern"), C("links_to_coordinate").alias("s_links"),
        C("max_link_distance").alias("s_max_link"), C("avg_template_size").alias("s_avg_size"),
    )
    return df.filter(~C("cls").isin(R.spellings(R.CLASSES))).join(s, "cls")


# --- patterns ----------------------------------------------------------------------------------
def signal_pattern(c: Column) -> Column:
    s = T.text_or_empty(c)
    return (
        F.when(s == "", "empty").when(s.rlike(r"^[A-ZÄÖÜ]{1,3}\d{1,3}$"), "letter_number").when(s.rlike(r"^\d{1,3}[A-ZÄÖÜ]{1,3}$"), "number_letter")
        .when(s.rlike(r"^[A-ZÄÖÜ]+$"), "letters_only").when(s.rlike(r"^\d+$"), "numbers_only")
        .when(s.rlike(r"^[A-ZÄÖÜ]{1,3}\d{1,3}[A-ZÄÖÜ]$"), "letter_number_letter").otherwise("other")
    )


def gks_pattern(c: Column) -> Column:
    s = F.translate(T.text_or_empty(c), " -", "")
    return F.when(T.text_or_empty(c) == "", "empty").when(s.rlike(r"^\d+$"), "numbers_only").when(s.rlike(r"\p{L}"), "contains_letters").otherwise("other")


def coord_pattern(c: Column) -> Column:
    s = c.cast("string")
    return (
        F.when(s.rlike(r"^\d+,\d{4}$"), "digit_comma_4digits").when(s.rlike(r"^\d+\.\d+$"), "decimal_dot")
        .when(s.rlike(r"^\d+,\d+$"), "decimal_comma").when(s.rlike(r"^\d+$"), "integer").otherwise("unknown")
    )


def pattern_shares(df: DataFrame, keys: list[str], pattern: str = "pattern") -> DataFrame:
    """Most frequent pattern per group with its count and the group size. Patterns per group are few."""
    per = df.groupBy(*keys, pattern).agg(F.count(F.lit(1)).alias("k"), F.min("row_id").alias("first_row"))
    top = F.min(F.struct((-C("k")).alias("k"), "first_row", C(pattern).alias("p")))
    return per.groupBy(*keys).agg(F.sum("k").alias("n"), top.alias("m")).select(
        *keys, "n", (-C("m.k")).alias("majority_count"), C("m.p").alias("majority")
    )


def pattern_outliers(df: DataFrame, coord_col: str = "coord_text") -> DataFrame:
    """Texts that do not look like the majority of their class in the plan."""
    cls = C("cls")
    d = df.withColumn("pattern", F.when(cls == "signal", signal_pattern(C("anchor_text"))).when(cls.isin(R.GKS), gks_pattern(C("anchor_text")))
                      .when(cls == "coordinate", coord_pattern(C(coord_col))))
    shown = F.when(cls == "coordinate", C(coord_col).isNotNull()).otherwise(F.coalesce("anchor_text", F.lit("")) != "")
    d = d.filter(C("pattern").isNotNull() & shown)
    share = pattern_shares(d, ["layout_id", "cls"]).filter(C("n") >= 3)
    j = d.join(share, ["layout_id", "cls"])
    odd = C("pattern") != C("majority")
    text, coord = F.when(cls == "coordinate", C(coord_col).cast("string")).otherwise(T.strip(C("anchor_text"))), cls == "coordinate"
    return row_issues(j, [[
        issue(coord & odd & (C("majority_count") >= C("n") * 0.6), "warning", "coordinate_pattern_mismatch", "coord_value",
              F.concat_ws(" ", F.lit("coordinate format"), "pattern", F.lit("expected"), "majority"), text, confidence=0.7),
        issue((cls == "signal") & odd & (C("pattern") != "empty") & (C("majority_count") >= C("n") * 0.5), "warning", "ocr_text_outlier", "anchor_text",
              F.concat_ws(" ", F.lit("signal text"), "pattern", F.lit("majority"), "majority"), text, confidence=0.7),
        issue(cls.isin(R.GKS) & (C("pattern") == "contains_letters"), "warning", "ocr_text_outlier", "anchor_text",
              F.concat(cls, F.lit(" text has letters")), text, confidence=0.8),
        issue(cls.isin(R.GKS) & (C("pattern") != "contains_letters") & odd & (C("majority") == "numbers_only"), "warning", "ocr_text_outlier", "anchor_text",
              F.concat_ws(" ", cls, F.lit("text"), "pattern"), text, confidence=0.6),
    ]])


def length_outliers(df: DataFrame) -> DataFrame:
    """Texts more than three times as long as the median of their class."""
    d = df.filter(C("cls").isin(R.NEED_TEXT) & (F.coalesce("anchor_text", F.lit("")) != "")).withColumn("len", F.length(T.strip(C("anchor_text"))).cast("double"))
    med = ordered.median(d, ["layout_id", "cls"], "len", 16.0).filter((C("n") >= 5) & (C("median") >= 2))
    j = d.join(med, ["layout_id", "cls"])
    return row_issues(j, [[issue((C("len") > C("median") * 3) & (C("len") > 10), "warning", "ocr_text_length_outlier", "anchor_text",
                                 F.concat(C("cls"), F.lit(": unusually long text")), T.strip(C("anchor_text")), confidence=0.6)]])


# --- statistics --------------------------------------------------------------------------------
def link_distances(df: DataFrame) -> DataFrame:
    """Centre distance of anchors with a linked coordinate (``lx, ly``) for the classes that are linked closely."""
    dist = F.sqrt((C("lx") - C("cx")) * (C("lx") - C("cx")) + (C("ly") - C("cy")) * (C("ly") - C("cy")))
    return df.filter(C("cls").isin(R.NEED_TEXT) & C("lx").isNotNull()).withColumn("link_dist", dist).filter(C("link_dist") > 0)


def link_distance_outliers(df: DataFrame) -> DataFrame:
    d = link_distances(df)
    med = ordered.median(d, ["layout_id", "cls"], "link_dist", 16.0).filter(C("n") >= 3)
    limit = F.greatest(C("median") * 1.5, F.lit(100.0))
    return row_issues(d.join(med, ["layout_id", "cls"]), [[
        issue(C("link_dist") > limit, "warning", "link_distance_outlier", "coord_text", F.concat(C("cls"), F.lit(": link unusually long")),
              F.concat(F.coalesce("coord_text", F.lit("")), F.lit(" @ "), F.format_string("%.0f", C("link_dist")), F.lit("px")))]])


def size_outliers(df: DataFrame, limit: float = 2.5) -> DataFrame:
    """Boxes more than ``limit`` sample deviations from the mean size of their class in the plan."""
    stats = df.groupBy("layout_id", "cls").agg(
        F.count(F.lit(1)).alias("n"), F.avg("w").alias("wm"), F.stddev_samp("w").alias("ws"), F.avg("h").alias("hm"), F.stddev_samp("h").alias("hs"),
    ).filter((C("n") >= 5) & (C("ws") >= 1) & (C("hs") >= 1))
    far = (F.abs(C("w") - C("wm")) / C("ws") > limit) | (F.abs(C("h") - C("hm")) / C("hs") > limit)
    small = (C("w") < C("wm") * 0.5) | (C("h") < C("hm") * 0.5)
    return row_issues(df.join(stats, ["layout_id", "cls"]), [[
        issue(far, "warning", "size", "size", F.concat(C("cls"), F.when(small, ": very small").otherwise(": very large")),
              F.concat(F.format_string("%.0f", C("w")), F.lit("x"), F.format_string("%.0f", C("h"))))]])


def ratio_checks(df: DataFrame) -> DataFrame:
    """Plans with too few linked rows or too few signals."""
    a = df.groupBy("layout_id").agg(
        F.count_if(F.coalesce("coord_text", F.lit("")) != "").alias("coords"), F.count_if(C("cls") == "signal").alias("signals"),
        F.count_if(C("cls").isin(R.GKS)).alias("gks"),
    ).withColumn("row_id", F.lit(-1).cast("long"))
    total = C("signals") + C("gks")
    return row_issues(a, [[
        issue((total > 5) & (C("coords") < total * 0.3), "error", "missing_data", "coordinates", "too few coordinates", C("coords")),
        issue((C("gks") > 10) & (C("signals") < C("gks") * 0.3), "warning", "missing_data", "signals", "few signals", C("signals")),
    ]])


def duplicate_ids(df: DataFrame) -> DataFrame:
    """Names used more than once within a class: first row and number of uses."""
    d = df.filter(F.coalesce("anchor_text", F.lit("")) != "").groupBy("layout_id", "cls", "anchor_text")
    return d.agg(F.min("row_id").alias("row_id"), F.count(F.lit(1)).alias("n_rows")).filter(C("n_rows") > 1)


def signal_consistency(df: DataFrame) -> DataFrame:
    """Equally named signals of a plan with different coordinates or directions."""
    def present(c):
        return F.when(F.coalesce(c, F.lit("")) != "", C(c))

    g = df.filter((C("cls") == "signal") & (F.coalesce("anchor_text", F.lit("")) != "")).groupBy("layout_id", "anchor_text").agg(
        F.min("row_id").alias("row_id"), F.count(F.lit(1)).alias("n"),
        F.count_distinct(present("coord_text")).alias("n_coords"), F.count_distinct(present("fahrtrichtung")).alias("n_directions"),
    ).filter(C("n") > 1)
    return row_issues(g, [[
        issue(C("n_coords") > 1, "error", "inconsistency", "coord_text", F.concat(F.lit("signal '"), C("anchor_text"), F.lit("': different coordinates"))),
        issue(C("n_directions") > 1, "error", "inconsistency", "fahrtrichtung", F.concat(F.lit("signal '"), C("anchor_text"), F.lit("': different directions"))),
    ]])


# --- sequences ---------------------------------------------------------------------------------
def coordinate_steps(df: DataFrame) -> DataFrame:
    """Consecutive kilometre values per page with the position of both ends."""
    d = df.filter((C("cls") == "coordinate") & C("coord_value").isNotNull())
    s = ordered.next_value(d, ["layout_id", "page"], "coord_value", 1.0, carry=["cx", "cy"])
    return s.filter(C("next_value").isNotNull()).withColumn("gap", C("next_value") - C("value"))


def coordinate_gaps(df: DataFrame, limit: float = 0.5) -> DataFrame:
    """Issue for every step between consecutive values above ``limit`` kilometres."""
    s = coordinate_steps(df)
    return row_issues(s, [[issue(C("gap") > limit, "warning", "coordinate_sequence_gap", "coord_value", "large gap in coordinate sequence",
                                 T.km_text(C("value")), confidence=F.least(F.lit(1.0), C("gap")))]])


def gap_regions(df: DataFrame, limit: float = 2.0, size: float = 200.0) -> DataFrame:
    """Region half-way between two coordinates more than ``limit`` kilometres apart."""
    s = coordinate_steps(df).filter(C("gap") > limit)
    x, y = (C("cx") + C("next_cx")) / 2, (C("cy") + C("next_cy")) / 2
    return region(s, "coordinate_gap", x, y, size / 2, size / 2, F.least(F.lit(0.9), C("gap") / 5.0))


def region(df: DataFrame, kind: str, x: Column, y: Column, half_w: float, half_h: float, confidence: Column, centre_y: Column | None = None) -> DataFrame:
    return df.select(
        "layout_id", "page", F.lit(kind).alias("region_type"), F.lit("coordinate").alias("expected_class"),
        (x - half_w).alias("x1"), (y - half_h).alias("y1"), (x + half_w).alias("x2"), (y + half_h).alias("y2"),
        x.alias("xc"), (y if centre_y is None else centre_y).alias("yc"), confidence.cast("double").alias("confidence"),
    )
