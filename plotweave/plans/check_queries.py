"""Row rules, statistics, patterns and risk."""

from __future__ import annotations

from pyspark.sql import functions as F

from plotweave import rules as R
from plotweave.functions import scoring as S
from plotweave.functions import text as T
from plotweave.operators import checks as K
from plotweave.plans.registry import query, sql_case, sql_list

C = F.col
ID = ["layout_id", "row_id"]
REVIEW, REVIEW5 = sql_case(R.REVIEW, default=R.REVIEW_DEFAULT), sql_case(R.REVIEW, default=R.REVIEW_DEFAULT_CHECK)
NEEDC, NEEDT = "cls IN " + sql_list(R.NEED_COORDINATE), "cls IN " + sql_list(R.NEED_TEXT)
ALL = "layout_id, row_id, severity, category, field, message, current_value, suggested_value, auto_correctable, confidence"


def row(sev, cat, field, msg, where, cur="NULL", sug="NULL", auto="FALSE", conf="0.0", src="det"):
    """One issue SELECT."""
    return (f"SELECT layout_id, row_id, {sev} AS severity, '{cat}' AS category, '{field}' AS field, {msg} AS message, CAST({cur} AS STRING) AS current_value, "
            f"CAST({sug} AS STRING) AS suggested_value, {auto} AS auto_correctable, CAST({conf} AS DOUBLE) AS confidence FROM {src} WHERE {where}")


def union(*parts):
    return " UNION ALL ".join(parts)


NAME = "trim(anchor_text)"
COORD = "trim(coord_text)"
PCT = "concat(printf('%.0f', conf * 100), '%')"
V1 = row(f"CASE WHEN conf < {REVIEW5} * 0.6 THEN 'error' ELSE 'warning' END", "low_confidence", "conf",
         f"concat('confidence: ', cls, CASE WHEN conf < {REVIEW5} * 0.6 THEN ' very low' ELSE ' low' END)", f"conf < {REVIEW5}", PCT)
V2 = row("'warning'", "confidence", "conf", "concat(cls, ': low confidence')", "conf < 0.3 AND cls NOT IN ('isolierstoß', 'isolierstoss')", "conf")
V3 = union(
    row("'warning'", "missing_data", "coord_text", "concat(cls, ': no coordinate linked')", f"{NEEDC} AND coalesce(coord_text, '') = ''"),
    row("'error'", "missing_data", "anchor_text", "concat(cls, ': text is empty')", f"{NEEDT} AND coalesce({NAME}, '') = ''", "''", conf="1.0"),
    row("'warning'", "missing_text", "anchor_text", "concat(cls, ': text missing')", f"{NEEDT} AND coalesce({NAME}, '') = ''"),
)
SIGFIX = f"translate(upper({NAME}), ' -', '')"
SIGOK = f"regexp_matches({SIGFIX}, '^[A-ZÄÖÜ]{{1,4}}\\d{{1,4}}$')"
F12 = row("'warning'", "format", "anchor_text", f"concat('signal: invalid format ''', {NAME}, '''')",
          f"cls = 'signal' AND {NAME} <> '' AND NOT regexp_matches({NAME}, '^[A-ZÄÖÜ]{{1,4}}\\d{{1,4}}$')", NAME, f"CASE WHEN {SIGOK} THEN {SIGFIX} END", SIGOK, f"CASE WHEN {SIGOK} THEN 0.8 ELSE 0.0 END")
GKS = "cls IN ('gks_gesteuert', 'gks_festkodiert')"
G11 = f"regexp_replace({NAME}, '\\D', '', 'g')"
G11OK = f"regexp_matches({G11}, '^\\d{{3,4}}$')"
F11 = row("'warning'", "format", "anchor_text", f"concat('gks: invalid format ''', {NAME}, '''')", f"{GKS} AND {NAME} <> '' AND NOT regexp_matches({NAME}, '^\\d{{3,4}}$')",
          NAME, f"CASE WHEN {G11OK} THEN {G11} END", G11OK, f"CASE WHEN {G11OK} THEN 0.7 ELSE 0.0 END")
G10 = f"regexp_replace(translate({NAME}, 'OoIlLSBZ', '00111582'), '\\D', '', 'g')"
G10OK = f"regexp_matches({G10}, '^\\d{{3,4}}$')"
F10 = union(
    row("'warning'", "format", "anchor_text", "'gks: look-alike characters'", f"{GKS} AND {NAME} <> '' AND {G10OK} AND {G10} <> {NAME}", NAME, G10, "TRUE", "0.9"),
    row("'error'", "format", "anchor_text", "'gks: must be three or four digits'", f"{GKS} AND {NAME} <> '' AND NOT {G10OK}", NAME, f"CASE WHEN {G10} <> {NAME} THEN {G10} END", "FALSE", "0.8"),
)
F13 = union(*[row("'warning'", "format", c, "concat(cls, ': several blanks')", f"contains({c}, '  ')", c, f"regexp_replace(trim({c}), '\\s+', ' ', 'g')", "TRUE", "0.95") for c in ("anchor_text", "coord_text")])
ON14 = f"cls <> 'coordinate' AND coalesce({COORD}, '') <> ''"
FIX14 = f"regexp_replace({COORD}, '^[^0-9-]+', '')"
CAN14 = f"({FIX14} <> '' AND contains({FIX14}, '.'))"
DIG14 = f"length(regexp_replace({COORD}, '[^0-9]', '', 'g'))"


def f14(src):
    return union(
        row("'error'", "format", "coord_text", f"concat('coordinate does not start with a digit: ', {COORD})", f"{ON14} AND NOT regexp_matches({COORD}, '^[0-9-]')", COORD,
            f"CASE WHEN {CAN14} THEN {FIX14} END", CAN14, f"CASE WHEN {CAN14} THEN 0.8 ELSE 0.0 END", src),
        row("'error'", "format", "coord_text", f"concat('coordinate without decimal point: ', {COORD})", f"{ON14} AND NOT contains({COORD}, '.')", COORD, conf="0.9", src=src),
        row("'warning'", "format", "coord_text", f"concat('coordinate with few digits: ', {COORD})", f"{ON14} AND {DIG14} < 3", COORD, conf="0.85", src=src),
    )


EXEMPT = f"(starts_with(upper({NAME}), 'V') OR regexp_matches(upper({NAME}), '^\\p{{L}}\\d{{3,}}$'))"
F18 = union(
    row("'warning'", "missing_data", "fahrtrichtung", "'signal: direction missing'", f"cls = 'signal' AND NOT {EXEMPT} AND coalesce(fahrtrichtung, '') = ''"),
    row("'error'", "invalid_value", "fahrtrichtung", "'signal: invalid direction'", "cls = 'signal' AND fahrtrichtung NOT IN ('A', 'B', '')", "fahrtrichtung",
        "CASE WHEN upper(fahrtrichtung) IN ('A', 'B') THEN upper(fahrtrichtung) END", "upper(fahrtrichtung) IN ('A', 'B')", "CASE WHEN upper(fahrtrichtung) IN ('A', 'B') THEN 0.9 ELSE 0.0 END"),
)


def rules(t, *r):
    return K.row_issues(t.det, list(r))


@query("v1_low_confidence", sql=V1)
def v1(t):
    return rules(t, K.low_confidence)


@query("v2_low_confidence_absolute", sql=V2)
def v2(t):
    return rules(t, K.low_confidence_absolute)


@query("v3_missing_data", sql=V3)
def v3(t):
    return rules(t, K.missing_data)


@query("v4_value_range", sql=row("'warning'", "value_range", "coord_value", "'coordinate: unusually large value'", "cls = 'coordinate' AND abs(coord_value) > 15", "coord_value"))
def v4(t):
    return rules(t, K.value_range(15))


@query("f10_gks_lookalikes", sql=F10)
def f10(t):
    return rules(t, K.gks_lookalikes)


@query("f11_gks_format", sql=F11)
def f11(t):
    return rules(t, K.gks_format)


@query("f12_signal_format", sql=F12)
def f12(t):
    return rules(t, K.signal_format)


@query("f13_wide_blanks", sql=F13)
def f13(t):
    return rules(t, K.wide_blanks)


DIRTY = "(SELECT * REPLACE (CASE r % 5 WHEN 0 THEN 'km ' || coord_text WHEN 1 THEN substr(coord_text, 1, 3) ELSE coord_text END AS coord_text) FROM det)"


def dirty(t):
    c = F.when(C("r") % 5 == 0, F.concat(F.lit("km "), "coord_text")).when(C("r") % 5 == 1, F.substr("coord_text", F.lit(1), F.lit(3))).otherwise(C("coord_text"))
    return t.det.withColumn("coord_text", c)


@query("f14_linked_coordinate", sql=f14(DIRTY))
def f14_q(t):
    return K.row_issues(dirty(t), [K.linked_coordinate])


GL15 = f"regexp_replace(regexp_replace({COORD}, 'Gl([.)])', 'GL\\1', 'g'), 'Gl(\\d)', 'GL\\1', 'g')"
LOW15, NUM15 = f"regexp_matches({GL15}, '\\p{{Ll}}')", f"regexp_matches({COORD}, '^-?\\d+[.,]\\d+')"
REST15 = f"trim(regexp_replace({COORD}, '^(-?\\d+[.,]\\d+)', ''))"
D15 = "(SELECT * REPLACE (CASE r % 5 WHEN 0 THEN 'km ' || coord_text WHEN 1 THEN substr(coord_text, 1, 2) WHEN 2 THEN coord_text || ')' ELSE coord_text END AS coord_text) FROM det WHERE cls = 'coordinate' AND coord_text IS NOT NULL)"


@query("f15_coordinate_format", sql=union(
    row("'error'", "format", "coord_text", f"concat('coordinate: lower-case letters ''', {COORD}, '''')", LOW15, COORD, f"upper({COORD})", "TRUE", "0.95", D15),
    row("'error'", "format", "coord_text", f"concat('coordinate: invalid format ''', {COORD}, '''')", f"NOT {LOW15} AND NOT {NUM15}", COORD, src=D15),
    row("'warning'", "format", "coord_text", f"concat('coordinate: brackets ''', {COORD}, '''')", f"NOT {LOW15} AND {NUM15} AND {REST15} <> '' AND NOT (starts_with({REST15}, '(') AND ends_with({REST15}, ')'))", COORD, src=D15)))
def f15(t):
    c = F.when(C("r") % 5 == 0, F.concat(F.lit("km "), "coord_text")).when(C("r") % 5 == 1, F.substr("coord_text", F.lit(1), F.lit(2))).when(
        C("r") % 5 == 2, F.concat("coord_text", F.lit(")"))).otherwise(C("coord_text"))
    return K.row_issues(t.det.withColumn("coord_text", c), [K.coordinate_format])


@query("f16_block_start", sql=row("'error'", "format", "anchor_text", "'switch block does not start with W'", f"cls = 'weichenende' AND {NAME} <> '' AND NOT starts_with(upper({NAME}), 'W')", NAME, conf="0.95"))
def f16(t):
    return K.row_issues(t.det.withColumn("cls", F.when(C("cls") == "weichenende", "weichen_block").otherwise(C("cls"))), [K.block_start])


@query("f18_direction", sql=F18)
def f18(t):
    return rules(t, K.direction_value)


@query("u1_issue_union", sql=union(V1, V2, V3, F12, F10, F13, f14("det"), F18))
def u1(t):
    return rules(t, *K.DEFAULT_RULES)


# --- user symbols ------------------------------------------------------------------------------
SYMBOL_ROWS = [
    # name, threshold, has text, pattern, links, positions, max link, mean size
    ("raute", 0.70, True, "Nur Zahlen", True, ["below", "right"], 150, 22.0),
    ("dreieck", 0.60, True, "Signal-ID", True, ["any"], 180, 60.0),
    ("kreuz", 0.50, False, None, False, ["above_left"], 120, 90.0),
]
SYMBOL_SCHEMA = "name STRING, similarity_threshold DOUBLE, has_text BOOLEAN, text_pattern STRING, links_to_coordinate BOOLEAN, coordinate_position ARRAY<STRING>, max_link_distance INT, avg_template_size DOUBLE"


def symbol_dim(t):
    return t.spark.createDataFrame(SYMBOL_ROWS, SYMBOL_SCHEMA)


SD = """sd AS (SELECT * FROM (VALUES ('raute', 0.70::DOUBLE, TRUE, '^\\d+$', 'Nur Zahlen', TRUE, 150, 22.0::DOUBLE), ('dreieck', 0.60, TRUE, '^[A-ZÄÖÜ]{1,2}\\d{1,3}$', 'Signal-ID', TRUE, 180, 60.0), ('kreuz', 0.50, FALSE, NULL, NULL, FALSE, 120, 90.0))
  AS v(name, thr, has_text, regex, preset, links, max_link, avg_size)),
sj AS (SELECT s.*, thr, has_text, regex, preset, links, max_link, (w + h) / 2 / avg_size AS ratio, coalesce(anchor_text, '') AS nm FROM sym s JOIN sd ON s.cls = sd.name),
st AS (SELECT *, links AND coord_value IS NULL AS t1, has_text AND length(nm) < 2 AS t2, regex IS NOT NULL AND nm <> '' AND NOT regexp_matches(nm, regex) AS t3, ratio > 2.5 OR ratio < 0.4 AS t4,
  conf >= thr AND conf < thr + 0.05 AS t5, link_distance > max_link * 0.8 AS t6, coalesce(preset = 'Nur Zahlen' AND regexp_matches(translate(nm, 'OISBZ', '01582'), '^\\d+$'), FALSE) AS can FROM sj)"""


@query("v5_symbol_checks", "sym", sql=f"WITH {SD} " + union(
    row("'error'", "template_no_coordinate", "coord_value", "concat('Template ', cls, ': no coordinate')", "t1", src="st"),
    row("'error'", "template_no_text", "anchor_text", "concat('Template ', cls, ': no text')", "t2", "nm", src="st"),
    row("'warning'", "template_low_confidence", "conf", "concat('Template ', cls, ': borderline confidence')", "t5", PCT, src="st"),
    row("'warning'", "template_size_outlier", "size", "concat('Template ', cls, ': unusual size')", "t4", src="st"),
    row("'warning'", "template_link_distance_large", "link_distance", "concat('Template ', cls, ': coordinate far away')", "t6", src="st"),
    row("'warning'", "template_text_pattern_invalid", "anchor_text", "concat('Template ', cls, ': text does not fit')", "t3", "nm", "CASE WHEN can THEN translate(nm, 'OISBZ', '01582') END", "can", src="st")))
def v5(t):
    return K.row_issues(K.with_symbols(t.sym, symbol_dim(t)), [K.symbol_rules])


@query("r6_symbol_false_positive", "sym", sql=f"""WITH {SD}, sc AS (SELECT *, least(100, CASE WHEN t1 THEN 50 ELSE 0 END + CASE WHEN t2 THEN 40 ELSE 0 END + CASE WHEN t3 THEN 35 ELSE 0 END + CASE WHEN t4 THEN 25 ELSE 0 END + CASE WHEN t5 THEN 15 ELSE 0 END + CASE WHEN t6 THEN 10 ELSE 0 END) AS score FROM st) """ + union(
    row("'error'", "template_false_positive_high", "detection", "concat('Template ', cls, ': probably wrong')", "score >= 70", "concat(score, '/100')", conf="1.0 - score / 100.0", src="sc"),
    row("'warning'", "template_false_positive_medium", "detection", "concat('Template ', cls, ': possibly wrong')", "score >= 40 AND score < 70", "concat(score, '/100')", conf="0.5", src="sc")))
def r6(t):
    return K.row_issues(K.with_symbols(t.sym, symbol_dim(t)), [K.symbol_suspects])


# --- patterns and statistics -------------------------------------------------------------------
PAT = f"""CASE WHEN cls = 'signal' THEN CASE WHEN {NAME} = '' THEN 'empty' WHEN regexp_matches({NAME}, '^[A-ZÄÖÜ]{{1,3}}\\d{{1,3}}$') THEN 'letter_number' WHEN regexp_matches({NAME}, '^\\d{{1,3}}[A-ZÄÖÜ]{{1,3}}$') THEN 'number_letter'
    WHEN regexp_matches({NAME}, '^[A-ZÄÖÜ]+$') THEN 'letters_only' WHEN regexp_matches({NAME}, '^\\d+$') THEN 'numbers_only' WHEN regexp_matches({NAME}, '^[A-ZÄÖÜ]{{1,3}}\\d{{1,3}}[A-ZÄÖÜ]$') THEN 'letter_number_letter' ELSE 'other' END
  WHEN {GKS} THEN CASE WHEN {NAME} = '' THEN 'empty' WHEN regexp_matches(translate({NAME}, ' -', ''), '^\\d+$') THEN 'numbers_only' WHEN regexp_matches({NAME}, '\\p{{L}}') THEN 'contains_letters' ELSE 'other' END
  ELSE CASE WHEN regexp_matches(coord_text, '^\\d+,\\d{{4}}$') THEN 'digit_comma_4digits' WHEN regexp_matches(coord_text, '^\\d+\\.\\d+$') THEN 'decimal_dot' WHEN regexp_matches(coord_text, '^\\d+,\\d+$') THEN 'decimal_comma' WHEN regexp_matches(coord_text, '^\\d+$') THEN 'integer' ELSE 'unknown' END END"""


@query("a11_pattern_outliers", sql=f"""
WITH p AS (SELECT *, {PAT} AS pattern FROM det WHERE (cls IN ('signal', 'gks_gesteuert', 'gks_festkodiert') AND anchor_text <> '') OR (cls = 'coordinate' AND coord_text IS NOT NULL)),
c AS (SELECT layout_id, cls, pattern, count(*) AS k, min(row_id) AS f FROM p GROUP BY ALL),
m AS (SELECT layout_id, cls, pattern AS majority, k, n FROM (SELECT *, sum(k) OVER (PARTITION BY layout_id, cls) AS n, row_number() OVER (PARTITION BY layout_id, cls ORDER BY k DESC, f) AS rn FROM c) WHERE rn = 1 AND n >= 3),
j AS (SELECT p.*, majority, k, n, CASE WHEN p.cls = 'coordinate' THEN coord_text ELSE {NAME} END AS txt FROM p JOIN m ON p.layout_id = m.layout_id AND p.cls = m.cls) """ + union(
    row("'warning'", "coordinate_pattern_mismatch", "coord_value", "concat('coordinate format ', pattern, ' expected ', majority)", "cls = 'coordinate' AND pattern <> majority AND k >= n * 0.6", "txt", conf="0.7", src="j"),
    row("'warning'", "ocr_text_outlier", "anchor_text", "concat('signal text ', pattern, ' majority ', majority)", "cls = 'signal' AND pattern <> majority AND pattern <> 'empty' AND k >= n * 0.5", "txt", conf="0.7", src="j"),
    row("'warning'", "ocr_text_outlier", "anchor_text", "concat(cls, ' text has letters')", f"{GKS} AND pattern = 'contains_letters'", "txt", conf="0.8", src="j"),
    row("'warning'", "ocr_text_outlier", "anchor_text", "concat(cls, ' text ', pattern)", f"{GKS} AND pattern <> 'contains_letters' AND pattern <> majority AND majority = 'numbers_only'", "txt", conf="0.6", src="j")))
def a11(t):
    return K.pattern_outliers(t.det)


@query("f26_pattern_class", sql=f"SELECT layout_id, row_id, {PAT} AS pattern FROM det WHERE cls IN ('signal', 'gks_gesteuert', 'gks_festkodiert') OR (cls = 'coordinate' AND coord_text IS NOT NULL)")
def f26(t):
    p = F.when(C("cls") == "signal", K.signal_pattern(C("anchor_text"))).when(C("cls").isin(R.GKS), K.gks_pattern(C("anchor_text"))).otherwise(K.coord_pattern(C("coord_text")))
    return t.det.filter(C("cls").isin(R.NEED_TEXT) | ((C("cls") == "coordinate") & C("coord_text").isNotNull())).select(*ID, p.alias("pattern"))


LONG = "(SELECT * REPLACE (CASE WHEN r % 9 = 4 THEN concat(anchor_text, ' / ', name_text, ' ', coord_text) ELSE anchor_text END AS anchor_text) FROM det)"


@query("a12_length_outliers", sql=f"""
WITH d AS (SELECT *, length({NAME}) AS len FROM {LONG} WHERE {NEEDT} AND anchor_text <> ''), m AS (SELECT layout_id, cls, count(*) AS n, median(len) AS med FROM d GROUP BY ALL),
j AS (SELECT d.*, n, med FROM d JOIN m ON d.layout_id = m.layout_id AND d.cls = m.cls) """
       + row("'warning'", "ocr_text_length_outlier", "anchor_text", "concat(cls, ': unusually long text')", "n >= 5 AND med >= 2 AND len > med * 3 AND len > 10", NAME, conf="0.6", src="j"))
def a12(t):
    d = t.det.withColumn("anchor_text", F.when(C("r") % 9 == 4, F.concat("anchor_text", F.lit(" / "), "name_text", F.lit(" "), F.coalesce("coord_text", F.lit("")))).otherwise(C("anchor_text")))
    return K.length_outliers(d)


@query("a13_link_distance_outliers", sql=f"""
WITH d AS (SELECT *, sqrt((lx - cx) * (lx - cx) + (ly - cy) * (ly - cy)) AS dist FROM det WHERE {NEEDT} AND lx IS NOT NULL), e AS (SELECT * FROM d WHERE dist > 0),
m AS (SELECT layout_id, cls, count(*) AS n, median(dist) AS med FROM e GROUP BY ALL), j AS (SELECT e.*, n, med FROM e JOIN m ON e.layout_id = m.layout_id AND e.cls = m.cls) """
       + row("'warning'", "link_distance_outlier", "coord_text", "concat(cls, ': link unusually long')", "n >= 3 AND dist > greatest(med * 1.5, 100)", "concat(coord_text, ' @ ', printf('%.0f', dist), 'px')", src="j"))
def a13(t):
    return K.link_distance_outliers(t.det)


@query("a14_size_outliers", sql="""
WITH m AS (SELECT layout_id, cls, count(*) AS n, avg(w) AS wm, stddev_samp(w) AS ws, avg(h) AS hm, stddev_samp(h) AS hs FROM det GROUP BY ALL),
j AS (SELECT d.*, n, wm, ws, hm, hs FROM det d JOIN m ON d.layout_id = m.layout_id AND d.cls = m.cls WHERE n >= 5 AND ws >= 1 AND hs >= 1) """
       + row("'warning'", "size", "size", "concat(cls, CASE WHEN w < wm * 0.5 OR h < hm * 0.5 THEN ': very small' ELSE ': very large' END)", "abs(w - wm) / ws > 1.5 OR abs(h - hm) / hs > 1.5", "concat(printf('%.0f', w), 'x', printf('%.0f', h))", src="j"))
def a14(t):
    return K.size_outliers(t.det, 1.5)


@query("a15_ratio_checks", sql="""
WITH v AS (SELECT * REPLACE (CASE WHEN cls = 'signal' AND r % 3 > 0 THEN 'gks_gesteuert' ELSE cls END AS cls, CASE WHEN layout_id % 2 = 0 OR cls = 'coordinate' THEN NULL ELSE coord_text END AS coord_text) FROM det),
a AS (SELECT layout_id, CAST(-1 AS BIGINT) AS row_id, count(*) FILTER (coalesce(coord_text, '') <> '') AS coords, count(*) FILTER (cls = 'signal') AS signals, count(*) FILTER (cls IN ('gks_gesteuert', 'gks_festkodiert')) AS gks FROM v GROUP BY layout_id) """
       + union(row("'error'", "missing_data", "coordinates", "'too few coordinates'", "signals + gks > 5 AND coords < (signals + gks) * 0.3", "coords", src="a"),
               row("'warning'", "missing_data", "signals", "'few signals'", "gks > 10 AND signals < gks * 0.3", "signals", src="a")))
def a15(t):
    d = t.det.withColumns({"coord_text": F.when((C("layout_id") % 2 != 0) & (C("cls") != "coordinate"), C("coord_text")),
                           "cls": F.when((C("cls") == "signal") & (C("r") % 3 > 0), "gks_gesteuert").otherwise(C("cls"))})
    return K.ratio_checks(d)


@query("a16_duplicate_ids", sql="SELECT layout_id, cls, anchor_text, min(row_id) AS row_id, count(*) AS n_rows FROM det WHERE anchor_text <> '' GROUP BY layout_id, cls, anchor_text HAVING count(*) > 1")
def a16(t):
    return K.duplicate_ids(t.det)


@query("a16_signal_consistency", sql="""
WITH g AS (SELECT layout_id, anchor_text, min(row_id) AS row_id, count(*) AS n, count(DISTINCT nullif(coord_text, '')) AS nc, count(DISTINCT nullif(fahrtrichtung, '')) AS nd FROM det WHERE cls = 'signal' AND anchor_text <> '' GROUP BY ALL HAVING count(*) > 1) """
       + union(row("'error'", "inconsistency", "coord_text", "concat('signal ''', anchor_text, ''': different coordinates')", "nc > 1", src="g"),
               row("'error'", "inconsistency", "fahrtrichtung", "concat('signal ''', anchor_text, ''': different directions')", "nd > 1", src="g")))
def a16b(t):
    return K.signal_consistency(t.det)


STEPS = "s AS (SELECT * FROM (SELECT *, lead(coord_value) OVER w AS nv, lead(cx) OVER w AS nx, lead(cy) OVER w AS ny FROM det WHERE cls = 'coordinate' WINDOW w AS (PARTITION BY layout_id, page ORDER BY coord_value, row_id)) WHERE nv IS NOT NULL)"


@query("w1_coordinate_gaps", sql=f"WITH {STEPS} " + row("'warning'", "coordinate_sequence_gap", "coord_value", "'large gap in coordinate sequence'", "nv - coord_value > 0.5", "printf('%.4f', coord_value)", conf="least(1.0, nv - coord_value)", src="s"))
def w1(t):
    return K.coordinate_gaps(t.det)


@query("w1_gap_regions", sql=f"""WITH {STEPS} SELECT layout_id, page, 'coordinate_gap' AS region_type, 'coordinate' AS expected_class, (cx + nx) / 2 - 100 AS x1, (cy + ny) / 2 - 100 AS y1, (cx + nx) / 2 + 100 AS x2, (cy + ny) / 2 + 100 AS y2,
  (cx + nx) / 2 AS xc, (cy + ny) / 2 AS yc, least(0.9, (nv - coord_value) / 5.0) AS confidence FROM s WHERE nv - coord_value > 2.0""")
def w1b(t):
    return K.gap_regions(t.det)


# --- risk --------------------------------------------------------------------------------------
LOWC = f"CASE WHEN conf < {REVIEW} THEN (1.0 - conf) * 0.40 ELSE 0.0 END"
MISSC = f"CASE WHEN {NEEDC} AND coalesce({COORD}, '') = '' THEN 0.30 ELSE 0.0 END"
MISST = f"CASE WHEN {NEEDT} AND coalesce({NAME}, '') = '' THEN 0.15 ELSE 0.0 END"
BADSTART = f"(coalesce({COORD}, '') <> '' AND NOT regexp_matches(coalesce({COORD}, ''), '^[0-9-]'))"
LETTERS = f"CASE WHEN {GKS} AND translate({NAME}, ' -', '') <> '' AND NOT regexp_matches(translate({NAME}, ' -', ''), '^\\d+$') THEN 0.15 ELSE 0.0 END"
SIZE = "CASE WHEN w * h < 100 OR w * h > 50000 THEN 0.10 ELSE 0.0 END"
BLANKS = "CASE WHEN contains(anchor_text, '  ') OR coalesce(contains(coord_text, '  '), FALSE) THEN 0.05 ELSE 0.0 END"
BLANKS2 = "CASE WHEN contains(anchor_text, '  ') OR (cls <> 'coordinate' AND coalesce(contains(coord_text, '  '), FALSE)) THEN 0.05 ELSE 0.0 END"
R1 = f"least(1.0, {LOWC} + {MISSC} + CASE WHEN {NEEDC} AND {BADSTART} THEN 0.20 ELSE 0.0 END + {MISST} + {LETTERS} + {BLANKS})"
R2 = f"least(1.0, {LOWC} + {MISSC} + {MISST} + CASE WHEN cls <> 'coordinate' AND {BADSTART} THEN 0.20 ELSE 0.0 END + {LETTERS} + {SIZE} + {BLANKS2})"


@query("r1_base_risk", sql=f"SELECT layout_id, row_id, round({R1}, 6) AS risk_score, CASE WHEN conf < {REVIEW} THEN 1 ELSE 0 END + CASE WHEN {MISSC} > 0 THEN 1 ELSE 0 END + CASE WHEN {NEEDC} AND {BADSTART} THEN 1 ELSE 0 END + CASE WHEN {MISST} > 0 THEN 1 ELSE 0 END + CASE WHEN {LETTERS} > 0 THEN 1 ELSE 0 END + CASE WHEN {BLANKS} > 0 THEN 1 ELSE 0 END AS n_factors FROM {DIRTY}")
def r1(t):
    score, factors = S.base_risk()
    return dirty(t).select(*ID, F.round(score, 6).alias("risk_score"), F.size(factors).alias("n_factors"))


@query("r2_row_risk", sql=f"SELECT layout_id, row_id, round({R2}, 6) AS risk_score FROM {DIRTY}")
def r2(t):
    return dirty(t).select(*ID, F.round(S.row_risk()[0], 6).alias("risk_score"))


LEVEL = "CASE WHEN risk > 0.20 THEN 'high_risk' WHEN risk >= 0.10 THEN 'medium_risk' ELSE 'low_risk' END"


@query("r4_risk_level", sql=f"SELECT layout_id, row_id, {LEVEL} AS risk_level, CASE {LEVEL} WHEN 'high_risk' THEN 'Sofort prüfen' WHEN 'medium_risk' THEN 'Bald prüfen' ELSE 'Gut erkannt' END AS label FROM (SELECT *, {R2} AS risk FROM det)")
def r4(t):
    level = S.risk_level(S.row_risk()[0])
    return t.det.withColumn("risk_level", level).select(*ID, "risk_level", S.risk_label(C("risk_level")).alias("label"))
