"""Counts, metrics, profiles, orders and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from plotweave import rules as R
from plotweave.functions import scoring as S
from plotweave.operators import checks as K
from plotweave.operators import corrections as O
from plotweave.operators import filters as P
from plotweave.operators import metrics as M
from plotweave.plans.check_queries import F10, F12, F13, F18, LEVEL, R2, REVIEW5, V1, V2, V3, f14, union
from plotweave.plans.registry import query, sql_case, sql_list

C = F.col
ID = ["layout_id", "row_id"]
ISSUES = f"i AS ({union(V1, V2, V3, F12, F10, F13, f14('det'), F18)})"


def issues(t):
    return K.row_issues(t.det, K.DEFAULT_RULES)


def rounded(df, *cols):
    # means can end exactly on half a unit; the small shift makes both engines round the same way
    return df.withColumns({c: F.round(C(c) + 1e-9, 6) for c in cols})


@query("a1_class_counts", sql="SELECT layout_id, cls, count(*) AS n, count(*) FILTER (cls IN ('haltetafel', 'weichenende')) AS custom, count(*) FILTER (cls NOT IN ('haltetafel', 'weichenende')) AS model FROM det GROUP BY ALL")
def a1(t):
    return M.class_counts(t.det, C("cls").isin("haltetafel", "weichenende"))


NEEDC = "cls IN " + sql_list(R.NEED_COORDINATE)


def _m(name, value, group, where="TRUE"):
    return f"SELECT layout_id, {name} AS metric_name, round(CAST({value} AS DOUBLE) + 1e-9, 6) AS metric_value FROM det WHERE {where} GROUP BY layout_id{group} HAVING {value} IS NOT NULL"


@query("a2_quality_metrics", sql=" UNION ALL ".join([
    _m("'avg_confidence_all'", "avg(conf)", ""), _m("'min_confidence_all'", "min(conf)", ""), _m("'max_confidence_all'", "max(conf)", ""), _m("'std_confidence_all'", "stddev_samp(conf)", ""),
    _m("'total_detections'", "count(*)", ""), _m("'coord_ocr_success_rate'", "count(coord_text) / count(*)", "", "cls = 'coordinate'"),
    _m("'signal_ocr_success_rate'", "count(anchor_text) / count(*)", "", "cls = 'signal'"), _m("'anchor_linking_success_rate'", "count(lx) / count(*)", "", NEEDC),
    _m("'avg_confidence_' || cls", "avg(conf)", ", cls"), _m("'min_confidence_' || cls", "min(conf)", ", cls"), _m("'count_' || cls", "count(*)", ", cls"),
    _m("'low_confidence_count_' || cls", f"count(*) FILTER (conf < {REVIEW5})", ", cls"), _m("'total_' || cls", "count(*)", ", cls"), _m("'avg_confidence_page_' || page", "avg(conf)", ", page")]))
def a2(t):
    return rounded(M.quality_metrics(t.det, "lx"), "metric_value")


@query("a3_risk_counts", sql=f"WITH r AS (SELECT layout_id, {LEVEL} AS l FROM (SELECT *, {R2} AS risk FROM det WHERE NOT hidden AND cls NOT IN ('coordinate', 'weichen_block'))) SELECT layout_id, count(*) FILTER (l = 'high_risk') AS high_risk, count(*) FILTER (l = 'medium_risk') AS medium_risk, count(*) FILTER (l = 'low_risk') AS low_risk, count(*) AS total FROM r GROUP BY ALL")
def a3(t):
    return M.risk_counts(t.det)


@query("a4_quality_stats", sql=f"""WITH r AS (SELECT *, {R2} AS risk FROM det), g AS (SELECT layout_id, count(*) AS total, round(avg(conf) + 1e-9, 6) AS avg_confidence, count(*) FILTER (risk > 0.20) AS high_risk, count(*) FILTER (risk >= 0.10 AND risk <= 0.20) AS medium_risk, count(*) FILTER (risk < 0.10) AS low_risk FROM r GROUP BY layout_id)
SELECT *, round(high_risk / total + 1e-9, 6) AS high_risk_share, round(medium_risk / total + 1e-9, 6) AS medium_risk_share, round(low_risk / total + 1e-9, 6) AS low_risk_share FROM g""")
def a4(t):
    d = M.quality_stats(t.det.withColumn("risk_score", S.row_risk()[0]))
    return rounded(d, "avg_confidence", "high_risk_share", "medium_risk_share", "low_risk_share")


@query("a5_confidence_stats", sql="""WITH g AS (SELECT layout_id, count(*) AS total, round(avg(conf) + 1e-9, 6) AS average, count(*) FILTER (conf >= 0.9) AS high, count(*) FILTER (conf >= 0.6 AND conf < 0.9) AS medium, count(*) FILTER (conf < 0.6) AS low, count(*) FILTER (conf < 0.4) AS very_low FROM det GROUP BY layout_id)
SELECT *, round(high / total + 1e-9, 6) AS high_share, round(medium / total + 1e-9, 6) AS medium_share, round(low / total + 1e-9, 6) AS low_share, round(very_low / total + 1e-9, 6) AS very_low_share FROM g""")
def a5(t):
    return rounded(M.confidence_stats(t.det), "average", "high_share", "medium_share", "low_share", "very_low_share")


PCOLS = ["anchor_text", "coord_text", "fahrtrichtung", "notes", "cls"]


@query("a6_profile", sql=" UNION ALL ".join(f"SELECT layout_id, '{c}' AS column_name, count(*) FILTER (trim(coalesce({c}, '')) <> '') AS filled, count(*) FILTER (trim(coalesce({c}, '')) = '') AS empty, count(DISTINCT {c}) FILTER (trim({c}) <> '') AS distinct_values FROM det GROUP BY layout_id" for c in PCOLS))
def a6(t):
    return M.profile(t.det, PCOLS)


@query("a7_issue_summary", sql=f"""WITH {ISSUES} SELECT layout_id, count(*) AS total_issues, count(*) FILTER (severity = 'error') AS errors, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'info') AS info,
  count(*) FILTER (auto_correctable) AS auto_correctable, count(*) FILTER (auto_correctable AND confidence >= 0.9) AS high_confidence_fixes, count(*) FILTER (auto_correctable AND confidence >= 0.6 AND confidence < 0.9) AS medium_confidence_fixes FROM i GROUP BY layout_id""")
def a7(t):
    return M.issue_summary(issues(t))


@query("a7_issue_categories", sql=f"WITH {ISSUES} SELECT layout_id, category, count(*) AS n FROM i GROUP BY ALL")
def a7b(t):
    return M.issue_categories(issues(t))


@query("p23_issues_view", sql=f"WITH {ISSUES} SELECT layout_id, row_id, category, field, CASE WHEN starts_with(category, 'template_') OR starts_with(message, 'Template') THEN 'template' WHEN category IN ('format', 'duplicate', 'missing_data', 'confidence') THEN 'text' ELSE 'model' END AS origin FROM i WHERE severity = 'warning' AND auto_correctable")
def p23(t):
    return P.issues_view(issues(t), "warning", True).select(*ID, "category", "field", "origin")


@query("a9_correction_stats", "corr", sql="SELECT layout_id, column_name, count(*) AS correction_count, count(DISTINCT row_id) AS affected_rows, min(created_at) AS first_correction, max(created_at) AS last_correction FROM corr GROUP BY ALL")
def a9(t):
    return O.correction_stats(t.corr)


LOG = "SELECT event_id AS id, user_id % 50 AS layout_id, CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'click' THEN 'WARNING' WHEN 'view' THEN 'INFO' ELSE 'OTHER' END AS severity, event_type AS validation_type, ts AS created_at FROM events"


def vlog(t):
    s = F.when(C("event_type") == "error", "ERROR").when(C("event_type") == "click", "WARNING").when(C("event_type") == "view", "INFO").otherwise("OTHER")
    return t.events.select(C("event_id").alias("id"), (C("user_id") % 50).alias("layout_id"), s.alias("severity"), C("event_type").alias("validation_type"), C("ts").alias("created_at"))


@query("a10_validation_summary", "events", sql=f"SELECT layout_id, count(*) FILTER (severity = 'ERROR') AS \"ERROR\", count(*) FILTER (severity = 'WARNING') AS \"WARNING\", count(*) FILTER (severity = 'INFO') AS \"INFO\", count(*) AS total FROM ({LOG}) GROUP BY layout_id")
def a10(t):
    return O.validation_summary(vlog(t))


@query("a22_quick_check", sql="WITH r AS (SELECT layout_id, (1.0 - conf) * 0.4 + CASE WHEN cls IN ('signal', 'gks_gesteuert', 'gks_nicht_gesteuert', 'weiche', 'sverbinder') AND coalesce(coord_text, '') = '' THEN 0.3 ELSE 0.0 END AS k FROM det) SELECT layout_id, count(*) FILTER (k >= 0.5) AS high, count(*) FILTER (k >= 0.3 AND k < 0.5) AS medium FROM r GROUP BY layout_id")
def a22(t):
    return M.quick_check(t.det)


@query("a23_most_corrected_fields", "corr", sql="SELECT column_name, count(*) AS correction_count, count(DISTINCT layout_id * 1000000 + row_id) AS affected_rows FROM corr GROUP BY column_name ORDER BY correction_count DESC, column_name LIMIT 3")
def a23(t):
    return O.top_corrected(t.corr, 3)


@query("o3_top_corrected", "corr", sql="SELECT column_name, count(*) AS correction_count, count(DISTINCT layout_id * 1000000 + row_id) AS affected_rows FROM corr GROUP BY column_name ORDER BY correction_count DESC, column_name LIMIT 10")
def o3(t):
    return O.top_corrected(t.corr)


@query("w5_dedupe_rows", "corr", sql="SELECT layout_id, row_id, min(corr_id) AS corr_id FROM corr GROUP BY ALL")
def w5(t):
    return M.dedupe_rows(t.corr, "corr_id").select(*ID, "corr_id")


@query("w6_next_risk", sql=f"WITH h AS (SELECT layout_id, row_id FROM (SELECT *, {R2} AS risk FROM det) WHERE risk > 0.20 AND NOT hidden AND cls NOT IN ('coordinate', 'weichen_block')) SELECT layout_id, CASE WHEN count(*) FILTER (row_id = 700) > 0 THEN coalesce(min(row_id) FILTER (row_id > 700), min(row_id)) ELSE min(row_id) END AS next_row FROM h GROUP BY layout_id")
def w6(t):
    return M.next_risk(t.det, 700)


@query("w7_row_ids", sql="SELECT layout_id, row_id, row_number() OVER (PARTITION BY layout_id ORDER BY page, row_id) - 1 AS new_id FROM det")
def w7(t):
    return M.assign_row_ids(t.det).select(*ID, "new_id")


@query("o1_sort_rows", sql="SELECT layout_id, row_id, cls, conf, coord_text FROM det ORDER BY cls, TRY_CAST(coord_text AS DOUBLE), coord_text, conf DESC")
def o1(t):
    return M.sort_rows(t.det, [("coord_text", True), ("conf", False)]).select(*ID, "cls", "conf", "coord_text")


@query("o2_validation_history", "events", sql=f"SELECT *, CASE severity WHEN 'ERROR' THEN 1 WHEN 'WARNING' THEN 2 WHEN 'INFO' THEN 3 END AS severity_rank FROM ({LOG}) ORDER BY severity_rank, created_at DESC")
def o2(t):
    return O.validation_history(vlog(t))


@query("o4_latest_entries", "corr", sql="SELECT * FROM corr ORDER BY created_at DESC, corr_id DESC LIMIT 500")
def o4(t):
    return O.latest(t.corr, 500)


@query("o5_weakest", sql="SELECT layout_id, row_id, conf FROM det ORDER BY conf, layout_id, row_id")
def o5(t):
    return M.weakest(t.det).select(*ID, "conf")


@query("o6_export_sort", sql="SELECT CAST(layout_id AS STRING) AS plan, CAST(row_id AS STRING) AS row, cls AS class, CAST(page AS STRING) AS page FROM det WHERE cls IN ('signal', 'gm_block') ORDER BY cls, page DESC")
def o6(t):
    cols = {"layout_id": "plan", "row_id": "row", "cls": "class", "page": "page"}
    return P.export_projection(t.det, {"signal": cols, "gm_block": cols}, sort=[C("cls"), C("page").desc()])


@query("o7_class_order", sql="SELECT DISTINCT cls FROM det ORDER BY cls = 'coordinate', cls")
def o7(t):
    return M.class_order(t.det)


@query("o8_correction_history", "corr", sql="SELECT * FROM corr WHERE layout_id = 7 ORDER BY created_at DESC, corr_id DESC")
def o8(t):
    return O.correction_history(t.corr, 7)


@query("o8_metric_history", "events", sql="SELECT user_id % 50 AS layout_id, event_type AS metric_name, value AS metric_value, ts AS computed_at FROM events WHERE user_id % 50 = 7 ORDER BY metric_name, computed_at DESC")
def o8b(t):
    m = t.events.select((C("user_id") % 50).alias("layout_id"), C("event_type").alias("metric_name"), C("value").alias("metric_value"), C("ts").alias("computed_at"))
    return O.metric_history(m, 7)


@query("u2_union_detections", "det sym", sql="SELECT layout_id, row_id, cls, NULL::DOUBLE AS link_distance, 'model' AS source FROM det WHERE cls NOT IN ('haltetafel', 'weichenende', 'prellbock') UNION ALL SELECT layout_id, row_id, cls, link_distance, 'symbol' FROM sym")
def u2(t):
    a = t.det.filter(~C("cls").isin("haltetafel", "weichenende", "prellbock")).select(*ID, "cls", F.lit("model").alias("source"))
    return a.unionByName(t.sym.select(*ID, "cls", "link_distance", F.lit("symbol").alias("source")), allowMissingColumns=True)


@query("u4_export_exclusion", "det corr_log", sql="SELECT CAST(layout_id AS STRING) AS plan, CAST(row_id AS STRING) AS row FROM det d WHERE cls = 'signal' AND NOT EXISTS (SELECT 1 FROM corr_log c WHERE c.layout_id = d.layout_id AND c.row_id = d.row_id)")
def u4(t):
    ex = t.corr_log.select("layout_id", "row_id").distinct()
    return P.export_projection(t.det, {"signal": {"layout_id": "plan", "row_id": "row", "cls": "class"}}, exclude=ex, drop=["class"])


# --- corrections -------------------------------------------------------------------------------
VALUE = r"TRY_CAST(replace(nullif(regexp_extract(regexp_replace(replace(trim({0}), ' ', ''), '[a-zA-Z]$', ''), '^\s*([+-]?\d{{1,3}}[,.]\d{{3,4}})\s*(?:\(?(?:GI|Gl)\.?\s*([A-Za-z0-9./-]{{1,6}})\)?)?\s*$', 1), ''), ',', '.') AS DOUBLE)"
FIX = f"WITH {ISSUES}, f AS (SELECT layout_id, row_id, field, arg_max(suggested_value, struct_pack(a := confidence, b := suggested_value)) AS v FROM i WHERE auto_correctable AND suggested_value IS NOT NULL AND field IN ('anchor_text', 'coord_text', 'fahrtrichtung', 'notes') GROUP BY ALL), w AS (SELECT layout_id, row_id, max(CASE WHEN field = 'anchor_text' THEN v END) AS a, max(CASE WHEN field = 'coord_text' THEN v END) AS c, max(CASE WHEN field = 'fahrtrichtung' THEN v END) AS r1 FROM f GROUP BY ALL)"


@query("j29_apply_corrections", sql=f"{FIX} SELECT d.layout_id, d.row_id, coalesce(a, anchor_text) AS anchor_text, coalesce(c, coord_text) AS coord_text, coalesce(r1, fahrtrichtung) AS fahrtrichtung, CASE WHEN coalesce(c <> coalesce(coord_text, ''), FALSE) THEN {VALUE.format('c')} ELSE coord_value END AS coord_value FROM det d LEFT JOIN w ON d.layout_id = w.layout_id AND d.row_id = w.row_id")
def j29(t):
    return O.apply_corrections(t.det, issues(t)).select(*ID, "anchor_text", "coord_text", "fahrtrichtung", "coord_value")


@query("j29_corrections_log", sql=f"{FIX} SELECT d.layout_id, d.row_id, f.field AS column_name, CASE f.field WHEN 'anchor_text' THEN anchor_text WHEN 'coord_text' THEN coord_text WHEN 'fahrtrichtung' THEN fahrtrichtung ELSE notes END AS old_value, v AS new_value FROM det d JOIN f ON d.layout_id = f.layout_id AND d.row_id = f.row_id WHERE v IS DISTINCT FROM CASE f.field WHEN 'anchor_text' THEN anchor_text WHEN 'coord_text' THEN coord_text WHEN 'fahrtrichtung' THEN fahrtrichtung ELSE notes END")
def j29b(t):
    return O.corrections_log(t.det, issues(t))


@query("j30_propagate_coordinates", sql=f"WITH c AS (SELECT layout_id, page, trim(coord_text) AS o, max(replace(coord_text, ',', '.')) AS n FROM det WHERE cls = 'coordinate' AND coord_text IS NOT NULL GROUP BY ALL) SELECT d.layout_id, d.row_id, CASE WHEN cls <> 'coordinate' AND n IS NOT NULL THEN n ELSE coord_text END AS coord_text, CASE WHEN cls <> 'coordinate' AND n IS NOT NULL THEN {VALUE.format('n')} ELSE coord_value END AS coord_value FROM det d LEFT JOIN c ON d.layout_id = c.layout_id AND d.page = c.page AND trim(d.coord_text) = o")
def j30(t):
    c = t.det.filter((C("cls") == "coordinate") & C("coord_text").isNotNull()).select("layout_id", "page", C("coord_text").alias("old_text"), F.replace("coord_text", F.lit(","), F.lit(".")).alias("new_text"))
    return O.propagate_coordinates(t.det, c).select(*ID, "coord_text", "coord_value")


LINKS = "ln AS (SELECT a.layout_id, a.row_id, min(c.row_id) AS coord_row FROM det a JOIN det c ON a.layout_id = c.layout_id AND a.page = c.page AND a.r % 7 = c.r % 7 AND a.cls = 'signal' AND c.cls = 'coordinate' GROUP BY ALL)"


def links(t):
    key = ["layout_id", "page", "k"]
    c = t.det.filter(C("cls") == "coordinate").groupBy("layout_id", "page", (C("r") % 7).alias("k")).agg(F.min("row_id").alias("coord_row"))
    return t.det.filter(C("cls") == "signal").withColumn("k", C("r") % 7).join(c, key).select(*ID, "coord_row")


@query("j31_apply_links", sql=f"WITH {LINKS} SELECT d.layout_id, d.row_id, CASE WHEN c.row_id IS NOT NULL THEN c.coord_text ELSE d.coord_text END AS coord_text, CASE WHEN c.row_id IS NOT NULL THEN c.coord_value ELSE d.coord_value END AS coord_value, CASE WHEN c.row_id IS NOT NULL THEN c.gi_gl ELSE d.gi_gl END AS gi_gl, c.row_id AS link_coord_row_id FROM det d LEFT JOIN ln ON d.layout_id = ln.layout_id AND d.row_id = ln.row_id LEFT JOIN det c ON c.layout_id = ln.layout_id AND c.row_id = ln.coord_row AND coalesce(c.coord_text, '') <> ''")
def j31(t):
    return O.apply_links(t.det, links(t)).select(*ID, "coord_text", "coord_value", "gi_gl", "link_coord_row_id")


@query("j36_propagate_links", "det corr_log", sql=f"""WITH {LINKS}, e AS (SELECT layout_id, row_id, max('9,' || lpad(new_value, 4, '0')) AS nt FROM corr_log WHERE column_name = 'coord_text' GROUP BY ALL),
d AS (SELECT det.*, coord_row FROM det LEFT JOIN ln ON det.layout_id = ln.layout_id AND det.row_id = ln.row_id),
up AS (SELECT d.layout_id, coord_row AS row_id, arg_max(nt, d.row_id) AS u FROM d JOIN e ON d.layout_id = e.layout_id AND d.row_id = e.row_id WHERE cls <> 'coordinate' AND coord_row IS NOT NULL GROUP BY ALL),
x AS (SELECT d.*, coalesce(e.nt, CASE WHEN cls <> 'coordinate' THEN dn.nt END, CASE WHEN cls = 'coordinate' THEN u END) AS z FROM d LEFT JOIN e ON d.layout_id = e.layout_id AND d.row_id = e.row_id LEFT JOIN e dn ON d.layout_id = dn.layout_id AND d.coord_row = dn.row_id LEFT JOIN up ON d.layout_id = up.layout_id AND d.row_id = up.row_id)
SELECT layout_id, row_id, coalesce(z, coord_text) AS coord_text, CASE WHEN z IS NOT NULL THEN {VALUE.format('z')} ELSE coord_value END AS coord_value FROM x""")
def j36(t):
    d = t.det.join(links(t).withColumnRenamed("coord_row", "link_coord_row_id"), ID, "left")
    e = t.corr_log.filter(C("column_name") == "coord_text").select(*ID, F.concat(F.lit("9,"), F.lpad("new_value", 4, "0")).alias("new_text"))
    return O.propagate_links(d, e).select(*ID, "coord_text", "coord_value")


@query("e1_state_at", "det corr_log", sql=f"""WITH l AS (SELECT layout_id, row_id, column_name, arg_max(new_value, struct_pack(a := created_at, b := corr_id)) AS v FROM corr_log WHERE created_at <= TIMESTAMP '2024-01-15 00:00:00' GROUP BY ALL),
w AS (SELECT layout_id, row_id, max(CASE WHEN column_name = 'anchor_text' THEN v END) AS a, max(CASE WHEN column_name = 'coord_text' THEN v END) AS c, max(CASE WHEN column_name = 'fahrtrichtung' THEN v END) AS f, max(CASE WHEN column_name = 'notes' THEN v END) AS n FROM l GROUP BY ALL)
SELECT d.layout_id, d.row_id, coalesce(a, anchor_text) AS anchor_text, coalesce(c, coord_text) AS coord_text, coalesce(f, fahrtrichtung) AS fahrtrichtung, coalesce(n, notes) AS notes, CASE WHEN c IS NOT NULL THEN {VALUE.format('c')} ELSE coord_value END AS coord_value FROM det d LEFT JOIN w ON d.layout_id = w.layout_id AND d.row_id = w.row_id""")
def e1(t):
    return O.state_at(t.det, t.corr_log, "2024-01-15 00:00:00").select(*ID, "anchor_text", "coord_text", "fahrtrichtung", "notes", "coord_value")
