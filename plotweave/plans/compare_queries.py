"""Version comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from plotweave import rules as R
from plotweave.functions import scoring as S
from plotweave.functions import text as T
from plotweave.operators import compare as X
from plotweave.plans.registry import query
from plotweave.plans.text_queries import FP, GEN

C = F.col
KEEP = "cls NOT IN ('coordinate', 'weichen_block') AND NOT hidden"
FPS = FP.replace("'plan', ", "")


def with_id(d):
    i = T.detection_id(C("cls"), C("page"), C("cx"), C("cy"), C("w"), C("h"), C("angle"), C("anchor_text"), C("coord_text"))
    return d.withColumn("detection_id", i)


def by_row(d):
    """Versions keyed on their row id."""
    return d.withColumn("detection_id", C("row_id").cast("string"))


def both(t, key=with_id):
    return X.elements(key(t.det)), X.elements(key(t.det2))


def _uuid(h):
    return f"concat(substr({h}, 1, 8), '-', substr({h}, 9, 4), '-', substr({h}, 13, 4), '-', substr({h}, 17, 4), '-', substr({h}, 21, 12))"


IDS = f"""o AS (SELECT layout_id, {_uuid('hh')} AS id FROM (SELECT *, sha256({FPS}) AS hh FROM det WHERE {KEEP}) GROUP BY ALL), n AS (SELECT layout_id, {_uuid('hh')} AS id FROM (SELECT *, sha256({FPS}) AS hh FROM det2 WHERE {KEEP}) GROUP BY ALL)"""


@query("j24_match_ids", "det det2", sql=f"WITH {IDS} SELECT o.layout_id, o.id AS old_id, n.id AS new_id FROM o JOIN n ON o.layout_id = n.layout_id AND o.id = n.id")
def j24(t):
    return X.match_ids(*both(t))


@query("u3_common_ids", "det det2", sql=f"WITH {IDS} SELECT * FROM o INTERSECT SELECT * FROM n")
def u3(t):
    a, b = both(t)
    return a.select("layout_id", C("detection_id").alias("id")).intersect(b.select("layout_id", C("detection_id").alias("id")))


@query("j27_added_deleted", "det det2", sql=f"""WITH {IDS} SELECT layout_id, id, 'deleted' AS change_type FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.layout_id = o.layout_id AND n.id = o.id)
UNION ALL SELECT layout_id, id, 'added' FROM n WHERE NOT EXISTS (SELECT 1 FROM o WHERE n.layout_id = o.layout_id AND n.id = o.id)""")
def j27(t):
    a, b = both(t)
    m = X.match_ids(a, b)

    def lone(d, side, name):
        return X.unmatched(d, m, side).select("layout_id", C("detection_id").alias("id"), F.lit(name).alias("change_type"))

    return lone(a, "old_id", "deleted").unionByName(lone(b, "new_id", "added"))


def _tiers(v, steps, rest):
    return "CASE " + " ".join(f"WHEN {v} < {a} THEN {b}::DOUBLE" for a, b in steps) + f" ELSE {rest} END"


KM, PX = "abs(a.coord_value - b.coord_value)", "sqrt((a.cx - b.cx) * (a.cx - b.cx) + (a.cy - b.cy) * (a.cy - b.cy))"
BR = "nullif(trim(regexp_extract({0}.name_text, '\\(([^)]+)\\)\\s*$', 1)), '')"
GA, GB = (GEN.replace("trim(n)", f"trim({x}.name_text)").replace("lower(cls)", f"lower({x}.cls)").replace("(cls =", f"({x}.cls =") for x in "ab")
SCORE = f"""least(1.0, CASE WHEN a.cls IN ('signal', 'gks_festkodiert', 'gks_gesteuert') THEN CASE WHEN trim(a.name_text) = '' OR trim(b.name_text) = '' OR trim(a.name_text) <> trim(b.name_text) THEN 0.0::DOUBLE
    ELSE CASE a.cls WHEN 'signal' THEN 0.7::DOUBLE ELSE 0.6::DOUBLE END + {_tiers(KM, S.TEXT_KM, '0.0::DOUBLE')} + {_tiers(PX, S.TEXT_PX, '0.10::DOUBLE')} END
  WHEN a.cls = 'haltepunkt' AND {BR.format('a')} IS NOT NULL AND {BR.format('b')} IS NOT NULL THEN CASE WHEN {BR.format('a')} = {BR.format('b')} THEN 0.9::DOUBLE + {_tiers(PX, S.STOP_PX, '0.0::DOUBLE')} ELSE 0.0 END
  WHEN trim(a.name_text) <> '' AND trim(b.name_text) <> '' AND trim(a.name_text) <> trim(b.name_text) AND NOT ({GA} AND {GB}) THEN 0.0
  ELSE coalesce({_tiers(KM, S.SYMBOL_KM, 'NULL')} + {_tiers(PX, S.SYMBOL_PX, '0.0::DOUBLE')}, 0.0) END)"""


@query("j26_match_score", "det det2", sql=f"SELECT a.layout_id, a.row_id, round(CASE WHEN abs(a.page - b.page) > 1 OR a.cls <> b.cls THEN 0.0 ELSE {SCORE} END, 6) AS score FROM det a JOIN det2 b ON a.layout_id = b.layout_id AND a.r = b.r AND a.ck = b.ck")
def j26(t):
    def side(d, p):
        return d.select("layout_id", "r", "ck", *[C("name_text" if c == "anchor_text" else c).alias(p + c) for c in X.FIELDS])

    j = side(t.det, "a_").join(side(t.det2, "b_"), ["layout_id", "r", "ck"])
    ratio = F.when(T.text_or_empty(C("a_anchor_text")) == T.text_or_empty(C("b_anchor_text")), 1.0).otherwise(0.0)
    return j.select("layout_id", C("a_row_id").alias("row_id"), F.round(S.match_score(ratio), 6).alias("score"))


@query("j26_match_candidates")
def j26c(t):
    a, b = both(t)
    m = X.match_ids(a, b)
    return X.match_candidates(X.unmatched(a, m, "old_id"), X.unmatched(b, m, "new_id")).withColumn("score", F.round("score", 6))


@query("j25_match_optimal")
def j25(t):
    a, b = both(t)
    m = X.match_ids(a, b)
    return X.match_optimal(X.unmatched(a, m, "old_id"), X.unmatched(b, m, "new_id")).withColumn("score", F.round("score", 6))


TXT = "cls IN ('signal', 'gks_festkodiert', 'gks_gesteuert')"
PAIRS = f"""p AS (SELECT a.layout_id, a.row_id, a.cls, b.page, a.coord_value AS av, b.coord_value AS bv, a.anchor_text AS an, b.anchor_text AS bn, a.fahrtrichtung AS af, b.fahrtrichtung AS bf, b.cx - a.cx AS dx, b.cy - a.cy AS dy, a.coord_text AS act, b.coord_text AS bct
  FROM (SELECT * FROM det WHERE {KEEP}) a JOIN (SELECT * REPLACE (CASE WHEN r % 23 = 1 THEN 'Z9' ELSE anchor_text END AS anchor_text) FROM det2 WHERE {KEEP}) b ON a.layout_id = b.layout_id AND a.row_id = b.row_id),
q AS (SELECT *, abs(av - bv) >= 0.0001 AS moved, {TXT} AND trim(an) <> trim(bn) AS renamed, cls = 'signal' AND coalesce(af, '') <> coalesce(bf, '') AS turned, (bv - av) * 1000 AS dm, sqrt(dx * dx + dy * dy) AS px FROM p)"""


def versions(t):
    new = t.det2.withColumn("anchor_text", F.when(C("r") % 23 == 1, "Z9").otherwise(C("anchor_text")))
    return X.elements(by_row(t.det)), X.elements(by_row(new))


@query("c1_field_changes", "det det2", sql=f"WITH {PAIRS} SELECT layout_id, row_id, moved, renamed, turned, round(CASE WHEN moved THEN dm END, 4) AS delta_meters, round(CASE WHEN px >= 10 THEN px END, 6) AS moved_px, CAST(moved AS INT) + CAST(renamed AS INT) + CAST(turned AS INT) AS n_changes FROM q")
def c1(t):
    a, b = versions(t)
    p = X.change_columns(X.pairs_of(a, b, X.match_ids(a, b)))
    return p.select("layout_id", C("a_row_id").alias("row_id"), "moved", "renamed", "turned", F.round("delta_meters", 4).alias("delta_meters"),
                    F.round("moved_px", 6).alias("moved_px"), F.size("field_changes").alias("n_changes"))


@query("c2_change_severity", "det det2", sql=f"WITH {PAIRS} SELECT layout_id, row_id, CASE WHEN renamed OR (moved AND abs(dm) > 20) OR px > 100 THEN 'major' WHEN (moved AND abs(dm) > 5) OR turned OR px > 50 THEN 'moderate' ELSE 'minor' END AS severity FROM q")
def c2(t):
    a, b = versions(t)
    p = X.change_columns(X.pairs_of(a, b, X.match_ids(a, b)))
    return p.select("layout_id", C("a_row_id").alias("row_id"), S.change_severity(C("delta_meters"), C("renamed"), C("turned"), C("moved_px")).alias("severity"))


CHANGES = f"""{PAIRS}, ch AS (SELECT layout_id, row_id, cls AS element_class, page, CASE WHEN moved THEN 'moved' WHEN renamed OR turned THEN 'modified' ELSE 'unchanged' END AS change_type,
  CASE WHEN moved THEN CASE WHEN abs(dm) > 20 THEN 'major' WHEN abs(dm) > 5 THEN 'moderate' ELSE 'minor' END WHEN renamed THEN 'major' WHEN turned THEN 'moderate' ELSE 'minor' END AS severity, dm, av, bv, an, bn, act, bct, af, bf, renamed, turned FROM q
UNION ALL SELECT layout_id, row_id, cls, page, 'deleted', 'major', NULL, coord_value, NULL, anchor_text, NULL, coord_text, NULL, NULL, NULL, NULL, NULL FROM det d WHERE {KEEP} AND NOT EXISTS (SELECT 1 FROM det2 n WHERE n.layout_id = d.layout_id AND n.row_id = d.row_id AND NOT n.hidden)
UNION ALL SELECT layout_id, row_id, cls, page, 'added', 'major', NULL, NULL, coord_value, NULL, CASE WHEN r % 23 = 1 THEN 'Z9' ELSE anchor_text END, NULL, coord_text, NULL, NULL, NULL, NULL FROM det2 d WHERE {KEEP} AND NOT EXISTS (SELECT 1 FROM det n WHERE n.layout_id = d.layout_id AND n.row_id = d.row_id AND NOT n.hidden))"""


def changes(t, modified=True):
    a, b = versions(t)
    return X.classify(a, b, X.match_ids(a, b), modified)


@query("c3_classify_by_id", "det det2", sql=f"WITH {CHANGES} SELECT layout_id, row_id, element_class, page, change_type, severity FROM ch")
def c3(t):
    return changes(t).select("layout_id", F.coalesce("new.row_id", "old.row_id").alias("row_id"), "element_class", "page", "change_type", "severity")


@query("c3_full_compare")
def c3f(t):
    return X.compare(with_id(t.det), with_id(t.det2)).select("layout_id", "change_type", "severity", "element_class", "page", C("old.row_id").alias("old_row"), C("new.row_id").alias("new_row"), F.round("delta_meters", 4).alias("delta_meters"))


COUNTS = "count(*) FILTER (change_type = 'added') AS added, count(*) FILTER (change_type = 'deleted') AS deleted, count(*) FILTER (change_type = 'moved') AS moved, count(*) FILTER (change_type = 'unchanged') AS unchanged, " + ", ".join(
    f"count(*) FILTER (change_type = 'moved' AND severity = '{s}') AS moved_{s}" for s in ("major", "moderate", "minor"))


@query("a8_change_summary", "det det2", sql=f"""WITH {CHANGES} SELECT layout_id, 'total' AS level, NULL AS key, {COUNTS} FROM ch GROUP BY layout_id
UNION ALL SELECT layout_id, 'class', element_class, {COUNTS} FROM ch GROUP BY ALL HAVING count(*) FILTER (change_type IN ('added', 'deleted', 'moved')) > 0
UNION ALL SELECT layout_id, 'page', CAST(page AS STRING), {COUNTS} FROM ch GROUP BY ALL HAVING count(*) FILTER (change_type IN ('added', 'deleted', 'moved')) > 0""".replace("GROUP BY ALL HAVING", "GROUP BY 1, 2, 3 HAVING"))
def a8(t):
    return X.change_summary(changes(t))


NEWID, OLDID = "CASE WHEN coalesce(bn, '') <> '' THEN bn ELSE coalesce(bct, '') END", "CASE WHEN coalesce(an, '') <> '' THEN an ELSE coalesce(act, '') END"
OUT = "coalesce({0}, '') AS coordinate, CASE WHEN {1} IS NULL THEN '' ELSE printf('%.4f', {1}) END AS km, page"


@query("s15_comparison_tables", "det det2", sql=f"""WITH {CHANGES}
SELECT 'added' AS tbl, layout_id, element_class, {NEWID} AS identifier, 'added' AS change, '' AS old_value, coalesce(bn, '') AS new_value, {OUT.format('bct', 'bv')} FROM ch WHERE change_type = 'added'
UNION ALL SELECT 'deleted', layout_id, element_class, {OLDID}, 'deleted', coalesce(an, ''), '', {OUT.format('act', 'av')} FROM ch WHERE change_type = 'deleted'
UNION ALL SELECT 'moved', layout_id, element_class, {NEWID}, 'moved', printf('%.4f', av), concat(printf('%.4f', bv), CASE WHEN dm > 0 THEN printf(' (+%.1fm)', round(dm, 4)) ELSE printf(' (%.1fm)', round(dm, 4)) END), {OUT.format('bct', 'bv')} FROM ch WHERE change_type = 'moved'
UNION ALL SELECT 'modified', layout_id, element_class, {NEWID}, 'anchor_text changed', coalesce(an, ''), coalesce(bn, ''), {OUT.format('bct', 'bv')} FROM ch WHERE change_type = 'modified' AND renamed
UNION ALL SELECT 'modified', layout_id, element_class, {NEWID}, 'fahrtrichtung changed', coalesce(af, ''), coalesce(bf, ''), {OUT.format('bct', 'bv')} FROM ch WHERE change_type = 'modified' AND turned""")
def s15(t):
    tables = X.comparison_tables(changes(t))
    out = None
    for name in ("added", "deleted", "moved", "modified"):
        d = tables[name].withColumn("tbl", F.lit(name))
        out = d if out is None else out.unionByName(d)
    return out
