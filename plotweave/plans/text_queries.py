"""Text functions over the element, reading and token views."""

from __future__ import annotations

from pyspark.sql import functions as F

from plotweave import rules as R
from plotweave.functions import text as T
from plotweave.operators import compare
from plotweave.operators import texts as X
from plotweave.plans.registry import query, sql_case, sql_list

C = F.col
ID = ["layout_id", "row_id"]
BASE = r"regexp_replace(replace(trim(coord_text), ' ', ''), '[a-zA-Z]$', '')"
COORD = r"^\s*([+-]?\d{1,3}[,.]\d{3,4})\s*(?:\(?(?:GI|Gl)\.?\s*([A-Za-z0-9./-]{1,6})\)?)?\s*$"
STRICT = r"^\s*([+-]?\d{1,3}[,.]\d{3,4})\s*(?:(?:GI|Gl)\.?\s*([A-Za-z0-9./-]{1,6}))?\s*$"

CLEAN = r"""fixed AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(coalesce(txt, ''), '^[QOqo]([,.])', '0\1'),
  '^-[QOqo]([,.])', '-0\1'), '([,.])[QOqo]([,.\d])', '\10\2', 'g') AS t FROM readings),
clean AS (SELECT layout_id, row_id, k, CASE
  WHEN regexp_extract(t, '-?\d+[.,]\d+\([A-Za-z0-9.,]+') <> '' THEN concat(replace(regexp_extract(t, '-?\d+[.,]\d+\([A-Za-z0-9.,]+'), ',', '.'), ')')
  ELSE replace(regexp_extract(t, '(-?\d+[.,]\d+)(?:\s|$|[^0-9.,])', 1), ',', '.') END AS c FROM fixed)"""
TXT = "coalesce(txt, '')"
DIG = r"length(regexp_replace({0}, '[^0-9]', '', 'g'))"
BRACK = r"trim(regexp_replace(regexp_replace(regexp_replace(replace({0}, ',', '.'), '[Gg][Ii1l]\.?', 'Gl.', 'g'), '\(\s+', '(', 'g'), '\s+\)', ')', 'g'))"
LOOKS = r"(regexp_matches({0}, '^[0-9-]') AND regexp_matches({0}, '[0-9]') AND contains({0}, '.') AND contains({0}, '(') = contains({0}, ')'))"


def _d(x: str) -> str:
    return DIG.format(x)


def _score(x: str) -> str:
    main, inner = f"trim(split_part({x}, '(', 1))", f"trim(split_part(split_part({x}, '(', 2), ')', 1))"
    return f"""CASE WHEN {x} = '' THEN -1.0 WHEN NOT {LOOKS.format(x)} THEN 0.0
      WHEN contains({x}, '(') THEN CASE WHEN {_d(main)} >= 1 AND contains({main}, '.') THEN 1.0 + {_d(main)} * 0.1 ELSE 0 END
        + CASE WHEN contains({inner}, 'Gl.') OR contains({inner}, 'gl.') THEN 0.5 ELSE 0 END + {_d(inner)} * 0.05
      WHEN {_d(x)} < 1 THEN 0.0
      ELSE 1.0 + {_d(x)} * 0.1 + CASE WHEN contains({x}, '.') OR contains({x}, ',') THEN 0.3 ELSE 0 END END"""


@query("f1_parse_coordinate", sql=f"""
SELECT layout_id, row_id,
  TRY_CAST(replace(nullif(regexp_extract({BASE}, '{COORD}', 1), ''), ',', '.') AS DOUBLE) AS km,
  nullif(regexp_extract({BASE}, '{COORD}', 2), '') AS track,
  TRY_CAST(replace(nullif(regexp_extract({BASE}, '{STRICT}', 1), ''), ',', '.') AS DOUBLE) AS km_strict
FROM det""")
def f1(t):
    c = C("coord_text")
    return t.det.select(*ID, T.coord_value(c).alias("km"), T.coord_track(c).alias("track"),
                        T.coord_value(c, strict=True).alias("km_strict"))


@query("f2_clean_coordinate", "readings", sql=f"WITH {CLEAN} SELECT layout_id, row_id, k, c AS clean FROM clean")
def f2(t):
    return t.readings.select(*ID, "k", T.clean_coord(C("txt")).alias("clean"))


@query("f3_fix_brackets", "readings", sql=f"SELECT layout_id, row_id, k, {BRACK.format(TXT)} AS fixed FROM readings")
def f3(t):
    return t.readings.select(*ID, "k", T.fix_brackets(C("txt")).alias("fixed"))


@query("f4_looks_like_coordinate", "readings", sql=f"SELECT layout_id, row_id, k, {LOOKS.format(TXT)} AS ok FROM readings")
def f4(t):
    return t.readings.select(*ID, "k", T.looks_like_coord(C("txt")).alias("ok"))


@query("f5_best_reading", "readings", sql=f"""WITH {CLEAN},
s AS (SELECT layout_id, row_id, k, {BRACK.format('c')} AS b FROM clean),
r AS (SELECT *, {_score('b')} AS score FROM s)
SELECT layout_id, row_id, b AS coord_text, CAST(score AS DOUBLE) AS score FROM (SELECT *, row_number() OVER (PARTITION BY layout_id, row_id ORDER BY round(score, 9) DESC, k) AS n FROM r) WHERE n = 1""")
def f5(t):
    return X.best_reading(t.readings, ID)


ALNUM = "trim(regexp_replace(regexp_replace(upper({0}), '[^\\p{{L}}\\p{{N}} ]', '', 'g'), '\\s+', ' ', 'g'))"
HT = "^([A-ZÄÖÜ]{1,4})\\s*([A-Z0-9]{1,4})$"


@query("f6_signal_id", sql=f"""
SELECT layout_id, row_id, regexp_matches(a, '^[A-ZÄÖÜ]{{1,4}}\\s*\\d{{1,4}}$') AS strict,
  CASE WHEN regexp_matches(a, '{HT}') THEN concat(regexp_extract(a, '{HT}', 1), translate(regexp_extract(a, '{HT}', 2), 'OILSBZGQD', '011582600')) ELSE a END AS fixed
FROM (SELECT *, {ALNUM.format('anchor_text')} AS a FROM det WHERE cls = 'signal')""")
def f6(t):
    a = C("anchor_text")
    return t.det.filter(C("cls") == "signal").select(*ID, T.is_strict_signal(a).alias("strict"), T.fix_signal_digits(a).alias("fixed"))


NAME = f"""CASE WHEN s = '' OR length(s) > 18 THEN -1.0 WHEN regexp_matches(replace(s, ' ', ''), '{STRICT}') THEN -1.0
  WHEN regexp_matches(s, '^\\d+$') THEN -1.0 WHEN regexp_matches(s, '^[-_/().]+$') THEN -1.0
  ELSE CASE WHEN regexp_matches(s, '\\p{{L}}') THEN 1.0 ELSE 0 END + CASE WHEN regexp_matches(s, '\\d') THEN 0.7 ELSE 0 END
    + 0.4 * length(regexp_replace(s, '\\P{{Lu}}', '', 'g')) / greatest(1, length(regexp_replace(s, '\\P{{L}}', '', 'g')))
    + greatest(0, 6 - abs(length(s) - 5)) * 0.1 + 0.6 * tconf
    + CASE WHEN regexp_matches(s, '(?i)^[A-ZÄÖÜ]{{1,4}}\\d{{1,4}}$') THEN 1.2 ELSE 0 END END"""


@query("f7_name_score", "tokens", sql=f"SELECT layout_id, row_id, token_id, round({NAME}, 6) AS score FROM (SELECT *, trim(txt) AS s FROM tokens)")
def f7(t):
    return t.tokens.select(*ID, "token_id", F.round(T.name_score(C("txt"), C("tconf"), F.lit("signal")), 6).alias("score"))


@query("f8_join_tokens", "tokens", sql=f"""
WITH o AS (SELECT *, row_number() OVER (PARTITION BY layout_id, row_id ORDER BY tx, token_id) AS i FROM tokens WHERE trim(txt) <> ''),
runs AS (SELECT a.layout_id, a.row_id, a.i, b.i - a.i AS d, any_value(a.cx) AS cx, any_value(a.cy) AS cy, any_value(a.w) AS w,
  {ALNUM.format("string_agg(trim(c.txt), ' ' ORDER BY c.i)")} AS text, sum(c.tconf) AS sc, avg(c.tx) AS mx, avg(c.ty) AS my
  FROM o a JOIN o b ON a.layout_id = b.layout_id AND a.row_id = b.row_id AND b.i BETWEEN a.i AND a.i + 3
  JOIN o c ON a.layout_id = c.layout_id AND a.row_id = c.row_id AND c.i BETWEEN a.i AND b.i GROUP BY ALL),
s AS (SELECT *, sc + 0.2 * (4 - d) - 0.1 * sqrt((mx - cx) * (mx - cx) + (my - cy) * (my - cy)) / w AS score FROM runs WHERE regexp_matches(text, '^[A-ZÄÖÜ]{{1,4}}\\s*\\d{{1,4}}$'))
SELECT layout_id, row_id, replace(text, ' ', '') AS text, round(score, 6) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY layout_id, row_id ORDER BY score DESC, i, d) AS n FROM s) WHERE n = 1""")
def f8(t):
    return X.join_tokens(t.tokens, ID).withColumn("score", F.round("score", 6))


@query("f7_best_name", "tokens", sql=f"""
SELECT layout_id, row_id, txt AS text, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY layout_id, row_id ORDER BY score DESC, token_id) AS n
FROM (SELECT *, {NAME} AS score FROM (SELECT *, trim(txt) AS s FROM tokens)) WHERE score >= 0) WHERE n = 1""")
def f7b(t):
    return X.best_name(t.tokens, ID, F.lit("signal")).withColumn("score", F.round("score", 6))


BLOCK = "concat(anchor_text, chr(10), 'WA  ', replace(coord_text, '0', 'O'), chr(10), ' ', chr(10), 'WB Q,', CAST(r % 1000 AS STRING))"


@query("f9_switch_block", sql=f"""
SELECT layout_id, row_id, trim(coalesce(anchor_text, '')) AS block_id,
  concat(CASE WHEN coord_text IS NULL THEN 'WA' WHEN coord_text LIKE '%,%' THEN concat('WA  ', coord_text) WHEN coord_text LIKE '%(%'
    THEN concat('WA  ', split_part(coord_text, '(', 1), '(Gl.112)') ELSE concat('WA  ', coord_text) END, ' | ', 'WB 0,', CAST(r % 1000 AS STRING)) AS coords
FROM det""")
def f9(t):
    d = t.det
    block = F.concat(F.coalesce("anchor_text", F.lit("")), F.lit("\nWA  "), F.replace(F.coalesce("coord_text", F.lit("")), F.lit("0"), F.lit("O")), F.lit("\n \nWB Q,"),
                     (C("r") % 1000).cast("string"))
    return d.select(*ID, T.block_id(block).alias("block_id"), F.array_join(T.block_coords(block), " | ").alias("coords"))


@query("f17_text_pattern", "sym", sql="""
SELECT layout_id, row_id, coalesce(anchor_text, '') = '' OR regexp_matches(anchor_text, CASE cls WHEN 'raute' THEN '^\\d+$' WHEN 'dreieck' THEN '^[A-ZÄÖÜ]{1,2}\\d{1,3}$' ELSE '^(?:[ABN].*)' END) AS fits,
  regexp_matches(translate(anchor_text, 'OISBZ', '01582'), '^\\d+$') AS fixable FROM sym""")
def f17(t):
    pattern = F.when(C("cls") == "raute", "Nur Zahlen").when(C("cls") == "dreieck", "Signal-ID").otherwise("[ABN].*")
    return t.sym.select(*ID, T.fits_pattern(C("anchor_text"), pattern).alias("fits"),
                        T.digits_fix(C("anchor_text")).rlike(r"^\d+$").alias("fixable"))


NORM = "nullif(lower(regexp_replace(trim({0}), '\\s+', ' ', 'g')), '')"
FP = f"""concat_ws('|', 'plan', cls, CAST(page AS STRING), CAST(CAST(round_even(cx / 10, 0) * 10 AS BIGINT) AS STRING), CAST(CAST(round_even(cy / 10, 0) * 10 AS BIGINT) AS STRING),
  {NORM.format('anchor_text')}, {NORM.format('coord_text')},
  CASE WHEN coalesce(trim(anchor_text), '') = '' AND coalesce(trim(coord_text), '') = '' AND (w > 0 OR h > 0) THEN concat('size:', CAST(round_even(w, 1) AS STRING), 'x', CAST(round_even(h, 1) AS STRING)) END,
  CASE WHEN coalesce(trim(anchor_text), '') = '' AND coalesce(trim(coord_text), '') = '' AND angle <> 0 THEN concat('angle:', CAST(round_even(angle, 1) AS STRING)) END)"""


@query("f19_detection_id", sql=f"""
SELECT layout_id, row_id, concat(substr(h, 1, 8), '-', substr(h, 9, 4), '-', substr(h, 13, 4), '-', substr(h, 17, 4), '-', substr(h, 21, 12)) AS detection_id
FROM (SELECT layout_id, row_id, sha256({FP}) AS h FROM (SELECT * REPLACE (CASE WHEN r % 3 = 0 THEN '' ELSE anchor_text END AS anchor_text, CASE WHEN r % 3 = 0 THEN NULL ELSE coord_text END AS coord_text) FROM det))""")
def f19(t):
    d = t.det.withColumns({"anchor_text": F.when(C("r") % 3 == 0, "").otherwise(C("anchor_text")),
                           "coord_text": F.when(C("r") % 3 != 0, C("coord_text"))})
    i = T.detection_id(C("cls"), C("page"), C("cx"), C("cy"), C("w"), C("h"), C("angle"), C("anchor_text"), C("coord_text"), F.lit("plan"))
    return d.select(*ID, i.alias("detection_id"))


PATH = "concat('/plans/SgSl', CAST(o_custkey AS STRING), CASE o_orderkey % 6 WHEN 0 THEN '_D_001.pdf' WHEN 1 THEN '_v2.PDF' WHEN 2 THEN '_rev3.pdf' WHEN 3 THEN '_version4.pdf' WHEN 4 THEN '_0001' ELSE '_plan.pdf' END)"


@query("f20_base_name", "orders", sql=f"""
SELECT o_orderkey, CASE WHEN regexp_matches(n, '(?i)_[A-Z]_\\d{{3,4}}$') THEN regexp_replace(n, '(?i)_[A-Z]_\\d{{3,4}}$', '')
  WHEN regexp_matches(n, '(?i)_v\\d+$') THEN regexp_replace(n, '(?i)_v\\d+$', '') WHEN regexp_matches(n, '(?i)_rev\\d+$') THEN regexp_replace(n, '(?i)_rev\\d+$', '')
  WHEN regexp_matches(n, '(?i)_version\\d+$') THEN regexp_replace(n, '(?i)_version\\d+$', '') WHEN regexp_matches(n, '_\\d{{3,4}}$') THEN regexp_replace(n, '_\\d{{3,4}}$', '') ELSE n END AS base
FROM (SELECT o_orderkey, regexp_replace(split_part({PATH}, '/', 3), '(?i)\\.pdf$', '') AS n FROM orders)""")
def f20(t):
    return t.orders.withColumn("p", F.expr(PATH)).select("o_orderkey", T.base_name(C("p")).alias("base"))


@query("f21_bracket_name", sql="SELECT layout_id, row_id, nullif(trim(regexp_extract(name_text, '\\(([^)]+)\\)\\s*$', 1)), '') AS signal_name FROM det WHERE cls = 'haltepunkt'")
def f21(t):
    return t.det.filter(C("cls") == "haltepunkt").select(*ID, F.nullif(T.bracket_name(C("name_text")), F.lit("")).alias("signal_name"))


GEN = """(regexp_matches(lower(trim(n)), concat('^', lower(cls), '\\s*\\d+$')) OR regexp_matches(lower(trim(n)), concat('^', replace(lower(cls), '_', ' '), '\\s*\\d+$')) OR regexp_matches(lower(trim(n)), concat('^', replace(lower(cls), '_', ''), '\\s*\\d+$'))
  OR (cls = 'gm_block' AND lower(trim(n)) = 'gm') OR (cls = 'prellbock' AND lower(trim(n)) = 'pb') OR (cls = 'haltepunkt' AND regexp_matches(lower(trim(n)), '^haltepunkt\\s*\\d+(\\s*\\([^)]+\\))?$')))"""
GEN_NAME = "CASE r % 5 WHEN 0 THEN concat(replace(cls, '_', ' '), ' ', CAST(r % 30 AS STRING)) WHEN 1 THEN concat(upper(replace(cls, '_', '')), CAST(r % 30 AS STRING)) WHEN 2 THEN CASE cls WHEN 'gm_block' THEN 'gm' ELSE 'PB' END ELSE name_text END"


@query("f22_generated_name", sql=f"SELECT layout_id, row_id, coalesce({GEN}, FALSE) AS generated FROM (SELECT *, {GEN_NAME} AS n FROM det)")
def f22(t):
    return t.det.withColumn("n", F.expr(GEN_NAME)).select(*ID, T.is_generated(C("n"), C("cls")).alias("generated"))


@query("f23_word_diff", sql="""
WITH p AS (SELECT layout_id, row_id, regexp_extract_all(name_text, '\\w+') AS a, regexp_extract_all(replace(concat(anchor_text, ' ', coalesce(coord_text, '')), 'O', '0'), '\\w+') AS b FROM det),
u AS (SELECT layout_id, row_id, i, a[i + 1] AS old, b[i + 1] AS new FROM (SELECT *, unnest(range(0, greatest(len(a), len(b)))) AS i FROM p))
SELECT layout_id, row_id, CAST(i AS INT) AS position, old, new FROM u WHERE old IS DISTINCT FROM new""")
def f23(t):
    new = F.replace(F.concat(C("anchor_text"), F.lit(" "), F.coalesce("coord_text", F.lit(""))), F.lit("O"), F.lit("0"))
    return t.det.select(*ID, F.inline(T.word_changes(C("name_text"), new)))


@query("f24_text_similarity")
def f24(t):
    # all pairs of different names of one plan that are alike
    p = compare.similar_names(t.det, t.det, 0.75).filter(C("a_name") < C("b_name"))
    return p.select("layout_id", C("a_name").alias("a"), C("b_name").alias("b"), F.round("ratio", 6).alias("ratio"))


@query("f25_coordinate_equal", "det det2", sql="""
SELECT a.layout_id, a.row_id, CASE WHEN a.v IS NULL OR b.v IS NULL THEN a.v IS NULL AND b.v IS NULL ELSE abs(a.v - b.v) < 0.0001 END AS equal,
  coalesce(trim(a.anchor_text), '') = '' AS empty_old
FROM (SELECT *, CASE WHEN r % 3 > 0 THEN coord_value END AS v FROM det) a JOIN (SELECT *, CASE WHEN r % 6 > 0 THEN coord_value END AS v FROM det2) b ON a.row_id = b.row_id""")
def f25(t):
    a = t.det.select(*ID, F.when(C("r") % 3 > 0, C("coord_value")).alias("va"), (~T.filled(C("anchor_text"))).alias("empty_old"))
    b = t.det2.select("row_id", F.when(C("r") % 6 > 0, C("coord_value")).alias("vb"))
    return a.join(b, "row_id").select(*ID, T.same_km(C("va"), C("vb")).alias("equal"), "empty_old")


@query("f27_number_format", "det det2", sql="""
SELECT a.layout_id, a.row_id, printf('%.4f', a.coord_value) AS old_km,
  concat(printf('%.4f', b.coord_value), CASE WHEN round(b.coord_value - a.coord_value, 4) > 0 THEN printf(' (+%.1fm)', round((b.coord_value - a.coord_value) * 1000, 4)) ELSE printf(' (%.1fm)', round((b.coord_value - a.coord_value) * 1000, 4)) END) AS new_km
FROM det a JOIN det2 b ON a.row_id = b.row_id""")
def f27(t):
    a = t.det.select(*ID, C("coord_value").alias("a"))
    b = t.det2.select("row_id", C("coord_value").alias("b"))
    delta = F.round((C("b") - C("a")) * 1000, 4)
    return a.join(b, "row_id").select(*ID, T.km_text(C("a")).alias("old_km"), F.concat(T.km_text(C("b")), T.metres_text(delta)).alias("new_km"))


@query("f28_json_columns", "events", sql="""
SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, concat('{"id":', event_id, ',"type":"', event_type, '"}') AS packed FROM events""")
def f28(t):
    k = F.from_json("props", "k BIGINT")["k"]
    return t.events.select("event_id", k.alias("k"), F.to_json(F.struct(C("event_id").alias("id"), C("event_type").alias("type"))).alias("packed"))


@query("f_normalise_text", sql=f"""
SELECT layout_id, row_id, c AS coord_clean, TRY_CAST(nullif(regexp_extract(c, '{COORD}', 1), '') AS DOUBLE) AS coord_km, nullif(regexp_extract(c, '{COORD}', 2), '') AS coord_track, name_clean
FROM (SELECT *, CASE WHEN cls = 'signal' THEN CASE WHEN regexp_matches(a, '{HT}') THEN concat(regexp_extract(a, '{HT}', 1), translate(regexp_extract(a, '{HT}', 2), 'OILSBZGQD', '011582600')) ELSE a END
    ELSE regexp_replace(trim(anchor_text), '\\s+', ' ', 'g') END AS name_clean,
  replace(CASE WHEN coord_text LIKE '%(%' THEN coord_text ELSE coalesce(coord_text, '') END, ',', '.') AS c FROM (SELECT *, {ALNUM.format('anchor_text')} AS a FROM det))""")
def f_normalise(t):
    return X.normalise_text(t.det).select(*ID, "coord_clean", "coord_km", "coord_track", "name_clean")


@query("p24_finish_rows", sql=f"""
SELECT layout_id, row_id, CASE WHEN cls = 'gm_block' THEN 'GM' WHEN cls = 'prellbock' THEN 'PB' WHEN cls IN {sql_list(R.GENERATED_NAME)} THEN '' ELSE upper(trim(anchor_text)) END AS anchor_text,
  regexp_replace(trim(coord_text), '\\s+', ' ', 'g') AS coord_text, round(conf, 3) AS conf
FROM det""")
def p24(t):
    return X.finish_rows(t.det).select(*ID, "anchor_text", "coord_text", "conf")
