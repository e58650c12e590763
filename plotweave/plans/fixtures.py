"""Views over the given tables, shaped like the element tables the operators expect.

Every view is one SQL text that Spark and the checking database both understand. Each further 150,000 orders open 50
further plans, and there are four corrections for every sixth row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plotweave.session import scratch

VIEWS: dict[str, tuple[list[str], str]] = {}


def _view(name: str, needs: list[str], sql: str) -> None:
    VIEWS[name] = (needs, sql)


_view("det", ["orders"], """
SELECT t.*, cx - w / 2.0 AS x1, cy - h / 2.0 AS y1, cx + w / 2.0 AS x2, cy + h / 2.0 AS y2,
  CASE WHEN (r + ck) % 13 < 10 AND r % 11 <> 0 THEN cx + CAST((r * 3) % 241 AS DOUBLE) - 120.0 END AS lx,
  CASE WHEN (r + ck) % 13 < 10 AND r % 11 <> 0 THEN cy + CAST((r * 5) % 181 AS DOUBLE) - 60.0 END AS ly,
  CASE WHEN cls = 'haltepunkt' THEN concat('haltepunkt ', CAST(r % 9 AS STRING), ' (', trim(anchor_text), ')') ELSE anchor_text END AS name_text,
  CASE WHEN fahrtrichtung IS NULL THEN 'none' WHEN r % 5 = 0 THEN 'gks' WHEN r % 5 = 1 THEN 'track' WHEN r % 5 = 2 THEN 'gks_relaxed' ELSE 'gks_nearest' END AS direction_source
FROM (
  SELECT o_orderkey AS row_id, o_orderkey % 50 + 50 * CAST(floor(o_orderkey / 150000) AS BIGINT) AS layout_id, CAST(r % 3 + 1 AS INT) AS page, r, ck,
    CASE (r + ck) % 13 WHEN 0 THEN 'signal' WHEN 1 THEN 'gks_gesteuert' WHEN 2 THEN 'gks_festkodiert' WHEN 3 THEN 'gm_block'
      WHEN 4 THEN 'isolierstoss' WHEN 5 THEN 'prellbock' WHEN 6 THEN 'haltepunkt' WHEN 7 THEN 'sverbinder' WHEN 8 THEN 'haltetafel'
      WHEN 9 THEN 'weichenende' ELSE 'coordinate' END AS cls,
    CAST((r * 37) % 100 AS DOUBLE) / 100.0 AS conf,
    CAST((r * 7) % 2003 AS DOUBLE) AS cx, CAST((r * 13 + ck * 101) % 1201 AS DOUBLE) AS cy,
    CAST(20 + r % 61 AS DOUBLE) AS w, CAST(16 + ck % 41 AS DOUBLE) AS h,
    CASE r % 5 WHEN 0 THEN CAST(30 AS DOUBLE) WHEN 1 THEN CAST(90 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS angle,
    CASE WHEN r % 11 = 0 THEN NULL ELSE concat(CAST(r % 20 AS STRING), CASE WHEN r % 9 = 0 THEN '.' ELSE ',' END,
      lpad(CAST(r % 10000 AS STRING), 4, '0'), CASE WHEN r % 31 = 0 THEN '(Gl.112)' ELSE '' END) END AS coord_text,
    CAST(r % 20 AS DOUBLE) + CAST(r % 10000 AS DOUBLE) / 10000.0 AS coord_value,
    CASE WHEN r % 31 = 0 THEN '112' END AS gi_gl,
    concat(CASE WHEN r % 17 = 0 THEN '' WHEN r % 29 = 0 THEN 'a' ELSE substr('ABNPSUVW', CAST(1 + r % 8 AS INT), 1) END,
      CASE WHEN r % 7 = 0 THEN 'O' ELSE '' END, CASE WHEN r % 23 = 0 THEN '  ' ELSE '' END, CAST(100 + r % 40 AS STRING)) AS anchor_text,
    CASE r % 4 WHEN 0 THEN 'A' WHEN 1 THEN 'B' WHEN 2 THEN 'b' ELSE NULL END AS fahrtrichtung,
    CASE WHEN r % 6 = 0 THEN 'geprueft' WHEN r % 6 = 1 THEN '' END AS notes,
    r % 41 = 0 AS hidden
  FROM (SELECT o_orderkey, o_custkey AS ck, CAST(round(o_totalprice * 100) AS BIGINT) AS r FROM orders) o
) t
""")

# the next version of every plan
_view("det2", ["det"], """
SELECT CASE WHEN r % 19 = 0 THEN row_id + 1000000 ELSE row_id END AS row_id, layout_id, page, r, ck, cls, conf,
  CASE WHEN r % 5 = 0 THEN cx + 15 ELSE cx END AS cx, cy, w, h, angle, coord_text,
  CASE WHEN r % 13 = 0 THEN coord_value + 0.012 WHEN r % 14 = 0 THEN coord_value + 0.03 ELSE coord_value END AS coord_value,
  gi_gl, anchor_text, CASE WHEN r % 37 = 0 THEN 'A' ELSE fahrtrichtung END AS fahrtrichtung, notes, hidden,
  CASE WHEN r % 5 = 0 THEN x1 + 15 ELSE x1 END AS x1, y1, CASE WHEN r % 5 = 0 THEN x2 + 15 ELSE x2 END AS x2, y2,
  lx, ly, name_text, direction_source
FROM det WHERE r % 16 <> 0
""")

_view("corr", ["events"], """
SELECT event_id AS corr_id, user_id % 50 + 50 * CAST(floor(event_id / 100000) AS BIGINT) AS layout_id,
  CAST(floor(event_id / 4) AS BIGINT) * 6 + CAST(floor(event_id / 4) AS BIGINT) % 6 AS row_id,
  CASE event_type WHEN 'click' THEN 'anchor_text' WHEN 'signup' THEN 'coord_text' WHEN 'error' THEN 'fahrtrichtung' ELSE 'notes' END AS column_name,
  event_type AS correction_type, CAST(CAST(round(value * 100) AS BIGINT) AS STRING) AS new_value, ts AS created_at
FROM events
""")

# correction log entries that belong to a row of their plan
_view("corr_log", ["corr"], """
SELECT corr_id, row_id % 50 + 50 * CAST(floor(row_id / 150000) AS BIGINT) AS layout_id, row_id, column_name, correction_type, new_value, created_at FROM corr
""")

_view("px", ["lineitem"], """
SELECT DISTINCT l_suppkey % 50 + 50 * CAST(floor(l_orderkey / 150000) AS BIGINT) AS layout_id, CAST(l_linenumber % 3 + 1 AS INT) AS page,
  150 + 300 * (l_partkey % 4) AS y, (l_orderkey * 13) % 2003 AS x
FROM lineitem
""")

_view("sheets", ["det"], """
SELECT layout_id, page, CAST(2003 AS INT) AS width, CAST(1201 AS INT) AS height FROM det GROUP BY layout_id, page
""")

# tile-local detections: every detection is seen by the tile it lies in and by the one before
_view("raw", ["det"], """
SELECT layout_id, page, row_id, cls, conf, tile_x, tile_y, x1 - tile_x * 307 AS lx1, y1 - tile_y * 307 AS ly1,
  x2 - tile_x * 307 AS lx2, y2 - tile_y * 307 AS ly2, w, h, angle
FROM (
  SELECT d.*, greatest(0, CAST(floor(cx / 307.0) AS INT) - k) AS tile_x, greatest(0, CAST(floor(cy / 307.0) AS INT) - k) AS tile_y
  FROM det d CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 AS k) s
) q
""")

# rows whose class is a user-defined symbol
_view("sym", ["det"], """
SELECT row_id, layout_id, page, r, conf, cx, cy, w, h, angle, coord_text, CASE WHEN r % 7 = 3 THEN NULL ELSE coord_value END AS coord_value,
  CASE WHEN r % 13 = 5 THEN '' ELSE anchor_text END AS anchor_text,
  CASE cls WHEN 'haltetafel' THEN 'raute' WHEN 'weichenende' THEN 'dreieck' ELSE 'kreuz' END AS cls,
  CAST((r * 11) % 160 AS DOUBLE) AS link_distance, x1, y1, x2, y2
FROM det WHERE cls IN ('haltetafel', 'weichenende', 'prellbock')
""")

# recognised tokens around signals
_view("tokens", ["det"], """
SELECT layout_id, row_id, k AS token_id, cx, cy, w,
  cx + CAST((k - 2) * 18 AS DOUBLE) AS tx, cy + CAST(r % 9 AS DOUBLE) AS ty,
  CASE k WHEN 0 THEN '-' WHEN 1 THEN substr(anchor_text, 1, 1) WHEN 2 THEN substr(anchor_text, 2) ELSE CASE WHEN r % 3 = 0 THEN '7' ELSE 'xx' END END AS txt,
  CAST((r + k * 17) % 100 AS DOUBLE) / 100.0 AS tconf
FROM det CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) s
WHERE cls = 'signal'
""")

# several readings of one coordinate
_view("readings", ["det"], """
SELECT layout_id, row_id, k, CASE k WHEN 0 THEN coord_text
  WHEN 1 THEN 'Q' || substr(coord_text, 2) || ' x'
  WHEN 2 THEN '-' || replace(coord_text, ',', '.')
  WHEN 3 THEN 'ab ' || replace(coord_text, ',', '.') || '(GI.11 z'
  ELSE replace(coord_text, '0', 'O') END AS txt
FROM det CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) s
WHERE cls = 'coordinate'
""")

# text-region adjustments, from the event stream
_view("adjust", ["events"], """
SELECT event_id AS adjust_id, event_type AS cls, CAST(user_id % 21 AS INT) - 10 AS offset_x, CAST(event_id % 15 AS INT) - 7 AS offset_y,
  CAST(user_id % 9 AS INT) AS width_delta, CAST(event_id % 6 AS INT) - 3 AS height_delta, ts AS created_at
FROM events
""")


# column to spread a table on that comes in fewer splits than there are cores
SPREAD = {"orders": "o_orderkey", "events": "event_id", "lineitem": "l_orderkey"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. One small file is one task for everything up to the first shuffle, so it is spread."""
    d = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if name in SPREAD and d.rdd.getNumPartitions() < cores:
        d = d.repartition(cores, SPREAD[name])
    return d


# views that stand for stored tables: written once per session, read like any other table
STORED = ("det", "det2", "px")
_written: dict[tuple[str, str, str], str] = {}


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame; tables are read where they are needed."""
    if name not in VIEWS:
        return table(spark, sf_dir, name)
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _written:
        needs, sql = VIEWS[name]
        frames = {n: frame(spark, sf_dir, n) for n in needs}
        for n in needs:
            sql = sql.replace(f"FROM {n}", "FROM {" + n + "}")
        view = spark.sql(sql, **frames)
        if name not in STORED:
            return view
        path = scratch(spark, name)
        view.write.parquet(path)
        _written[key] = path
    return spark.read.parquet(_written[key])


def oracle(sql: str, *views: str) -> str:
    """``sql`` with the views it reads in front of it."""
    seen: list[str] = []

    def add(name: str) -> None:
        if name in VIEWS and name not in seen:
            for n in VIEWS[name][0]:
                add(n)
            seen.append(name)

    for v in views:
        add(v)
    ctes = ",\n".join(f"{n} AS ({VIEWS[n][1].strip()})" for n in seen)
    body = sql.strip()
    if not ctes:
        return body
    for head in ("WITH RECURSIVE ", "WITH "):
        if body.startswith(head):
            return f"{head}{ctes},\n{body[len(head):]}"
    return f"WITH {ctes}\n{body}"
