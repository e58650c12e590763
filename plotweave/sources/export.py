"""Exports. Documents that are one JSON value are written as ordered text lines by all tasks; the part
files in order form the document, so no group is ever collected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotweave.operators.filters import columns_for, filter_thresholds

C = F.col


def write_csv(df: DataFrame, path: str, sep: str = ";", header: bool = True) -> None:
    df.write.mode("overwrite").option("sep", sep).option("header", header).option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def _record(cols: list[str]) -> Column:
    return F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})


def _write_lines(lines: DataFrame, path: str) -> None:
    lines.orderBy("k0", "k1", "k2", "k3").select("line").write.mode("overwrite").text(path)


def _line(df: DataFrame, k0, k1, k2, k3, text: Column) -> DataFrame:
    def col(v, t):
        return (v if isinstance(v, Column) else F.lit(v)).cast(t)

    return df.select(col(k0, "int").alias("k0"), col(k1, "string").alias("k1"), col(k2, "int").alias("k2"), col(k3, "long").alias("k3"), text.alias("line"))


def _keys(df: DataFrame, key: str) -> list[str]:
    return [*(["layout_id"] if "layout_id" in df.columns and key != "layout_id" else []), key]


def json_lines(df: DataFrame, orient: str, key: str = "row_id", index: list[str] | None = None) -> DataFrame:
    """Ordered lines of one JSON document over rows with the id ``key``, unique within a ``layout_id`` if there is one.

    ``records``: list of objects; ``table``: column names and rows; ``index``: object by ``index``, the id alone if not given;
    several plans need ``["layout_id", "row_id"]``, joined by "/".
    """
    cols = df.columns
    one = df.sparkSession.range(1)
    keys = _keys(df, key)
    first = df.agg(F.min(F.struct(*keys)).alias("m")).first()["m"]
    own = F.lit(False) if first is None else F.struct(*keys).eqNullSafe(F.struct(*[F.lit(first[k]).alias(k) for k in keys]))
    comma = F.when(own, F.lit("")).otherwise(F.lit(","))
    if orient == "table":
        # the record's values without its names
        value = F.concat(F.lit("["), F.array_join(F.array(*[F.regexp_replace(F.to_json(F.struct(C(c).alias("v")), {"ignoreNullFields": "false"}), r"^\{\"v\":|\}$", "") for c in cols]), ","), F.lit("]"))
        names = ",".join(f'"{c}"' for c in cols)
        head, tail = f'{{"columns":[{names}],"data":[', "]}"
    elif orient == "index":
        value, head, tail = F.concat(F.lit('"'), F.concat_ws("/", *[C(k).cast("string") for k in index or [key]]), F.lit('":'), _record(cols)), "{", "}"
    else:
        value, head, tail = _record(cols), "[", "]"
    body = _line(df, 1, "", 0, C(key), F.concat(comma, value))
    return _line(one, 0, "", 0, 0, F.lit(head)).unionByName(body).unionByName(_line(one, 2, "", 0, 0, F.lit(tail)))


def write_json(df: DataFrame, path: str, orient: str = "records", key: str = "row_id", lines: bool = False, index: list[str] | None = None) -> None:
    """One JSON document, or one object per line with ``lines=True``."""
    if lines:
        df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)
    else:
        _write_lines(json_lines(df, orient, key, index), path)


def grouped_lines(df: DataFrame, group: str, key: str, record: Column, rank: Column | None = None) -> DataFrame:
    """Lines of an object with one list of records per group; groups without rows do not appear."""
    r = F.lit(0) if rank is None else rank
    d = df.withColumns({"_g": C(group).cast("string"), "_r": r.cast("int"), "_line": record})
    keys = F.struct(*_keys(df, key))
    heads = d.groupBy("_r", "_g").agg(F.min(keys).alias("_first"))
    top = heads.agg(F.min(F.struct("_r", "_g")).alias("m")).first()["m"]
    lead = F.lit("") if top is None else F.when((C("_r") == F.lit(top["_r"])) & (C("_g") == F.lit(top["_g"])), "").otherwise(",")
    start = _line(heads, 2 + C("_r"), C("_g"), 0, 0, F.concat(lead, F.regexp_replace(F.to_json(F.struct(C("_g").alias("v"))), r"^\{\"v\":|\}$", ""), F.lit(":[")))
    stop = _line(heads, 2 + C("_r"), C("_g"), 2, 0, F.lit("]"))
    rows = d.join(heads, ["_r", "_g"])
    rows = _line(rows, 2 + C("_r"), C("_g"), 1, C(key), F.concat(F.when(keys == C("_first"), "").otherwise(","), C("_line")))
    one = df.sparkSession.range(1)
    return _line(one, 0, "", 0, 0, F.lit("{")).unionByName(start).unionByName(rows).unionByName(stop).unionByName(_line(one, 1 << 20, "", 0, 0, F.lit("}")))


def write_json_grouped(df: DataFrame, group: str, path: str, key: str = "row_id") -> None:
    _write_lines(grouped_lines(df, group, key, _record([c for c in df.columns if c != group])), path)


def write_by_class(df: DataFrame, path: str) -> None:
    """One table per class; classes without rows do not appear."""
    df.write.mode("overwrite").partitionBy("cls").parquet(path)


# fixed columns and display names of the class export
CLASS_JSON = {"anchor_text": "Text/Nummer", "coord_text": "Koordinatentext", "coord_value": "Koordinatenwert", "gi_gl": "GI/GL", "page": "Seite", "notes": "Notizen", "conf": "Konfidenz"}
COORD_JSON = {"coord_text": "Text", "coord_value": "Wert", "gi_gl": "GI/GL", "page": "Seite", "notes": "Notizen", "conf": "Konfidenz"}


def class_records(df: DataFrame, thresholds: dict, overall: float = 0.0) -> DataFrame:
    """Rows above their thresholds as JSON records with the columns of their class."""
    def rec(cols: dict[str, str]) -> Column:
        return F.to_json(F.struct(*[C(c).alias(n) for c, n in cols.items()]), {"ignoreNullFields": "false"})

    d = filter_thresholds(df, thresholds, overall)
    r = F.when(C("cls") == "coordinate", rec(COORD_JSON)).when(C("cls") == "signal", rec(CLASS_JSON | {"fahrtrichtung": "Fahrtrichtung"})).otherwise(rec(CLASS_JSON))
    return d.select("layout_id", "row_id", "cls", r.alias("record"))


def export_class_json(df: DataFrame, thresholds: dict, path: str, overall: float = 0.0) -> None:
    """Object of classes with their filtered records, coordinates last."""
    d = class_records(df, thresholds, overall)
    _write_lines(grouped_lines(d, "cls", "row_id", C("record"), (C("cls") == "coordinate").cast("int")), path)


# --- reports -----------------------------------------------------------------------------------
def report_rows(issues: DataFrame) -> DataFrame:
    """Flat report of eight text columns."""
    m, v = C("message"), F.lit("")
    return issues.select(
        "severity", F.when(m.contains(":"), F.substring_index(m, ":", 1)).otherwise("Allgemein").alias("category"),
        F.when(C("row_id") >= 0, C("row_id").cast("string")).otherwise(v).alias("row"), F.coalesce("field", v).alias("field"), "message",
        F.coalesce("current_value", v).alias("current_value"), F.coalesce("suggested_value", v).alias("suggestion"),
        F.when(C("auto_correctable"), F.concat(F.format_string("%.0f", C("confidence") * 100), F.lit("%"))).otherwise(v).alias("confidence"))


def report_lines(issues: DataFrame, corrections: DataFrame | None = None) -> DataFrame:
    """Text report: summary, applied corrections, then the issues by category, as ordered lines."""
    s = issues.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))
    out = _line(s, 0, C("severity"), 0, 0, F.format_string("%s: %d", "severity", "n"))
    if corrections is not None:
        out = out.unionByName(_line(corrections, 1, "", 0, C("row_id"), F.concat(
            F.lit("row "), C("row_id").cast("string"), F.lit(" - "), C("column_name"), F.lit(": '"), F.coalesce("old_value", F.lit("")), F.lit("' -> '"), C("new_value"), F.lit("'"))))
    d = issues.withColumn("category", F.when(C("message").contains(":"), F.substring_index("message", ":", 1)).otherwise("Allgemein"))
    heads = d.select("category").distinct()
    out = out.unionByName(_line(heads, 2, C("category"), 0, 0, F.upper("category")))
    fix = F.when(C("suggested_value").isNotNull(), F.concat(F.lit(" => "), C("suggested_value"), F.lit(" ("), F.format_string("%.0f", C("confidence") * 100), F.lit("%)"))).otherwise("")
    text = F.concat(F.lit("["), C("severity"), F.lit("] row "), C("row_id").cast("string"), F.lit(" "), C("field"), F.lit(": "), C("message"), F.lit(" | "), F.coalesce("current_value", F.lit("")), fix)
    return out.unionByName(_line(d, 2, C("category"), 1, C("row_id"), text))


def write_report(issues: DataFrame, path: str, corrections: DataFrame | None = None) -> None:
    _write_lines(report_lines(issues, corrections), path)


def corrections_export(log: DataFrame, path: str, key: str = "corr_id") -> DataFrame:
    """Corrections as JSON lines by type below ``path``; returns the counts per plan and type."""
    log.write.mode("overwrite").option("ignoreNullFields", "false").partitionBy("correction_type").json(path)
    return log.groupBy("layout_id", "correction_type").agg(F.count(F.lit(1)).alias("n"))
