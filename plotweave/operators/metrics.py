"""Counts, quality metrics, profiles, orders and logs as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotweave import rules as R
from plotweave.functions import scoring as S
from plotweave.functions import text as T
from plotweave.operators.filters import visible
from plotweave.operators.ordered import id_cell, rank_in_group

C = F.col


def class_counts(df: DataFrame, custom: Column | None = None) -> DataFrame:
    """Rows per plan and class, split by source."""
    own = F.lit(False) if custom is None else custom
    return df.groupBy("layout_id", "cls").agg(F.count(F.lit(1)).alias("n"), F.count_if(own).alias("custom"), F.count_if(~own).alias("model"))


def quality_metrics(df: DataFrame, value: str = "coord_value") -> DataFrame:
    """Long table of metrics per plan: overall, per class and per page from one grouping-sets pass."""
    low = C("conf") < R.lookup(C("cls"), R.REVIEW, R.REVIEW_DEFAULT_CHECK)
    need = R.is_in(C("cls"), R.NEED_COORDINATE)
    d = df.select("layout_id", "cls", "page", "conf", low.alias("low"), (C("cls") == "coordinate").alias("c"), (C("cls") == "signal").alias("s"), need.alias("a"),
                  C("coord_text").isNotNull().alias("ct"), C("anchor_text").isNotNull().alias("at"), C(value).isNotNull().alias("cv"))
    g = d.groupingSets([["layout_id"], ["layout_id", "cls"], ["layout_id", "page"]], "layout_id", "cls", "page").agg(
        F.grouping_id().alias("gid"), F.avg("conf").alias("mean"), F.min("conf").alias("lo"), F.max("conf").alias("hi"), F.stddev_samp("conf").alias("sd"),
        F.count(F.lit(1)).alias("n"), F.count_if("low").alias("low"),
        (F.count_if(C("c") & C("ct")) / F.nullif(F.count_if("c"), F.lit(0))).alias("coord_rate"),
        (F.count_if(C("s") & C("at")) / F.nullif(F.count_if("s"), F.lit(0))).alias("signal_rate"),
        (F.count_if(C("a") & C("cv")) / F.nullif(F.count_if("a"), F.lit(0))).alias("link_rate"))

    def m(name, v: str, when: Column) -> Column:
        label = name if isinstance(name, Column) else F.lit(name)
        return F.when(when, F.struct(label.alias("metric_name"), C(v).cast("double").alias("metric_value")))

    whole, cls, page = C("gid") == 3, C("gid") == 1, C("gid") == 2

    def per(prefix):
        return F.concat(F.lit(prefix), "cls")

    items = F.array(
        m("avg_confidence_all", "mean", whole), m("min_confidence_all", "lo", whole), m("max_confidence_all", "hi", whole), m("std_confidence_all", "sd", whole),
        m("total_detections", "n", whole), m("coord_ocr_success_rate", "coord_rate", whole), m("signal_ocr_success_rate", "signal_rate", whole),
        m("anchor_linking_success_rate", "link_rate", whole),
        m(per("avg_confidence_"), "mean", cls), m(per("min_confidence_"), "lo", cls), m(per("count_"), "n", cls), m(per("low_confidence_count_"), "low", cls), m(per("total_"), "n", cls),
        m(F.concat(F.lit("avg_confidence_page_"), C("page").cast("string")), "mean", page))
    return g.select("layout_id", F.inline(F.array_compact(items))).filter(C("metric_value").isNotNull())


def risk_counts(df: DataFrame) -> DataFrame:
    """Visible rows per risk level and plan."""
    level = S.risk_level(S.row_risk()[0])
    return visible(df).select("layout_id", level.alias("level")).groupBy("layout_id").agg(
        *[F.count_if(C("level") == n).alias(n) for n in ("high_risk", "medium_risk", "low_risk")], F.count(F.lit(1)).alias("total"))


def quality_stats(df: DataFrame, risk: str = "risk_score") -> DataFrame:
    """Mean confidence, and number and share of rows per risk level, per plan."""
    r = C(risk)
    g = df.filter(C("conf").isNotNull()).groupBy("layout_id").agg(
        F.count(F.lit(1)).alias("total"), F.avg("conf").alias("avg_confidence"), F.count_if(r > R.RISK_HIGH).alias("high_risk"),
        F.count_if((r >= R.RISK_MEDIUM) & (r <= R.RISK_HIGH)).alias("medium_risk"), F.count_if(r < R.RISK_MEDIUM).alias("low_risk"))
    return g.withColumns({f"{n}_share": C(n) / C("total") for n in ("high_risk", "medium_risk", "low_risk")})


def confidence_stats(df: DataFrame) -> DataFrame:
    c = C("conf")
    bands = {"high": c >= 0.9, "medium": (c >= 0.6) & (c < 0.9), "low": c < 0.6, "very_low": c < 0.4}
    g = df.filter(c.isNotNull()).groupBy("layout_id").agg(F.count(F.lit(1)).alias("total"), F.avg(c).alias("average"), *[F.count_if(v).alias(k) for k, v in bands.items()])
    return g.withColumns({f"{n}_share": C(n) / C("total") for n in bands})


def profile(df: DataFrame, cols: list[str]) -> DataFrame:
    """Filled, empty and distinct values per column and plan.

    Values are counted per distinct value first, so no task sees all values of one column.
    """
    long = df.select("layout_id", F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), C(c).cast("string").alias("v")) for c in cols])).alias("e")).select("layout_id", "e.*")
    per = long.groupBy("layout_id", "column_name", "v").agg(F.count(F.lit(1)).alias("k"))
    ok = T.filled(C("v"))
    return per.groupBy("layout_id", "column_name").agg(
        F.sum(F.when(ok, C("k")).otherwise(0)).alias("filled"), F.sum(F.when(ok, 0).otherwise(C("k"))).alias("empty"), F.count_if(ok).alias("distinct_values"))


def issue_summary(issues: DataFrame) -> DataFrame:
    """Totals per plan: severities, correctable issues, how sure the fixes are."""
    s, auto, conf = F.lower("severity"), C("auto_correctable"), C("confidence")
    return issues.groupBy("layout_id").agg(
        F.count(F.lit(1)).alias("total_issues"), F.count_if(s == "error").alias("errors"), F.count_if(s == "warning").alias("warnings"), F.count_if(s == "info").alias("info"),
        F.count_if(auto).alias("auto_correctable"), F.count_if(auto & (conf >= 0.9)).alias("high_confidence_fixes"),
        F.count_if(auto & (conf >= 0.6) & (conf < 0.9)).alias("medium_confidence_fixes"))


def issue_categories(issues: DataFrame) -> DataFrame:
    return issues.groupBy("layout_id", "category").agg(F.count(F.lit(1)).alias("n"))


def quick_check(df: DataFrame) -> DataFrame:
    """Fast look at freshly loaded rows: number of risky ones per plan."""
    missing = C("cls").isin("signal", "gks_gesteuert", "gks_nicht_gesteuert", "weiche", "sverbinder") & (F.coalesce("coord_text", F.lit("")) == "")
    risk = (1.0 - C("conf")) * 0.4 + F.when(missing, 0.3).otherwise(0.0)
    return df.filter(C("conf").isNotNull()).groupBy("layout_id").agg(F.count_if(risk >= 0.5).alias("high"), F.count_if((risk >= 0.3) & (risk < 0.5)).alias("medium"))


def adjustment_stats(log: DataFrame) -> DataFrame:
    """Learned text-region adjustment per class and whether to suggest it."""
    n = F.count(F.lit(1))
    cols = ["offset_x", "offset_y", "width_delta", "height_delta"]
    return log.groupBy("cls").agg(n.alias("n"), *[F.avg(c).cast("int").alias(c) for c in cols]).withColumns({
        "confidence": F.least(F.lit(0.95), C("n") / 10.0), "usable": C("n") >= 3, "suggest": suggest_at(C("n"))})


def suggest_at(n: Column) -> Column:
    return (n == 3) | ((n > 3) & (n % 5 == 0))


# --- order -------------------------------------------------------------------------------------
def dedupe_rows(df: DataFrame, order: str) -> DataFrame:
    """First row of every ``row_id`` of a plan."""
    first = df.groupBy("layout_id", "row_id").agg(F.min(order).alias(order))
    return df.join(first, ["layout_id", "row_id", order], "left_semi")


def next_risk(df: DataFrame, at: int) -> DataFrame:
    """Next high-risk row of every plan after row ``at``, from the start again behind the last one."""
    d = visible(df).filter(S.row_risk()[0] > R.RISK_HIGH)
    known = F.count_if(C("row_id") == at) > 0
    nxt = F.min(F.when(C("row_id") > at, C("row_id")))
    return d.groupBy("layout_id").agg(F.when(known, F.coalesce(nxt, F.min("row_id"))).otherwise(F.min("row_id")).alias("next_row"))


def assign_row_ids(df: DataFrame, out: str = "new_id") -> DataFrame:
    """Dense 0-based numbering of a plan's rows by page and id."""
    cell = F.struct("page", id_cell().alias("c"))
    d = rank_in_group(df, ["layout_id"], ["page", "row_id"], cell, out)
    return d.withColumn(out, C(out) - 1)


def sort_rows(df: DataFrame, keys: list[tuple[str, bool]]) -> DataFrame:
    """Inside each class by up to two columns, numbers as numbers before texts; direction per key."""
    by = [C("cls")]
    for col, up in keys:
        s = F.coalesce(C(col).cast("string"), F.lit(""))
        for k in (s.try_cast("double").isNull(), s.try_cast("double"), F.lower(s)):
            by.append(k.asc() if up else k.desc())
    return df.orderBy(*by)


def weakest(df: DataFrame) -> DataFrame:
    return df.orderBy("conf", "layout_id", "row_id")


def class_order(df: DataFrame) -> DataFrame:
    """Classes in display order with their place; coordinates last."""
    c = df.select("cls").distinct()
    return c.orderBy(C("cls") == "coordinate", "cls")
