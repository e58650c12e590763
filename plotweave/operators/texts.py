"""Text clean-up over whole element and candidate tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plotweave import rules as R
from plotweave.functions import text as T


def best_reading(readings: DataFrame, keys: list[str], text: str = "txt", tie: str = "k") -> DataFrame:
    """The coordinate reading with the highest score per detection (first one on a tie)."""
    score = T.coord_score(F.col("clean"))
    d = readings.withColumn("clean", T.fix_brackets(T.clean_coord(F.col(text)))).withColumn("score", score)
    pick = F.min(F.struct((-F.col("score")).alias("s"), F.col(tie).alias("t"), F.col("clean").alias("c")))
    return d.groupBy(*keys).agg(pick.alias("m")).select(
        *keys, F.col("m.c").alias("coord_text"), (-F.col("m.s")).alias("score")
    )


def join_tokens(tokens: DataFrame, keys: list[str], span: int = 4) -> DataFrame:
    """Best run of up to ``span`` neighbouring tokens that forms a signal id."""
    w = Window.partitionBy(*keys).orderBy("tx", "token_id")
    d = tokens.filter(T.filled(F.col("txt"))).withColumn("_i", F.row_number().over(w))
    ahead = [
        F.lead(F.struct(T.strip(F.col("txt")).alias("txt"), "tx", "ty", "tconf"), k).over(w) if k
        else F.struct(T.strip(F.col("txt")).alias("txt"), "tx", "ty", "tconf")
        for k in range(span)
    ]
    runs = []
    for n in range(1, span + 1):
        part = [F.col(f"_t{k}") for k in range(n)]
        mean_x = sum((p["tx"] for p in part[1:]), part[0]["tx"]) / n
        mean_y = sum((p["ty"] for p in part[1:]), part[0]["ty"]) / n
        conf = sum((p["tconf"] for p in part[1:]), part[0]["tconf"])
        dist = F.sqrt((mean_x - F.col("cx")) * (mean_x - F.col("cx")) + (mean_y - F.col("cy")) * (mean_y - F.col("cy")))
        text = T.alnum_upper(F.concat_ws(" ", *[p["txt"] for p in part]))
        run = F.struct(
            F.lit(n).alias("len"), text.alias("text"), (conf + 0.2 * (5 - n) - 0.1 * dist / F.col("w")).alias("score")
        )
        runs.append(F.when(part[-1].isNotNull(), run))
    d = d.withColumns({f"_t{k}": a for k, a in enumerate(ahead)})
    d = d.withColumn("_run", F.explode(F.array_compact(F.array(*runs))))
    d = d.filter(F.col("_run.text").rlike(T.STRICT_SIGNAL))
    pick = F.min(F.struct((-F.col("_run.score")).alias("s"), "_i", F.col("_run.len").alias("n"), F.col("_run.text").alias("t")))
    return d.groupBy(*keys).agg(pick.alias("m")).select(
        *keys, F.replace(F.col("m.t"), F.lit(" "), F.lit("")).alias("text"), (-F.col("m.s")).alias("score")
    )


def best_name(tokens: DataFrame, keys: list[str], cls) -> DataFrame:
    """Token with the highest name score per detection."""
    d = tokens.withColumn("_s", T.name_score(F.col("txt"), F.col("tconf"), cls))
    pick = F.min(F.struct((-F.col("_s")).alias("s"), "token_id", F.col("txt").alias("t")))
    return d.filter(F.col("_s") >= 0).groupBy(*keys).agg(pick.alias("m")).select(
        *keys, F.col("m.t").alias("text"), (-F.col("m.s")).alias("score")
    )


def normalise_text(df: DataFrame, coord: str = "coord_text", name: str = "anchor_text") -> DataFrame:
    """Clean coordinate text, its value and track id, and the signal name in one pass."""
    clean = T.fix_brackets(T.clean_coord(F.col(coord)))
    return df.withColumn("coord_clean", clean).withColumns({
        "coord_km": T.coord_value(F.col("coord_clean")),
        "coord_track": T.coord_track(F.col("coord_clean")),
        "name_clean": F.when(F.col("cls") == "signal", T.fix_signal_digits(F.col(name))).otherwise(T.squeeze(F.col(name))),
    })


def finish_rows(df: DataFrame) -> DataFrame:
    """Last pass over element rows: upper case, tails cut, three-digit confidence, fixed and empty texts."""
    name = F.upper(T.text_or_empty(F.col("anchor_text")))
    fixed = R.lookup(F.col("cls"), R.FIXED_TEXT)
    return df.withColumns({
        "anchor_text": F.when(fixed.isNotNull(), fixed)
        .when(R.is_in(F.col("cls"), R.GENERATED_NAME), F.lit("")).otherwise(name),
        "coord_text": T.squeeze(T.trim_coord_tail(F.col("coord_text"))),
        "conf": F.round("conf", 3),
    })
