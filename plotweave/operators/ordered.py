"""Order inside groups without putting a whole group into one task.

A group is cut into cells by an order-preserving expression. Counts per cell are added up over
the few cells of a group, and only the rows of one cell are sorted together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_CELL = 65536


def id_cell(col: str = "row_id") -> Column:
    """Cell for ordering by a unique running id: holds at most ``ROWS_PER_CELL`` rows."""
    return F.floor(F.col(col) / ROWS_PER_CELL)


def rank_in_group(df: DataFrame, keys: list[str], order: list, cell: Column, out: str) -> DataFrame:
    """1-based position of every row in its group. ``cell`` must not decrease along ``order``."""
    d = df.withColumn("_cell", cell)
    before = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        d.groupBy(*keys, "_cell").agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    within = Window.partitionBy(*keys, "_cell").orderBy(*order)
    return (
        d.withColumn("_rn", F.row_number().over(within))
        .join(offsets, [*keys, "_cell"])
        .withColumn(out, F.col("_off") + F.col("_rn"))
        .drop("_cell", "_rn", "_off")
    )


def next_value(df: DataFrame, keys: list[str], value: str, width: float, carry: list[str] = ()) -> DataFrame:
    """Every distinct value of a group with the next larger one.

    Rows are first reduced to distinct values (row with the smallest id and number of rows), so a
    cell holds at most as many rows as there are different values in ``width``. Columns in
    ``carry`` come from the row with the smallest id; ``next_<name>`` from that of the next value.
    """
    best = F.min(F.struct("row_id", *carry))
    last = F.max(F.struct("row_id", *carry))
    d = (
        df.filter(F.col(value).isNotNull())
        .groupBy(*keys, F.col(value).alias("value"))
        .agg(best.alias("_lo"), last.alias("_hi"), F.count(F.lit(1)).alias("n_rows"))
        .withColumn("_cell", F.floor(F.col("value") / width))
    )
    entry = F.struct("value", "_lo")
    w = Window.partitionBy(*keys, "_cell").orderBy("value")
    cells = d.groupBy(*keys, "_cell").agg(F.min(entry).alias("_first"))
    nxt = Window.partitionBy(*keys).orderBy("_cell")
    cells = cells.withColumn("_after", F.lead("_first").over(nxt)).drop("_first")
    out = (
        d.withColumn("_in", F.lead(entry).over(w))
        .join(cells, [*keys, "_cell"])
        .withColumn("_next", F.coalesce("_in", "_after"))
    )
    # the last of several rows with one value is the one whose successor is the next value
    cols = [F.col("_hi.row_id").alias("row_id"), F.col("_next._lo.row_id").alias("next_row_id")]
    for c in carry:
        cols += [F.col(f"_hi.{c}").alias(c), F.col(f"_next._lo.{c}").alias(f"next_{c}")]
    return out.select(*keys, "value", F.col("_next.value").alias("next_value"), "n_rows", *cols)


def order_statistics(df: DataFrame, keys: list[str], value: str, width: float, ranks: dict[str, Column],
                     weight: str | None = None) -> DataFrame:
    """Exact order statistics per group: ``ranks`` maps a name to a 1-based rank in terms of ``n``.

    A histogram of cells finds the cell that holds each rank; only those cells are sorted.
    """
    one = F.col(weight) if weight else F.lit(1)
    d = df.filter(F.col(value).isNotNull()).withColumn("_cell", F.floor(F.col(value) / width))
    d = d.groupBy(*keys, "_cell", F.col(value).alias("_v")).agg(F.sum(one).alias("_n"))
    whole = Window.partitionBy(*keys)
    upto = whole.orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)
    hist = (
        d.groupBy(*keys, "_cell").agg(F.sum("_n").alias("_cn"))
        .withColumn("n", F.sum("_cn").over(whole))
        .withColumn("_end", F.sum("_cn").over(upto))
        .withColumn("_start", F.col("_end") - F.col("_cn"))
    )
    hit = F.lit(False)
    for r in ranks.values():
        hit = hit | ((r > F.col("_start")) & (r <= F.col("_end")))
    inside = Window.partitionBy(*keys, "_cell").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    rows = d.join(hist.filter(hit), [*keys, "_cell"]).withColumn("_pos", F.col("_start") + F.sum("_n").over(inside))
    return rows.groupBy(*keys).agg(
        F.first("n").alias("n"),
        *[F.min(F.when(F.col("_pos") >= r, F.col("_v"))).alias(name) for name, r in ranks.items()],
    )


def median(df: DataFrame, keys: list[str], value: str, width: float, out: str = "median") -> DataFrame:
    """Exact median per group with the number of values ``n``."""
    n = F.col("n")
    m = order_statistics(df, keys, value, width, {"_a": F.floor((n + 1) / 2), "_b": F.floor(n / 2) + 1})
    return m.withColumn(out, (F.col("_a") + F.col("_b")) / 2).drop("_a", "_b")
