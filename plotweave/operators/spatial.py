"""Distance and overlap joins on a grid, so that every theta join gets equality keys.

Points that share a position are merged before a search (``places``): a grid cell then holds no
more rows than it has pixel positions, however many copies the data has.

Rows are copied into all cells they reach, which Spark's size estimate does not see: it would take
the copies for a small table and collect them on the driver. Cell joins therefore ask for a merge join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plotweave.functions import geometry as G

KEYS = ["layout_id", "page"]


def prefixed(df: DataFrame, prefix: str, keep: list[str] = KEYS) -> DataFrame:
    return df.select(*keep, *[F.col(c).alias(prefix + c) for c in df.columns if c not in keep])


def places(df: DataFrame, cols: list[str], on: list[str] = KEYS) -> DataFrame:
    """One row per distinct ``cols``: smallest ``row_id`` and number of rows ``n``."""
    return df.groupBy(*on, *cols).agg(F.min("row_id").alias("row_id"), F.count(F.lit(1)).alias("n"))


def _cell(c: Column, size: float) -> Column:
    return F.floor(c / size).cast("long")


def _reached(c: Column, radius: float, size: float) -> Column:
    """One row per cell within ``radius``, and a trace more for rounding."""
    far = radius * 1.001
    return F.explode(F.sequence(_cell(c - far, size), _cell(c + far, size)))


def near_pairs(a: DataFrame, b: DataFrame, radius: float, on: list[str] = KEYS,
               where: Column | None = None, ax="x", ay="y", bx="x", by="y") -> DataFrame:
    """Pairs (``a_*``, ``b_*``) at most ``radius`` apart, with ``dist``.

    Cells are twice as wide as the radius, so a row of ``a`` is copied into some four of them.
    """
    size = 2 * radius
    left = (
        prefixed(a, "a_", on)
        .withColumn("_gx", _reached(F.col("a_" + ax), radius, size))
        .withColumn("_gy", _reached(F.col("a_" + ay), radius, size))
    )
    right = (
        prefixed(b, "b_", on)
        .withColumn("_gx", _cell(F.col("b_" + bx), size))
        .withColumn("_gy", _cell(F.col("b_" + by), size))
    )
    dist = G.distance(F.col("a_" + ax), F.col("a_" + ay), F.col("b_" + bx), F.col("b_" + by))
    pairs = left.hint("merge").join(right, [*on, "_gx", "_gy"]).withColumn("dist", dist).filter(F.col("dist") <= radius)
    return (pairs if where is None else pairs.filter(where)).drop("_gx", "_gy")


def nearest(a: DataFrame, b: DataFrame, radius: float, on: list[str] = KEYS, where: Column | None = None,
            carry: list[str] = (), order: list[Column] | None = None, key: str = "row_id", **xy) -> DataFrame:
    """Nearest ``b`` per row of ``a`` within ``radius``; ties go to the smaller ``b`` id.

    Result: ``on``, ``a``'s key, ``dist``, ``b_row_id`` and the carried ``b_`` columns.
    """
    pairs = near_pairs(a, b, radius, on, where, **xy)
    by = order if order is not None else [F.col("dist")]
    pick = F.struct(*[c.alias(f"_o{i}") for i, c in enumerate(by)], "b_row_id", "dist", *[F.col("b_" + c) for c in carry])
    best = pairs.groupBy(*on, F.col("a_" + key).alias(key)).agg(F.min(pick).alias("_m"))
    return best.select(*on, key, F.col("_m.dist").alias("dist"), F.col("_m.b_row_id").alias("b_row_id"),
                       *[F.col(f"_m.b_{c}").alias(f"b_{c}") for c in carry])


def nearest_any(a: DataFrame, b: DataFrame, radii: list[float], on: list[str] = KEYS, key: str = "row_id") -> DataFrame:
    """Distance to the nearest ``b`` with a growing radius: later radii only see rows without a hit."""
    found, rest = None, a
    for r in radii:
        hit = nearest(rest, b, r, on, key=key)
        found = hit if found is None else found.unionByName(hit)
        rest = rest.join(hit.select(*on, key), [*on, key], "left_anti")
    return found


def span_cells(df: DataFrame, b: G.Box, size: float) -> DataFrame:
    """One row per grid cell a box touches."""
    return df.withColumn("_gx", F.explode(F.sequence(_cell(b[0], size), _cell(b[2], size)))).withColumn(
        "_gy", F.explode(F.sequence(_cell(b[1], size), _cell(b[3], size)))
    )


def overlapping(a: DataFrame, b: DataFrame, on: list[str] = KEYS, size: float = 256.0,
                where: Column | None = None) -> DataFrame:
    """Pairs of boxes (``x1,y1,x2,y2``) with common area. Each pair appears once, in the cell of its corner."""
    left = span_cells(prefixed(a, "a_", on), G.box("a_"), size)
    right = span_cells(prefixed(b, "b_", on), G.box("b_"), size)
    p, q = G.box("a_"), G.box("b_")
    corner = (F.col("_gx") == _cell(F.greatest(p[0], q[0]), size)) & (F.col("_gy") == _cell(F.greatest(p[1], q[1]), size))
    pairs = left.hint("merge").join(right, [*on, "_gx", "_gy"]).filter(corner & (G.overlap_area(p, q) > 0))
    return (pairs if where is None else pairs.filter(where)).drop("_gx", "_gy")


BOX = ["x1", "y1", "x2", "y2"]


def box_groups(df: DataFrame, cols: list[str] = ("cls",), on: list[str] = KEYS) -> DataFrame:
    """Identical boxes as one row: smallest ``row_id`` and number of copies ``n``."""
    return places(df, [*cols, *BOX], on)


def without_near(new: DataFrame, old: DataFrame, radius: float, on: list[str], strict: bool = True) -> DataFrame:
    """Rows of ``new`` that have no row of ``old`` within ``radius``."""
    limit = (F.col("dist") < radius) if strict else (F.col("dist") <= radius)
    hit = near_pairs(new.select(*on, "row_id", "x", "y"), places(old, ["x", "y"], on), radius, on, limit)
    return new.join(hit.select(*on, F.col("a_row_id").alias("row_id")).distinct(), [*on, "row_id"], "left_anti")


def reach_pairs(a: DataFrame, b: DataFrame, a_reach: G.Box, b_reach: G.Box, on: list[str] = KEYS, size: float = 256.0) -> DataFrame:
    """Pairs (``a_*``, ``b_*``) whose reach boxes touch; each pair once, in the cell of the common corner."""
    r = ["r1", "r2", "r3", "r4"]

    def side(d: DataFrame, reach: G.Box, p: str) -> DataFrame:
        d = prefixed(d.withColumns(dict(zip(r, reach))), p, on)
        return span_cells(d, tuple(F.col(p + c) for c in r), size)

    corner = (F.col("_gx") == _cell(F.greatest("a_r1", "b_r1"), size)) & (F.col("_gy") == _cell(F.greatest("a_r2", "b_r2"), size))
    touch = (F.col("a_r1") <= F.col("b_r3")) & (F.col("b_r1") <= F.col("a_r3")) & (F.col("a_r2") <= F.col("b_r4")) & (F.col("b_r2") <= F.col("a_r4"))
    return side(a, a_reach, "a_").hint("merge").join(side(b, b_reach, "b_"), [*on, "_gx", "_gy"]).filter(corner & touch).drop(
        "_gx", "_gy", *[p + c for p in ("a_", "b_") for c in r])
