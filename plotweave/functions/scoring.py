"""Risk, false-positive and version-match scores as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from plotweave import rules as R
from plotweave.functions import geometry as G
from plotweave.functions import text as T


def _sum(parts: list[Column]) -> Column:
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total


def _if(cond: Column, points: float) -> Column:
    return F.when(cond, F.lit(points)).otherwise(F.lit(0.0))


def bad_start(coord: Column) -> Column:
    return T.filled(coord) & ~T.text_or_empty(coord).rlike(r"^[0-9-]")


def gks_letters(cls: Column, name: Column) -> Column:
    s = F.translate(T.text_or_empty(name), " -", "")
    return cls.isin(R.GKS) & (s != "") & ~s.rlike(r"^\d+$")


def wide_blank(*texts: Column) -> Column:
    hit = F.lit(False)
    for t in texts:
        hit = hit | F.coalesce(t.contains("  "), F.lit(False))
    return hit


def risk_terms(needs_coord: Column | None = None, needs_text: Column | None = None) -> dict[str, Column]:
    """Condition per risk factor on an element row with ``cls, conf, coord_text, anchor_text, w, h``."""
    cls, conf = F.col("cls"), F.col("conf")
    coord, name = F.col("coord_text"), F.col("anchor_text")
    needs_coord = R.is_in(cls, R.NEED_COORDINATE) if needs_coord is None else needs_coord
    needs_text = cls.isin(R.NEED_TEXT) if needs_text is None else needs_text
    size = F.col("w") * F.col("h")
    return {
        "low_confidence": F.coalesce(conf < R.lookup(cls, R.REVIEW, R.REVIEW_DEFAULT), F.lit(False)),
        "missing_coordinate": needs_coord & ~T.filled(coord),
        "missing_text": needs_text & ~T.filled(name),
        "invalid_needed": needs_coord & bad_start(coord),
        "invalid_coordinate": (cls != "coordinate") & bad_start(coord),
        "gks_letters": gks_letters(cls, name),
        "size_anomaly": F.coalesce((size < 100) | (size > 50000), F.lit(False)),
        "formatting_any": wide_blank(coord, name),
        "formatting_error": wide_blank(F.when(cls != "coordinate", coord), name),
    }


def _points(name: str, cond: Column) -> Column:
    if name == "low_confidence":
        return F.when(cond, (1.0 - F.col("conf")) * R.RISK["low_confidence"]).otherwise(0.0)
    return _if(cond, R.RISK[{"invalid_needed": "invalid_coordinate", "formatting_any": "formatting_error"}.get(name, name)])


def _risk(terms: dict[str, Column], names: list[str]) -> tuple[Column, Column]:
    score = F.least(F.lit(1.0), _sum([_points(n, terms[n]) for n in names]))
    label = {"invalid_needed": "invalid_coordinate", "formatting_any": "formatting_error"}
    factors = F.array_compact(F.array(*[F.when(terms[n], F.lit(label.get(n, n))) for n in names]))
    return score, factors


def base_risk(**kw) -> tuple[Column, Column]:
    """Score and factor list from confidence, coordinate, text and spacing."""
    return _risk(risk_terms(**kw), ["low_confidence", "missing_coordinate", "invalid_needed", "missing_text", "gks_letters", "formatting_any"])


def row_risk(**kw) -> tuple[Column, Column]:
    """As the base risk, with size, and start of any linked coordinate."""
    return _risk(risk_terms(**kw), ["low_confidence", "missing_coordinate", "missing_text", "invalid_coordinate", "gks_letters", "size_anomaly", "formatting_error"])


def inspector_risk(duplicate: Column, mismatch: Column, **kw) -> tuple[Column, Column]:
    """Row risk plus near duplicate and unknown signal of a stop point."""
    terms = risk_terms(**kw) | {"duplicate_nearby": duplicate, "stop_mismatch": mismatch}
    return _risk(terms, ["low_confidence", "missing_coordinate", "missing_text", "duplicate_nearby", "size_anomaly",
                         "invalid_coordinate", "gks_letters", "formatting_error", "stop_mismatch"])


def risk_level(score: Column) -> Column:
    return F.when(score > R.RISK_HIGH, "high_risk").when(score >= R.RISK_MEDIUM, "medium_risk").otherwise("low_risk")


def risk_label(level: Column) -> Column:
    return F.coalesce(R.lookup(level, R.RISK_LABEL), F.lit("Unbekannt"))


def false_positive(coord_dist: Column) -> Column:
    """Flag score of a detection; ``coord_dist`` = distance to the nearest coordinate, NULL if beyond the limit."""
    cls, conf = F.col("cls"), F.col("conf")
    far = R.is_in(cls, R.NEED_COORDINATE) & (coord_dist.isNull() | (coord_dist > F.when(cls == "signal", 200).otherwise(150)))
    return (
        F.when(conf < 0.4, 40).when(conf < 0.5, 20).otherwise(0)
        + F.when(cls.isin(R.NEED_TEXT) & (F.coalesce("anchor_text", F.lit("")) == ""), 30).otherwise(0)
        + F.when(far, 20).otherwise(0)
    )


def symbol_terms() -> dict[str, Column]:
    """Conditions on a row joined with its symbol definition (``s_*`` columns)."""
    name = F.coalesce("anchor_text", F.lit(""))
    ratio = (F.col("w") + F.col("h")) / 2 / F.nullif(F.col("s_avg_size"), F.lit(0.0))
    return {
        "no_coordinate": F.col("s_links") & F.col("coord_value").isNull(),
        "no_text": F.col("s_has_text") & (F.length(name) < 2),
        "pattern": ~T.fits_pattern(name, F.col("s_pattern")),
        "size": F.coalesce((ratio > 2.5) | (ratio < 0.4), F.lit(False)),
        "borderline": (F.col("conf") >= F.col("s_threshold")) & (F.col("conf") < F.col("s_threshold") + 0.05),
        "far_link": F.coalesce(F.col("link_distance") > F.col("s_max_link") * 0.8, F.lit(False)),
    }


SYMBOL_POINTS = {"no_coordinate": 50, "no_text": 40, "pattern": 35, "size": 25, "borderline": 15, "far_link": 10}


def symbol_false_positive() -> Column:
    t = symbol_terms()
    return F.least(F.lit(100), _sum([F.when(t[n], p).otherwise(0) for n, p in SYMBOL_POINTS.items()]))


# --- version matching --------------------------------------------------------------------------
def tiers(v: Column, steps: list[tuple[float, float]], rest: float | None) -> Column:
    """Score of the first step ``v`` is below."""
    out = F.when(v < steps[0][0], F.lit(steps[0][1]))
    for limit, score in steps[1:]:
        out = out.when(v < limit, F.lit(score))
    return out.otherwise(F.lit(rest))


# fixed tiers: (below, score)
TEXT_KM = [(0.001, 0.15), (0.005, 0.12), (0.01, 0.10), (0.02, 0.08), (0.05, 0.06), (0.1, 0.04), (0.5, 0.02)]
TEXT_PX = [(50, 0.30), (100, 0.26), (150, 0.22), (250, 0.18), (400, 0.14), (600, 0.12)]
STOP_PX = [(50, 0.10), (100, 0.07), (200, 0.04), (350, 0.02)]
SYMBOL_KM = [(0.001, 0.85), (0.01, 0.82), (0.02, 0.78), (0.04, 0.74), (0.07, 0.72), (0.1, 0.70)]
SYMBOL_BARE_PX = [(50, 0.85), (100, 0.80), (200, 0.72), (350, 0.68)]
SYMBOL_PX = [(50, 0.15), (100, 0.10), (200, 0.05), (350, 0.02)]


def match_score(ratio: Column | None = None) -> Column:
    """Score of an old (``a_*``) and a new (``b_*``) row; ``ratio`` is the name similarity of signals."""
    def both(n: str) -> tuple[Column, Column]:
        return F.col("a_" + n), F.col("b_" + n)

    (ac, bc), (ap, bp) = both("cls"), both("page")
    an, bn = (T.text_or_empty(c) for c in both("anchor_text"))
    at, bt = (T.text_or_empty(c) for c in both("coord_text"))
    av, bv = both("coord_value")
    km = F.abs(av - bv)
    px = G.distance(F.coalesce("a_cx", F.lit(0.0)), F.coalesce("a_cy", F.lit(0.0)), F.coalesce("b_cx", F.lit(0.0)), F.coalesce("b_cy", F.lit(0.0)))
    ratio = F.when(an == bn, 1.0).otherwise(0.0) if ratio is None else ratio

    name = F.when(ac == "signal", F.when(ratio >= 0.9, 0.7 * ratio)).otherwise(F.when(an == bn, F.lit(0.6)))
    text = F.when((an == "") | (bn == "") | name.isNull(), F.lit(0.0)).otherwise(
        name + F.when(km.isNull(), 0.0).otherwise(tiers(km, TEXT_KM, 0.0)) + tiers(px, TEXT_PX, 0.10)
    )

    sa, sb = T.bracket_name(F.col("a_anchor_text")), T.bracket_name(F.col("b_anchor_text"))
    stops = (ac == "haltepunkt") & T.filled(sa) & T.filled(sb)
    stop = F.when(sa == sb, 0.9 + tiers(px, STOP_PX, 0.0)).otherwise(0.0)

    ga, gb = T.is_generated(an, ac), T.is_generated(bn, bc)
    clash = (an != "") & (bn != "") & (an != bn) & ~(ga & gb)
    base = (
        F.when(km.isNotNull(), tiers(km, SYMBOL_KM, None))
        .when((at != "") & (bt != ""), F.when(at == bt, F.lit(0.8)))
        .when((at == "") & (bt == ""), tiers(px, SYMBOL_BARE_PX, None))
    )
    symbol = F.when(clash | base.isNull(), 0.0).otherwise(base + tiers(px, SYMBOL_PX, 0.0))

    score = F.when(ac.isin(R.TEXT_CLASSES), text).when(stops, stop).otherwise(symbol)
    return F.when((ac != bc) | (F.abs(ap - bp) > 1), 0.0).otherwise(F.least(F.lit(1.0), score))


def change_severity(delta_m: Column, renamed: Column, direction: Column, moved_px: Column) -> Column:
    """major, moderate or minor from metres moved, new name, new direction and pixels moved."""
    m = F.coalesce(F.abs(delta_m), F.lit(0.0))
    px = F.coalesce(moved_px, F.lit(0.0))
    return (
        F.when(renamed | (m > 20) | (px > 100), "major").when((m > 5) | direction | (px > 50), "moderate").otherwise("minor")
    )
