"""Class lists, thresholds and weights.

Fixed values: they decide results and have to stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- classes -----------------------------------------------------------------------------------
CLASSES = [
    "signal", "gm_block", "gks_festkodiert", "gks_gesteuert", "weichen_block", "isolierstoß",
    "haltepunkt", "sverbinder", "coordinate", "prellbock", "haltetafel", "weichenende",
    "weichengruppenende",
]
GKS = ["gks_gesteuert", "gks_festkodiert"]
NEED_COORDINATE = [
    "signal", "gks_gesteuert", "gks_festkodiert", "isolierstoß", "prellbock", "haltepunkt",
    "sverbinder", "gm_block", "haltetafel", "weichenende", "weichengruppenende",
]
NEED_TEXT = ["signal", "gks_gesteuert", "gks_festkodiert"]
EXCLUDED = ["coordinate", "weichen_block"]
# classes whose names are generated, and classes with a fixed text
GENERATED_NAME = ["isolierstoß", "haltepunkt", "sverbinder", "haltetafel", "weichenende", "weichengruppenende"]
FIXED_TEXT = {"gm_block": "GM", "prellbock": "PB"}
# spelling variants of one class
CLASS_ALIAS = {"isolierstoss": "isolierstoß"}

# --- detection gate ----------------------------------------------------------------------------
GATE = {
    "gm_block": 0.22, "sverbinder": 0.50, "prellbock": 0.30, "weichengruppenende": 0.7,
    "signal": 0.40, "isolierstoß": 0.09, "haltetafel": 0.81, "haltepunkt": 0.32,
    "gks_festkodiert": 0.85, "coordinate": 0.10, "weichen_block": 0.42, "gks_gesteuert": 0.5,
    "weichenende": 0.7,
}
GATE_DEFAULT = 0.25
UNCERTAIN_FACTOR = 0.5
UNCERTAIN_MIN = {"coordinate": 0.01, "isolierstoß": 0.01}
UNCERTAIN_MIN_DEFAULT = 0.10

SUPPRESS_IOU = {
    "coordinate": 0.25, "weichen_block": 0.30, "signal": 0.32, "haltetafel": 0.35,
    "gks_gesteuert": 0.30, "gks_festkodiert": 0.30,
}
SUPPRESS_IOU_DEFAULT = 0.40

# --- review ------------------------------------------------------------------------------------
REVIEW = {
    "signal": 0.80, "gm_block": 0.80, "gks_festkodiert": 0.70, "gks_gesteuert": 0.70,
    "weichen_block": 0.90, "isolierstoß": 0.70, "haltepunkt": 0.80, "sverbinder": 0.80,
    "coordinate": 0.65, "weichenende": 0.80, "prellbock": 0.80, "haltetafel": 0.70,
    "weichengruppenende": 0.80,
}
REVIEW_DEFAULT = 0.60
REVIEW_DEFAULT_CHECK = 0.5

RISK = {
    "low_confidence": 0.40, "missing_coordinate": 0.30, "stop_mismatch": 0.25,
    "invalid_coordinate": 0.20, "gks_letters": 0.15, "missing_text": 0.15,
    "duplicate_nearby": 0.15, "size_anomaly": 0.10, "formatting_error": 0.05,
}
RISK_HIGH = 0.20
RISK_MEDIUM = 0.10
RISK_LABEL = {"high_risk": "Sofort prüfen", "medium_risk": "Bald prüfen", "low_risk": "Gut erkannt"}

# near-duplicate limit in pixels; None = class is not checked
NEAR_DUPLICATE = {
    "signal": 50, "gks_gesteuert": 30, "gks_festkodiert": 30, "haltepunkt": None,
    "haltetafel": None, "sverbinder": 30, "gm_block": 40, "prellbock": 30, "isolierstoß": None,
    "weichenende": None, "weichengruppenende": 40,
}
NEAR_DUPLICATE_DEFAULT = 50

# class -> (limit in pixels, severity when no coordinate is that near)
RELATION = {
    "signal": (200, "error"), "gks_gesteuert": (150, "error"), "gks_festkodiert": (150, "error"),
    "sverbinder": (150, "error"), "gm_block": (150, "error"), "prellbock": (200, "warning"),
    "haltepunkt": (200, "warning"), "haltetafel": (200, "warning"),
    "weichengruppenende": (200, "warning"), "weichenende": (200, "warning"),
}

# --- linking -----------------------------------------------------------------------------------
# class -> search mode, dx factor, horizontal first, left search, tilted boxes stay axis-aligned, later dy steps
LINK = {
    "signal": dict(mode="below"),
    "gm_block": dict(mode="below"),
    "gks_festkodiert": dict(mode="either"),
    "gks_gesteuert": dict(mode="either"),
    "weichen_block": dict(mode="inside"),
    "isolierstoß": dict(mode="above", axis=True),
    "haltepunkt": dict(mode="either"),
    "sverbinder": dict(mode="above"),
    "weichenende": dict(mode="either", dx=3.0, horizontal=True, steps=[1.5, 2.0, 2.5]),
    "prellbock": dict(mode="right_or_below", dx=2.0, horizontal=True),
    "haltetafel": dict(mode="either", dx=2.0, steps=[2.0, 2.5]),
    "weichengruppenende": dict(mode="either", dx=3.0, horizontal=True, left=True, steps=[1.5, 2.0, 2.5, 3.0]),
}
ANGLE_TOL = 12.0
ANGLE_EPS = 0.15
DIRECTION_PRIORITY = {"gks": 4, "gks_relaxed": 3, "gks_nearest": 2, "gks_confirmed": 2, "track": 1}

# --- box padding (pixels) and expansion, upright and tilted text -------------------------------
PAD_UPRIGHT = {
    "coordinate": 4, "signal": 4, "weichenende": 8, "haltetafel": 4, "prellbock": 4,
    "gks_gesteuert": 8, "gks_festkodiert": 8, "weichengruppenende": 4, "weichen_block": 2,
}
PAD_UPRIGHT_DEFAULT = 8
EXPAND_X_UPRIGHT = {"gks_gesteuert": 0.6, "gks_festkodiert": 0.6, "weichen_block": 1.1}
EXPAND_Y_UPRIGHT = {"gks_gesteuert": 0.6, "gks_festkodiert": 0.6}
PAD_TILTED = {
    "coordinate": 4, "signal": 8, "weichenende": 4, "haltetafel": 4, "prellbock": 4,
    "gks_gesteuert": 6, "gks_festkodiert": 6,
}
PAD_TILTED_DEFAULT = 4
EXPAND_X_TILTED = {"gks_gesteuert": 0.75, "gks_festkodiert": 0.75}
EXPAND_Y_TILTED = {"signal": 1.05, "gks_gesteuert": 0.75, "gks_festkodiert": 0.75}

# extra text windows per class
WINDOW_SIDES = {
    "gm_block": ["inside", "right", "below"],
    "weichen_block": ["inside", "right", "below"],
    "prellbock": ["inside", "right", "below"],
    "gks_gesteuert": ["inside", "left", "right", "below"],
    "gks_festkodiert": ["inside", "left", "right", "below"],
    "signal": ["left", "right", "below", "above"],
}

# --- text patterns -----------------------------------------------------------------------------
SIGNAL_ID = r"^[A-ZÄÖÜ]{1,4}\d{1,4}$"
GKS_ID = r"^\d{3,4}$"
TEXT_PATTERNS = {
    "Nur Zahlen": r"^\d+$",
    "Buchstaben + Zahlen": r"^[A-Z]+\d+$",
    "Signal-ID": r"^[A-ZÄÖÜ]{1,2}\d{1,3}$",
    "Nur Buchstaben": r"^[A-ZÄÖÜ]+$",
    "Koordinate": r"^\d+\+\d+$",
}

# --- comparing versions ------------------------------------------------------------------------
TEXT_CLASSES = ["signal", "gks_festkodiert", "gks_gesteuert"]
TRACK_DIRECTION = ["signal", "weichen_block"]
SAME_KM = 0.0001
RENUMBER_KM = 0.1
MATCH_MIN = 0.7


def spellings(names: list[str]) -> list[str]:
    """Class names with their spelling variants."""
    return names + [a for a, c in CLASS_ALIAS.items() if c in names]


def with_spellings(table: dict) -> dict:
    return table | {a: table[c] for a, c in CLASS_ALIAS.items() if c in table}


def lookup(key: Column, table: dict, default=None) -> Column:
    """Value of ``table`` for ``key`` as one CASE expression: no join, no broadcast."""
    out = None
    for value in dict.fromkeys(with_spellings(table).values()):
        keys = [k for k, v in with_spellings(table).items() if v == value and type(v) is type(value)]
        lit = F.lit(value)
        out = F.when(key.isin(keys), lit) if out is None else out.when(key.isin(keys), lit)
    return out.otherwise(F.lit(default)) if out is not None else F.lit(default)


def is_in(key: Column, names: list[str]) -> Column:
    return key.isin(spellings(names))
