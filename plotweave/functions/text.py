"""Text rules as Column expressions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from plotweave import rules as R

BLANK = " \t\n\r\f\x0b"


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(BLANK))


def filled(c: Column) -> Column:
    """Not null and not blank."""
    return F.coalesce(F.length(strip(c)) > 0, F.lit(False))


def text_or_empty(c: Column) -> Column:
    return F.coalesce(strip(c), F.lit(""))


def squeeze(c: Column) -> Column:
    """Runs of white space become one space, ends are cut."""
    return F.regexp_replace(strip(c), r"\s+", " ")


def matches(c: Column, pattern: str) -> Column:
    return c.rlike(pattern)


def group(c: Column, pattern: str, idx: int = 1) -> Column:
    """Regex group, NULL where the pattern does not match."""
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, idx))


def digits_in(c: Column) -> Column:
    return F.length(F.regexp_replace(c, r"[^0-9]", ""))


# --- coordinates -------------------------------------------------------------------------------
_NUMBER = r"^\s*([+-]?\d{1,3}[,\.]\d{3,4})\s*"
COORD_STRICT = _NUMBER + r"(?:(?:GI|Gl)\.?\s*([A-Za-z0-9./-]{1,6}))?\s*$"
COORD_BRACKETS = _NUMBER + r"(?:\(?(?:GI|Gl)\.?\s*([A-Za-z0-9./-]{1,6})\)?)?\s*$"


def _coord_base(text: Column) -> Column:
    return F.regexp_replace(F.replace(strip(text), F.lit(" "), F.lit("")), r"[a-zA-Z]$", "")


def coord_value(text: Column, strict: bool = False) -> Column:
    """Kilometre value of a coordinate text; NULL if it is not one."""
    number = group(_coord_base(text), COORD_STRICT if strict else COORD_BRACKETS, 1)
    return F.replace(number, F.lit(","), F.lit(".")).try_cast("double")


def coord_track(text: Column, strict: bool = False) -> Column:
    """Track id after the number, NULL without one."""
    return F.nullif(group(_coord_base(text), COORD_STRICT if strict else COORD_BRACKETS, 2), F.lit(""))


def trim_coord_tail(c: Column) -> Column:
    """Drop one trailing letter, then one trailing bar or slash."""
    c = F.regexp_replace(c, r"\s*[a-zA-Z]\s*$", "")
    return F.regexp_replace(c, r"\s*[|/\\]\s*$", "")


def clean_coord(text: Column) -> Column:
    """Take the coordinate out of a text with neighbours' characters in it, '' if there is none."""
    t = F.coalesce(text, F.lit(""))
    t = F.regexp_replace(t, r"^[QOqo]([,.])", "0$1")
    t = F.regexp_replace(t, r"^-[QOqo]([,.])", "-0$1")
    t = F.regexp_replace(t, r"([,.])[QOqo]([,.\d])", "$10$2")
    bracket = F.replace(F.regexp_extract(t, r"-?\d+[.,]\d+\([A-Za-z0-9.,]+", 0), F.lit(","), F.lit("."))
    plain = F.replace(F.regexp_extract(t, r"-?\d+[.,]\d+(?=\s|$|[^0-9.,])", 0), F.lit(","), F.lit("."))
    return (
        F.when(bracket != "", F.concat(bracket, F.lit(")")))
        .when(plain != "", trim_coord_tail(plain))
        .otherwise(F.lit(""))
    )


def fix_brackets(text: Column) -> Column:
    """One spelling for the track mark, no blanks inside brackets, dot as separator."""
    t = F.replace(F.coalesce(text, F.lit("")), F.lit(","), F.lit("."))
    t = F.regexp_replace(t, r"[Gg][Ii1l]\.?", "Gl.")
    t = F.regexp_replace(t, r"\(\s+", "(")
    return strip(F.regexp_replace(t, r"\s+\)", ")"))


def looks_like_coord(text: Column) -> Column:
    t = F.coalesce(text, F.lit(""))
    return (
        t.rlike(r"^[0-9-]") & t.rlike(r"[0-9]") & t.contains(".") & (t.contains("(") == t.contains(")"))
    )


def coord_score(text: Column) -> Column:
    """How good a coordinate text is: -1 empty, 0 none, more for digits, separator and track mark."""
    t = text_or_empty(text)
    main = strip(F.substring_index(t, "(", 1))
    inner = strip(F.substring_index(F.coalesce(F.get(F.split(t, r"\(", -1), 1), F.lit("")), ")", 1))
    main_score = F.when((digits_in(main) >= 1) & main.contains("."), 1.0 + digits_in(main) * 0.1).otherwise(0.0)
    inner_score = F.when(inner.contains("Gl.") | inner.contains("gl."), 0.5).otherwise(0.0) + digits_in(inner) * 0.05
    plain = 1.0 + digits_in(t) * 0.1 + F.when(t.contains(".") | t.contains(","), 0.3).otherwise(0.0)
    return (
        F.when(F.coalesce(text, F.lit("")) == "", -1.0)
        .when(~looks_like_coord(t), 0.0)
        .when(t.contains("("), main_score + inner_score)
        .when(digits_in(t) < 1, 0.0)
        .otherwise(plain)
    )


# --- names -------------------------------------------------------------------------------------
def alnum_upper(text: Column) -> Column:
    t = F.regexp_replace(F.upper(text), r"[^\p{L}\p{N} ]", "")
    return strip(F.regexp_replace(t, r"\s+", " "))


STRICT_SIGNAL = r"^[A-ZÄÖÜ]{1,4}\s*\d{1,4}$"
_HEAD_TAIL = r"^([A-ZÄÖÜ]{1,4})\s*([A-Z0-9]{1,4})$"


def is_strict_signal(text: Column) -> Column:
    return alnum_upper(text).rlike(STRICT_SIGNAL)


def fix_signal_digits(text: Column) -> Column:
    """Letters in the number part that look like digits become digits."""
    t = alnum_upper(text)
    tail = F.translate(F.regexp_extract(t, _HEAD_TAIL, 2), "OILSBZGQD", "011582600")
    return F.when(t.rlike(_HEAD_TAIL), F.concat(F.regexp_extract(t, _HEAD_TAIL, 1), tail)).otherwise(t)


def name_score(text: Column, conf: Column, cls: Column, numeric_ok: Column | None = None) -> Column:
    """How likely a token is an element name, -1 if it cannot be one."""
    s = text_or_empty(text)
    numeric_ok = F.lit(False) if numeric_ok is None else numeric_ok
    letters = F.length(F.regexp_replace(s, r"\P{L}", ""))
    uppers = F.length(F.regexp_replace(s, r"\P{Lu}", ""))
    score = (
        F.when(letters > 0, 1.0).otherwise(0.0)
        + F.when(s.rlike(r"\p{Nd}"), 0.7).otherwise(0.0)
        + 0.4 * uppers / F.greatest(F.lit(1), letters)
        + F.greatest(F.lit(0), 6 - F.abs(F.length(s) - 5)) * 0.1
        + 0.6 * conf
        + F.when(
            ((cls == "signal") & s.rlike("(?i)" + R.SIGNAL_ID)) | (cls.isin(R.GKS) & s.rlike(R.GKS_ID)), 1.2
        ).otherwise(0.0)
    )
    return (
        F.when((s == "") | (F.length(s) > 18), -1.0)
        .when(F.replace(s, F.lit(" "), F.lit("")).rlike(COORD_STRICT), -1.0)
        .when(~numeric_ok & s.rlike(r"^\p{Nd}+$"), -1.0)
        .when(s.rlike(r"^[-_/().]+$"), -1.0)
        .otherwise(score)
    )


def block_id(text: Column) -> Column:
    """First line of a switch block."""
    return strip(F.element_at(F.split(text_or_empty(text), "\n"), 1))


def block_coords(text: Column) -> Column:
    """Coordinate lines of a switch block, letters read for zero put right inside numbers."""
    lines = F.split(text_or_empty(text), "\n")
    rest = F.filter(F.transform(F.slice(lines, 2, F.size(lines)), strip), lambda x: x != "")

    def zeros(line: Column) -> Column:
        # every number-like run "digits/O/Q , digits/O/Q" is rewritten; the text between runs stays
        run = r"[0-9OoQq]+[,.][0-9OoQq]+"
        parts = F.split(line, run, -1)
        runs = F.transform(F.regexp_extract_all(line, F.lit(run), F.lit(0)), lambda x: F.translate(x, "OoQq", "0000"))
        return F.array_join(F.flatten(F.transform(F.arrays_zip(parts.alias("p"), runs.alias("r")),
                            lambda z: F.array(z["p"], F.coalesce(z["r"], F.lit(""))))), "")

    return F.transform(rest, zeros)


def is_exempt(name: Column) -> Column:
    """Names that need no direction: V..., or one letter with three or more digits."""
    n = text_or_empty(F.upper(name))
    return n.startswith("V") | n.rlike(r"^\p{L}\p{Nd}{3,}$")


def bracket_name(name: Column) -> Column:
    """Signal name in the brackets at the end of a stop point's name."""
    return strip(group(name, r"\(([^)]+)\)\s*$", 1))


def is_generated(name: Column, cls: Column) -> Column:
    """Name made from the class and a number, or a fixed text: says nothing about identity."""
    n = F.lower(text_or_empty(name))
    c = F.lower(F.coalesce(cls, F.lit("")))
    numbered = F.lit(False)
    for variant in (c, F.replace(c, F.lit("_"), F.lit(" ")), F.replace(c, F.lit("_"), F.lit(""))):
        rest = F.substr(n, F.length(variant) + 1)
        numbered = numbered | (F.startswith(n, variant) & rest.rlike(r"^\s*\d+$"))
    return (n != "") & (c != "") & (
        ((c == "gm_block") & (n == "gm"))
        | ((c == "prellbock") & (n == "pb"))
        | ((c == "haltepunkt") & n.rlike(r"^haltepunkt\s*\d+(\s*\([^)]+\))?$"))
        | numbered
    )


def word_changes(old: Column, new: Column) -> Column:
    """Positions at which the word lists of two names differ: array of (position, old, new)."""
    a = F.regexp_extract_all(text_or_empty(old), F.lit(r"(?U)\w+"), F.lit(0))
    b = F.regexp_extract_all(text_or_empty(new), F.lit(r"(?U)\w+"), F.lit(0))
    n = F.greatest(F.size(a), F.size(b))
    idx = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    rows = F.transform(
        idx, lambda i: F.struct(i.alias("position"), F.get(a, i).alias("old"), F.get(b, i).alias("new"))
    )
    return F.filter(rows, lambda r: ~r["old"].eqNullSafe(r["new"]))


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio of two texts. Run it on distinct pairs behind a cheap filter."""
    import difflib

    return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b)], dtype="float64")


# --- stable ids --------------------------------------------------------------------------------
def detection_id(cls, page, cx, cy, w, h, angle, anchor_text, coord_text, base=None) -> Column:
    """Content hash in UUID form: class, page, centre on a 10 px grid, texts, else size and angle."""

    def grid(c: Column) -> Column:
        return (F.rint(F.coalesce(c, F.lit(0.0)) / 10) * 10).cast("long").cast("string")

    def one(c: Column) -> Column:
        return F.bround(F.coalesce(c.cast("double"), F.lit(0.0)), 1)

    def norm(c: Column) -> Column:
        return F.nullif(F.lower(squeeze(c)), F.lit(""))

    bare = ~filled(anchor_text) & ~filled(coord_text)
    size = F.when(
        bare & ((one(w) > 0) | (one(h) > 0)),
        F.concat(F.lit("size:"), one(w).cast("string"), F.lit("x"), one(h).cast("string")),
    )
    tilt = F.when(bare & (one(angle) != 0), F.concat(F.lit("angle:"), one(angle).cast("string")))
    parts = [
        F.nullif(base, F.lit("")) if base is not None else F.lit(None).cast("string"),
        F.coalesce(cls, F.lit("")), F.coalesce(page, F.lit(0)).cast("string"), grid(cx), grid(cy),
        norm(anchor_text), norm(coord_text), size, tilt,
    ]
    h32 = F.substr(F.sha2(F.concat_ws("|", *parts), 256), F.lit(1), F.lit(32))
    return F.regexp_replace(h32, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


VERSION_SUFFIX = [r"_[A-Z]_\d{3,4}$", r"_v\d+$", r"_rev\d+$", r"_version\d+$", r"_\d{3,4}$"]


def base_name(path: Column) -> Column:
    """File name without folder, extension and the first matching version suffix."""
    name = F.regexp_replace(F.substring_index(path, "/", -1), r"(?i)\.pdf$", "")
    out = None
    for pattern in VERSION_SUFFIX:
        hit, rest = name.rlike("(?i)" + pattern), F.regexp_replace(name, "(?i)" + pattern, "")
        out = F.when(hit, rest) if out is None else out.when(hit, rest)
    return out.otherwise(name)


# --- empty, equal, format ----------------------------------------------------------------------
def same_km(a: Column, b: Column, tol: float = R.SAME_KM) -> Column:
    """Both missing, or closer than ``tol`` kilometres."""
    return F.when(a.isNull() | b.isNull(), a.isNull() & b.isNull()).otherwise(F.abs(a - b) < tol)


def km_text(v: Column) -> Column:
    return F.when(v.isNull(), F.lit("")).otherwise(F.format_string("%.4f", v))


def metres_text(v: Column) -> Column:
    """Signed metres in brackets, as put behind a kilometre value."""
    return F.when(v > 0, F.format_string(" (+%.1fm)", v)).when(v.isNotNull(), F.format_string(" (%.1fm)", v)).otherwise("")


def fits_pattern(text: Column, pattern: Column) -> Column:
    """Text against a preset or custom pattern; blank text or pattern fits."""
    regex = F.coalesce(R.lookup(pattern, R.TEXT_PATTERNS), pattern)
    return (
        F.coalesce(pattern, F.lit("")).eqNullSafe("")
        | F.coalesce(text, F.lit("")).eqNullSafe("")
        | F.coalesce(F.regexp_like(text, F.concat(F.lit("^(?:"), regex, F.lit(")"))), F.lit(False))
    )


def digits_fix(text: Column) -> Column:
    """Look-alike letters to digits, as used for the digits-only preset."""
    return F.translate(text, "OISBZ", "01582")
