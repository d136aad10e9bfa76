"""Column-expression builders.

Each function returns a ``Column`` composed only of built-in Spark SQL functions, so the
work stays inside whole-stage code generation; none of them needs a Python UDF.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

# ---------------------------------------------------------------------------------------
# Fixed values of the analysed workload (must equal it for the same results)
# ---------------------------------------------------------------------------------------

# Titles searched in a passenger name, in search order (first hit wins):
TITLE_SEARCH_ORDER = ["Mrs", "Mr", "Master", "Miss", "Major", "Rev", "Dr", "Ms", "Mlle",
                      "Col", "Capt", "Mme", "Countess", "Don", "Jonkheer"]

# Title folding into four groups:
TITLE_GROUPS = {
    "Mr": ["Mr", "Don", "Major", "Capt", "Jonkheer", "Rev", "Col"],
    "Master": ["Master"],
    "Mrs": ["Countess", "Mme", "Mrs"],
    "Miss": ["Mlle", "Ms", "Miss"],
}

# Age cut points (right-closed): <=10 child, (10,30] adult, (30,60] senior, >60 aged.
AGE_BINS = [(10.0, "child"), (30.0, "adult"), (60.0, "senior")]
AGE_TOP_LABEL = "aged"

# Fare-per-person threshold: < 8 -> "Low", >= 8 -> "High".
FARE_THRESHOLD = 8.0

# Sex -> gender code.
GENDER_CODES = {"female": 0, "male": 1}


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# F1 --------------------------------------------------------------------------------------
def first_substring(col, candidates: Sequence[str], word_boundary: bool = False) -> Column:
    """The first candidate (in list order) occurring anywhere in ``col``; null if none.

    ``instr`` is a plain substring test, so "Dona" contains "Don"; ``word_boundary=True``
    requires the candidate to stand as a whole word instead.
    """
    c = _c(col)
    hits = []
    for s in candidates:
        if word_boundary:
            pat = r"(^|\W)" + _re_escape(s) + r"(\W|$)"
            hits.append(F.when(c.rlike(pat), F.lit(s)))
        else:
            hits.append(F.when(F.instr(c, s) > 0, F.lit(s)))
    return F.coalesce(*hits)


def _re_escape(s: str) -> str:
    import re
    return re.escape(s)


# P10 -------------------------------------------------------------------------------------
def fold_title(title, sex, strict_reference: bool = False) -> Column:
    """Fold a title into Mr / Master / Mrs / Miss.

    "Dr" becomes "Mr" for men and "Mrs" otherwise; no title becomes "Master" for men and
    "Miss" otherwise. The analysed code compared the sex against "Male" while the data is
    lower case (so "Dr" was always "Mrs") and tested for an empty title while a missing
    title is null; ``strict_reference=True`` reproduces that behaviour.
    """
    t, s = _c(title), _c(sex)
    if strict_reference:
        male = s == F.lit("Male")
        missing = t == F.lit("")
    else:
        male = F.lower(s) == F.lit("male")
        missing = t.isNull() | (t == F.lit(""))
    expr = None
    for group, members in TITLE_GROUPS.items():
        cond = t.isin(*members)
        expr = F.when(cond, F.lit(group)) if expr is None else expr.when(cond, F.lit(group))
    expr = expr.when(t == F.lit("Dr"), F.when(male, F.lit("Mr")).otherwise(F.lit("Mrs")))
    expr = expr.when(missing, F.when(male, F.lit("Master")).otherwise(F.lit("Miss")))
    return expr.otherwise(t)


def case_map(col, groups: Mapping[str, Sequence], default=None) -> Column:
    """CASE over value sets: ``{result: [values..]}`` in order; else ``default``."""
    c = _c(col)
    expr = None
    for out, members in groups.items():
        cond = c.isin(*members)
        expr = F.when(cond, F.lit(out)) if expr is None else expr.when(cond, F.lit(out))
    if default is None:
        return expr
    return expr.otherwise(default if isinstance(default, Column) else F.lit(default))


# P11 -------------------------------------------------------------------------------------
def dict_map(col, mapping: Mapping, cast: str | None = "int") -> Column:
    """Value lookup through a literal map (unmapped -> null), optionally cast."""
    kv = []
    for k, v in mapping.items():
        kv += [F.lit(k), F.lit(v)]
    out = F.try_element_at(F.create_map(*kv), _c(col))
    return out.cast(cast) if cast else out


# F3 --------------------------------------------------------------------------------------
def strip_units(col, to: str = "double") -> Column:
    """Remove unit text (metres, %, any non-numeric characters) and parse the number."""
    cleaned = F.regexp_replace(_c(col).cast("string"), r"[^0-9.\-]", "")
    return cleaned.try_cast(to)


# F4 --------------------------------------------------------------------------------------
def path_piece(col, sep: str = "/", index: int = -1) -> Column:
    """``split(sep)[index]`` (negative index counts from the end); null if out of range."""
    return F.try_element_at(F.split(_c(col), _re_escape(sep)), F.lit(index))


def file_stem(col) -> Column:
    """Last path piece without its extension and without anything after the first '_'."""
    last = path_piece(col, "/", -1)
    stem = F.substring_index(last, ".", 1)
    return F.substring_index(stem, "_", 1)


# F5 --------------------------------------------------------------------------------------
def format_key(*cols, sep: str = "_") -> Column:
    """``device_lane`` style key from several columns."""
    return F.concat_ws(sep, *[_c(c).cast("string") for c in cols])


# F6-F9 -----------------------------------------------------------------------------------
def parse_timestamp(col, fmt: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """Text -> timestamp without time zone; malformed text -> null."""
    return F.try_to_timestamp(_c(col), F.lit(fmt)).cast("timestamp_ntz")


def date_part(col) -> Column:
    return F.to_date(_c(col))


def time_of_day(col) -> Column:
    return F.date_format(_c(col), "HH:mm:ss")


def weekday_monday0(col) -> Column:
    """Day of week with Monday = 0 (``dayofweek`` would be Sunday = 1)."""
    return F.weekday(_c(col))


def hour_of_day(col) -> Column:
    return F.hour(_c(col))


# F10-F15 ---------------------------------------------------------------------------------
def zero_to_null(col) -> Column:
    return F.nullif(_c(col), F.lit(0))


def fill_constant(col, value) -> Column:
    return F.coalesce(_c(col), F.lit(value))


def bin_right_closed(col, edges: Sequence[tuple[float, str]] = AGE_BINS,
                     top: str = AGE_TOP_LABEL) -> Column:
    """Label by right-closed cut points: ``x <= e1 -> l1, x <= e2 -> l2, .., else top``.

    Null stays null. (``ml.feature.Bucketizer`` is left-closed, hence not used.)
    """
    c = _c(col)
    expr = F.when(c.isNull(), F.lit(None).cast("string"))
    for edge, label in edges:
        expr = expr.when(c <= F.lit(edge), F.lit(label))
    return expr.otherwise(F.lit(top))


def threshold_flag(col, threshold: float = FARE_THRESHOLD, low: str = "Low",
                   high: str = "High") -> Column:
    """``< threshold -> low``, ``>= threshold -> high``, null stays null."""
    c = _c(col)
    return F.when(c < threshold, F.lit(low)).when(c >= threshold, F.lit(high))


def presence_flag(col, yes: str = "Yes", no: str = "No") -> Column:
    return F.when(_c(col).isNotNull(), F.lit(yes)).otherwise(F.lit(no))


def row_mean(*cols) -> Column:
    """Mean across columns of one row over the non-null ones (null if all are null)."""
    cs = [_c(c) for c in cols]
    total = None
    count = None
    for c in cs:
        v = F.coalesce(c.cast("double"), F.lit(0.0))
        n = F.when(c.isNotNull(), F.lit(1)).otherwise(F.lit(0))
        total = v if total is None else total + v
        count = n if count is None else count + n
    return F.when(count > 0, total / count)


def gapped(col, above: float = 10.0) -> Column:
    """Deterministic null injection used by the catalogue: value if > above else null."""
    c = _c(col)
    return F.when(c > F.lit(above), c)
