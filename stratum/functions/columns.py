"""Column-expression builders (all JVM-side, codegen-friendly, no UDFs).

Every function takes and returns ``pyspark.sql.Column`` objects so callers can
compose them inside a single ``select`` and Catalyst collapses the projection.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from stratum.functions.dates import parse_text
from stratum.registry import CATEGORY_ORDER, MONTH_NAMES_PT


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


# --- metric repair -----------------------------------------------------------

def clamp_nonneg(col) -> Column:
    """Negative and NULL become 0; non-negative values pass through."""
    c = _c(col)
    return F.when(c >= 0, c).otherwise(F.lit(0))


def mask_nonneg(col) -> Column:
    """Keep non-negative values, everything else NULL (boolean-mask selection, F1)."""
    c = _c(col)
    return F.when(c >= 0, c)


def fill_zero(col) -> Column:
    """``fillna(0)``."""
    return F.coalesce(_c(col), F.lit(0))


def replace_negative(col, replacement, null_policy: str = "keep") -> Column:
    """Replace negative values by ``replacement``.

    ``null_policy="keep"``: a NULL metric stays NULL (``NULL < 0`` is not true).
    ``null_policy="repair"``: a NULL metric is replaced as well.
    Result type is the common supertype (double when the replacement is an average).
    """
    c, r = _c(col), _c(replacement)
    if null_policy == "keep":
        return F.when(c < 0, r).otherwise(c)
    if null_policy == "repair":
        return F.when(c >= 0, c).otherwise(r)
    raise ValueError(f"null_policy must be 'keep' or 'repair', got {null_policy!r}")


def ratio(numerator, denominator) -> Column:
    """Division that yields NULL for a zero or NULL denominator (ANSI-safe)."""
    return F.try_divide(_c(numerator).cast("double"), _c(denominator).cast("double"))


def engagement_rate(parts, impressions) -> Column:
    """(sum of interaction counts) / impressions, NULL when impressions is 0."""
    total = None
    for p in parts:
        total = _c(p) if total is None else total + _c(p)
    return ratio(total, impressions)


# --- dates -------------------------------------------------------------------

def period_end_date(year, month, period) -> Column:
    """Extraction date of a half-month extraction (C4).

    Period 2 ends on the last day of the month; any other period on the 15th.
    """
    y, m, p = _c(year).cast("int"), _c(month).cast("int"), _c(period).cast("int")
    first = F.make_date(y, m, F.lit(1))
    return F.when(p == 2, F.last_day(first)).otherwise(F.make_date(y, m, F.lit(15)))


def half_month_period(date_col) -> Column:
    """1 for days 1..15 of a month, 2 for the rest."""
    return F.when(F.dayofmonth(_c(date_col)) <= 15, F.lit(1)).otherwise(F.lit(2))


def _month_to_num() -> Column:
    return F.create_map(*chain.from_iterable((F.lit(n), F.lit(i + 1)) for i, n in enumerate(MONTH_NAMES_PT)))


def _num_to_month() -> Column:
    return F.create_map(*chain.from_iterable((F.lit(i + 1), F.lit(n)) for i, n in enumerate(MONTH_NAMES_PT)))


def month_number(name_col) -> Column:
    """Portuguese month folder name -> 1..12; unknown names give NULL."""
    return F.try_element_at(_month_to_num(), _c(name_col))


def month_name(num_col) -> Column:
    """1..12 -> Portuguese month folder name."""
    return F.try_element_at(_num_to_month(), _c(num_col).cast("int"))


def blank_to_null(col) -> Column:
    """``CASE WHEN c IS NULL OR c = '' THEN NULL ELSE c END``."""
    c = _c(col)
    return F.when(c.isNull() | (F.trim(c) == ""), F.lit(None)).otherwise(c)


def parse_date_strict(col, fmt: str = "M/d/yyyy") -> Column:
    """Strict parse (C7): blank -> NULL, malformed text raises under ANSI mode."""
    return F.to_date(blank_to_null(col), fmt)


def parse_date(col, order=None, excel_serial: bool = True) -> Column:
    """Lenient parse of one cell (C8/C9), NULL if no format admits it; see ``functions.dates``.

    ``order`` is what the cell's whole column admits (``dates.order_mask`` under ``bit_and``);
    without it ``1/2/2024`` is read month first. With ``excel_serial`` a numeric cell is read as
    a spreadsheet day serial, which is how workbooks store typed dates; a fractional part (time
    of day) is dropped.
    """
    return parse_text(blank_to_null(F.trim(_c(col).cast("string"))), order, excel_serial)


def round_half_even_long(col) -> Column:
    """DOUBLE -> BIGINT rounding half to even (C6), as an engine casting doubles
    into an integer column does; a plain Spark cast truncates."""
    return F.bround(_c(col), 0).cast("long")


# --- strings -----------------------------------------------------------------

def classify_category(name_col, else_value=None) -> Column:
    """First category whose name occurs in the file name, in fixed order (S3)."""
    c = _c(name_col)
    expr = None
    for cat in CATEGORY_ORDER:
        expr = F.when(c.contains(cat), F.lit(cat)) if expr is None else expr.when(c.contains(cat), F.lit(cat))
    return expr.otherwise(F.lit(else_value))


def file_name(path_col) -> Column:
    """Last path segment."""
    return F.element_at(F.split(_c(path_col), "/"), -1)


def dataset_name_from_file(path_col, prefix: str = "all_extractions_", suffix: str = ".csv") -> Column:
    """Strip a fixed prefix and extension from a file name."""
    import re

    pattern = "^" + re.escape(prefix) + "|" + re.escape(suffix) + "$"
    return F.regexp_replace(file_name(path_col), pattern, "")


def capitalize(col) -> Column:
    """Python ``str.capitalize``: first character upper, rest lower (C17)."""
    c = _c(col)
    return F.concat(F.upper(F.substring(c, 1, 1)), F.lower(F.substring(c, 2, 1 << 30)))


def bytes_to_mb(col, digits: int = 2) -> Column:
    """Bytes -> decimal megabytes rounded."""
    return F.round(_c(col).cast("double") / F.lit(1_000_000.0), digits)


def try_cast(col, dtype) -> Column:
    """Non-strict cast: unparsable values become NULL (C11)."""
    return _c(col).try_cast(dtype)
