"""Dates in text: one parse per cell by its shape, the order of day and month by column.

Every shape but ``n/n/yyyy`` tells its format by itself. What ``1/2/2024`` means is settled by
the whole column of a file: each such cell admits month first, day first or both (``order_mask``,
two bits); the bitwise AND over the column is what all of them admit. One bit left settles the
column; both left is ambiguous and read as month first, the exports' own order; none left is a
mixed column, in which each cell is read in the only order it admits, month first if in doubt.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONTH_FIRST, DAY_FIRST = 1, 2
#: What a column's mask says, by its value.
ORDERS = {0: "mixed", MONTH_FIRST: "month first", DAY_FIRST: "day first", MONTH_FIRST | DAY_FIRST: "ambiguous"}

_TIME = r"([01]?\d|2[0-3]):[0-5]\d(:[0-5]\d)?"
SLASH = rf"^\d{{1,2}}/\d{{1,2}}/\d{{4}}( {_TIME})?$"
ISO = r"^\d{4}-\d{2}-\d{2}([ T]([01]\d|2[0-3]):[0-5]\d:[0-5]\d)?$"
SERIAL = r"^\d{1,6}(\.\d+)?$"
#: Other shapes: pattern, format.
SHAPES = (
    (r"^\d{4}/\d{2}/\d{2}$", "yyyy/MM/dd"),
    (r"^\d{8}$", "yyyyMMdd"),
    (r"^\d{1,2} [A-Za-z]{3} \d{4}$", "d MMM yyyy"),
    (r"^\d{1,2} [A-Za-z]{4,} \d{4}$", "d MMMM yyyy"),
    (r"^[A-Za-z]{3} \d{1,2}, \d{4}$", "MMM d, yyyy"),
    (r"^[A-Za-z]{4,} \d{1,2}, \d{4}$", "MMMM d, yyyy"),
)


def order_mask(text: Column) -> Column:
    """The orders that a trimmed cell admits, as bits; NULL if it isn't of the shape ``n/n/yyyy``."""
    part = F.split(text, "/")
    a, b = (F.get(part, F.lit(i)).cast("int") for i in (0, 1))
    longest = F.array(*[F.lit(n) for n in (31, 29, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)])
    month = F.when(b.between(F.lit(1), F.get(longest, a - 1)), F.lit(MONTH_FIRST)).otherwise(F.lit(0))
    day = F.when(a.between(F.lit(1), F.get(longest, b - 1)), F.lit(DAY_FIRST)).otherwise(F.lit(0))
    # a cell that no order admits says nothing about the column
    return F.when(text.rlike(SLASH), F.nullif(month.bitwiseOR(day), F.lit(0)))


def parse_text(text: Column, order: Column | None = None, excel_serial: bool = True) -> Column:
    """A trimmed cell as a date, NULL if no format admits it; ``order`` is its column's mask
    (None: month first). With ``excel_serial`` a number is a day serial since 1899-12-30."""
    slash = F.get(F.split(text, " "), F.lit(0))
    month, day = F.try_to_date(slash, "M/d/yyyy"), F.try_to_date(slash, "d/M/yyyy")
    if order is not None:
        month = F.when(order == DAY_FIRST, day).when(order == 0, F.coalesce(month, day)).otherwise(month)
    out = F.when(text.rlike(SLASH), month).when(text.rlike(ISO), F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd"))
    if excel_serial:
        out = out.when(text.rlike(SERIAL), F.date_add(F.lit("1899-12-30").cast("date"), F.get(F.split(text, r"\."), F.lit(0)).cast("int")))
    for shape, fmt in SHAPES:
        out = out.when(text.rlike(shape), F.try_to_date(text, fmt))
    return out
