"""Per-dataset transform: positional naming + typing, extraction stamp, repair."""

from __future__ import annotations

from functools import reduce
from itertools import chain

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from stratum.functions.columns import blank_to_null, period_end_date
from stratum.functions.dates import ORDERS, order_mask
from stratum.operators.columns import convert
from stratum.operators.repair import clean_content_metrics
from stratum.registry import EXTRACTION_RANGE, LINEAGE_COLS, PARTITION_COLS, SPECS

FAILURES = "source_file string, dataset string, sheet_row long, column string, text string"
BROADCAST_FILES = 100_000  # rows of a path and three numbers
STAGE_COLS = ["source_file", "dataset", "sheet_pos", "sheet_row", "cells", "error", "year", "month", "period"]


def attach_extraction(cells: DataFrame, files: DataFrame) -> DataFrame:
    """Join decoded rows to their file's year/month/period: one row per file on the right, which
    is broadcast unless there are very many files, so that the cells stay where they are."""
    meta = files.select(F.col("path").alias("source_file"), F.col("year").cast("int").alias("year"),
                        F.col("month").cast("int").alias("month"), F.col("period").cast("int").alias("period"))
    if files.count() <= BROADCAST_FILES:
        meta = F.broadcast(meta)
    return cells.join(meta, "source_file", "inner").select(*STAGE_COLS)


def _by_dataset(value) -> "F.Column":
    """A column that looks ``value(spec)`` up by the row's dataset."""
    pairs = chain.from_iterable((F.lit(s.name), F.lit(value(s))) for s in SPECS.values())
    return F.try_element_at(F.create_map(*pairs), F.col("dataset"))


DATE_POSITIONS = sorted({i for s in SPECS.values() for i, (c, _) in enumerate(s.columns) if c in s.date_columns})


def summarise(staged: DataFrame) -> DataFrame:
    """One row per (source_file, dataset) from one scan of the staged cells: decoding error,
    width of the header row, number of data rows, and what the cells of each date position
    admit together (``dates.order_mask`` under ``bit_and``; NULL: nothing to settle)."""
    lead = _by_dataset(lambda s: s.skip_rows)
    data = F.col("sheet_row") > lead
    masks = []
    for i in DATE_POSITIONS:
        own = [s.name for s in SPECS.values() if i < len(s.columns) and s.names[i] in s.date_columns]
        cell = F.when(data & F.col("dataset").isin(own), F.trim(F.get("cells", F.lit(i))))
        masks.append(F.bit_and(order_mask(cell)).alias(f"order_{i}"))
    return staged.groupBy("source_file", "dataset").agg(
        F.max("error").alias("error"),
        F.max(F.when(F.col("sheet_row") == lead, F.size("cells"))).alias("width"),
        F.count(F.when(data, 1)).alias("n_rows"), *masks)


def summary_rejects(summary: DataFrame) -> DataFrame:
    """(path, reason) of the decoded files that must not be loaded, from their summary: a
    workbook is loaded whole or not at all, and positional naming of a header of another width
    would shift columns."""
    expected = _by_dataset(lambda s: len(s.columns))
    wide = F.format_string("%s: %d columns, expected %d", "dataset", "width", expected)
    reason = F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("width") != expected, wide)
    return summary.select(F.col("source_file").alias("path"), reason.alias("reason")).filter("reason is not null")


def date_orders(summary: DataFrame) -> DataFrame:
    """(source_file, dataset, column, order): how each date column with cells such as 1/2/2024
    is read: month first, day first, ambiguous (month first) or mixed (cell by cell)."""
    cells = []
    for s in SPECS.values():
        for i, (c, _) in enumerate(s.columns):
            if c in s.date_columns:
                cells.append(F.when(F.col("dataset") == s.name, F.struct(F.lit(c).alias("column"), F.col(f"order_{i}").alias("mask"))))
    names = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in ORDERS.items()))
    each = summary.select("source_file", "dataset", F.explode(F.array_compact(F.array(*cells))).alias("c")).filter("c.mask is not null")
    return each.select("source_file", "dataset", "c.column", names[F.col("c.mask").cast("int")].alias("order"))


def typed_dataset(staged: DataFrame, name: str, strict: bool = False, summary: DataFrame | None = None,
                  failed: Observation | None = None) -> DataFrame:
    """Rows of one dataset, named by position and converted to declared types.

    Leading ``skip_rows`` rows and the header row are dropped (S6/O2);
    ``row_idx`` is the 0-based data-row position inside the sheet. Dates are read in the order
    that their column in the file settles (``summary``, found by a scan of its own if not given).
    ``failed`` observes, in the same pass, how many cells their type can't hold (``cells``).
    """
    s = SPECS[name]
    rows = staged.filter(F.col("dataset") == name).filter(F.col("sheet_row") > s.skip_rows)
    orders = {c: f"order_{i}" for i, c in enumerate(s.names) if c in s.date_columns}
    if orders:
        known = (summarise(staged.filter(F.col("dataset") == name)) if summary is None else summary).filter(F.col("dataset") == name)
        rows = rows.join(known.select("source_file", *orders.values()), "source_file", "left")
    cells = F.col("cells")
    typed_cols = [convert(F.get(cells, i), s.spark_type(col), strict, F.col(orders[col]) if col in orders else None).alias(col)
                  for i, (col, _) in enumerate(s.columns)]
    kept = [*[F.col(p) for p in PARTITION_COLS], F.col("source_file"), (F.col("sheet_row") - s.skip_rows - 1).alias("row_idx")]
    if failed is None:
        return rows.select(*typed_cols, *kept)
    typed = rows.select(*typed_cols, *kept, cells.alias("__cells"))
    bad = [(blank_to_null(F.get("__cells", i)).isNotNull() & F.col(f"`{col}`").isNull()).cast("long") for i, col in enumerate(s.names)]
    return typed.observe(failed, F.sum(reduce(lambda x, y: x + y, bad)).alias("cells")).drop("__cells")


def loadable(staged: DataFrame, bad: DataFrame) -> DataFrame:
    """Staged rows of the files that are not in ``bad`` (column ``path``)."""
    return staged.join(bad.select(F.col("path").alias("source_file")).distinct(), "source_file", "left_anti")


def conversion_failures(staged: DataFrame, names=None, summary: DataFrame | None = None) -> DataFrame:
    """(source_file, dataset, sheet_row, column, text) of every cell of the datasets ``names``
    that its declared type can't hold and that is therefore loaded as NULL."""
    parts = []
    for name in SPECS if names is None else names:
        s = SPECS[name]
        rows = staged.filter((F.col("dataset") == s.name) & (F.col("sheet_row") > s.skip_rows))
        orders = {c: f"order_{i}" for i, c in enumerate(s.names) if c in s.date_columns}
        if orders:
            known = (summarise(staged.filter(F.col("dataset") == name)) if summary is None else summary).filter(F.col("dataset") == name)
            rows = rows.join(known.select("source_file", *orders.values()), "source_file", "left")
        checks = []
        for i, (col, _) in enumerate(s.columns):
            cell = blank_to_null(F.get("cells", F.lit(i)))
            bad = cell.isNotNull() & convert(cell, s.spark_type(col), False, F.col(orders[col]) if col in orders else None).isNull()
            checks.append(F.when(bad, F.struct(F.lit(col).alias("column"), cell.alias("text"))))
        parts.append(rows.select("source_file", "dataset", "sheet_row", F.explode(F.array_compact(F.array(*checks))).alias("c"))
                     .select("source_file", "dataset", "sheet_row", "c.column", "c.text"))
    if not parts:
        return staged.sparkSession.createDataFrame([], FAILURES)
    return reduce(DataFrame.unionByName, parts)


def transform_dataset(staged: DataFrame, name: str, null_policy: str = "keep", frame: str = "rows",
                      strict: bool = False, summary: DataFrame | None = None, failed: Observation | None = None) -> DataFrame:
    """Typed rows + ``Extraction Range``; the repaired kernel for content_metrics."""
    typed = typed_dataset(staged, name, strict, summary, failed)
    stamped = typed.withColumn(EXTRACTION_RANGE, period_end_date("year", "month", "period"))
    if SPECS[name].repair:
        return clean_content_metrics(stamped, null_policy=null_policy, frame=frame)
    return stamped.select(*SPECS[name].names, EXTRACTION_RANGE, *PARTITION_COLS, *LINEAGE_COLS)
