"""Incremental append of one new extraction to the clean layer.

Only the new extraction is decoded and transformed, and only its own
``(year, month, period)`` partition of every dataset is (over)written --
O(new data), where rebuilding the merged table would be O(all data).
Re-running the same extraction replaces its partition (idempotent) instead
of duplicating rows. Copies that exist follow: the touched month of the month level, and the
whole-history level by one more set of files and a new manifest (``plans.history``). Readers see
the union of all extractions through ``sources.clean.read_dataset``.
"""

from __future__ import annotations

import os
import time
from functools import reduce

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from stratum.plans import history as whole_history
from stratum.plans.rebuild import _concurrently, accept, datasets_with_rows, load_datasets, report_failures, stage_cells, summary_of
from stratum.plans.transform import transform_dataset
from stratum.registry import SPECS
from stratum.sinks.writers import write_table
from stratum.sources.clean import dataset_path, read_dataset
from stratum.sources.files import discover_single_extraction
from stratum.sources.history import exists, hadoop, manifest
from stratum.sources.xlsx import scan_cells


def kept_categories(files, rejected, replace_absent: bool = False) -> set:
    """Categories whose loaded rows an append must not clear: those with a rejected workbook
    and, unless ``replace_absent``, those without any workbook."""
    bad = rejected.select("path").distinct().withColumn("bad", F.lit(True))
    seen = files.filter(F.col("category").isNotNull()).join(bad, "path", "left")
    by = {r["category"]: r["bad"] for r in seen.groupBy("category").agg(F.max(F.coalesce("bad", F.lit(False))).alias("bad")).collect()}  # at most 4
    absent = set() if replace_absent else {s.category for s in SPECS.values()} - set(by)
    return absent | {c for c, is_bad in by.items() if is_bad}


def partition_path(clean_root: str, name: str, key: tuple) -> str:
    year, month, period = (int(x) for x in key)
    return os.path.join(dataset_path(clean_root, name), f"year={year}", f"month={month}", f"period={period}")


def any_file(spark: SparkSession, folder: str) -> bool:
    """True if a folder of extraction folders holds any."""
    fs, p = hadoop(spark, folder)
    return fs.exists(p) and len(fs.listStatus(p)) > 0


def refresh_months(spark: SparkSession, clean_root: str, months, names, fmt: str, dialect: str, parallelism: int) -> None:
    """Bring the touched months [(year, month)] of the month level up to date, where it exists."""

    def one(name):
        if not exists(spark, dataset_path(clean_root, name, "monthly")):
            return
        folder = lambda level, y, m: os.path.join(dataset_path(clean_root, name, level), f"year={int(y)}", f"month={int(m)}")
        left = [(y, m) for y, m in months if any_file(spark, folder("extractions", y, m))]
        if left:
            touched = [(F.col("year") == int(y)) & (F.col("month") == int(m)) for y, m in left]
            # one file per extraction, bounded by its workbook
            own = read_dataset(spark, clean_root, name, fmt, dialect, split=False).filter(reduce(lambda a, b: a | b, touched))
            write_table(own, dataset_path(clean_root, name, "monthly"), fmt=fmt, dialect=dialect, partition_by=["year", "month"])
        for y, m in set(months) - set(left):
            fs, p = hadoop(spark, folder("monthly", y, m))
            fs.delete(p, True)

    if exists(spark, os.path.join(clean_root, "monthly")):
        _concurrently(one, list(names), parallelism)


def append_extraction(spark: SparkSession, incoming: str, clean_root: str, year: int, month: int, period: int,
                      fmt: str = "parquet", dialect: str = "quoted", null_policy: str = "keep",
                      frame: str = "rows", parallelism: int = 15, replace_absent: bool = False) -> dict:
    """Add the workbooks in flat folder ``incoming`` as extraction (year, month, period).

    Datasets of the folder's categories are replaced; a category that the folder lacks keeps
    what was loaded of it, unless ``replace_absent`` says that the folder is the whole
    extraction. A category with a rejected workbook never loses the datasets it brings no rows for.
    """
    t_all = time.perf_counter()
    timings = {}
    key = (int(year), int(month), int(period))
    label = "_".join(map(str, key))
    files = discover_single_extraction(spark, incoming, *key)
    t0 = time.perf_counter()
    staging = os.path.join(clean_root, "_staging", f"cells_{label}")
    staged = stage_cells(spark, scan_cells(spark, incoming, recursive=False), files, staging)
    summary = summary_of(spark, staged, os.path.join(clean_root, "_staging", f"summary_{label}"))
    rejects_path = os.path.join(clean_root, "_rejects_append", label)
    good = accept(spark, files, staged, rejects_path, summary)
    bad = spark.read.schema("path string, reason string").parquet(rejects_path)
    kept = kept_categories(files, bad, replace_absent)
    timings["get_raw_unique_extraction_data"] = time.perf_counter() - t0

    t0 = time.perf_counter()
    present = datasets_with_rows(spark, summary, rejects_path)
    cleared = [n for n, s in SPECS.items() if n not in present and s.category not in kept]
    before = {n for n in (*present, *cleared) if exists(spark, partition_path(clean_root, n, key))}
    failed: dict = {}
    load_datasets(spark, good, clean_root, fmt, dialect, datasets=present, null_policy=null_policy, frame=frame,
                  parallelism=parallelism, mode="overwrite", dynamic=True, cluster=False, summary=summary, failed=failed)
    for n in before & set(cleared):
        fs, p = hadoop(spark, partition_path(clean_root, n, key))
        fs.delete(p, True)
    report_failures(good, failed, os.path.join(clean_root, "_rejects_cells_append", label), summary)
    refresh_months(spark, clean_root, [key[:2]], {*present, *(before & set(cleared))}, fmt, dialect, parallelism)
    if manifest(spark, clean_root) is not None:
        new = {n: transform_dataset(good, n, null_policy, frame, summary=summary) for n in present}
        whole_history.add(spark, new, clean_root, {n: [key] for n in before}, fmt, dialect, lambda fn, items: _concurrently(fn, items, parallelism))
    if exists(spark, os.path.join(clean_root, "_profile")):
        from stratum.plans.profile_store import maintain

        maintain(spark, clean_root, [key], fmt, dialect)
    timings["export_dataframes"] = time.perf_counter() - t0
    timings["total_etl_time"] = time.perf_counter() - t_all
    return timings


def merged_view(spark: SparkSession, clean_root: str, name: str, fmt: str = "parquet", dialect: str = "quoted"):
    """Existing extractions and the appended one as a single DataFrame."""
    return read_dataset(spark, clean_root, name, fmt, dialect)
