"""Full rebuild of the clean layer from a raw extraction tree.

Jobs, in order:

1. **extract** -- one scan decodes every workbook (``mapInArrow``), joins the
   rows to the file listing (year/month/period) and writes the staging table
   ``<clean>/_staging/cells`` partitioned by dataset. This is the only pass
   over workbook bytes and it cuts the lineage for everything after it. One aggregate over the
   staged cells tells, per file and sheet, what can't be loaded, how its dates are read and how
   many rows it has (``_staging/summary``, ``_rejects``, ``_date_orders``).
2. **load** -- per dataset: read its staging partition, type, stamp, repair,
   write ``<clean>/extractions/<dataset>/year=/month=/period=``. The 15 writes
   are independent jobs and are submitted concurrently. Cells that their type can't hold are
   counted in the same pass; only datasets with any are scanned for them (``_rejects_cells``).
3. **export (optional)** -- month level (``partitionBy(year, month)``) and
   whole-history level (``plans.history``), from the staged rows once more.

Timings per stage are returned (and can be appended to a metrics table).
"""

from __future__ import annotations

import os
import time
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from stratum.plans import history as whole_history
from stratum.plans.transform import (
    attach_extraction, conversion_failures, date_orders, loadable, summarise, summary_rejects, transform_dataset)
from stratum.registry import PARTITION_COLS, SPECS
from stratum.sinks.writers import write_table
from stratum.sources.clean import dataset_path, read_dataset
from stratum.sources.files import discover_extractions, rejected_files
from stratum.sources.xlsx import scan_cells


def stage_cells(spark: SparkSession, cells: DataFrame, files: DataFrame, staging: str) -> DataFrame:
    """Decode once, persist to the shared clean root, read back (lineage cut)."""
    write_table(attach_extraction(cells, files), staging, partition_by=["dataset"], dynamic_overwrite=False)
    return spark.read.parquet(staging)


TARGET_WRITE_BYTES = 128 << 20


def staged_bytes(spark: SparkSession, staging: str) -> dict:
    """Bytes of staging data per dataset, from a content-pruned file listing."""
    listing = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
               .option("pathGlobFilter", "*.parquet").load(staging).select("path", "length"))
    per = (listing.withColumn("dataset", F.regexp_extract("path", r"/dataset=([^/]+)/", 1))
           .groupBy("dataset").agg(F.sum("length").alias("bytes")))
    return {r["dataset"]: int(r["bytes"]) for r in per.collect()}  # at most one row per dataset


def write_partitions(spark: SparkSession, nbytes: int) -> int:
    """Write tasks for a dataset: its bytes / 128 MB, never fewer than the cluster's cores.

    Clustering by extraction keys with an explicit count keeps every core busy
    on small layers (AQE would coalesce them into a handful of tasks that each
    create hundreds of partition files) and grows with the data on large ones.
    """
    return max(spark.sparkContext.defaultParallelism, -(-int(nbytes) // TARGET_WRITE_BYTES))


def summary_of(spark: SparkSession, staged: DataFrame, path: str) -> DataFrame:
    """``summarise`` written to ``path`` and read back: one row per file and dataset."""
    out = summarise(staged)
    write_table(out, path)
    return spark.read.schema(out.schema).parquet(path)


def rejects(files: DataFrame, summary: DataFrame) -> DataFrame:
    """Files that were not loaded, with the reason: unclassified name or unknown
    folder, undecodable workbook, or a sheet whose width differs from the registry."""
    return rejected_files(files).select("path", F.lit("unclassified file").alias("reason")).unionByName(summary_rejects(summary))


def datasets_with_rows(spark: SparkSession, summary: DataFrame, rejects_path: str) -> list[str]:
    """The datasets (at most 15) that the files which weren't rejected have rows of."""
    bad = spark.read.schema("path string, reason string").parquet(rejects_path)
    sound = summary.join(bad.select(F.col("path").alias("source_file")), "source_file", "left_anti")
    return sorted(r["dataset"] for r in sound.filter("n_rows > 0").select("dataset").distinct().collect())


def accept(spark: SparkSession, files: DataFrame, staged: DataFrame, path: str, summary: DataFrame) -> DataFrame:
    """Write the rejects and return the staged rows of all other files."""
    write_table(rejects(files, summary), path)
    bad = spark.read.schema("path string, reason string").parquet(path)
    return staged if bad.isEmpty() else loadable(staged, bad)


def _concurrently(fn, items, parallelism: int):
    """Submit independent write jobs together (the scheduler interleaves their tasks)."""
    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
        return list(pool.map(fn, items))


def load_datasets(spark: SparkSession, staged: DataFrame, clean_root: str, fmt: str = "parquet",
                  dialect: str = "quoted", datasets=None, null_policy: str = "keep", frame: str = "rows",
                  parallelism: int = 8, mode: str = "overwrite", dynamic: bool = True,
                  sizes: dict | None = None, cluster: bool = True, summary: DataFrame | None = None,
                  failed: dict | None = None, present=None) -> dict:
    """Transform and write each dataset; returns {dataset: path}.

    Rows are clustered by extraction before the write so each extraction
    partition is written by one task as one file (an extraction is bounded by
    its workbook), and AQE sizes the number of write tasks.
    ``dynamic=True`` replaces only the partitions present (append);
    a full rebuild into a fresh location uses a static overwrite.
    ``cluster=False`` skips the clustering shuffle (one extraction: it is
    already a single partition). ``failed`` receives {dataset: cells that became NULL} of the
    datasets ``present``, those that have rows (an observation of no row has no value).
    """
    names = list(SPECS if datasets is None else datasets)
    sizes = sizes or {}

    def one(name):
        seen = Observation() if failed is not None and (present is None or name in present) else None
        out = transform_dataset(staged, name, null_policy=null_policy, frame=frame, summary=summary, failed=seen)
        path = dataset_path(clean_root, name)
        if cluster:
            out = out.repartition(write_partitions(spark, sizes.get(name, 0)), *PARTITION_COLS)
        write_table(out, path, fmt=fmt, dialect=dialect,
                    partition_by=PARTITION_COLS, mode=mode, dynamic_overwrite=dynamic)
        if seen is not None:
            failed[name] = seen.get.get("cells") or 0
        return name, path

    return dict(_concurrently(one, names, parallelism))


def report_failures(staged: DataFrame, failed: dict, path: str, summary: DataFrame | None = None) -> None:
    """Write the cells that became NULL; only datasets that have any are scanned."""
    write_table(conversion_failures(staged, [n for n in SPECS if failed.get(n)], summary), path)


def export_levels(spark: SparkSession, clean_root: str, fmt: str = "parquet", dialect: str = "quoted",
                  levels=("month", "all"), datasets=None, parallelism: int = 8, sizes: dict | None = None,
                  rows=None) -> dict:
    """Month-level and whole-history copies of every dataset.

    ``rows(dataset)`` are their rows, by default the clean table read back; readers can equally
    use the partitioned table with a year/month filter.
    """
    timings = {}
    names = list(datasets or SPECS)
    sizes = sizes or {}
    rows = rows or (lambda n: read_dataset(spark, clean_root, n, fmt, dialect))
    if "month" in levels:
        t0 = time.perf_counter()

        def month(n):
            parts = write_partitions(spark, sizes.get(n, 0))
            # one file per extraction and month folder: no task gathers a whole month
            write_table(rows(n).repartition(parts, *PARTITION_COLS, "source_file"), dataset_path(clean_root, n, "monthly"), fmt=fmt,
                        dialect=dialect, partition_by=["year", "month"], dynamic_overwrite=False)

        _concurrently(month, names, parallelism)
        timings["export_monthly_data"] = time.perf_counter() - t0
    if "all" in levels:
        t0 = time.perf_counter()
        whole_history.start(spark, {n: rows(n) for n in names}, clean_root, fmt, dialect, lambda fn, items: _concurrently(fn, items, parallelism))
        whole_history.vacuum(spark, clean_root)
        timings["export_category_data"] = time.perf_counter() - t0
    return timings


def rebuild(spark: SparkSession, raw_root: str, clean_root: str, fmt: str = "parquet", dialect: str = "quoted",
            levels=(), null_policy: str = "keep", frame: str = "rows", parallelism: int = 8) -> dict:
    """Rebuild ``clean_root`` from ``raw_root``; returns stage timings (rejects go to ``<clean>/_rejects``)."""
    t_all = time.perf_counter()
    timings = {}
    files = discover_extractions(spark, raw_root)
    t0 = time.perf_counter()
    staging = os.path.join(clean_root, "_staging", "cells")
    staged = stage_cells(spark, scan_cells(spark, raw_root), files, staging)
    summary = summary_of(spark, staged, os.path.join(clean_root, "_staging", "summary"))
    good = accept(spark, files, staged, os.path.join(clean_root, "_rejects"), summary)
    timings["extract_data"] = time.perf_counter() - t0

    t0 = time.perf_counter()
    sizes = staged_bytes(spark, staging)
    write_table(date_orders(summary), os.path.join(clean_root, "_date_orders"))
    failed: dict = {}
    present = datasets_with_rows(spark, summary, os.path.join(clean_root, "_rejects"))
    load_datasets(spark, good, clean_root, fmt, dialect, null_policy=null_policy, frame=frame,
                  parallelism=parallelism, dynamic=False, sizes=sizes, summary=summary, failed=failed, present=present)
    report_failures(good, failed, os.path.join(clean_root, "_rejects_cells"), summary)
    timings["load_to_clean"] = time.perf_counter() - t0

    timings.update(export_levels(spark, clean_root, fmt, dialect, levels, parallelism=parallelism, sizes=sizes,
                                 rows=lambda n: transform_dataset(good, n, null_policy, frame, summary=summary)))
    timings["total_etl_time"] = time.perf_counter() - t_all
    return timings
