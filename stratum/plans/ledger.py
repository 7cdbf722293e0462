"""Rebuild that decodes only new and changed workbooks.

``<clean>/_ledger/<run>`` has one row per workbook that the clean layer holds: its length and
modification time, the SHA-256 of its bytes, its extraction and the run that decoded it. A run

1. compares the listing with the ledger. A file of unchanged length and time is unchanged; of the
   others the bytes are digested, and only those with another digest are decoded, into the
   run's own batch of ``<clean>/_staging/batches``;
2. finds the touched extractions: of files that are new, changed, gone, or whose rank in their
   month folder (the period) has moved;
3. loads the touched extractions from the live batches (rows of a file count in the batch that
   its ledger row names, so an older batch's rows of a changed or deleted file are retracted)
   and overwrites their partitions, or removes them where nothing is left;
4. writes the new ledger last. A run that is stopped before is done again as if it had not been.

The result is that of a fresh rebuild. Drivers hold the changed files' names and the touched
extractions, as Spark's own file index holds all names.
"""

from __future__ import annotations

import os
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.plans import history as whole_history
from stratum.plans.append import partition_path, refresh_months
from stratum.plans.profile_store import maintain
from stratum.plans.rebuild import _concurrently, export_levels, load_datasets, report_failures, rejects
from stratum.plans.transform import date_orders, loadable, summarise, transform_dataset
from stratum.registry import PARTITION_COLS, SPECS
from stratum.sinks.writers import write_table
from stratum.sources.clean import dataset_path
from stratum.sources.files import accepted_files, discover_extractions
from stratum.sources.history import exists, hadoop, manifest
from stratum.sources.xlsx import CELLS_SCHEMA, decode_files

LEDGER = "path string, length long, modified timestamp, digest string, category string, year int, month int, period int, batch int"


def _runs(spark: SparkSession, clean_root: str) -> list[int]:
    """Ledgers that were written to their end."""
    fs, p = hadoop(spark, os.path.join(clean_root, "_ledger"))
    if not fs.exists(p):
        return []
    names = [f.getPath().getName() for f in fs.listStatus(p)]
    return sorted(int(n) for n in names if n.isdigit() and exists(spark, os.path.join(clean_root, "_ledger", n, "_SUCCESS")))


def read_ledger(spark: SparkSession, clean_root: str) -> tuple[int, DataFrame]:
    """(number of the last run, its ledger); run 0 has an empty one."""
    runs = _runs(spark, clean_root)
    if not runs:
        return 0, spark.createDataFrame([], LEDGER)
    return runs[-1], spark.read.schema(LEDGER).parquet(os.path.join(clean_root, "_ledger", str(runs[-1])))


def summary_schema(spark: SparkSession):
    """Schema of the stored summaries."""
    return summarise(spark.createDataFrame([], CELLS_SCHEMA)).withColumn("reported_run", F.lit(0)).schema


def compare(listing: DataFrame, ledger: DataFrame) -> DataFrame:
    """Every file of either side; ``stale`` if its bytes have to be looked at."""
    new = listing.select("path", "length", F.col("modificationTime").alias("modified"), "category", *[F.col(c).cast("int").alias(c) for c in PARTITION_COLS])
    old = ledger.select("path", *[F.col(c).alias(f"old_{c}") for c in ledger.columns if c != "path"])
    both = new.join(old, "path", "full")
    same = F.col("length").eqNullSafe(F.col("old_length")) & F.col("modified").eqNullSafe(F.col("old_modified"))
    return both.withColumn("stale", F.col("length").isNotNull() & ~same)


def refresh(spark: SparkSession, raw_root: str, clean_root: str, fmt: str = "parquet", dialect: str = "quoted",
            levels=(), null_policy: str = "keep", frame: str = "rows", parallelism: int = 8) -> dict:
    """Bring ``clean_root`` up to date with ``raw_root``; returns timings and the numbers of
    files ``decoded`` and of extractions ``touched``."""
    t_all = time.perf_counter()
    at = lambda *p: os.path.join(clean_root, *p)
    last, ledger = read_ledger(spark, clean_root)
    run = last + 1
    files = discover_extractions(spark, raw_root)
    write_table(compare(accepted_files(files), ledger), at("_staging", "compared"), dynamic_overwrite=False)
    both = spark.read.parquet(at("_staging", "compared"))

    # the bytes of files whose length or time differs
    stale = [r["path"] for r in both.filter("stale").select("path").collect()]
    found = both.withColumn("new_digest", F.col("old_digest"))
    if stale:
        digests = spark.read.format("binaryFile").load(stale).select("path", F.sha2("content", 256).alias("seen"))
        write_table(digests, at("_staging", "digests"), dynamic_overwrite=False)
        found = both.join(spark.read.parquet(at("_staging", "digests")), "path", "left").withColumn("new_digest", F.coalesce("seen", "old_digest"))
    changed = [r["path"] for r in found.filter("stale and not (new_digest <=> old_digest)").select("path").collect()]
    if changed:
        cells = decode_files(spark, spark.read.format("binaryFile").load(changed))
        write_table(cells, at("_staging", "batches", f"batch={run}"), partition_by=["dataset"], dynamic_overwrite=False)
    batch = F.when(F.col("path").isin(changed) if len(changed) < 1000 else F.col("stale") & ~F.col("new_digest").eqNullSafe(F.col("old_digest")), F.lit(run)).otherwise(F.col("old_batch"))
    now = found.filter("length is not null").select("path", "length", "modified", F.col("new_digest").alias("digest"), "category", *PARTITION_COLS, batch.cast("int").alias("batch"))
    write_table(now, at("_staging", "ledger"), dynamic_overwrite=False)
    now = spark.read.schema(LEDGER).parquet(at("_staging", "ledger"))

    # extractions of files that are new, changed, gone or moved
    was = ledger.select("path", *[F.col(c).alias(f"old_{c}") for c in ("category", *PARTITION_COLS, "batch")])
    pairs = now.join(was, "path", "full")
    moved = [~F.col(c).eqNullSafe(F.col(f"old_{c}")) for c in ("category", *PARTITION_COLS, "batch")]
    moved = pairs.filter(moved[0] | moved[1] | moved[2] | moved[3] | moved[4])
    keys = ["category", *PARTITION_COLS]
    touched = moved.select(*keys).union(moved.select(*[F.col(f"old_{c}") for c in keys])).filter("category is not null").distinct()
    touched = [tuple(r) for r in touched.collect()]
    timings = {"decoded": len(changed), "touched": len(touched), "extract_data": time.perf_counter() - t_all}

    t0 = time.perf_counter()
    if touched:
        schema = CELLS_SCHEMA + ", batch int"
        staged = spark.read.schema(schema).parquet(at("_staging", "batches")) if exists(spark, at("_staging", "batches")) else spark.createDataFrame([], schema)
        live = now.select(F.col("path").alias("source_file"), "batch", *PARTITION_COLS)
        mine = spark.createDataFrame(touched, "category string, year int, month int, period int")
        live = live.join(now.join(mine, keys, "left_semi").select(F.col("path").alias("source_file")), "source_file", "left_semi")
        staged = staged.join(live, ["source_file", "batch"]).drop("batch")
        write_table(summarise(staged), at("_staging", "touched_summary"), dynamic_overwrite=False)
        summary = spark.read.schema(summarise(staged).schema).parquet(at("_staging", "touched_summary"))
        # the summaries of files that no touched extraction holds stay as they were
        keep = at("_ledger_summary", str(last))
        every = summary.withColumn("reported_run", F.lit(run))
        if last and exists(spark, keep):
            before = spark.read.schema(every.schema).parquet(keep)
            gone = summary.select("source_file").distinct()
            every = before.join(gone, "source_file", "left_anti").join(now.select(F.col("path").alias("source_file")), "source_file", "left_semi").unionByName(every)
        write_table(every, at("_ledger_summary", str(run)), dynamic_overwrite=False)
        every = spark.read.schema(every.schema).parquet(at("_ledger_summary", str(run)))
        write_table(rejects(files, every), at("_rejects"))
        write_table(date_orders(every), at("_date_orders"))
        bad = spark.read.schema("path string, reason string").parquet(at("_rejects"))
        good = loadable(staged, bad)
        sound = summary.join(bad.select(F.col("path").alias("source_file")), "source_file", "left_anti").filter("n_rows > 0")
        where = sound.join(live.drop("batch"), "source_file").select("dataset", *PARTITION_COLS).distinct()
        present = {(r["dataset"], (r["year"], r["month"], r["period"])) for r in where.collect()}  # of the touched extractions
        names = [n for n, s in SPECS.items() if any(k[0] == s.category for k in touched)]
        replaced = {n: [k[1:] for k in touched if k[0] == SPECS[n].category and exists(spark, partition_path(clean_root, n, k[1:]))] for n in names}
        full = [n for n in names if any(d == n for d, _ in present)]
        failed: dict = {}
        load_datasets(spark, good, clean_root, fmt, dialect, datasets=full, null_policy=null_policy, frame=frame,
                      parallelism=parallelism, dynamic=True, summary=summary, failed=failed)
        for n in names:
            for key in replaced[n]:
                if (n, key) not in present:
                    fs, p = hadoop(spark, partition_path(clean_root, n, key))
                    fs.delete(p, True)
        report_failures(good, failed, at("_rejects_cells_refresh", str(run)), summary)
        timings["load_to_clean"] = time.perf_counter() - t0
        t0 = time.perf_counter()
        rows = lambda n: transform_dataset(good, n, null_policy, frame, summary=summary)
        submit = lambda fn, items: _concurrently(fn, items, parallelism)
        if "month" in levels and not exists(spark, at("monthly")):
            export_levels(spark, clean_root, fmt, dialect, ("month",), parallelism=parallelism)
        else:
            refresh_months(spark, clean_root, sorted({k[1:3] for k in touched}), names, fmt, dialect, parallelism)
        if manifest(spark, clean_root) is not None:
            whole_history.add(spark, {n: rows(n) for n in full}, clean_root, {n: k for n, k in replaced.items() if k}, fmt, dialect, submit)
        elif "all" in levels:
            export_levels(spark, clean_root, fmt, dialect, ("all",), parallelism=parallelism)
        if exists(spark, at("_profile")):
            maintain(spark, clean_root, sorted({k[1:] for k in touched}), fmt, dialect)
        timings["export_data"] = time.perf_counter() - t0
    for n in SPECS:  # a dataset that nothing was loaded of reads as an empty table
        for path in [dataset_path(clean_root, n)]:
            fs, p = hadoop(spark, path)
            fs.mkdirs(p)
    if touched or stale or not last:
        if not touched and last:  # other times, the same bytes: the summaries stay
            kept = spark.read.schema(summary_schema(spark)).parquet(at("_ledger_summary", str(last)))
            write_table(kept, at("_ledger_summary", str(run)), dynamic_overwrite=False)
        write_table(now, at("_ledger", str(run)), dynamic_overwrite=False)
        for old in _runs(spark, clean_root)[:-2]:
            for name in ("_ledger", "_ledger_summary"):
                fs, p = hadoop(spark, at(name, str(old)))
                fs.delete(p, True)
    timings["total_etl_time"] = time.perf_counter() - t_all
    return timings
