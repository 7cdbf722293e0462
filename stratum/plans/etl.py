"""Step-by-step facade over the plans, in the order users of a per-file ETL
run it: extract -> transform -> load -> monthly / whole-history rollups ->
export, and for the incremental mode: read clean -> read new extraction ->
transform -> concatenate -> export.

Every step returns lazy DataFrames (one per dataset, not one per file) or
writes with Spark; nothing is collected to the driver.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.operators.setops import union_by_name
from stratum.plans.rebuild import accept, export_levels, load_datasets, stage_cells, staged_bytes, summary_of
from stratum.plans.transform import transform_dataset
from stratum.registry import SPECS
from stratum.sources.clean import read_dataset
from stratum.sources.files import discover_extractions, discover_single_extraction
from stratum.sources.xlsx import scan_cells


class CleanLayerETL:
    def __init__(self, spark: SparkSession, raw_root: str, clean_root: str, fmt: str = "parquet",
                 dialect: str = "quoted", null_policy: str = "keep", frame: str = "rows"):
        self.spark, self.raw_root, self.clean_root = spark, raw_root, clean_root
        self.fmt, self.dialect, self.null_policy, self.frame = fmt, dialect, null_policy, frame

    # --- strategy 1: full rebuild -------------------------------------------
    def extract_data(self) -> DataFrame:
        """Decode every workbook once into the staging table; returns the rows of the files
        that can be loaded (the others are reported in ``<clean>/_rejects``)."""
        files = discover_extractions(self.spark, self.raw_root)
        self._staging = os.path.join(self.clean_root, "_staging", "cells")
        staged = stage_cells(self.spark, scan_cells(self.spark, self.raw_root), files, self._staging)
        self._summary = summary_of(self.spark, staged, os.path.join(self.clean_root, "_staging", "summary"))
        return accept(self.spark, files, staged, os.path.join(self.clean_root, "_rejects"), self._summary)

    def transform_data(self, staged: DataFrame) -> dict:
        """{dataset: typed, stamped (and for content_metrics repaired) DataFrame}."""
        return {n: transform_dataset(staged, n, self.null_policy, self.frame, summary=getattr(self, "_summary", None)) for n in SPECS}

    def load_to_clean(self, staged: DataFrame) -> dict:
        """Write the per-extraction clean layer (partitioned by year/month/period)."""
        sizes = staged_bytes(self.spark, self._staging) if hasattr(self, "_staging") else {}
        return load_datasets(self.spark, staged, self.clean_root, self.fmt, self.dialect,
                             null_policy=self.null_policy, frame=self.frame, dynamic=False, sizes=sizes,
                             summary=getattr(self, "_summary", None))

    def concatenate_monthly_data(self, year: int, month: int) -> dict:
        """{dataset: all extractions of one month} -- a partition-pruned read."""
        return {n: self.clean_table(n).filter((F.col("year") == year) & (F.col("month") == month))
                for n in SPECS}

    def concatenate_category_data(self) -> dict:
        """{dataset: every extraction} -- the whole partitioned table."""
        return {n: self.clean_table(n) for n in SPECS}

    def export_data(self, levels=("month", "all")) -> dict:
        """Write month-level and whole-history copies (optional; the partitioned
        layer already serves both through partition pruning)."""
        return export_levels(self.spark, self.clean_root, self.fmt, self.dialect, levels)

    # --- strategy 2: incremental append ---------------------------------------
    def clean_table(self, name: str) -> DataFrame:
        return read_dataset(self.spark, self.clean_root, name, self.fmt, self.dialect)

    def get_clean_concatenated_data(self) -> dict:
        return self.concatenate_category_data()

    def get_raw_unique_extraction_data(self, folder: str, year: int, month: int, period: int) -> DataFrame:
        files = discover_single_extraction(self.spark, folder, year, month, period)
        label = f"{int(year)}_{int(month)}_{int(period)}"
        self._staging = os.path.join(self.clean_root, "_staging", f"cells_{label}")
        staged = stage_cells(self.spark, scan_cells(self.spark, folder, recursive=False), files, self._staging)
        self._summary = summary_of(self.spark, staged, os.path.join(self.clean_root, "_staging", f"summary_{label}"))
        return accept(self.spark, files, staged, os.path.join(self.clean_root, "_rejects_append", label), self._summary)

    def concatenate_unique_extraction_data(self, clean: dict, new: dict) -> dict:
        """{dataset: existing rows + new rows} as a lazy by-name union (a view, nothing copied)."""
        return {n: union_by_name([clean[n], new[n]]) if n in clean else new[n] for n in new}

    def export_dataframes(self, staged_new: DataFrame) -> dict:
        """Persist the new extraction: overwrite only its own partitions (O(new))."""
        return load_datasets(self.spark, staged_new, self.clean_root, self.fmt, self.dialect,
                             null_policy=self.null_policy, frame=self.frame, dynamic=True, cluster=False,
                             summary=getattr(self, "_summary", None))
