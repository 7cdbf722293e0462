"""Clean-layer readers (S8/S9/S11): declared schemas, never inferred.

Two layouts are read:

* the partitioned layer written by ``plans.rebuild`` --
  ``<root>/<level>/<dataset>/year=/month=/period=`` (parquet or CSV);
* a flat folder of one CSV per dataset named ``<prefix><dataset>.csv``.

CSV text fields can span lines; ``split_csv`` reads such files in as many tasks as they have
splits.
"""

from __future__ import annotations

import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratum.functions.columns import dataset_name_from_file
from stratum.registry import LINEAGE_COLS, PARTITION_COLS, SPECS, clean_schema
from stratum.sinks.writers import csv_options
from stratum.sources import history
from stratum.sources.split_csv import read_split_csv

LINEAGE_FIELDS = [T.StructField("source_file", T.StringType()), T.StructField("row_idx", T.LongType())]


def dataset_path(root: str, name: str, level: str = "extractions") -> str:
    return os.path.join(root, level, name)


def read_csv(spark: SparkSession, path: str, schema: T.StructType, dialect: str = "quoted", folders: T.StructType | None = None,
             file_col: str | None = None) -> DataFrame:
    return read_split_csv(spark, path, schema, csv_options(dialect) | {"dateFormat": "yyyy-MM-dd"}, folders, file_col)


def read_dataset(spark: SparkSession, root: str, name: str, fmt: str = "parquet", dialect: str = "quoted",
                 level: str = "extractions", lineage: bool = True, split: bool = True) -> DataFrame:
    """A clean dataset as one DataFrame over all its extractions (U6 view);
    filtering on year/month/period prunes partitions (U5 view). ``split=False`` reads each CSV
    file in one task, for files that are known to be small."""
    if level == history.LEVEL:
        fields = T.StructType([*clean_schema(name).fields, *LINEAGE_FIELDS])
        sets = (history.manifest(spark, root) or {"sets": {}})["sets"].get(name, [])
        whole = history.read_sets(spark, root, sets, fields, fmt, csv_options(dialect) | {"dateFormat": "yyyy-MM-dd"})
        return whole if lineage else whole.drop(*LINEAGE_COLS)
    path = dataset_path(root, name, level)
    fields = list(clean_schema(name).fields) + (LINEAGE_FIELDS if lineage else [])
    keys = [T.StructField(c, T.IntegerType()) for c in PARTITION_COLS]
    # declared, so that a dataset without rows reads as an empty table
    if fmt == "parquet":
        return spark.read.schema(T.StructType(fields + keys)).parquet(path)
    inside, folders = (fields, keys) if level == "extractions" else ([*fields, keys[2]], keys[:2])
    if not split:
        opts = {k: v for k, v in csv_options(dialect).items() if k != "quoteAll"}
        reader = spark.read.schema(T.StructType([*inside, *folders])).options(**opts)
        return reader.option("multiLine", "true").option("dateFormat", "yyyy-MM-dd").csv(path)
    return read_csv(spark, path, T.StructType(inside), dialect, T.StructType(folders))


def list_flat_datasets(spark: SparkSession, folder: str, prefix: str = "all_extractions_") -> DataFrame:
    """Dataset names present in a flat clean folder (S9): path-only listing. A dataset is one
    file, or one folder of part files as ``sinks.writers.write_flat`` leaves it."""
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length")
    table = F.regexp_extract("path", f"(/{re.escape(prefix)}[^/]+[.]csv)(?:/[^/]+)?$", 1)
    return listing.filter(table != "").withColumn("dataset", dataset_name_from_file(table, prefix=prefix))


def read_flat_clean(spark: SparkSession, folder: str, prefix: str = "all_extractions_",
                    dialect: str = "quoted", file_col: str | None = None) -> dict:
    """``{dataset: DataFrame}`` for a flat folder of per-dataset CSV files.

    One name per file of the folder is collected; each file is then read lazily, a
    registered dataset with its declared schema, any other with all its columns as text.
    """
    names = [r["dataset"] for r in list_flat_datasets(spark, folder, prefix).select("dataset").distinct().collect()]
    out = {}
    for n in sorted(set(names)):
        path = os.path.join(folder, f"{prefix}{n}.csv")
        if n in SPECS:
            out[n] = read_csv(spark, path, clean_schema(n), dialect, file_col=file_col)
        else:
            opts = csv_options(dialect)
            names = spark.read.options(**opts).option("multiLine", "true").csv(path).schema  # the first record
            out[n] = read_split_csv(spark, path, names, opts, file_col=file_col)
    return out


METRICS_M1 = ("environment string, engine string, extract_data double, transform_data double, "
              "load_to_clean double, concatenate_monthly_data double, export_monthly_data double, "
              "concatenate_category_data double, export_category_data double, total_etl_time double")
METRICS_M2 = ("environment string, engine string, get_clean_concatenated_data double, "
              "get_raw_unique_extraction_data double, transform_data double, "
              "concatenate_unique_extraction_data double, export_dataframes double, total_etl_time double")
PROFILE_M1 = "environment string, num_files long, num_tables long, total_columns long, total_rows long"
PROFILE_M2 = "environment string, initial_clean_dataframe_size_MB double, num_files long, num_lines long"


def read_metrics_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Run-metric / environment tables (S11), every row of them."""
    return spark.read.schema(schema).option("header", "true").csv(path)


def lineage_columns() -> list[str]:
    return list(LINEAGE_COLS)
