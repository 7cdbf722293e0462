"""Extraction discovery: list workbook files as a DataFrame.

The listing is a ``binaryFile`` scan that selects only ``path``/``length`` --
Spark then never reads file contents. Category, year and month come from the
path, the extraction period from the file's rank inside its month folder
(deterministic: ordered by file name).

Tree layout: ``<root>/<category folder>/<year>/<month folder>/<file>``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratum.functions.columns import classify_category, file_name, month_number

WORKBOOK_GLOB = None  # every file is listed; what can't be loaded is reported as a reject


def _listing(spark: SparkSession, root: str, recursive: bool, glob: str | None) -> DataFrame:
    reader = spark.read.format("binaryFile")
    if recursive:
        reader = reader.option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(root).select("path", "length", "modificationTime")


def discover_extractions(spark: SparkSession, root: str, glob: str | None = WORKBOOK_GLOB) -> DataFrame:
    """One row per workbook in a category/year/month tree.

    Columns: path, length, modificationTime, file_name, category_dir, year (int), month_name,
    month (int), category (classified from the file name, NULL if unknown),
    period (1-based rank of the file inside its category/year/month folder).
    Empty month folders simply contribute no rows.
    """
    files = _listing(spark, root, recursive=True, glob=glob)
    segs = F.split(F.col("path"), "/")
    files = files.select(
        "path", "length", "modificationTime",
        file_name("path").alias("file_name"),
        F.element_at(segs, -4).alias("category_dir"),
        F.element_at(segs, -3).try_cast("int").alias("year"),
        F.element_at(segs, -2).alias("month_name"),
    ).withColumns({
        "month": month_number("month_name"),
        "category": classify_category("file_name"),
    })
    # A month folder holds a handful of files: this window partition is tiny. Files of no known
    # category are counted apart, so that a stray file shifts no period.
    w = Window.partitionBy("category_dir", "year", "month_name", F.col("category").isNull()).orderBy("file_name")
    return files.withColumn("period", F.row_number().over(w))


def discover_single_extraction(spark: SparkSession, folder: str, year: int, month: int, period: int,
                               glob: str | None = WORKBOOK_GLOB) -> DataFrame:
    """Flat folder holding one extraction; the caller names its period."""
    files = _listing(spark, folder, recursive=False, glob=glob)
    return files.select(
        "path", "length", file_name("path").alias("file_name"),
        F.lit(None).cast("string").alias("category_dir"),
        F.lit(int(year)).alias("year"), F.lit(None).cast("string").alias("month_name"),
        F.lit(int(month)).alias("month"),
    ).withColumns({"category": classify_category("file_name"), "period": F.lit(int(period))})


def rejected_files(files: DataFrame) -> DataFrame:
    """Files that cannot be processed: unknown category, month or year."""
    return files.filter(F.col("category").isNull() | F.col("month").isNull() | F.col("year").isNull())


def accepted_files(files: DataFrame) -> DataFrame:
    return files.filter(F.col("category").isNotNull() & F.col("month").isNotNull() & F.col("year").isNotNull())


def text_line_profile(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """Bytes and text lines per file (S12): listing sizes joined with a line count.

    Lines are counted by a ``text`` scan grouped by the file each line came from.
    """
    sizes = _listing(spark, root, recursive=True, glob=glob).select("path", "length")
    reader = spark.read.option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    lines = (reader.text(root).select(F.col("_metadata.file_path").alias("path"))
             .groupBy("path").agg(F.count(F.lit(1)).cast("long").alias("num_lines")))
    return sizes.join(lines, "path", "left").fillna(0, ["num_lines"])
