"""Environment profiles in one call (A3 raw tree, A4 clean layer)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.operators.profile import environment_profile, size_profile
from stratum.plans.transform import attach_extraction
from stratum.registry import SPECS
from stratum.sources.files import accepted_files, discover_extractions
from stratum.sources.xlsx import scan_cells


def profile_raw_tree(spark: SparkSession, raw_root: str, environment: str) -> DataFrame:
    """num_files, num_tables (file x sheet), total_columns, total_rows of a raw tree.

    Rows and header widths are counted from the decoded sheets (one scan);
    data rows exclude each sheet's leading rows and header.
    """
    files = accepted_files(discover_extractions(spark, raw_root))
    cells = attach_extraction(scan_cells(spark, raw_root), files).filter(F.col("error").isNull())
    skip = F.create_map(*[x for s in SPECS.values() for x in (F.lit(s.name), F.lit(s.skip_rows))])
    per_table = (cells.withColumn("__skip", F.element_at(skip, F.col("dataset")))
                 .groupBy("source_file", "dataset")
                 .agg(F.sum(F.when(F.col("sheet_row") > F.col("__skip"), 1).otherwise(0)).alias("n_rows"),
                      F.max(F.when(F.col("sheet_row") == F.col("__skip"), F.size("cells"))).alias("n_columns")))
    return environment_profile(per_table, files, environment)


def profile_clean_layer(spark: SparkSession, clean_root: str, environment: str, glob: str = "*.csv") -> DataFrame:
    """Size (MB), file count and text lines of the files of a clean layer."""
    listing = (spark.read.format("binaryFile").option("recursiveFileLookup", "true")
               .option("pathGlobFilter", glob).load(clean_root).select("length"))
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(clean_root)
    return size_profile(listing, environment, lines)
