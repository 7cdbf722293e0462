"""Import a flat clean folder (one ``all_extractions_<dataset>.csv`` per dataset)
into the partitioned clean layer, so incremental appends can continue from it.

The extraction key is recovered from ``Extraction Range``. The month end is period 2. Every
other period is stamped with the 15th, so such rows can't be told apart and go to period 0
(``IMPORTED``), which no append ever overwrites. What can't be keyed is reported in
``<clean>/_rejects_import`` with its number of rows: datasets that aren't registered and rows
without a date.
"""

from __future__ import annotations

import os

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from stratum.plans.rebuild import _concurrently
from stratum.registry import EXTRACTION_RANGE, PARTITION_COLS, SPECS
from stratum.sinks.writers import write_table
from stratum.sources.clean import dataset_path, read_flat_clean

IMPORTED = 0


def import_flat_layer(spark: SparkSession, folder: str, clean_root: str, prefix: str = "all_extractions_",
                      dialect: str = "quoted", fmt: str = "parquet", parallelism: int = 8) -> dict:
    """Returns {dataset: rows written}."""
    tables = read_flat_clean(spark, folder, prefix=prefix, dialect=dialect, file_col="source_file")
    left_out = []
    for name, df in sorted(tables.items()):
        known = name in SPECS
        n = (df.filter(F.col(EXTRACTION_RANGE).isNull()) if known else df).count()
        if n or not known:
            left_out.append((name, "no Extraction Range" if known else "unknown dataset", n))
    write_table(spark.createDataFrame(left_out, "dataset string, reason string, n_rows long"), os.path.join(clean_root, "_rejects_import"))
    tables = {name: df.filter(F.col(EXTRACTION_RANGE).isNotNull()) for name, df in tables.items() if name in SPECS}

    def one(item):
        name, df = item
        er = F.col(EXTRACTION_RANGE)
        keyed = df.withColumns({
            "year": F.year(er), "month": F.month(er),
            "period": F.when(er == F.last_day(er), F.lit(2)).otherwise(F.lit(IMPORTED)),
            "row_idx": F.lit(None).cast("long"),
        })
        write_table(keyed.repartition(spark.sparkContext.defaultParallelism, *PARTITION_COLS),
                    dataset_path(clean_root, name), fmt=fmt, dialect=dialect, partition_by=PARTITION_COLS)
        return name, spark.read.parquet(dataset_path(clean_root, name)).count() if fmt == "parquet" else None

    return dict(_concurrently(one, sorted(tables.items()), parallelism))
