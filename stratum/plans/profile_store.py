"""Profiles that are kept up to date instead of scanned for (A3/A4).

``<clean>/_profile/year=/month=/period=`` holds one row per dataset of the extraction: files,
bytes, rows, columns, text lines and NULLs per column. ``maintain`` counts the extractions that
were written and replaces their rows, so a replaced or deleted extraction is retracted;
``stored_profile`` adds the counters up without reading any data.
"""

from __future__ import annotations

import os
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.functions.columns import bytes_to_mb
from stratum.plans.append import partition_path
from stratum.registry import PARTITION_COLS, SPECS, clean_schema
from stratum.sinks.writers import write_table
from stratum.sources.clean import read_dataset
from stratum.sources.history import exists, hadoop

STORE = "_profile"
COUNTERS = "dataset string, n_rows long, n_columns long, n_files long, bytes long, n_lines long, nulls map<string,long>, year int, month int, period int"


def extractions(spark: SparkSession, clean_root: str) -> list[tuple]:
    """The (year, month, period) that the clean layer's folders hold."""
    found = set()
    for name in SPECS:
        fs, p = hadoop(spark, os.path.join(clean_root, "extractions", name, "year=*", "month=*", "period=*"))
        for f in fs.globStatus(p) or ():
            parts = f.getPath().toString().split("/")[-3:]
            found.add(tuple(int(x.split("=")[1]) for x in parts))
    return sorted(found)


def counters(spark: SparkSession, clean_root: str, keys: list[tuple], fmt: str = "parquet", dialect: str = "quoted") -> DataFrame:
    """Counters of the extractions ``keys``, one row per dataset that has any file of them."""
    own = reduce(lambda a, b: a | b, [(F.col("year") == y) & (F.col("month") == m) & (F.col("period") == p) for y, m, p in keys])
    of = lambda i: F.regexp_extract("path", r"/year=(\d+)/month=(\d+)/period=(\d+)/[^/]+$", i).cast("int")
    keyed = lambda df: df.withColumns({c: of(i) for i, c in enumerate(PARTITION_COLS, 1)})
    parts = []
    for name in SPECS:
        paths = [x for x in (partition_path(clean_root, name, k) for k in keys) if exists(spark, x)]
        if not paths:
            continue
        columns = clean_schema(name).names
        nulls = F.map_from_arrays(F.array(*[F.lit(c) for c in columns]), F.array(*[F.count(F.when(F.col(f"`{c}`").isNull(), 1)) for c in columns]))
        rows = read_dataset(spark, clean_root, name, fmt, dialect).filter(own).groupBy(*PARTITION_COLS).agg(F.count("*").alias("n_rows"), nulls.alias("nulls"))
        files = keyed(spark.read.format("binaryFile").load(paths).select("path", "length")).groupBy(*PARTITION_COLS).agg(F.count("*").alias("n_files"), F.sum("length").alias("bytes"))
        both = files.join(rows, PARTITION_COLS, "left")
        if fmt == "csv":
            lines = keyed(spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"))).groupBy(*PARTITION_COLS).agg(F.count("*").alias("n_lines"))
            both = both.join(lines, PARTITION_COLS, "left")
        else:
            both = both.withColumn("n_lines", F.lit(None).cast("long"))
        parts.append(both.select(F.lit(name).alias("dataset"), F.coalesce("n_rows", F.lit(0).cast("long")).alias("n_rows"), F.lit(len(columns)).cast("long").alias("n_columns"),
                                 "n_files", F.coalesce("bytes", F.lit(0).cast("long")).alias("bytes"), "n_lines", "nulls", *PARTITION_COLS))
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], COUNTERS)


def maintain(spark: SparkSession, clean_root: str, keys: list[tuple] | None = None, fmt: str = "parquet", dialect: str = "quoted") -> None:
    """Count the extractions ``keys`` (all, if None) anew and replace what is stored of them."""
    keys = extractions(spark, clean_root) if keys is None else [tuple(int(x) for x in k) for k in keys]
    if not keys:
        return
    store = os.path.join(clean_root, STORE)
    new = counters(spark, clean_root, keys, fmt, dialect)
    write_table(new.repartition(*PARTITION_COLS), store, partition_by=PARTITION_COLS)
    there = {tuple(r) for r in spark.read.schema(COUNTERS).parquet(store).select(*PARTITION_COLS).distinct().collect()}
    live = set(extractions(spark, clean_root))
    for key in there - live:  # nothing is left of them
        fs, p = hadoop(spark, os.path.join(store, *(f"{c}={v}" for c, v in zip(PARTITION_COLS, key, strict=True))))
        fs.delete(p, True)


def stored_profile(spark: SparkSession, clean_root: str) -> DataFrame:
    """(dataset, num_rows, num_columns, num_files, size_MB, num_lines, nulls) from the counters."""
    rows = spark.read.schema(COUNTERS).parquet(os.path.join(clean_root, STORE))
    sums = rows.groupBy("dataset").agg(F.sum("n_rows").alias("num_rows"), F.max("n_columns").alias("num_columns"), F.sum("n_files").alias("num_files"),
                                       bytes_to_mb(F.sum("bytes")).alias("size_MB"), F.sum("n_lines").alias("num_lines"))
    nulls = rows.select("dataset", F.explode("nulls").alias("c", "n")).groupBy("dataset", "c").agg(F.sum("n").alias("n"))
    packed = nulls.groupBy("dataset").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("c", "n")))).alias("nulls"))  # one entry per column
    return sums.join(packed, "dataset", "left")
