"""Continuous incremental append: new workbooks landing in a folder are added
to the clean layer by a Structured Streaming query (X3 as a stream).

Landing layout: ``<landing>/<year>/<month>/<period>/<workbook>`` where month
is 1..12 or the Portuguese folder name. Each micro-batch:

1. decodes the batch's workbooks (the same ``mapInArrow`` decoder as the
   batch path -- file bytes are never shuffled),
2. stages the decoded rows under ``<clean>/_staging/stream``, one partition per extraction
   and file,
3. reloads the extractions it touches from *all* their staged files, whichever batch brought
   them, and overwrites their (year, month, period) partitions, per dataset.

So the table doesn't depend on how files fall into batches. The file source records
processed files in the checkpoint (kept in the shared clean root), and steps 2 and 3 are
idempotent: a replayed batch rewrites the same partitions with the same rows. Files that
can't be loaded, by name or content, are recorded in ``<clean>/_rejects_stream``.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratum.functions.columns import classify_category, file_name, month_number
from stratum.plans.rebuild import load_datasets, summary_of
from stratum.plans.transform import loadable, summary_rejects
from stratum.registry import PARTITION_COLS
from stratum.session import ship_code
from stratum.sinks.writers import write_table
from stratum.sources.xlsx import CELLS_SCHEMA, _decode_batches


BINARY_FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def landing_stream(spark: SparkSession, landing: str, glob: str | None = None, max_files_per_trigger: int | None = None):
    reader = (spark.readStream.format("binaryFile").schema(BINARY_FILE_SCHEMA)
              .option("recursiveFileLookup", "true"))
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", int(max_files_per_trigger))
    return reader.load(landing)


def _with_extraction_keys(df: DataFrame) -> DataFrame:
    segs = F.split(F.col("path"), "/")
    month_seg = F.element_at(segs, -3)
    return df.withColumns({
        "year": F.element_at(segs, -4).try_cast("int"),
        "month": F.coalesce(month_seg.try_cast("int"), month_number(month_seg)),
        "period": F.element_at(segs, -2).try_cast("int"),
        "category": classify_category(file_name("path")),
    })


def process_batch(batch: DataFrame, batch_id: int, clean_root: str, fmt: str = "parquet",
                  dialect: str = "quoted", parallelism: int = 4) -> None:
    spark = batch.sparkSession
    ship_code(spark)
    keyed = _with_extraction_keys(batch.select("path", "content"))
    good = keyed.filter(F.col("category").isNotNull() & F.col("year").isNotNull()
                        & F.col("month").isNotNull() & F.col("period").isNotNull())
    meta = good.select(F.col("path").alias("source_file"), "year", "month", "period")
    cells = good.select("path", "category", "content").mapInArrow(_decode_batches, CELLS_SCHEMA)
    root = os.path.join(clean_root, "_staging", "stream")
    # file-level metadata comes from the path: attach it by a join on the (small) per-file table
    staged = cells.join(meta, "source_file", "inner").withColumns({"file": F.md5("source_file"), "part": F.coalesce("dataset", F.lit("none"))})
    write_table(staged, root, partition_by=[*PARTITION_COLS, "file", "part"])
    schema = T.StructType([*staged.schema.fields])
    touched = meta.select(*PARTITION_COLS).distinct()
    own = spark.read.schema(schema).parquet(root).join(touched, PARTITION_COLS, "left_semi").drop("file", "part")
    rejects = keyed.filter(~(F.col("category").isNotNull() & F.col("year").isNotNull()
                             & F.col("month").isNotNull() & F.col("period").isNotNull()))
    summary = summary_of(spark, own, os.path.join(clean_root, "_staging", "stream_summary", f"batch={int(batch_id)}"))
    bad = summary_rejects(summary)
    reported = rejects.select("path", F.lit("unclassified file").alias("reason")).unionByName(bad)
    write_table(reported.withColumn("batch_id", F.lit(int(batch_id))), os.path.join(clean_root, "_rejects_stream"),
                partition_by=["batch_id"])
    load_datasets(spark, loadable(own, bad), clean_root, fmt, dialect, parallelism=parallelism, mode="overwrite", summary=summary)


def start_append_stream(spark: SparkSession, landing: str, clean_root: str, checkpoint: str | None = None,
                        available_now: bool = True, processing_time: str | None = None, fmt: str = "parquet",
                        dialect: str = "quoted", max_files_per_trigger: int | None = None):
    """Start the streaming append; returns the StreamingQuery.

    ``available_now=True`` processes everything that has landed and stops
    (scheduled runs); otherwise the query keeps polling every ``processing_time``.
    """
    checkpoint = checkpoint or os.path.join(clean_root, "_checkpoints", "append_stream")
    stream = landing_stream(spark, landing, max_files_per_trigger=max_files_per_trigger)
    writer = (stream.writeStream
              .foreachBatch(lambda df, bid: process_batch(df, bid, clean_root, fmt, dialect))
              .option("checkpointLocation", checkpoint))
    if available_now:
        writer = writer.trigger(availableNow=True)
    elif processing_time:
        writer = writer.trigger(processingTime=processing_time)
    return writer.start()
