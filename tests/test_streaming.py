"""Streaming append: landed extractions reach the clean layer exactly once."""

import os
import shutil

import pytest
from pyspark.sql import functions as F

from stratum.plans.append import append_extraction
from stratum.sources.clean import read_dataset
from stratum.streaming.append_stream import start_append_stream
from xlsx_fixture import build_single_extraction


def test_stream_appends_and_replays_idempotently(spark, scratch):
    landing, clean = os.path.join(scratch, "landing"), os.path.join(scratch, "clean")
    build_single_extraction(os.path.join(landing, "2024", "5", "1"), 2024, 5, 1, seed=1)
    q = start_append_stream(spark, landing, clean)
    q.awaitTermination(300)
    first = read_dataset(spark, clean, "content_metrics").count()
    assert first == 15

    # a second extraction lands later (month given by its folder name)
    build_single_extraction(os.path.join(landing, "2024", "Maio", "2"), 2024, 5, 2, seed=2)
    q = start_append_stream(spark, landing, clean)
    q.awaitTermination(300)
    cm = read_dataset(spark, clean, "content_metrics")
    assert cm.count() == 15 + 16
    assert {(r.month, r.period) for r in cm.select("month", "period").distinct().collect()} == {(5, 1), (5, 2)}

    # nothing new: the checkpoint remembers processed files
    q = start_append_stream(spark, landing, clean)
    q.awaitTermination(300)
    assert read_dataset(spark, clean, "content_metrics").count() == 31
    assert read_dataset(spark, clean, "followers_new").filter(F.col("period") == 2).count() == 16


@pytest.mark.parametrize("per_batch", [None, 1])
def test_stream_keeps_all_files_of_an_extraction(spark, scratch, per_batch):
    """However an extraction's files fall into batches, the table is that of the batch path."""
    landing, clean = os.path.join(scratch, f"l{per_batch}"), os.path.join(scratch, f"c{per_batch}")
    folder = os.path.join(landing, "2024", "5", "1")
    build_single_extraction(folder, 2024, 5, 1, seed=1)
    for name in sorted(os.listdir(folder)):
        shutil.copy(os.path.join(folder, name), os.path.join(folder, "again_" + name.replace(".xlsx", ".XLSX")))
    with open(os.path.join(folder, "page_visitors_broken.xlsx"), "wb") as fh:
        fh.write(b"PK broken")
    batch = os.path.join(scratch, f"b{per_batch}")
    append_extraction(spark, folder, batch, 2024, 5, 1)
    start_append_stream(spark, landing, clean, max_files_per_trigger=per_batch).awaitTermination(600)
    for name in ("content_metrics", "competitor", "visitors_metrics"):
        a, b = (sorted(map(str, read_dataset(spark, root, name).drop("source_file").collect())) for root in (batch, clean))
        assert a == b and len(a) % 2 == 0 and a
    rejected = spark.read.parquet(os.path.join(clean, "_rejects_stream")).filter("path LIKE '%broken%'")
    assert rejected.count() >= 1
