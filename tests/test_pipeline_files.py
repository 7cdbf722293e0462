"""Raw tree -> clean layer (rebuild), incremental append, CSV dialect round trips."""

import os

import pytest
from pyspark.sql import functions as F

from stratum.operators.profile import environment_profile, size_profile
from stratum.plans.append import append_extraction, merged_view
from stratum.plans.rebuild import rebuild
from stratum.registry import SPECS, clean_schema
from stratum.sinks.writers import write_table
from stratum.sources.clean import read_csv, read_dataset, read_flat_clean
from stratum.sources.files import accepted_files, discover_extractions, rejected_files
from stratum.sources.xlsx import decode_workbook, scan_cells
from xlsx_fixture import build_raw_tree, build_single_extraction, write_xlsx


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("tree"))
    raw, clean = os.path.join(base, "raw"), os.path.join(base, "clean")
    info = build_raw_tree(raw)
    timings = rebuild(spark, raw, clean, levels=("month", "all"))
    return {"raw": raw, "clean": clean, "files": info["files"], "timings": timings}


def test_decode_workbook_roundtrip(scratch):
    p = os.path.join(scratch, "w.xlsx")
    write_xlsx(p, [("a", [["h1", "h2"], [1, "x"], [2.5, None], ["multi\nline \"q\"", 3]]), ("b", [["z"]])])
    with open(p, "rb") as fh:
        rows = list(decode_workbook(fh.read(), [0, 1]))
    assert rows[0] == (0, 0, ["h1", "h2"])
    assert rows[1] == (0, 1, ["1", "x"])
    assert rows[2] == (0, 2, ["2.5"])
    assert rows[3] == (0, 3, ["multi\nline \"q\"", "3"])
    assert rows[4] == (1, 0, ["z"])


def test_discovery(spark, built):
    files = discover_extractions(spark, built["raw"])
    acc = accepted_files(files)
    assert acc.count() == built["files"]
    assert rejected_files(files).count() == 1
    periods = {r.period for r in acc.select("period").distinct().collect()}
    assert periods == {1, 2}
    assert {r.category for r in acc.select("category").distinct().collect()} == {
        "competitor", "content", "followers", "visitors"}


def test_rebuild_invariants(spark, built):
    clean = built["clean"]
    n_extractions = built["files"] // 4
    total_tables = 0
    for name in SPECS:
        df = read_dataset(spark, clean, name)
        assert df.select("source_file").distinct().count() == n_extractions, name
        total_tables += n_extractions
        for c in clean_schema(name).fields:
            assert df.schema[c.name].dataType == c.dataType, (name, c.name)
    assert total_tables == built["files"] // 4 * 15
    cm = read_dataset(spark, clean, "content_metrics")
    # no negative repaired metric once the 3-row frame is full
    neg = cm.filter((F.col("row_idx") >= 2) & ((F.col("Clicks (total)") < 0) | (F.col("Reactions (total)") < 0)))
    assert neg.count() == 0
    # extraction stamp: period 1 -> 15th, period 2 -> month end
    bad = cm.filter(F.col("Extraction Range") != F.when(F.col("period") == 1, F.make_date("year", "month", F.lit(15)))
                    .otherwise(F.last_day(F.make_date("year", "month", F.lit(1)))))
    assert bad.count() == 0
    # monthly and whole-history levels carry the same rows
    assert read_dataset(spark, clean, "content_metrics", level="monthly").count() == cm.count()
    assert read_dataset(spark, clean, "content_metrics", level="all_extractions").count() == cm.count()


def test_profiles(spark, built):
    files = accepted_files(discover_extractions(spark, built["raw"]))
    staged = spark.read.parquet(os.path.join(built["clean"], "_staging", "cells"))
    per_table = (staged.filter(F.col("error").isNull())
                 .groupBy("source_file", "dataset")
                 .agg((F.count(F.lit(1)) - 1).alias("n_rows"), F.max(F.size("cells")).alias("n_columns")))
    prof = environment_profile(per_table, files, "test").collect()[0]
    assert prof.num_files == built["files"]
    assert prof.num_tables == built["files"] // 4 * 15
    listing = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(
        os.path.join(built["clean"], "extractions")).select("length")
    size = size_profile(listing, "test").collect()[0]
    assert size.num_files > 0 and size.initial_clean_dataframe_size_MB >= 0


def test_append_is_idempotent(spark, built, tmp_path):
    incoming = str(tmp_path / "incoming")
    build_single_extraction(incoming, 2024, 3, 1)
    clean = built["clean"]
    before = read_dataset(spark, clean, "followers_new").count()
    append_extraction(spark, incoming, clean, 2024, 3, 1)
    once = merged_view(spark, clean, "followers_new")
    n_once = once.count()
    assert n_once == before + 15  # 15 days in the first half of March
    append_extraction(spark, incoming, clean, 2024, 3, 1)
    assert merged_view(spark, clean, "followers_new").count() == n_once  # partition replaced, not duplicated
    fresh = merged_view(spark, clean, "followers_new")  # re-list files after the rewrite
    march = fresh.filter((F.col("year") == 2024) & (F.col("month") == 3))
    assert march.select("period").distinct().collect()[0].period == 1


@pytest.mark.parametrize("dialect", ["quoted", "semicolon"])
def test_csv_dialect_roundtrip(spark, built, scratch, dialect):
    posts = read_dataset(spark, built["clean"], "content_posts")
    out = os.path.join(scratch, f"posts_{dialect}")
    write_table(posts, out, fmt="csv", dialect=dialect, partition_by=["year", "month", "period"])
    from pyspark.sql import types as T
    schema = T.StructType(list(clean_schema("content_posts").fields)
                          + [T.StructField("source_file", T.StringType()), T.StructField("row_idx", T.LongType())])
    back = read_csv(spark, out, schema, dialect)
    assert back.count() == posts.count()
    key = ["source_file", "row_idx"]
    a = {tuple(r[k] for k in key): r["Post Title"] for r in posts.collect()}
    b = {tuple(r[k] for k in key): r["Post Title"] for r in back.collect()}
    assert a == b
    assert any("\n" in t for t in a.values())


def test_flat_clean_folder(spark, scratch):
    folder = os.path.join(scratch, "flat")
    os.makedirs(folder)
    with open(os.path.join(folder, "all_extractions_followers_location.csv"), "w") as fh:
        fh.write('"Location","Total Followers","Extraction Range"\n"Lisbon, PT","12","2024-01-15"\n')
    with open(os.path.join(folder, "all_extractions_unknown.csv"), "w") as fh:
        fh.write('"a"\n"1"\n')
    got = read_flat_clean(spark, folder)
    assert list(got) == ["followers_location", "unknown"]
    assert [tuple(r) for r in got["unknown"].collect()] == [("1",)]
    row = got["followers_location"].collect()[0]
    assert row["Location"] == "Lisbon, PT" and row["Total Followers"] == 12


def test_bad_workbook_is_rejected_not_fatal(spark, scratch):
    folder = os.path.join(scratch, "bad")
    os.makedirs(folder)
    with open(os.path.join(folder, "page_content_bad.xlsx"), "wb") as fh:
        fh.write(b"not a zip")
    rows = scan_cells(spark, folder, recursive=False).collect()
    assert len(rows) == 1 and rows[0].error.startswith("BadZipFile")


def test_import_flat_layer_then_append(spark, scratch):
    from stratum.plans.migrate import import_flat_layer

    folder = os.path.join(scratch, "flat_layer")
    os.makedirs(folder)
    with open(os.path.join(folder, "all_extractions_followers_new.csv"), "w") as fh:
        fh.write('"Date","Followers Sponsored","Followers Organic","Total Followers","Extraction Range"\n')
        fh.write('"2024-01-01","1","2","3","2024-01-15"\n"2024-01-20","0","5","5","2024-01-31"\n')
    clean = os.path.join(scratch, "clean_from_flat")
    got = import_flat_layer(spark, folder, clean)
    assert got == {"followers_new": 2}
    df = read_dataset(spark, clean, "followers_new")
    assert sorted((r.year, r.month, r.period) for r in df.collect()) == [(2024, 1, 0), (2024, 1, 2)]
    incoming = os.path.join(scratch, "incoming_after_flat")
    build_single_extraction(incoming, 2024, 2, 1)
    append_extraction(spark, incoming, clean, 2024, 2, 1)
    assert read_dataset(spark, clean, "followers_new").count() == 2 + 15


def test_step_facade(spark, scratch):
    from stratum.plans.etl import CleanLayerETL
    from xlsx_fixture import build_raw_tree

    raw, clean = os.path.join(scratch, "raw"), os.path.join(scratch, "clean")
    build_raw_tree(raw, months=((2024, 1),), extra_files=False)
    etl = CleanLayerETL(spark, raw, clean)
    staged = etl.extract_data()
    transformed = etl.transform_data(staged)
    assert set(transformed) == set(SPECS)
    etl.load_to_clean(staged)
    month = etl.concatenate_monthly_data(2024, 1)
    assert month["content_metrics"].count() == 31
    etl.export_data(levels=("all",))
    assert read_dataset(spark, clean, "competitor", level="all_extractions").count() == \
        etl.clean_table("competitor").count()
    incoming = os.path.join(scratch, "incoming")
    build_single_extraction(incoming, 2024, 2, 1)
    new_staged = etl.get_raw_unique_extraction_data(incoming, 2024, 2, 1)
    merged = etl.concatenate_unique_extraction_data(etl.get_clean_concatenated_data(),
                                                    etl.transform_data(new_staged))
    assert merged["content_metrics"].count() == 31 + 15
    etl.export_dataframes(new_staged)
    assert etl.clean_table("content_metrics").count() == 31 + 15


def test_rebuild_independent_of_scan_partitioning(spark, scratch):
    from xlsx_fixture import build_raw_tree

    raw = os.path.join(scratch, "raw_p")
    build_raw_tree(raw, months=((2024, 3),), extra_files=False)
    outs = []
    for max_bytes in ("1k", "128m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", max_bytes)
        spark.conf.set("spark.sql.files.openCostInBytes", "1k" if max_bytes == "1k" else "4m")
        try:
            clean = os.path.join(scratch, f"clean_{max_bytes}")
            rebuild(spark, raw, clean)
            outs.append(sorted(tuple(r) for r in read_dataset(spark, clean, "content_metrics")
                               .drop("source_file").collect()))
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
    assert outs[0] == outs[1] and len(outs[0]) == 31


def test_append_reports_rejects(spark, scratch):
    incoming = os.path.join(scratch, "incoming_bad")
    build_single_extraction(incoming, 2024, 4, 2)
    with open(os.path.join(incoming, "page_visitors_broken.xlsx"), "wb") as fh:
        fh.write(b"PK not really a zip")
    write_xlsx(os.path.join(incoming, "summary_sheet.xlsx"), [("x", [["a"], ["1"]])])
    clean = os.path.join(scratch, "clean_rej")
    append_extraction(spark, incoming, clean, 2024, 4, 2)
    rej = spark.read.parquet(os.path.join(clean, "_rejects_append", "2024_4_2")).collect()
    reasons = {os.path.basename(r.path): r.reason for r in rej}
    assert reasons["summary_sheet.xlsx"] == "unclassified file"
    assert reasons["page_visitors_broken.xlsx"].startswith("BadZipFile")
    assert read_dataset(spark, clean, "content_metrics").count() == 15  # April 16..30


def test_csv_layer_equals_parquet_layer(spark, built, scratch):
    # other tests append later months to the shared layer: compare the fixture months only
    clean_csv = os.path.join(scratch, "clean_csv")
    rebuild(spark, built["raw"], clean_csv, fmt="csv", dialect="semicolon")
    for name in ["content_metrics", "content_posts", "visitors_metrics", "competitor"]:
        pq = read_dataset(spark, built["clean"], name)
        csv = read_dataset(spark, clean_csv, name, fmt="csv", dialect="semicolon")
        cols = sorted(pq.columns)
        assert sorted(csv.columns) == cols
        def key(t):
            return tuple((x is None, str(x)) for x in t)

        a = sorted((tuple(r) for r in pq.select(*cols).filter((F.col("year") == 2024) & (F.col("month") <= 2)).collect()), key=key)
        b = sorted((tuple(r) for r in csv.select(*cols).filter((F.col("year") == 2024) & (F.col("month") <= 2)).collect()), key=key)
        assert a == b, name


def test_cli_and_profiles(spark, scratch):
    from stratum.__main__ import main
    from xlsx_fixture import build_raw_tree

    raw, clean = os.path.join(scratch, "raw_cli"), os.path.join(scratch, "clean_cli")
    info = build_raw_tree(raw, months=((2024, 5),), extra_files=False)
    t = main(["rebuild", raw, clean, "--fmt", "csv", "--levels", "all"], spark=spark)
    assert t["total_etl_time"] > 0
    prof = main(["profile", "raw", raw, "1m"], spark=spark)
    assert prof["num_files"] == info["files"] == 8
    assert prof["num_tables"] == 2 * 15
    assert prof["total_columns"] == 2 * sum(len(s.columns) for s in SPECS.values())
    total = sum(read_dataset(spark, clean, n, fmt="csv").count() for n in SPECS)
    assert prof["total_rows"] == total
    size = main(["profile", "clean", os.path.join(clean, "extractions"), "1m"], spark=spark)
    assert size["num_files"] > 0 and size["num_lines"] > total  # headers + multi-line titles


def test_cells_stay_in_the_tasks_that_decode_them(spark, scratch):
    """Workbooks are dealt to tasks one by one; their cells are not shuffled to meet the listing."""
    from stratum.plans.transform import attach_extraction
    from stratum.sources.files import discover_extractions

    for i in range(40):
        write_xlsx(os.path.join(scratch, "Concorrentes", "2024", "Janeiro", f"page_competitor_{i:02d}.xlsx"), [("a", [["x"] * 5, ["y"] * 5])])
    cells = scan_cells(spark, scratch)
    assert cells.rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
    plan = attach_extraction(cells, discover_extractions(spark, scratch))._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
