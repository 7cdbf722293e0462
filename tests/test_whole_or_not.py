"""Workbooks load whole or not at all; failures and empty datasets are accounted for."""

import os
import zipfile

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from stratum.operators.columns import convert, update_from
from stratum.operators.joins import band_self_join_mean
from stratum.plans.append import append_extraction
from stratum.plans.rebuild import rebuild
from stratum.registry import SPECS
from stratum.sources.clean import read_dataset
from xlsx_fixture import build_raw_tree, build_single_extraction, write_xlsx


def test_wrong_width_and_half_broken_workbooks_are_left_out(spark, scratch):
    folder, clean = os.path.join(scratch, "in"), os.path.join(scratch, "clean")
    build_single_extraction(folder, 2024, 4, 1)
    s = SPECS["competitor"]
    wide = [["x"]] * s.skip_rows + [[f"c{i}" for i in range(len(s.columns) + 1)]] + [["EXTRA"] + ["1"] * len(s.columns)] * 3
    write_xlsx(os.path.join(folder, "wide_competitor.xlsx"), [("a", wide)])
    name = next(n for n in os.listdir(folder) if "followers" in n)
    with zipfile.ZipFile(os.path.join(folder, name)) as src, zipfile.ZipFile(os.path.join(folder, "half_followers.xlsx"), "w") as out:
        for n in src.namelist():
            out.writestr(n, src.read(n)[:40] if n.endswith("sheet4.xml") else src.read(n))
    append_extraction(spark, folder, clean, 2024, 4, 1)
    for d in SPECS:
        files = {os.path.basename(r.source_file) for r in read_dataset(spark, clean, d).select("source_file").distinct().collect()}
        assert len(files) == 1 and not files & {"wide_competitor.xlsx", "half_followers.xlsx"}, d
    rejected = {os.path.basename(r.path) for r in spark.read.parquet(os.path.join(clean, "_rejects_append", "2024_4_1")).collect()}
    assert rejected == {"wide_competitor.xlsx", "half_followers.xlsx"}


def test_levels_follow_an_append_and_missing_categories_read_empty(spark, scratch):
    raw, clean = os.path.join(scratch, "raw"), os.path.join(scratch, "clean")
    build_raw_tree(raw, months=((2024, 1),), extra_files=False)
    import shutil

    shutil.move(os.path.join(raw, "Visitantes"), os.path.join(scratch, "elsewhere"))
    rebuild(spark, raw, clean, levels=("month", "all"))
    assert read_dataset(spark, clean, "visitors_metrics").count() == 0
    incoming = os.path.join(scratch, "incoming")
    build_single_extraction(incoming, 2024, 2, 1)
    append_extraction(spark, incoming, clean, 2024, 2, 1)
    for d in SPECS:
        n = {level: read_dataset(spark, clean, d, level=level).count() for level in ("extractions", "monthly", "all_extractions")}
        assert len(set(n.values())) == 1 and n["monthly"] > 0, (d, n)
    # a corrected extraction without competitors: they stay, unless the folder is said to be whole
    for f in os.listdir(incoming):
        if "competitor" in f:
            os.unlink(os.path.join(incoming, f))
    levels = lambda: {level: read_dataset(spark, clean, "competitor", level=level).filter("month = 2").count() for level in ("extractions", "monthly", "all_extractions")}
    there = levels()
    append_extraction(spark, incoming, clean, 2024, 2, 1)
    assert levels() == there and min(there.values()) > 0
    append_extraction(spark, incoming, clean, 2024, 2, 1, replace_absent=True)
    assert set(levels().values()) == {0}


def test_conversion_failures_are_reported(spark, scratch):
    folder, clean = os.path.join(scratch, "in"), os.path.join(scratch, "clean")
    s = SPECS["competitor"]
    body = [["x"]] * s.skip_rows + [list(s.names)] + [["page", "many", "2", "3.5", "4"][: len(s.columns)]]
    os.makedirs(folder)
    write_xlsx(os.path.join(folder, "competitor.xlsx"), [("a", body)])
    append_extraction(spark, folder, clean, 2024, 4, 1)
    bad = spark.read.parquet(os.path.join(clean, "_rejects_cells_append", "2024_4_1")).collect()
    assert [(r.dataset, r.column, r.text) for r in bad] == [("competitor", s.names[1], "many")]


def test_semantics(spark):
    d = spark.createDataFrame([("2024/01/05",), ("2024-01-05T13:00:00",), ("5 Jan 2024",), ("",)], "t string")
    from pyspark.sql import types as T

    got = [str(r.d) for r in d.select(convert(F.col("t"), T.DateType(), True).alias("d")).collect()]
    assert got == ["2024-01-05"] * 3 + ["None"]
    with pytest.raises(PySparkException):
        spark.createDataFrame([("soon",)], "t string").select(convert(F.col("t"), T.DateType(), True)).collect()
    a = spark.createDataFrame([(1, 5), (2, 6)], "k int, v int")
    u = spark.createDataFrame([(1, None)], "k int, v int")
    assert sorted(map(tuple, update_from(a, u, "k", "v").collect())) == [(1, None), (2, 6)]
    x = spark.createDataFrame([("a", None, 1.0), ("a", "2024-01-01", 2.0)], "k string, d string, v double").withColumn("d", F.to_date("d"))
    assert sorted([r.band_mean for r in band_self_join_mean(x, "k", "d", "v").collect()], key=str) == [2.0, None]


def test_rejected_and_late_workbooks_clear_nothing(spark, scratch):
    raw, clean, incoming = (os.path.join(scratch, x) for x in ("raw", "clean", "incoming"))
    build_raw_tree(raw, months=((2024, 1),), extra_files=False)
    rebuild(spark, raw, clean, levels=("month", "all"))
    build_single_extraction(incoming, 2024, 2, 1)
    append_extraction(spark, incoming, clean, 2024, 2, 1)

    def counts():
        return {(d, level): read_dataset(spark, clean, d, level=level).filter("month = 2").count()
                for d in SPECS for level in ("extractions", "monthly", "all_extractions")}

    before = counts()
    assert min(before.values()) > 0
    # the same extraction again, its content workbook corrupt and its visitors of the wrong width
    for f in os.listdir(incoming):
        if "content" in f:
            with open(os.path.join(incoming, f), "wb") as out:
                out.write(b"no workbook")
        if "visitors" in f:
            s = SPECS["visitors_metrics"]
            write_xlsx(os.path.join(incoming, f), [("a", [["x"]] * s.skip_rows + [["one"], ["1"]])])
    append_extraction(spark, incoming, clean, 2024, 2, 1)
    rejected = {os.path.basename(r.path) for r in spark.read.parquet(os.path.join(clean, "_rejects_append", "2024_2_1")).collect()}
    assert rejected == {f for f in os.listdir(incoming) if "content" in f or "visitors" in f} and len(rejected) == 2
    assert counts() == before
    # a late delivery of one category
    for f in os.listdir(incoming):
        if "competitor" not in f:
            os.unlink(os.path.join(incoming, f))
    append_extraction(spark, incoming, clean, 2024, 2, 1, replace_absent=False)
    assert counts() == before
