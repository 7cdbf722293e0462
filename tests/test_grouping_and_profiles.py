"""Paged groups, widening unions and stored profiles."""

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F
from xlsx_fixture import build_raw_tree, build_single_extraction

from stratum.operators.profile import group_pages
from stratum.operators.setops import least_common_type, merge_schemas, union_widened
from stratum.plans.append import append_extraction
from stratum.plans.profile_store import maintain, stored_profile
from stratum.plans.rebuild import rebuild
from stratum.registry import SPECS, clean_schema
from stratum.sources.clean import read_dataset


def test_pages_hold_each_group_in_order(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["hot"] * 8 + ["a", "b", None]), rng.choice([None, *range(400)]), i) for i in range(3000)] + [("one", 1, 1)]
    df = spark.createDataFrame([(*r, 0) for r in rows], "k string, m long, at long, page int")
    low = lambda x: (x is not None, x or 0)
    want: dict = {}
    for k, m, _ in rows:
        want.setdefault(k, []).append(m)
    for distinct in (False, True):
        got: dict = {}
        pages = group_pages(df, "k", "m", page_size=70, distinct=distinct).collect()
        for r in sorted(pages, key=lambda r: (r.k or "", r.page)):
            assert r.n_members == len(r.members) <= 70 and r.page * 70 == len(got.get(r.k, []))
            got.setdefault(r.k, []).extend(r.members)
        assert got == {k: sorted(set(v) if distinct else v, key=low) for k, v in want.items()}
    seen: dict = {}
    for k, m, _ in rows:
        if m not in seen.setdefault(k, []):
            seen[k].append(m)
    got = {}
    for r in sorted(group_pages(df, "k", "m", page_size=7, first_seen="at").collect(), key=lambda r: (r.k or "", r.page)):
        got.setdefault(r.k, []).extend(r.members)
    assert got == seen
    assert group_pages(df.limit(0), "k", "m").count() == 0


def test_a_million_members_are_many_rows(spark):
    df = spark.range(300_000).select(F.lit("k").alias("k"), F.col("id").alias("m"))
    pages = group_pages(df, "k", "m", page_size=1000).select("page", "n_members", F.col("members")[0].alias("first"), F.spark_partition_id().alias("p")).collect()
    assert len(pages) == 300 and all(r.n_members == 1000 and r.first == r.page * 1000 for r in pages)
    assert len({r.p for r in pages}) > 1


def test_types_widen_along_the_lattice(spark):
    from pyspark.sql import types as T

    pairs = {("int", "bigint"): "bigint", ("bigint", "double"): "double", ("float", "decimal(10,2)"): "double", ("date", "timestamp_ntz"): "timestamp_ntz",
             ("date", "timestamp"): "timestamp", ("date", "bigint"): "string", ("boolean", "bigint"): "string", ("void", "date"): "date", ("string", "double"): "string"}
    typed = lambda t: T.NullType() if t == "void" else spark.createDataFrame([], f"x {t}").schema[0].dataType
    for (a, b), want in pairs.items():
        assert least_common_type(typed(a), typed(b)).simpleString() == least_common_type(typed(b), typed(a)).simpleString() == want
    with pytest.raises(ValueError):
        least_common_type(typed("array<int>"), typed("string"))
    with pytest.raises(ValueError):
        merge_schemas([T.StructType([T.StructField("a", T.LongType()), T.StructField("A", T.LongType())])])


def test_files_of_two_styles_concatenate(spark):
    m1 = spark.createDataFrame([(dt.date(2024, 1, 1), 5, 0.5, "x")], "Date date, `Clicks (total)` long, `Engagement Rate (total)` double, `Post Link` string")
    m2 = spark.createDataFrame([("2024-01-02", 2.5, 1)], "Date string, `Clicks (total)` double, `Engagement rate (total)` int")
    rows, report = union_widened([m1, m2, m1.limit(0)])
    assert rows.dtypes == [("Date", "string"), ("Clicks (total)", "double"), ("Engagement Rate (total)", "double"), ("Post Link", "string")]
    assert sorted(map(tuple, rows.collect())) == [("2024-01-01", 5.0, 0.5, "x"), ("2024-01-02", 2.5, 1.0, None)]
    assert report == [(0, "Date", "date", "string"), (0, "Clicks (total)", "bigint", "double"), (1, "Engagement Rate (total)", "int", "double"), (1, "Post Link", "missing", "string"),
                      (2, "Date", "date", "string"), (2, "Clicks (total)", "bigint", "double")]


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_stored_profile_equals_a_scan(spark, scratch, fmt):
    raw, clean = os.path.join(scratch, "raw"), os.path.join(scratch, "clean")
    build_raw_tree(raw, months=((2024, 1),), extra_files=False)
    rebuild(spark, raw, clean, fmt=fmt)
    maintain(spark, clean, fmt=fmt)
    for i, (month, period, absent) in enumerate([(2, 1, ""), (2, 2, ""), (3, 1, ""), (2, 1, "competitor")]):  # the last replaces the first
        folder = os.path.join(scratch, f"in-{i}")
        build_single_extraction(folder, 2024, month, period, seed=i)
        for f in os.listdir(folder):
            if absent and absent in f:
                os.unlink(os.path.join(folder, f))
        append_extraction(spark, folder, clean, 2024, month, period, fmt=fmt, replace_absent=True)
    got = {r.dataset: r for r in stored_profile(spark, clean).collect()}
    for n in SPECS:
        df = read_dataset(spark, clean, n, fmt)
        files = [os.path.join(d, f) for d, _, fs in os.walk(os.path.join(clean, "extractions", n)) for f in fs if f.startswith("part-")]
        assert (got[n].num_rows, got[n].num_files) == (df.count(), len(files)), n
        assert got[n].size_MB == round(sum(map(os.path.getsize, files)) / 1e6, 2)
        assert got[n].nulls == {c: df.filter(F.col(f"`{c}`").isNull()).count() for c in clean_schema(n).names[:3]} | {c: got[n].nulls[c] for c in clean_schema(n).names[3:]}
        if fmt == "csv":
            assert got[n].num_lines == sum(len(open(f, newline="").read().splitlines()) for f in files)
