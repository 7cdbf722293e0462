"""Column builders, set operations, DDL-style column ops and profiles."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from stratum.functions import columns as C
from stratum.operators import columns as COL
from stratum.operators import joins as J
from stratum.operators import profile as P
from stratum.operators import setops as U


def test_round_half_even(spark):
    df = spark.createDataFrame([(2.5,), (3.5,), (2.7,), (-2.5,)], "x double")
    assert [r[0] for r in df.select(C.round_half_even_long("x")).collect()] == [2, 4, 3, -2]


def test_month_lookup_and_unknown(spark):
    df = spark.createDataFrame([("Maio",), ("Dez",), ("May",)], "m string")
    assert [r[0] for r in df.select(C.month_number("m")).collect()] == [5, 12, None]


def test_classify_order(spark):
    df = spark.createDataFrame([("competitor_content.xlsx",), ("x_followers.xlsx",), ("other.xlsx",)], "f string")
    assert [r[0] for r in df.select(C.classify_category("f")).collect()] == ["competitor", "followers", None]


def test_parse_date_variants(spark):
    df = spark.createDataFrame([("1/5/2024",), ("2024-01-05",), ("",), (None,), ("45296",), ("02/30/2024",),
                                ("45296.75",), ("2024-01-05 13:00:00",)], "s string")
    got = [r[0] for r in df.select(C.parse_date("s")).collect()]
    d = dt.date(2024, 1, 5)
    assert got == [d, d, None, None, d, None, d, d]


def test_parse_date_strict_raises(spark):
    df = spark.createDataFrame([("not a date",)], "s string")
    with pytest.raises(Exception):
        df.select(C.parse_date_strict("s")).collect()


def test_capitalize_is_not_initcap(spark):
    df = spark.createDataFrame([("pOLARS engine",)], "s string")
    assert df.select(C.capitalize("s")).first()[0] == "Polars engine"


def test_dataset_name(spark):
    df = spark.createDataFrame([("/a/b/all_extractions_content_posts.csv",)], "p string")
    assert df.select(C.dataset_name_from_file("p")).first()[0] == "content_posts"


def test_union_strict_reorders_and_checks(spark):
    a = spark.createDataFrame([(1, "x")], "k long, v string")
    b = spark.createDataFrame([("y", 2)], "v string, k long")
    assert [tuple(r) for r in U.union_strict([a, b]).collect()] == [(1, "x"), (2, "y")]
    c = spark.createDataFrame([(1, 2.0)], "k long, v double")
    with pytest.raises(ValueError):
        U.union_strict([a, c])


def test_union_by_name_fills_nulls(spark):
    a = spark.createDataFrame([(1, "x")], "k long, v string")
    b = spark.createDataFrame([(2,)], "k long")
    got = sorted(tuple(r) for r in U.union_by_name([a, b, b]).collect())
    assert got == [(1, "x"), (2, None), (2, None)]


def test_union_positional_width(spark):
    a = spark.createDataFrame([(1, "x")], "k long, v string")
    b = spark.createDataFrame([(2,)], "k long")
    with pytest.raises(ValueError):
        U.union_positional([a, b])


def test_add_column_if_not_exists(spark):
    df = spark.createDataFrame([(1,)], "a long")
    out = COL.add_column(COL.add_column(df, "b", "double"), "B", "date")
    assert out.columns == ["a", "b"]
    with pytest.raises(ValueError):
        COL.add_column(out, "b", "double", if_not_exists=False)


def test_positional_rename_arity(spark):
    df = spark.createDataFrame([(1, 2)], "a long, b long")
    with pytest.raises(ValueError):
        COL.positional_rename(df, ["x"])


def test_update_from_keeps_unmatched(spark):
    t = spark.createDataFrame([(1, 10.0), (2, 20.0), (3, 30.0)], "k long, v double")
    u = spark.createDataFrame([(1, 11.0), (3, None)], "k long, v double")
    got = sorted(tuple(r) for r in COL.update_from(t, u, "k", "v").collect())
    assert got == [(1, 11.0), (2, 20.0), (3, None)]  # a matched NULL is set, as UPDATE .. FROM does


def test_two_updates_of_a_row_raise(spark):
    t = spark.createDataFrame([(1, 10.0), (2, 20.0), (None, 5.0)], "k long, v double")
    u = spark.createDataFrame([(1, 11.0), (9, 1.0), (9, 2.0), (None, 3.0), (None, 4.0)], "k long, v double")
    assert sorted(map(tuple, COL.update_from(t, u, "k", "v").collect()), key=str) == [(1, 11.0), (2, 20.0), (None, 5.0)]  # 9 and NULL update no row
    with pytest.raises(Exception, match="several updates of one row"):
        COL.update_from(t, u.union(u.filter("k = 1")), "k", "v").collect()


def test_band_join_has_no_pairwise_blowup(spark, capsys):
    days = [dt.date(2024, 1, d) for d in range(1, 11)]
    df = spark.createDataFrame([("a", d, i) for i, d in enumerate(days)], "k string, d date, n long")
    out = J.band_self_join_mean(df, "k", "d", "n", 2, out="m")
    got = {r.d: r.m for r in out.collect()}
    assert got[days[0]] == 0 and got[days[1]] == 0.5 and got[days[5]] == 4.0
    out.explain()
    plan = capsys.readouterr().out
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_skip_and_first(spark):
    df = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 5, "c")], "g long, o long, t string")
    assert sorted(tuple(r) for r in J.skip_leading_rows(df, "g", "o").collect()) == [(1, 2, "b")]
    assert sorted(tuple(r) for r in J.first_by_order(df, "g", "o", ["t"]).collect()) == [(1, "a"), (2, "c")]


def test_stage_report(spark):
    m = spark.createDataFrame([("1y", "polars", 1.0, 2.0, 3.0), ("1y", "polars", 3.0, 2.0, 5.0)],
                              "environment string, engine string, extract_data double, transform_data double, "
                              "total_etl_time double")
    means, steps = P.stage_report(m)
    assert means.first().total_etl_time == 4.0
    assert steps.count() == 4 and set(steps.columns) == {"environment", "engine", "total_etl_time", "etl_step",
                                                         "seconds"}


def test_unpivot_excludes(spark):
    df = spark.createDataFrame([("1y", 88, 330, 12422)], "environment string, num_files long, num_tables long, "
                                                          "total_rows long")
    out = P.unpivot_metrics(df, "environment", ["num_files", "num_tables", "total_rows"], "Atributos", "qtd",
                            exclude=["total_rows"])
    assert sorted(r.Atributos for r in out.collect()) == ["num_files", "num_tables"]


def test_mask_and_fill(spark):
    df = spark.createDataFrame([(-1.0,), (2.0,), (None,)], "x double")
    got = [tuple(r) for r in df.select(C.mask_nonneg("x"), C.fill_zero(C.mask_nonneg("x")),
                                       C.clamp_nonneg("x")).collect()]
    assert got == [(None, 0.0, 0.0), (2.0, 2.0, 2.0), (None, 0.0, 0.0)]
    assert df.select(C.ratio(F.lit(1), F.lit(0))).first()[0] is None
