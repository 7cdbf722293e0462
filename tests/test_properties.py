"""Properties: partitioning independence, split == plain, union conservation, no negatives."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stratum.operators import setops as U
from stratum.operators.repair import repair_metrics
from stratum.operators.windows import rolling_mean_rows, row_ordinal

SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))

rows_st = st.lists(
    st.tuples(st.integers(0, 3), st.one_of(st.none(), st.integers(-20, 50))), min_size=1, max_size=60)


def _df(spark, rows):
    data = [(k, i, dt.date(2024, 1, 1) + dt.timedelta(days=i), v) for i, (k, v) in enumerate(rows)]
    return spark.createDataFrame(data, "k int, o long, d date, v long")


def _as_map(df, col):
    return {(r.k, r.o): r[col] for r in df.collect()}


@SETTINGS
@given(rows=rows_st, parts=st.integers(1, 6))
def test_repair_independent_of_partitioning(spark, rows, parts):
    df = _df(spark, rows)
    a = repair_metrics(df.coalesce(1), "k", "o", ["v"])
    b = repair_metrics(df.repartition(parts), "k", "o", ["v"])
    assert _as_map(a, "v") == _as_map(b, "v")


@SETTINGS
@given(rows=rows_st, hot=st.integers(2, 15), preceding=st.integers(1, 3))
def test_split_equals_plain(spark, rows, hot, preceding):
    df = _df(spark, rows)
    plain = _as_map(rolling_mean_rows(df, "k", "o", {"m": "v"}, preceding=preceding, skew_guard=False), "m")
    split = _as_map(rolling_mean_rows(df, "k", "o", {"m": "v"}, preceding=preceding, hot_key_rows=hot), "m")
    assert plain.keys() == split.keys()
    for key, x in plain.items():
        y = split[key]
        assert (x is None and y is None) or abs(x - y) < 1e-9
    assert _as_map(row_ordinal(df, "k", "o", skew_guard=False), "ordinal") == \
        _as_map(row_ordinal(df, "k", "o", hot_key_rows=hot), "ordinal")


@SETTINGS
@given(rows=rows_st)
def test_no_negative_once_frame_is_full(spark, rows):
    out = repair_metrics(_df(spark, rows), "k", "o", ["v"], keep_helpers=True)
    bad = out.filter((F.col("v (moving average)").isNotNull()) & (F.col("v") < 0))
    assert bad.count() == 0


@SETTINGS
@given(a=st.integers(0, 30), b=st.integers(0, 30), c=st.integers(0, 30))
def test_union_conserves_rows(spark, a, b, c):
    d1 = spark.range(a).select(F.col("id").alias("x"))
    d2 = spark.range(b).select(F.col("id").alias("x"), F.lit("y").alias("y"))
    d3 = spark.range(c).select(F.col("id").alias("x"))
    assert U.union_by_name([d1, d2, d3]).count() == a + b + c
    assert U.union_positional([d1, d3]).count() == a + c


cell_st = st.one_of(
    st.none(),
    st.integers(-10**12, 10**12),
    st.text(alphabet=st.characters(blacklist_categories=("Cs", "Cc"), blacklist_characters="\x00")
            | st.sampled_from(["\n", "\t", "<", ">", "&", '"', "'", ";", ","]), min_size=1, max_size=30),
)


@settings(max_examples=60, deadline=None)
@given(rows=st.lists(st.lists(cell_st, min_size=1, max_size=8), min_size=1, max_size=12))
def test_xlsx_decode_roundtrip(tmp_path_factory, rows):
    import os

    from stratum.sources.xlsx import decode_workbook
    from tools.xlsx_writer import write_xlsx

    path = os.path.join(str(tmp_path_factory.mktemp("x")), "w.xlsx")
    write_xlsx(path, [("s", rows)])
    with open(path, "rb") as fh:
        got = list(decode_workbook(fh.read(), [0]))
    assert [g[1] for g in got] == list(range(len(rows)))
    for (_, _, cells), row in zip(got, rows):
        want = ["" if v is None else str(v) for v in row]
        # trailing empty cells are not stored; interior gaps come back as None
        while want and want[-1] == "":
            want.pop()
        assert [("" if c is None else c) for c in cells] == want


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(batch=st.lists(st.tuples(st.integers(1900, 2100), st.integers(1, 12), st.integers(1, 3)),
                      min_size=1, max_size=40))
def test_period_end_matches_calendar(spark, batch):
    import calendar

    from stratum.functions.columns import period_end_date

    df = spark.createDataFrame(batch, "y int, m int, p int")
    got = [r[0] for r in df.select(period_end_date("y", "m", "p")).collect()]
    want = [dt.date(y, m, calendar.monthrange(y, m)[1] if p == 2 else 15) for y, m, p in batch]
    assert got == want


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(xs=st.lists(st.integers(-10**6, 10**6), min_size=1, max_size=40))
def test_half_even_matches_python_round(spark, xs):
    from stratum.functions.columns import round_half_even_long

    vals = [x / 2 for x in xs]  # exact halves and integers
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    assert [r[0] for r in df.select(round_half_even_long("v")).collect()] == [round(v) for v in vals]


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(words=st.lists(st.text(alphabet="abcXYZ 19-", min_size=0, max_size=12), min_size=1, max_size=20))
def test_month_roundtrip_and_capitalize(spark, words):
    from stratum.functions.columns import capitalize, month_name, month_number

    months = spark.range(1, 13).select(F.col("id").cast("int").alias("m"))
    assert [r[0] for r in months.select(month_number(month_name("m"))).collect()] == list(range(1, 13))
    df = spark.createDataFrame([(w,) for w in words], "w string")
    assert [r[0] for r in df.select(capitalize("w")).collect()] == [w.capitalize() for w in words]
