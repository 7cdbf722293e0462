"""Hand-computed golden for the repair kernel (clamp, moving average, replace, rate)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from stratum.functions.columns import period_end_date
from stratum.operators.repair import clean_content_metrics, repair_metrics

D = dt.date
RAW = [  # row_idx, Date, Reactions (total)
    (0, D(2024, 1, 16), 5), (1, D(2024, 1, 17), -2), (2, D(2024, 1, 18), 4),
    (3, D(2024, 1, 19), -3), (4, D(2024, 1, 20), None), (5, D(2024, 1, 21), 0),
]


def _frame(spark, rows, files=("f1",)):
    data = [(f, i, d, v) for f in files for (i, d, v) in rows]
    return spark.createDataFrame(data, "source_file string, row_idx long, Date date, r long")


def _vals(df, col="r"):
    return [r[col] for r in df.orderBy("source_file", "row_idx").collect()]


def approx(xs):
    return [None if x is None else pytest.approx(x, abs=1e-4) for x in xs]


def test_rows_frame_keep_nulls(spark):
    out = repair_metrics(_frame(spark, RAW), ["source_file"], "row_idx", ["r"], keep_helpers=True)
    assert _vals(out, "r (positive)") == [5, 0, 4, 0, 0, 0]
    assert _vals(out, "r (moving average)") == approx([None, None, 3.0, 4 / 3, 4 / 3, 0.0])
    assert _vals(out) == approx([5, None, 4, 4 / 3, None, 0])


def test_rows_frame_repair_nulls(spark):
    out = repair_metrics(_frame(spark, RAW), ["source_file"], "row_idx", ["r"], null_policy="repair")
    assert _vals(out) == approx([5, None, 4, 4 / 3, 4 / 3, 0])


def test_days_frame(spark):
    out = repair_metrics(_frame(spark, RAW), ["source_file"], None, ["r"], frame="days", date_col="Date",
                         keep_helpers=True)
    assert _vals(out, "r (moving average)") == approx([5.0, 2.5, 3.0, 4 / 3, 4 / 3, 0.0])
    assert _vals(out) == approx([5, 2.5, 4, 4 / 3, None, 0])


def test_second_file_restarts_frame(spark):
    out = repair_metrics(_frame(spark, RAW, files=("f1", "f2")), ["source_file"], "row_idx", ["r"])
    vals = _vals(out)
    assert vals[:6] == vals[6:]
    assert vals[7] is None  # second row of the second file: frame not yet full


def test_date_gap(spark):
    gap = [r for r in RAW if r[1] != D(2024, 1, 18)]
    rows = repair_metrics(_frame(spark, gap), ["source_file"], "row_idx", ["r"], keep_helpers=True)
    days = repair_metrics(_frame(spark, gap), ["source_file"], None, ["r"], frame="days", date_col="Date",
                          keep_helpers=True)
    at = {r["Date"]: r["r (moving average)"] for r in rows.collect()}
    at_d = {r["Date"]: r["r (moving average)"] for r in days.collect()}
    assert at[D(2024, 1, 19)] == pytest.approx(5 / 3)
    assert at_d[D(2024, 1, 19)] == pytest.approx(0.0)


def test_no_negative_after_repair_and_rate(spark):
    rows = []
    for i in range(10):
        rows.append(("f", i, D(2024, 1, 1 + i), 10 - 3 * i, i - 4, 2, 1, 0 if i == 3 else 10))
    df = spark.createDataFrame(rows, "source_file string, row_idx long, Date date, `Clicks (total)` long, "
                                     "`Reactions (total)` long, `Comments (total)` long, `Shares (total)` long, "
                                     "`Impressions (total)` long")
    df = df.withColumns({"year": F.lit(2024), "month": F.lit(1), "period": F.lit(1),
                         "Engagement rate (total)": F.lit(0.5)})
    df = df.withColumn("Extraction Range", period_end_date("year", "month", "period"))
    out = clean_content_metrics(df)
    assert out.columns[:8] == ["Date", "Impressions (total)", "Clicks (total)", "Reactions (total)",
                               "Comments (total)", "Shares (total)", "Engagement Rate (total)", "Extraction Range"]
    got = out.orderBy("row_idx").collect()
    for r in got[2:]:
        for c in ["Clicks (total)", "Reactions (total)"]:
            assert r[c] is None or r[c] >= 0
    assert got[3]["Engagement Rate (total)"] is None  # zero impressions
    assert got[0]["Reactions (total)"] is None and got[0]["Engagement Rate (total)"] is None
    r = got[6]
    parts = r["Clicks (total)"] + r["Reactions (total)"] + r["Comments (total)"] + r["Shares (total)"]
    assert r["Engagement Rate (total)"] == pytest.approx(parts / 10)


def test_period_end_dates(spark):
    df = spark.createDataFrame([(2024, 2, 1), (2024, 2, 2), (2023, 2, 2), (2024, 2, 3)], "y int, m int, p int")
    got = [r[0] for r in df.select(period_end_date("y", "m", "p")).collect()]
    assert got == [D(2024, 2, 15), D(2024, 2, 29), D(2023, 2, 28), D(2024, 2, 15)]
