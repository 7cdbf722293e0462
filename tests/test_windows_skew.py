"""The hot-key split must give exactly the plain window's answer."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from stratum.operators.windows import find_hot_keys, rolling_mean_days, rolling_mean_rows, row_ordinal


def _data(spark, n=3000, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        # key 0 holds ~half of the rows, key None a tenth
        k = 0 if rng.random() < 0.5 else (None if rng.random() < 0.2 else rng.randint(1, 9))
        v = None if rng.random() < 0.05 else round(rng.uniform(-50, 100), 2)
        rows.append((k, i * 7 + rng.randint(0, 6), v))
    return spark.createDataFrame(rows, "k int, o long, v double")


@pytest.mark.parametrize("preceding", [1, 2, 4])
def test_rolling_split_matches_plain(spark, preceding):
    df = _data(spark)
    plain = rolling_mean_rows(df, "k", "o", {"ma": "v"}, preceding=preceding, skew_guard=False)
    split = rolling_mean_rows(df, "k", "o", {"ma": "v"}, preceding=preceding, hot_key_rows=97)
    assert len(find_hot_keys(df, ["k"], 97)) >= 2
    a = {(r.k, r.o): r.ma for r in plain.collect()}
    b = {(r.k, r.o): r.ma for r in split.collect()}
    assert a.keys() == b.keys()
    for key, x in a.items():
        y = b[key]
        assert (x is None and y is None) or x == pytest.approx(y, abs=1e-9), key


def test_rolling_min_periods(spark):
    df = _data(spark, n=500)
    plain = rolling_mean_rows(df, "k", "o", {"ma": "v"}, preceding=3, min_periods=2, skew_guard=False)
    split = rolling_mean_rows(df, "k", "o", {"ma": "v"}, preceding=3, min_periods=2, hot_key_rows=23)
    a = sorted((r.k if r.k is not None else -1, r.o, r.ma if r.ma is not None else -1e9) for r in plain.collect())
    b = sorted((r.k if r.k is not None else -1, r.o, r.ma if r.ma is not None else -1e9) for r in split.collect())
    assert [x[:2] for x in a] == [x[:2] for x in b]
    assert all(abs(x[2] - y[2]) < 1e-9 for x, y in zip(a, b))


def test_row_ordinal_split_matches_plain(spark):
    df = _data(spark)
    plain = row_ordinal(df, "k", ["o"], skew_guard=False)
    split = row_ordinal(df, "k", ["o"], hot_key_rows=50)
    a = {(r.k, r.o): r.ordinal for r in plain.collect()}
    b = {(r.k, r.o): r.ordinal for r in split.collect()}
    assert a == b
    assert max(a.values()) > 1000


def test_split_with_few_leading_values(spark):
    """A hot key whose leading order column has one value still splits (range buckets
    over the whole order tuple)."""
    rows = [(1, 0, i, float(i % 7)) for i in range(600)] + [(2, 0, i, 1.0) for i in range(50)]
    df = spark.createDataFrame(rows, "k int, day int, o long, v double")
    plain = rolling_mean_rows(df, "k", ["day", "o"], {"m": "v"}, skew_guard=False)
    split = rolling_mean_rows(df, "k", ["day", "o"], {"m": "v"}, hot_key_rows=100)
    a = {(r.k, r.o): r.m for r in plain.collect()}
    b = {(r.k, r.o): r.m for r in split.collect()}
    assert a.keys() == b.keys() and all(
        (a[x] is None and b[x] is None) or abs(a[x] - b[x]) < 1e-9 for x in a)
    o_plain = {(r.k, r.o): r.ordinal for r in row_ordinal(df, "k", ["day", "o"], skew_guard=False).collect()}
    o_split = {(r.k, r.o): r.ordinal for r in row_ordinal(df, "k", ["day", "o"], hot_key_rows=100).collect()}
    assert o_plain == o_split
    from stratum.operators.windows import _with_buckets, find_hot_keys as fh
    hot = fh(df, ["k"], 100)
    buckets = _with_buckets(df, ["k"], ["day", "o"], hot, 100).filter("k = 1").select("__bkt").distinct().count()
    assert buckets >= 4  # 600 rows / 100 per bucket, despite a single `day` value


def test_split_plan_windows_per_bucket(spark, capsys):
    df = _data(spark)
    split = rolling_mean_rows(df, "k", "o", {"ma": "v"}, hot_key_rows=97)
    split.explain()
    plan = capsys.readouterr().out
    assert "__bkt" in plan and "BroadcastHashJoin" in plan
    assert split.filter(F.col("ma").isNotNull()).count() > 0


@pytest.mark.parametrize("preceding", [1, 2, 5])
def test_days_over_daily_partials_match_a_plain_window(spark, preceding):
    import datetime as dt

    rng = random.Random(preceding)
    rows = []
    for i in range(1500):
        k = 0 if rng.random() < 0.6 else rng.choice([1, 2, 3, None])
        day = dt.date(2024, 1, 1) + dt.timedelta(days=rng.choice([5, 5, 5, rng.randint(0, 90)]))
        rows.append((k, None if rng.random() < 0.02 else day, i, None if rng.random() < 0.05 else rng.randint(-5, 40)))
    df = spark.createDataFrame(rows, "k int, d date, i long, v long")
    w = Window.partitionBy("k").orderBy(F.unix_date("d")).rangeBetween(-preceding, 0)
    plain = df.withColumn("m", F.avg("v").over(w))
    split = rolling_mean_days(df, "k", "d", {"m": "v"}, preceding_days=preceding)
    assert split.columns == plain.columns
    a = {r.i: r.m for r in plain.collect()}
    b = {r.i: r.m for r in split.collect()}
    assert len(a) == split.count() == len(rows) and a.keys() == b.keys()
    for i, x in a.items():
        y = b[i]
        assert (x is None and y is None) or abs(x - y) < 1e-9, i


def test_a_date_with_half_of_all_rows_runs_in_several_tasks(spark):
    """Neither side broadcast: AQE splits the rows of the hot date."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "50k", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "40k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2"}
    old = {k: spark.conf.get(k, None) for k in conf}
    hot = F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 200)
    df = spark.range(0, 200_000, 1, 8).select(F.lit(1).alias("k"), F.date_add(F.lit("2024-01-01").cast("date"), hot.cast("int")).alias("d"), (F.col("id") % 17).alias("v"), F.sha1(F.col("id").cast("string")).alias("t"))
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        out = rolling_mean_days(df, "k", "d", {"m": "v"}).select("d", "m", "t", F.spark_partition_id().alias("p"))
        tasks = out.filter("d = '2024-01-01'").groupBy("p").agg(F.count("t").alias("n"), F.max("t")).collect()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert sum(r.n for r in tasks) == 100_000 and len(tasks) > 1


def test_split_on_post_shuffle_input(spark):
    """Input whose row order comes out of a shuffle (not deterministic): the bucket
    assignment is materialized once, so the window and the stitching agree."""
    base = _data(spark, n=2000, seed=11)
    shuffled = base.groupBy("k", "o").agg(F.max("v").alias("v")).repartition(5, "o")
    plain = rolling_mean_rows(shuffled, "k", "o", {"m": "v"}, skew_guard=False)
    split = rolling_mean_rows(shuffled, "k", "o", {"m": "v"}, hot_key_rows=40)
    a = {(r.k, r.o): r.m for r in plain.collect()}
    b = {(r.k, r.o): r.m for r in split.collect()}
    assert a.keys() == b.keys()
    assert all((a[x] is None and b[x] is None) or abs(a[x] - b[x]) < 1e-9 for x in a)
    assert {(r.k, r.o): r.ordinal for r in row_ordinal(shuffled, "k", "o", skew_guard=False).collect()} == \
        {(r.k, r.o): r.ordinal for r in row_ordinal(shuffled, "k", "o", hot_key_rows=40).collect()}
