"""Quoted CSV read in several tasks per file, against the rows written and the multi-line reader."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratum.sinks.writers import csv_options, write_table
from stratum.sources.split_csv import read_lines, read_split_csv, records, split_states

SCHEMA = T.StructType([T.StructField("a", T.StringType()), T.StructField("b", T.LongType()), T.StructField("c (x)", T.StringType())])
KEYS = T.StructType([T.StructField("p", T.IntegerType())])


def _rows(n=600):
    rng = random.Random(1)
    bits = ["a", '"', '""', "\n", "\n\n", ";", ",", "é", "\r\n", "\r", " ", "long text here "]
    text = lambda low, high: "".join(rng.choice(bits) for _ in range(rng.randint(low, high)))
    return [(text(0, 12) or None, rng.randint(0, 9) if rng.random() < 0.9 else None, text(1, 30), i % 2) for i in range(n)] + [("x" * 3000 + '"\n"' * 500, 1, "y", 0)]


@pytest.fixture()
def split_bytes(spark):
    """Sets the size of a split; Spark's own setting afterwards."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum")

    def to(size):
        for name, value in zip(names, (size, 1, 1), strict=True):
            spark.conf.set(name, str(value))

    yield to
    for name in names:
        spark.conf.unset(name)


@pytest.mark.parametrize("dialect", ["quoted", "semicolon"])
def test_rows_survive_any_split(spark, scratch, split_bytes, dialect):
    rows = _rows()
    df = spark.createDataFrame(rows, T.StructType([*SCHEMA.fields, *KEYS.fields]))
    write_table(df.coalesce(1), f"{scratch}/t", fmt="csv", dialect=dialect, partition_by=["p"])
    options = csv_options(dialect)
    plain = spark.read.schema(SCHEMA).options(**{k: v for k, v in options.items() if k != "quoteAll"}).option("multiLine", "true").csv(f"{scratch}/t")
    want = sorted(map(tuple, rows), key=str)
    assert sorted(map(tuple, plain.collect()), key=str) == want
    for size in (150, 1000, 20_000, 10**8):
        split_bytes(size)
        got = read_split_csv(spark, f"{scratch}/t", SCHEMA, options, KEYS)
        assert got.columns == plain.columns and sorted(map(tuple, got.collect()), key=str) == want
        splits = read_lines(spark, f"{scratch}/t").select("__path", "__block").distinct().count()
        assert splits > 10 if size < 2000 else splits >= 2


def test_several_tasks_read_one_file(spark, scratch, split_bytes):
    df = spark.range(4000).select(F.concat(F.lit('a\n"b"; '), F.col("id").cast("string")).alias("a"), F.col("id").alias("b"))
    write_table(df.coalesce(1), f"{scratch}/one", fmt="csv", dialect="semicolon")
    split_bytes(8000)
    lines = read_lines(spark, f"{scratch}/one")
    assert lines.rdd.getNumPartitions() > 5 and split_states(lines).count() > 1
    got = read_split_csv(spark, f"{scratch}/one", T.StructType.fromDDL("a string, b long"), csv_options("semicolon"))
    assert got.filter(F.col("a") == F.concat(F.lit('a\n"b"; '), F.col("b").cast("string"))).count() == got.count() == 4000


def test_defined_cases(spark, tmp_path, split_bytes):
    files = {
        "a.csv": 'a,"b\nhead",c\r\n1,"x\r\ny",2\r\n\r\n"",,"3"\r\n',
        "b.csv": 'a,b,c\nlast,"never closed\nto the end',
        "c.csv": "",
        "d.csv": 'only a header\n',
    }
    for name, text in files.items():
        (tmp_path / name).write_bytes(text.encode())
    for size in (3, 10, 10**6):
        split_bytes(size)
        got = {r.a: (r.b, r.c) for r in read_split_csv(spark, str(tmp_path), T.StructType.fromDDL("a string, b string, c string"), csv_options("quoted")).collect()}
        assert got.pop("last")[0].endswith("never closed\nto the end")
        assert got == {None: (None, "3"), "1": ("x\r\ny", "2")}  # as Spark's reader, an empty field is NULL
        assert records(spark, str(tmp_path)).count() == 3
