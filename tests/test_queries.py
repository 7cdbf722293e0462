"""Every registered query against its DuckDB oracle (value-level, order-insensitive)."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from check_oracle import duck, rows_of  # noqa: E402

import __spark_entry__ as entry_mod  # noqa: E402
from conftest import SF_SMALL  # noqa: E402

# the library's own queries; those of optional subpackages have their own tests
QUERIES = entry_mod.catalog.QUERIES
ORACLE = entry_mod.catalog.ORACLE


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_every_query_has_oracle_or_reason():
    missing = sorted(set(QUERIES) - set(ORACLE))
    assert missing == [], missing


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_query_matches_oracle(spark, con, key):
    df = QUERIES[key](spark, SF_SMALL)
    s_cols = df.columns
    s_rows = [tuple(r) for r in df.collect()]
    res = con.execute(ORACLE[key])
    d_cols = [d[0] for d in res.description]
    d_rows = res.fetchall()
    assert sorted(s_cols) == sorted(d_cols)
    assert len(s_rows) == len(d_rows)
    assert rows_of(s_cols, s_rows) == rows_of(d_cols, d_rows)


def test_entry_smoke(spark):
    df = entry_mod.entry(spark)
    assert df.count() > 0
    assert df.columns == ["day", "impressions", "clicks", "reactions", "comments", "engagement_rate",
                          "extraction_range"]


@pytest.mark.parametrize("key", ["moving_avg_rows", "repair_negative", "period_ordinal", "skip_rows"])
def test_window_queries_on_split_path(spark, con, key):
    """Force every key hot: the range-bucketed plan must still equal the oracle."""
    spark.conf.set("stratum.window.hotKeyRows", "3")
    try:
        df = QUERIES[key](spark, SF_SMALL)
        s_rows = [tuple(r) for r in df.collect()]
    finally:
        spark.conf.unset("stratum.window.hotKeyRows")
    res = con.execute(ORACLE[key])
    assert rows_of(df.columns, s_rows) == rows_of([d[0] for d in res.description], res.fetchall())
