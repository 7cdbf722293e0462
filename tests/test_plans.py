"""Physical-plan guards: pushdown, pruning, no pairwise joins or Python evaluation."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from plan_report import formatted_plan, summarize  # noqa: E402

from conftest import SF_SMALL  # noqa: E402

from stratum.plans.catalog import QUERIES  # noqa: E402

# queries that read files which Python tasks decode or cut into records
DECODED = {"flat_layer_roundtrip", "quoted_csv_layer"}
JVM_ONLY = sorted(k for k in QUERIES if k not in DECODED)


def _summary(spark, key):
    return summarize(formatted_plan(QUERIES[key](spark, SF_SMALL)))


def test_filter_pushed_to_scan(spark):
    s = _summary(spark, "filter_eq")
    assert any("EqualTo(event_type,purchase)" in p for p in s["pushed_filters"])


def test_projection_pruned_at_scan(spark):
    assert _summary(spark, "project_subset")["scan_columns"] == [5]  # of lineitem's 11
    assert _summary(spark, "content_metrics_clean")["scan_columns"] == [2]  # ts, event_type of 6


def test_flagship_is_one_aggregate_and_one_window(spark):
    s = _summary(spark, "content_metrics_clean")
    assert s["windows"] == 1 and s["shuffles"] == 2


@pytest.mark.parametrize("key", JVM_ONLY)
def test_no_pairwise_join_or_python(spark, key):
    assert _summary(spark, key)["bad_nodes"] == []
