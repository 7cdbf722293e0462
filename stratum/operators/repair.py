"""The metric-repair kernel: clamp -> moving average -> replace negatives -> rate.

Negative daily counts in an export are data errors. Each one is replaced by the
mean of the clamped (negative/NULL -> 0) values of the current and previous
days *of the same extraction*; the engagement rate is then recomputed from
the repaired counts. Two frame flavours exist:

* ``frame="rows"``  -- current + ``preceding`` rows in file order, NULL until the
  frame is full (min_periods = frame size). Canonical.
* ``frame="days"``  -- rows dated within ``preceding`` calendar days before the
  current date, partial frames allowed.

The whole kernel is one lazy plan: a projection, one window (all metrics share
the spec, so Catalyst builds a single Window node over one shuffle) and a
final projection.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.functions.columns import clamp_nonneg, engagement_rate, replace_negative
from stratum.operators.windows import rolling_mean_days, rolling_mean_rows


def repair_metrics(
    df: DataFrame,
    keys,
    order_by,
    metrics,
    null_policy: str = "keep",
    frame: str = "rows",
    preceding: int = 2,
    date_col: str | None = None,
    keep_helpers: bool = False,
    skew_guard: bool = True,
    hot_key_rows: int | None = None,
) -> DataFrame:
    """Replace negative values of ``metrics`` by their per-key moving average.

    Repaired metric columns become DOUBLE (an average is fractional). Helper
    columns ``<m> (positive)`` / ``<m> (moving average)`` are kept on request.
    """
    metrics = list(metrics)
    pos = {m: f"{m} (positive)" for m in metrics}
    ma = {m: f"{m} (moving average)" for m in metrics}
    staged = df.withColumns({pos[m]: clamp_nonneg(m) for m in metrics})
    if frame == "rows":
        staged = rolling_mean_rows(staged, keys, order_by, {ma[m]: pos[m] for m in metrics},
                                   preceding=preceding, skew_guard=skew_guard, hot_key_rows=hot_key_rows)
    elif frame == "days":
        if date_col is None:
            raise ValueError("frame='days' needs date_col")
        staged = rolling_mean_days(staged, keys, date_col, {ma[m]: pos[m] for m in metrics},
                                   preceding_days=preceding, bounded=not skew_guard)
    else:
        raise ValueError(f"frame must be 'rows' or 'days', got {frame!r}")
    out = staged.withColumns({
        m: replace_negative(F.col(m).cast("double"), F.col(ma[m]), null_policy) for m in metrics})
    if not keep_helpers:
        out = out.drop(*pos.values(), *ma.values())
    return out


def clean_content_metrics(
    df: DataFrame,
    keys=("year", "month", "period", "source_file"),
    order_by="row_idx",
    null_policy: str = "keep",
    frame: str = "rows",
    extra_cols=("year", "month", "period", "source_file", "row_idx"),
) -> DataFrame:
    """Clean a typed ``content_metrics`` dataset (one frame per extraction file).

    Output: Date, Impressions (total), Clicks/Reactions/Comments/Shares (total)
    as DOUBLE, recomputed ``Engagement Rate (total)``, Extraction Range, plus
    the partition/lineage columns present in ``extra_cols``.
    """
    from stratum.registry import CONTENT_METRICS_CLEAN, CONTENT_METRICS_REPAIRED

    keys = [k for k in keys if k in df.columns]
    base = df.select(*[c for c in CONTENT_METRICS_CLEAN if c in df.columns and c != "Engagement Rate (total)"],
                     *[c for c in extra_cols if c in df.columns])
    # A rows frame inside one workbook sheet is bounded by the sheet row limit,
    # so the per-file window needs no skew split.
    repaired = repair_metrics(base, keys, order_by if frame == "rows" else None, CONTENT_METRICS_REPAIRED,
                              null_policy=null_policy, frame=frame, date_col="Date",
                              skew_guard=False)
    # The raw rate differs from the output name only by case; drop it before adding ours.
    repaired = repaired.drop("Engagement rate (total)").withColumn(
        "Engagement Rate (total)",
        engagement_rate(["Reactions (total)", "Comments (total)", "Clicks (total)", "Shares (total)"],
                        "Impressions (total)"))
    return repaired.select(*CONTENT_METRICS_CLEAN, *[c for c in extra_cols if c in df.columns])
