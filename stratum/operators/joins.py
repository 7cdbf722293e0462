"""Join operators: band (date-range) self join, bounded lookups, skip-leading-rows.

A band join ``t2.d BETWEEN t1.d - k AND t1.d`` is never run as a keyed join
followed by a range filter (that emits every pair of rows inside a key before
filtering). Each right-side row is instead replicated to the ``k + 1`` dates
it can match and joined on an equality -- the fan-out is fixed at ``k + 1``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.operators.windows import row_ordinal


def band_self_join_mean(
    df: DataFrame,
    keys,
    date_col: str,
    value_col: str,
    preceding_days: int = 2,
    out: str = "band_mean",
) -> DataFrame:
    """For each row, AVG(value) over rows of the same key dated in [d - k, d].

    ``(keys, date_col)`` must identify a row (e.g. a daily aggregate). Same
    answer as ``rolling_mean_days``; expressed as an equi-join on
    (keys, target date) after a fixed ``k + 1`` fan-out, then a grouped mean.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    right = (df.select(*[F.col(k).alias(f"__r_{k}") for k in keys], F.col(date_col).alias("__rd"),
                       F.col(value_col).alias("__rv"))
             .withColumn("__off", F.explode(F.sequence(F.lit(0), F.lit(preceding_days))))
             .withColumn("__target", F.date_add(F.col("__rd"), F.col("__off")))
             .drop("__off"))
    cond = (F.col(date_col) == F.col("__target"))
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__r_{k}"))
    joined = df.join(right, cond, "left")  # a row without a date has no peers and an empty mean
    group_cols = list(df.columns)
    return joined.groupBy(*group_cols).agg(F.avg(F.col("__rv").cast("double")).alias(out))


def lookup(df: DataFrame, dim: DataFrame, on, how: str = "inner", fixed_size: bool = False) -> DataFrame:
    """Join a dimension. AQE broadcasts it if its measured size allows; ``fixed_size`` asks for
    that beforehand, for dims that never grow with the data (month names, sheet registry)."""
    return df.join(F.broadcast(dim) if fixed_size else dim, on, how)


def skip_leading_rows(df: DataFrame, keys, order_by, n: int = 1, skew_guard: bool = True) -> DataFrame:
    """Drop the first ``n`` rows of every key in ``order_by`` order (skiprows / slice)."""
    ranked = row_ordinal(df, keys, order_by, out="__pos", skew_guard=skew_guard)
    return ranked.filter(F.col("__pos") > n).drop("__pos")


def first_by_order(df: DataFrame, keys, order_col: str, value_cols, prefix: str = "first_",
                   extra_aggs=()) -> DataFrame:
    """Value(s) of the first row per key by ``order_col`` -- ``min_by``, an
    aggregate with map-side partial merge (skew-safe), never a bare ``first()``.
    ``extra_aggs`` are computed in the same aggregate (one shuffle)."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    return df.groupBy(*keys).agg(*[F.min_by(F.col(c), F.col(order_col)).alias(f"{prefix}{c}")
                                   for c in value_cols], *extra_aggs)
