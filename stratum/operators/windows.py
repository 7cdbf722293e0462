"""Window operators: rolling rows-frame mean, calendar-day range mean, ordinals.

Skew handling
-------------
A window partition is processed by one task, so a partition key that holds a
large share of the rows (one nation out of 25, one customer with a third of all
orders) pins that share on a single executor. ``rolling_mean_days`` needs no split: its window
runs over one row per key and date. ``rolling_mean_rows`` and ``row_ordinal`` split *hot* keys:

1. A cheap aggregate (partial aggregation, only key + order columns) finds
   keys with more than ``hot_key_rows`` rows. Their number is bounded by
   ``total_rows / hot_key_rows``, which is what makes broadcasting them safe.
2. Rows of hot keys are range-partitioned on (key, order...) into
   ``sum(ceil(n / hot_key_rows))`` partitions (Spark's sampled range
   boundaries over the full order tuple); the partition index is the bucket,
   so each bucket is a contiguous slice of one key's order, balanced even when
   the leading order column has few distinct values. The window then runs per
   (key, bucket); cold keys keep a single bucket 0 and are not range-shuffled.
3. The frame edge of each bucket is stitched from a correction table built
   from the last ``preceding`` rows of every hot bucket (top-k per group, which
   Spark evaluates map-side with a partial WindowGroupLimit). That table has at
   most ``preceding`` rows per hot bucket and is broadcast.

Cold keys take the plain path (bucket 0) in the same plan. When no key is hot
the plan is a single ``Window`` over one shuffle.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratum.session import cut_lineage

DEFAULT_HOT_KEY_ROWS = 4_000_000
# Row limit for broadcasting the per-bucket helper tables; above it they are
# joined with a shuffle instead (their size is known on the driver up front).
MAX_BROADCAST_ROWS = 2_000_000
_BKT = "__bkt"
_HOT = "__hot"


def _hot_key_rows(spark, hot_key_rows):
    if hot_key_rows is not None:
        return int(hot_key_rows)
    return int(spark.conf.get("stratum.window.hotKeyRows", str(DEFAULT_HOT_KEY_ROWS)))


def _bounded_broadcast(df: DataFrame, rows_bound: int) -> DataFrame:
    """Broadcast ``df`` only when its known row bound is under the limit."""
    return F.broadcast(df) if rows_bound <= MAX_BROADCAST_ROWS else df


def _bucket_count(hot_rows, hot_key_rows: int) -> int:
    return sum(int(math.ceil(r["__n"] / hot_key_rows)) for r in hot_rows)


def find_hot_keys(df: DataFrame, keys, hot_key_rows: int):
    """Collect keys with more than ``hot_key_rows`` rows (at most N / hot_key_rows of them)."""
    stats = (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
             .filter(F.col("__n") > F.lit(hot_key_rows)))
    return stats.collect()


def _with_buckets(df: DataFrame, keys, order, hot_rows, hot_key_rows: int) -> DataFrame:
    """Attach the bucket column: 0 for cold keys; for hot keys, the index of a
    range partition over (keys, order...), so buckets are contiguous slices of
    each hot key's order however its order values are distributed."""
    spark = df.sparkSession
    hot = spark.createDataFrame([tuple(r[k] for k in keys) + (True,) for r in hot_rows],
                                T.StructType([df.schema[k] for k in keys] + [T.StructField(_HOT, T.BooleanType())]))
    hot = hot.select(*[F.col(k).alias(f"__h_{k}") for k in keys], _HOT)
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__h_{k}")) for k in keys])
    marked = (df.join(_bounded_broadcast(hot, len(hot_rows)), cond, "left")
                .withColumn(_HOT, F.coalesce(F.col(_HOT), F.lit(False)))
                .drop(*[f"__h_{k}" for k in keys]))
    n_buckets = _bucket_count(hot_rows, hot_key_rows)
    hot_part = (marked.filter(F.col(_HOT)).repartitionByRange(n_buckets, *keys, *order)
                .withColumn(_BKT, F.spark_partition_id().cast("long") + 1))
    # Range boundaries are sampled: if the input's row order is not deterministic,
    # two evaluations could bucket differently, and the window and the stitching
    # tables are two consumers. A reliable checkpoint (shared checkpoint folder,
    # survives executor loss) fixes the assignment once for both.
    hot_part = cut_lineage(hot_part)
    cold_part = marked.filter(~F.col(_HOT)).withColumn(_BKT, F.lit(0).cast("long"))
    return hot_part.unionByName(cold_part)


def _order_cols(order_by) -> list[str]:
    return [order_by] if isinstance(order_by, str) else list(order_by)


def rolling_mean_rows(
    df: DataFrame,
    partition_by,
    order_by,
    values: dict,
    preceding: int = 2,
    min_periods: int | None = None,
    hot_key_rows: int | None = None,
    skew_guard: bool = True,
) -> DataFrame:
    """Mean over the current row and ``preceding`` rows before it (rows frame).

    ``values`` maps output column -> input column/expression. A mean is NULL
    until ``min_periods`` non-null inputs are in the frame (default: the full
    frame, ``preceding + 1``), which is a rolling mean with min_periods.
    ``order_by`` must be a total order within a partition.
    """
    keys = [partition_by] if isinstance(partition_by, str) else list(partition_by)
    order = _order_cols(order_by)
    min_periods = preceding + 1 if min_periods is None else min_periods
    vals = {out: (F.col(src) if isinstance(src, str) else src).cast("double") for out, src in values.items()}
    tmp = {out: f"__v_{i}" for i, out in enumerate(vals)}
    base = df.withColumns({tmp[o]: v for o, v in vals.items()})

    hot_rows = []
    if skew_guard and keys:
        hot_rows = find_hot_keys(base, keys, _hot_key_rows(df.sparkSession, hot_key_rows))

    def finish(frame: DataFrame, sums: dict, counts: dict) -> DataFrame:
        out = frame.withColumns({
            o: F.when(counts[o] >= F.lit(min_periods), F.try_divide(sums[o], counts[o].cast("double")))
            for o in vals})
        return out

    if not hot_rows:
        w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-preceding, 0)
        sums = {o: F.sum(F.col(tmp[o])).over(w) for o in vals}
        counts = {o: F.count(F.col(tmp[o])).over(w) for o in vals}
        return finish(base, sums, counts).drop(*tmp.values())

    hk = _hot_key_rows(df.sparkSession, hot_key_rows)
    b = _with_buckets(base, keys, order, hot_rows, hk)
    part = keys + [_BKT]
    w_local = Window.partitionBy(*part).orderBy(*order)
    w_frame = w_local.rowsBetween(-preceding, 0)
    local = b.withColumns({"__rn": F.row_number().over(w_local)}
                          | {f"__s_{o}": F.sum(F.col(tmp[o])).over(w_frame) for o in vals}
                          | {f"__c_{o}": F.count(F.col(tmp[o])).over(w_frame) for o in vals})

    # Last `preceding` rows of every bucket of a hot key.
    hot_only = b.filter(F.col(_HOT))
    desc = Window.partitionBy(*part).orderBy(*[F.col(c).desc() for c in order])
    tails = (hot_only.select(*part, *order, *tmp.values())
             .withColumn("__rd", F.row_number().over(desc))
             .filter(F.col("__rd") <= preceding))
    # Sums over the last k (1..preceding) tail rows, ending at each bucket's last row.
    wt = Window.partitionBy(*keys).orderBy(*order)
    agg_cols = {}
    for k in range(1, preceding + 1):
        wk = wt.rowsBetween(-(k - 1), 0)
        for o in vals:
            agg_cols[f"__ts{k}_{o}"] = F.sum(F.col(tmp[o])).over(wk)
            agg_cols[f"__tc{k}_{o}"] = F.count(F.col(tmp[o])).over(wk)
    last = tails.withColumns(agg_cols).filter(F.col("__rd") == 1)
    nxt = last.withColumn("__next", F.lead(_BKT).over(Window.partitionBy(*keys).orderBy(_BKT)))
    corr = (nxt.filter(F.col("__next").isNotNull())
               .select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__next").alias("__kb"),
                       *agg_cols.keys()))
    cond = reduce(lambda x, y: x & y,
                  [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys]) & (F.col(_BKT) == F.col("__kb"))
    # at most one row per hot bucket
    joined = local.join(_bounded_broadcast(corr, _bucket_count(hot_rows, hk)), cond, "left")

    def stitched(prefix_local, prefix_tail, o):
        # row r (1-based) in a bucket needs the last (preceding - r + 1) rows before the bucket
        add = None
        for r in range(1, preceding + 1):
            k = preceding - r + 1
            add = (F.when(F.col("__rn") == r, F.col(f"{prefix_tail}{k}_{o}")) if add is None
                   else add.when(F.col("__rn") == r, F.col(f"{prefix_tail}{k}_{o}")))
        # a frame whose values are all NULL sums to NULL: treat partial sums as 0
        return F.coalesce(F.col(f"{prefix_local}{o}"), F.lit(0)) + F.coalesce(add, F.lit(0))

    sums = {o: stitched("__s_", "__ts", o) for o in vals}
    counts = {o: stitched("__c_", "__tc", o) for o in vals}
    out = finish(joined, sums, counts)
    drop = ([_BKT, _HOT, "__rn", "__kb"] + [f"__k_{k}" for k in keys] + list(tmp.values())
            + [f"__s_{o}" for o in vals] + [f"__c_{o}" for o in vals] + list(agg_cols.keys()))
    return out.drop(*drop)


def rolling_mean_days(
    df: DataFrame,
    partition_by,
    date_col: str,
    values: dict,
    preceding_days: int = 2,
    bounded: bool = False,
) -> DataFrame:
    """Mean over rows whose date lies in [date - preceding_days, date] (range frame).

    Partial frames are allowed (no minimum). Rows sharing a date are peers and share a mean, so
    the window runs over daily partials: (sum, count) per key and date, aggregated before they
    are shuffled, then summed over the frame. A window partition holds a row per date, however
    many rows a date has; the means are joined back on key and date, where AQE broadcasts the
    daily table or splits the rows of a date that fills a partition.

    ``bounded`` says that a key holds few rows (one a date, or one file's): a plain window then.
    """
    keys = [partition_by] if isinstance(partition_by, str) else list(partition_by)
    vals = {out: (F.col(src) if isinstance(src, str) else src).cast("double") for out, src in values.items()}
    tmp = {out: f"__v_{i}" for i, out in enumerate(vals)}
    base = df.withColumns({tmp[o]: v for o, v in vals.items()})
    w = Window.partitionBy(*keys).orderBy(F.unix_date(F.col(date_col))).rangeBetween(-preceding_days, 0)
    if bounded:
        return base.withColumns({o: F.avg(F.col(tmp[o])).over(w) for o in vals}).drop(*tmp.values())
    partial = [f(F.col(tmp[o])).alias(f"__{n}{tmp[o]}") for o in vals for n, f in (("s", F.sum), ("c", F.count))]
    daily = base.groupBy(*keys, date_col).agg(*partial)
    mean = lambda o: F.try_divide(F.sum(f"__s{tmp[o]}").over(w), F.sum(f"__c{tmp[o]}").over(w).cast("double"))
    on = [*keys, date_col]
    means = daily.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate(on)], *[mean(o).alias(f"__m{tmp[o]}") for o in vals])
    cond = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(on)])
    # every row has its day: an inner join keeps all of them and may be split on this side
    joined = base.join(means, cond, "inner")
    return joined.withColumns({o: F.col(f"__m{tmp[o]}") for o in vals}).drop(*tmp.values(), *[f"__m{t}" for t in tmp.values()], *[f"__k{i}" for i in range(len(on))])


def row_ordinal(
    df: DataFrame,
    partition_by,
    order_by,
    out: str = "ordinal",
    hot_key_rows: int | None = None,
    skew_guard: bool = True,
) -> DataFrame:
    """1-based position of each row within its partition (ROW_NUMBER), skew-split.

    Hot keys are numbered per bucket and shifted by the row count of the
    key's earlier buckets (a prefix sum over a table with one row per hot bucket).
    """
    keys = [partition_by] if isinstance(partition_by, str) else list(partition_by)
    order = _order_cols(order_by)
    hot_rows = []
    if skew_guard and keys:
        hot_rows = find_hot_keys(df, keys, _hot_key_rows(df.sparkSession, hot_key_rows))
    if not hot_rows:
        return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))
    hk = _hot_key_rows(df.sparkSession, hot_key_rows)
    b = _with_buckets(df, keys, order, hot_rows, hk)
    part = keys + [_BKT]
    local = b.withColumn("__rn", F.row_number().over(Window.partitionBy(*part).orderBy(*order)))
    # One row per bucket of a hot key (bounded by N / hot_key_rows + #hot keys); cold keys
    # have a single bucket and offset 0, so they never need the join.
    counts = b.filter(F.col(_HOT)).groupBy(*part).agg(F.count(F.lit(1)).alias("__cnt"))
    offs = (counts.withColumn("__off", F.coalesce(F.sum("__cnt").over(
        Window.partitionBy(*keys).orderBy(_BKT).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .filter(F.col("__off") > 0)
        .select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col(_BKT).alias("__kb"), "__off"))
    cond = reduce(lambda x, y: x & y,
                  [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in keys]) & (F.col(_BKT) == F.col("__kb"))
    joined = local.join(_bounded_broadcast(offs, _bucket_count(hot_rows, hk)), cond, "left")
    return (joined.withColumn(out, (F.col("__rn") + F.coalesce(F.col("__off"), F.lit(0))).cast("long"))
                  .drop("__rn", "__off", "__kb", _BKT, _HOT, *[f"__k_{k}" for k in keys]))
