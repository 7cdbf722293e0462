"""Profiling and reporting aggregates (table profile, sizes, members, unpivot)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratum.functions.columns import bytes_to_mb
from stratum.session import cut_lineage


def table_profile(tables: dict) -> DataFrame:
    """One row per named table: num_rows, num_columns (A3).

    All scans (empty read schema: only row counts are needed) feed one
    aggregate keyed by table name -- one shuffle of partial counts for any
    number of tables. The table list is the left side, so an empty table
    still reports 0 rows.
    """
    spark = next(iter(tables.values())).sparkSession
    tagged = reduce(lambda a, b: a.unionByName(b),
                    [df.select(F.lit(name).alias("table_name")) for name, df in tables.items()])
    counts = tagged.groupBy("table_name").agg(F.count(F.lit(1)).cast("long").alias("num_rows"))
    names = spark.createDataFrame([(n, len(df.columns)) for n, df in tables.items()],
                                  "table_name string, num_columns long")
    return (names.join(counts, "table_name", "left")
            .select("table_name", F.coalesce("num_rows", F.lit(0).cast("long")).alias("num_rows"), "num_columns"))


def environment_profile(datasets: DataFrame, files: DataFrame, environment: str) -> DataFrame:
    """Raw-tree profile: files, tables (file x sheet), total columns, total rows (A3).

    ``files``: one row per workbook; ``datasets``: one row per (dataset, file)
    with its column count and row count.
    """
    f = files.agg(F.count(F.lit(1)).cast("long").alias("num_files"))
    d = datasets.agg(F.count(F.lit(1)).cast("long").alias("num_tables"),
                     F.sum("n_columns").cast("long").alias("total_columns"),
                     F.sum("n_rows").cast("long").alias("total_rows"))
    return f.crossJoin(d).select(F.lit(environment).alias("environment"), "num_files", "num_tables",
                                 "total_columns", "total_rows")


def size_profile(files: DataFrame, environment: str, lines: DataFrame | None = None) -> DataFrame:
    """Clean-layer size profile: MB (2 digits), file count, text lines (A4).

    ``files`` is a ``binaryFile`` listing (``length`` column, content pruned);
    ``lines`` an optional ``spark.read.text`` of the same files.
    """
    agg = files.agg(bytes_to_mb(F.sum("length")).alias("initial_clean_dataframe_size_MB"),
                    F.count(F.lit(1)).cast("long").alias("num_files"))
    if lines is not None:
        agg = agg.crossJoin(lines.agg(F.count(F.lit(1)).cast("long").alias("num_lines")))
    return agg.select(F.lit(environment).alias("environment"), *agg.columns)


def group_pages(df: DataFrame, key: str, member: str, page_size: int = 1000, distinct: bool = False, first_seen: str | None = None) -> DataFrame:
    """(key, page, n_members, members): the members of each key as arrays of up to ``page_size``,
    so that no row or task holds a group as a whole (A6/F7).

    Members stand in their own order or, with ``first_seen`` (an order column), each distinct
    one where it is seen first. Pages are cut by rank, and the rank is a prefix sum: rows are
    range-partitioned by (key, order) and fixed by a checkpoint; the rows of a key in the
    partitions before give a partition's first rank. A large group is ranked by as many tasks as
    it fills partitions. Nulls are members and stand first; an empty table has no pages.
    """
    rows = df.select(F.col(key).alias("__key"), F.col(member).alias("__member"), *([F.col(first_seen).alias("__at")] if first_seen else []))
    if first_seen:
        rows = rows.groupBy("__key", "__member").agg(F.min("__at").alias("__at"))
    elif distinct:
        rows = rows.distinct()
    order = ["__at", "__member"] if first_seen else ["__member"]
    # contiguous parts: a sampled range partition over (key, order), fixed by a written table
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    full = ["__key", *order, "__row"]
    dealt = rows.withColumn("__row", F.monotonically_increasing_id()).repartitionByRange(parts, *full).sortWithinPartitions(*full)
    dealt = cut_lineage(dealt.withColumns({"__pid": F.spark_partition_id(), "__seq": F.monotonically_increasing_id()}).drop("__row"))
    whole = Window.partitionBy("__key")
    counts = dealt.groupBy("__key", "__pid").agg(F.min("__seq").alias("__first"), F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(whole.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select(F.col("__key").alias("__k"), F.col("__pid").alias("__p"), (before - F.col("__first")).alias("__shift"))
    placed = dealt.join(starts, F.col("__key").eqNullSafe(F.col("__k")) & (F.col("__pid") == F.col("__p")))
    rank = F.col("__seq") + F.col("__shift")
    paged = placed.withColumns({"__page": F.floor(rank / page_size).cast("long"), "__rank": rank})
    members = F.array_sort(F.collect_list(F.struct("__rank", "__member")))
    out = paged.groupBy("__key", "__page").agg(members.alias("__m"))
    return out.select(F.col("__key").alias(key), F.col("__page").alias("page"), F.size("__m").cast("long").alias("n_members"), F.col("__m.__member").alias("members"))


def group_members(df: DataFrame, key: str, member: str, sep: str = ",", out: str = "members",
                  extra_aggs=()) -> DataFrame:
    """Sorted member list per key as one string.

    Collects every member of a group into one row: for groups whose size is bounded by
    construction (a fixed dimension, file descriptors of one month). ``group_pages`` is for
    groups that grow with the data.
    """
    return df.groupBy(key).agg(
        F.array_join(F.sort_array(F.collect_list(F.col(member))), sep).alias(out),
        F.count(F.lit(1)).cast("long").alias(f"n_{out}"), *extra_aggs)


def unpivot_metrics(df: DataFrame, ids, values, var: str = "attribute", val: str = "value",
                    exclude=()) -> DataFrame:
    """Wide -> long (melt) with optional attribute exclusion."""
    ids = [ids] if isinstance(ids, str) else list(ids)
    long_df = df.unpivot(ids, list(values), var, val)
    if exclude:
        long_df = long_df.filter(~F.col(var).isin(list(exclude)))
    return long_df


def group_mean(df: DataFrame, keys, value: str, out: str | None = None, count: str | None = None) -> DataFrame:
    """``groupby(keys)[value].mean()`` -- partial + final hash aggregate (A2); ``count`` names a
    column for the number of rows."""
    keys = [keys] if isinstance(keys, str) else list(keys)
    rows = [F.count(F.lit(1)).cast("long").alias(count)] if count else []
    return df.groupBy(*keys).agg(F.avg(F.col(value)).alias(out or value), *rows)


def stage_report(run_metrics: DataFrame, id_cols=("environment", "engine"),
                 total_col: str = "total_etl_time"):
    """Result analysis over run-metric tables.

    Returns (mean total per id group, long table of per-step timings).
    """
    ids = list(id_cols)
    steps = [c for c in run_metrics.columns if c not in ids and c != total_col]
    means = run_metrics.groupBy(*ids).agg(F.avg(total_col).alias(total_col))
    steps_long = unpivot_metrics(run_metrics.select(*ids, total_col, *[F.col(s).cast("double") for s in steps]),
                                 ids + [total_col], steps, "etl_step", "seconds")
    return means, steps_long
