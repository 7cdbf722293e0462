"""Table-definition style column operations, lazily (no materialized copies).

* ``positional_rename`` -- rename all columns by position with an arity check (P1)
* ``select_renamed``    -- column subset plus renames in one projection (P2/P3)
* ``add_column``        -- typed NULL/constant column, optionally IF NOT EXISTS (M4/M5)
* ``typed_select``      -- per-column conversion to a declared schema (M2/C10/C11)
* ``update_from``       -- ``UPDATE t SET c = u.c FROM u WHERE t.k = u.k`` (M7/J1)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratum.functions.columns import blank_to_null, parse_date


def positional_rename(df: DataFrame, names) -> DataFrame:
    names = list(names)
    if len(names) != len(df.columns):
        raise ValueError(f"expected {len(df.columns)} names, got {len(names)}")
    return df.toDF(*names)


def select_renamed(df: DataFrame, mapping: dict) -> DataFrame:
    """Keep only ``mapping`` keys, renamed to its values, in mapping order."""
    return df.select(*[F.col(src).alias(dst) for src, dst in mapping.items()])


def add_column(df: DataFrame, name: str, dtype, value=None, if_not_exists: bool = True) -> DataFrame:
    """``ALTER TABLE ADD COLUMN [IF NOT EXISTS] name type`` (+ optional constant)."""
    if name.lower() in {c.lower() for c in df.columns}:
        if if_not_exists:
            return df
        raise ValueError(f"column {name!r} already exists")
    return df.withColumn(name, F.lit(value).cast(dtype))


def convert(col: Column, dtype: T.DataType, strict: bool, order: Column | None = None) -> Column:
    """String/any -> declared type. Dates accept M/d/yyyy (d/M/yyyy where ``order``, what the
    whole column admits, says so), ISO and day serials."""
    if isinstance(dtype, T.DateType):
        if not strict:
            return parse_date(col, order)
        text = blank_to_null(F.trim(col.cast("string")))
        failed = F.raise_error(F.concat(F.lit("not a date: "), text)).cast("date")
        return F.coalesce(parse_date(col, order), F.when(text.isNotNull(), failed))
    return col.cast(dtype) if strict else col.try_cast(dtype)


def typed_select(df: DataFrame, schema: T.StructType, strict: bool = False, by_position: bool = False) -> DataFrame:
    """Project ``df`` onto ``schema``: same names (or positions), declared types.

    ``strict=True`` raises on an unconvertible value (ANSI cast); the default
    turns it into NULL (non-strict cast).
    """
    if by_position:
        if len(df.columns) < len(schema.fields):
            raise ValueError(f"{len(df.columns)} input columns for {len(schema.fields)} declared")
        sources = [F.col(f"`{c}`") for c in df.columns[: len(schema.fields)]]
    else:
        sources = [F.col(f"`{f.name}`") for f in schema.fields]
    return df.select(*[convert(src, f.dataType, strict).alias(f.name) for src, f in zip(sources, schema.fields)])


def update_from(df: DataFrame, updates: DataFrame, keys, columns, broadcast_updates: bool = False) -> DataFrame:
    """Overwrite ``columns`` of ``df`` with the matching row of ``updates``.

    A matched row takes the new value, NULL included, and rows without a match keep theirs. Two
    updates of one row have no defined result: reading such a row raises, as MERGE does. Planned
    as a left outer equi-join; AQE picks broadcast vs sort-merge from the runtime size of ``updates``.
    """
    keys = [keys] if isinstance(keys, str) else list(keys)
    cols = [columns] if isinstance(columns, str) else list(columns)
    # one row per key, grouped as the join needs it anyway
    own = updates.groupBy(*keys).agg(F.first(F.struct(*cols)).alias("__new"), F.count("*").alias("__n"))
    u = own.select(*[F.col(k).alias(f"__u_{k}") for k in keys], *[F.col("__new").getField(c).alias(f"__n_{c}") for c in cols], "__n",
                   F.lit(True).alias("__matched"))
    if broadcast_updates:
        u = F.broadcast(u)
    cond = None
    for k in keys:
        c = df[k] == u[f"__u_{k}"]
        cond = c if cond is None else cond & c
    joined = df.join(u, cond, "left")
    twice = F.raise_error(F.concat(F.lit("several updates of one row: "), F.to_json(F.struct(*[F.col(f"__u_{k}").alias(k) for k in keys]))))
    new = lambda c: F.when(F.col("__n") > 1, twice.cast(df.schema[c].dataType)).otherwise(F.col(f"__n_{c}"))
    out = joined.withColumns({c: F.when(F.col("__matched"), new(c)).otherwise(df[c]) for c in cols})
    return out.drop("__matched", "__n", *[f"__u_{k}" for k in keys], *[f"__n_{c}" for c in cols])
