"""Vertical set operations: by-name, strict, widening and positional unions; append."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def union_by_name(dfs, allow_missing: bool = True) -> DataFrame:
    """By-name concatenation; missing columns become NULL, duplicates kept."""
    dfs = list(dfs)
    if not dfs:
        raise ValueError("union_by_name needs at least one DataFrame")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=allow_missing), dfs)


_WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FRACTION = (T.FloatType, T.DoubleType, T.DecimalType)
_TIME = (T.DateType, T.TimestampType, T.TimestampNTZType)
_ATOMS = (*_WHOLE, *_FRACTION, *_TIME, T.BooleanType, T.StringType)


def least_common_type(a: T.DataType, b: T.DataType) -> T.DataType:
    """The smallest type of the lattice that holds both: whole numbers below long below double,
    dates below timestamps, everything below string; nothing (``void``) is below all."""
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if not (isinstance(a, _ATOMS) and isinstance(b, _ATOMS)):
        raise ValueError(f"no common type of {a.simpleString()} and {b.simpleString()}")
    both = lambda kinds: isinstance(a, kinds) and isinstance(b, kinds)
    if both(_WHOLE):
        return T.LongType()
    if both(_WHOLE + _FRACTION):
        return T.DoubleType()
    if both(_TIME):
        return T.TimestampNTZType() if both((T.DateType, T.TimestampNTZType)) else T.TimestampType()
    return T.StringType()


def merge_schemas(schemas) -> T.StructType:
    """The columns of all schemas by name (case-blind, the first spelling and position count),
    each with the least common type of its inputs."""
    merged: dict = {}
    for s in schemas:
        names = [f.name.lower() for f in s.fields]
        if len(set(names)) < len(names):
            raise ValueError(f"column names that differ only by case: {sorted(n for n in names if names.count(n) > 1)}")
        for f in s.fields:
            have = merged.get(f.name.lower())
            merged[f.name.lower()] = T.StructField(have.name if have else f.name, least_common_type(have.dataType, f.dataType) if have else f.dataType)
    return T.StructType(list(merged.values()))


def union_widened(dfs) -> tuple[DataFrame, list[tuple]]:
    """By-name concatenation of frames whose columns and types differ (U1): (rows, report).

    Each column gets the least common type of its inputs, missing columns are NULL, duplicate
    rows stay. The report has a row (input, column, type, merged type) for every column that an
    input had to widen, with the type ``missing`` where it had none.
    """
    dfs = list(dfs)
    if not dfs:
        raise ValueError("union_widened needs at least one DataFrame")
    whole = merge_schemas([d.schema for d in dfs])
    report, aligned = [], []
    for i, d in enumerate(dfs):
        own = {f.name.lower(): f for f in d.schema.fields}
        cols = []
        for f in whole.fields:
            have = own.get(f.name.lower())
            if have is None or have.dataType != f.dataType:
                report.append((i, f.name, have.dataType.simpleString() if have else "missing", f.dataType.simpleString()))
            source = F.col(f"`{have.name.replace('`', '``')}`") if have else F.lit(None)
            cols.append(source.cast(f.dataType).alias(f.name))
        aligned.append(d.select(*cols))
    return reduce(lambda a, b: a.union(b), aligned), report


def _schema_signature(df: DataFrame):
    return {f.name.lower(): f.dataType for f in df.schema.fields}


def union_strict(dfs) -> DataFrame:
    """Concatenation that requires identical column sets and types.

    Column order may differ; every frame is re-projected to the first one's
    order (P5) before the union.
    """
    dfs = list(dfs)
    if not dfs:
        raise ValueError("union_strict needs at least one DataFrame")
    first = dfs[0]
    want = _schema_signature(first)
    aligned = [first]
    for d in dfs[1:]:
        got = _schema_signature(d)
        if got != want:
            missing = sorted(set(want) ^ set(got))
            mismatched = sorted(k for k in set(want) & set(got) if want[k] != got[k])
            raise ValueError(f"schema mismatch: columns differing={missing}, types differing={mismatched}")
        aligned.append(d.select(*first.columns))
    return reduce(lambda a, b: a.union(b), aligned)


def union_positional(dfs) -> DataFrame:
    """Positional UNION ALL of any number of frames (U3); names come from the first."""
    dfs = list(dfs)
    if not dfs:
        raise ValueError("union_positional needs at least one DataFrame")
    widths = {len(d.columns) for d in dfs}
    if len(widths) != 1:
        raise ValueError(f"positional union needs equal widths, got {sorted(widths)}")
    return reduce(lambda a, b: a.union(b), dfs)


def append_aligned(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Existing rows followed by new rows reordered to the existing layout (U4/P5)."""
    return union_strict([existing, new])
