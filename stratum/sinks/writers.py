"""Clean-layer writers (K1-K6): partitioned tables in parquet or CSV dialects.

Dialects
--------
* ``"quoted"``    -- ``,`` separator, header, every field quoted (K1/K3).
* ``"semicolon"`` -- ``;`` separator, header, quotes only where needed (K2).

Text fields may hold newlines, quotes, separators and white space at their ends; the matching
reader (``sources.split_csv``) reads such files in several tasks.

Overwrites are per partition (dynamic partition overwrite), so re-running an
extraction replaces exactly its own partition and appending a new extraction
never rewrites older ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

_EXACT = {"ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}  # the writer trims otherwise
DIALECTS = {
    "quoted": {"sep": ",", "header": "true", "quoteAll": "true", "escape": '"'} | _EXACT,
    "semicolon": {"sep": ";", "header": "true", "quoteAll": "false", "escape": '"'} | _EXACT,
}


def csv_options(dialect: str) -> dict:
    try:
        return dict(DIALECTS[dialect])
    except KeyError as exc:
        raise ValueError(f"unknown CSV dialect {dialect!r}; known: {sorted(DIALECTS)}") from exc


def write_table(
    df: DataFrame,
    path: str,
    fmt: str = "parquet",
    dialect: str = "quoted",
    partition_by=(),
    mode: str = "overwrite",
    dynamic_overwrite: bool = True,
    max_records_per_file: int | None = None,
) -> None:
    """Write ``df`` to ``path``.

    ``mode="overwrite"`` with partition columns replaces only the partitions
    present in ``df`` (K4/K6); ``mode="append"`` adds files (K5).
    """
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
        if mode == "overwrite" and dynamic_overwrite:
            w = w.option("partitionOverwriteMode", "dynamic")
    if max_records_per_file:
        w = w.option("maxRecordsPerFile", int(max_records_per_file))
    if fmt == "parquet":
        w.parquet(path)
    elif fmt == "csv":
        w.options(**csv_options(dialect)).option("dateFormat", "yyyy-MM-dd").csv(path)
    else:
        raise ValueError(f"fmt must be 'parquet' or 'csv', got {fmt!r}")


def write_flat(tables: dict, folder: str, prefix: str = "all_extractions_", dialect: str = "quoted") -> None:
    """The flat layout: ``<folder>/<prefix><dataset>.csv`` for each dataset, a folder of part
    files written by its tasks (``sources.clean.read_flat_clean`` reads it back)."""
    for name, df in tables.items():
        write_table(df, f"{folder.rstrip('/')}/{prefix}{name}.csv", fmt="csv", dialect=dialect)


def append_row(spark, path: str, row: dict, schema: str, fmt: str = "parquet") -> None:
    """Append one record to a metrics table; the first write creates it (K5)."""
    df = spark.createDataFrame([tuple(row.get(c.strip().split(" ")[0]) for c in schema.split(","))], schema)
    write_table(df, path, fmt=fmt, mode="append")
