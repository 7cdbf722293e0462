"""Shared helpers of the training-data operators."""

from __future__ import annotations

import ctypes
import math
import os
import sys
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratum.session import checkpoint_dir, ship_code

#: Splits of op1/op6: rows whose crc32(doc_id as text) mod 4 is this are held out.
FOLDS, HELD_OUT_FOLD = 4, 2


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(id_col):
    """True for the held-out quarter of the ids; false for a null id."""
    return F.coalesce(F.crc32(id_col.cast("string")) % FOLDS == HELD_OUT_FOLD, F.lit(False))


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder name under the shared checkpoint folder, as a URI."""
    base = checkpoint_dir(spark)
    if "://" not in base and not base.startswith("file:"):
        base = "file://" + os.path.abspath(base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def forget_others(module: str) -> None:
    """Empty what the other operators remember in this worker (their ``forget``)."""
    for name, m in list(sys.modules.items()):
        if name.startswith(f"{__package__}.") and name != module and (forget := getattr(m, "forget", None)):
            forget()


def release() -> None:
    """Give freed memory back to the system: a worker waits for its next task with little."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not the GNU C library
        pass


def map_arrow(df: DataFrame, fn: Callable, schema: str) -> DataFrame:
    """mapInArrow with the package shipped to the executors."""
    ship_code(df.sparkSession)
    module = fn.__module__

    def run(it):
        forget_others(module)
        try:
            yield from fn(it)
        finally:
            release()

    return df.mapInArrow(run, schema)


def tiles(cands: DataFrame, own: DataFrame, cands_by: list[str], own_by: list[str], on: list, share: int) -> DataFrame:
    """Each block of ``cands`` beside each block of ``own`` that ``on`` allows, once, in a grid of
    lanes: ``cands`` are dealt to its rows and copied to its columns, ``own`` the other way round.
    ``share`` is how many times more there are of ``cands``; with it, what is copied grows with
    the square root of the lanes.

    The copies are many times what the planner takes them for, so a broadcast of them would fill
    the driver: always a merge join. Blocks are dealt to tasks before they are copied."""
    lanes = int(cands.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    columns = max(1, math.isqrt(lanes // share))
    rows = -(-lanes // columns)
    copies = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    spread = lambda by, n: F.pmod(F.xxhash64(*by), F.lit(n))
    lane = lambda row, col: (row * columns + col).cast("long")
    own = own.repartition(lanes, *own_by).withColumn("_copy", copies(rows)).withColumn("_own_lane", lane(F.col("_copy"), spread(own_by, columns))).drop("_copy")
    cands = cands.withColumn("_copy", copies(columns)).withColumn("_lane", lane(spread(cands_by, rows), F.col("_copy"))).drop("_copy")
    return cands.hint("merge").join(own, [F.col("_lane") == F.col("_own_lane"), *on]).drop("_lane", "_own_lane")


def text_batches(it: Iterator[pa.RecordBatch], limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that one holds about ``limit`` bytes (or a single row)."""
    for b in it:
        n = b.num_rows
        if n == 0:
            continue
        per = max(1, b.nbytes // n)
        step = max(1, limit // per)
        for i in range(0, n, step):
            yield b.slice(i, step)


def cast_binary(col: pa.Array) -> pa.Array:
    """UTF-8 bytes of a string column (64-bit offsets, no copy of the data)."""
    return col.cast(pa.large_string()).cast(pa.large_binary()) if not pa.types.is_large_string(col.type) else col.cast(pa.large_binary())


def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Concatenated bytes of a string column and its row offsets (null: empty)."""
    col = cast_binary(col).fill_null(b"")
    off = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, off - off[0]


def text_bytes(df: DataFrame, text_col: str) -> int:
    """Bytes of text of the whole table: one pre-aggregated row."""
    return df.agg(F.sum(F.octet_length(text_col)).alias("n")).first()["n"] or 0


def filesystem(uri: str):
    """(pyarrow file system, path in it) of a URI, on the driver or an executor."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)
