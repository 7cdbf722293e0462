"""The whole-history level: sets of files per dataset, and a manifest of the live ones.

``<clean>/all_extractions/<dataset>/set-<id>/`` holds the rows of one or many extractions and is
never changed. ``<clean>/all_extractions/_manifest/<version>.json`` lists the sets that are live,
for all datasets at once, and which extractions a set has lost to a replacement. A version is
written last, in one piece and under a name that must not exist yet: whoever reads sees an
append whole or not at all, and sets of a writer that was stopped are never listed.

A manifest holds a few sets per dataset and size tier, whatever the number of extractions.
"""

from __future__ import annotations

import json
import os
import re
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stratum.registry import PARTITION_COLS
from stratum.sources.split_csv import read_split_csv

LEVEL = "all_extractions"


def hadoop(spark: SparkSession, path: str):
    """(file system, path) of a path of any scheme that Spark can open."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = hadoop(spark, path)
    return fs.exists(p)


def _folder(clean_root: str) -> str:
    return os.path.join(clean_root, LEVEL, "_manifest")


def versions(spark: SparkSession, clean_root: str) -> list[int]:
    fs, p = hadoop(spark, _folder(clean_root))
    if not fs.exists(p):
        return []
    names = [re.fullmatch(r"(\d+)[.]json", f.getPath().getName()) for f in fs.listStatus(p)]
    return sorted(int(m[1]) for m in names if m)


def read_version(spark: SparkSession, clean_root: str, version: int) -> dict | None:
    """One version of the manifest; None if its writer was stopped, or is still at it."""
    fs, p = hadoop(spark, os.path.join(_folder(clean_root), f"{version:012d}.json"))
    stream = fs.open(p)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    except ValueError:
        return None
    finally:
        stream.close()


def manifest(spark: SparkSession, clean_root: str) -> dict | None:
    """The newest whole version: ``{"version", "sets": {dataset: [{"path", "tier", "dropped"}]}}``."""
    whole = (read_version(spark, clean_root, v) for v in reversed(versions(spark, clean_root)))
    return next((m for m in whole if m is not None), None)


def publish(spark: SparkSession, clean_root: str, change: Callable[[dict], dict], tries: int = 20) -> dict:
    """Write ``change(sets)`` as the next version; a writer that came first is taken into
    account by applying ``change`` to what it published."""
    for _ in range(tries):
        listed = versions(spark, clean_root)
        for _ in range(10):  # the newest version may still be being written
            if not listed or read_version(spark, clean_root, listed[-1]) is not None:
                break
            time.sleep(0.1)
        version = max([0, *listed]) + 1  # what is read from here on is at most that version's predecessor
        now = next((m for m in (read_version(spark, clean_root, v) for v in reversed(listed)) if m is not None), {"sets": {}})
        sets = change({k: [dict(x) for x in v] for k, v in now["sets"].items()})
        new = {"version": version, "sets": sets}
        fs, p = hadoop(spark, os.path.join(_folder(clean_root), f"{version:012d}.json"))
        try:
            out = fs.create(p, False)
        except Exception:  # noqa: BLE001 -- the name is taken: another writer was faster
            if fs.exists(p):
                continue
            raise
        out.write(bytearray(json.dumps(new, sort_keys=True).encode()))
        out.close()
        return new
    raise RuntimeError(f"{clean_root}: no manifest version could be written in {tries} tries")


def read_sets(spark: SparkSession, clean_root: str, sets: list[dict], schema: T.StructType, fmt: str, options: dict) -> DataFrame:
    """The rows of ``sets`` but those of extractions that were dropped from them."""
    keys = [T.StructField(c, T.IntegerType()) for c in PARTITION_COLS]
    whole = T.StructType([*schema.fields, *keys])

    def rows(paths):
        if fmt == "parquet":
            return spark.read.schema(whole).parquet(*paths)
        return read_split_csv(spark, paths, whole, options)

    plain = [os.path.join(clean_root, x["path"]) for x in sets if not x["dropped"]]
    parts = [rows(plain)] if plain else []
    for x in sets:
        if x["dropped"]:
            gone = [tuple(k) for k in x["dropped"]]
            own = rows([os.path.join(clean_root, x["path"])])
            key = F.struct(*[F.col(c) for c in PARTITION_COLS])
            parts.append(own.filter(~F.coalesce(key.isin([F.struct(*[F.lit(v).alias(c) for c, v in zip(PARTITION_COLS, k, strict=True)]) for k in gone]), F.lit(False))))
    if not parts:
        return spark.createDataFrame([], whole)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
