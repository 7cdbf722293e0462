"""Writers of the whole-history level: an append writes the new extraction and a manifest.

``add`` writes one new set per dataset, the new rows and nothing else, and publishes them; where
they replace an extraction, the older sets lose it in the manifest. ``merge_tiers`` puts ``FANOUT`` sets of a size tier together to one of the next, so
that a row is rewritten once per tier and a reader opens a few sets per tier. ``vacuum`` deletes
the sets that no kept version lists.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from stratum.registry import SPECS, clean_schema
from stratum.sinks.writers import csv_options, write_table
from stratum.sources import history
from stratum.sources.clean import LINEAGE_FIELDS

FANOUT = 8


def _schema(name: str):
    return T.StructType([*clean_schema(name).fields, *LINEAGE_FIELDS])


def _write(df: DataFrame, clean_root: str, name: str, fmt: str, dialect: str) -> str:
    path = os.path.join(history.LEVEL, name, f"set-{uuid.uuid4().hex}")
    write_table(df, os.path.join(clean_root, path), fmt=fmt, dialect=dialect)
    return path


def _options(dialect: str) -> dict:
    return csv_options(dialect) | {"dateFormat": "yyyy-MM-dd"}


def start(spark: SparkSession, tables: dict, clean_root: str, fmt: str, dialect: str, run) -> None:
    """Write ``tables`` {dataset: rows} as the level's only sets; ``run(fn, names)`` submits the writes."""
    paths = dict(run(lambda n: (n, _write(tables[n], clean_root, n, fmt, dialect)), list(tables)))
    # a rebuild is one large set: its tier is above those that appends fill
    history.publish(spark, clean_root, lambda _: {n: [{"path": p, "tier": FANOUT, "dropped": []}] for n, p in paths.items()})


def add(spark: SparkSession, tables: dict, clean_root: str, replaced: dict, fmt: str, dialect: str, run) -> None:
    """Publish ``tables`` {dataset: new rows}; older sets lose the extractions ``replaced``
    {dataset: [(year, month, period)]}."""
    paths = dict(run(lambda n: (n, _write(tables[n], clean_root, n, fmt, dialect)), list(tables)))

    def change(sets):
        for n, keys in replaced.items():
            for x in sets.get(n, []):
                x["dropped"] += [list(k) for k in keys if list(k) not in x["dropped"]]
        for n, p in paths.items():
            sets.setdefault(n, []).append({"path": p, "tier": 0, "dropped": []})
        return sets

    history.publish(spark, clean_root, change)


def merge_tiers(spark: SparkSession, clean_root: str, fmt: str = "parquet", dialect: str = "quoted", fanout: int = FANOUT) -> int:
    """Merge every tier that holds ``fanout`` sets or more; returns how many sets went."""
    gone = 0
    while True:
        now = history.manifest(spark, clean_root)
        full = []
        for n, sets in (now or {"sets": {}})["sets"].items():
            by: dict = {}
            for x in sets:
                by.setdefault(x["tier"], []).append(x)
            full += [(n, t, own[:fanout]) for t, own in sorted(by.items()) if len(own) >= fanout]
        if not full:
            return gone
        for n, tier, own in full:
            rows = history.read_sets(spark, clean_root, own, _schema(n), fmt, _options(dialect))
            path = _write(rows, clean_root, n, fmt, dialect)
            was = {x["path"]: x["dropped"] for x in own}

            def change(sets, n=n, tier=tier, was=was, path=path):
                there = [x for x in sets[n] if x["path"] in was]
                if len(there) < len(was):
                    raise RuntimeError("another merge was faster")
                # what was dropped since the rows were read is dropped from the merged set too
                late = [k for x in there for k in x["dropped"] if k not in was[x["path"]]]
                sets[n] = [x for x in sets[n] if x["path"] not in was] + [{"path": path, "tier": tier + 1, "dropped": late}]
                return sets

            history.publish(spark, clean_root, change)
            gone += len(own)


def vacuum(spark: SparkSession, clean_root: str, keep_versions: int = 1) -> int:
    """Delete old manifest versions and the sets that none of the kept ones lists; returns the
    number of sets deleted. Not while a writer or a reader of an older version is at work."""
    newest = history.manifest(spark, clean_root)
    if newest is None:
        return 0
    folder = os.path.join(clean_root, history.LEVEL)
    every = [v for v in history.versions(spark, clean_root) if v <= newest["version"]]
    live = set()
    for v in every:
        if v in every[-keep_versions:]:
            kept = history.read_version(spark, clean_root, v) or {"sets": {}}
            live |= {x["path"] for sets in kept["sets"].values() for x in sets}
        else:
            fs, p = history.hadoop(spark, os.path.join(folder, "_manifest", f"{v:012d}.json"))
            fs.delete(p, False)
    n = 0
    for name in SPECS:
        fs, p = history.hadoop(spark, os.path.join(folder, name))
        if not fs.exists(p):
            continue
        for f in fs.listStatus(p):
            own = f.getPath().getName()
            if os.path.join(history.LEVEL, name, own) not in live:
                fs.delete(f.getPath(), True)
                n += own.startswith("set-")
    return n
