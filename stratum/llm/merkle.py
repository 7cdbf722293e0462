"""Merkle manifest of a table with octopus multiproofs.

Every row is a leaf, the SHA-256 of its columns. The leaves of a tree (here: of a source) stand
in the order of their ids; each run of ``RUN`` nodes has the digest of their hex digests as its
parent. The trees' roots are the leaves of one tree more, whose root names the whole table.

*Order.* Leaves are range-partitioned by (tree, id, leaf) and written; a leaf's place is its
place in its partition plus the leaves of its tree in the partitions before it, a prefix sum
over one row per partition and tree.

*Nodes.* Blocks of ``RUN ** LEVELS`` leaves make their inner nodes by themselves, their tops are
the leaves of the next tier; a tree of any size takes a few tiers.

*Proofs.* Leaf partitions of ``PART`` places each work out the octopus: level by level the runs
that hold known nodes, less the known nodes, are the missing ones, and the runs themselves are
known a level up. That least union is fetched by one join on node coordinates; the partition
derives the inner nodes that its leaves share and expands every leaf's own proof locally.

Defined cases: a null column is ``-``; null ids stand first in their tree, and rows that share
an id by their leaf digests; repeated rows are equal leaves, each at its own place; a null
source is a tree of its own, before all others; a tree of one leaf is that leaf, a table of one
source has the subroot as its root; a leaf without siblings has the digest of nothing as its
proof; extra columns are ignored; an empty table gives no rows. Memory is bounded by a block or
a leaf partition, whatever the size of a tree.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratum.session import ship_code

from .common import map_arrow, scratch

RUN, LEVELS = 3, 7
BLOCK = RUN**LEVELS
PART = 4096
TOP = "top"  # the tree of subroots; the others' keys begin with 0 or 1
NODE = "tree string, level int, idx long, n long, top boolean, hash string"
COORD = "tree string, part long, at string, level int, idx long"
PROOF = "id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def field(value: Column) -> Column:
    """A column's part of a leaf: ``-``, or the length in bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*values: Column) -> Column:
    return F.sha2(F.concat(*map(field, values)), 256)


def parent(digests) -> str:
    return sha256("".join(digests).encode()).hexdigest()


def _ranked(leaves: DataFrame, root: str) -> DataFrame:
    """``leaves`` (tree, id, leaf ...) with their place ``pos`` in their tree and its size ``n``."""
    spark = leaves.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["tree", F.col("id").asc_nulls_first(), "leaf", "salt"]  # equal leaves may stand in any order, and in several partitions
    dealt = leaves.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("salt")
    dealt.withColumn("pid", F.spark_partition_id()).withColumn("seq", F.monotonically_increasing_id()).write.parquet(f"{root}/dealt")
    dealt = spark.read.parquet(f"{root}/dealt")
    whole = Window.partitionBy("tree")
    before = whole.orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy("pid", "tree").agg(F.min("seq").alias("first"), F.count("*").alias("c"))
    starts = counts.select("pid", "tree", (F.coalesce(F.sum("c").over(before), F.lit(0)) - F.col("first")).alias("shift"), F.sum("c").over(whole).alias("n"))
    placed = dealt.join(starts, ["pid", "tree"]).withColumn("pos", F.col("seq") + F.col("shift"))
    placed.drop("pid", "seq", "shift").write.parquet(f"{root}/leaves")
    return spark.read.parquet(f"{root}/leaves")


def _block(tier: int):
    """The nodes of one block of a tier; its leaves were the last tier's tops."""

    def run(group: pa.Table) -> pa.Table:
        tree, n = group.column("tree")[0].as_py(), group.column("n")[0].as_py()
        pos = np.asarray(group.column("pos"))
        order = np.argsort(pos)
        row = group.column("leaf").take(pa.array(order)).to_pylist()
        idx, level, out = int(pos.min()), 0, []
        alone = n <= BLOCK
        while True:
            last = len(row) == 1 if alone else level == LEVELS
            if tier == 0 or level or (last and alone):
                out += [(tree, tier * LEVELS + level, idx + i, n, last, h) for i, h in enumerate(row)]
            if last:
                break
            row, idx, level = [parent(row[i : i + RUN]) for i in range(0, len(row), RUN)], idx // RUN, level + 1
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.string()), strict=True)], ["tree", "level", "idx", "n", "top", "hash"])

    return run


def _grow(leaves: DataFrame, root: str) -> tuple[DataFrame, DataFrame]:
    """(all nodes, the roots) of the trees of ``leaves`` (tree, pos, n, leaf)."""
    spark, tier, made, roots = leaves.sparkSession, 0, [], []
    while True:
        leaves.select("tree", "pos", "n", "leaf", F.expr(f"pos div {BLOCK}").alias("block")).groupBy("tree", "block").applyInArrow(_block(tier), NODE).write.parquet(f"{root}/tier-{tier}")
        nodes = spark.read.schema(NODE).parquet(f"{root}/tier-{tier}")
        made.append(nodes)
        tops = nodes.filter("top")
        roots.append(tops.filter(F.col("n") <= BLOCK).select("tree", F.col("hash").alias("leaf")))
        leaves = tops.filter(F.col("n") > BLOCK).select("tree", F.col("idx").alias("pos"), F.ceil(F.col("n") / BLOCK).alias("n"), F.col("hash").alias("leaf"))
        tier += 1
        if leaves.isEmpty():
            break
    return _all(made), _all(roots)


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def octopus(known: np.ndarray, n: int) -> list[np.ndarray]:
    """For every level of a tree of ``n`` leaves the nodes that proofs of the leaves ``known``
    need and cannot derive."""
    known, out = np.unique(known), []
    while n > 1:
        runs = np.unique(known // RUN)
        members = (runs[:, None] * RUN + np.arange(RUN)).ravel()
        out.append(np.setdiff1d(members[members < n], known, assume_unique=True))
        known, n = runs, -(-n // RUN)
    return out


def _derive(known: dict, fetched: dict, n: int) -> list[dict]:
    """Every node of every level that the proofs of ``known`` touch."""
    out = []
    while n > 1:
        runs = sorted({i // RUN for i in known})
        row = {**fetched.get(len(out), {}), **known}
        out.append(row)
        known = {r: parent(row[i] for i in range(r * RUN, min(r * RUN + RUN, n))) for r in runs}
        n = -(-n // RUN)
    return out


def _siblings(levels: list[dict], i: int, n: int) -> list[tuple[list, list]]:
    """Per level the digests before and after the node on leaf ``i``'s path, in its run."""
    out = []
    for row in levels:
        first = i // RUN * RUN
        out.append(([row[j] for j in range(first, i)], [row[j] for j in range(i + 1, min(first + RUN, n))]))
        i, n = i // RUN, -(-n // RUN)
    return out


def fold(digest: str, path: list[tuple[list, list]]) -> str:
    """The root that ``digest`` gives along its siblings."""
    for before, after in path:
        digest = parent([*before, digest, *after])
    return digest


def _coords(it):
    """Missing node coordinates of each leaf partition, in its tree and in the tree of subroots."""
    for b in it:
        for tree, part, places, n, top, n_top in zip(*(b.column(c).to_pylist() for c in ("tree", "part", "places", "n", "top", "n_top")), strict=True):
            for at, levels in ((tree, octopus(np.array(places), n)), (TOP, octopus(np.array([top]), n_top))):
                for level, idx in enumerate(levels):
                    if len(idx):
                        k = len(idx)
                        yield pa.RecordBatch.from_arrays([pa.array([tree] * k), pa.array([part] * k, pa.int64()), pa.array([at] * k), pa.array([level] * k, pa.int32()), pa.array(idx, pa.int64())], ["tree", "part", "at", "level", "idx"])


def _expand(root: str):
    def run(own: pa.Table, fetched: pa.Table) -> pa.Table:
        """Proofs of one leaf partition; the fetched row without a level tells its tree."""
        nodes: dict = {}
        info = None
        for at, level, idx, h, n_top, top in zip(*(fetched.column(c).to_pylist() for c in ("at", "level", "idx", "hash", "n_top", "top")), strict=True):
            if level is None:
                info = (h, n_top, top)
            else:
                nodes.setdefault(at == TOP, {}).setdefault(level, {})[idx] = h
        pos, leaves = own.column("pos").to_pylist(), own.column("leaf").to_pylist()
        if not pos:
            return pa.schema([("id", pa.int64())] + [(c, pa.string()) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")] + [("verified", pa.bool_())]).empty_table()
        n, (subroot, n_top, top) = own.column("n")[0].as_py(), info
        levels = _derive(dict(zip(pos, leaves, strict=True)), nodes.get(False, {}), n)
        above = _siblings(_derive({top: subroot}, nodes.get(True, {}), n_top), top, n_top)
        proofs, folded = [], []
        for i, shown in zip(pos, own.column("shown").to_pylist(), strict=True):
            path = _siblings(levels, i, n) + above
            proofs.append(parent(h for before, after in path for h in before + after))
            folded.append(fold(shown, path))
        k = len(pos)
        return pa.table([own.column("id"), own.column("leaf"), pa.array([subroot] * k), pa.array([root] * k), pa.array(proofs), pa.array(folded), pa.array([f == root for f in folded])], ["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    return run


def prove(rows: DataFrame, fields: list[str], shown: dict[str, Column] | None = None, tree_col: str = "source", id_col: str = "doc_id") -> DataFrame:
    """Commit every row of ``rows`` to one root and prove it: (id, leaf, subroot, root,
    proof_sha256, folded_root, verified). ``shown`` replaces columns by what the reader of the
    table is shown; the row is verified if that still folds to the root."""
    spark = rows.sparkSession
    ship_code(spark)
    base = scratch(spark, "merkle")
    key = F.coalesce(F.concat(F.lit("1"), F.col(tree_col).cast("string")), F.lit("0"))
    now = [(shown or {}).get(c, F.col(c)) for c in fields]
    own = rows.select(key.alias("tree"), F.col(id_col).cast("long").alias("id"), leaf(*map(F.col, fields)).alias("leaf"), leaf(*now).alias("shown"))
    leaves = _ranked(own, base)
    nodes, subroots = _grow(leaves, f"{base}/nodes")
    tops = _ranked(subroots.select(F.lit(TOP).alias("tree"), F.col("tree").alias("id"), "leaf"), f"{base}/top")
    upper, root = _grow(tops, f"{base}/top/nodes")
    found = root.first()
    trees = tops.select(F.col("id").alias("tree"), F.col("pos").alias("top"), F.col("n").alias("n_top"), F.col("leaf").alias("subroot"))

    placed = leaves.withColumn("part", F.expr(f"pos div {PART}"))
    parts = placed.groupBy("tree", "part").agg(F.collect_list("pos").alias("places"), F.first("n").alias("n")).join(trees, "tree")
    parts.write.parquet(f"{base}/parts")
    parts = spark.read.parquet(f"{base}/parts")
    asked = map_arrow(parts.select("tree", "part", "places", "n", "top", "n_top"), _coords, COORD)
    every = nodes.unionByName(upper).select(F.col("tree").alias("at"), "level", "idx", "hash")
    none = F.lit(None)
    fetched = asked.join(every, ["at", "level", "idx"]).select("tree", "part", "at", "level", "idx", "hash", none.cast("long").alias("n_top"), none.cast("long").alias("top"))
    told = parts.select("tree", "part", none.cast("string").alias("at"), none.cast("int").alias("level"), none.cast("long").alias("idx"), F.col("subroot").alias("hash"), "n_top", "top")
    both = placed.select("tree", "part", "pos", "n", "id", "leaf", "shown").groupBy("tree", "part").cogroup(fetched.unionByName(told).groupBy("tree", "part"))
    return both.applyInArrow(_expand(found["leaf"] if found else ""), PROOF).withColumnRenamed("id", id_col)
