"""Hard negatives by cover trees over norm-augmented candidates.

Inner products become distances on a sphere: every candidate of a block gets one component
more, so that all have the norm of the block's longest; the anchor gets a zero. A block's
candidates, all of one label, form a cover tree: a node is a candidate, its children lie
within its covering radius, children of a node are further apart than the radius of their own
level, and radii shrink by ``BASE`` from level to level. With the distance from a node and its
covering radius, the anchor's inner products below the node are bounded from both sides.

An anchor descends best-first: the nodes with the largest upper bounds are opened next. Nodes
whose bounds lie outside every window still wanted, or below what the window's list holds
already, are skipped; leaves are verified by exact integer products. Positives are the best of
the anchor's own label, with one window that is open on both sides; their scores set the
windows of the negatives, which all blocks of other labels are searched for.

Blocks of candidates and of anchors meet in a grid of tiles, a merge join on a lane number, see
``common.tiles``. Trees are made once and written. No table that grows with the anchors is
broadcast: files of few distinct vectors are far smaller than their rows. Each task merges its
lists by anchor, and ranks among tasks are a window over pre-limited groups. Exact.

Defined cases: rows with a null id, label or vector, or with a null or non-finite component, or
one whose integer value needs more than 53 bits, take no part; zero vectors do; vectors meet
those of equal length only; all rows that share the anchor's id are its own, otherwise rows with
equal ids are candidates of their own; an anchor row that repeats counts once; equal scores go
to the smaller id; scores beyond a long are clamped to it; an empty table gives no rows; extra
columns are ignored. Memory is bounded by two blocks and ``HELD`` list entries.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, scratch, tiles

BLOCK, ANCHORS, LEAF = 1024, 256, 24
BASE = 1.3  # how covering radii shrink from level to level
SCALE = 256
HELD = 1 << 19
SHARE = 50  # candidates to an anchor that the grid of tiles is laid out for
_TREE = "label long, dim int, ids binary, data binary, node binary, first binary, last binary, radius binary"


def quantise(values: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore", invalid="ignore"):
        return np.floor(SCALE * values)


def _usable(b: pa.RecordBatch):
    """(dim, ids, labels, integer vectors as doubles) of the rows of ``b`` that take part."""
    b = b.filter(pc.and_(pc.and_(b.column(0).is_valid(), b.column(1).is_valid()), b.column(2).is_valid()))
    col = b.column(1)
    lengths = np.asarray(pc.list_value_length(col))
    start = np.concatenate(([0], np.cumsum(lengths)))
    values = np.asarray(col.flatten().cast(pa.float64()).fill_null(float("nan")), dtype=np.float64)
    ids, labels = np.asarray(b.column(0)), np.asarray(b.column(2))
    for dim in np.unique(lengths[lengths > 0]).tolist():
        at = np.flatnonzero(lengths == dim)
        vecs = quantise(values[start[at][:, None] + np.arange(dim)])
        good = (np.abs(vecs) < 2.0**53).all(axis=1) & np.isfinite(values[start[at][:, None] + np.arange(dim)]).all(axis=1)
        if good.any():
            yield dim, ids[at][good], labels[at][good], vecs[good]


def _augment(vecs: np.ndarray) -> tuple[np.ndarray, float]:
    """Vectors with one component more that gives all of them the norm of the longest."""
    square = (vecs * vecs).sum(axis=1)
    top = float(square.max())
    return np.column_stack([vecs, np.sqrt(np.maximum(top - square, 0))]), top


def cover_tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order, node, first, last, radius) of a cover tree over ``points``.

    ``order`` lists the points so that a node's own are one range. Node i has the centre
    ``node[i]`` (a place in the order) and the covering radius ``radius[i]``. Its children are
    the nodes ``first[i]`` to ``last[i]``; in a leaf, whose children would be below node 0,
    these are -1 - the range of its places."""
    order: list[int] = []
    node, first, last, radius = [0], [0], [0], [0.0]
    root = np.arange(len(points))
    gap = np.sqrt(((points - points[0]) ** 2).sum(axis=1))
    work = [(0, root, gap)]  # (node, points, the centre first, their distances from it)
    while work:
        at, own, dist = work.pop()
        radius[at] = float(dist.max())
        node[at] = int(own[0])
        if len(own) <= LEAF or radius[at] == 0:
            first[at], last[at] = -1 - len(order), -1 - (len(order) + len(own))
            order += own.tolist()
            continue
        reach = radius[at] / BASE
        begin = len(node)
        groups = []
        while len(own):  # the centre covers itself first, then the next point that is left
            near = dist <= reach
            near[0] = True
            groups.append((own[near], dist[near]))
            own = own[~near]
            if len(own):
                dist = np.sqrt(((points[own] - points[own[0]]) ** 2).sum(axis=1))
        first[at], last[at] = begin, begin + len(groups)
        for k, (members, far) in enumerate(groups):
            node.append(0)
            first.append(0)
            last.append(0)
            radius.append(0.0)
            work.append((begin + k, members, far))
    place = np.empty(len(points), np.int64)
    place[order] = np.arange(len(points))
    return np.array(order), place[np.array(node)], np.array(first), np.array(last), np.array(radius)


def _trees(rows: DataFrame) -> DataFrame:
    """Cover trees over blocks of one label and length."""

    def run(it):
        held: dict = {}
        count: dict = {}

        def pack(key):
            ids, vecs = (np.concatenate(x) for x in zip(*held.pop(key), strict=True))
            count.pop(key)
            for i in range(0, len(ids), BLOCK):
                own, vec = ids[i : i + BLOCK], vecs[i : i + BLOCK]
                order, *tree = cover_tree(_augment(vec)[0])
                cols = [own[order], vec[order], *tree]
                yield pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int32()), *(pa.array([np.ascontiguousarray(c).tobytes()], pa.binary()) for c in cols)], ["label", "dim", "ids", "data", "node", "first", "last", "radius"])

        for b in it:
            for dim, ids, labels, vecs in _usable(b):
                for label in np.unique(labels).tolist():
                    at = labels == label
                    key = (label, dim)
                    held.setdefault(key, []).append((ids[at], vecs[at]))
                    count[key] = count.get(key, 0) + int(at.sum())
                    if count[key] >= BLOCK:
                        yield from pack(key)
            while sum(count.values()) > 16 * BLOCK:  # many labels: the fullest goes first
                yield from pack(max(count, key=count.get))
        for key in list(held):
            yield from pack(key)

    return map_arrow(rows, run, _TREE)


class _Tree:
    def __init__(self, dim, ids, data, node, first, last, radius):
        self.ids = np.frombuffer(ids, np.int64)
        self.vecs = np.frombuffer(data, np.float64).reshape(len(self.ids), dim)
        self.node, self.first, self.last = (np.frombuffer(x, np.int64) for x in (node, first, last))
        self.radius = np.frombuffer(radius, np.float64)
        self.top = float((self.vecs * self.vecs).sum(axis=1).max())
        self.peak = float(np.abs(self.vecs).max(initial=0))
        leaves = np.flatnonzero(self.first < 0)
        leaves = leaves[np.argsort(-self.first[leaves])]  # by their ranges of places
        self.leaf = np.repeat(leaves, self.first[leaves] - self.last[leaves])
        self.cover = 2 * np.arcsin(np.clip(self.radius / (2 * math.sqrt(self.top)), 0, 1)) if self.top else self.radius

    def bounds(self, product: np.ndarray, square: float) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest product below each node, from the products with the centres.

        All points lie on one sphere: with the angles t to the centre and p of the covering
        radius, products are norm * norm * cos of between t - p and t + p."""
        size = math.sqrt(self.top * square)
        if size == 0:
            return np.zeros(len(product)), np.zeros(len(product))
        t = np.arccos(np.clip(product / size, -1, 1))
        slack = size * 1e-7
        return size * np.cos(np.minimum(t + self.cover, np.pi)) - slack, size * np.cos(np.maximum(t - self.cover, 0)) + slack


def search(tree: _Tree, own_id: int, query: np.ndarray, wins: list[tuple], best: list[list], k: int) -> int:
    """Merge the tree's ``k`` best of each window (least, most) into the lists ``best`` of
    (score, -id), largest first; returns how many candidates were verified.

    The nodes with the largest upper bounds are opened first, in steps that double."""
    exact = len(query) * tree.peak * float(np.abs(query).max(initial=0)) < 2.0**53
    whole = None if exact else [int(x) for x in query.tolist()]
    floor = np.array([max(low, lst[-1][0]) if len(lst) >= k else low for (low, _), lst in zip(wins, best, strict=True)], float)
    most = np.array([m for _, m in wins], float)
    if not exact:  # windows as doubles: a little wider
        floor, most = floor - np.abs(floor) * 1e-12, most + np.abs(most) * 1e-12
    low, high = tree.bounds(tree.vecs[tree.node] @ query, float(query @ query))

    def verify(places):
        """Integer products: doubles while every partial sum is below 2 ** 53."""
        if exact:
            score = tree.vecs[places] @ query
        else:
            score = np.array([sum(int(a) * b for a, b in zip(v, whole, strict=True)) for v in tree.vecs[places].tolist()], dtype=object)
        fit = (score >= floor.min()) & (score <= most.max()) & (tree.ids[places] != own_id)
        if not fit.any():
            return
        score, ids = score[fit], tree.ids[places[fit]]
        for w, (least, top) in enumerate(wins):
            at = np.flatnonzero((score >= floor[w]) & (score <= most[w]))
            if len(at) > k and exact:  # all but the k largest scores and their ties
                at = at[score[at] >= np.partition(score[at], -k)[-k]]
            if len(at):
                found = [(int(s), -int(i)) for s, i in zip(score[at], ids[at], strict=True)]
                best[w] = heapq.nlargest(k, best[w] + [x for x in found if least <= x[0] <= top])
                if len(best[w]) >= k:
                    floor[w] = max(floor[w], best[w][-1][0] if exact else best[w][-1][0] - abs(best[w][-1][0]) * 1e-12)

    open_, step, seen = np.array([0]), 4, 0
    while True:
        open_ = open_[((high[open_, None] >= floor) & (low[open_, None] <= most)).any(axis=1)]
        if not len(open_):
            return seen
        if len(open_) > step:
            open_ = open_[np.argsort(-high[open_])]
        now, open_, step = open_[:step], open_[step:], step * 2
        leaf = tree.first[now] < 0
        if leaf.any():
            chosen = np.zeros(len(low), bool)
            chosen[now[leaf]] = True
            places = np.flatnonzero(chosen[tree.leaf])
            seen += len(places)
            verify(places)
        if not leaf.all():
            open_ = np.concatenate([open_, *(np.arange(a, b) for a, b in zip(tree.first[now[~leaf]].tolist(), tree.last[now[~leaf]].tolist(), strict=True))])


def _long(x: int) -> int:
    return max(-(1 << 63), min((1 << 63) - 1, x))


def _anchors(rows: DataFrame) -> DataFrame:
    """(id, label, dim, data, key): each distinct anchor with its integer vector."""

    def run(it):
        for b in it:
            for dim, ids, labels, vecs in _usable(b):
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(labels, pa.int64()), pa.array([dim] * len(ids), pa.int32()), pa.array([v.tobytes() for v in vecs], pa.binary())], ["id", "label", "dim", "data"])

    return map_arrow(rows, run, "id long, label long, dim int, data binary").distinct().withColumn("key", F.xxhash64("data"))


def _meet(anchors: DataFrame, trees: DataFrame, same: bool, k: int) -> DataFrame:
    """(id, alabel, key, w, other, score): each task's ``k`` best of every anchor and window;
    ``anchors`` are (id, label, dim, data, key, low, most), windows as arrays."""
    def pack(it):
        held: dict = {}

        def block(key):
            own = held.pop(key)
            cols = [[x[c] for x in own] for c in ("id", "key", "data", "low", "most")]
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int64()), pa.array([key[1]], pa.int32()), *(pa.array([c], t) for c, t in zip(cols, (pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.binary()), pa.list_(pa.list_(pa.int64())), pa.list_(pa.list_(pa.int64()))), strict=True))], ["alabel", "adim", "ids", "keys", "vecs", "low", "most"])

        for b in it:
            for r in b.to_pylist():
                key = r["label"], r["dim"]
                held.setdefault(key, []).append(r)
                if len(held[key]) >= ANCHORS:
                    yield block(key)
        for key in list(held):
            yield block(key)

    blocks = map_arrow(anchors.select("id", "label", "dim", "data", "key", "low", "most"), pack, "alabel long, adim int, ids array<long>, keys array<long>, vecs array<binary>, low array<array<long>>, most array<array<long>>")
    on = [F.col("dim") == F.col("adim"), (F.col("label") == F.col("alabel")) if same else (F.col("label") != F.col("alabel"))]
    pairs = tiles(trees.withColumnRenamed("ids", "cids"), blocks, ["cids", "data"], ["ids", "keys"], on, SHARE).select("dim", "cids", "data", "node", "first", "last", "radius", "alabel", "ids", "keys", "vecs", "low", "most")

    def run(it):
        best: dict = {}
        entries = 0
        last = (None, None)
        for batch in it:
            for i in range(batch.num_rows):  # row by row: each has two blocks
                dim, ids, data, node, first, end, radius, label, aids, keys, vecs, lows, mosts = (c[i].as_py() for c in batch.columns)
                if last[0] != (ids, data):
                    last = (ids, data), _Tree(dim, ids, data, node, first, end, radius)
                for a, key, vec, low, most in zip(aids, keys, vecs, lows, mosts, strict=True):
                    wins = [(-math.inf if x is None else x, math.inf if y is None else y) for x, y in zip(low, most, strict=True)]
                    lists = best.setdefault((a, label, key), [[] for _ in wins])
                    entries -= sum(map(len, lists))
                    search(last[1], a, np.frombuffer(vec, np.float64), wins, lists, k)
                    entries += sum(map(len, lists))
                if entries >= HELD:
                    yield _rows(best)
                    best, entries = {}, 0
        if best:
            yield _rows(best)

    lists = map_arrow(pairs, run, "id long, label long, key long, w int, score long, other long")
    rank = F.row_number().over(Window.partitionBy("id", "label", "key", "w").orderBy(F.desc("score"), "other"))
    return lists.withColumn("rank", rank).filter(F.col("rank") <= k)


def _rows(best: dict) -> pa.RecordBatch:
    rows = [(*key, w, _long(s), -i) for key, lists in best.items() for w, lst in enumerate(lists) for s, i in lst]
    types = [("id", pa.int64()), ("label", pa.int64()), ("key", pa.int64()), ("w", pa.int32()), ("score", pa.int64()), ("other", pa.int64())]
    return pa.table([pa.array([r[c] for r in rows], t) for c, (_, t) in enumerate(types)], [n for n, _ in types]).combine_chunks().to_batches()[0] if rows else pa.RecordBatch.from_pylist([], pa.schema(types))


def hard_negatives(vectors: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each
    anchor and each of its best rows of the same label, the best rows of other labels whose
    score is from ``least`` to ``most`` hundredths of the positive's."""
    spark = vectors.sparkSession
    base = scratch(spark, "negatives")
    pick = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).alias("vec"), F.col(label_col).cast("long").alias("label"))
    _trees(pick(vectors)).write.parquet(f"{base}/trees")
    trees = spark.read.parquet(f"{base}/trees")
    _anchors(pick(anchors)).write.parquet(f"{base}/anchors")
    own = spark.read.parquet(f"{base}/anchors")
    whole = F.array(F.lit(None).cast("long"))
    near = _meet(own.withColumn("low", whole).withColumn("most", whole), trees, True, positives)
    near.select("id", "label", "key", "rank", F.col("other").alias("positive_id"), F.col("score").alias("positive_score")).write.parquet(f"{base}/positives")
    near = spark.read.parquet(f"{base}/positives")
    # integer limits: least <= 100 n / p and 100 n / p <= most
    p = F.col("positive_score").cast("decimal(25,0)")
    low, high = F.ceil(p * least / 100).cast("long"), F.floor(p * most / 100).cast("long")
    wins = near.filter(low <= high).groupBy("id", "label", "key").agg(F.array_sort(F.collect_list(F.struct("rank", low.alias("low"), high.alias("most")))).alias("wins"))
    asking = own.join(wins.hint("merge"), ["id", "label", "key"]).withColumn("low", F.col("wins.low")).withColumn("most", F.col("wins.most"))
    asking.write.parquet(f"{base}/windows")
    asking = spark.read.parquet(f"{base}/windows")
    found = _meet(asking.select(*own.columns, "low", "most"), trees, False, negatives)
    shown = asking.select("id", "label", "key", F.posexplode("wins.rank").alias("w", "place")).withColumnRenamed("place", "prank")
    pairs = near.withColumnRenamed("rank", "prank").join(shown.hint("merge"), ["id", "label", "key", "prank"])
    return found.join(pairs.hint("merge"), ["id", "label", "key", "w"]).select(F.col("id").alias("anchor_id"), "positive_id", "rank", F.col("other").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
