"""Nearest neighbours by a block matrix join.

Vectors are packed into blocks. Each block of queries meets each block of candidates in one
tile of a grid: a merge join on a lane number, see ``common.tiles``. In a tile the unit vectors are quantised to int8; the product of the int8
matrices gives every cosine within a bound that follows from the two rounding errors. Pairs
whose upper bound reaches the k-th best lower bound so far are recomputed in double precision
from the original vectors and merged into the query's k best; the lists of the tiles are merged
at the end. Exact: recall is 1.

Defined cases: null, empty or zero vectors, those that hold null or non-finite components, and
rows with a null id take no part; vectors meet those of equal length only; all rows with the
query's id are its own; a query row that repeats is searched for once and each copy gets the
whole list, rows of one id and different vectors are queries of their own; otherwise rows with equal ids are candidates of their own; equal
scores go to the smaller id; an empty table gives no rows; extra columns are ignored. Memory
is bounded by two blocks, their tile of products and ``HELD`` list entries.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, tiles

QUERY_BLOCK, BLOCK = 512, 4096
HELD = 1 << 19  # queries whose lists a task holds before it passes them on
SHARE = 50  # candidates to a query that the grid of tiles is laid out for


def _blocks(rows: DataFrame, id_col: str, vec_col: str, size: int) -> DataFrame:
    """(dim, n, ids, data, tags): up to ``size`` usable vectors of one length, as doubles; tags
    are the key and the number of copies of each, if ``rows`` have them."""
    tagged = ["_key", "_copies"] if "_key" in rows.columns else []

    def run(it):
        held: dict[int, list] = {}
        counts: dict[int, int] = {}

        def pack(dim):
            ids, vecs, tags = (np.concatenate(x) for x in zip(*held.pop(dim), strict=True))
            counts.pop(dim)
            for i in range(0, len(ids), size):
                own = ids[i : i + size]
                yield pa.RecordBatch.from_arrays([pa.array([dim], pa.int32()), pa.array([len(own)], pa.int32()), pa.array([own.tobytes()]), pa.array([vecs[i : i + size].tobytes()]), pa.array([tags[i : i + size].tobytes()])], ["dim", "n", "ids", "data", "tags"])

        for b in it:
            b = b.filter(pc.and_(b.column(0).is_valid(), b.column(1).is_valid()))
            col = b.column(1)
            if not b.num_rows:
                continue
            lengths = np.asarray(pc.list_value_length(col))
            start = np.concatenate(([0], np.cumsum(lengths)))
            values = np.asarray(col.flatten().cast(pa.float64()).fill_null(float("nan")), dtype=np.float64)
            ids = np.asarray(b.column(0).cast(pa.int64()))
            tags = np.column_stack([np.asarray(b.column(2 + i)) for i in range(len(tagged))]) if tagged else np.zeros((len(ids), 0), np.int64)
            for dim in np.unique(lengths[lengths > 0]).tolist():
                at = np.flatnonzero(lengths == dim)
                vecs = values[start[at][:, None] + np.arange(dim)]
                with np.errstate(over="ignore", invalid="ignore"):
                    good = np.isfinite(vecs).all(axis=1) & (vecs != 0).any(axis=1)
                if good.any():
                    held.setdefault(dim, []).append((ids[at][good], vecs[good], tags[at][good]))
                    counts[dim] = counts.get(dim, 0) + int(good.sum())
                    if counts[dim] >= size:
                        yield from pack(dim)
        for dim in list(held):
            yield from pack(dim)

    return map_arrow(rows.select(id_col, vec_col, *tagged), run, "dim int, n int, ids binary, data binary, tags binary")


class _Side:
    """A block: ids, original vectors, norms, int8 rows with their scales and error norms."""

    def __init__(self, dim: int, n: int, ids: bytes, data: bytes, tags: bytes = b""):
        self.ids = np.frombuffer(ids, np.int64)
        self.tags = [tuple(t) for t in np.frombuffer(tags, np.int64).reshape(n, len(tags) // (8 * n)).tolist()]
        raw = np.frombuffer(data, np.float64).reshape(n, dim)
        # scaled by powers of two: exact, and no square over- or underflows
        self.raw = np.ldexp(raw, -np.frexp(np.abs(raw).max(axis=1))[1][:, None])
        self.norm = np.sqrt((self.raw * self.raw).sum(axis=1))
        unit = self.raw / self.norm[:, None]
        self.scale = np.abs(unit).max(axis=1) / 127
        self.q = np.rint(unit / self.scale[:, None]).astype(np.int8)
        self.err = np.sqrt(((unit - self.q * self.scale[:, None]) ** 2).sum(axis=1)) + 1e-12
        # float products of int8 values are exact sums below 2**24 (float32) or 2**53
        self.factor = self.q.astype(np.float32 if dim * 127 * 127 < 1 << 24 else np.float64)


def _tile(a: _Side, b: _Side, best: dict, k: int) -> None:
    """Merge the k best candidates of ``b`` into the lists of the queries of ``a``."""
    near = (a.factor @ b.factor.T).astype(np.float64) * a.scale[:, None] * b.scale
    bound = a.err[:, None] + (1 + a.err)[:, None] * b.err
    other = a.ids[:, None] != b.ids
    low = np.where(other, near - bound, -np.inf)
    keep = min(k, low.shape[1])
    least = np.partition(low, low.shape[1] - keep, axis=1)[:, low.shape[1] - keep] if keep == k else np.full(len(a.ids), -np.inf)
    for i, query in enumerate(zip(a.ids.tolist(), a.tags, strict=True)):
        ids, scores = best.get(query, (np.zeros(0, np.int64), np.zeros(0)))
        floor = max(least[i], scores[-1] - 1e-12 if len(scores) == k else -np.inf)
        j = np.flatnonzero(other[i] & (near[i] + bound[i] >= floor))
        if len(j):
            exact = (b.raw[j] * a.raw[i]).sum(axis=1) / (b.norm[j] * a.norm[i])
            ids, scores = np.concatenate([ids, b.ids[j]]), np.concatenate([scores, exact])
            order = np.lexsort((ids, -scores))[:k]
            best[query] = ids[order], scores[order]


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, score): each query's ``k`` nearest by cosine, nearest first."""
    cands = _blocks(vectors, id_col, vec_col, BLOCK).drop("tags")
    # copies of a query are searched for once
    asked = queries.groupBy(F.col(id_col).alias("_id"), F.col(vec_col).alias("_vec")).agg(F.count("*").alias("_copies")).withColumn("_key", F.xxhash64("_vec"))
    own = _blocks(asked, "_id", "_vec", QUERY_BLOCK).select(F.col("dim").alias("qdim"), F.col("n").alias("qn"), F.col("ids").alias("qids"), F.col("data").alias("qdata"), "tags")
    pairs = tiles(cands, own, ["ids"], ["qids", "tags"], [F.col("dim") == F.col("qdim")], SHARE).drop("qdim")

    def run(it):
        best, last = {}, (None, None)
        for batch in it:
            for i in range(batch.num_rows):  # row by row: each has two blocks
                dim, n, ids, data, qn, qids, qdata, tags = (c[i].as_py() for c in batch.columns)
                if last[0] != (ids, data):  # other vectors may have these ids
                    last = (ids, data), _Side(dim, n, ids, data)
                _tile(_Side(dim, qn, qids, qdata, tags), last[1], best, k)
                if len(best) >= HELD:
                    yield _rows(best)
                    best = {}
        if best:
            yield _rows(best)

    lists = map_arrow(pairs, run, "query_id long, key long, copies long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id"))
    best = lists.withColumn("rank", rank).filter(F.col("rank") <= k)
    each = best.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return each.select("query_id", "rank", F.col("vec_id").alias(id_col), "score")


def _rows(best: dict) -> pa.RecordBatch:
    ids, scores = zip(*best.values(), strict=True)
    size = [len(x) for x in ids]
    query, tags = zip(*best, strict=True)
    key, copies = zip(*tags, strict=True)
    cols = [pa.array(np.repeat(np.array(c, np.int64), size)) for c in (query, key, copies)]
    return pa.RecordBatch.from_arrays([*cols, pa.array(np.concatenate(ids)), pa.array(np.concatenate(scores))], ["query_id", "key", "copies", "vec_id", "score"])
