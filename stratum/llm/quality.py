"""Quality classifier: regularised quadratic discriminant over document statistics.

Each text gives ``FEATURES`` transformed statistics. Per class the sums of the statistics and of
their products are pre-aggregated in the tasks; mean and covariance follow, the covariance
shrunk towards the pooled one and towards a scaled identity. Its Cholesky factor is computed once
and kept in the model. A text's score is the logistic function of the difference of the two
classes' log densities (Mahalanobis distances through the factors) plus the log prior odds.

Defined cases: null text is empty text, which has a score as any other; rows with equal ids
are scored alike and each counts in learning; labels that aren't 0 or 1 and labels of no
document are ignored, repeated labels count once; if a class has fewer than two rows the score
is the smoothed share of label 1 (0.5 without labels); extra columns are ignored. Memory is
bounded by the longest text.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flat, map_arrow, text_batches

SHRINK_POOLED, SHRINK_IDENTITY = 0.3, 0.02
KEEP_SCORE = 0.7


def _class(chars: str) -> np.ndarray:
    own = np.zeros(256)
    own[[ord(c) for c in chars]] = 1
    return own


_DIGIT, _UPPER, _LOWER = "0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_POINTS, _SYMBOLS = ".,;:'\"-()?", "!#$%&*+/<=>@[\\]^_`{|}~"
_CLASSES = np.stack([_class(_UPPER), _class(_DIGIT), _class(_POINTS), _class(_SYMBOLS), _class(" "), _class("\n"), _class(".")], axis=1)
FEATURES = ("log bytes", "log mean word", "log types over log tokens", "upper", "digits", "points", "symbols", "spaces", "lines", "stops", "distinct lines", "byte entropy", "most frequent word")


def features(batch: pa.RecordBatch, text_at: int) -> np.ndarray:
    """The statistics of each row's text."""
    raw, off = flat(batch.column(text_at))
    texts = [memoryview(raw)[a:b].tobytes() for a, b in zip(off[:-1], off[1:], strict=True)]
    hist = np.stack([np.bincount(raw[a:b], minlength=256) for a, b in zip(off[:-1], off[1:], strict=True)]) if len(texts) else np.zeros((0, 256))
    n = hist.sum(axis=1)
    share = np.log((hist @ _CLASSES + 0.5) / (n + 1.0)[:, None])
    p = hist / np.maximum(n, 1)[:, None]
    entropy = -(p * np.log(np.where(p > 0, p, 1.0))).sum(axis=1)
    own = np.zeros((len(texts), 4))
    for i, t in enumerate(texts):
        words = t.split()
        k = len(words)
        if k:
            seen: dict[bytes, int] = {}
            for w in words:
                seen[w] = seen.get(w, 0) + 1
            lines = t.split(b"\n")
            own[i] = math.log((len(t) + 1) / k), math.log(1 + len(seen)) / math.log(1 + k), len(set(lines)) / len(lines), math.log(max(seen.values()) / k)
    return np.column_stack([np.log1p(n), own[:, 0], own[:, 1], share, own[:, 2], entropy, own[:, 3]])


class Model:
    """Class means, Cholesky factors of the shrunk covariances, and the prior."""

    def __init__(self, sums: dict[int, np.ndarray]):
        d = len(FEATURES)
        stats = {}
        for k, s in sums.items():
            n, mean = s[0], s[1 : d + 1] / s[0]
            second = np.zeros((d, d))
            second[np.triu_indices(d)] = s[d + 1 :] / n
            second = second + np.triu(second, 1).T
            stats[k] = n, mean, second - np.outer(mean, mean)
        n0, n1 = (stats[k][0] if k in stats else 0.0 for k in (0, 1))
        self.share = (n1 + 1) / (n0 + n1 + 2)
        self.classes = {}
        if min(n0, n1) < 2:
            return
        pooled = sum(n * c for n, _, c in stats.values()) / (n0 + n1)
        scale = np.sqrt(np.maximum(np.diag(pooled), 1e-9))
        for k, (_, mean, cov) in stats.items():
            own = ((1 - SHRINK_POOLED) * cov + SHRINK_POOLED * pooled) / np.outer(scale, scale)
            own = (1 - SHRINK_IDENTITY) * own + SHRINK_IDENTITY * np.eye(d) * max(np.trace(own) / d, 1e-3)
            factor = np.linalg.cholesky(own)
            self.classes[k] = mean, np.linalg.inv(factor) / scale, np.log(np.diag(factor)).sum()

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.classes:
            return np.full(len(x), self.share)
        density = {k: -0.5 * (((x - mean) @ inverse.T) ** 2).sum(axis=1) - logdet for k, (mean, inverse, logdet) in self.classes.items()}
        odds = density[1] - density[0] + math.log(self.share / (1 - self.share))
        return 1 / (1 + np.exp(-np.clip(odds, -700, 700)))


def with_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    kind = docs.schema[id_col].dataType.simpleString()

    def run(it):
        for b in text_batches(it, 1 << 20):
            x = features(b, 1)
            flat_x = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0), flat_x], [id_col, "x"])

    return map_arrow(docs.select(id_col, text_col), run, f"`{id_col}` {kind}, x array<double>")


def _matrix(col: pa.Array) -> np.ndarray:
    return np.asarray(col.flatten(), dtype=np.float64).reshape(len(col), -1)


def learn(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality") -> Model:
    """Fit on the rows of ``stats`` (id, x) that have a label."""
    own = labels.select(id_col, F.col(label_col).cast("int").alias("y")).filter("y IN (0, 1)").distinct()

    def run(it):
        d = len(FEATURES)
        total = {}
        for b in it:
            x, y = _matrix(b.column(0)), np.asarray(b.column(1))
            for k in np.unique(y):
                own = x[y == k]
                s = np.concatenate(([len(own)], own.sum(axis=0), (own.T @ own)[np.triu_indices(d)]))
                total[int(k)] = total[int(k)] + s if int(k) in total else s
        for k, s in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([s.tolist()])], ["y", "s"])

    sums = map_arrow(stats.join(own, id_col).select("x", "y"), run, "y int, s array<double>")
    rows = sums.select("y", F.posexplode("s")).groupBy("y", "pos").agg(F.sum("col").alias("v")).collect()
    found: dict[int, np.ndarray] = {}
    size = 1 + len(FEATURES) + len(FEATURES) * (len(FEATURES) + 1) // 2
    for r in rows:
        found.setdefault(r["y"], np.zeros(size))[r["pos"]] = r["v"]
    return Model(found)


def score(stats: DataFrame, model: Model, id_col: str = "doc_id") -> DataFrame:
    """(id, score) of every row of ``stats``."""
    kind = stats.schema[id_col].dataType.simpleString()

    def run(it):
        for b in it:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(_matrix(b.column(1))))], [id_col, "score"])

    return map_arrow(stats.select(id_col, "x"), run, f"`{id_col}` {kind}, score double")


def keep_good(docs: DataFrame, model: Model, least: float = KEEP_SCORE, text_col: str = "text") -> DataFrame:
    """The documents whose score is at least ``least``, with all their columns."""
    at = docs.columns.index(text_col)

    def run(it):
        for b in text_batches(it, 1 << 20):
            yield b.filter(pa.array(model.score(features(b, at)) >= least))

    return map_arrow(docs, run, docs.schema)
