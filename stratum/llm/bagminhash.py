"""Near-duplicate classes by BagMinHash signatures, banding and verified multiset overlap.

A text is the multiset of its five-word shingles (words: A-Z lowered, runs of digits, letters
and non-ASCII; a text of fewer words is one shingle). Weights are discretised at the integers:
a shingle owns one Poisson process for each dyadic range [0, 1), [1, 2), [2, 4) ... of weight
levels, with the range's width as its rate, and a text takes those points whose level lies
below its count. Each point falls on one of ``SIZE`` components; the signature is the earliest
point of each, so two components agree with the probability of the weighted Jaccard
similarity. Points are made in order of time and a process stops once it is later than all of
its text's components.

Signatures are cut into ``BANDS`` bands of ``ROWS``; texts that share a band's key are in one
bucket (a pair at the threshold is missed by all bands with probability 3e-6). In a bucket
nobody meets everybody: members are compared with its centre, the member with the most
company, and linked ones become one class. A bucket that still holds several classes is taken
up again without its centre: one of up to ``SMALL`` members is settled pair by pair, a larger
one is split, its key being lengthened by the next band's, a fixed other one of each band; so
its 32 copies split apart independently. Each part has a centre again. After ``LEVELS`` splits
keys are ``ROWS * (LEVELS + 1)`` components long. A member is thus compared at most
``BANDS * (LEVELS + SMALL)`` times in these rounds, which join nearly all that is alike at little
cost. Two members of a large bucket may still have met in no part of it, so the last round
settles what is left exactly: in every large bucket that holds several classes, whoever is
outside its largest class meets every member of another class. The bucket's members are dealt
to parts of ``GROUP`` texts, and each pair of parts with an outsider is one group: memory stays
bounded however large a bucket is, and the work is that of the outsiders times the members.
No pair that shares a band's key is left out. Each compared pair is verified on its
texts: overlap sum(min) / sum(max) of at least ``THRESHOLD``. Classes are the connected
components of the verified links.

A node is a distinct text (its digest): exact copies take part once, and every text of an id
that repeats takes part. Comparisons with a popular centre are dealt to salted groups of
``GROUP``; band counts, degrees and labels are pre-aggregated. Tables between rounds are
written to the shared folder. Ids that hold texts of several classes link these classes
afterwards.

Defined cases: null is empty text; equal texts are one class; a text without words is alike
only to its copies; rows that share an id share a class, and ``keep_one`` keeps one of each
group of alike texts even if a shared id joins the groups; a null id is represented by a hash
of its text; extra columns are ignored; an empty table gives no rows. Memory is bounded by a
batch of texts, ``GROUP`` texts and the longest text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from stratum.session import ship_code

from .common import flat, map_arrow, scratch, text_batches
from .suffixes import Prefixes, _mix

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 32, 5
SIZE = BANDS * ROWS
GROUP = 256
SIGN_BYTES, VERIFY_BYTES = 1 << 19, 1 << 20  # of text whose shingles are held at once
PART_SHINGLES = 1 << 18  # shingles of a part's texts, about
COLUMNS = 1 << 12  # elements whose overlaps are counted at once
SMALL = 8  # members up to which an unsettled bucket is settled pair by pair
#: How many bands further on the band stands that lengthens a key, level by level.
STRIDES = (1, 3, 7, 12, 20, 9, 26)
LEVELS = len(STRIDES)
BROADCAST_EDGES = 100_000  # rows of 32 bytes up to which comparisons are broadcast
_GOLD = np.uint64(0x9E3779B97F4A7C15)
#: FIXED VALUES: bytes of words, A-Z as a-z; 0 for all others.
_LOWER = np.array([c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0 for c in range(256)], np.uint8)


def shingles(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle hash, count) of each distinct shingle of each row, in order."""
    raw, off = flat(col)
    low = _LOWER[raw]
    word = low != 0
    edge = np.zeros(len(raw) + 1, bool)
    edge[off] = True
    start = np.flatnonzero(word & (edge[:-1] | ~np.concatenate(([False], word[:-1]))))
    end = np.flatnonzero(word & (edge[1:] | ~np.concatenate((word[1:], [False])))) + 1
    row = np.searchsorted(off, start, side="right") - 1
    own = Prefixes(low).of(start, end)
    n = len(own)
    if not n:
        return (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))
    count = np.bincount(row, minlength=len(off) - 1)
    first = np.concatenate(([0], np.cumsum(count)))[row]
    size = np.minimum(count[row], SHINGLE)
    at = np.flatnonzero(np.arange(n) - first + size <= count[row])  # shingles start here
    h = np.zeros(len(at), np.uint64)
    for k in range(SHINGLE):
        there = k < size[at]
        h = np.where(there, _mix(h + own[np.minimum(at + k, n - 1)] + _gold(k + 1)), h)
    r = row[at]
    order = np.lexsort((h, r))
    r, h = r[order], h[order]
    new = np.concatenate(([True], (r[1:] != r[:-1]) | (h[1:] != h[:-1])))
    i = np.flatnonzero(new)
    return r[i], h[i], np.diff(np.append(i, len(r)))


def _gold(k: int) -> np.uint64:
    """k golden steps, modulo 2**64."""
    return np.uint64(int(_GOLD) * k & 0xFFFFFFFFFFFFFFFF)


def _unit(x: np.ndarray) -> np.ndarray:
    """Hashes to (0, 1]."""
    return ((x >> np.uint64(11)).astype(np.float64) + 1.0) * 2.0**-53


def signatures(row: np.ndarray, shingle: np.ndarray, count: np.ndarray, n: int) -> np.ndarray:
    """BagMinHash components of ``n`` rows (times; infinite for a row without shingles)."""
    rows, seeds, low, width, counts = [row], [_mix(shingle)], [np.zeros(len(row))], [np.ones(len(row))], [count]
    level = 1
    while (more := np.flatnonzero(count > level)).size:
        rows.append(row[more])
        seeds.append(_mix(shingle[more] + _gold(level)))
        low.append(np.full(len(more), float(level)))
        width.append(np.full(len(more), float(level)))
        counts.append(count[more])
        level *= 2
    row, seed, low, width, count = (np.concatenate(x) for x in (rows, seeds, low, width, counts))
    least = np.full(n * SIZE, np.inf)
    limit = np.full(n, np.inf)
    time = np.zeros(len(row))
    k = 0
    while len(row):
        k += 1
        x = _mix(seed + _gold(k))
        time = time - np.log(_unit(x)) / width
        y = _mix(x ^ _GOLD)
        part = (y >> np.uint64(32)).astype(np.int64) * SIZE >> 32
        # the point's level within the range; a range that the count covers in part is thinned
        kept = (time <= limit[row]) & (low + _unit(_mix(y)) * width <= count)
        np.minimum.at(least, row[kept] * SIZE + part[kept], time[kept])
        touched = np.unique(row)
        limit[touched] = least.reshape(n, SIZE)[touched].max(axis=1)
        on = time <= limit[row]
        row, seed, low, width, count, time = row[on], seed[on], low[on], width[on], count[on], time[on]
    return least.reshape(n, SIZE)


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key per row and band."""
    bits = sig.view(np.uint64).reshape(len(sig), BANDS, ROWS)
    key = np.broadcast_to(_GOLD * np.arange(1, BANDS + 1, dtype=np.uint64), (len(sig), BANDS)).copy()
    for k in range(ROWS):
        key = _mix(key + bits[:, :, k])
    return key.view(np.int64)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """sum(min) / sum(max) of two (sorted hashes, counts)."""
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    both = int(np.minimum(a[1][i], b[1][j]).sum())
    total = int(a[1].sum() + b[1].sum()) - both
    return both / total if total else 0.0


def _sign(it):
    for b in text_batches(it, SIGN_BYTES):
        keys: list = [None] * b.num_rows
        row, h, c = shingles(b.column(2))
        size = np.bincount(row, weights=c, minlength=b.num_rows).astype(np.int64)
        used, local = np.unique(row, return_inverse=True)
        if len(used):
            for i, x in zip(used.tolist(), band_keys(signatures(local, h, c, len(used))), strict=True):
                keys[i] = x
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(keys, pa.list_(pa.int64())), pa.array(size)], ["key", "digest", "bands", "size"])


def _texts(group: pa.Table) -> pa.Array:
    texts = group.column("text").combine_chunks()
    return texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts


def _cut(texts: pa.Array):
    """(first row, row after the last, shingles) of a few texts at a time."""
    ends = np.cumsum(np.asarray(pc.binary_length(texts)))
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + VERIFY_BYTES, side="right")))
        yield i, j, *shingles(texts.slice(i, j - i))
        i = j


def overlaps(row: np.ndarray, shingle: np.ndarray, count: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """sum(min) of the multisets of every row in ``left`` with every row in ``right``."""
    # a multiset as a set: the k-th copy of a shingle is an element of its own
    nth = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    row = np.repeat(row, count)
    _, element = np.unique(_mix(np.repeat(shingle, count) + nth.astype(np.uint64) * _GOLD), return_inverse=True)
    n = max(int(left.max()), int(right.max()), int(row.max(initial=0))) + 1
    sides = []
    for own in (left, right):
        place = np.full(n, -1)
        place[own] = np.arange(len(own))
        at = place[row]
        sides.append((at[at >= 0], element[at >= 0]))
    (x, a), (y, b) = sides
    size = int(element.max(initial=-1)) + 1
    used = (np.bincount(a, minlength=size) > 0) & (np.bincount(b, minlength=size) > 0)
    number = np.cumsum(used) - 1
    x, a, y, b = x[used[a]], number[a[used[a]]], y[used[b]], number[b[used[b]]]
    i, j = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    x, a, y, b = x[i], a[i], y[j], b[j]
    both = np.zeros((len(left), len(right)))
    for first in range(0, int(used.sum()), COLUMNS):
        halves = []
        for own, z, e in ((left, x, a), (right, y, b)):
            lo, hi = np.searchsorted(e, [first, first + COLUMNS])
            m = np.zeros((len(own), COLUMNS), np.float32)
            m[z[lo:hi], e[lo:hi] - first] = 1
            halves.append(m)
        both += halves[0] @ halves[1].T
    return both


def _settle(group: pa.Table) -> pa.Table:
    """Links between the classes of two parts of a bucket (or within one), each pair of texts
    being compared; one link for two classes."""
    node, cls, part = (np.asarray(group.column(c)) for c in ("node", "cls", "part"))
    lo, hi = group.column("lo")[0].as_py(), group.column("hi")[0].as_py()
    left, right = np.flatnonzero(part == lo), np.flatnonzero(part == hi)
    a = b = np.zeros(0, np.int64)
    if len(left) and len(right):
        cut = [(row + i, h, c) for i, _, row, h, c in _cut(_texts(group))]
        row, h, c = (np.concatenate(x) for x in zip(*cut, strict=True))
        total = np.bincount(row, weights=c, minlength=len(node))
        both = overlaps(row, h, c, left, right)
        every = total[left][:, None] + total[right] - both
        i, j = np.nonzero((both >= THRESHOLD * every - 1e-6) & (cls[left][:, None] != cls[right]))
        same = both[i, j] / every[i, j] >= THRESHOLD
        a, b = left[i[same]], right[j[same]]
        _, once = np.unique(np.stack([np.minimum(cls[a], cls[b]), np.maximum(cls[a], cls[b])]), axis=1, return_index=True)
        a, b = a[once], b[once]
    return pa.table([pa.array(node[a], pa.int64()), pa.array(node[b], pa.int64())], ["a", "b"])


def _verify(group: pa.Table) -> pa.Table:
    """Links of one centre: its text is the row whose node is the centre. Texts are cut into
    shingles a few at a time."""
    texts = _texts(group)
    nodes = np.asarray(group.column("node"))
    centre = group.column("centre")[0].as_py()
    mid = np.flatnonzero(nodes == centre)
    linked = set()
    if len(mid):
        _, *own = shingles(texts.slice(int(mid[0]), 1))
        for i, j, row, h, c in _cut(texts):
            cut = np.searchsorted(row, np.arange(j - i + 1))
            for n, a, b in zip(nodes[i:j].tolist(), cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                if n != centre and similarity(own, (h[a:b], c[a:b])) >= THRESHOLD:
                    linked.add(n)
    linked = sorted(linked)
    return pa.table([pa.array([centre] * len(linked), pa.int64()), pa.array(linked, pa.int64())], ["a", "b"])


def _small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast a side that has been counted and is small; otherwise leave it to Spark."""
    return F.broadcast(df) if rows <= BROADCAST_EDGES else df


def _components(links: DataFrame, n: int, root: str) -> DataFrame:
    """(node, cls): the smallest node that each of ``n`` links' nodes reaches, by min-label
    propagation with pointer jumping; labels (at most 2 n rows) are written after each step."""
    spark = links.sparkSession
    both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("cls")).withColumn("moved", F.lit(True))
    step = 0
    while True:
        labels.write.parquet(f"{root}/labels-{step}")
        labels = spark.read.parquet(f"{root}/labels-{step}")
        if labels.filter("moved").isEmpty():
            return labels.select("node", "cls")
        near = both.join(_small(labels.select(F.col("node").alias("b"), "cls"), 2 * n), "b").groupBy(F.col("a").alias("node")).agg(F.min("cls").alias("near"))
        far = labels.select(F.col("node").alias("cls"), F.col("cls").alias("far"))
        labels = labels.drop("moved").join(_small(far, 2 * n), "cls", "left").join(near, "node").select("node", F.least("cls", "near", "far").alias("to"), "cls")
        labels, step = labels.select("node", F.col("to").alias("cls"), (F.col("to") < F.col("cls")).alias("moved")), step + 1


def _extend(label: DataFrame | None, n_labels: int, links: DataFrame, n: int, root: str) -> DataFrame:
    """(node, cls) of all links so far: ``n`` new ``links`` join the classes of ``label``. Only
    links between different classes are followed."""
    spark = links.sparkSession
    if label is None:
        return _components(links, n, root)
    own = label.select("node", F.col("cls").alias("own"))
    for end in ("a", "b"):
        links = links.join(_small(own.withColumnRenamed("node", end), n_labels), end, "left").withColumn(end, F.coalesce("own", end)).drop("own")
    links.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct().write.parquet(f"{root}/between")
    between = spark.read.parquet(f"{root}/between")
    if between.isEmpty():
        return label
    to = _components(between, n, root).withColumnRenamed("cls", "to")
    old = label.join(_small(to.withColumnRenamed("node", "cls"), 2 * n), "cls", "left").select("node", F.coalesce("to", "cls").alias("cls"))
    fresh = to.join(_small(label.select("node"), n_labels), "node", "left_anti").select("node", F.col("to").alias("cls"))
    old.unionByName(fresh).write.parquet(f"{root}/classes")
    return spark.read.parquet(f"{root}/classes")


def _rest(spark, root: str, texts: DataFrame, label: DataFrame | None, n_links: int) -> DataFrame | None:
    """The labels after the last round: all that is left of the large buckets is compared."""
    here = f"{root}/last"
    large = spark.read.parquet(f"{root}/round-0/open").filter(F.col("n") > SMALL).select("band")
    own = spark.read.parquet(f"{root}/round-0/left").select("band", "node", "size")
    # the first round compared the centres with all others
    own = own.join(spark.read.parquet(f"{root}/round-0/centres").select("band", F.col("c.node").alias("node")), ["band", "node"], "left_anti").join(large, "band")
    if label is not None:
        own = own.join(_small(label, 2 * n_links), "node", "left")
    own = own.withColumn("cls", F.coalesce("cls", "node") if label is not None else F.col("node"))
    own.write.parquet(f"{here}/own")
    own = spark.read.parquet(f"{here}/own")
    # per bucket: the largest class, and the number of parts of those outside and inside
    classes = own.groupBy("band", "cls").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    parts = lambda n, size: F.greatest(F.ceil(n / GROUP), F.ceil(size / PART_SHINGLES))
    most = F.max(F.struct("n", "size", "cls")).alias("most")
    buckets = classes.groupBy("band").agg(most, F.sum("n").alias("n"), F.sum("size").alias("size")).filter("n > most.n")
    buckets = buckets.select("band", F.col("most.cls").alias("most"), parts(F.col("n") - F.col("most.n"), F.col("size") - F.col("most.size")).alias("out"), parts(F.col("most.n"), F.col("most.size")).alias("in"))
    buckets.write.parquet(f"{here}/buckets")
    buckets = spark.read.parquet(f"{here}/buckets")
    n = buckets.count()
    if not n:
        return label
    salt, outside = F.xxhash64("node"), F.col("cls") != F.col("most")
    dealt = own.join(_small(buckets, n), "band").withColumn("part", F.when(outside, F.pmod(salt, "out")).otherwise(F.col("out") + F.pmod(salt, "in")))
    meets = F.when(outside, F.col("out") + F.col("in")).otherwise(F.col("out"))
    dealt = dealt.select("band", "node", "cls", "part", F.explode(F.sequence(F.lit(0).cast("long"), meets - 1)).alias("other"))
    dealt = dealt.select("band", "node", "cls", "part", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"))
    texts.join(dealt, "node").groupBy("band", "lo", "hi").applyInArrow(_settle, "a long, b long").write.parquet(f"{here}/links")
    new = spark.read.parquet(f"{here}/links")
    found = new.count()
    return _extend(label, 2 * n_links, new, found, here) if found else label


def _key(id_col: str, text_col: str):
    return F.coalesce(F.col(id_col).cast("long"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))))


def _digest(text_col: str):
    return F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit(""))))


def _alike(docs: DataFrame, id_col: str, text_col: str, root: str) -> DataFrame:
    """(key, digest, cls) of every distinct key and text: the class of the text, whatever ids
    its rows share with others."""
    spark = docs.sparkSession
    ship_code(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(_key(id_col, text_col).alias("key"), _digest(text_col).alias("digest"), text.alias("text"))
    signed = map_arrow(own, _sign, "key long, digest binary, bands array<long>, size long")
    signed.write.parquet(f"{root}/signed")
    signed = spark.read.parquet(f"{root}/signed")
    # a number for each text, fixed by the write; the row of its smallest key stands for it
    signed.groupBy("digest").agg(F.min("key").alias("key")).withColumn("node", F.monotonically_increasing_id()).write.parquet(f"{root}/nodes")
    nodes = spark.read.parquet(f"{root}/nodes")
    signed.select("key", "digest").distinct().join(nodes.select("digest", "node"), "digest").write.parquet(f"{root}/member")
    member = spark.read.parquet(f"{root}/member")
    sketches = signed.join(nodes, ["key", "digest"]).select("node", "size", "bands").dropDuplicates(["node"])
    bands = sketches.select("node", "size", F.posexplode("bands").alias("slot", "band"))
    bands.groupBy("band").count().filter("count > 1").write.parquet(f"{root}/shared")
    shared = spark.read.parquet(f"{root}/shared")  # read anew, so that the join can split a hot bucket
    bands.join(shared, "band").select("band", "slot", "node", "size", "count").write.parquet(f"{root}/buckets")
    buckets = spark.read.parquet(f"{root}/buckets")
    degree = buckets.groupBy("node").agg(F.sum("count").alias("degree"))
    # the texts that will be compared: one row a node
    compared = nodes.join(degree.select("node"), "node", "left_semi")
    own.join(compared, ["key", "digest"]).dropDuplicates(["key", "digest"]).select("node", "text").write.parquet(f"{root}/texts")
    texts = spark.read.parquet(f"{root}/texts")
    left = buckets.select("band", "slot", "node", "size").join(degree, "node").withColumn("cls", F.col("node"))
    left.write.parquet(f"{root}/round-0/left")
    level, label, tested, n_links, small = 0, None, None, 0, None
    order = F.struct("degree", "node", "size")

    def alike(x, y):
        """No overlap reaches the threshold if the smaller multiset can't cover it."""
        return F.least(x, y) + 1e-9 >= F.greatest(x, y) * THRESHOLD

    while True:
        here = f"{root}/round-{level}"
        left = spark.read.parquet(f"{here}/left")
        if left.isEmpty() and (small is None or small.isEmpty()):
            break
        centres = left.groupBy("band").agg(F.max(order).alias("c")).select("band", "c", F.col("c.node").alias("ccls"))
        if label is not None:
            centres = centres.join(_small(label.select(F.col("node").alias("ccls"), F.col("cls").alias("to")), 2 * n_links), "ccls", "left").select("band", "c", F.coalesce("to", "ccls").alias("ccls"))
        centres.write.parquet(f"{here}/centres")
        centres = spark.read.parquet(f"{here}/centres")  # read anew, so that the join can split a hot bucket
        n_centres = centres.count()
        met = left.join(_small(centres, n_centres), "band").filter((order < F.col("c")) & (F.col("cls") != F.col("ccls")) & alike(F.col("size"), F.col("c.size")))
        pairs = met.select(F.col("c.node").alias("centre"), "node")
        if small is not None:
            x, y = small.alias("x"), small.alias("y")
            each = x.join(y, (F.col("x.band") == F.col("y.band")) & (F.col("x.node") < F.col("y.node")) & (F.col("x.cls") != F.col("y.cls")) & alike(F.col("x.size"), F.col("y.size")))
            pairs = pairs.union(each.select(F.col("x.node").alias("centre"), F.col("y.node").alias("node")))
        pairs = pairs.distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["centre", "node"], "left_anti")
        pairs.write.parquet(f"{here}/pairs")
        pairs = spark.read.parquet(f"{here}/pairs")
        n = pairs.count()
        if n:
            sizes = pairs.groupBy("centre").agg(F.ceil(F.count("*") / GROUP).alias("groups"))
            dealt = pairs.join(_small(sizes, n), "centre").select("centre", "node", F.pmod(F.xxhash64("node"), "groups").alias("salt"))
            ends = dealt.unionByName(sizes.select("centre", F.col("centre").alias("node"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("groups") - 1)).alias("salt")))
            sides = texts.join(_small(ends, 2 * n), "node")
            sides.groupBy("centre", "salt").applyInArrow(_verify, "a long, b long").write.parquet(f"{here}/links")
            new = spark.read.parquet(f"{here}/links")
            if found := new.count():
                label = _extend(label, 2 * n_links, new, found, here)
                n_links += found
        tested = pairs if tested is None else tested.union(pairs)
        if level == LEVELS:
            break
        # on with the buckets that hold several classes, less their centres
        rest = left.join(_small(centres.select("band", F.col("c.node").alias("node")), n_centres), ["band", "node"], "left_anti")
        if label is not None:
            rest = rest.drop("cls").join(_small(label, 2 * n_links), "node", "left").withColumn("cls", F.coalesce("cls", "node"))
        state = rest.groupBy("band").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi"), F.count("*").alias("n")).filter("lo < hi").select("band", "n")
        state.write.parquet(f"{here}/open")
        still = spark.read.parquet(f"{here}/open")
        rest = rest.join(still, "band")
        rest.filter(F.col("n") <= SMALL).select("band", "node", "size", "cls").write.parquet(f"{here}/small")
        small = spark.read.parquet(f"{here}/small")
        large = rest.filter(F.col("n") > SMALL).drop("n")
        if level == 0:
            large = large.join(sketches.select("node", "bands"), "node")
        longer = F.xxhash64("band", F.element_at("bands", ((F.col("slot") + STRIDES[level]) % BANDS) + 1))
        level += 1
        split = large.withColumn("band", longer)
        split.write.parquet(f"{root}/round-{level}/split")
        split = spark.read.parquet(f"{root}/round-{level}/split")
        several = split.groupBy("band").agg(F.min("cls").alias("lo"), F.max("cls").alias("hi")).filter("lo < hi").select("band")
        split.join(several, "band", "left_semi").select("band", "slot", "node", "size", "degree", "cls", "bands").write.parquet(f"{root}/round-{level}/left")
    if level:
        label = _rest(spark, root, texts, label, n_links)
    if label is None:
        return member.select("key", "digest", F.col("node").alias("cls"))
    member.join(label, "node", "left").select("key", "digest", F.coalesce("cls", "node").alias("cls")).write.parquet(f"{root}/alike")
    return spark.read.parquet(f"{root}/alike")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, key, class_id) of every row: the smallest key among the row's near duplicates and
    the rows that share an id with one of them."""
    spark = docs.sparkSession
    root = scratch(spark, "near")
    alike = _alike(docs, id_col, text_col, root)
    alike.groupBy("key").agg(F.min("cls").alias("cls"), F.max("cls").alias("hi")).write.parquet(f"{root}/keys")
    keys = spark.read.parquet(f"{root}/keys")
    several = keys.filter("cls < hi").select("key", F.col("cls").alias("a"))
    alike.join(several, "key").filter("a < cls").select("a", F.col("cls").alias("b")).distinct().write.parquet(f"{root}/shared_ids")
    shared = spark.read.parquet(f"{root}/shared_ids")
    keys = keys.select("key", "cls")
    if n := shared.count():
        joined = _components(shared, n, f"{root}/ids").withColumnRenamed("cls", "to")
        keys = keys.join(_small(joined.withColumnRenamed("node", "cls"), 2 * n), "cls", "left").select("key", F.coalesce("to", "cls").alias("cls"))
    keys.groupBy("cls").agg(F.min("key").alias("class_id")).write.parquet(f"{root}/least")
    least = spark.read.parquet(f"{root}/least")  # read anew, so that the join can split a hot class
    own = docs.select(F.col(id_col).alias("id"), _key(id_col, text_col).alias("key"))
    return own.join(keys.join(least, "cls").select("key", "class_id"), "key").select(F.col("id").alias(id_col), "key", "class_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each group of alike texts, that of the smallest key (then digest); all
    its columns."""
    key, digest = "_key", "_digest"
    while key in docs.columns or digest in docs.columns:
        key, digest = "_" + key, "_" + digest
    alike = _alike(docs, id_col, text_col, scratch(docs.sparkSession, "near"))
    kept = alike.groupBy("cls").agg(F.min(F.struct("key", "digest")).alias("k")).select(F.col("k.key").alias(key), F.col("k.digest").alias(digest))
    own = docs.withColumn(key, _key(id_col, text_col)).withColumn(digest, _digest(text_col))
    kept = own.join(kept, [key, digest], "left_semi")
    # rows that repeat id and text are few: only they are compared as a whole
    many = own.groupBy(key, digest).count().filter("count > 1").drop("count")
    once = kept.join(many, [key, digest], "left_anti")
    return once.unionByName(kept.join(many, [key, digest], "left_semi").dropDuplicates([key, digest])).drop(key, digest)
