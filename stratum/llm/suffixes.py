"""Removal of repeated byte strings by blockwise suffix sorting with a difference cover.

Every byte that lies in a string of ``LENGTH`` bytes which also starts anywhere else goes.
Suffixes are compared to that depth only, and equality is all that counts, so ranks are
fingerprints and their order stands for the suffix order. Texts stay in blocks (packs of
documents); what is sorted are suffix buckets, one at a time:

1. Cover samples. Positions p with p mod ``PERIOD`` in the difference cover ``COVER`` are ranked
   by their next LENGTH - PERIOD + 1 bytes. For any two equal strings of LENGTH bytes some
   offset below PERIOD is a sample of both (that is what a difference cover is for), so a
   suffix without a repeated sample in its first PERIOD bytes has no equal: most end here.
2. Runs. The others may tie for long. Suffixes up to the same content-defined anchor form a
   run, sorted as one: by what all its strings share and by all that they cover together. A
   run whose shared part is alone has no tie; one whose whole span is repeated is all ties.
3. Single suffixes of the runs between are sorted by their LENGTH bytes (128-bit ranks).

In each round a block sends its distinct ranks, sorted and cut into buckets by their leading
bits; a bucket is sorted in one task and answers with a byte per rank. A bucket's size is
bounded since ranks are spread evenly and a block sends a rank once, however often it occurs;
exact copies of a text are found beforehand by digest and sorted only once.

Texts are shuffled once, by a hash of the id and the text, and kept on the executors' disks (recomputed if an
executor is lost) until the rounds are over.

Defined cases: null text is empty; texts shorter than LENGTH keep all; rows that repeat a
text, or even its id, are copies and lose all of it if it is long enough; extra columns are
ignored or (``keep_rest``) passed on, with cut characters left out of the text; an empty table
gives no rows. Memory is bounded by a block (``BLOCK_BYTES``, or the longest text) and a bucket.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratum.session import ship_code

from .common import flat, scratch, text_bytes

LENGTH = 400
PERIOD = 183
#: FIXED VALUES: a perfect difference set: every residue mod PERIOD is a difference of two.
COVER = (0, 12, 19, 20, 22, 43, 60, 71, 76, 85, 89, 115, 121, 168)
REACH = 127  # an anchor belongs to the suffixes that start at most so far before it
GRAM, GRAM_BITS = 16, 5  # an anchor is one in 2**GRAM_BITS strings of GRAM bytes
BLOCK_BYTES, BUCKET_BYTES = 4 << 20, 2 << 20
NOTE = "block int, round int, bucket int, data binary"
NONE, SOME, ALL, ALL_SHOWN = 0, 1, 2, 3

_rng = np.random.default_rng(20240229)
_BYTES = _rng.integers(0, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = [int(x) | 1 for x in _rng.integers(1 << 61, 1 << 63, 2, dtype=np.uint64)]
_IN_COVER = np.isin(np.arange(PERIOD), COVER)
_LOW = 12  # powers are products of two small tables, by the low and the high bits of the exponent
PART = 1 << 16  # positions whose intermediate values are held at once; a multiple of 2**_LOW
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _tables(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers base**i for i < 2**_LOW and base**(i << _LOW) up to n, modulo 2**64."""
    high = (n >> _LOW) + 1
    got = _powers.get(base)
    if got is None or len(got[1]) < high:
        size = max(high, 1 << 12)
        step = np.uint64(pow(base, 1 << _LOW, 1 << 64))
        low = np.concatenate(([np.uint64(1)], np.cumprod(np.full((1 << _LOW) - 1, base, np.uint64))))
        got = _powers[base] = low, np.concatenate(([np.uint64(1)], np.cumprod(np.full(size - 1, step, np.uint64))))
    return got


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Prefixes:
    """Polynomial prefix sums of a byte string: fingerprints of any of its substrings."""

    def __init__(self, raw: np.ndarray, k: int = 0):
        n = len(raw)
        low, high = _tables(_BASE[k], n)
        self.inverse = _tables(pow(_BASE[k], -1, 1 << 64), n)
        self.sums = np.zeros(n + 1, np.uint64)
        for i in range(0, n, PART):
            part = raw[i : i + PART]
            power = np.multiply.outer(high[i >> _LOW : ((i + len(part) - 1) >> _LOW) + 1], low).ravel()[: len(part)]
            own = np.cumsum(_BYTES[k][part] * power, out=self.sums[i + 1 : i + 1 + len(part)])
            own += self.sums[i]

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        low, high = self.inverse
        return _mix((self.sums[b] - self.sums[a]) * (low[a & ((1 << _LOW) - 1)] * high[a >> _LOW]))


class Ranks:
    """A round's ranks in one block: distinct (a, b) in order, and each item's place."""

    def __init__(self, a: np.ndarray, b: np.ndarray | None = None):
        order = np.argsort(a, kind="stable") if b is None else np.lexsort((b, a))
        sa = a[order]
        new = np.ones(len(a), bool)
        if len(a):
            new[1:] = sa[1:] != sa[:-1]
        sb = None
        if b is not None:
            sb = b[order]
            if len(a):
                new[1:] |= sb[1:] != sb[:-1]
        place = np.cumsum(new) - 1
        self.place = np.empty(len(a), np.int64)
        self.place[order] = place
        self.many = np.bincount(place, minlength=int(new.sum())) > 1
        self.a, self.b = sa[new], None if sb is None else sb[new]

    def blobs(self, block: int, round_: int, bits: int, width: int):
        """One row per bucket: the ranks' ``width`` bits below the bucket's, b, and ``many``."""
        bucket = (self.a >> np.uint64(64 - bits)).astype(np.int64)
        if not len(bucket):  # a block of short texts
            return
        used, at = np.unique(bucket, return_index=True)
        for k, i, j in zip(used.tolist(), at.tolist(), [*at[1:].tolist(), len(bucket)], strict=True):
            a = self.a[i:j]
            key = ((a << np.uint64(bits)) >> np.uint64(32)).astype("<u4") if width == 32 else a.astype("<u8")
            b = b"" if self.b is None else self.b[i:j].astype("<u8").tobytes()
            yield block, round_, k, np.int64(j - i).tobytes() + key.tobytes() + b + np.packbits(self.many[i:j]).tobytes()


def _sort_bucket(table: pa.Table) -> pa.Table:
    """Sort one bucket; per rank of each block: NONE, or for pairs SOME / ALL / ALL_SHOWN."""
    blobs, round_ = table.column("data").to_pylist(), table.column("round")[0].as_py()
    keys, more, many, sizes = [], [], [], []
    for x in blobs:
        n, at, w = int(np.frombuffer(x, np.int64, 1)[0]), 8, 4 if round_ == 1 else 8
        keys.append(np.frombuffer(x, f"<u{w}", n, at))
        at += w * n
        if round_ > 1:
            more.append(np.frombuffer(x, "<u8", n, at))
            at += 8 * n
        many.append(np.unpackbits(np.frombuffer(x, np.uint8, -1, at), count=n).astype(bool))
        sizes.append(n)
    a, many = np.concatenate(keys), np.concatenate(many)
    b = np.concatenate(more) if more else np.zeros(len(a), np.uint8)
    order = np.lexsort((b, a))
    sa, sb, sm = a[order], b[order], many[order]
    head = np.concatenate(([True], sa[1:] != sa[:-1]))
    group = np.cumsum(head) - 1
    if round_ == 1:
        code = ((np.bincount(group) > 1)[group] | sm).astype(np.uint8)
    else:
        pair_head = head | np.concatenate(([True], sb[1:] != sb[:-1]))
        pair = np.cumsum(pair_head) - 1
        tied = (np.bincount(pair) > 1)[pair] | sm
        if round_ == 3:
            code = tied.astype(np.uint8)
        else:
            shared = (np.bincount(group) > 1)[group] | sm
            # where spans of a group differ, one run of each repeated span shows its suffixes
            differ = np.bincount(group, weights=~tied)[group] > 0
            code = np.where(tied, np.where(differ & pair_head, ALL_SHOWN, ALL), np.where(shared, SOME, NONE)).astype(np.uint8)
    answer = np.empty(len(a), np.uint8)
    answer[order] = code
    cut = np.cumsum([0, *sizes])
    data = [answer[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)]
    return pa.table({"block": table.column("block"), "round": table.column("round"), "bucket": table.column("bucket"), "data": pa.array(data, pa.binary())})


class Block:
    """The texts of one block that are sorted, with the answers of earlier rounds."""

    def __init__(self, texts: pa.Table, notes: pa.Table, text_col: str, digest_col: str, length: int = LENGTH):
        self.length = length
        digests = texts.column(digest_col).to_pylist()
        self.answers: dict[int, list[tuple[int, bytes]]] = {}
        copied: dict[str, int] = {}
        for r, k, x in zip(*(notes.column(c).to_pylist() for c in ("round", "bucket", "data")), strict=True):
            if r == 0:
                copied[x.decode()] = k
            else:
                self.answers.setdefault(r, []).append((k, x))
        # a copied text is sorted once, in one block
        self.copied = [d in copied for d in digests]
        seen, own = set(), []
        for d in digests:
            own.append(not (d in copied and (copied[d] == 0 or d in seen)))
            seen.add(d)
        self.raw, off = flat(pa.concat_arrays([c.cast(pa.large_string()) for c in texts.column(text_col).chunks] or [pa.array([], pa.large_string())]))
        self.off = off
        size = np.diff(off)
        self.rows = np.flatnonzero(np.array(own, bool) & (size >= self.length)) if len(size) else np.zeros(0, np.int64)
        self.sums = Prefixes(self.raw)

    def _answer(self, round_: int, ranks: Ranks) -> np.ndarray:
        got = b"".join(x for _, x in sorted(self.answers.get(round_, [])))
        return np.frombuffer(got, np.uint8)[ranks.place]

    def samples(self) -> np.ndarray:
        at = []
        for i in self.rows:
            n = self.off[i + 1] - self.off[i]
            at.append(self.off[i] + np.flatnonzero(np.resize(_IN_COVER, n - (self.length - PERIOD + 1) + 1)))
        at = np.concatenate(at) if at else np.zeros(0, np.int64)
        self.sample_at = at
        return self.sums.of(at, at + (self.length - PERIOD + 1))

    def candidates(self, ranks: Ranks) -> np.ndarray:
        """Starts with a repeated sample in their first PERIOD bytes."""
        hit = self.sample_at[self._answer(1, ranks) > 0]
        step = np.zeros(len(self.raw) + 1, np.int32)
        first = self.off[np.searchsorted(self.off, hit, side="right") - 1]
        np.add.at(step, np.maximum(hit - PERIOD + 1, first), 1)
        np.add.at(step, hit + 1, -1)
        on = np.cumsum(step[:-1]) > 0
        valid = np.zeros(len(self.raw), bool)
        for i in self.rows:
            valid[self.off[i] : self.off[i + 1] - self.length + 1] = True
        return np.flatnonzero(on & valid)

    def runs(self, at: np.ndarray):
        """Anchor of each candidate (-1: none in reach), and the runs' shared and whole ranks."""
        n = len(self.raw)
        parts = [np.arange(i, min(i + PART, n - GRAM + 1)) for i in range(0, max(1, n - GRAM + 1), PART)]
        anchors = np.concatenate([p[self.sums.of(p, p + GRAM) >> np.uint64(64 - GRAM_BITS) == 0] for p in parts])
        nxt = np.searchsorted(anchors, at)
        anchor = np.append(anchors, n + REACH)[nxt]
        end = self.off[np.searchsorted(self.off, at, side="right")]
        anchor = np.where((anchor - at <= REACH) & (anchor + GRAM <= end), anchor, -1)
        own, run = np.unique(anchor[anchor >= 0], return_inverse=True)
        which = np.searchsorted(anchors, own)
        before = np.where(which > 0, anchors[np.maximum(which - 1, 0)], -1) if len(own) else own
        doc = np.searchsorted(self.off, own, side="right") - 1
        low = np.maximum(np.maximum(before + 1, own - REACH), self.off[doc])
        high = np.minimum(own, self.off[doc + 1] - self.length)
        shared = self.sums.of(own, own - REACH + self.length)
        whole = self.sums.of(low, high + self.length)
        whole = _mix(whole + ((own - low) * 512 + (high - low)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        return anchor >= 0, run, shared, whole

    def step(self, number: int):
        """Ranks of round ``number``, or the starts that are repeated after the last."""
        ranks = Ranks(self.samples())
        if number == 1:
            return ranks
        at = self.candidates(ranks)
        anchored, run, shared, whole = self.runs(at)
        ranks = Ranks(shared, whole)
        if number == 2:
            return ranks
        code = np.full(len(at), SOME, np.uint8)
        code[anchored] = self._answer(2, ranks)[run]
        shown = at[(code == SOME) | (code == ALL_SHOWN)]
        ranks = Ranks(self.sums.of(shown, shown + self.length), Prefixes(self.raw, 1).of(shown, shown + self.length))
        if number == 3:
            return ranks
        single = shown[(self._answer(3, ranks) > 0) & (code[(code == SOME) | (code == ALL_SHOWN)] == SOME)]
        return np.concatenate([at[code >= ALL], single])

    def removed(self) -> np.ndarray:
        """A mark for each byte that goes."""
        starts = self.step(4)
        edge = np.zeros(len(self.raw) + 1, np.int32)
        np.add.at(edge, starts, 1)
        np.add.at(edge, starts + self.length, -1)
        gone = np.cumsum(edge[:-1]) > 0
        for i, c in enumerate(self.copied):
            if c and self.off[i + 1] - self.off[i] >= self.length:
                gone[self.off[i] : self.off[i + 1]] = True
        return gone


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_rest: bool = False, length: int = LENGTH) -> tuple[DataFrame, DataFrame]:
    """(result, what to unpersist when the result has been written). Strings of ``length`` bytes
    count, of at least ``PERIOD + REACH // 2`` (so that samples are long enough to tell).

    The result has the id, n_bytes, n_removed, n_spans and kept_sha256 of each row; with
    ``keep_rest`` it has the rows' own columns, the text being what is left of it.
    """
    if length < PERIOD + REACH // 2:
        raise ValueError(f"length must be at least {PERIOD + REACH // 2}")
    spark = docs.sparkSession
    ship_code(spark)
    total = text_bytes(docs, text_col)
    blocks = max(1, math.ceil(total / BLOCK_BYTES))
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / (32 << 20)))
    names = ["_block", "_digest"]
    while set(names) & set(docs.columns):
        names = ["_" + x for x in names]
    block, digest = names
    own = docs if keep_rest else docs.select(id_col, text_col)
    own = own.withColumn(digest, F.md5(F.coalesce(F.col(text_col), F.lit(""))))
    own = own.withColumn(block, F.pmod(F.xxhash64(id_col, digest), F.lit(blocks)).cast("int"))
    long = own.filter(F.octet_length(text_col) >= length)
    counts = long.groupBy(F.col(digest).alias("digest"), F.col(block).alias("block")).count()
    groups = counts.groupBy("digest").agg(F.sum("count").alias("n"), F.min("block").alias("first")).filter("n > 1")
    root = scratch(spark, "suffixes")
    copies = counts.join(groups, "digest").select("block", F.lit(0).alias("round"), (F.col("block") == F.col("first")).cast("int").alias("bucket"), F.encode("digest", "UTF-8").alias("data"))
    copies.write.parquet(f"{root}/0")
    notes = spark.read.schema(NOTE).parquet(f"{root}/0")
    packed = own.repartition(parts, block).sortWithinPartitions(block).persist(StorageLevel.DISK_ONLY)

    def sender(number: int, bits: int):
        def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
            rows = []
            if left.num_rows:
                rows = list(Block(left, right, text_col, digest, length).step(number).blobs(key[0].as_py(), number, bits, 32 if number == 1 else 64))
            cols = list(zip(*rows, strict=True)) or [[], [], [], []]
            return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.int32(), pa.binary()), strict=True)], ["block", "round", "bucket", "data"])

        return run

    for number, per_byte in ((1, 4 * len(COVER) / PERIOD), (2, 16 / 2**GRAM_BITS), (3, 0.5)):
        bits = min(24, max(3, math.ceil(math.log2(max(1, total * per_byte / BUCKET_BYTES)))))
        sent = packed.groupBy(block).cogroup(notes.groupBy("block")).applyInArrow(sender(number, bits), NOTE)
        sent.groupBy("bucket").applyInArrow(_sort_bucket, NOTE).write.parquet(f"{root}/{number}")
        notes = spark.read.schema(NOTE).parquet(*[f"{root}/{i}" for i in range(number + 1)])

    out = docs.schema if keep_rest else f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string"

    def finish(key, left: pa.Table, right: pa.Table) -> pa.Table:
        rest = left.drop_columns(names)
        if not left.num_rows:
            return rest if keep_rest else _report(left.column(id_col), [], id_col)
        b = Block(left, right, text_col, digest, length)
        gone, rows = b.removed(), []
        for i, j in zip(b.off[:-1], b.off[1:], strict=True):
            cut = gone[i:j]
            if not cut.any():
                rows.append((int(j - i), 0, 0, b.raw[i:j].tobytes()))
            else:
                spans = int(np.count_nonzero(cut[1:] & ~cut[:-1])) + int(cut[0])
                rows.append((int(j - i), int(cut.sum()), spans, b.raw[i:j][~cut].tobytes()))
        if not keep_rest:
            return _report(left.column(id_col), rows, id_col)
        at = rest.column_names.index(text_col)
        old = rest.column(text_col).to_pylist()
        text = [o if r[1] == 0 else r[3].decode(errors="ignore") for o, r in zip(old, rows, strict=True)]
        return rest.set_column(at, rest.schema.field(text_col), pa.chunked_array([pa.array(text, rest.schema.field(text_col).type)]))

    return packed.groupBy(block).cogroup(notes.groupBy("block")).applyInArrow(finish, out), packed


def _report(ids, rows, id_col: str) -> pa.Table:
    n, removed, spans, kept = zip(*rows, strict=True) if rows else ([], [], [], [])
    digests = [hashlib.sha256(k).hexdigest() for k in kept]
    return pa.table([ids, pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digests, pa.string())], [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256"])
