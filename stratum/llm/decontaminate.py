"""Benchmark decontamination by a generalised suffix automaton of the test items.

Texts are normalised to words (A-Z lowered; runs of digits, letters a-z and non-ASCII). The
automaton of all items' word sequences is built once per worker; a document's words are
streamed through it, and at each word the length of the longest match that ends there is
known. Where it reaches the window length (13, or the whole of a shorter item) a window
occurs, its words are hit and its items are looked up. Words that no item has reset the
match, so only runs of known words are streamed.

The benchmark's distinct texts are cut into shards of about ``SHARD_BYTES`` by a hash; each shard
is collected and broadcast for itself, and the documents pass through one job per shard, whose
hits are written in between, so neither the driver nor a worker's automaton outgrows a shard.

``report`` tells what is hit, ``drop_contaminated`` removes documents whose hits exceed the
coverage limit, ``remove_spans`` also cuts the hit runs of a given length out of the others.

Defined cases: null or wordless text has no words and is never contaminated; null or wordless
items have no window; an item with a null id counts as item ``null``; rows with equal ids are
scanned one by one; equal items hit alike and count by distinct id; an empty benchmark hits
nothing; extra columns pass through.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cast_binary, map_arrow, scratch, text_batches, text_bytes

WINDOW = 13
SHARD_BYTES = 16 << 20
#: FIXED VALUES: bytes that are part of words once A-Z is lowered; all others become a space.
_WORD = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))

WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")  # the same words, where they stand

HITS = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.StringType())), T.StructField("spans", T.ArrayType(T.IntegerType()))])
_HITS = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("spans", pa.list_(pa.int32()))])


def words(data: bytes) -> list[bytes]:
    return data.lower().translate(_WORD).split()


class Automaton:
    """Suffix automaton of many word sequences, with the windows' items."""

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        self.window, self.vocab = window, {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]
        self.items: dict[tuple[int, ...], set[str]] = {}
        self.short: set[int] = set()  # lengths of the items that are one short window
        seen = set()
        for item, text in items:
            seq = tuple(self.vocab.setdefault(w, len(self.vocab)) for w in words(text))
            if not seq:
                continue
            size = min(window, len(seq))
            if size < window:
                self.short.add(size)
            for i in range(len(seq) - size + 1):
                self.items.setdefault(seq[i : i + size], set()).add(item)
            if seq not in seen:
                seen.add(seq)
                last = 0
                for w in seq:
                    last = self._extend(last, w)
        self.least = min([window, *self.short])

    def _split(self, p: int, w: int) -> int:
        """The state of p's strings followed by w; splits the target where it also has longer ones."""
        q = self.next[p][w]
        if self.len[q] == self.len[p] + 1:
            return q
        clone = len(self.next)
        self.next.append(dict(self.next[q]))
        self.len.append(self.len[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, w: int) -> int:
        if w in self.next[last]:
            return self._split(last, w)
        new = len(self.next)
        self.next.append({})
        self.len.append(self.len[last] + 1)
        self.link.append(0)
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, w)
        return new

    def scan(self, data: bytes) -> tuple[int, np.ndarray | None, set[str]]:
        """(number of words, hit mark per word or None, items with an occurring window)."""
        get = self.vocab.get
        ids = [get(w, -1) for w in words(data)]
        n, hit, found = len(ids), None, set()
        if n < self.least:
            return n, hit, found
        cuts = np.flatnonzero(np.asarray(ids, dtype=np.int32) < 0)
        edge = np.concatenate(([-1], cuts, [n]))
        for k in np.flatnonzero(np.diff(edge) > self.least):
            state = length = 0
            for e in range(edge[k] + 1, edge[k + 1]):
                w = ids[e]
                while state and w not in self.next[state]:
                    state = self.link[state]
                    length = self.len[state]
                if w in self.next[state]:
                    state, length = self.next[state][w], length + 1
                if length < self.least:
                    continue
                for size in (self.window, *self.short) if self.short else (self.window,):
                    if length >= size and (own := self.items.get(tuple(ids[e - size + 1 : e + 1]))):
                        if hit is None:
                            hit = np.zeros(n, bool)
                        hit[e - size + 1 : e + 1] = True
                        found |= own
        return n, hit, found


_built: dict[str, Automaton] = {}


def forget() -> None:
    _built.clear()


def _scanner(shard, key: str, text_at: int, hits_at: int | None, keep: list[int], names: list[str]):
    def run(it: Iterator[pa.RecordBatch]):
        if key not in _built:
            _built.clear()
            _built[key] = Automaton(shard.value)
        scan = _built[key].scan
        for b in text_batches(it):
            texts = cast_binary(b.column(text_at)).to_pylist()
            before = b.column(hits_at).to_pylist() if hits_at is not None else [None] * b.num_rows
            out = []
            for data, old in zip(texts, before, strict=True):
                n, hit, found = scan(data or b"")
                if old and old["spans"]:
                    hit = np.zeros(n, bool) if hit is None else hit
                    for a, z in zip(old["spans"][::2], old["spans"][1::2], strict=True):
                        hit[a:z] = True
                    found |= set(old["items"])
                spans = [] if hit is None else np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0])))).tolist()
                out.append({"n_words": n, "n_hit": 0 if hit is None else int(hit.sum()), "items": sorted(found), "spans": spans})
            yield pa.RecordBatch.from_arrays([b.column(i) for i in keep] + [pa.array(out, _HITS)], names)

    return run


def scan(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", keep: list[str] | None = None, into: str = "hits") -> DataFrame:
    """The columns ``keep`` of every row, and the struct ``into``: n_words, n_hit, items (sorted
    ids with occurring windows) and spans (start, end, start, end ... of the hit word runs)."""
    keep = docs.columns if keep is None else keep
    if into in docs.columns:
        raise ValueError(f"{into} is a column of the documents; choose another name for the result")
    spark = docs.sparkSession
    rows = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item_id"), "text").filter("text is not null")
    # a text counts once, however many items repeat it: shards of distinct texts are even
    items = rows.groupBy("text").agg(F.collect_set("item_id").alias("ids")).withColumn("all", F.concat("text", F.array_join("ids", "")))
    shards = max(1, math.ceil(text_bytes(items, "all") / SHARD_BYTES))
    sc = spark.sparkContext
    df = docs
    for i in range(shards):
        if i:  # one automaton at a time: what the shards before found is written
            root = scratch(spark, "hits")
            df.write.parquet(root)
            df = spark.read.parquet(root)
        own = [(x, r.text.encode()) for r in items.filter(F.pmod(F.xxhash64("text"), F.lit(shards)) == i).collect() for x in r.ids]
        cols = df.columns
        left = keep if i == shards - 1 else docs.columns
        out = T.StructType([df.schema[c] for c in left] + [T.StructField(into, HITS)])
        run = _scanner(sc.broadcast(own), uuid.uuid4().hex, cols.index(text_col), cols.index(into) if i else None, [cols.index(c) for c in left], [*left, into])
        df = map_arrow(df, run, out)
    return df


def contaminated(hits):
    """Some words are hit, and at least a twentieth of all words."""
    return (hits["n_hit"] > 0) & (20 * hits["n_hit"] >= hits["n_words"])


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with its hits and the verdict."""
    h = F.col("hits")
    return scan(docs.select(id_col, text_col), benchmark, text_col, [id_col]).select(
        id_col, h["n_words"].alias("n_words"), h["n_hit"].alias("n_hit"), F.size(h["items"]).cast("long").alias("n_items"),
        F.sha2(F.array_join(h["items"], ","), 256).alias("items_sha256"), contaminated(h).alias("contaminated"),
    )


def _cut(text_at: int, hits_at: int, keep: list[int], names: list[str], least: int):
    def run(it: Iterator[pa.RecordBatch]):
        for b in text_batches(it):
            out = []
            for data, hits in zip(cast_binary(b.column(text_at)).to_pylist(), b.column(hits_at).to_pylist(), strict=True):
                spans = [(a, z) for a, z in zip(hits["spans"][::2], hits["spans"][1::2], strict=True) if z - a >= least]
                if data is not None and spans:
                    at = [m.span() for m in WORD.finditer(data)]
                    edge = [0, *(x for a, z in spans for x in (at[a][0], at[z - 1][1])), len(data)]
                    data = b"".join(data[i:j] for i, j in zip(edge[::2], edge[1::2], strict=True))
                out.append(None if data is None else data.decode())
            cols = [pa.array(out, b.schema.field(text_at).type) if i == text_at else b.column(i) for i in keep]
            yield pa.RecordBatch.from_arrays(cols, names)

    return run


def remove_spans(docs: DataFrame, benchmark: DataFrame, least: int = 1, text_col: str = "text") -> DataFrame:
    """The documents that are not contaminated (whose hits stay below the coverage limit), with
    all their columns, less the hit runs of ``least`` words or more."""
    into = "hits_" + uuid.uuid4().hex[:8]
    kept = scan(docs, benchmark, text_col, None, into).filter(~contaminated(F.col(into)))
    run = _cut(docs.columns.index(text_col), len(docs.columns), list(range(len(docs.columns))), docs.columns, least)
    return map_arrow(kept.select(*docs.columns, into), run, docs.schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that are not contaminated, with all their columns."""
    into = "hits_" + uuid.uuid4().hex[:8]
    return scan(docs, benchmark, text_col, None, into).filter(~contaminated(F.col(into))).drop(into)
