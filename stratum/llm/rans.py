"""Token-id files coded by a static range asymmetric numeral system (rANS).

One frequency table, counted over all tokens, is shared by all files. Tokens are cut into
blocks at document ends; a block interleaves ``lanes`` rANS states (symbol i belongs to lane
i mod lanes), so coding is vectorised over lanes, blocks decode independently, and a block
can be entered at its checkpoints (word offset and all lane states every ``STEPS`` steps).
Payload, tokens and table carry CRC-32 checksums.

Jobs: (1) range-partition the texts by id, encode each once with the tokenizers library and
stage token files, with pre-aggregated counts; (2) one task per file codes it; (3) one task
per file reads it back. Manifests hold one row per file, at most ``MAX_PARTS``.

Defined cases: null or empty text has only the end id; equal ids are ordered by the
beginning of their texts, then a digest; a null
id sorts first; extra columns are ignored; an empty table writes no file and gives no rows. A
failed or repeated task writes under a new name, and only files in the manifest are read.
Memory is bounded by a file's tokens (``PART_BYTES`` of text) and the longest text.
"""

from __future__ import annotations

import json
import math
import re
import struct
import uuid
import zlib
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filesystem, flat, map_arrow, scratch, text_batches, text_bytes

SCALE = 20  # bits of the frequency table's total
LANES, STEPS = 1024, 128  # largest number of lanes; steps between checkpoints
BLOCK = 1 << 18  # tokens after which a block is closed at the next document's end
PART_BYTES, MAX_PARTS = 32 << 20, 20_000
ENCODE_BYTES = 8 << 20  # of text that is encoded at once
LOW = np.uint64(1 << 31)
END_ID = 2
MAGIC, BLOCK_HEAD = b"RANSTOK1", struct.Struct("<4sIIIIII")


class Table:
    """Frequencies that sum to 2**SCALE, at least 1 for each symbol of the vocabulary."""

    def __init__(self, freq: np.ndarray):
        self.freq = freq.astype(np.uint64)
        self.cum = np.concatenate(([0], np.cumsum(self.freq)[:-1])).astype(np.uint64)
        self.symbol = np.repeat(np.arange(len(freq), dtype=np.uint32), freq.astype(np.int64))
        self.crc = zlib.crc32(freq.astype("<u4").tobytes())

    @classmethod
    def from_counts(cls, counts: dict[int, int], size: int) -> Table:
        n = np.zeros(size)
        for k, v in counts.items():
            n[k] = v
        spare = (1 << SCALE) - size
        q = 1 + np.floor(n * (spare / max(1.0, n.sum()))).astype(np.int64)
        q[int(n.argmax())] += (1 << SCALE) - int(q.sum())
        return cls(q)


def encode_block(ids: np.ndarray, t: Table) -> bytes:
    n = len(ids)
    lanes = max(1, min(LANES, 1 << max(0, (n // 64).bit_length() - 1)))
    steps = -(-n // lanes)
    x = np.full(lanes, LOW, np.uint64)
    out, marks = [b""] * steps, []
    for s in range(steps - 1, -1, -1):
        own = ids[s * lanes : (s + 1) * lanes]
        f, c = t.freq[own], t.cum[own]
        v = x[: len(own)]
        full = v >= (f << np.uint64(63 - SCALE))
        if full.any():
            out[s] = v[full].astype("<u4").tobytes()
            v = np.where(full, v >> np.uint64(32), v)
        q = v // f
        x[: len(own)] = (q << np.uint64(SCALE)) + (v - q * f) + c
        if s and s % STEPS == 0:
            marks.append((s, x.copy()))
    at = np.concatenate(([0], np.cumsum([len(w) // 4 for w in out]))).astype(np.int64)
    payload = b"".join(out)
    body = x.astype("<u8").tobytes() + b"".join(struct.pack("<I", at[s]) + m.astype("<u8").tobytes() for s, m in reversed(marks)) + payload
    head = BLOCK_HEAD.pack(b"RBLK", n, lanes, len(payload) // 4, len(marks), zlib.crc32(body), zlib.crc32(ids.astype("<u4").tobytes()))
    return head + body


def decode_block(buf: bytes, t: Table, checkpoint: int = 0) -> np.ndarray:
    """The block's ids from a checkpoint on (0: all of them)."""
    magic, n, lanes, n_words, n_marks, crc, ids_crc = BLOCK_HEAD.unpack_from(buf)
    body = memoryview(buf)[BLOCK_HEAD.size :]
    if magic != b"RBLK" or zlib.crc32(body) != crc:
        raise ValueError("damaged token block")
    if checkpoint > n_marks:
        raise ValueError(f"the block has {n_marks} checkpoints")
    mark = 4 + 8 * lanes
    at, start = 0, 8 * lanes + (checkpoint - 1) * mark
    if checkpoint:
        (at,) = struct.unpack_from("<I", body, start)
        start += 4
    x = np.frombuffer(body, "<u8", lanes, start if checkpoint else 0).astype(np.uint64)
    words = np.frombuffer(body, "<u4", n_words, 8 * lanes + n_marks * mark).astype(np.uint64)
    first = checkpoint * STEPS
    steps = -(-n // lanes)
    out = np.empty(n - first * lanes, np.uint32)
    slots = np.uint64((1 << SCALE) - 1)
    for s in range(first, steps):
        a = s * lanes
        m = min(lanes, n - a)
        v = x[:m]
        slot = v & slots
        sym = t.symbol[slot]
        out[a - first * lanes : a - first * lanes + m] = sym
        v = t.freq[sym] * (v >> np.uint64(SCALE)) + slot - t.cum[sym]
        need = v < LOW
        k = int(np.count_nonzero(need))
        if k:
            v[need] = (v[need] << np.uint64(32)) | words[at : at + k]
            at += k
        x[:m] = v
    if not checkpoint and zlib.crc32(out.tobytes()) != ids_crc:
        raise ValueError("decoded tokens differ from what was written")
    return out


def write_file(f, docs: list[tuple[int | None, np.ndarray]], t: Table) -> None:
    """Blocks, then a footer (documents, tokens, blocks) and its length and checksum."""
    f.write(MAGIC + struct.pack("<I", t.crc))
    at, blocks, own, n, k = len(MAGIC) + 4, [], [], 0, 0
    for i, (_, ids) in enumerate(docs):
        own.append(ids)
        n += len(ids)
        if n >= BLOCK or i == len(docs) - 1:
            b = encode_block(np.concatenate(own), t)
            f.write(b)
            blocks.append([at, len(b), i + 1 - k])
            at, own, n, k = at + len(b), [], 0, i + 1
    foot = zlib.compress(json.dumps({"ids": [d for d, _ in docs], "n": [len(x) for _, x in docs], "blocks": blocks}).encode(), 1)
    f.write(foot + struct.pack("<II", len(foot), zlib.crc32(foot)) + MAGIC)


def read_file(f, t: Table):
    """(doc id, ids) of each document, block by block."""
    size = f.size()
    head = f.read_at(len(MAGIC) + 4, 0)
    tail = f.read_at(8 + len(MAGIC), size - 8 - len(MAGIC))
    n, crc = struct.unpack("<II", tail[:8])
    foot = f.read_at(n, size - 8 - len(MAGIC) - n)
    if head[: len(MAGIC)] != MAGIC or tail[8:] != MAGIC or zlib.crc32(foot) != crc or struct.unpack("<I", head[len(MAGIC) :])[0] != t.crc:
        raise ValueError("damaged token file, or written with another table")
    meta = json.loads(zlib.decompress(foot))
    k = 0
    for at, length, docs in meta["blocks"]:
        ids = decode_block(f.read_at(length, at), t)
        for d, m in zip(meta["ids"][k : k + docs], np.split(ids, np.cumsum(meta["n"][k : k + docs])[:-1]), strict=True):
            yield d, m
        k += docs


class Memory:
    """Distinct byte strings, numbered as they come, and the ids of each in one array."""

    def __init__(self):
        self.keys = pa.array([], pa.large_binary())
        self.ids = np.zeros(0, "<u4")
        self.end = np.zeros(1, np.int64)  # string k's ids stand from end[k] to end[k + 1]

    def put(self, keys: pa.Array, ids: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Numbers of new strings, given the ids of all of them and how many each has."""
        n = len(self.keys)
        self.keys = pa.concat_arrays([self.keys, keys])
        self.ids = np.concatenate([self.ids, ids])
        self.end = np.concatenate([self.end, self.end[-1] + np.cumsum(size)])
        return n + np.arange(len(keys))

    def at(self, keys: pa.Array) -> np.ndarray:
        """Numbers of strings; -1 for an unknown one."""
        return pc.index_in(keys, value_set=self.keys).fill_null(-1).to_numpy().astype(np.int64)

    def take(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the numbered strings, one after another, and how many each has."""
        first = self.end[at]
        size = self.end[at + 1] - first
        stop = np.cumsum(size)
        n = int(stop[-1]) if len(stop) else 0
        return self.ids[np.repeat(first - stop + size, size) + np.arange(n)], size


def _strings(raw: np.ndarray, off: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(off) - 1, [None, pa.py_buffer(np.ascontiguousarray(off, np.int64)), pa.py_buffer(np.ascontiguousarray(raw))])


class WordEncoder:
    """The library's encoding of a text, word by word.

    The tokenizer drops white space and treats each pre-token alone, so a text is the
    concatenation of its words. The words of a batch are looked up at once, as an Arrow column,
    and their ids gathered. New words of letters, digits and punctuation of Latin-1 split into
    pre-tokens as the tokenizer's own pattern does (all at once by the classes of their
    characters, those with an apostrophe by the pattern); new pre-tokens are encoded in one
    call. Any other word goes to the library as it is. Words and pre-tokens are remembered
    (bounded).
    """

    CACHE = 1_000_000
    PLAIN = re.compile("[!-~À-ÿ]+").fullmatch
    #: FIXED VALUES: the pattern of the tokenizer's pre-tokens.
    TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    #: FIXED VALUES: classes of ASCII characters: 1 letter, 2 digit, 3 other printable; 0 is left
    #: to the pattern (the apostrophe) or the library.
    LETTER, DIGIT, SIGN = 1, 2, 3
    CLASS = np.array([0 if not 0x21 <= c <= 0x7E or c == 0x27 else 1 if chr(c).isalpha() else 2 if chr(c).isdigit() else 3 for c in range(256)], np.uint8)
    LOWER = np.array([c + 32 if 0x41 <= c <= 0x5A else c for c in range(256)], np.uint8)

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        added = self.tok.get_added_tokens_decoder().values()
        self.special = [a.content.lower() for a in added]  # the library finds them inside words
        self.find = regex.compile(self.TOKEN).findall
        size = self.tok.get_vocab_size()
        self.ends = np.array([(self.tok.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        self.words, self.tokens = Memory(), Memory()

    def _library(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def _learn(self, new: pa.Array) -> np.ndarray:
        """Numbers of new pre-tokens, encoded in one call; each one's ids end with an
        end-of-word token."""
        own = [w.decode() for w in new.to_numpy(zero_copy_only=False)]
        ids = self._library(" ".join(own))
        stop = np.flatnonzero(self.ends[ids]) + 1
        if len(stop) == len(own) and stop[-1] == len(ids):
            return self.tokens.put(new, ids, np.diff(stop, prepend=0))
        each = [self._library(w) for w in own]
        return self.tokens.put(new, np.concatenate(each), np.array([len(x) for x in each]))

    def _known(self, tokens: pa.Array) -> np.ndarray:
        """Numbers of distinct pre-tokens; new ones are encoded."""
        at = self.tokens.at(tokens)
        new = np.flatnonzero(at < 0)
        for i in range(0, len(new), 16384):
            at[new[i : i + 16384]] = self._learn(tokens.take(pa.array(new[i : i + 16384])))
        return at

    def split(self, w: str) -> list[str] | None:
        """Pre-tokens of a word, or None if the library has to find them."""
        return self.find(w.lower()) if self.PLAIN(w) else None

    def _classes(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The class and the lower case of each byte; both bytes of a Latin-1 letter or sign
        are of its class."""
        kind, low = self.CLASS[raw], self.LOWER[raw]
        lead = np.flatnonzero(raw[:-1] == 0xC3)  # U+00C0 to U+00FF
        c = raw[lead + 1]
        sign = (c == 0x97) | (c == 0xB7)  # multiplication and division
        kind[lead] = kind[lead + 1] = np.where(c & 0xC0 != 0x80, 0, np.where(sign, self.SIGN, self.LETTER))
        low[lead + 1] = np.where((c >= 0x80) & (c < 0x9F) & ~sign, c + 0x20, c)
        return kind, low

    def add(self, words: pa.Array) -> np.ndarray:
        """Numbers of new distinct words, each with a space behind it."""
        if len(self.tokens.keys) > self.CACHE:
            self.tokens = Memory()
        raw, off = flat(words)
        off = off - np.arange(len(off))
        raw = raw[raw != 0x20]
        kind, low = self._classes(raw)
        odd = np.concatenate(([0], np.cumsum(kind == 0)))[off]
        plain = odd[1:] == odd[:-1]
        rest = [raw[i:j].tobytes().decode() for i, j in zip(off[:-1][~plain].tolist(), off[1:][~plain].tolist(), strict=True)]
        # the plain words alone, one after another
        length = np.diff(off)
        here = np.repeat(plain, length)
        kind, low, off = kind[here], low[here], np.concatenate(([0], np.cumsum(length[plain])))
        first = np.ones(len(kind) + 1, bool)
        first[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == self.DIGIT)
        first[off] = True
        start = np.flatnonzero(first)  # of each pre-token, and the end of the last
        own = _strings(low, start).dictionary_encode()
        ids, size = self.tokens.take(self._known(own.dictionary)[own.indices.to_numpy()])
        stop = np.concatenate(([0], np.cumsum(size)))[np.searchsorted(start, off)]
        at = np.empty(len(words), np.int64)
        at[plain] = self.words.put(words.filter(pa.array(plain)), ids, np.diff(stop))
        if rest:
            split = [self.split(w) for w in rest]
            own = pa.array([p.encode() for ps in split if ps is not None for p in ps], pa.large_binary()).dictionary_encode()
            token = iter(self._known(own.dictionary)[own.indices.to_numpy()].tolist())
            each = [self._library(w) if ps is None else self.tokens.take(np.array([next(token) for _ in ps]))[0] for w, ps in zip(rest, split, strict=True)]
            at[~plain] = self.words.put(words.filter(pa.array(~plain)), np.concatenate(each), np.array([len(x) for x in each]))
        return at

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        if not texts:
            return []
        ids, size = self.encode_column(pa.array(texts, pa.large_string()))
        return [x.tobytes() for x in np.split(ids, np.cumsum(size)[:-1])]

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and how many each has."""
        ids, size, at = [np.zeros(0, "<u4")], [np.zeros(0, np.int64)], 0
        for i in np.flatnonzero(pc.match_substring(texts, "<|").fill_null(False).to_numpy(zero_copy_only=False)).tolist():
            t = texts[i].as_py()
            if any(x in t.lower() for x in self.special):
                whole = self._library(t)
                for x, n in (self._by_words(texts.slice(at, i - at)), (whole, np.array([len(whole)]))):
                    ids.append(x)
                    size.append(n)
                at = i + 1
        x, n = self._by_words(texts.slice(at))
        return np.concatenate([*ids, x]), np.concatenate([*size, n])

    def _by_words(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        raw, off = flat(texts)
        # a word ends with the white space behind it, that of a text's last word being added
        raw, off = np.insert(raw, off[1:], 0x20), off + np.arange(len(off))
        raw[raw == 0x0A] = 0x20
        cut = np.concatenate(([0], np.flatnonzero(raw == 0x20) + 1))
        words, part = _strings(raw, cut), 2 * self.CACHE
        ids, size = zip(*[self._encode(words.slice(i, part)) for i in range(0, max(1, len(words)), part)], strict=True)
        stop = np.concatenate(([0], np.cumsum(np.concatenate(size))))[np.searchsorted(cut, off)]
        return np.concatenate(ids), np.diff(stop)

    def _encode(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, no more than twice as many as are remembered, and how many each has."""
        at = self.words.at(words)
        new = words.filter(pa.array(at < 0)).dictionary_encode()
        if len(self.words.keys) + len(new.dictionary) > self.CACHE:
            self.words, new = Memory(), words.dictionary_encode()
            at[:] = -1
        if len(new):
            at[at < 0] = self.add(new.dictionary)[new.indices.to_numpy()]
        return self.words.take(at)


@lru_cache(maxsize=1)
def encoder(path: str) -> WordEncoder:
    import gc

    gc.disable()  # the caches hold no cycles, and the collector would walk them again and again
    return WordEncoder(path)


def forget() -> None:
    encoder.cache_clear()
    load_table.cache_clear()


def _stage(path: str, root: str, id_col: str):
    def run(it):
        from pyspark import TaskContext

        enc, part = encoder(path), TaskContext.get().partitionId()
        ids, texts, counts, n = [], [], None, 0
        wide = np.uint16 if len(enc.ends) <= 1 << 16 else np.uint32
        for b in text_batches(it, ENCODE_BYTES):
            ids += b.column(0).to_pylist()
            whole, size = enc.encode_column(b.column(1))
            stop = np.cumsum(size)
            whole = np.insert(whole, stop, END_ID)  # counted at once: a count is as wide as the vocabulary
            c = np.bincount(whole, minlength=len(enc.ends))
            counts = c if counts is None else counts + c
            n += len(whole)
            texts += np.split(whole.astype(wide), (stop + np.arange(1, len(stop) + 1))[:-1])
        if not ids:
            return
        name = f"{root}/tokens-{part:06d}-{uuid.uuid4().hex}.npz"
        fs, p = filesystem(name)
        with fs.open_output_stream(p) as f:
            foot = zlib.compress(json.dumps([ids, [len(x) for x in texts]]).encode(), 1)
            f.write(struct.pack("<II", len(foot), wide().itemsize) + foot)
            for x in texts:
                f.write(x.tobytes())
        used = np.flatnonzero(counts)
        m = len(used)
        yield pa.RecordBatch.from_arrays(
            [pa.array([part] * (m + 1), pa.int32()), pa.array([name] + [None] * m, pa.string()), pa.array([-1, *used.tolist()], pa.int32()), pa.array([n, *counts[used].tolist()], pa.int64())],
            ["part", "path", "token", "n"],
        )

    return run


def _read_staged(name: str) -> list[tuple[int | None, np.ndarray]]:
    fs, p = filesystem(name)
    with fs.open_input_file(p) as f:
        size, width = struct.unpack("<II", f.read(8))
        ids, lengths = json.loads(zlib.decompress(f.read(size)))
        x = np.frombuffer(f.read(), np.uint16 if width == 2 else np.uint32).astype(np.uint32)
    return list(zip(ids, np.split(x, np.cumsum(lengths)[:-1]), strict=True))


def write_tokens(docs: DataFrame, tokenizer: str, root: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> dict:
    """Write the token files; returns the manifest: files [(path, first token)], table path."""
    spark = docs.sparkSession
    root = root or scratch(spark, "tokens")
    fs, p = filesystem(root)
    fs.create_dir(p, recursive=True)
    d = docs.select(id_col, text_col)
    total = text_bytes(d, text_col)
    parts = max(1, math.ceil(total / max(PART_BYTES, total // MAX_PARTS)))
    # rows of one id may fill several parts: they stand by the beginning of the text, then its digest
    order = [F.col(id_col).asc_nulls_first(), F.substring(text_col, 1, 64).asc_nulls_first(), "_digest", "_row"]
    d = d.toDF(id_col, text_col).withColumns({"_digest": F.xxhash64(text_col), "_row": F.monotonically_increasing_id()})
    d = d.repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("_digest", "_row")
    map_arrow(d, _stage(tokenizer, root, id_col), "part int, path string, token int, n long").write.parquet(f"{root}/staged")
    staged = spark.read.parquet(f"{root}/staged")
    files = sorted((r["part"], r["path"], r["n"]) for r in staged.filter("token < 0").collect())
    counts = {r["token"]: r["n"] for r in staged.filter("token >= 0").groupBy("token").agg(F.sum("n").alias("n")).collect()}
    t = Table.from_counts(counts, encoder_size(tokenizer))
    with fs.open_output_stream(f"{p}/table.u4") as f:
        f.write(t.freq.astype("<u4").tobytes())
    done, start = [], 0
    held = [path for _, path, _ in files]
    table = f"{root}/table.u4"

    def code(it):
        t = load_table(table)
        for b in it:
            for i in b.column(0).to_pylist():
                name = f"{root}/part-{i:06d}-{uuid.uuid4().hex}.rans"
                fs, p = filesystem(name)
                with fs.open_output_stream(p) as f:
                    write_file(f, _read_staged(held[i]), t)
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([name])], ["i", "path"])

    if held:
        names = {r["i"]: r["path"] for r in map_arrow(spark.range(0, len(held), 1, len(held)), code, "i long, path string").collect()}
        for i, (_, path, n) in enumerate(files):
            done.append((names[i], start))
            start += n
            sfs, sp = filesystem(path)
            sfs.delete_file(sp)
    return {"files": done, "table": table, "root": root}


def encoder_size(tokenizer: str) -> int:
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer).get_vocab_size()


@lru_cache(maxsize=2)
def load_table(path: str) -> Table:
    fs, p = filesystem(path)
    with fs.open_input_file(p) as f:
        return Table(np.frombuffer(f.read(), "<u4").astype(np.int64))


def read_tokens(spark, manifest: dict, id_col: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """(id, start, n_tokens, ids_crc32 and, if asked for, ids) of each document in the files."""
    files, table = manifest["files"], manifest["table"]

    def run(it):
        t = load_table(table)
        for b in it:
            for i in b.column(0).to_pylist():
                path, start = files[i]
                fs, p = filesystem(path)
                rows = []
                with fs.open_input_file(p) as f:
                    for d, ids in read_file(f, t):
                        raw = ids.astype("<u4").tobytes()
                        rows.append((d, start, len(ids), zlib.crc32(raw), ids))
                        start += len(ids)
                        if len(rows) >= 1000:
                            yield batch(rows)
                            rows = []
                if rows:
                    yield batch(rows)

    def batch(rows):
        d, s, n, c, ids = zip(*rows, strict=True)
        cols = [pa.array(d, pa.int64()), pa.array(s, pa.int64()), pa.array(n, pa.int64()), pa.array(c, pa.int64())]
        return pa.RecordBatch.from_arrays(cols + [pa.array(list(ids), pa.list_(pa.uint32())).cast(pa.list_(pa.int32()))] * with_ids, [id_col, "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)

    schema = f"`{id_col}` long, start long, n_tokens long, ids_crc32 long" + ", ids array<int>" * with_ids
    return map_arrow(spark.range(0, len(files), 1, max(1, len(files))), run, schema)
