"""Byte-level BPE encoding and decoding by monoid tree reduction.

A text splits into pattern matches; each match (piece) is encoded alone. Long pieces are
cut in halves recursively; two encoded neighbours are joined by re-encoding a window around
the seam. The window grows until the token outside each edge is stable: a token sequence is
the encoding of its bytes exactly if every adjacent pair re-encodes to itself, so once the
pairs at both window edges do, no token outside the window can change. Decoding is the same
fold: the bytes of a node are the concatenation of its children's.

Defined cases: null text is empty (0 tokens, empty bytes); repeated rows are encoded alike;
extra columns are ignored; an empty table gives an empty result. Memory is bounded by two
caches (``CACHE``) and the longest text.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import map_arrow, text_batches

LEAF = 16  # bytes up to which a piece is merged directly
CACHE, PIECES = 200_000, 500_000  # entries of each per-worker cache, and of that of pieces


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class TreeBPE:
    """Encoder and decoder over a rank table (token bytes -> rank). Short byte strings (leaves
    and seam windows) are merged by rank with the tiktoken core."""

    def __init__(self, ranks: dict[bytes, int]):
        import tiktoken

        self.ranks = ranks
        self.tokens = {i: t for t, i in ranks.items()}
        self.merge = tiktoken.Encoding("ranks", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self._pairs: dict[tuple[int, int], bool] = {}

    def stable(self, a: int, b: int) -> bool:
        """Whether the adjacent tokens a, b re-encode to themselves."""
        known = self._pairs.get((a, b))
        if known is None:
            if len(self._pairs) >= CACHE:
                self._pairs.clear()
            known = self._pairs[a, b] = self.merge(self.tokens[a] + self.tokens[b]) == [a, b]
        return known

    def join(self, x: list[int], y: list[int]) -> list[int]:
        """Encoding of the concatenated bytes of two encodings."""
        if not x or not y:
            return x or y
        i = j = 1
        while True:
            i, j = min(i, len(x)), min(j, len(y))
            mid = self.merge(b"".join([self.tokens[t] for t in x[-i:] + y[:j]]))
            left = i == len(x) or self.stable(x[-i - 1], mid[0])
            right = j == len(y) or self.stable(mid[-1], y[j])
            if left and right:
                return x[: len(x) - i] + mid + y[j:]
            i, j = i if left else 2 * i, j if right else 2 * j

    def encode(self, piece: bytes) -> list[int]:
        """Ids of one piece: halves, recursively, joined at the seam."""
        if len(piece) <= LEAF:
            return self.merge(piece) if piece else []
        mid = len(piece) // 2
        return self.join(self.encode(piece[:mid]), self.encode(piece[mid:]))

    def decode(self, ids: list[int]) -> bytes:
        """Concatenate up the tree: halves first, then the two byte strings."""
        if len(ids) <= 64:
            return b"".join([self.tokens[i] for i in ids])
        mid = len(ids) // 2
        return self.decode(ids[:mid]) + self.decode(ids[mid:])


class TextCodec:
    """Texts to token ids and back, remembering what it has encoded (bounded)."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.bpe = TreeBPE(load_ranks(path))
        # White_Space only: the module's \s also takes the separators U+001C..1F
        self.find = regex.compile(pattern.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")).findall
        self.odd = re.compile(r"[^\S \n]").search  # white space other than space and newline
        self.pieces: dict[str, list[int]] = {}
        self.chunks: dict[str, list[int]] = {}
        self.number = list(range(max(self.bpe.tokens) + 1))  # one object for each id, however often it is remembered
        self.decimal = [str(i) for i in self.number]

    def piece(self, s: str) -> list[int]:
        ids = self.pieces.get(s)
        if ids is None:
            if len(self.pieces) >= PIECES:
                self.pieces.clear()
            ids = [self.number[i] for i in self.bpe.encode(s.encode())]
            if len(s) < 64:
                self.pieces[s] = ids
        return ids

    def chunk(self, s: str) -> list[int]:
        """Ids of a text cut at piece boundaries."""
        ids = [i for p in self.find(s) for i in self.piece(p)]
        if len(s) < 64:
            if len(self.chunks) >= CACHE:
                self.chunks.clear()
            self.chunks[s] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        """Ids of a text, chunk by chunk.

        A space between two non-spaces always starts a piece, so the text may be cut before
        each such space; cuts next to other white space are closed again.
        """
        known = self.chunks.get
        cut = text.split(" ")
        if "" in cut or "\n " in text or " \n" in text or self.odd(text):
            merged = [cut[0]]
            for c in cut[1:]:
                last = merged[-1]
                if not c or c[0].isspace() or not last or last[-1].isspace():
                    merged[-1] = f"{last} {c}"
                else:
                    merged.append(c)
            cut = merged
        keys = [cut[0]] + [" " + c for c in cut[1:]]
        return [i for k in keys if k for i in known(k) or self.chunk(k)]

    def digests(self, text: str | None) -> tuple[int, str, str]:
        """n_tokens, sha256 of the decimal ids joined by commas, sha256 of the decoded ids."""
        ids, decimal = self.encode(text) if text else [], self.decimal
        listed = ",".join([decimal[i] for i in ids])
        return len(ids), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(self.bpe.decode(ids)).hexdigest()


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> TextCodec:
    """The worker's codec. Its caches hold no reference cycles, so the cycle collector, which
    would walk them again and again, is switched off in the worker."""
    gc.disable()
    return TextCodec(path, pattern)


def forget() -> None:
    if codec.cache_info().currsize:
        codec.cache_clear()
        gc.enable()


def encode_texts(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, decoded binary) of every row: the operator's real output. A task
    forgets its codec when it ends: Spark hands tasks to idle workers in turn, so that all the
    workers of the stages before would come to hold one."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(it):
        c = codec(path, pattern)
        try:
            for b in text_batches(it):
                ids = [c.encode(t) if t else [] for t in b.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32())), pa.array([c.bpe.decode(x) for x in ids], pa.binary())], [id_col, "ids", "decoded"])
        finally:
            forget()

    return map_arrow(docs.select(id_col, text_col), run, f"`{id_col}` {kind}, ids array<int>, decoded binary")


def encode_digests(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): digests taken where the ids are, so that
    neither ids nor decoded bytes leave the task."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(it):
        c = codec(path, pattern)
        for b in text_batches(it):
            n, ids, dec = zip(*map(c.digests, b.column(1).to_pylist()), strict=True)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids), pa.array(dec)], [id_col, "n_tokens", "ids_sha256", "decoded_sha256"])

    return map_arrow(docs.select(id_col, text_col), run, f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
