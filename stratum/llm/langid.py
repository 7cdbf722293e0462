"""Language ID by segmentation-marginalised unigrams over a fixed public piece vocabulary.

Each language has a probability per piece. A word's likelihood is the sum over all its
segmentations into pieces, by the forward algorithm; a text's is the product over its words
(words as lower-case runs between white space, outer punctuation stripped, preceded by the
vocabulary's word mark) times the language's prior. The score is the posterior of the
predicted language.

Learning counts the pieces of the library's segmentation, pre-aggregated per task. It is fitted
on a bounded sample of the learnable rows: about ``per_lang`` documents of each language,
chosen by a hash of the id; every document is scored, whole.

Defined cases: null text and text without a letter give ``und`` with score 0, as does
everything if no row can be learned from; rows with equal ids are scored alike; equal scores
go to the first language in order; extra columns are ignored. Memory is bounded by the model
(vocabulary x languages), the word cache (``CACHE``) and the longest text.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, text_batches

MARK = "▁"
PUNCT = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())
CACHE = 600_000
SMOOTHING = 0.1
TINY, BIG = 1e-150, 1e150
SHORT = 30  # characters below which no word's sums can underflow
WIDE, UNKNOWN = 64, ({}, 0)  # more than the length of a short word's pieces; a character of no piece


def words(text: str) -> list[str]:
    return [w.strip(PUNCT) for w in runs(text)]


def runs(text: str) -> list[str]:
    """Lower-case runs between white space, with their punctuation."""
    return text.lower().split()


def count_pieces(rows: DataFrame, vocab: str, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(lang, piece id, n) over the rows; the piece -1 counts documents."""

    def run(it):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=vocab)
        docs, seen = Counter(), defaultdict(Counter)
        for b in text_batches(it):
            for text, lang in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                docs[lang] += 1
                seen[lang].update(words(text))
        for lang, counts in seen.items():
            total = Counter({-1: docs[lang]})
            for w, n in counts.items():
                if w:
                    for i in sp.encode(w):
                        total[i] += n
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(total)), pa.array(list(total), pa.int32()), pa.array(list(total.values()), pa.int64())], ["lang", "piece", "n"])

    return map_arrow(rows.select(text_col, lang_col), run, "lang string, piece int, n long").groupBy("lang", "piece").agg(F.sum("n").alias("n"))


class Model:
    """Piece probabilities of each language."""

    def __init__(self, counts: list[tuple[str, int, int]], vocab: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=vocab)
        size = sp.get_piece_size()
        self.langs = sorted({lang for lang, _, _ in counts})
        at = {lang: i for i, lang in enumerate(self.langs)}
        n = np.full((size, len(at)), SMOOTHING)
        docs = np.ones(len(at))
        for lang, piece, c in counts:
            if piece < 0:
                docs[at[lang]] = c
            else:
                n[piece, at[lang]] += c
        p = n / n.sum(axis=0) if at else n
        self.prior = np.log(docs / docs.sum()) if at else docs
        pieces = [(sp.id_to_piece(i), i) for i in range(size) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))]
        # pieces of one word only: the mark stands at the start or not at all
        self.p = {s: tuple(p[i].tolist()) for s, i in pieces if MARK not in s[1:]}
        self.longest = max(map(len, self.p), default=1)
        self.unknown = tuple((p.min(axis=0) / 16).tolist()) if at else ()
        # the same pieces as a trie of (children, row in the table) by character
        self.table = np.array([self.unknown, *self.p.values()], dtype=np.float64)
        self.trie: dict = {}
        for row, piece in enumerate(self.p, 1):
            node = self.trie
            for c in piece[:-1]:
                node = node.setdefault(c, [{}, 0])[0]
            node.setdefault(piece[-1], [{}, 0])[1] = row

    def batch(self, ws: list[str]) -> np.ndarray:
        """Log-likelihoods of many words at once: one row a word. Short words go forward
        together, by end position and piece length; long ones one by one, with scaling."""
        out = np.empty((len(ws), len(self.langs)))
        short = [i for i, w in enumerate(ws) if len(w) < SHORT]
        for i, w in enumerate(ws):
            if len(w) >= SHORT:
                out[i] = self.word(w)
        steps: defaultdict[int, list[int]] = defaultdict(list)  # by end * WIDE + piece length
        base, ends, trie = 0, [], self.trie
        for i in short:
            s = MARK + ws[i]
            for a, c in enumerate(s, 1):
                src, key = (base + a - 1) << 20, a * WIDE + 1
                node, row = trie.get(c, UNKNOWN)
                steps[key].append(src | row)  # row 0: an unknown character
                if not node:
                    continue
                for c in s[a:]:
                    got = node.get(c)
                    if got is None:
                        break
                    node, row = got
                    key += WIDE + 1
                    if row:
                        steps[key].append(src | row)
            ends.append(base + len(s))
            base += len(s) + 1
        alpha = np.zeros((base, len(self.langs)))
        if short:
            ends = np.array(ends)
            alpha[np.concatenate(([0], ends[:-1] + 1))] = 1.0
            for key in sorted(steps):
                x, d = np.array(steps[key]), key % WIDE
                src = x >> 20
                alpha[src + d] += alpha[src] * self.table[x & 0xFFFFF]
            out[short] = np.log(alpha[ends])
        return out

    def word(self, w: str) -> list[float]:
        """Log-likelihood in each language: forward sums over all segmentations."""
        s = MARK + w
        n, k, get, longest, unknown = len(s), len(self.langs), self.p.get, self.longest, self.unknown
        alpha, shift = [[1.0] * k], 0
        for e in range(1, n + 1):
            own = [0.0] * k
            for a in range(max(0, e - longest), e):
                q = get(s[a:e])
                if q is None:
                    if e - a > 1:
                        continue
                    q = unknown
                own = [x + y * z for x, y, z in zip(own, alpha[a], q, strict=True)]
            alpha.append(own)
            if max(own) < TINY:  # scale the sums that are still needed
                shift += 1
                for a in range(max(0, e + 1 - longest), e + 1):
                    alpha[a] = [x * BIG for x in alpha[a]]
        least = math.log(5e-324)
        return [(math.log(x) if x > 0 else least) - shift * math.log(BIG) for x in alpha[n]]


class Scorer:
    """Texts to (language, posterior), remembering the words it has scored (bounded): runs are
    looked up as they stand in the text, and those of one word share a row."""

    def __init__(self, model: Model):
        self.model, self.at, self.used = model, {"": 0}, 1
        self.rows = np.zeros((1024, len(model.langs)))

    def learn(self, ws: list[str]) -> None:
        """Score new words and remember them."""
        if len(self.at) + 2 * len(ws) > CACHE:
            self.at, self.used = {"": 0}, 1
        bare = {w: w.strip(PUNCT) for w in ws}
        new, first = list(set(bare.values()).difference(self.at)), self.used
        self.used += len(new)
        while self.used > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        self.rows[first : self.used] = self.model.batch(new)
        self.at.update(zip(new, range(first, self.used), strict=True))
        self.at.update(zip(bare, map(self.at.__getitem__, bare.values()), strict=True))

    def log_likelihoods(self, texts: list[str]) -> np.ndarray:
        """One row a text, its prior included."""
        total = np.tile(self.model.prior, (len(texts), 1))
        cut = map(runs, texts)
        part = CACHE // 4  # runs at a time, so that none of them is forgotten meanwhile
        group: list[tuple[int, list[str]]] = []
        size = 0
        for i, ws in enumerate(cut):
            for a in range(0, len(ws), part):
                own = ws[a : a + part]
                if size + len(own) > part:
                    self._add(group, total)
                    group, size = [], 0
                group.append((i, own))
                size += len(own)
        self._add(group, total)
        return total

    def _add(self, group: list[tuple[int, list[str]]], total: np.ndarray) -> None:
        known = self.at
        new = set()
        for _, ws in group:
            new.update(ws)
        new = list(new.difference(known))
        if new:
            self.learn(new)
            if self.at is not known:  # all was forgotten
                self.learn(list({w for _, ws in group for w in ws if w not in self.at}))
        row = self.at.__getitem__
        for i, ws in group:
            total[i] += self.rows[list(map(row, ws))].sum(axis=0)

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out = [("und", 0.0)] * len(texts)
        some = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))] if self.model.langs else []
        for i, x in zip(some, self.log_likelihoods([texts[i] for i in some]), strict=True):
            best = int(x.argmax())
            out[i] = self.model.langs[best], float(1 / np.exp(x - x[best]).sum())
        return out


_scorers: dict[object, Scorer] = {}


def learn(rows: DataFrame, vocab: str, per_lang: int = 5000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on about ``per_lang`` of the rows of each language (all, if fewer)."""
    rows = rows.select(id_col, text_col, lang_col).filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    share = [(r[lang_col], min(1.0, per_lang / r["count"])) for r in rows.groupBy(lang_col).count().collect()]
    picked = F.lit(False)
    for lang, part in share:
        picked = picked | ((F.col(lang_col) == lang) & (F.pmod(F.xxhash64(id_col), F.lit(1 << 20)) < int(part * (1 << 20))))
    counts = count_pieces(rows.filter(picked), vocab, text_col, lang_col).collect()
    return Model([(r["lang"], r["piece"], r["n"]) for r in counts], vocab)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) of every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    key, kind = uuid.uuid4().hex, docs.schema[id_col].dataType.simpleString()

    def run(it):
        if key not in _scorers:
            _scorers.clear()
            _scorers[key] = Scorer(held.value)
        scorer = _scorers[key]
        for b in text_batches(it):
            lang, score = zip(*scorer.predict(b.column(1).to_pylist()), strict=True)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], [id_col, "lang_pred", "score"])

    return map_arrow(docs.select(id_col, text_col), run, f"`{id_col}` {kind}, lang_pred string, score double")
