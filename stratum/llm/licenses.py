"""License scan with a positional rare-token index; DataFrame functions only.

A template is a license notice with a mandatory key phrase. Its postings say at which offset
each word stands. Of each template's key phrase the two words with the highest IDF over the
documents are its rare tokens: the positions of a file's rare tokens, less their offsets,
are intersected, and at the starts that both agree on the key phrase is verified word by
word. Exact: a key phrase can't stand where its rare tokens don't. The score is the largest
share of a found template's words that stand at their relative positions.

Per row only: no shuffle but that of the IDF counts, which are pre-aggregated and at most one
row for each phrase word. Memory is bounded by the longest text.

Defined cases: null and wordless texts have no words, no label and score 0; repeated rows are
scanned alike; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: FIXED VALUES: a word, as a class of separators, and the base phrases with their labels.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BASE = {
    "mit": "under the mit license",
    "apache-2": "apache license version 2",
    "cc-by-nc": "cc by nc",
}
#: FIXED VALUES: (label, notice, key phrase in it).
TEMPLATES = [
    ("mit", "released under the mit license", "under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge"),
    ("apache-2", "licensed under the apache license version 2 0", "apache license version 2"),
    ("gpl-2", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    ("gpl-3", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("lgpl", "under the terms of the gnu lesser general public license", "gnu lesser general public license"),
    ("agpl", "under the terms of the gnu affero general public license", "gnu affero general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution and use in source and binary forms"),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2"),
    ("cc-by", "licensed under cc by 4 0", "cc by 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
]
UPPER, LOWER = string.ascii_uppercase, string.ascii_lowercase


def lowered(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def words_of(low: Column) -> Column:
    return F.array_remove(F.split(low, SEPARATORS), "")


def idf_order(docs: DataFrame, text_col: str = "text") -> dict[str, int]:
    """Document frequency of every word of a phrase: the rarer, the higher its IDF."""
    vocab = sorted({w for p in [*BASE.values(), *(key for _, _, key in TEMPLATES)] for w in p.split()})
    own = F.array_distinct(F.filter(words_of(lowered(F.col(text_col))), lambda w: w.isin(vocab)))
    counts = docs.select(F.explode(own).alias("word")).groupBy("word").count().collect()
    return dict.fromkeys(vocab, 0) | {r["word"]: r["count"] for r in counts}


def _array(phrase: list[str]) -> str:
    return "array(" + ", ".join(f"'{w}'" for w in phrase) + ")"


def _rare(phrase: str, df: dict[str, int]) -> list[str]:
    """The phrase's two words of highest IDF."""
    return sorted(set(phrase.split()), key=lambda w: (df.get(w, 0), w))[:2]


def _places(phrase: str, rare: list[str], index: dict[str, str]) -> str:
    """Starts of a phrase: its rare words' positions, less their offsets, intersected and
    verified word by word."""
    words = phrase.split()
    starts = [f"transform({index[w]}, p -> p - {words.index(w)})" for w in rare]
    agreed = starts[0] if len(starts) == 1 else f"array_intersect({starts[0]}, {starts[1]})"
    verified = f"filter({agreed}, s -> s >= 0 AND slice(words, s + 1, {len(words)}) = {_array(words)})"
    return f"coalesce({verified}, cast(array() AS array<int>))"


def _share(notice: list[str], off: int, at: str) -> str:
    """Largest share of the notice's words that stand at their places around a key phrase."""
    there = " + ".join(f"int(coalesce(get(words, s + ({i - off})) = '{w}', false))" for i, w in enumerate(notice))
    return f"array_max(transform({at}, s -> ({there}) / {len(notice)}.0D))"


def _labels(pairs) -> str:
    own = ", ".join(f"CASE WHEN size({c}) > 0 THEN '{x}' END" for x, c in pairs)
    return f"array_join(array_sort(array_distinct(array_compact(array({own})))), ',')"


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: words, base places, labels and score."""
    df = idf_order(docs, text_col)
    phrases = list(dict.fromkeys([*BASE.values(), *(key for _, _, key in TEMPLATES)]))
    rare = {p: _rare(p, df) for p in phrases}
    tokens = sorted({w for ws in rare.values() for w in ws})
    index = {w: f"ix_{i}" for i, w in enumerate(tokens)}
    at = {p: f"at_{i}" for i, p in enumerate(phrases)}
    maybe = " OR ".join(f"contains(low, '{w}')" for w in sorted({ws[0] for ws in rare.values()}))
    d = docs.select(F.col(id_col).alias("id"), lowered(F.col(text_col)).alias("low"))
    d = d.select("id", words_of(F.col("low")).alias("words"), F.expr(maybe).alias("maybe"))
    # most files have no rare token: their words go no further
    d = d.selectExpr("id", "cast(size(words) AS long) AS n_words", "CASE WHEN maybe THEN words END AS words")
    # the file's postings: positions of its rare tokens
    own = f"filter(arrays_zip(words, sequence(0, size(words) - 1)), x -> x.words IN ({', '.join(repr(w) for w in tokens)}))"
    d = d.selectExpr("id", "n_words", "words", f"CASE WHEN size(words) > 0 THEN {own} END AS own")
    d = d.selectExpr("id", "n_words", "words", *[f"transform(filter(own, x -> x.words = '{w}'), x -> x.`1`) AS {c}" for w, c in index.items()])
    d = d.selectExpr("id", "n_words", "words", *[f"{_places(p, rare[p], index)} AS {c}" for p, c in at.items()])
    base = [(label, at[p]) for label, p in BASE.items()]
    found = "flatten(array(" + ", ".join(c for _, c in base) + "))"
    scores = []
    for _, notice, key in TEMPLATES:
        n, k = notice.split(), key.split()
        scores.append(_share(n, next(i for i in range(len(n)) if n[i : i + len(k)] == k), at[key]))
    return d.selectExpr(
        f"id AS `{id_col}`", "n_words", f"cast(size({found}) AS long) AS n_base",
        f"cast(array_min({found}) AS long) AS first_word", f"cast(array_max({found}) AS long) AS last_word",
        f"{_labels(base)} AS base_labels", f"{_labels([*base, *((x, at[key]) for x, _, key in TEMPLATES)])} AS labels",
        f"coalesce(greatest({', '.join(scores)}), 0.0D) AS score",
    )
