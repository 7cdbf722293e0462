"""BPE, token files and language ID against the public libraries and plain versions."""

import gc
import hashlib
import math
import random
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import sentencepiece
import tiktoken
from tokenizers import Tokenizer

import corpus_pipeline
from stratum.llm import bpe, langid, rans

PATH, WORDS, PIECES = P.path("byte_bpe_multi_50k.tiktoken"), P.path("word_bpe_49k.json"), P.path("piece_bpe_32k.model")
ODD = ["", " ", "  a", "a \n b", "\n \n", "tab\tx", "don't they're I'LL 'S", "\x1c\x1d a", "é ñ́ 中文字", "<|endoftext|> a", "x" * 3000, "ab" * 2000, "İΣς ß", "1²3 ½", "\x85\xa0 　z"]


def samples(seed, alphabet, n=200, size=60):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, size))) for _ in range(n)]


def test_tree_encoding_is_the_librarys():
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})
    c = bpe.TextCodec(PATH, P.PATTERN)
    for t in ODD + samples(1, "aaeinrst") + samples(2, "ab \n") + samples(3, "aé ñ'st  \t\n 1²3!中文"):
        ids = c.encode(t)
        assert ids == enc.encode_ordinary(t)
        assert c.bpe.decode(ids) == t.encode()


def test_join_of_any_two_halves():
    b = bpe.TreeBPE(bpe.load_ranks(PATH))
    for t in samples(4, "aeinrst é", 100, 40):
        whole = b.merge(t.encode()) if t else []
        for k in range(len(t.encode())):
            assert b.join(b.encode(t.encode()[:k]), b.encode(t.encode()[k:])) == whole


def test_bpe_rows(spark):
    df = spark.createDataFrame([(1, None, "a"), (1, None, "a"), (None, "x y", "b"), (2, "", "c")], "doc_id long, text string, n_tokens string")
    rows = bpe.encode_texts(df, PATH, P.PATTERN).collect()
    assert sorted((r.doc_id or 0, len(r.ids), bytes(r.decoded)) for r in rows) == [(0, 2, b"x y"), (1, 0, b""), (1, 0, b""), (2, 0, b"")]
    assert bpe.encode_digests(df.limit(0), PATH, P.PATTERN).count() == 0


def test_a_task_forgets_its_codec(spark, monkeypatch):
    """Ended or given up, it leaves no caches in the worker and the cycle collector on."""
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    monkeypatch.setattr(bpe, "map_arrow", lambda df, run, schema: run)
    run, batch = bpe.encode_texts(df, PATH, P.PATTERN), pa.RecordBatch.from_pydict({"doc_id": [1], "text": ["a b"]})
    assert [b.column(2).to_pylist() for b in run(iter([batch]))] == [[b"a b"]]
    assert not bpe.codec.cache_info().currsize and gc.isenabled()
    left = run(iter([batch, batch]))
    next(left)
    assert bpe.codec.cache_info().currsize and not gc.isenabled()
    left.close()
    assert not bpe.codec.cache_info().currsize and gc.isenabled()


def test_bpe_digests_come_from_the_ids(spark):
    """The registered query on whole documents, against the library."""
    from stratum.llm import queries

    sf = "/root/testdata/sf0.001"
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = queries.op4_byte_bpe(spark, sf).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = enc.encode_ordinary(docs[r.doc_id])
        sha = lambda x: hashlib.sha256(x).hexdigest()
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids)).encode()), sha(enc.decode_bytes(ids)))


def test_tokens_of_the_query_are_the_librarys(spark):
    from stratum.llm import queries

    sf = "/root/testdata/sf0.001"
    tok, at = Tokenizer.from_file(WORDS), 0
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.op3_token_ids(spark, sf).collect()}
    for i in sorted(docs):
        ids = [*tok.encode(docs[i], add_special_tokens=False).ids, 2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_word_encoder_is_the_librarys(monkeypatch):
    tok = Tokenizer.from_file(WORDS)
    monkeypatch.setattr(rans.WordEncoder, "CACHE", 64)  # forgets all the time
    e = rans.WordEncoder(WORDS)
    texts = ["a <|endoftext|> b", "x<|startoftext|>y\n<|ENDOFTEXT|> z", "<|endof text|>", *ODD] + samples(5, "aA é Ñß'sßtÏİΣς \t\n\x1c\x85\xa0<|endoftext|>12³ª×÷中文.,!$$")
    for t, got in zip(texts, e.encode(texts), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("n", [1, 2, 63, 64, 1000, 300_001])
def test_rans_round_trip_and_checkpoints(n):
    ids = (np.random.default_rng(n).zipf(1.3, n) % 1000).astype(np.uint32)
    t = rans.Table.from_counts(dict(zip(*(x.tolist() for x in np.unique(ids, return_counts=True)), strict=True)), 1000)
    block = rans.encode_block(ids, t)
    assert (rans.decode_block(block, t) == ids).all()
    _, _, lanes, _, marks, _, _ = rans.BLOCK_HEAD.unpack_from(block)
    for k in range(1, marks + 1):
        assert (rans.decode_block(block, t, k) == ids[k * rans.STEPS * lanes :]).all()
    with pytest.raises(ValueError):
        rans.decode_block(block[:-1] + bytes([block[-1] ^ 1]), t)


def test_token_files(spark):
    rows = [(5, "the cat sat"), (None, "x"), (2, None), (2, ""), (9, "dog " * 5000), (5, "the cat sat")]
    df = spark.createDataFrame([(*r, "y") for r in rows], "doc_id long, text string, start string")
    got = rans.read_tokens(spark, rans.write_tokens(df, WORDS)).orderBy("start").collect()
    tok, at = Tokenizer.from_file(WORDS), 0
    for r, (i, t) in zip(got, sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")), strict=True):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids) == (i, at, len(ids), ids)
        assert r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)
    assert rans.read_tokens(spark, rans.write_tokens(df.limit(0), WORDS)).count() == 0


def toy_model():
    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    counts = [(x, i, n + k) for x, text, n in (("de", "der und die nicht", 5), ("en", "the and of is not", 7)) for k, i in enumerate(sp.encode(text))]
    return langid.Model([*counts, ("de", -1, 10), ("en", -1, 12)], PIECES)


def test_forward_sums_all_segmentations():
    m = toy_model()

    def every(s, k):
        if not s:
            return 1.0
        total = 0.0
        for e in range(1, len(s) + 1):
            q = m.p.get(s[:e]) or (m.unknown if e == 1 else None)
            if q:
                total += q[k] * every(s[e:], k)
        return total

    ws = ["the", "and", "nicht", "中x", "q"]
    for w, row in zip(ws, m.batch(ws), strict=True):
        for k in range(2):
            assert math.isclose(row[k], math.log(every(langid.MARK + w, k)), rel_tol=1e-9)
            assert math.isclose(m.word(w)[k], row[k], rel_tol=1e-9)
    assert np.isfinite(m.batch(["é中" * 300, ""])).all()


def test_language_cases(spark, monkeypatch):
    monkeypatch.setattr(langid, "CACHE", 8)  # forgets all the time
    m = toy_model()
    df = spark.createDataFrame([(1, None, "z"), (2, "", "z"), (3, "12 !!", "z"), (4, "the and of " * 50, "z"), (None, "Der, und die", "z"), (4, "the", "z")], "doc_id long, text string, score string")
    got = sorted((r.doc_id or 0, r.lang_pred, r.score) for r in langid.predict(df, m).collect())
    assert [(i, x) for i, x, _ in got] == [(0, "de"), (1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en")]
    assert all(0 <= s <= 1 for _, _, s in got)
    empty = langid.learn(spark.createDataFrame([], "doc_id long, text string, lang string"), PIECES)
    assert {r.lang_pred for r in langid.predict(df, empty).collect()} == {"und"}
    assert langid.predict(df.limit(0), m).count() == 0


def test_pipeline_ends_with_token_ids(spark):
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})
    rows = [*enumerate(ODD), (None, "x y"), (900, None), (2, "the cat  sat\n on it")]
    got = corpus_pipeline.encode(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect()
    sha = lambda x: hashlib.sha256(x).hexdigest()
    want = []
    for i, t in rows:
        ids = enc.encode_ordinary(t or "")
        want.append((i, len(ids), sha(",".join(map(str, ids)).encode()), sha((t or "").encode()), ids))
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_letters_before_a_full_stop_need_no_pattern():
    e = rans.WordEncoder(WORDS)
    e.find = None
    texts = ["One two. \u00c9t\u00e9, caf\u00e9. na\u00efve \u00aa."]
    assert [np.frombuffer(x, "<u4").tolist() for x in e.encode(texts)] == [e.tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_runs_of_one_word_share_a_row():
    s = langid.Scorer(toy_model())
    s.predict(["Hund, (hund) hund."])
    assert s.at["hund,"] == s.at["(hund)"] == s.at["hund."] == s.at["hund"] and s.used == 2


def test_a_column_of_words_needs_no_pattern(monkeypatch):
    """Digits, signs and Latin-1 are split all at once; the ids of a slice of a column are the
    library's, whatever is remembered."""
    tok = Tokenizer.from_file(WORDS)
    texts = [None, "", " ", "\n\n", "A1b22 (x), 3.5%! \u00c9T\u00c9\u00d72 \u00f7\u00ff\u00dfx --", "a <|endoftext|> b", "last", None, "last \u4e2d\u6587 J\u030c", *samples(7, "aB1.,(\u00c9\u00d7 \n")]
    for cache in (rans.WordEncoder.CACHE, 5):
        monkeypatch.setattr(rans.WordEncoder, "CACHE", cache)
        e = rans.WordEncoder(WORDS)
        e.find = None
        for _ in range(2):
            ids, size = e.encode_column(pa.array(["skipped", *texts]).slice(1))
            own = [x.tolist() for x in np.split(ids, np.cumsum(size)[:-1])]
            assert own == [tok.encode(t or "", add_special_tokens=False).ids for t in texts]
    ids, size = e.encode_column(pa.array([], pa.string()))
    assert not len(ids) and not len(size)
