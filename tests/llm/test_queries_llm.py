"""The other operators' cases, the queries against DuckDB and the pipeline."""

import hashlib
import os
import random
import sys

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), "tools"))

import corpus_pipeline  # noqa: E402
from check_oracle import duck, rows_of  # noqa: E402

from stratum.llm import ann, decontaminate, licenses, quality, queries, warc  # noqa: E402
from stratum.llm.common import scratch as shared  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("key", sorted(queries.ORACLE))
def test_query_matches_sql(spark, key):
    df = queries.QUERIES[key](spark, SF)
    res = duck(SF).execute(queries.ORACLE[key])
    cols = [d[0] for d in res.description]
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(cols, res.fetchall())


def test_decontamination_matches_brute_force(spark, monkeypatch):
    rng = random.Random(2)
    text = lambda n: " ".join(rng.choice("a b c d E f,g".split()) for _ in range(n))
    items = [(i, text(rng.choice([1, 3, 12, 13, 14, 30]))) for i in range(12)] + [(None, "zz zz"), (3, None), (4, "!!"), (5, text(20))]
    docs = [(i, text(rng.randint(0, 60)) + " " + (rng.choice(items)[1] or "") + " " + text(20)) for i in range(40)] + [(1, None), (None, ""), (2, "zz zz zz")]
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, hits int")
    b = spark.createDataFrame(items, "item_id long, text string")
    want = brute.contamination(docs, items)
    assert sorted(map(tuple, decontaminate.report(d, b).collect()), key=str) == want
    kept = decontaminate.drop_contaminated(d, b)
    assert kept.columns == d.columns and kept.count() == sum(not r[-1] for r in want)
    cleaned = decontaminate.remove_spans(d, b)
    texts = {(r.doc_id, r.hits): r.text for r in cleaned.collect()}
    assert cleaned.columns == d.columns and len(texts) <= kept.count()
    again = {r.doc_id: r for r in decontaminate.report(cleaned, b).collect()}
    hit = [r for r in want if r[2] and not r[-1]]
    assert all(again[i].n_words == n - h for i, n, h, *_ in hit) and all(again[i].n_words == n for i, n, h, *_ in want if not h and i in again and i not in (None, 2))
    many = b.union(spark.createDataFrame([(1000 + i, items[3][1]) for i in range(500)], "item_id long, text string"))
    assert decontaminate.report(d, many).filter("n_hit > 0").count() == sum(r[2] > 0 for r in want)
    monkeypatch.setattr(decontaminate, "SHARD_BYTES", 100)  # several shards
    assert sorted(map(tuple, decontaminate.report(d, b).collect()), key=str) == want
    assert decontaminate.report(d, b.limit(0)).filter("n_hit > 0").count() == 0
    assert decontaminate.report(d.limit(0), b).count() == 0


def test_license_cases(spark):
    rows = [(1, None), (2, ""), (3, "Released under the MIT License. under the MIT license"), (4, "CC BY-NC 4.0 and the Apache License, Version 2.0"), (4, "under the the mit license"), (5, "GNU General Public License, version 3"), (None, "cc by nc cc by nc")]
    got = licenses.scan(spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, words int")).collect()
    by = {(r.doc_id, r.n_words): r for r in got}
    assert len(got) == len(rows) and by[1, 0].labels == "" and by[1, 0].first_word is None and by[2, 0].score == 0.0
    assert (by[3, 9].n_base, by[3, 9].first_word, by[3, 9].last_word, by[3, 9].base_labels) == (2, 1, 5, "mit")
    assert (by[4, 12].n_base, by[4, 12].labels) == (2, "apache-2,cc-by-nc") or by[4, 11].labels == "apache-2,cc-by-nc"
    assert by[4, 5].n_base == 0 and by[None, 6].n_base == 2 and by[None, 6].last_word == 3
    assert next(r for r in got if r.doc_id == 5).labels == "gpl-3" and next(r for r in got if r.doc_id == 5).base_labels == ""
    assert licenses.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_license_scan_runs_no_python(spark):
    plan = licenses.scan(spark.read.parquet(f"{SF}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_quality_cases(spark):
    rng = random.Random(1)
    docs = [(i, " ".join(rng.choice(["good", "fine", "plain"]) + str(rng.randint(0, 99)) for _ in range(40))) for i in range(60)]
    docs += [(100 + i, "$$$ !!! " * rng.randint(5, 40)) for i in range(60)] + [(None, "x"), (500, None), (501, ""), (1, "a")]
    labels = [(i, int(i < 100)) for i, _ in docs[:120]] + [(0, 1), (7, None), (8, 5), (999, 1)]
    d, y = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int")
    stats = quality.with_features(d)
    m = quality.learn(stats, y)
    got = quality.score(stats, m).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 for r in got)
    assert all((r.score >= 0.7) == (r.doc_id < 100) for r in got if r.doc_id is not None and r.doc_id not in (1, 500, 501))
    mean, inverse, logdet = m.classes[1]
    cov = np.linalg.inv(inverse.T @ inverse)  # the density against numpy's own
    x = np.array([r.x for r in stats.limit(3).collect()])
    want = [-0.5 * (v - mean) @ np.linalg.solve(cov, v - mean) for v in x]
    assert np.allclose([-0.5 * ((inverse @ (v - mean)) ** 2).sum() for v in x], want)
    assert set(quality.score(stats, quality.learn(stats, y.limit(0))).toPandas().score) == {0.5}
    assert quality.keep_good(d.limit(0), m).count() == 0 and quality.with_features(d.limit(0)).count() == 0


def test_quality_on_held_out_rows(spark):
    got = queries.op1_quality(spark, "/root/testdata/sf0.01").filter("held_out").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    assert got.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0] > 0.95


def test_language_on_held_out_rows(spark):
    got = queries.op6_language_id(spark, "/root/testdata/sf0.01").filter("held_out").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), "doc_id")
    assert got.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0] > 0.98


def test_nearest_match_brute_force(spark):
    rng = np.random.default_rng(0)
    vecs = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(rng.normal(size=(300, 16)))]
    vecs += [(300 + i, vecs[i][1]) for i in range(20)]  # ties
    odd = [(400, None), (401, []), (402, [0.0] * 16), (403, [1.0] * 15 + [float("nan")]), (404, [None] * 16), (None, [1.0] * 16), (405, [1.0, 2.0])]
    df = spark.createDataFrame([(*r, 3) for r in vecs + odd], "vec_id long, embedding array<float>, score int")
    got = {}
    for r in ann.nearest(df, df.filter("vec_id % 50 = 0")).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    ids, m = np.array([i for i, _ in vecs]), np.array([v for _, v in vecs], dtype=float)
    norm = np.sqrt((m * m).sum(axis=1))
    assert sorted(got) == [i for i in ids.tolist() if i % 50 == 0]
    for k in np.flatnonzero(ids % 50 == 0):
        s = (m * m[k]).sum(axis=1) / (norm * norm[k])
        s[k] = -9
        order = np.lexsort((ids, -np.round(s, 12)))[:5]
        own = sorted(got[int(ids[k])])
        assert [x[1] for x in own] == ids[order].tolist() and np.allclose([x[2] for x in own], s[order], atol=1e-12)
    # copies of a query each get the whole list; rows of one id and other vectors are queries of their own
    own = df.filter("vec_id = 0")
    once = [tuple(r) for r in ann.nearest(df, own).collect()]
    assert len(once) == 5
    assert sorted(map(tuple, ann.nearest(df, own.union(own).union(own)).collect())) == sorted(once * 3)
    other = df.filter("vec_id = 50").withColumn("vec_id", F.lit(0).cast("long"))
    assert ann.nearest(df, own.union(other)).count() == 10
    assert ann.nearest(df.limit(0), df.limit(0)).count() == 0
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert [(r["rank"], r.vec_id, r.score) for r in ann.nearest(few, few.filter("vec_id = 0")).collect()] == [(1, 1, 0.0)]


def test_nearest_in_a_grid_without_broadcast(spark, scratch, monkeypatch):
    monkeypatch.setattr(ann, "SHARE", 2)  # 8 lanes: 2 columns of 4
    monkeypatch.setattr(ann, "BLOCK", 100)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 3)
    m = np.random.default_rng(3).normal(size=(200, 8))
    ids = np.arange(200) % 100  # the second block has the first one's ids and other vectors
    spark.createDataFrame([(int(i), v) for i, v in zip(ids, m.tolist(), strict=True)], "vec_id long, embedding array<double>").coalesce(1).write.parquet(f"{scratch}/v")
    df = spark.read.parquet(f"{scratch}/v")
    found = ann.nearest(df, df.filter("vec_id % 10 = 0"))
    got = sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in found.collect())
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan  # copies of blocks never go to the driver
    unit = m / np.sqrt((m * m).sum(axis=1))[:, None]
    want = []
    for q in np.flatnonzero(ids % 10 == 0):
        s = np.where(ids == ids[q], -9, unit @ unit[q])
        want += [(int(ids[q]), i, int(ids[j]), round(float(s[j]), 9)) for i, j in enumerate(np.lexsort((ids, -s))[:5], 1)]
    assert got == sorted(want)


def test_int8_bounds_hold():
    rng = np.random.default_rng(1)
    a, b = (ann._Side(24, 200, np.arange(200).tobytes(), rng.normal(size=(200, 24)).tobytes()) for _ in range(2))
    near = (a.factor @ b.factor.T).astype(float) * a.scale[:, None] * b.scale
    true = (a.raw / a.norm[:, None]) @ (b.raw / b.norm[:, None]).T
    assert (np.abs(near - true) <= a.err[:, None] + (1 + a.err)[:, None] * b.err).all()


def test_warc_cases(spark):
    same = "é" * 700
    rows = [(1, "u\r\n: x", None), (2, None, same), (3, "x", same), (None, "y", same), (3, "x", same), (5, "q", ""), (6, "http://z", "\r\n\r\nWARC/1.1\r\n" * 200)]
    pages = spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, n int")
    got = warc.archive(pages).collect()
    assert sorted(((r.page_id or 0), r.payload_bytes, r.record_type, r.refers_to) for r in got if r.page_id != 6) == [(0, 1400, "revisit", 3), (1, 0, "response", None), (2, 1400, "revisit", 3), (3, 1400, "response", None), (3, 1400, "response", None), (5, 0, "response", None)]
    assert all(r.payload_digest == hashlib.sha1((dict((i, h) for i, _, h in rows)[r.page_id] or "").encode()).hexdigest() for r in got)
    assert warc.archive(pages.limit(0)).count() == 0
    for compression in ("gzip", "none"):
        root = shared(spark, "w")
        warc.write(warc.with_revisits(pages), root, compression)
        r = warc.read(spark, root)
        own = r.filter("record_type = 'response' AND target_uri LIKE 'http%'")
        assert [bytes(x.payload).decode() for x in own.collect()] == [rows[-1][2]]
        # the reader takes the predicates: none but the tests for NULL is left in the plan
        plan = own._jdf.queryExecution().executedPlan().toString()
        left = plan[plan.index("Filter (") : plan.index("BatchScan")]
        assert "response" not in left and "StartsWith" not in left and "isnotnull" in left
        assert warc.read(spark, root, "none").filter("payload IS NOT NULL").count() == 0 and r.filter("record_id = 'urn:page:2'").count() == 1


def test_warc_headers_of_others(spark, scratch):
    """Folded lines, repeated headers and bytes that are not UTF-8."""
    head = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:a>\r\nWARC-Target-URI: http://x/\xff\r\nX-Note: one\r\n\ttwo\r\nX-Note: again\r\nContent-Length: 3\r\n\r\n"
    with open(f"{scratch}/a.warc", "wb") as f:
        f.write(head + b"abc\r\n\r\n" + head.replace(b"urn:a", b"urn:b") + b"def\r\n\r\n")
    got = warc.read(spark, f"file://{scratch}").orderBy("record_id").collect()
    assert [(r.record_id, r.target_uri, r.headers["x-note"], bytes(r.payload)) for r in got] == [("urn:a", "http://x/\ufffd", "one two", b"abc"), ("urn:b", "http://x/\ufffd", "one two", b"def")]


def test_damaged_archive_raises(spark, scratch):
    record = warc.record({"record_type": "response", "record_id": "a", "target_uri": "u", "payload": b"abc", "payload_bytes": 3, "payload_digest": hashlib.sha1(b"abc").hexdigest(), "refers_to": None})
    with open(os.path.join(scratch, "a.warc"), "wb") as f:
        f.write(record.replace(b"abc", b"abd"))
    with pytest.raises(Exception, match="differs from its digest"):
        warc.read(spark, f"file://{scratch}").collect()


def test_pipeline(spark):
    assert [k for k, _ in corpus_pipeline.STAGES] and len(corpus_pipeline.STAGES) == 5 and corpus_pipeline.ORACLE_SQL is None
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    root, n, frames = shared(spark, "p"), docs.count(), []
    held = len(spark.sparkContext._jsc.getPersistentRDDs())
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if i < 4:
            assert out.columns == docs.columns
        out.write.parquet(f"{root}/{i}")
        frames.append(docs)
        docs = spark.read.parquet(f"{root}/{i}")
        assert docs.count() <= n
        n = docs.count()
    # each stage against the plain version, on its own input
    rows = [(r.doc_id, r.text) for r in frames[1].collect()]
    assert frames[2].count() == len(brute.near_classes(rows))
    gone = {i: (size - cut) for i, size, cut, _, _ in brute.repeats([(r.doc_id, r.text) for r in frames[2].collect()], corpus_pipeline.PASSAGE)}
    assert all(len(r.text.encode()) <= gone[r.doc_id] <= len(r.text.encode()) + 8 for r in frames[3].collect())
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    own = brute.contamination([(r.doc_id, r.text) for r in frames[3].collect()], items)
    assert {r.doc_id for r in frames[4].collect()} == {x[0] for x in own if not x[-1]}
    assert {r.doc_id for r in docs.collect()} == {r.doc_id for r in frames[4].collect()}
    # no benchmark window is left, and only hit words went
    hits = {x[0]: x[2] for x in own}
    before = {r.doc_id: r.text for r in frames[3].collect()}
    for r in frames[4].collect():
        assert len(brute.words(r.text)) == len(brute.words(before[r.doc_id])) - hits[r.doc_id] and r.n_chars == len(r.text)
        assert hits[r.doc_id] or r.text == before[r.doc_id]
    # run() is these stages, and keeps nothing on executors
    assert sorted(map(str, corpus_pipeline.run(spark, SF).collect())) == sorted(map(str, docs.collect()))
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) == held


def test_passages_of_fifty_words_go(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(3, 8)))
    passages = [" ".join(word() for _ in range(55)) for _ in range(6)]
    rows = [(i, " ".join(word() for _ in range(120)) + " " + passages[i % 6] + " " + " ".join(word() for _ in range(120)), "en", "s", 0) for i in range(18)]
    rows += [(100 + i, " ".join(word() for _ in range(300)), "en", "s", 0) for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    held = len(spark.sparkContext._jsc.getPersistentRDDs())
    kept = {r.doc_id: r.text for r in corpus_pipeline.unrepeated(spark, docs, SF).collect()}
    assert all(p not in t for p in passages for t in kept.values())
    assert all(kept[i] == t for i, t, *_ in rows if i >= 100)
    assert all(kept[i] and len(kept[i].split()) >= 235 for i, *_ in rows)
    assert len(spark.sparkContext._jsc.getPersistentRDDs()) == held


def test_one_id_may_hold_most_rows(spark, monkeypatch):
    """Rows of one id are spread over blocks and files."""
    from stratum.llm import rans, suffixes
    import public_tokenizers as P

    rng = random.Random(3)
    noise = lambda n: "".join(rng.choice("abcde fgh") for _ in range(n))
    shared = noise(500)
    rows = [(None if i % 3 else 7, noise(300) + (shared if i % 2 else "") + noise(100)) for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(suffixes, "BLOCK_BYTES", 5000)
    out, packed = suffixes.remove_repeats(df)
    blocks = {r._block: r.n for r in packed.groupBy("_block").count().withColumnRenamed("count", "n").collect()}
    assert sorted(map(tuple, out.collect()), key=str) == brute.repeats(rows) and len(blocks) > 3 and max(blocks.values()) < 30
    packed.unpersist()
    monkeypatch.setattr(rans, "PART_BYTES", 5000)
    manifest = rans.write_tokens(df, P.path("word_bpe_49k.json"))
    assert len(manifest["files"]) > 3 and rans.read_tokens(spark, manifest).count() == 60


