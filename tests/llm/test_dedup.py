"""Near-duplicates and repeated strings against brute force."""

import random
import tracemalloc

import brute
import numpy as np
import pyarrow as pa
import pytest

from stratum.llm import bagminhash, suffixes


def test_cover_is_a_difference_cover():
    assert {(a - b) % suffixes.PERIOD for a in suffixes.COVER for b in suffixes.COVER} == set(range(suffixes.PERIOD))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    noise = lambda n: "".join(rng.choice("abcdé ñ\n") for _ in range(n))
    shared = [noise(rng.choice([300, 399, 400, 401, 450, 700, 1500])) for _ in range(10)]
    rows = [(None, None), (0, ""), (1, "ab" * 900), (2, "ab" * 300 + noise(50) + "ab" * 230), (3, "x" * 1000), (4, "x" * 400), (5, "x" * 399)]
    for i in range(6, 60):
        t = noise(rng.randint(0, 300))
        for _ in range(rng.randint(0, 4)):
            t += rng.choice(shared)[rng.choice([0, 0, 17, 60]) :] + noise(rng.randint(0, 200))
        rows.append((i, t))
    return rows + [(100, rows[20][1]), (101, rows[20][1]), (21, rows[20][1]), (102, "line of text number one\n" * 60), (None, rows[30][1])]


def test_repeated_strings_match_brute_force(spark, texts, monkeypatch):
    monkeypatch.setattr(suffixes, "BLOCK_BYTES", 20_000)  # several blocks
    df = spark.createDataFrame([(i, t, "x") for i, t in texts], "doc_id long, text string, n_bytes string")
    out, packed = suffixes.remove_repeats(df)
    assert sorted(map(tuple, out.collect()), key=str) == brute.repeats(texts)
    packed.unpersist()
    kept, packed = suffixes.remove_repeats(df.withColumnRenamed("n_bytes", "_block"), keep_rest=True)
    want = {(i, n - gone) for i, n, gone, _, _ in brute.repeats(texts)}
    got = kept.collect()
    assert kept.columns == ["doc_id", "text", "_block"] and len(got) == len(texts)
    assert all(any(i == r.doc_id and len((r.text or "").encode()) <= n for i, n in want) for r in got)
    packed.unpersist()


@pytest.mark.parametrize("n", [0, 1, 4095, 4096, suffixes.PART, suffixes.PART + 1, 20 * suffixes.PART + 7])
def test_prefix_sums_hold_little_besides_themselves(n):
    raw = np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8)
    suffixes.Prefixes(raw)  # the tables of powers stay
    tracemalloc.start()
    sums = suffixes.Prefixes(raw).sums
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    power = np.concatenate(([np.uint64(1)], np.cumprod(np.full(n, suffixes._BASE[0], np.uint64))))[:n]
    assert (sums == np.concatenate(([np.uint64(0)], np.cumsum(suffixes._BYTES[0][raw] * power)))).all()
    assert peak < 8 * n + 6 * 8 * suffixes.PART


def test_repeats_of_an_empty_table(spark):
    out, _ = suffixes.remove_repeats(spark.createDataFrame([], "doc_id long, text string"))
    assert out.count() == 0 and out.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]


def test_repeats_of_short_texts(spark):
    rows = [(i, "short") for i in range(5)] + [(None, None)]
    out, packed = suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, out.collect()), key=str) == brute.repeats(rows)
    packed.unpersist()


def test_shingle_multisets():
    texts = ["", "a", "A b", "!!", "a b c d", "a b c d e", "a b c d e f a b c d e f a b c d e", "É é, x\x00y z0 9", "w " * 400]
    row, _, count = bagminhash.shingles(pa.array(texts))
    for i, t in enumerate(texts):
        assert sorted(count[row == i]) == sorted(brute.shingles(t).values())


def test_signatures_are_unbiased():
    rng = random.Random(3)
    error = []
    for _ in range(60):
        own = [rng.getrandbits(63) for _ in range(60)]
        a = {u: rng.choice([1, 1, 2, 5, 9, 33]) for u in own[:50]}
        b = {u: rng.choice([a.get(u, 1), a.get(u, 2), 7]) for u in own[5:]}
        true = sum(min(a.get(u, 0), b.get(u, 0)) for u in own) / sum(max(a.get(u, 0), b.get(u, 0)) for u in own)
        row = np.repeat([0, 1], [len(a), len(b)])
        h = np.array([*sorted(a), *sorted(b)], dtype=np.uint64)
        n = np.array([*(a[u] for u in sorted(a)), *(b[u] for u in sorted(b))])
        s = bagminhash.signatures(row, h, n, 2)
        error.append((s[0] == s[1]).mean() - true)
    assert abs(np.mean(error)) < 0.02 and np.std(error) < 0.06


def test_near_classes_match_brute_force(spark):
    rng = random.Random(0)
    rows = []
    add = lambda t: rows.append((len(rows), t))
    for f in range(14):
        base = [f"w{rng.randint(0, 500)}" for _ in range(rng.choice([8, 60, 200]))]
        add(" ".join(base))
        for _ in range(rng.choice([0, 1, 5, 20])):
            w = list(base)
            for _ in range(rng.choice([0, 1, 2, 3, 4, 6])):
                w[rng.randrange(len(w))] = f"x{rng.randint(0, 9999)}"
            add(" ".join(w))
        if f % 3 == 0:
            add(" ".join(base).upper())
            add(" ".join(base))
    for t in (None, "", "", "!!", "??", "!!", "one two", "One, two", "many " * 3000):
        add(t)
    rows += [(None, rows[0][1]), (None, "no id at all"), (3, rows[3][1])]
    df = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, class_id int")
    got = {}
    out = bagminhash.classes(df).collect()
    for r in out:
        got.setdefault(r.class_id, []).append(r.doc_id)
    assert len(out) == len(rows)
    assert {frozenset(x) for x in got.values()} == brute.near_classes(rows)
    kept = bagminhash.keep_one(df)
    assert kept.columns == df.columns and kept.count() == len(got)


def test_overlaps_of_multisets():
    rng = random.Random(1)
    texts = [" ".join(rng.choice("ab") for _ in range(n)) for n in (0, 3, 8, 30, 30, 60, 200)] + ["w " * 400, "w " * 300]
    row, h, c = bagminhash.shingles(pa.array(texts))
    left, right = np.array([0, 2, 4, 6, 8]), np.array([1, 3, 5, 7])
    got = bagminhash.overlaps(row, h, c, left, right)
    for i, x in enumerate(left):
        for j, y in enumerate(right):
            assert got[i, j] == (brute.shingles(texts[x]) & brute.shingles(texts[y])).total()


@pytest.fixture(scope="module")
def pairs():
    """Texts of one template, each alike to one other only: nobody helps a pair to meet."""
    rng = random.Random(7)
    word = lambda: f"w{rng.getrandbits(40)}"
    template, rows = [word() for _ in range(304)], []
    for _ in range(120):
        own = [word() for _ in range(12)]
        for _ in range(2):
            rows.append((len(rows), " ".join(template + own + [word() for _ in range(38)])))
    return rows


def test_a_large_bucket_loses_no_link(spark, pairs, monkeypatch):
    monkeypatch.setattr(bagminhash, "GROUP", 32)  # several parts
    df = spark.createDataFrame(pairs, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in bagminhash.classes(df).collect()}
    assert got == {i: i - i % 2 for i, _ in pairs}


def test_pipeline_keeps_one_of_each_pair_of_a_large_bucket(spark, pairs):
    import corpus_pipeline

    df = spark.createDataFrame([(*r, "x") for r in pairs], "doc_id long, text string, lang string")
    kept = corpus_pipeline.distinct(spark, df, "")
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == list(range(0, len(pairs), 2))


def test_near_classes_of_an_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert bagminhash.classes(df).count() == 0 and bagminhash.keep_one(df).count() == 0


def test_ids_that_repeat_with_different_texts(spark):
    def text(seed, change=0):
        w = [f"{seed}{i}" for i in range(60)]
        return " ".join(w[: 60 - change] + ["other"] * change)

    a, b, c, d = ((text(s), text(s, 2)) for s in "abcd")
    rows = [(10, a[0]), (10, b[0]), (11, b[1])]  # a link of the second text of an id
    rows += [(5, c[0]), (20, d[0]), (20, c[0]), (21, d[1])]  # a text whose id has a smaller class
    e, f, g, h = (text(s) for s in "efgh")
    rows += [(31, e), (32, e), (32, f), (33, f), (33, g), (34, g), (40, h), (40, None), (41, ""), (None, "alone"), (42, h)]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, _key string")
    got, out = {}, bagminhash.classes(df).collect()
    for r in out:
        got.setdefault(r.class_id, []).append(r.doc_id)
    assert len(out) == len(rows)
    assert {frozenset(x) for x in got.values()} == brute.near_classes(rows) == {frozenset(x) for x in ({10, 11}, {5, 20, 21}, {31, 32, 33, 34}, {40, 41, 42}, {None})}
    assert all(k == min(i for i in x if i is not None) for k, x in got.items() if x != [None])
    # one row of each group of alike texts, whatever ids they share
    kept = bagminhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=str) == sorted([(10, a[0]), (10, b[0]), (5, c[0]), (20, d[0]), (31, e), (32, f), (33, g), (40, h), (40, None), (None, "alone")], key=str)
