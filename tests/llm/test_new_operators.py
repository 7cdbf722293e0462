"""Merkle proofs, chat formatting and hard negatives against plain versions."""

import hashlib
import random
import zlib

import brute
import pytest
from pyspark.sql import functions as F

from stratum.llm import chat, covertree, merkle

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
DOC = "doc_id long, source string, lang string, n_chars long, text string"


def _prove(df):
    odd = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    return merkle.prove(df, FIELDS, {"text": F.when(odd, F.translate("text", "\n", "")).otherwise(F.col("text"))})


def _docs(n):
    rng = random.Random(n)
    rows = [(i, rng.choice(["a", "a", "a", "é", "", None, "0", "1b"]), rng.choice(["en", None]), rng.choice([None, 5, -7]), rng.choice(["x\ny", "", None, "line\n" * 50, f"t{i}"])) for i in range(n)]
    return rows + [(3, "a", "en", 5, "other"), (3, "a", "en", 5, "other"), (None, "a", None, None, None), (None, None, None, None, "q\n"), (n, "alone", "en", 1, "z\n")]


@pytest.mark.parametrize("n", [0, 1, 40, 400])
def test_proofs_match_a_plain_tree(spark, monkeypatch, n):
    monkeypatch.setattr(merkle, "PART", 10)  # partitions that are no whole subtrees
    monkeypatch.setattr(merkle, "LEVELS", 2)
    monkeypatch.setattr(merkle, "BLOCK", 9)  # several tiers
    rows = _docs(n) if n > 1 else _docs(0)[-1:] * n
    df = spark.createDataFrame([(*r, "x") for r in rows], DOC + ", tree string")
    out = _prove(df)
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    got = sorted(map(tuple, out.collect()), key=str)
    assert got == sorted(brute.merkle(rows), key=str)
    for r in got:
        tampered = any(x[0] == r[0] and x[4] and "\n" in x[4] and brute.leaf(x) == r[1] for x in rows) and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[0] is not None
        assert r[6] is not tampered


def test_octopus_is_the_least_union():
    import numpy as np

    for n in (1, 2, 3, 4, 9, 10, 28, 100):
        for k in (1, 2, n):
            known = np.array(sorted(random.Random(n + k).sample(range(n), min(k, n))))
            need, own, size, level = set(), set(known.tolist()), n, 0
            while size > 1:
                for i in own:
                    need |= {(level, j) for j in range(i // 3 * 3, min(i // 3 * 3 + 3, size)) if j not in own}
                own, size, level = {i // 3 for i in own}, -(-size // 3), level + 1
            assert {(lv, int(i)) for lv, idx in enumerate(merkle.octopus(known, n)) for i in idx} == need


CHAT = "conv_id long, turn long, role string, text string"


def _conversations():
    rng = random.Random(4)
    words = ["hello", "<|im_end|>", "<|", "<\\|", "\n", "é", "|>", "<\\\\|im_start|>x", "<", "", " "]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool\nx\\"]), "".join(rng.choice(words) for _ in range(rng.randint(0, 9)))) for c in range(30) for t in range(rng.randint(1, 7))]
    rows += [(50, t, "user" if t % 2 else "assistant", f"<|turn {t}") for t in range(400)]  # one conversation holds most rows
    return rows + [(60, 1, None, None), (60, 0, "assistant", None), (None, 0, "assistant", "no id"), (61, None, "assistant", "first"), (61, 1, "user", "x"), (62, 1, "user", "twice"), (62, 1, "user", "twice"), (63, 0, "assistant", "long " * 300_000)]


def test_chat_digests_match_plain_text(spark):
    rows = _conversations()
    df = spark.createDataFrame([(*r, 1) for r in rows], CHAT + ", piece int")
    pieces = chat.format_turns(df)
    got = {r.conv_id: tuple(r)[1:5] for r in chat.digests(pieces).collect()}
    assert got == brute.conversations(rows)
    text = {}
    for r in sorted(pieces.collect(), key=lambda r: (str(r.conv_id), r.pid, r.piece)):
        assert len(r.turns) <= chat.PIECE and not r.rewrites
        text[r.conv_id] = text.get(r.conv_id, "") + r.text
    assert text[50] == "".join(f"<|im_start|>{'user' if t % 2 else 'assistant'}\n<\\|turn {t}<|im_end|>\n" for t in range(400))
    assert all(t.count("<|im_start|>") == sum(r[0] == c for r in rows) for c, t in text.items())
    assert chat.digests(chat.format_turns(df.limit(0))).count() == 0


def test_templates_with_context_and_templates_that_rewrite(spark):
    def header(turns):  # a header once, trimmed texts, a mark that depends on the turn before
        out = "<bos>"
        for i, (role, text) in enumerate(turns):
            out += f"[{'again ' if i and turns[i - 1][0] == role else ''}{role}]{text.strip()}[/]"
        return out

    rows = [(1, t, "user" if t % 3 else "assistant", f" t{t} ") for t in range(300)]
    pieces = chat.format_turns(spark.createDataFrame(rows, CHAT), chat.Template(header))
    whole = "".join(r.text for r in sorted(pieces.collect(), key=lambda r: (r.pid, r.piece)))
    assert whole == header([(r[2], r[3]) for r in rows])
    got = chat.digests(pieces, chat.Template(header)).first()
    assert got.loss_chars == sum(len(r[3].strip()) for r in rows if r[2] == "assistant") and not got.rewrites

    def forgets(turns):  # earlier answers lose their thoughts
        return "".join(f"({r}:{t.split('=')[-1] if r == 'assistant' and i < len(turns) - 1 else t})" for i, (r, t) in enumerate(turns))

    out, spans, rewrites = chat.locate(forgets, [], [("user", "q"), ("assistant", "think=a"), ("user", "r")])
    assert rewrites and out == "(user:q)(assistant:a)(user:r)"
    assert [out[s["text_start"] : s["text_end"]] for s in spans] == ["q", "a", "r"]
    drops = lambda turns: "".join(t for _, t in turns[-2:])
    out, spans, rewrites = chat.locate(drops, [], [("user", "aa"), ("user", "b"), ("user", "c")])
    assert rewrites and out == "bc" and spans[0]["text_start"] is None and [out[s["text_start"] : s["text_end"]] for s in spans[1:]] == ["b", "c"]


VEC = "vec_id long, embedding array<float>, label int"


def _vectors():
    rng = random.Random(9)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(6)], rng.randint(0, 3)) for i in range(160)]
    rows += [(200 + i, list(rows[7][1]), i % 3) for i in range(30)]  # many equal vectors
    rows += [(300, None, 1), (301, [0.1] * 6, None), (302, [0.1, None, 0.2, 0.0, 0.0, 0.0], 1), (303, [float("nan")] * 6, 1), (304, [float("inf")] * 6, 1), (None, [0.5] * 6, 1)]
    return rows + [(305, [0.0] * 6, 1), (350, [0.0] * 6, 2), (400, [1.0, 2.0], 0), (401, [1.0, 1.9], 0), (402, [1.0, 0.5], 1), (403, [], 1), (450, [1e6] * 6, 0), (451, [1e6] * 6, 0), (452, [6e5] * 6, 1), (500, [0.5], 9)]


def test_hard_negatives_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(covertree, "BLOCK", 40)
    monkeypatch.setattr(covertree, "ANCHORS", 3)
    monkeypatch.setattr(covertree, "LEAF", 4)
    rows = _vectors()
    df = spark.createDataFrame([(*r, 1) for r in rows], VEC + ", rank int")
    pick = df.filter("vec_id % 10 = 0")
    got = covertree.hard_negatives(df, pick)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = brute.hard_negatives(rows, [r for r in rows if r[0] is not None and r[0] % 10 == 0])
    assert sorted(map(tuple, got.collect())) == want and len(want) > 50
    # an anchor that repeats counts once; a row that repeats is found twice, but not by itself
    again = covertree.hard_negatives(df, pick.union(pick))
    assert sorted(map(tuple, again.collect())) == want
    twice = rows + [r for r in rows if r[0] in (20, 8)]
    again = covertree.hard_negatives(spark.createDataFrame([(*r, 1) for r in twice], VEC + ", rank int"), pick)
    assert sorted(map(tuple, again.collect())) == brute.hard_negatives(twice, [r for r in rows if r[0] is not None and r[0] % 10 == 0])
    assert covertree.hard_negatives(df.limit(0), pick).count() == 0


def test_hard_negatives_in_a_grid_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(covertree, "SHARE", 2)  # 8 lanes: 2 columns of 4
    monkeypatch.setattr(covertree, "BLOCK", 40)
    monkeypatch.setattr(covertree, "ANCHORS", 3)
    met, meet = [], covertree._meet
    monkeypatch.setattr(covertree, "_meet", lambda *a: met.append(meet(*a)) or met[-1])
    rows = _vectors()
    df = spark.createDataFrame(rows, VEC)
    got = covertree.hard_negatives(df, df.filter("vec_id % 10 = 0"))
    assert sorted(map(tuple, got.collect())) == brute.hard_negatives(rows, [r for r in rows if r[0] is not None and r[0] % 10 == 0])
    plans = [x._jdf.queryExecution().executedPlan().toString() for x in [*met, got]]
    # the files are small, the copies of their blocks are not: none goes to the driver
    assert len(plans) == 3 and all("Broadcast" not in p and "SortMergeJoin" in p for p in plans)


def test_cover_tree_covers_and_separates():
    import numpy as np

    rng = np.random.default_rng(2)
    points = np.concatenate([rng.normal(size=(150, 3)), np.repeat(rng.normal(size=(1, 3)), 60, axis=0), rng.normal(size=(90, 3)) * 0.01])
    order, node, first, last, radius = covertree.cover_tree(points)
    assert sorted(order.tolist()) == list(range(len(points)))
    own = points[order]

    def below(i):
        return list(range(-1 - first[i], -1 - last[i])) if first[i] < 0 else [p for j in range(first[i], last[i]) for p in below(j)]

    dist = lambda a, b: np.sqrt(((a - b) ** 2).sum(axis=-1))
    for i in range(len(node)):
        assert dist(own[below(i)], own[node[i]]).max() <= radius[i] + 1e-12 and node[i] in below(i)
        if first[i] >= 0:
            centres = own[node[first[i] : last[i]]]
            apart = dist(centres[:, None], centres[None])[~np.eye(len(centres), dtype=bool)]
            assert not len(apart) or apart.min() > radius[i] / covertree.BASE


def test_descent_skips_what_windows_exclude():
    import numpy as np

    rng = np.random.default_rng(5)
    centres = rng.normal(size=(20, 8)) * 40
    vecs = np.floor(np.repeat(centres, 50, axis=0) + rng.normal(size=(1000, 8)))
    order, *tree = covertree.cover_tree(covertree._augment(vecs)[0])
    t = covertree._Tree(8, order.astype(np.int64).tobytes(), vecs[order].tobytes(), *(np.ascontiguousarray(x).tobytes() for x in tree))
    scores = vecs @ vecs[3]
    best = [[]]
    seen = covertree.search(t, 3, vecs[3], [(-np.inf, np.inf)], best, 5)
    want = sorted(((s, -i) for i, s in enumerate(scores) if i != 3), reverse=True)[:5]
    assert [(float(s), i) for s, i in best[0]] == want and seen < 500
    top = float(np.sort(scores)[-300])
    best = [[]]
    covertree.search(t, 3, vecs[3], [(top - 500, top)], best, 3)
    assert [(float(s), i) for s, i in best[0]] == sorted(((s, -i) for i, s in enumerate(scores) if top - 500 <= s <= top), reverse=True)[:3]
