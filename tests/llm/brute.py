"""Plain versions of the operators' definitions, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
import struct
import zlib
from collections import Counter


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def shingles(text):
    w = words(text)
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else Counter([tuple(w)] if w else [])


def near_classes(rows):
    """Ids grouped by linked texts; rows of (id, text)."""
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    bags = [shingles(t) for _, t in rows]
    for a in range(len(rows)):
        for b in range(a):
            both, total = sum((bags[a] & bags[b]).values()), sum((bags[a] | bags[b]).values())
            same_id = rows[a][0] is not None and rows[a][0] == rows[b][0]
            if same_id or (rows[a][1] or "") == (rows[b][1] or "") or total and both / total >= 0.8:
                up[find(a)] = find(b)
    out = {}
    for a in range(len(rows)):
        out.setdefault(find(a), []).append(rows[a][0])
    return {frozenset(x) for x in out.values()}


def repeats(rows, length=400):
    data = [(i, (t or "").encode()) for i, t in rows]
    count = Counter(t[k : k + length] for _, t in data for k in range(len(t) - length + 1))
    out = []
    for i, t in data:
        gone = bytearray(len(t))
        for k in range(len(t) - length + 1):
            if count[t[k : k + length]] > 1:
                gone[k : k + length] = b"\1" * length
        spans = sum(1 for k in range(len(gone)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(bytes(b for b, x in zip(t, gone, strict=True) if not x)).hexdigest()))
    return sorted(out, key=str)


def contamination(docs, items, window=13):
    grams, out = {}, []
    for item, text in items:
        w = words(text)
        k = min(window, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            grams.setdefault(tuple(w[i : i + k]), set()).add(str(item) if item is not None else "null")
    sizes = {len(g) for g in grams}
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for k in sizes:
            for p in range(len(w) - k + 1):
                if own := grams.get(tuple(w[p : p + k])):
                    hit.update(range(p, p + k))
                    found |= own
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=str)


def _sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return _sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def merkle(rows):
    """(doc_id, leaf, subroot, root, proof, folded root, verified) of rows (doc_id, source, lang, n_chars, text)."""

    def grow(row):
        levels = [row]
        while len(levels[-1]) > 1:
            levels.append([_sha(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
        return levels

    def climb(levels, i, digest, proof):
        for row in levels[:-1]:
            run = range(i // 3 * 3, min(i // 3 * 3 + 3, len(row)))
            proof += [row[j] for j in run if j != i]
            digest = _sha(*(digest if j == i else row[j] for j in run))
            i //= 3
        return digest

    trees = {}
    for r in rows:
        trees.setdefault(r[1], []).append(r)
    keys = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    grown = {}
    for s in keys:
        trees[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        grown[s] = grow([leaf(r) for r in trees[s]])
    top = grow([grown[s][-1][0] for s in keys]) if keys else []
    out = []
    for k, s in enumerate(keys):
        for i, r in enumerate(trees[s]):
            shown = r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None:
                shown = (*r[:4], r[4].replace("\n", ""))
            proof = []
            folded = climb(top, k, climb(grown[s], i, leaf(shown), proof), proof)
            out.append((r[0], leaf(r), grown[s][-1][0], top[-1][0], _sha(*proof), folded, folded == top[-1][0]))
    return out


def conversations(rows):
    """{conv_id: (turns, digest of the turns, characters of the assistant, their digest)}."""
    by = {}
    for c, turn, role, text in rows:
        by.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for c, turns in by.items():
        turns.sort()
        loss = "".join(t for *_, role, t in turns if role == "assistant")
        out[c] = (len(turns), _sha(*(f"{role}\n{t}\n" for *_, role, t in turns)), len(loss), _sha(loss))
    return out


def hard_negatives(rows, anchors, positives=5, negatives=3):
    def usable(r):
        return r[0] is not None and r[2] is not None and r[1] and all(x is not None and math.isfinite(x) for x in r[1])

    whole = lambda v: [math.floor(256 * struct.unpack("f", struct.pack("f", x))[0]) for x in v]
    rows = [(r[0], whole(r[1]), r[2]) for r in rows if usable(r)]
    out = []
    for a in {(r[0], tuple(whole(r[1])), r[2]) for r in anchors if usable(r)}:
        scored = sorted((-sum(x * y for x, y in zip(a[1], r[1], strict=True)), r[0], r[2]) for r in rows if r[0] != a[0] and len(r[1]) == len(a[1]))
        for p, pid, _ in [s for s in scored if s[2] == a[2]][:positives]:
            fit = [s for s in scored if s[2] != a[2] and 50 * -p <= 100 * -s[0] <= 95 * -p][:negatives]
            out += [(a[0], pid, k, n, -p, -s) for k, (s, n, _) in enumerate(fit, 1)]
    return sorted(out)
