"""Plain versions of the operators' contracts, for small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

BLANK = re.compile(r"[^\x20\x09-\x0D]+")
UPPER = {i: i + 32 for i in range(65, 91)}


def lower(text):
    return (text or "").translate(UPPER)


def shingles(text):
    words = BLANK.findall(lower(text))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def jaccard_groups(rows):
    """[(doc_id, text)] -> [(doc_id, n_shingles, component_id)]"""
    sets = [shingles(t) for _, t in rows]
    parent = {d: d for d, _ in rows}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    having = defaultdict(list)
    for k, s in enumerate(sets):
        for x in s:
            having[x].append(k)
    common = Counter()
    for ks in having.values():
        for i, a in enumerate(ks):
            for b in ks[i + 1 :]:
                common[a, b] += 1
    for (a, b), n in common.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            x, y = find(rows[a][0]), find(rows[b][0])
            parent[max(x, y)] = min(x, y)
    return [(d, len(s), find(d)) for (d, _), s in zip(rows, sets)]


def repeated_spans(rows, span=50):
    """[(doc_id, text)] -> [(doc_id, n_bytes, n_removed, n_spans, kept_sha256)]"""
    first = {}
    raw = [(d, (t or "").encode()) for d, t in rows]
    for d, b in raw:
        if d is not None:
            for i in range(len(b) - span + 1):
                s = b[i : i + span]
                if d < first.get(s, math.inf):
                    first[s] = d
    out = []
    for d, b in raw:
        gone = bytearray(len(b))
        if d is not None:
            for i in range(len(b) - span + 1):
                if first[b[i : i + span]] < d:
                    gone[i : i + span] = b"\1" * span
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((d, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


def language_base(rows, folds=7, held=2):
    """[(doc_id, text)] -> [(doc_id, held_out, n_tokens, n_known, train_tokens, base_score)]"""
    docs = [(d, zlib.crc32(("" if d is None else str(d)).encode()) % folds == held, [*BLANK.findall(lower(t)), None]) for d, t in rows]
    count = Counter(w for _, out, ws in docs if not out for w in ws)
    n, v = sum(count.values()), len(count)
    return [(d, out, len(ws), sum(count[w] > 0 for w in ws), n, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in ws)) for d, out, ws in docs]


def language_model(rows, bigram, unigram, distinct, folds=7, held=2):
    """[(doc_id, text)] -> {doc_id: score} of the operator's formula with ``distinct`` as V."""
    docs = [(d, zlib.crc32(("" if d is None else str(d)).encode()) % folds == held, ["<0>", "<1>", *BLANK.findall(lower(t)), None]) for d, t in rows]
    c1, c2, c3, x1, x2 = Counter(), Counter(), Counter(), Counter(), Counter()
    for _, out, ws in docs:
        if not out:
            for u, v, w in zip(ws, ws[1:], ws[2:]):
                c1[w] += 1
                c2[v, w] += 1
                c3[u, v, w] += 1
                x1[v] += 1
                x2[u, v] += 1
    n = sum(c1.values())
    scores = {}
    for d, _, ws in docs:
        scores[d] = sum(
            math.log10((c3[u, v, w] + bigram * c2[v, w] + unigram * (c1[w] + 1) / (n + distinct + 1)) / (x2[u, v] + bigram * x1[v] + unigram)) for u, v, w in zip(ws, ws[1:], ws[2:])
        )
    return scores


def wordpieces(word, initial, later):
    """Greedy longest-match pieces of a word, None where there are none."""
    pieces, at, held = [], 0, initial
    while at < len(word):
        for end in range(len(word), at, -1):
            if word[at:end] in held:
                pieces.append(word[at:end])
                at, held = end, later
                break
        else:
            return None
    return pieces


def conversation_nodes(rows):
    """[(conv_id, turn, role, text)] -> [(conv_id, depth, parent, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)]"""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 4
        path = tuple(own.get(c - c % 20, [])[:h] + own[c][h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    children = defaultdict(list)
    for path in members:
        if path:
            children[path[:-1]].append(path)
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        below = children[path]
        words = len(BLANK.findall(path[-1][1])) if path else 0
        leaves[path] = sum(leaves[x] for x in below) or 1
        saved[path] = sum(saved[x] for x in below) + (len(members[path]) - 1) * words
    sha = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    return [(m[0], len(p), members[p[:-1]][0] if p else None, len(m), len(children[p]), leaves[p], saved[p], sha(ends.get(p, []))) for p, m in members.items()]


def periodic_runs(words):
    """[(start, length, period)] of a list of words."""
    found = {}
    for p in range(1, len(words) // 3 + 1):
        i = 0
        while i + p < len(words):
            j = i
            while j + p < len(words) and words[j] == words[j + p]:
                j += 1
            if j > i and j + p - i >= max(24, 3 * p):
                found.setdefault((i, j + p - i), p)
            i = j + 1
    return sorted((s, n, p) for (s, n), p in found.items())


def period_report(rows):
    """[(doc_id, text)] -> [(doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256)]"""
    out = []
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for d, text in rows:
        words = BLANK.findall(text or "")
        n = len(words)
        h = zlib.crc32(str(d).encode()) if d is not None else 1
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = periodic_runs(words)
        gone = {i for s, n, p in runs for i in range(s + p, s + n)}
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else None
        listed = sha("".join(f"{s},{n},{p}\n" for s, n, p in sorted(runs, key=lambda r: (r[0], r[2]))))
        out.append((d, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, listed, sha(" ".join(w for i, w in enumerate(words) if i not in gone))))
    return out
