"""Plain versions of the operators that look at every row, pair or window, for small inputs."""

from __future__ import annotations

import base64
import hashlib
import re
from collections import defaultdict

import numpy as np

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return SPACE.findall(text or "")


def smallest_reachable(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def exact(docs):
    groups = defaultdict(list)
    for i, t in docs:
        groups[t or ""].append(i)
    return sorted((i, max(groups[t or ""]), len(groups[t or ""]), i == max(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in docs)


def vectors(rows, threshold=0.9):
    ok = {i: np.array(v, float) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    links = [(a, b) for a in ok for b in ok if a < b and len(ok[a]) == len(ok[b]) and ok[a] @ ok[b] / np.linalg.norm(ok[a]) / np.linalg.norm(ok[b]) >= threshold]
    comp = smallest_reachable([i for i, _ in rows], links)
    n = defaultdict(int)
    for a, b in links:
        n[a] += 1
        n[b] += 1
    return sorted((i, n[i], comp[i], comp[i] == i) for i, _ in rows)


def substrings(docs, window=50):
    least = {}
    for i, t in docs:
        w = words(t)
        for k in range(len(w) - window + 1):
            s = tuple(w[k : k + window])
            least[s] = min(least.get(s, i), i)
    out = []
    for i, t in docs:
        w = words(t)
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if least[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def secrets(docs):
    rules = [
        ("assign", re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A), 2, 8),
        ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 16), ("hex", re.compile(r"[0-9a-f]+"), 0, 32),
    ]
    out = []
    for i, t in docs:
        found = [(m.start(), k, m.end()) for k, (_, r, g, least) in enumerate(rules) for m in r.finditer(t or "") if len(m[g]) >= least]
        spans = ",".join(f"{rules[k][0]}:{s}:{e}" for s, k, e in sorted(found))
        out.append((i, *(sum(x[1] == k for x in found) for k in range(3)), hashlib.sha256(spans.encode()).hexdigest()))
    return sorted(out)


def targets(sizes, share=1.5, most=2.0, weights=(3, 1, 2)):
    """Source -> target by resharing the excess until none is above."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, open_, out = share * sum(sizes.values()), set(order), dict.fromkeys(order, 0.0)
    while open_:
        unit = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if unit * weight[s] > most * sizes[s]}
        if not over:
            return out | {s: unit * weight[s] for s in open_}
        for s in over:
            out[s] = most * sizes[s]
            left -= out[s]
        open_ -= over
    return out


def archived(pages):
    payload = {i: (h or "").encode() for i, h in pages}
    owner = {}
    for i, p in payload.items():
        owner[p] = max(owner.get(p, i), i)
    return sorted((i, len(p), base64.b32encode(hashlib.sha1(p).digest()).decode(), "response" if owner[p] == i else "revisit", None if owner[p] == i else owner[p]) for i, p in payload.items())


def shingles(text, size=5):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()


def jaccard(docs, percent=80):
    sets = {i: shingles(t) for i, t in docs}
    ids = sorted(sets, key=lambda i: len(sets[i]))
    links = []
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            if 100 * len(sets[a]) < percent * len(sets[b]):
                break
            same = len(sets[a] & sets[b])
            if sets[a] and 100 * same >= percent * (len(sets[a]) + len(sets[b]) - same):
                links.append((min(a, b), max(a, b)))
    comp = smallest_reachable(list(sets), links)
    return sorted((i, len(sets[i]), comp[i]) for i in sets)


def fewest_bins(lengths, limit):
    """By trying every bin for every length, longest first."""
    lengths, best = sorted(lengths, reverse=True), [len(lengths)]

    def go(i, rooms):
        if len(rooms) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(rooms)
            return
        for j in {room: j for j, room in enumerate(rooms) if room >= lengths[i]}.values():
            rooms[j] -= lengths[i]
            go(i + 1, rooms)
            rooms[j] += lengths[i]
        go(i + 1, [*rooms, limit - lengths[i]])

    go(0, [])
    return best[0]


def kneser_ney(words, order, discount, base):
    """Probability of a character after a context, from the definition, over words with marks around them."""
    grams = defaultdict(int)
    for w in words:
        s = "\x02" * (order - 1) + w + "\x03"
        for i in range(len(s) - order + 1):
            grams[s[i : i + order]] += 1
    levels = {order: dict(grams)}
    for n in range(order - 1, 0, -1):
        levels[n] = defaultdict(int)
        for g in levels[n + 1]:
            levels[n][g[1:]] += 1

    def p(context, c):
        n = len(context) + 1
        below = p(context[1:], c) if n > 1 else base
        own = {g: k for g, k in levels[n].items() if g[:-1] == context}
        if not own:
            return below
        total = sum(own.values())
        return max(own.get(context + c, 0) - discount, 0) / total + discount * len(own) / total * below

    return p
