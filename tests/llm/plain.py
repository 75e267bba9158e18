"""Plain versions that the operators are held against."""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import defaultdict

from millrace.llm import near_dups


def plain_score(model, x):
    total = model.base + sum(t[bisect_right(e.tolist(), v)] for e, t, v in zip(model.edges, model.tables, x, strict=True))
    for (a, b), table in zip(model.pairs, model.pair_tables, strict=True):
        total += table[bisect_right(model.pair_edges[a].tolist(), x[a]), bisect_right(model.pair_edges[b].tolist(), x[b])]
    return 1 / (1 + math.exp(-min(30, max(-30, total))))


def brute_classes(rows):
    owner, inverted, size = {}, defaultdict(list), {}
    for i, t in rows:
        _, v = near_dups.elements([t])
        size[i] = len(v)
        owner[i] = i
        for x in v.tolist():
            inverted[x].append(i)
    both = defaultdict(int)
    for ids in inverted.values():
        for k, b in enumerate(ids):
            for a in ids[:k]:
                both[a, b] += 1

    def root(x):
        while owner[x] != x:
            x = owner[x]
        return x

    for (a, b), n in both.items():
        if n / (size[a] + size[b] - n) >= near_dups.SIMILARITY:
            a, b = root(a), root(b)
            owner[max(a, b)] = min(a, b)
    return {i: root(i) for i, _ in rows}


def brute_tiles(a, b, m):
    """Longest first, then from the front of ``a``, then of ``b``."""
    ua, ub, out = [False] * len(a), [False] * len(b), []
    while True:
        best = (m - 1, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                k = 0
                while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] >= 0 and not ua[i + k] and not ub[j + k]:
                    k += 1
                if k > best[0]:
                    best = (k, i, j)
        k, i, j = best
        if k < m:
            return out
        ua[i : i + k], ub[j : j + k] = [True] * k, [True] * k
        out.append((i, j, k))


def brute_leaks(docs, items, coverage=0.5):
    out = []
    split = lambda t: re.findall(r"\w+", (t or "").lower())
    for i, t in items:
        b = split(t)
        m = min(5, len(b))
        runs = {tuple(b[k : k + m]) for k in range(len(b) - m + 1)} if b else set()
        for d, text in docs:
            a = split(text)
            if not any(tuple(a[k : k + m]) in runs for k in range(len(a) - m + 1)):
                continue
            found = brute_tiles([hash(w) & 0xFFFFFFFF for w in b], [hash(w) & 0xFFFFFFFF for w in a], m)
            share = sum(k for _, _, k in found) / len(b)
            if share >= coverage:
                out.append((d, i, share, len(found), max(k for _, _, k in found)))
    return sorted(out)
