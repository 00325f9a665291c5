"""Plain Python versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def sha(data):
    return hashlib.sha256(data if isinstance(data, bytes) else data.encode()).hexdigest()


def words(text, pattern=WORD, lower=False):
    text = text or ""
    return pattern.findall(text.translate(LOWER) if lower else text)


def repeats(rows, cut, join, window=50):
    """(id, items, removed, removed runs, hash of what stays) by looking at every window."""
    items = [(i, cut(t)) for i, t in rows]
    first = {}
    for i, own in items:
        if i is not None:
            for p in range(len(own) - window + 1):
                key = tuple(own[p:p + window])
                first[key] = min(i, first.get(key, i))
    out = []
    for i, own in items:
        gone = [False] * len(own)
        if i is not None:
            for p in range(len(own) - window + 1):
                if first[tuple(own[p:p + window])] < i:
                    gone[p:p + window] = [True] * window
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(own), sum(gone), runs, sha(join([x for x, g in zip(own, gone) if not g]))))
    return out


def lines(rows, shortest=20, docs=3):
    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)

    held = defaultdict(set)
    for i, t in rows:
        if i is not None:
            for line in (t or "").split("\n"):
                if len(key(line)) >= shortest:
                    held[key(line)].add(i)
    common = {k: max(v) for k, v in held.items() if len(v) >= docs}
    out = []
    for i, t in rows:
        own = (t or "").split("\n")
        kept = [x for x in own if i is None or key(x) not in common or common[key(x)] <= i]
        out.append((i, len(own), len(own) - len(kept), sha("\n".join(kept))))
    return out


def contamination(rows, tests, size=10):
    grams = defaultdict(set)
    for name, t in tests:
        own = words(t, ALNUM, True)
        n = min(size, len(own))
        if n and name is not None:
            for p in range(len(own) - n + 1):
                grams[tuple(own[p:p + n])].add(str(name))
    sizes, out = {len(g) for g in grams}, []
    for i, t in rows:
        own = words(t, ALNUM, True)
        hit, names = set(), set()
        for n in sizes:
            for p in range(len(own) - n + 1):
                if (found := grams.get(tuple(own[p:p + n]))):
                    hit.update(range(p, p + n))
                    names |= found
        out.append((i, len(own), len(hit), len(names), sha(",".join(sorted(names))), bool(hit)))
    return out


def shingles(text, n):
    own = words(text, lower=True)
    return {tuple(own[p:p + n]) for p in range(len(own) - n + 1)} if len(own) >= n else {tuple(own)} - {()}


def jaccard(rows, n, percent):
    """(id, set size, component) by counting shared shingles of all pairs."""
    sets = [(i, shingles(t, n)) for i, t in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for k, (i, own) in enumerate(sets):
        if i is None:
            continue
        shared = Counter(j for g in own for j in holders[g])
        for j, both in shared.items():
            if 100 * both >= percent * (len(own) + len(sets[j][1]) - both):
                a, b = find(i), find(sets[j][0])
                parent[max(a, b)] = min(a, b)
        for g in own:
            holders[g].append(k)
    return [(i, len(own), None if i is None else find(i)) for i, own in sets]


def statistics(text, window=5):
    text = text or ""
    own = words(text)
    grams = Counter(tuple(own[p:p + window]) for p in range(len(own) - window + 1))
    inside = set()
    for p in range(len(own) - window + 1):
        if grams[tuple(own[p:p + window])] > 1:
            inside.update(range(p, p + window))
    full = [x for x in text.split("\n") if words(x)]
    return (len(own), sum(map(len, own)), len(re.findall(r"[#*$%&|<>]", text)), len(full) - len(set(full)), len(inside))


def matched(text, template):
    """Most matched words of an alignment of a template inside a text, without a band."""
    a, b = words(text, ALNUM, True), words(template, ALNUM, True)
    best, above = (0, 0), [(0, 0)] * (len(a) + 1)
    for t in b:
        row = [(0, 0)]
        for i, w in enumerate(a):
            s, m = above[i]
            cell = max((0, 0), (s + 2, m + 1) if w == t else (s - 1, m), (above[i + 1][0] - 1, above[i + 1][1]),
                       (row[-1][0] - 1, row[-1][1]), key=lambda c: c[0])
            row.append(cell)
            if w == t:
                best = max(best, cell, key=lambda c: c[0])
        above = row
    return best[1] / max(1, len(b))
