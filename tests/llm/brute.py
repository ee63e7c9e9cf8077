"""Plain versions of the operators for small tables."""

import re
from collections import Counter, defaultdict

LOW = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def find(parent, x):
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def jaccard(rows, k=4, num=85, den=100):
    sets = {}
    for i, t in rows:
        w = words((t or "").translate(LOW))
        sets[i] = frozenset(tuple(w[j : j + k]) for j in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])
    parent = {i: i for i in sets}
    at = defaultdict(list)
    for i, s in sorted(sets.items()):
        c = Counter(j for x in s for j in at[x])
        for j, o in c.items():
            if den * o >= num * (len(s) + len(sets[j]) - o):
                a, b = sorted((find(parent, i), find(parent, j)))
                parent[b] = a
        for x in s:
            at[x].append(i)
    return {i: (len(s), find(parent, i)) for i, s in sets.items()}


def windows(rows, width=20):
    first = {}
    for i, t in sorted(rows):
        w = words(t)
        for j in range(len(w) - width + 1):
            first.setdefault(tuple(w[j : j + width]), (i, j))
    out = {}
    for i, t in rows:
        w = words(t)
        gone = {j + x for j in range(len(w) - width + 1) if first[tuple(w[j : j + width])] != (i, j) for x in range(width)}
        out[i] = (len(w), len(gone), " ".join(x for n, x in enumerate(w) if n not in gone))
    return out


def suffixes(rows, length=200):
    c = Counter()
    data = [(i, (t or "").encode()) for i, t in rows]
    for _, b in data:
        c.update(b[s : s + length] for s in range(len(b) - length + 1))
    out = {}
    for i, b in data:
        gone = bytearray(len(b))
        for s in range(len(b) - length + 1):
            if c[b[s : s + length]] > 1:
                gone[s : s + length] = b"\1" * length
        out[i] = (len(b), sum(gone), len([r for r in bytes(gone).split(b"\0") if r]), bytes(x for x, g in zip(b, gone) if not g))
    return out
