"""Fixtures with awkward rows, and brute-force versions of the operators."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from itertools import combinations

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row_key string, score double, key int, place string, dropped int"
EMPTY = [None, "", " ", "\n", "\n\n\n", "\t \r\n"]


def rows(texts, first=0):
    """Rows of SCHEMA: the columns of documents and some whose names the operators use inside."""
    return [(first + i, t, "en", "src0", len(t or ""), "x", 1.0, 2, "y", 3) for i, t in enumerate(texts)]


def words(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(UPPER)) if w]


def shingle_set(text, n):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)])


def components(docs, n=4, percent=85):
    """doc_id -> (size, component) by comparing all pairs that share a shingle."""
    sets = {d: shingle_set(t, n) for d, t in docs}
    holders = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            holders[x].append(d)
    shared = Counter(p for ds in holders.values() for p in combinations(sorted(ds), 2))
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for (a, b), k in shared.items():
        if 100 * k >= percent * (len(sets[a]) + len(sets[b]) - k):
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    return {d: (len(s), find(d)) for d, s in sets.items()}


def line_dedup(docs, least_chars=20, least_docs=3):
    """doc_id -> (lines, kept lines)."""
    strip = " \t\n\x0b\x0c\r"
    lines = {d: (t or "").split("\n") for d, t in docs}
    holders = defaultdict(set)
    for d, ls in lines.items():
        for x in ls:
            holders[x.translate(UPPER).strip(strip)].add(d)

    def stays(d, x):
        k = x.translate(UPPER).strip(strip)
        return len(k) < least_chars or len(holders[k]) < least_docs or max(holders[k]) == d

    return {d: (len(ls), [x for x in ls if stays(d, x)]) for d, ls in lines.items()}


PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def contamination(docs, items, n=13):
    """doc_id -> (words, hit words, items)."""
    windows = defaultdict(set)
    for i, t in items:
        w = PLAIN.findall((t or "").translate(UPPER))
        for k in range(max(1, len(w) - n + 1)) if w else ():
            windows[tuple(w[k : k + n])].add(i)
    sizes = {len(x) for x in windows}
    out = {}
    for d, t in docs:
        w = PLAIN.findall((t or "").translate(UPPER))
        hit, found = set(), set()
        for s in sizes:
            for k in range(len(w) - s + 1):
                owners = windows.get(tuple(w[k : k + s]))
                if owners:
                    hit.update(range(k, k + s))
                    found |= owners
        out[d] = (len(w), hit, found)
    return out
