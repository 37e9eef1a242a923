"""Plain versions of what the operators compute, for small tables."""

import collections
import re

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, words):
    w = re.findall(r"[^\x20\x09-\x0d]+", (text or "").translate(LOWER))
    if len(w) >= words:
        return frozenset(tuple(w[i : i + words]) for i in range(len(w) - words + 1))
    return frozenset([tuple(w)] if w else [])


def components(rows, words, num, den):
    """doc_id -> (size of its set, smallest doc_id of its component), comparing every pair that shares a shingle."""
    sets = {d: shingles(t, words) for d, t in rows}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    seen = collections.defaultdict(list)
    for d, s in sets.items():
        for e, n in collections.Counter(e for x in s for e in seen[x]).items():
            if den * n >= num * (len(s) + len(sets[e]) - n):
                a, b = find(d), find(e)
                parent[max(a, b)] = min(a, b)
        for x in s:
            seen[x].append(d)
    return {d: (len(s), find(d)) for d, s in sets.items()}
