"""Plain Python versions of operators, for small inputs."""

from __future__ import annotations

import re
import string
from collections import Counter, defaultdict

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def spaced_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))


def item_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


class Union:
    def __init__(self, n):
        self.up = list(range(n))

    def find(self, i):
        while self.up[i] != i:
            i = self.up[i]
        return i

    def join(self, i, j):
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)


def shingles(text, n=5):
    w = spaced_words(text)
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def jaccard_groups(texts):
    """For each text the smallest index that links lead to."""
    sets = [shingles(t) for t in texts]
    u = Union(len(texts))
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 75 * len(a | sets[j]):
                u.join(i, j)
    return sets, [u.find(i) for i in range(len(texts))]


def repeats(texts, size=50):
    """For each text the runs of words in windows that occur twice or more, and in
    windows whose first occurrence (texts in order) is elsewhere."""
    words = [spaced_words(t) for t in texts]
    count, first = Counter(), {}
    for i, w in enumerate(words):
        for s in range(len(w) - size + 1):
            key = tuple(w[s : s + size])
            count[key] += 1
            first.setdefault(key, (i, s))
    out = []
    for i, w in enumerate(words):
        found = [s for s in range(len(w) - size + 1) if count[tuple(w[s : s + size])] > 1]
        later = [s for s in found if first[tuple(w[s : s + size])] != (i, s)]
        out.append((runs(found, size), runs(later, size)))
    return out


def runs(starts, size):
    out = []
    for s in starts:
        if out and s <= out[-1][1]:
            out[-1][1] = s + size
        else:
            out.append([s, s + size])
    return [tuple(x) for x in out]


def contamination(texts, items, size=13):
    """(n_words, n_hit, item ids) of each text; items are (id, text)."""
    windows = defaultdict(set)
    for k, t in items:
        w = item_words(t)
        for s in range(max(1, len(w) - size + 1) if w else 0):
            windows[tuple(w[s : s + size])].add(str(k))
    sizes = {len(x) for x in windows}
    out = []
    for t in texts:
        w = item_words(t)
        hit, ids = set(), set()
        for n in sizes:
            for s in range(len(w) - n + 1):
                if (key := tuple(w[s : s + n])) in windows:
                    hit |= set(range(s, s + n))
                    ids |= windows[key]
        out.append((len(w), len(hit), sorted(ids)))
    return out
