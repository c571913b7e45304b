"""Plain single-machine versions of the operators, to test against."""

from __future__ import annotations

import re

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(UPPER))


def shingle_set(text: str | None, size: int = 5) -> frozenset:
    found = words(text)
    if not found:
        return frozenset([text or ""])
    return frozenset(tuple(found[i : i + size]) for i in range(max(1, len(found) - size + 1)))


def near_classes(texts: dict, similarity: float = 0.8) -> dict:
    """Smallest id of each document's component; pairs by a plain inverted index."""
    sets = {d: shingle_set(t) for d, t in texts.items()}
    by_set: dict = {}
    for d, s in sets.items():
        by_set.setdefault(s, []).append(d)
    nodes = [members[0] for members in by_set.values()]
    parent = {d: d for d in texts}

    def root(d):
        while parent[d] != d:
            parent[d] = parent[parent[d]]
            d = parent[d]
        return d

    def join(a, b):
        a, b = sorted((root(a), root(b)))
        parent[b] = a

    for members in by_set.values():
        for d in members[1:]:
            join(members[0], d)
    index: dict = {}
    for d in nodes:
        common: dict = {}
        for s in sets[d]:
            for other in index.get(s, ()):
                common[other] = common.get(other, 0) + 1
            index.setdefault(s, []).append(d)
        for other, n in common.items():
            if 5 * n >= 4 * (len(sets[d]) + len(sets[other]) - n):
                join(d, other)
    return {d: root(d) for d in texts}


def bigram_scores(texts: dict, training: set) -> dict:
    """Per document: tokens, known tokens, base score and modified Kneser-Ney score, by plain counting."""
    import collections
    import math

    def toks(text):
        return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER)) + [("end",)]

    count, pair = collections.Counter(), collections.Counter()
    for d in training:
        t = toks(texts[d])
        count.update(t)
        pair.update(zip([("start",), *t[:-1]], t))
    n, v = sum(count.values()), len(count)
    total, follow, before = collections.Counter(), collections.defaultdict(list), collections.Counter()
    for (u, w), c in pair.items():
        total[u] += c
        follow[u].append(c)
        before[w] += 1

    def taken(values):
        k = collections.Counter(values)
        y = k[1] / (k[1] + 2 * k[2])
        d = [0, 1 - 2 * y * k[2] / k[1], 2 - 3 * y * k[3] / k[2], 3 - 4 * y * k[4] / k[3]]
        return [min(max(x, lo), hi) for x, lo, hi in zip(d, (0, 0.01, 0.01, 0.01), (0, 0.99, 1.99, 2.99))]

    two, one = taken(pair.values()), taken(before.values())
    kinds = len(pair)
    spare = sum(one[min(b, 3)] for b in before.values())
    given = {u: sum(two[min(c, 3)] for c in cs) for u, cs in follow.items()}

    def lower(w):
        b = before.get(w, 0)
        return (max(b - one[min(b, 3)], 0) + spare / (v + 1)) / kinds

    out = {}
    for d, text in texts.items():
        t = toks(text)
        base = sum(math.log10((count.get(w, 0) + 1) / (n + v + 1)) for w in t)
        score = 0.0
        for u, w in zip([("start",), *t[:-1]], t):
            if total.get(u):
                c = pair.get((u, w), 0)
                score += math.log10((max(c - two[min(c, 3)], 0) + given[u] * lower(w)) / total[u])
            else:
                score += math.log10(lower(w))
        out[d] = (len(t), sum(w in count for w in t), n, base, score)
    return out
