"""Plain versions of the operators, one document after another."""

import re
from itertools import combinations

WORD = re.compile("[a-z0-9\x80-\U0010ffff]+")


def words(text):
    return WORD.findall((text or "").lower())


def grams(text, k, short=True):
    w = words(text)
    if len(w) < k:
        return {tuple(w)} if w and short else set()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def similar(docs, k=3, t=0.55):
    """(a, b) of all pairs of (doc_id, text) at least t alike."""
    sets = [(d, grams(x, k)) for d, x in docs]
    out = set()
    for (a, x), (b, y) in combinations(sets, 2):
        if a != b and x and y and len(x & y) >= t * len(x | y) - 1e-9:
            out.add((min(a, b), max(a, b)))
    return out


def keep_one(docs):
    root = {d: d for d, _ in docs}

    def up(d):
        while root[d] != d:
            d = root[d]
        return d

    for a, b in similar(docs):
        a, b = sorted((up(a), up(b)))
        root[b] = a
    return [(d, x) for d, x in docs if up(d) == d]


def copied_words(docs, n=50):
    """For each document the places of words that an earlier place, by (doc_id, word), has in a run of n."""
    seen, out = {}, {}
    for d, x in sorted(docs):
        w = words(x)
        for i in range(len(w) - n + 1):
            first = seen.setdefault(tuple(w[i : i + n]), (d, i))
            if first != (d, i):
                out.setdefault(d, set()).update(range(i, i + n))
    return out


def cut(text, gone):
    found = list(re.finditer("[A-Za-z0-9\x80-\U0010ffff]+", text))
    edges = [m.start() for m in found] + [len(text)]
    parts = [text[: edges[0]]] + [text[edges[i] : edges[i + 1]] for i in range(len(found)) if i not in gone]
    return "".join(parts), len(gone) < len(found)


def holds(text, item, k=5, t=0.6):
    own = grams(item, k, short=False)
    return bool(own) and len(own & grams(text, k, short=False)) >= t * len(own)
