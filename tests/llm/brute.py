"""Plain, quadratic or dictionary-based versions of the operators."""

from __future__ import annotations

import re
import zlib
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4)))


def near_duplicates(rows, num=85, den=100):
    """doc_id -> (n_shingles, component): links by counting over an inverted index."""
    sets = {i: shingles(t) for i, t in rows}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    index = defaultdict(list)
    for i in sorted(sets):
        common = defaultdict(int)
        for s in sets[i]:
            for j in index[s]:
                common[j] += 1
            index[s].append(i)
        for j, c in common.items():
            if den * c >= num * (len(sets[i]) + len(sets[j]) - c):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), root(i)) for i in sets}


def repeated_words(rows, least=50):
    """doc_id -> (positions of words in a run that another document has, those that a smaller doc_id has)."""
    places = defaultdict(list)
    for i, t in sorted(r for r in rows if r[1] is not None):
        w = WORD.findall(t)
        for k in range(len(w) - least + 1):
            places[tuple(w[k : k + least])].append((i, k))
    shared, later = defaultdict(set), defaultdict(set)
    for at in places.values():
        if len({i for i, _ in at}) < 2:
            continue
        for i, k in at:
            shared[i].update(range(k, k + least))
            if i != min(at)[0]:
                later[i].update(range(k, k + least))
    return shared, later


def spans_words(rows):
    """The same from span rows (doc_id, start_word, end_word, removed)."""
    shared, later = defaultdict(set), defaultdict(set)
    for r in rows:
        words = range(r["start_word"], r["end_word"])
        shared[r["doc_id"]].update(words)
        if r["removed"]:
            later[r["doc_id"]].update(words)
    return shared, later


def crc(ids):
    return zlib.crc32(b"".join(int(i).to_bytes(4, "little") for i in ids))
