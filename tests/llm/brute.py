"""Brute-force counterparts of the operators on small tables."""

import zlib


def crc(i):
    return zlib.crc32(str(i).encode())


def words(text):
    return (text or "").encode().lower().split()


def shingles(text, width=2):
    w = words(text)
    if len(w) < width:
        return frozenset([tuple(w)] if w else [])
    return frozenset(zip(*(w[i:] for i in range(width))))


class Sets:
    """Disjoint sets whose name is their smallest member."""

    def __init__(self, items):
        self.up = {i: i for i in items}

    def find(self, x):
        while self.up[x] != x:
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def near_components(texts, width=2, similarity=80):
    """Smallest id that each id of {id: text} reaches."""
    s = {i: shingles(t, width) for i, t in texts.items()}
    sets, ids = Sets(s), sorted(s)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if s[a] and s[b]:
                common = len(s[a] & s[b])
                if 100 * common >= similarity * (len(s[a]) + len(s[b]) - common):
                    sets.join(a, b)
    return {i: sets.find(i) for i in ids}
