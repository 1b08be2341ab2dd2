"""Plain Python versions of the operators, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or ""))


def words(text):
    return re.findall(WORD, low(text))


def exact(docs):
    groups = defaultdict(list)
    for k, t in docs:
        groups[re.sub(SPACE, " ", t or "")].append(k)
    return sorted((k, min(g), len(g), k == min(g), hashlib.sha256(n.encode()).hexdigest()) for n, g in groups.items() for k in g)


def repeats(docs, window):
    least, own = {}, []
    for k, t in docs:
        w = [x for x in re.split(SPACE, t or "") if x]
        own.append((k, w))
        for i in range(len(w) - window + 1):
            g = tuple(w[i : i + window])
            least[g] = min(k, least.get(g, k))
    out = []
    for k, w in own:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if least[tuple(w[i : i + window])] < k:
                gone[i : i + window] = [True] * window
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((k, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def leaks(docs, items, window=10):
    seen = defaultdict(set)
    for k, t in items:
        w = words(t)
        n = min(window, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            seen[tuple(w[i : i + n])].add(str(k))
    out = {}
    for k, t in docs:
        w, hit, named = words(t), set(), set()
        for n in {len(x) for x in seen}:
            for i in range(len(w) - n + 1):
                if found := seen.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    named |= found
        out[k] = (len(w), len(hit), sorted(named))
    return out


class Groups:
    def __init__(self):
        self.up = {}

    def find(self, x):
        self.up.setdefault(x, x)
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = sorted((self.find(a), self.find(b)))
        self.up[b] = a


def shingles(text, size=5):
    w = words(text)
    return Counter(tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))) if w else Counter()


def similarity(x, y):
    both = sum((x & y).values())
    return both / (sum(x.values()) + sum(y.values()) - both)


def near(docs, threshold=0.8):
    """Smallest id of each document's group; texts without words are alone."""
    sets, groups = {k: shingles(t) for k, t in docs}, Groups()
    ids = sorted(sets)
    for i, a in enumerate(ids):
        groups.find(a)
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and similarity(sets[a], sets[b]) >= threshold:
                groups.join(a, b)
    return {k: groups.find(k) for k in ids}


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def alike_lines(docs, threshold=0.8):
    """Removed lines of each document, from all pairs of distinct lines by edit similarity alone."""
    places = [(k, i, tuple(words(x))) for k, t in docs for i, x in enumerate((t or "").split("\n"))]
    distinct = sorted({w for _, _, w in places if w}, key=len)
    bags, groups = [Counter(w) for w in distinct], Groups()
    for i, a in enumerate(distinct):
        groups.find(a)
        for j in range(i + 1, len(distinct)):
            b = distinct[j]
            most = int((1 - threshold) * len(b) + 1e-9)
            if len(b) - len(a) > most:
                break
            # as many words as b has beyond a's take an edit each
            if (bags[j] - bags[i]).total() <= most and edits(a, b) <= most:
                groups.join(a, b)
    lead, out = {}, {k: [] for k, _ in docs}
    for k, i, w in sorted(places, key=lambda p: p[:2]):
        if w and lead.setdefault(groups.find(w), (k, i)) != (k, i):
            out[k].append(i)
    return out
