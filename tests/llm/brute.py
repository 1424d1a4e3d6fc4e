"""Plain Python answers that the operators are held against."""

from __future__ import annotations

import hashlib
import re
import string
from collections import Counter

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
BLANKS = " \t\n\r\v\f"


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def repeated_words(docs, k=20):
    seen, out = set(), {}
    for i, t in sorted(docs, key=lambda d: d[0]):
        w = (t or "").encode().split()
        gone = [False] * len(w)
        for j in range(len(w) - k + 1):
            key = tuple(w[j : j + k])
            if key in seen:
                gone[j : j + k] = [True] * k
            seen.add(key)
        out[i] = (len(w), sum(gone), sha(b" ".join(x for x, g in zip(w, gone) if not g)))
    return out


def repeated_bytes(docs, k=400):
    docs = [(i, (t or "").encode()) for i, t in docs]
    times = Counter(t[j : j + k] for _, t in docs for j in range(len(t) - k + 1))
    out = {}
    for i, t in docs:
        gone = [False] * len(t)
        for j in range(len(t) - k + 1):
            if times[t[j : j + k]] > 1:
                gone[j : j + k] = [True] * k
        kept = bytes(x for x, g in zip(t, gone) if not g)
        spans = sum(g and (not j or not gone[j - 1]) for j, g in enumerate(gone))
        out[i] = (len(t), sum(gone), spans, sha(kept))
    return out


def jaccard_components(docs, k=4, num=85, den=100):
    sets, root = {}, {}
    for i, t in docs:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(i for i in sets if sets[i])
    for n, i in enumerate(ids):
        for j in ids[:n]:
            if den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]) and find(i) != find(j):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return {i: (len(sets[i]), find(i)) for i in sets}


def jaccard_links(docs, k=4, num=85, den=100):
    sets = []
    for i, t in docs:
        w = (t or "").encode().lower().split()
        sets.append((i, {tuple(w[j : j + k]) for j in range(max(1, len(w) - k + 1))} if w else set()))
    return [(i, sum(bool(a and b) and n != m and den * len(a & b) >= num * len(a | b) for m, (_, b) in enumerate(sets))) for n, (i, a) in enumerate(sets)]


def equal_texts(docs):
    groups = {}
    for i, t in docs:
        t = t or ""
        groups.setdefault("".join(c for c in t if c not in BLANKS), []).append((-len(t), i))
    return {i: (min(g)[1], len(g), min(g)[1] == i, sha(n.encode())) for n, g in groups.items() for _, i in g}


def benchmark_hits(docs, items, k=10, reach=20):
    """(id, n_words, n_hit, n_items, items_sha256, contaminated, n_near) of every document."""
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").translate(LOWER))
    windows = {}
    for i, t in items:
        w = words(t)
        for j in range(max(1, len(w) - k + 1) if w else 0):
            windows.setdefault(tuple(w[j : j + k]), set()).add(i)
    rarity = Counter(x for _, t in docs for x in words(t))
    out = []
    for i, t in docs:
        w = words(t)
        hit, near, found = [False] * len(w), set(), set()
        for g, ids in windows.items():
            for j in range(len(w) - len(g) + 1):
                if tuple(w[j : j + len(g)]) == g:
                    hit[j : j + len(g)] = [True] * len(g)
                    found |= ids
            rarest = min(range(len(g)), key=lambda a: (rarity[g[a]], a))
            near |= {p for p, x in enumerate(w) if x == g[rarest] and set(g) <= set(w[max(0, p - reach) : p + reach + 1])}
        near = sum(not hit[p] for p in near)
        shown = ",".join(sorted(str(x) for x in found if x is not None))
        out.append((i, len(w), sum(hit), len(found), sha(shown.encode()), any(hit), near))
    return out


def audit_rows(docs, least=30, top=50):
    """Rows of the source divergence audit of (text, lang, source)."""
    counts, held, out = {}, Counter(), []
    for t, lang, source in docs:
        w = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (t or "").translate(LOWER))
        counts.setdefault((lang or "", source or ""), Counter()).update(w)
        held.update((lang or "", x) for x in set(w))
    for lang in {g[0] for g in counts}:
        kept = [x for (a, x), n in held.items() if a == lang and n >= least]
        own = {s: Counter({x: c[x] for x in kept}) for (a, s), c in counts.items() if a == lang}
        price = lambda c: {x: 1 + 10**9 * (c[x] + 5) // (sum(c[y] for y in kept) + 5 * len(kept)) for x in kept}
        p, q = {s: price(c) for s, c in own.items()}, price(sum(own.values(), Counter()))
        for s in own:
            pairs = [(sum(abs(p[s][x] - p[o][x]) for x in kept), o) for o in own if o != s]
            terms = [(p[s][x] - q[x], x) for x in kept if own[s][x] and p[s][x] > q[x]]
            for part, rows, most in (("pair", pairs, None), ("term", terms, top)):
                rows.sort(key=lambda r: (-r[0], r[1].encode()))
                out += [(lang, s, part, item, value, n) for n, (value, item) in enumerate(rows[:most], 1)]
    return sorted(out)
