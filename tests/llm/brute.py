"""Plain versions of the operators' contracts, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")


def shingles(t, n=5):
    w = re.findall(r"[^\x20\x09-\x0d]+", low(t))
    return frozenset(tuple(w[i : i + n]) for i in range(max(len(w) - n + 1, 1))) if w else frozenset()


def components(nodes, links):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near(texts):
    s = {i: shingles(t) for i, t in texts.items()}
    ids = sorted(i for i in s if s[i])
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if 100 * len(s[a] & s[b]) >= 75 * len(s[a] | s[b])]
    return s, components(s, links)


def repeats(texts, n):
    count = Counter(b[i : i + n] for b in texts for i in range(len(b) - n + 1))
    out = []
    for b in texts:
        cover = [False] * len(b)
        for i in range(len(b) - n + 1):
            if count[b[i : i + n]] > 1:
                cover[i : i + n] = [True] * n
        kept = bytes(c for c, gone in zip(b, cover, strict=True) if not gone)
        spans = sum(gone and (i == 0 or not cover[i - 1]) for i, gone in enumerate(cover))
        out.append((len(b), sum(cover), spans, hashlib.sha256(kept).hexdigest()))
    return out


def contaminated(docs, items, n=13):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    out = {}
    wins = {i: {tuple(w[k : k + n]) for k in range(max(len(w) - n + 1, 1))} if (w := word.findall(low(t))) else set() for i, t in items.items()}
    for d, t in docs.items():
        w = word.findall(low(t))
        hit, found = set(), set()
        for i, ws in wins.items():
            for x in ws:
                for k in range(len(w) - len(x) + 1):
                    if tuple(w[k : k + len(x)]) == x:
                        hit.update(range(k, k + len(x)))
                        found.add(str(i))
        out[d] = (len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w))
    return out


def base_scores(texts):
    tok = {i: re.findall(r"[^\x20\x09-\x0d]+", low(t)) + ["\n"] for i, t in texts.items()}
    c = Counter(w for i, v in tok.items() if zlib.crc32(str(i).encode()) % 5 != 1 for w in v)
    n, v = sum(c.values()), len(c)
    return {i: (len(t), sum(c[w] > 0 for w in t), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)) for i, t in tok.items()}
