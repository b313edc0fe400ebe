"""Plain, slow versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter

import xxhash


def words(text):
    return re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())


def sha(text: bytes) -> str:
    return hashlib.sha256(text).hexdigest()


def components(n, linked):
    """Least index of each item's group; ``linked(i, j)`` says whether two are linked."""
    top = list(range(n))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                top[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def simhash(text, shingle=3):
    w = words("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    k = min(shingle, len(w))
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + k]), 42) for i in range(len(w) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def substring_dedup(docs, window=13):
    """docs: [(id, text)]; ids may be None (smallest). [(id, n_words, n_removed, sha)]"""
    key = lambda d: (d is not None, d if d is not None else 0)
    first = {}
    for d, t in docs:
        w = words(t)
        for i in range(len(w) - window + 1):
            k = b" ".join(w[i : i + window])
            first[k] = min(first.get(k, key(d)), key(d))
    out = []
    for d, t in docs:
        w = words(t)
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if first[b" ".join(w[i : i + window])] < key(d):
                gone[i : i + window] = [True] * window
        kept = [x for x, g in zip(w, gone) if not g]
        out.append((d, len(w), len(w) - len(kept), sha(b" ".join(kept))))
    return out


def line_dedup(docs, min_chars=40, min_docs=5):
    key = lambda d: (d is not None, d if d is not None else 0)

    def norm(line):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\f\r"))

    held = {}
    for d, t in docs:
        for line in (t or "").split("\n"):
            if len(norm(line)) >= min_chars:
                held.setdefault(norm(line), set()).add(key(d))
    out = []
    for d, t in docs:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(held.get(norm(x), ())) < min_docs or key(d) == max(held[norm(x)])]
        out.append((d, len(lines), len(lines) - len(kept), sha("\n".join(kept).encode())))
    return out


def base_statistics(text):
    w, t = words(text), text or ""
    lines = [x for x in t.split("\n") if words(x)]
    triples = list(zip(w, w[1:], w[2:]))
    n, again = Counter(triples), [False] * len(w)
    for i, x in enumerate(triples):
        if n[x] > 1:
            again[i : i + 3] = [True] * 3
    rep = sum(again)
    return (len(w), sum(len(x.decode()) for x in w), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), rep, len(w) < 50 or 100 * rep > 50 * len(w))


def targets(sizes, weights=(5, 2, 1), most=3):
    """{source: target} by resharing what lies over the caps until nothing does."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    got, active, left = dict.fromkeys(order, 0.0), {s for s in order if sizes[s]}, float(sum(sizes.values()))
    while active:
        level = left / sum(w[s] for s in active)
        over = {s for s in active if level * w[s] > most * sizes[s]}
        for s in over or active:
            got[s] = float(most * sizes[s]) if over else level * w[s]
            left -= got[s]
        active -= over or set(active)
    return got


def crc(ids) -> int:
    return zlib.crc32(b"".join(int(x).to_bytes(4, "little") for x in ids))
