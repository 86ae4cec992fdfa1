"""Plain versions of what the operators compute."""

from __future__ import annotations

import collections
import re

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def last(i):
    return float("inf") if i is None else i


def repeated_bytes(rows, window):
    """(id, n_bytes, n_removed, n_spans, kept) of each row (id, text)."""
    texts = [(i, (t or "").encode()) for i, t in rows]
    count = collections.Counter(b[j : j + window] for _, b in texts for j in range(len(b) - window + 1))
    out = []
    for i, b in texts:
        gone = bytearray(len(b))
        for j in range(len(b) - window + 1):
            if count[b[j : j + window]] > 1:
                gone[j : j + window] = b"\1" * window
        out.append((i, len(b), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return out


def repeated_words(rows, window):
    """(id, n_words, n_removed, kept)."""
    texts = [(i, WORD.findall((t or "").encode())) for i, t in rows]
    least = {}
    for i, w in texts:
        for j in range(len(w) - window + 1):
            g = tuple(w[j : j + window])
            least[g] = min(last(i), least.get(g, float("inf")))
    out = []
    for i, w in texts:
        gone = [False] * len(w)
        for j in range(len(w) - window + 1):
            if least[tuple(w[j : j + window])] < last(i):
                gone[j : j + window] = [True] * window
        out.append((i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone, strict=True) if not g).decode()))
    return out


def shingles(text, n):
    low = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    w = WORD.findall(low)
    return frozenset(tuple(w[j : j + n]) for j in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def jaccard_classes(rows, n=5, percent=75):
    """(id, size, least id of the class) of each row."""
    sets = [(last(i), shingles(t, n)) for i, t in rows]
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a][1] & sets[b][1])
            if both and both * 100 >= percent * len(sets[a][1] | sets[b][1]):
                parent[find(a)] = find(b)
    least = {}
    for a, (i, _) in enumerate(sets):
        least[find(a)] = min(i, least.get(find(a), float("inf")))
    return [(rows[a][0], len(s), least[find(a)]) for a, (_, s) in enumerate(sets)]


def within_one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) < len(b):
        a, b = b, a
    i = next((i for i in range(len(b)) if a[i] != b[i]), len(b))
    return a[i + 1 :] == (b[i + 1 :] if len(a) == len(b) else b[i:])


def kept_lines(rows, near_chars):
    """(id, text) with rows in order of id."""
    seen: list[str] = []
    out = []
    for i, t in sorted((r for r in set(rows) if r[1] is not None), key=lambda r: (last(r[0]), r[1])):
        keep = []
        for line in t.split("\n"):
            gone = line.strip(" ") and any(s == line or (len(s) >= near_chars <= len(line) and within_one_edit(s, line)) for s in seen)
            if line.strip(" "):
                seen.append(line)
            if not gone:
                keep.append(line)
        out.append((i, "\n".join(keep)))
    return out
