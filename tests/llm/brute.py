"""Plain models of the operators of this subpackage, for comparison on small inputs."""

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, size):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def reachable(ids, links):
    up = {i: i for i in ids}

    def top(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return {i: top(i) for i in ids}


def near(rows, size, percent):
    """{id: (n_shingles, component)} of (id, text) rows."""
    sets = {i: shingles(t, size) for i, t in rows}
    where = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            where[x].append(i)
    common = Counter()
    for ids in where.values():
        for k, a in enumerate(ids):
            for b in ids[k + 1 :]:
                common[a, b] += 1
    links = [(a, b) for (a, b), n in common.items() if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n)]
    found = reachable(sets, links)
    return {i: (len(sets[i]), found[i]) for i in sets}


def removed(texts, length):
    """[(n_bytes, n_removed, n_spans, sha256 of the rest)] of texts."""
    raw = [(t or "").encode() for t in texts]
    starts = Counter(hash(r[k : k + length]) for r in raw for k in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = np.zeros(len(r) + 1, bool)
        for k in range(len(r) - length + 1):
            if starts[hash(r[k : k + length])] > 1:
                gone[k : k + length] = True
        spans = int((np.diff(gone.astype(np.int8), prepend=0) == 1).sum())
        kept = bytes(np.frombuffer(r, np.uint8)[~gone[:-1]])
        out.append((len(r), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def linked_vectors(rows, floor):
    """{id: (n_links, component)} of (id, vector, label) rows with distinct ids."""
    groups = defaultdict(list)
    for i, v, label in rows:
        if v is None or label is None or any(x is None for x in v):
            continue
        v = np.array(v, np.float64)
        n = np.sqrt((v * v).sum())
        if len(v) and np.isfinite(n) and n > 0:
            groups[label, len(v)].append((i, v / n))
    links = []
    for members in groups.values():
        m = np.array([v for _, v in members])
        hit = np.argwhere(np.triu(m @ m.T >= floor, 1))
        links += [(members[a][0], members[b][0]) for a, b in hit]
    degree = Counter(x for pair in links for x in pair)
    found = reachable([r[0] for r in rows], links)
    return {r[0]: (degree[r[0]], found[r[0]]) for r in rows}
