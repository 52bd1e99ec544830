"""Plain versions of the operators, for small inputs."""

import hashlib
import re
from collections import defaultdict


def edit_distance(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        q = [i]
        for j, y in enumerate(b, 1):
            q.append(min(p[j] + 1, q[-1] + 1, p[j - 1] + (x != y)))
        p = q
    return p[-1]


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if len(words) < 5:
        return frozenset([" ".join(words)] if words else [])
    return frozenset(" ".join(words[i:i + 5]) for i in range(len(words) - 4))


class Union:
    def __init__(self, n):
        self.root = list(range(n))

    def find(self, i):
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return i

    def join(self, i, j):
        i, j = self.find(i), self.find(j)
        self.root[max(i, j)] = min(i, j)


def near_documents(rows, percent):
    """Sorted (doc_id, n_shingles, component_id)."""
    sets, tree, by_shingle, classes = [shingles(t) for _, t in rows], Union(len(rows)), defaultdict(list), {}
    for i, s in enumerate(sets):
        if rows[i][0] is None or not s:
            continue
        if s in classes:
            tree.join(i, classes[s])
            continue
        met = defaultdict(int)
        for g in s:
            for j in by_shingle[g]:
                met[j] += 1
            by_shingle[g].append(i)
        classes[s] = i
        for j, n in met.items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                tree.join(i, j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            r = tree.find(i)
            least[r] = min(least.get(r, d), d)
    return sorted([(d, len(sets[i]), least.get(tree.find(i)) if d is not None else None) for i, (d, _) in enumerate(rows)], key=str)


def near_vectors(rows, threshold=0.9):
    """Sorted (vec_id, n_links, component_id)."""
    import numpy as np

    good = [i for i, (d, v) in enumerate(rows) if d is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links, tree = [0] * len(rows), Union(len(rows))
    for a, i in enumerate(good):
        for j in good[:a]:
            x, y = np.array(rows[i][1], float), np.array(rows[j][1], float)
            if len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold:
                links[i] += 1
                links[j] += 1
                tree.join(i, j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            r = tree.find(i)
            least[r] = min(least.get(r, d), d)
    return sorted([(d, links[i], least[tree.find(i)] if d is not None else None) for i, (d, _) in enumerate(rows)], key=str)


def without_repeats(rows, window=50):
    """Sorted (doc_id, n_bytes, n_removed, n_spans, sha256 of what stays)."""
    first = {}
    for d, t in rows:
        b = (t or "").encode()
        if d is not None:
            for i in range(len(b) - window + 1):
                w = b[i:i + window]
                first[w] = min(first.get(w, d), d)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        if d is not None:
            for i in range(len(b) - window + 1):
                if first[b[i:i + window]] < d:
                    gone[i:i + window] = b"\1" * window
        kept = bytes(x for x, y in zip(b, gone) if not y)
        spans = sum(1 for i in range(len(gone)) if gone[i] and (i == 0 or not gone[i - 1]))
        out.append((d, len(b), len(b) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)
