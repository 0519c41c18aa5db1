"""A BK-tree under the edit distance, built and searched in whole batches.

Nodes are numbered rows of arrays. Building lets all entries fall down the tree at once, level by
level; a search moves a frontier of (query, node) pairs the same way and keeps the children the
triangle inequality allows. Distances of all pairs of a level are computed together with the
bit-parallel algorithm of Myers in Hyyrö's form, one machine word a pattern; longer patterns take the
same steps one by one on integers of any length.
"""

from __future__ import annotations

import numpy as np

WORD = 63  #: longest pattern that fits a machine word
ONE = np.uint64(1)


def _codes(keys: list[str], alphabet: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    lens = np.array([len(k) for k in keys], np.int64)
    out = np.zeros((len(keys), max(1, lens.max(initial=0))), np.int64)
    for i, k in enumerate(keys):
        out[i, : len(k)] = [alphabet.get(c, 0) for c in k]
    return out, lens


def _masks(codes: np.ndarray, lens: np.ndarray, letters: int) -> np.ndarray:
    """Bit masks (pattern, letter): where the letter stands in the pattern."""
    masks = np.zeros((len(codes), letters + 1), np.uint64)
    for j in range(min(codes.shape[1], WORD)):
        live = np.flatnonzero((lens > j) & (codes[:, j] > 0))
        masks[live, codes[live, j]] |= ONE << np.uint64(j)
    return masks


def long_distance(pattern: np.ndarray, text: np.ndarray) -> int:
    """Edit distance of two rows of codes of any length; code 0 equals nothing."""
    if not len(pattern):
        return len(text)
    where: dict[int, int] = {}
    for i, c in enumerate(pattern.tolist()):
        where[c] = where.get(c, 0) | (1 << i)
    where.pop(0, None)
    full, high, score = (1 << len(pattern)) - 1, 1 << (len(pattern) - 1), len(pattern)
    pv, mv = full, 0
    for c in text.tolist():
        eq = where.get(c, 0)
        xv, xh = eq | mv, (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | (full & ~(xh | pv)), pv & xh
        score += bool(ph & high) - bool(mh & high)
        ph, mh = ((ph << 1) | 1) & full, (mh << 1) & full
        pv, mv = mh | (full & ~(xv | ph)), ph & xv
    return score


def distances(masks: np.ndarray, patterns: np.ndarray, lens: np.ndarray, q: np.ndarray, texts: np.ndarray, text_lens: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Edit distance of each pair (pattern q[i], text t[i])."""
    m, n = lens[q], text_lens[t]
    if (long := m > WORD).any():
        out = np.zeros(len(q), np.int64)
        short = ~long
        out[short] = distances(masks, patterns, lens, q[short], texts, text_lens, t[short])
        for i in np.flatnonzero(long):
            out[i] = long_distance(patterns[q[i], : m[i]], texts[t[i], : n[i]])
        return out
    score, high = m.copy(), ONE << np.maximum(m - 1, 0).astype(np.uint64)
    pv, mv = np.full(len(q), ~np.uint64(0)), np.zeros(len(q), np.uint64)
    for j in range(int(n.max(initial=0))):
        eq = masks[q, texts[t, j]]
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph, mh = mv | ~(xh | pv), pv & xh
        live = n > j
        score += (((ph & high) != 0).astype(np.int64) - ((mh & high) != 0)) * live
        ph, mh = (ph << ONE) | ONE, mh << ONE
        pv, mv = mh | ~(xv | ph), ph & xv
    return np.where(m == 0, n, score)


class BKTree:
    """Distinct keys; empty ones are left out and never found."""

    def __init__(self, keys: list[str]):
        self.keys = sorted({k for k in keys if k})
        self.alphabet = {c: i + 1 for i, c in enumerate(sorted({c for k in self.keys for c in k}))}
        self.codes, self.lens = _codes(self.keys, self.alphabet)
        masks, n = _masks(self.codes, self.lens, len(self.alphabet)), len(self.keys)
        parent, edge = np.full(n, -1), np.zeros(n, np.int64)
        order = np.random.default_rng(5).permutation(n)
        at, falling = np.full(n, order[0] if n else -1), order[1:]
        while len(falling):
            d = distances(masks, self.codes, self.lens, falling, self.codes, self.lens, at[falling])
            slot = at[falling] * (int(self.lens.max()) + 1) + d
            _, first = np.unique(slot, return_index=True)
            chosen = falling[first]
            parent[chosen], edge[chosen] = at[chosen], d[first]
            child = dict(zip(slot[first].tolist(), chosen.tolist()))
            at[falling] = [child[s] for s in slot.tolist()]
            falling = np.delete(falling, first)
        self.root = int(order[0]) if n else -1
        self.edge = edge
        self.children = np.argsort(parent, kind="stable")
        self.start = np.searchsorted(parent[self.children], np.arange(n))
        self.stop = np.searchsorted(parent[self.children], np.arange(n), side="right")

    def search(self, queries: list[str], radius: int, block: int = 4096) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query number, key number, distance) of every key within the radius of a query."""
        found = [(np.zeros(0, int),) * 3]
        for lo in range(0, len(queries) if self.keys else 0, block):
            some = queries[lo : lo + block]
            ok = np.array([len(s) > 0 for s in some])
            codes, lens = _codes(some, self.alphabet)
            masks = _masks(codes, lens, len(self.alphabet))
            q = np.flatnonzero(ok)
            node = np.full(len(q), self.root)
            while len(q):
                d = distances(masks, codes, lens, q, self.codes, self.lens, node)
                hit = d <= radius
                found.append((q[hit] + lo, node[hit], d[hit]))
                many = self.stop[node] - self.start[node]
                rep = np.repeat(np.arange(len(q)), many)
                nth = np.arange(len(rep)) - np.repeat(np.cumsum(many) - many, many)
                child = self.children[self.start[node[rep]] + nth]
                near = np.abs(self.edge[child] - d[rep]) <= radius
                q, node = q[rep[near]], child[near]
        return tuple(np.concatenate(x) for x in zip(*found))


class BKForest:
    """A BK-tree for every length of key: a query within a radius meets only trees of near lengths."""

    def __init__(self, keys: list[str]):
        by_length: dict[int, list[str]] = {}
        for k in set(keys):
            by_length.setdefault(len(k), []).append(k)
        self.trees = {n: BKTree(some) for n, some in by_length.items() if n}

    def search(self, queries: list[str], radius: int) -> list[tuple[int, str, int]]:
        """(query number, key, distance) of every key within the radius of a query."""
        by_length: dict[int, list[int]] = {}
        for i, s in enumerate(queries):
            by_length.setdefault(len(s), []).append(i)
        out = []
        for n, tree in self.trees.items():
            at = [i for m in range(n - radius, n + radius + 1) for i in by_length.get(m, ())]
            if at:
                q, k, d = tree.search([queries[i] for i in at], radius)
                out += [(at[a], tree.keys[b], c) for a, b, c in zip(q.tolist(), k.tolist(), d.tolist())]
        return out

    def nearest(self, queries: list[str], radius: int) -> list[tuple[int, str, int]]:
        """(query number, key, distance) of every key at the least distance from a query, if that is
        within the radius. The radius widens step by step, and only for queries without a key so far."""
        out, left = [], list(range(len(queries)))
        for r in range(radius + 1):
            got = self.search([queries[i] for i in left], r)
            out += [(left[i], k, d) for i, k, d in got]
            hit = {i for i, _, _ in got}
            left = [x for i, x in enumerate(left) if i not in hit]
        return out
