"""Forests of BK-trees over 64-bit fingerprints, built and searched level by level in numpy.

A tree's children are keyed by their integer Hamming distance to the parent, as if its items were added one after the
other; a search follows only the edges that the triangle inequality leaves open. All trees of a task grow and are
searched at once: a level of the forest, or a front of (query, node) pairs, is one array operation.
"""

from __future__ import annotations

import numpy as np

_FRONT = 1024


class Forest:
    """trees: the tree (ascending numbers from 0) of each item; keys: its fingerprint, distinct within a tree."""

    def __init__(self, trees: np.ndarray, keys: np.ndarray) -> None:
        n = len(keys)
        self.keys = keys
        self.roots = np.flatnonzero(np.concatenate([[True], trees[1:] != trees[:-1]])) if n else np.zeros(0, np.int64)
        parent, edge, self.levels = np.full(n, -1, np.int64), np.zeros(n, np.int64), [self.roots]
        rest = np.ones(n, bool)
        rest[self.roots] = False
        rest = np.flatnonzero(rest)
        at = self.roots[trees[rest]]
        while len(rest):
            d = np.bitwise_count(keys[rest] ^ keys[at]).astype(np.int64)
            place = at * 65 + d
            order = np.argsort(place, kind="stable")
            first = np.concatenate([[True], place[order][1:] != place[order][:-1]])
            child = rest[order][first]  # the first item that comes to a free edge stays there, the others go on below it
            parent[child], edge[child] = at[order][first], d[order][first]
            self.levels.append(child)
            at = child[np.cumsum(first) - 1][~first]
            rest = rest[order][~first]
        self.below = np.flatnonzero(parent >= 0)
        self.below = self.below[np.argsort(parent[self.below] * 65 + edge[self.below], kind="stable")]
        self.places = parent[self.below] * 65 + edge[self.below]
        self.parent = parent

    def uniform(self, part: np.ndarray) -> np.ndarray:
        """The part that all items at and below each node share, or -1; part: that of each item, or -1."""
        out = part.copy()
        for level in self.levels[:0:-1]:
            up = self.parent[level]
            np.put(out, up[out[level] != out[up]], -1)
        return out

    def within(self, trees: np.ndarray, queries: np.ndarray, radius: int, part: np.ndarray | None = None, closed: np.ndarray | None = None):
        """Yields (query, item, distance) arrays of items within the radius of the queries, each in its tree; subtrees whose
        closed part is the query's own are left out."""
        for a in range(0, len(queries), _FRONT):
            q = np.arange(a, min(a + _FRONT, len(queries)))
            node = self.roots[trees[q]]
            found = []
            while len(q):
                if part is not None:
                    open_ = closed[node] != part[q]
                    open_ |= closed[node] < 0
                    q, node = q[open_], node[open_]
                d = np.bitwise_count(self.keys[node] ^ queries[q]).astype(np.int64)
                near = d <= radius
                if near.any():
                    found.append((q[near], node[near], d[near]))
                low = np.searchsorted(self.places, node * 65 + np.maximum(d - radius, 0))
                high = np.searchsorted(self.places, node * 65 + np.minimum(d + radius, 64), "right")
                n = high - low
                ends = np.cumsum(n)
                total = int(ends[-1]) if len(ends) else 0
                q = np.repeat(q, n)
                node = self.below[np.repeat(low - ends + n, n) + np.arange(total)]
            if found:
                yield tuple(np.concatenate(x) for x in zip(*found))
