"""BK-trees over fingerprints: a child hangs at its parent under their Hamming distance.

A forest holds one tree for each shard and is built and searched level by level for all
shards of a batch at once.
"""

from __future__ import annotations

import numpy as np

#: (query, node) pairs looked at together; bounds the memory of a search.
_FRONTIER = 1 << 20


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits of rows of 64-bit words."""
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


class Forest:
    """``words``: one row of uint64 words for each fingerprint; ``shard``: which tree it is in."""

    def __init__(self, words: np.ndarray, shard: np.ndarray):
        self.words, n = words, len(words)
        self.span = 64 * words.shape[1] + 1
        parent, key = np.full(n, -1), np.full(n, -1)
        self.shards, first = np.unique(shard, return_index=True)
        self.roots = first
        at = first[np.searchsorted(self.shards, shard)]
        left = np.flatnonzero(at != np.arange(n))
        while len(left):
            d = distance(words[left], words[at[left]])
            edge = at[left] * self.span + d
            # the first of those that share (node, distance) becomes the child, the others go below it
            _, where, group = np.unique(edge, return_index=True, return_inverse=True)
            child = left[where]
            parent[child], key[child] = at[child], d[where]
            at[left] = child[group]
            left = left[at[left] != left]
        kids = np.flatnonzero(parent >= 0)
        edges = parent[kids] * self.span + key[kids]
        order = np.argsort(edges, kind="stable")
        self.kids, self.edges = kids[order], edges[order]

    def within(self, words: np.ndarray, shard: np.ndarray, radius: int):
        """Yield (query rows, node rows) at most ``radius`` apart, in parts of bounded size."""
        if not len(self.shards) or not len(words):
            return
        spot = np.minimum(np.searchsorted(self.shards, shard), len(self.shards) - 1)
        start = np.flatnonzero(self.shards[spot] == shard)
        stack = [(start, self.roots[spot[start]])]
        while stack:
            query, node = stack.pop()
            if len(query) > _FRONTIER:
                half = len(query) // 2
                stack += [(query[half:], node[half:]), (query[:half], node[:half])]
                continue
            d = distance(words[query], self.words[node])
            near = d <= radius
            if near.any():
                yield query[near], node[near]
            low = np.searchsorted(self.edges, node * self.span + np.maximum(d - radius, 0))
            high = np.searchsorted(self.edges, node * self.span + np.minimum(d + radius, self.span - 1), side="right")
            count = high - low
            # children of many pairs at once may be more than fit: take the pairs in parts
            ends = np.cumsum(count)
            if not len(ends) or not ends[-1]:
                continue
            cuts = np.searchsorted(ends, np.arange(_FRONTIER, ends[-1], _FRONTIER))
            for part in np.split(np.arange(len(count)), np.unique(cuts)):
                many = count[part]
                if total := int(many.sum()):
                    step = np.arange(total) - np.repeat(np.cumsum(many) - many, many)
                    stack.append((np.repeat(query[part], many), self.kids[np.repeat(low[part], many) + step]))


def merged(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Join the classes of ``a`` and ``b`` pairwise; a class is named by its smallest member."""
    while True:
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        open_ = low < high
        if not open_.any():
            return label
        a, b, low, high = a[open_], b[open_], low[open_], high[open_]
        np.minimum.at(label, high, low)
        while True:  # follow names to the smallest one
            up = label[label]
            if (up == label).all():
                break
            label = up
