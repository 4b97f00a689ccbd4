"""Forests of BK-trees over bit fingerprints, built and searched level by level with numpy.

A child hangs below its parent on the edge numbered by their Hamming distance. A search at distance d from a node and with radius r follows
only the edges d-r to d+r: by the triangle inequality no other subtree holds anything within the radius. All trees of a forest and all queries
advance together, one level at a time, which gives the same trees and answers as inserting and searching one by one. What hangs on an edge and is no more than a
bucket is not made a tree: its items stand next to each other and are all looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_EDGE = 1 << 16
BUCKET = 96  # items below an edge that are not worth a tree
WHOLE, ROWS = 4096, 4096  # pairs of a bucket and its queries that are worth a block of their own, and queries of a block


def hamming(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Differing bits, row by row."""
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int32)


class Forest:
    """Trees over the items: tree[i] names the tree of item i, which enters it in the order of i. Items of equal print share a node.

    compared counts the distances that searches computed.
    """

    def __init__(self, tree: np.ndarray, prints: np.ndarray, bucket: int = BUCKET):
        self.compared = 0
        self.tree_labels, which = np.unique(tree, return_inverse=True)
        # An entry stands for what hangs on an edge: a node, or a bucket. The first entries are the trees themselves.
        left, entry = np.arange(len(tree)), which.reshape(-1).astype(np.int64)
        n_entries = len(self.tree_labels)
        keys: list[np.ndarray] = []
        node_of_entry: list[np.ndarray] = []
        first_new = 0
        items: list[np.ndarray] = []
        owners: list[np.ndarray] = []
        while n_entries > first_new:
            many = np.bincount(entry - first_new, minlength=n_entries - first_new)
            small = many[entry - first_new] <= bucket
            items.append(left[small])
            owners.append(entry[small])
            left, entry = left[~small], entry[~small]
            nodes, where = np.unique(entry, return_index=True)
            node = np.full(n_entries - first_new, -1, np.int64)
            node[nodes - first_new] = left[where]  # the first to enter
            node_of_entry.append(node)
            d = hamming(prints[left], prints[node[entry - first_new]]).astype(np.int64)
            same = d == 0
            items.append(left[same])
            owners.append(entry[same])
            left, entry, d = left[~same], entry[~same], d[~same]
            edges, which = np.unique(entry * _EDGE + d, return_inverse=True)
            keys.append(edges)
            first_new, n_entries = n_entries, n_entries + len(edges)
            entry = first_new + which.reshape(-1).astype(np.int64)
        # Entries are numbered in the order of their parents and edges, level by level, so the children of an edge range are a range of entries.
        self.node = np.concatenate(node_of_entry) if node_of_entry else np.zeros(0, np.int64)
        self.keys, self.roots = np.concatenate([np.zeros(0, np.int64), *keys]), len(self.tree_labels)
        order = np.lexsort((np.concatenate([np.zeros(0, np.int64), *items]), owner := np.concatenate([np.zeros(0, np.int64), *owners])))
        self.items = np.concatenate([np.zeros(0, np.int64), *items])[order]
        owner = owner[order]
        self.start, self.place = np.searchsorted(owner, np.arange(n_entries + 1)), owner << 32 | self.items
        self.item_prints, self.node_prints = prints[self.items], prints[np.maximum(self.node, 0)]

    def within(self, tree: np.ndarray, prints: np.ndarray, radius: np.ndarray, before: np.ndarray, block: int = 1 << 15) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Query number, item, distance of all items within the queries' radii whose number is smaller than before[query]."""
        for low in range(0, len(tree) if self.roots else 0, block):
            q = np.arange(low, min(low + block, len(tree)), dtype=np.int32)
            at = np.searchsorted(self.tree_labels, tree[q])
            there = self.tree_labels[np.minimum(at, self.roots - 1)] == tree[q]
            q, entry = q[there], at[there]
            while len(q):
                node = self.node[entry]
                yield from self._bucket(q[node < 0], entry[node < 0], prints, radius, before)
                keep = (node >= 0) & (node < before[q])  # items below a node entered after it
                q, entry = q[keep], entry[keep]
                d = hamming(prints[q], self.node_prints[entry]).astype(np.int64)
                self.compared += len(q)
                hit = d <= radius[q]
                yield from self._equal(q[hit], entry[hit], d[hit], before)
                first = np.searchsorted(self.keys, entry * _EDGE + np.maximum(d - radius[q], 1), "left")
                last = np.searchsorted(self.keys, entry * _EDGE + np.minimum(d + radius[q], _EDGE - 1), "right")
                q, entry = _expanded(q, first, last)
                entry += self.roots

    def _bucket(self, q: np.ndarray, entry: np.ndarray, prints: np.ndarray, radius: np.ndarray, before: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        order = np.lexsort((before[q], entry))
        q, entry = q[order], entry[order]
        groups = np.flatnonzero(np.r_[len(entry) > 0, entry[1:] != entry[:-1]])
        visits = np.diff(np.r_[groups, len(entry)])
        whole = visits * (self.start[entry[groups] + 1] - self.start[entry[groups]]) >= WHOLE
        for a, n in zip(groups[whole].tolist(), visits[whole].tolist(), strict=True):
            for low in range(a, a + n, step := max(1, min(ROWS, max(32, n // 8)))):
                yield from self._block(q[low : min(low + step, a + n)], int(entry[a]), prints, radius, before)
        rest = np.repeat(~whole, visits)
        q, entry = q[rest], entry[rest]
        first, last = self.start[entry], np.searchsorted(self.place, entry << 32 | before[q], "left")  # items of an entry stand in their order
        size = np.cumsum(last - first)
        low = 0
        while low < len(q):
            high = max(low + 1, int(np.searchsorted(size, (size[low - 1] if low else 0) + (1 << 18), "right")))
            at, place = _expanded(q[low:high], first[low:high], last[low:high])
            d = hamming(prints[at], self.item_prints[place])
            self.compared += len(at)
            hit = np.flatnonzero(d <= radius[at])
            if len(hit):
                yield at[hit], self.items[place[hit]], d[hit]
            low = high

    def _block(self, q: np.ndarray, entry: int, prints: np.ndarray, radius: np.ndarray, before: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """A bucket and queries in the order of what they are before: all of them with all items up to the last query's."""
        items = slice(self.start[entry], np.searchsorted(self.place, entry << 32 | int(before[q[-1]]), "left"))
        x, y = prints[q], self.item_prints[items]
        d = np.zeros((len(x), len(y)), np.uint16)
        for w in range(x.shape[1]):
            d += np.bitwise_count(x[:, w, None] ^ y[None, :, w])
        self.compared += d.size
        at, place = np.nonzero(d <= radius[q, None])
        item = self.items[items][place]
        keep = item < before[q[at]]
        if keep.any():
            at, place = at[keep], place[keep]
            yield q[at], item[keep], d[at, place].astype(np.int32)

    def _equal(self, q: np.ndarray, entry: np.ndarray, d: np.ndarray, before: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        at, place = _expanded(np.arange(len(q)), self.start[entry], self.start[entry + 1])
        item, q, d = self.items[place], q[at], d[at]
        keep = item < before[q]
        if keep.any():
            yield q[keep], item[keep], d[keep]


def _expanded(q: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each q with every number from its first up to its last."""
    many = last - first
    return np.repeat(q, many), np.repeat(first - np.cumsum(many) + many, many) + np.arange(int(many.sum()))
