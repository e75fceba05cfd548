"""BK-trees over 64-bit fingerprints, one per shard, built and searched together with numpy.

Children of a node are keyed by their integer Hamming distance to it. Elements of a shard
start at its root (its first element); in every round each waiting element measures its
distance to the node it stands at, the first to arrive at a (node, distance) becomes the
child there and the others move on to it. A search follows only edges d' with
|d' - d| <= radius, where d is the distance to the node.
"""

from __future__ import annotations

import numpy as np

FRONTIER = 1 << 21


class BkForest:
    def __init__(self, fps: np.ndarray, shard: np.ndarray):
        """``fps``: unsigned 64-bit, distinct inside a shard; ``shard``: ascending numbers."""
        self.fps = fps
        self.root = np.searchsorted(shard, shard)
        n = len(fps)
        parent, edge = np.full(n, -1, np.int64), np.zeros(n, np.int64)
        waiting = np.flatnonzero(self.root != np.arange(n))
        at = self.root[waiting]
        while len(waiting):
            d = np.bitwise_count(fps[waiting] ^ fps[at]).astype(np.int64)
            _, first, spot = np.unique(at * 65 + d, return_index=True, return_inverse=True)
            child = waiting[first]
            parent[child], edge[child] = at[first], d[first]
            stay = np.ones(len(waiting), bool)
            stay[first] = False
            waiting, at = waiting[stay], child[spot[stay]]
        self.nodes = np.flatnonzero(parent >= 0)
        keys = parent[self.nodes] * 65 + edge[self.nodes]
        order = np.argsort(keys, kind="stable")
        self.nodes, self.keys = self.nodes[order], keys[order]

    def _search(self, queries: np.ndarray, radius: int) -> list[tuple[np.ndarray, np.ndarray]]:
        found, todo = [], [(queries, self.root[queries])]
        while todo:
            q, node = todo.pop()
            if len(q) > FRONTIER:
                half = len(q) // 2
                todo += [(q[:half], node[:half]), (q[half:], node[half:])]
                continue
            d = np.bitwise_count(self.fps[q] ^ self.fps[node]).astype(np.int64)
            hit = (d <= radius) & (node != q)
            if hit.any():
                found.append((q[hit], node[hit]))
            lo = np.searchsorted(self.keys, node * 65 + np.maximum(d - radius, 0), "left")
            hi = np.searchsorted(self.keys, node * 65 + np.minimum(d + radius, 64), "right")
            many = hi - lo
            if total := int(many.sum()):
                starts = np.repeat(lo - np.concatenate(([0], np.cumsum(many)[:-1])), many)
                todo.append((np.repeat(q, many), self.nodes[starts + np.arange(total)]))
        return found

    def components(self, radius: int, block: int = 4096) -> np.ndarray:
        """For each element the smallest element number that links of at most ``radius`` bits reach in its shard."""
        label = np.arange(len(self.fps))
        for k in range(0, len(self.fps), block):
            for a, b in self._search(np.arange(k, min(k + block, len(self.fps))), radius):
                while True:
                    la, lb = label[a], label[b]
                    open_ = la != lb
                    if not open_.any():
                        break
                    a, b, la, lb = a[open_], b[open_], la[open_], lb[open_]
                    np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
                    while (label[label] != label).any():
                        label = label[label]
        return label
