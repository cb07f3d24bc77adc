"""BK-trees over 64-bit fingerprints, as arrays.

A forest holds many trees at once, one for each group of a batch, and is built and searched level by
level over whole arrays: a child hangs on its parent under the integer Hamming distance of the two,
at most one child a distance, and a search follows only the edges whose distance differs by no more
than the radius from the query's distance to the node.
"""

from __future__ import annotations

import numpy as np

BITS = 64


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int64)


class Forest:
    def __init__(self, codes: np.ndarray, group: np.ndarray):
        """codes: uint64, without repeats inside a group; group: dense ids, 0..g-1."""
        n = len(codes)
        self.codes = codes
        groups = int(group.max()) + 1 if n else 0
        self.roots = np.full(groups, -1, np.int64)
        #: The edge of each node to its parent; a node's children are kids[first[node]:first[node + 1]].
        self.edge = np.zeros(n, np.int64)
        above = np.full(n, -1, np.int64)
        first = np.unique(group, return_index=True)[1] if n else np.zeros(0, np.int64)
        if n:
            self.roots[group[first]] = first
        child = np.full((n, BITS + 1), -1, np.int32)
        placed = np.zeros(n, bool)
        placed[first] = True
        left = np.flatnonzero(~placed)
        parent = self.roots[group[left]] if n else left
        while len(left):
            d = distance(codes[left], codes[parent])
            _, at = np.unique(parent * (BITS + 1) + d, return_index=True)
            child[parent[at], d[at]] = left[at]
            above[left[at]], self.edge[left[at]] = parent[at], d[at]
            rest = np.ones(len(left), bool)
            rest[at] = False
            parent = child[parent, d][rest].astype(np.int64)
            left = left[rest]
        self.kids = np.argsort(above, kind="stable")[int((above < 0).sum()) :]
        self.first = np.searchsorted(above[self.kids], np.arange(n + 1))

    def search(self, codes: np.ndarray, group: np.ndarray, radius: int):
        """Yields arrays (query, node) of the pairs at most `radius` apart."""
        query = np.flatnonzero(self.roots[group] >= 0)
        node = self.roots[group[query]]
        while len(query):
            d = distance(codes[query], self.codes[node])
            near = d <= radius
            yield query[near], node[near]
            many = self.first[node + 1] - self.first[node]
            child = self.kids[np.repeat(self.first[node] - np.cumsum(many) + many, many) + np.arange(many.sum())]
            follow = np.abs(self.edge[child] - np.repeat(d, many)) <= radius
            query, node = np.repeat(query, many)[follow], child[follow]


def spanning_links(codes: np.ndarray, group: np.ndarray, tree: np.ndarray, radius: int, block: int = 1024):
    """Links that join each group's codes as its pairs within the radius do, one a code at most.

    tree: which rows are nodes of the trees; all rows are queries. Pairs go into a union-find at
    once and are not kept, so a group of n codes gives at most n - 1 links, not n^2.
    """
    nodes = np.flatnonzero(tree)
    forest = Forest(codes[nodes], group[nodes]) if len(nodes) else None
    root = np.arange(len(codes))
    if forest is None:
        return root
    if len(forest.roots) <= group.max():
        grown = np.full(int(group.max()) + 1, -1, np.int64)
        grown[: len(forest.roots)] = forest.roots
        forest.roots = grown
    for start in range(0, len(codes), block):
        rows = np.arange(start, min(start + block, len(codes)))
        for q, n in forest.search(codes[rows], group[rows], radius):
            a, b = rows[q], nodes[n]
            root = _united(root, a, b)
    return root


def _united(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The union-find after joining a[i] with b[i]: least-root hooking and pointer jumping."""
    while True:
        ra, rb = root[a], root[b]
        differ = ra != rb
        if not differ.any():
            return root
        a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
