"""Numpy on the edges of one bounded group: coded nodes, components, cores, loop-closing edges and growing trees.

Nodes are codes 0 .. n-1 in the order of their ids. All but `grown` is whole-array work in a number of rounds that is
logarithmic in practice; `grown` goes through the edges that join two trees, one by one.
"""

from __future__ import annotations

from array import array

import numpy as np

STEP = 1 << 16  # edges that are Python numbers at a time


def distinct(*values: np.ndarray) -> np.ndarray:
    """Each value once, in order; sorted in place, which takes less memory than the hash table of np.unique."""
    x = np.concatenate(values)
    x.sort()
    return x[np.concatenate([np.ones(min(1, len(x)), bool), x[1:] != x[:-1]])]


def coded(id1: np.ndarray, id2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids in order, codes of id1, codes of id2)."""
    ids = distinct(id1, id2)
    return ids, np.searchsorted(ids, id1).astype(np.int32), np.searchsorted(ids, id2).astype(np.int32)


def _rooted(parent: np.ndarray) -> np.ndarray:
    """Each node's root, of parents without cycles."""
    while True:
        up = parent[parent]
        if np.array_equal(up, parent):
            return parent
        parent = up


def components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node of each node's component."""
    root = np.arange(n, dtype=np.int32)
    while True:
        apart = a != b
        a, b = a[apart], b[apart]
        if not len(a):
            return root
        hook = np.arange(n, dtype=np.int32)
        np.minimum.at(hook, np.maximum(a, b), np.minimum(a, b))
        hook = _rooted(hook)
        a, b, root = hook[a], hook[b], hook[root]


def cores(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The core number of each node, by peeling. Edges are distinct and join different nodes."""
    ends = np.concatenate([a, b])
    near = np.concatenate([b, a])[np.argsort(ends, kind="stable")]
    degree = np.bincount(ends, minlength=n)
    start, left = np.cumsum(degree) - degree, degree.copy()
    core, live, k = np.zeros(n, np.int64), np.ones(n, bool), 0
    while live.any():
        k = max(k, int(left[live].min()))
        front = np.flatnonzero(live & (left <= k))
        while len(front):
            core[front], live[front] = k, False
            many = degree[front]
            hit = near[np.repeat(start[front] - (np.cumsum(many) - many), many) + np.arange(many.sum())]
            hit = hit[live[hit]]
            np.subtract.at(left, hit, 1)
            hit = np.unique(hit)
            front = hit[left[hit] <= k]
    return core


def cyclic(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Places of the edges that are left when nodes of one edge go with it, again and again while that takes many. Only
    these can close a loop, in whatever order edges join."""
    left = np.arange(len(a))
    while len(left):
        degree = np.bincount(a[left], minlength=n) + np.bincount(b[left], minlength=n)
        stay = (degree[a[left]] > 1) & (degree[b[left]] > 1)
        before, left = len(left), left[stay]
        if before - len(left) <= before // 20:
            break
    return left


def joining(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Does an edge join two trees when edges join one by one? By rounds in which each tree takes its first edge."""
    joins, at = np.zeros(len(a), bool), np.arange(len(a))
    while True:
        apart = a != b
        a, b, at = a[apart], b[apart], at[apart]
        m = len(a)
        if not m:
            return joins
        first = np.full(n, m)
        place = np.arange(m)
        np.minimum.at(first, a, place)
        np.minimum.at(first, b, place)
        node = np.flatnonzero(first < m)
        edge = first[node]
        joins[at[edge]] = True
        parent = np.arange(n)
        parent[node] = a[edge].astype(np.int64) + b[edge] - node
        pair = (parent[parent] == np.arange(n)) & (np.arange(n) < parent)  # two that took the same edge
        parent[pair] = np.flatnonzero(pair)
        parent = _rooted(parent)
        code = np.cumsum(parent == np.arange(n)) - 1
        a, b, n = code[parent[a]], code[parent[b]], int(code[-1]) + 1


def closing(n: int, a: np.ndarray, b: np.ndarray, left: np.ndarray | None = None) -> np.ndarray:
    """Are an edge's ends joined by edges before it? left: places of `cyclic` edges, in the order of the edges."""
    left = cyclic(n, a, b) if left is None else left
    closes = np.zeros(len(a), bool)
    ids, x, y = coded(a[left], b[left])
    closes[left] = ~joining(len(ids), x, y)
    return closes


def grown(n: int, a: np.ndarray, b: np.ndarray, closes: np.ndarray, flags: np.ndarray | None = None, each: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(nodes of the largest tree so far, flags of the tree that the edge is in) after each edge.

    each: flags of closing edges too, else only of the edges that join and of those from a node to itself.
    """
    giant, touch = np.ones(len(a), np.int32), np.zeros(len(a), np.int32)
    parent, size = array("i", range(n)), array("i", [1]) * n
    marks = array("i", flags.astype(np.int32).tobytes()) if flags is not None else None
    steps = np.flatnonzero(~closes | ((a == b) | each if marks is not None else False))
    for lo in range(0, len(steps), STEP):
        at = steps[lo : lo + STEP]
        sizes, sides = [], []
        for x, y in zip(a[at].tolist(), b[at].tolist(), strict=True):
            while (p := parent[x]) != x:
                parent[x] = x = parent[p]
            while (p := parent[y]) != y:
                parent[y] = y = parent[p]
            if x != y:
                if size[x] < size[y]:
                    x, y = y, x
                parent[y] = x
                size[x] += size[y]
                if marks is not None:
                    marks[x] |= marks[y]
            sizes.append(size[x])
            if marks is not None:
                sides.append(marks[x])
        giant[at] = sizes
        if marks is not None:
            touch[at] = sides
    return np.maximum.accumulate(giant), touch


def descending(a: np.ndarray, b: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Greatest value first; ties by the nodes, so the order is certain."""
    return np.lexsort((b, a, -value))
