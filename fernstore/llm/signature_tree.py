"""Similarity join of token sets inside one group by a dual traversal of signature trees.

A set's tokens are hashed to the places of a bitmap. A node of a tree covers up to ``LEAF`` sets of similar
size (or up to ``FANOUT`` nodes) and holds the smallest and largest size, the OR of the bitmaps, and for each place the
most tokens that one set below has there. No set under one node can share more tokens with a set under another
than the sum, over the places in both bitmaps, of the smaller of these two numbers; a node pair that can't reach
the overlap that its smallest sizes need is left out with all below it. Leaf pairs that remain are verified
exactly, as products of 0/1 matrices over the tokens of one leaf.

Only the links needed to connect are returned: node pairs whose sets already belong together are passed over.
"""

from __future__ import annotations

import numpy as np

LEAF = 64
FANOUT = 8


class Forest:
    """Union-find with path halving. ``known``: labels of what belongs together from the start."""

    def __init__(self, n: int, known: np.ndarray | None = None):
        self.up = np.arange(n)
        if known is not None and n:
            _, first, label = np.unique(known, return_index=True, return_inverse=True)
            self.up = first[label]

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return int(x)

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x != y:
            self.up[max(x, y)] = min(x, y)
        return x != y


class Node:
    __slots__ = ("below", "bits", "high", "least", "members", "most")

    def __init__(self, members: np.ndarray, below: list[Node], least: int, most: int, bits: np.ndarray, high: np.ndarray):
        self.members, self.below, self.least, self.most, self.bits, self.high = members, below, least, most, bits, high


def needed(a: int, b: int, percent: int) -> int:
    """The smallest overlap with which sets of sizes a and b reach the similarity: 100 i >= percent (a + b - i)."""
    return -(-percent * (a + b) // (100 + percent))


def build(sets: list[np.ndarray], chosen: np.ndarray, width: int) -> Node:
    """The tree over the chosen sets, which must not be empty; ``width`` places, a power of two."""
    sizes = np.array([len(sets[i]) for i in chosen])
    first = np.array([sets[i][0] for i in chosen], dtype=np.uint64)
    chosen = chosen[np.lexsort((first, sizes))]  # equal sizes: near copies often share their smallest token
    level = []
    for k in range(0, len(chosen), LEAF):
        members = chosen[k : k + LEAF]
        high = np.zeros(width, dtype=np.int32)
        for i in members:
            np.maximum(high, np.bincount((sets[i] & np.uint64(width - 1)).astype(np.int64), minlength=width), out=high)
        own = [len(sets[i]) for i in members]
        level.append(Node(members, [], min(own), max(own), np.packbits(high > 0), high))
    while len(level) > 1:
        level = [
            Node(np.concatenate([x.members for x in part]), part, min(x.least for x in part), max(x.most for x in part), np.bitwise_or.reduce([x.bits for x in part]), np.maximum.reduce([x.high for x in part]))
            for part in (level[k : k + FANOUT] for k in range(0, len(level), FANOUT))
        ]
    return level[0]


def may_link(x: Node, y: Node, percent: int) -> bool:
    """Whether some set under x could be similar enough to some set under y."""
    if 100 * x.most < percent * y.least or 100 * y.most < percent * x.least:
        return False
    need = needed(x.least, y.least, percent)
    if not (x.bits & y.bits).any():
        return need <= 0
    return int(np.minimum(x.high, y.high).sum()) >= need  # 0 outside the common bits


def verified(sets: list[np.ndarray], x: np.ndarray, y: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions in x and y of the pairs that are similar enough, exactly."""
    tokens = np.unique(np.concatenate([sets[i] for i in x]))
    shared = np.zeros((len(x), len(y)), dtype=np.int64)
    step = max(1, (1 << 21) // max(len(x), len(y)))  # bounds the matrices for very long sets
    for k in range(0, len(tokens), step):
        part = tokens[k : k + step]

        def rows(members: np.ndarray, part: np.ndarray = part) -> np.ndarray:
            out = np.zeros((len(members), len(part)), dtype=np.float32)
            for r, i in enumerate(members):
                own = sets[i]
                at = np.minimum(np.searchsorted(part, own), len(part) - 1)
                out[r, at[part[at] == own]] = 1
            return out

        a = rows(x)
        shared += np.rint(a @ (a if x is y else rows(y)).T).astype(np.int64)
    total = np.array([len(sets[i]) for i in x])[:, None] + np.array([len(sets[i]) for i in y])[None]
    return np.nonzero(100 * shared >= percent * (total - shared))


def links(sets: list[np.ndarray], percent: int = 75, left: np.ndarray | None = None, right: np.ndarray | None = None, known: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Pairs of positions that connect all sets which links connect: a spanning forest of the links.

    ``sets``: sorted arrays of distinct tokens (uint64). With ``left`` and ``right``, only links between these two
    groups of positions count; else links among all. Empty sets link with nothing. ``known`` labels sets that belong
    together already, whose links aren't looked for.
    """
    whole = np.array([i for i, s in enumerate(sets) if len(s)], dtype=np.int64)
    left = whole if left is None else left
    if len(left) == 0 or (right is not None and len(right) == 0):
        return []
    longest = max(len(sets[i]) for i in whole)
    width = 64
    while width < 4 * longest and width < 1 << 14:
        width *= 2
    a = build(sets, left, width)
    b = a if right is None else build(sets, right, width)
    forest, found = Forest(len(sets), known), []
    stack = [(a, b)]
    while stack:
        x, y = stack.pop()
        if x is y:
            if x.below:
                # nearest pairs last, so that they come off the stack first and connect early
                n = len(x.below)
                stack += [(x.below[i], x.below[j]) for i, j in sorted(((i, j) for i in range(n) for j in range(i, n)), key=lambda p: p[0] - p[1])]
                continue
        elif not may_link(x, y, percent):
            continue
        roots = {forest.find(i) for i in x.members}
        if len(roots) == 1 and all(forest.find(i) in roots for i in y.members):
            continue
        if x.below or y.below:
            stack += [(u, v) for u in (x.below or [x]) for v in (y.below or [y])]
            continue
        for i, j in zip(*verified(sets, x.members, y.members, percent), strict=True):
            p, q = int(x.members[i]), int(y.members[j])
            if p != q and forest.join(p, q):
                found.append((p, q))
    return found
