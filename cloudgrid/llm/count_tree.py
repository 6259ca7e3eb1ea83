"""An R-tree over count vectors, for pairs of sets that may overlap enough.

The tokens of a set are hashed into GROUPS groups; its point is how many fall in
each. Two sets share at most the sum of the smaller counts of each group, and a
node's upper corner bounds its points the same way, so a pair of nodes whose sum
is too small holds no pair of sets at the threshold.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

GROUPS, LEAF, FULL = 128, 32, 255


def count_vector(hashes: np.ndarray) -> np.ndarray:
    """Counts by group as bytes; FULL stands for that many or more."""
    return np.minimum(np.bincount((hashes >> np.uint64(57)).astype(np.intp), minlength=GROUPS), FULL).astype(np.uint8)


class Sets:
    """Union-find over rows, and the edges that joined them."""

    def __init__(self, n: int):
        self.parent, self.edges = list(range(n)), []

    def find(self, i: int) -> int:
        p = self.parent
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return i

    def join(self, i: int, j: int) -> None:
        a, b = self.find(i), self.find(j)
        if a != b:
            self.parent[b] = a
            self.edges.append((i, j))


def bound(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Summed coordinate minima; where both counts are FULL the group tells nothing, so the sum is unbounded."""
    low = np.minimum(a, b)
    total = low.sum(axis=-1, dtype=np.int64)
    blind = (low == FULL).any(axis=-1)
    return np.where(blind, 1 << 40, total)


def enough(overlap, n_a, n_b, percent: int):
    """100 * overlap >= percent * (n_a + n_b - overlap)."""
    return (100 + percent) * overlap >= percent * (n_a + n_b)


class CountTree:
    """Bulk-loaded: halved at the median of the widest coordinate until LEAF points are left."""

    def __init__(self, counts: np.ndarray, sizes: np.ndarray):
        self.counts, self.sizes = counts, sizes.astype(np.int64)
        self.rows: list[np.ndarray | None] = []
        self.children: list[tuple[int, int] | None] = []
        self.high: list[np.ndarray] = []
        self.least: list[int] = []
        self.root = self._build(np.arange(len(sizes)))

    def _build(self, rows: np.ndarray) -> int:
        points = self.counts[rows]
        kids = None
        if len(rows) > LEAF:
            spread = points.max(axis=0).astype(np.int64) - points.min(axis=0)
            order = np.argsort(self.sizes[rows], kind="stable") if self.sizes[rows].max() > 1.3 * self.sizes[rows].min() else np.argsort(points[:, spread.argmax()], kind="stable")
            half = len(rows) // 2
            kids = self._build(rows[order[:half]]), self._build(rows[order[half:]])
        self.rows.append(None if kids else rows)
        self.children.append(kids)
        self.high.append(points.max(axis=0))
        self.least.append(int(self.sizes[rows].min()))
        return len(self.rows) - 1

    def forest(self, percent: int, verify: Callable[[int, int], bool] | None = None, across: np.ndarray | None = None) -> list[tuple[int, int]]:
        """Edges that connect what pairs at the threshold connect: of bounds, or with verify, of the pairs it confirms.

        Pairs already connected are passed over. across: side of each row; only pairs of two sides are looked at.
        """
        sets, stack = Sets(len(self.sizes)), [(self.root, self.root)]
        while stack:
            a, b = stack.pop()
            if not enough(int(bound(self.high[a], self.high[b])), self.least[a], self.least[b], percent):
                continue
            kids_a, kids_b = self.children[a], self.children[b]
            if kids_a is None and kids_b is None:
                self._leaves(self.rows[a], self.rows[b], a == b, percent, verify, across, sets)
            elif a == b:
                stack += [(kids_a[0], kids_a[1]), (kids_a[1], kids_a[1]), (kids_a[0], kids_a[0])]
            elif kids_b is None or kids_a is not None and len(kids_a) and self.least[a] <= self.least[b]:
                stack += [(k, b) for k in kids_a]
            else:
                stack += [(a, k) for k in kids_b]
        return sets.edges

    def _leaves(self, left, right, same, percent, verify, across, sets) -> None:
        roots = {sets.find(int(i)) for i in left} | {sets.find(int(i)) for i in right}
        if len(roots) == 1:
            return
        for at, i in enumerate(left.tolist()):
            others = right[at + 1 :] if same else right
            if across is not None:
                others = others[across[others] != across[i]]
            if not len(others):
                continue
            hit = others[enough(bound(self.counts[others], self.counts[i]), self.sizes[others], self.sizes[i], percent)]
            for j in hit.tolist():
                if sets.find(i) != sets.find(j) and (verify is None or verify(i, j)):
                    sets.join(i, j)
