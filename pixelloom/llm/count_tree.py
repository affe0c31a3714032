"""A count-vector R-tree.

Sets of token hashes are points: coordinate g counts the tokens whose hash falls in group g. Two sets share at most
sum_g min(a_g, b_g) tokens, and the sets below two nodes at most the same sum over the nodes' upper corners. Two nodes
are left unexplored where that bound is below what their smallest sets would have to share.
"""

from __future__ import annotations

import numpy as np


def count_vector(tokens: np.ndarray, groups: int) -> np.ndarray:
    return np.bincount((tokens >> np.uint64(40)).astype(np.int64) % groups, minlength=groups).astype(np.uint32)


def enough(bound: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of a and b tokens that share `bound` have a Jaccard similarity of percent/100 at least."""
    return (100 + percent) * bound >= percent * (a + b)


class CountTree:
    def __init__(self, points: np.ndarray, labels: np.ndarray | None = None, fan: int = 16):
        """points: a row of counts each. labels: pairs of equal labels aren't searched."""
        labels = np.arange(len(points)) if labels is None else labels
        self.sizes = points.sum(1, dtype=np.int64)
        # leaves hold neighbours in label, in size, then in the weight of half of the groups
        half = points[:, : points.shape[1] // 2].sum(1, dtype=np.int64)
        self.order = np.lexsort((half, np.log2(np.maximum(1, self.sizes)) // 0.125, labels))
        self.points, self.fan = points[self.order].astype(np.int64), fan
        self.sizes = self.sizes[self.order]
        labels = labels[self.order]
        self.levels = [(self.points, self.sizes, self.sizes, labels, labels)]  # upper corner, smallest and largest size and label
        while len(self.levels[-1][0]) > fan:
            top, low, high, first, last = self.levels[-1]
            cuts = np.arange(0, len(top), fan)
            self.levels.append((np.maximum.reduceat(top, cuts), np.minimum.reduceat(low, cuts), np.maximum.reduceat(high, cuts), np.minimum.reduceat(first, cuts), np.maximum.reduceat(last, cuts)))

    def _bound(self, level: int, other: CountTree, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.empty(len(i), np.int64)
        step = max(1, 4_000_000 // self.points.shape[1])
        for k in range(0, len(i), step):
            out[k : k + step] = np.minimum(self.levels[level][0][i[k : k + step]], other.levels[level][0][j[k : k + step]]).sum(1)
        return out

    def pairs(self, other: CountTree, percent: int):
        """Yields arrays (i, j, bound): rows of the two trees' points that may be similar. With itself: i < j in its order.
        Node pairs are taken from a stack in blocks, so that what is held stays small."""
        same, level = other is self, min(len(self.levels), len(other.levels)) - 1
        tops = np.arange(len(self.levels[level][0])), np.arange(len(other.levels[level][0]))
        stack = [(level, np.repeat(tops[0], len(tops[1])), np.tile(tops[1], len(tops[0])))]
        while stack:
            level, i, j = stack.pop()
            if len(i) > 65_536:
                stack += [(level, i[k : k + 65_536], j[k : k + 65_536]) for k in range(0, len(i), 65_536)]
                continue
            if same:
                keep = i < j if level == 0 else i <= j
                i, j = i[keep], j[keep]
            _, low_a, high_a, first_a, last_a = self.levels[level]
            _, low_b, high_b, first_b, last_b = other.levels[level]
            keep = (100 * high_a[i] >= percent * low_b[j]) & (100 * high_b[j] >= percent * low_a[i])
            keep &= (first_a[i] != last_b[j]) | (last_a[i] != first_b[j])  # else one label on both sides
            i, j = i[keep], j[keep]
            bound = self._bound(level, other, i, j)
            keep = enough(bound, low_a[i], low_b[j], percent)
            i, j, bound = i[keep], j[keep], bound[keep]
            if level == 0:
                if len(i):
                    yield self.order[i], other.order[j], bound
                continue
            a, b = np.divmod(np.arange(self.fan * other.fan), other.fan)
            i, j = (i[:, None] * self.fan + a).ravel(), (j[:, None] * other.fan + b).ravel()
            keep = (i < len(self.levels[level - 1][0])) & (j < len(other.levels[level - 1][0]))
            if len(i):
                stack.append((level - 1, i[keep], j[keep]))
