"""A vantage-point tree over a few integer points: exact nearest entries by metric branch and bound.

All distances are integers. A node's ring (least and greatest distance of its entries to the vantage point) is kept as roots
rounded outwards, and a query's distance is rounded so that the bound can only be too small; a subtree is left out only
if its bound's square is strictly greater than the best squared distance. So ties are always visited, and the lower
index wins."""

from __future__ import annotations

import numpy as np

_LEAF = 2


def floor_roots(squares: np.ndarray) -> np.ndarray:
    """Integer square roots rounded down."""
    roots = np.sqrt(squares.astype(np.float64)).astype(np.int64)
    roots -= roots * roots > squares
    return roots + ((roots + 1) * (roots + 1) <= squares)


def ceil_roots(squares: np.ndarray) -> np.ndarray:
    roots = floor_roots(squares)
    return roots + (roots * roots < squares)


def squared(points: np.ndarray, entry: np.ndarray) -> np.ndarray:
    apart = points - entry
    return np.einsum("ij,ij->i", apart, apart)


class _Node:
    """entries: those compared here (a leaf's, or the vantage point). sides: (low, high, node) of the entries near and far."""

    def __init__(self, entries: np.ndarray, numbers: list[int]):
        self.sides: list[tuple[int, int, _Node]] = []
        if len(numbers) <= _LEAF:
            self.numbers = numbers
            return
        # the vantage point with the widest spread of distances cuts best
        spreads = [np.var(np.sqrt(squared(entries[numbers], entries[i]).astype(np.float64))) for i in numbers]
        point = numbers[int(np.argmax(spreads))]
        self.numbers = [point]
        rest = [i for i in numbers if i != point]
        apart = squared(entries[rest], entries[point])
        order = np.argsort(apart, kind="stable")
        for part in (order[: len(rest) // 2], order[len(rest) // 2 :]):
            if len(part):
                low, high = floor_roots(apart[part]).min(), ceil_roots(apart[part]).max()
                self.sides.append((int(low), int(high), _Node(entries, sorted(rest[k] for k in part))))


class Tree:
    """Nearest entries of many points at once. `compared` counts pairs of points and entries that were compared."""

    def __init__(self, entries: np.ndarray):
        self.entries, self.compared = entries, 0
        self.root = _Node(entries, list(range(len(entries))))

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index, squared distance) of each point's nearest entry; the lower index wins a tie."""
        best = np.full(len(points), np.iinfo(np.int64).max, np.int64)
        index = np.full(len(points), len(self.entries), np.int64)
        self._visit(self.root, points, np.arange(len(points)), best, index)
        return index, best

    def _visit(self, node: _Node, points: np.ndarray, rows: np.ndarray, best: np.ndarray, index: np.ndarray) -> None:
        for i in node.numbers:
            apart = squared(points[rows], self.entries[i])
            self.compared += len(rows)
            better = (apart < best[rows]) | ((apart == best[rows]) & (i < index[rows]))
            best[rows[better]], index[rows[better]] = apart[better], i
        if not node.sides:
            return
        # the vantage point is the only entry of an inner node, so `apart` is the distance to it
        low, high = floor_roots(apart), ceil_roots(apart)
        gaps = [np.maximum(0, np.maximum(low - far, near - high)) for near, far, _ in node.sides]
        first = gaps[0] <= gaps[-1]
        for chosen in (first, ~first):
            for k in range(len(node.sides)) if chosen is first else reversed(range(len(node.sides))):
                own = rows[chosen]
                keep = gaps[k][chosen] ** 2 <= best[own]
                if keep.any():
                    self._visit(node.sides[k][2], points, own[keep], best, index)
