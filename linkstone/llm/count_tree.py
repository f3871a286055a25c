"""R-tree over count vectors: which pairs of sets can overlap enough.

A set's point counts its tokens by group.  Two sets share at most the sum, over the groups, of the
smaller of both counts; for all points below a node the same sum with the node's upper corner
bounds it.  The tree is packed bottom-up from points in order of set size, so a node also bounds
the sizes below it.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

FANOUT = 16


@dataclass
class Tree:
    points: np.ndarray
    sizes: np.ndarray
    order: np.ndarray
    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]]  # upper corners, least and most size; the root last


def build(points: np.ndarray, sizes: np.ndarray) -> Tree:
    order = np.lexsort((*points.T[:4], sizes))
    points, sizes = points[order], sizes[order]
    levels = []
    high, least, most = points, sizes, sizes
    while len(high) > 1 or not levels:
        cuts = np.arange(0, len(high), FANOUT)
        high, least, most = np.maximum.reduceat(high, cuts, axis=0), np.minimum.reduceat(least, cuts), np.maximum.reduceat(most, cuts)
        levels.append((high, least, most))
    return Tree(points, sizes, order, levels)


def needed(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Least overlap at which 100 * overlap >= percent * (a + b - overlap)."""
    return -(-percent * (a + b) // (100 + percent))


def search(tree: Tree, point: np.ndarray, size: int, percent: int) -> np.ndarray:
    """Numbers of the points whose bound with ``point`` reaches what is needed."""
    nodes = np.arange(len(tree.levels[-1][0]))
    for depth in range(len(tree.levels) - 1, -1, -1):
        high, least, most = tree.levels[depth]
        fits = (percent * least[nodes] <= 100 * size) & (100 * most[nodes] >= percent * size)
        nodes = nodes[fits]
        smallest = np.maximum(least[nodes], -(-percent * size // 100))
        nodes = nodes[np.minimum(high[nodes], point).sum(1) >= needed(smallest, np.int64(size), percent)]
        below = len(tree.levels[depth - 1][0]) if depth else len(tree.points)
        nodes = (nodes[:, None] * FANOUT + np.arange(FANOUT)).ravel()
        nodes = nodes[nodes < below]
        if not len(nodes):
            return nodes
    bound = np.minimum(tree.points[nodes], point).sum(1)
    return tree.order[nodes[bound >= needed(tree.sizes[nodes], np.int64(size), percent)]]
