"""Numpy kernels on batches of small pixel lists (one list per block).

All lists of an Arrow batch are worked on together: positions are spread on a
common line so that lists never touch, and no Python loop runs per list.
"""

from __future__ import annotations

import numpy as np


def component_labels(group: np.ndarray, y: np.ndarray, x: np.ndarray, connectivity: int) -> np.ndarray:
    """Label = position of the component's first pixel in (group, y, x) order.

    Neighbours are found by binary search, then labels flow along links with
    pointer jumping until nothing changes.
    """
    n = len(group)
    if n == 0:
        return np.zeros(0, np.int64)
    y = y.astype(np.int64) - y.min() + 1
    x = x.astype(np.int64) - x.min() + 1
    width, height = x.max() + 2, y.max() + 2
    key = (group.astype(np.int64) * height + y) * width + x
    order = np.argsort(key, kind="stable")
    key = key[order]
    steps = [1, width] if connectivity == 4 else [1, width - 1, width, width + 1]
    a, b = [], []
    for step in steps:
        at = np.searchsorted(key, key + step)
        at[at == n] = n - 1
        hit = key[at] == key + step
        a.append(np.flatnonzero(hit))
        b.append(at[hit])
    a, b = np.concatenate(a), np.concatenate(b)
    root = np.arange(n)
    while len(a):
        ra, rb = root[a], root[b]
        differs = ra != rb
        if not differs.any():
            break
        a, b, ra, rb = a[differs], b[differs], ra[differs], rb[differs]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
    out = np.empty(n, np.int64)
    out[order] = order[root]
    return out


def _neighbours(img: np.ndarray):
    """P2..P9 of every pixel, clockwise from north; the border row/column is empty."""
    p = np.pad(img, 1)
    n, e, s, w = p[:-2, 1:-1], p[1:-1, 2:], p[2:, 1:-1], p[1:-1, :-2]
    return n, p[:-2, 2:], e, p[2:, 2:], s, p[2:, :-2], w, p[:-2, :-2]


def thin_canvas(img: np.ndarray, max_rounds: int | None = None) -> np.ndarray:
    """Zhang-Suen thinning (1984) of a 0/1 canvas, to convergence by default."""
    img = img.astype(np.uint8)
    rounds = 0
    while max_rounds is None or rounds < max_rounds:
        changed = False
        for first in (True, False):
            ring = _neighbours(img)
            n, _, e, _, s, _, w, _ = ring
            count = sum(r.astype(np.int8) for r in ring)
            rises = sum(((ring[i] == 0) & (ring[(i + 1) % 8] == 1)).astype(np.int8) for i in range(8))
            open_side = ((n & e & s) == 0) & ((e & s & w) == 0) if first else \
                ((n & e & w) == 0) & ((n & s & w) == 0)
            gone = (img == 1) & (count >= 2) & (count <= 6) & (rises == 1) & open_side
            if gone.any():
                changed = True
                img[gone] = 0
        rounds += 1
        if not changed:
            break
    return img


def thin_lists(group: np.ndarray, y: np.ndarray, x: np.ndarray, max_rounds: int | None = None) -> np.ndarray:
    """Boolean 'kept' per pixel after thinning each list on its own canvas strip."""
    n = len(group)
    if n == 0:
        return np.zeros(0, bool)
    _, g = np.unique(group, return_inverse=True)
    k = g.max() + 1
    big = np.iinfo(np.int64).max
    x0, y0 = np.full(k, big), np.full(k, big)
    x1 = np.full(k, -big)
    np.minimum.at(x0, g, x.astype(np.int64))
    np.minimum.at(y0, g, y.astype(np.int64))
    np.maximum.at(x1, g, x.astype(np.int64))
    span = x1 - x0 + 2
    start = np.concatenate([[0], np.cumsum(span)])
    col = start[g] + x - x0[g]
    row = y - y0[g]
    canvas = np.zeros((int(row.max()) + 1, int(start[-1])), np.uint8)
    canvas[row, col] = 1
    return thin_canvas(canvas, max_rounds)[row, col] == 1
