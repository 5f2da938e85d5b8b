"""Latest earlier events around each event of a small area, by binary search over all of them at once."""
from __future__ import annotations

import numpy as np

#: Earlier than any event.
NEVER = -(1 << 62)
NEIGHBOURS = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if (dx, dy) != (0, 0)]


def latest_around(x: np.ndarray, y: np.ndarray, t: np.ndarray, width: int, surface: np.ndarray | None = None) -> np.ndarray:
    """For events in stream order, the latest time at which one of the eight neighbours fired before.

    ``x`` and ``y`` lie in an area of ``width`` columns with a rim of one pixel around all events that matter; ``surface`` has
    the last times of the area's pixels (row by row) before these events.
    """
    n = len(t)
    pixel = y.astype(np.int64) * width + x
    rank = np.arange(n)
    order = np.argsort(pixel, kind="stable")
    entry = pixel[order] * n + order
    seen = np.full(n, NEVER, np.int64)
    for dx, dy in NEIGHBOURS:
        near = pixel + dy * width + dx
        at = np.searchsorted(entry, near * n + rank) - 1
        found = (at >= 0) & (entry[at] // n == near)
        when = np.where(found, t[order[at]], NEVER)
        if surface is not None:
            there = ~found & (near >= 0) & (near < len(surface))
            when[there] = surface[near[there]]
        np.maximum(seen, when, out=seen)
    return seen
