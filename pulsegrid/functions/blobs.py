"""Morphology and connected components of one small binary frame (a per-frame helper)."""
from __future__ import annotations

import numpy as np


def _shift_or(a: np.ndarray) -> np.ndarray:
    out = a.copy()
    out[1:] |= a[:-1]
    out[:-1] |= a[1:]
    out[:, 1:] |= a[:, :-1]
    out[:, :-1] |= a[:, 1:]
    return out


def cross_morph(a: np.ndarray, dilate: int, erode: int) -> np.ndarray:
    """Dilate then erode with the 4-neighbour cross; outside the frame counts as empty."""
    for _ in range(dilate):
        a = _shift_or(a)
    for _ in range(erode):
        a = ~_shift_or(np.pad(~a, 1, constant_values=True))[1:-1, 1:-1]
    return a


def box_close(a: np.ndarray, r: int) -> np.ndarray:
    """Closing with a (2r+1)^2 box; outside the frame counts as empty in both steps."""
    def spread(m):
        p = np.pad(m, r)
        c = np.cumsum(np.pad(p, ((1, 0), (1, 0))), axis=0).cumsum(axis=1)
        k = 2 * r + 1
        return c[k:, k:] - c[:-k, k:] - c[k:, :-k] + c[:-k, :-k]
    grown = spread(a.astype(np.int64)) > 0
    return spread(grown.astype(np.int64)) == (2 * r + 1) ** 2


def label(mask: np.ndarray) -> np.ndarray:
    """8-connected components numbered from 1 in raster order of their first pixel."""
    h, w = mask.shape
    edge = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    rows, starts = np.nonzero(edge == 1)
    _, stops = np.nonzero(edge == -1)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    first = np.searchsorted(rows, np.arange(h + 1))
    for y in range(1, h):
        i, j = first[y - 1], first[y]
        while i < first[y] and j < first[y + 1]:
            if starts[i] <= stops[j] and starts[j] <= stops[i]:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
            if stops[i] < stops[j]:
                i += 1
            else:
                j += 1
    out = np.zeros((h, w), np.int32)
    names: dict[int, int] = {}
    for k in range(len(rows)):
        out[rows[k], starts[k]:stops[k]] = names.setdefault(find(k), len(names) + 1)
    return out


def frame_blobs(x: np.ndarray, y: np.ndarray, n: np.ndarray, shape: tuple[int, int], min_pixels: int,
                dilate: int, erode: int, close: int = 0) -> list[dict]:
    """Blobs of one frame given its lit pixels and their event counts, in raster order.

    Each blob carries its mask area and box, and the statistics of the events it holds.
    """
    img = np.zeros(shape, bool)
    img[y, x] = True
    bw = box_close(img, close) if close else cross_morph(img, dilate, erode)
    lab = label(bw)
    area = np.bincount(lab.ravel())
    at = lab[y, x]
    out = []
    for b in np.flatnonzero(area >= min_pixels):
        if b == 0:
            continue
        yy, xx = np.nonzero(lab == b)
        e = at == b
        m = int(n[e].sum())
        out.append({"blob": int(b), "area": int(area[b]), "x0": int(xx.min()), "y0": int(yy.min()),
                    "x1": int(xx.max()) + 1, "y1": int(yy.max()) + 1, "n_events": m,
                    "mx": float((x[e] * n[e]).sum() / m) if m else None,
                    "my": float((y[e] * n[e]).sum() / m) if m else None,
                    "ex0": int(x[e].min()) if m else None, "ey0": int(y[e].min()) if m else None,
                    "ex1": int(x[e].max()) + 1 if m else None, "ey1": int(y[e].max()) + 1 if m else None,
                    "pixels": (y[e].astype(np.int64) * shape[1] + x[e]).tolist()})
    return out
