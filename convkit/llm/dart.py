"""DartMinHash: sparse weighted signatures.

Every element owns a strip of the plane (weight x rank), cut into weight
regions [0, 1), [1, 2), [2, 4), ... Hashed darts fall on each region as a
Poisson process of rank 0, 1, 2, ...; each dart has a weight, a rank and one
of k coordinates, all functions of (element, region, number of the dart), so
two sets throw the same darts at the elements they share. A set keeps the
darts that hit below its element weights, and of these the earliest (lowest
rank) per coordinate. Two sets agree in a coordinate with probability equal
to their weighted Jaccard similarity, sum of minima over sum of maxima.

A set of total weight W throws only up to rank (k ln k + 2k) / W, so the
work is near elements + k ln k, not elements x k; sets with an empty
coordinate go on to twice the rank.
"""

from __future__ import annotations

import numpy as np

from convkit.llm.wordhash import mix, seeded

EMPTY = np.uint64(0)


def _uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * (1.0 / (1 << 53))


def _regions(weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(index of the element, region, its lower end, its width) for every
    region that an element of this weight reaches."""
    top = np.where(weight > 1, np.ceil(np.log2(np.maximum(weight, 1))), 0).astype(np.int64)
    if not top.any():
        at = np.arange(len(weight))
        return at, np.zeros(len(at), np.int64), np.zeros(len(at)), np.ones(len(at))
    at = np.repeat(np.arange(len(weight)), top + 1)
    region = np.arange(len(at)) - np.repeat(np.cumsum(top + 1) - (top + 1), top + 1)
    low = np.where(region > 0, 2.0 ** (region - 1), 0.0)
    return at, region, low, np.where(region > 0, low, 1.0)


def sketch(row: np.ndarray, element: np.ndarray, weight: np.ndarray | None, n: int, k: int) -> np.ndarray:
    """Signatures [n, k] (uint64 dart names; EMPTY where a row has no element).

    ``element`` are 64-bit hashes. Weights must be positive; None means 1. An
    element repeated in a row counts once if its weights are equal.
    """
    out = np.zeros(n * k, dtype=np.uint64)
    best = np.full(n * k, np.inf)
    w = np.ones(len(element)) if weight is None else np.asarray(weight, dtype=float)
    total = np.bincount(row, w, n)[:n] if len(row) else np.zeros(n)
    limit = np.zeros(n)
    limit[total > 0] = k * (np.log(k) + 2) / total[total > 0]
    open_rows = total > 0
    while open_rows.any():
        use = open_rows[row]
        _throw(row[use], element[use], w[use], limit, k, best, out)
        missing = np.isinf(best).reshape(n, k).any(axis=1)
        open_rows &= missing
        limit[open_rows] *= 2
    return out.reshape(n, k)


def _throw(row, element, weight, limit, k, best, out) -> None:
    at, region, low, width = _regions(weight)
    r, e, x = row[at], element[at] + region.astype(np.uint64) * seeded(11), weight[at]
    rank = np.zeros(len(r))
    dart = 0
    while len(r):
        h = mix(e ^ seeded(100 + dart))
        rank = rank - np.log(_uniform(h)) / width
        near = rank <= limit[r]
        if not near.all():
            r, e, x, low, width, rank, h = r[near], e[near], x[near], low[near], width[near], rank[near], h[near]
        h2 = mix(h + seeded(12))
        coord = (h2 % np.uint64(k)).astype(np.int64)
        # the weight of the dart inside its region, from bits that the coordinate doesn't use
        hit = low + width * _uniform(mix(h2)) < x if weight.max(initial=0) != 1 or weight.min(initial=1) != 1 else None
        slot = r * k + coord
        if hit is not None:
            slot_h, rank_h, name = slot[hit], rank[hit], h[hit]
        else:
            slot_h, rank_h, name = slot, rank, h
        np.minimum.at(best, slot_h, rank_h)
        won = best[slot_h] == rank_h
        out[slot_h[won]] = name[won] | np.uint64(1)
        dart += 1


def band_hashes(sig: np.ndarray, rows_per_band: int) -> np.ndarray:
    """[n, bands] hashes of consecutive signature rows."""
    n, k = sig.shape
    bands = k // rows_per_band
    s = sig[:, :bands * rows_per_band].reshape(n, bands, rows_per_band)
    h = np.zeros((n, bands), dtype=np.uint64)
    for j in range(rows_per_band):
        h = mix(h * np.uint64(0x9E37_79B9_7F4A_7C15) + s[:, :, j])
    return h
