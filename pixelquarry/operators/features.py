"""Feature matching between two grids: corners, binary descriptors, mutual nearest pairs, and their shift.

It finds shifts that phase correlation can't: large ones, and those of scenes of which part has changed.
"""

from __future__ import annotations

import numpy as np

#: Corners of a grid at most, the reach of a patch, and the bits of a descriptor.
CORNERS, REACH, BITS = 600, 12, 256
#: Pairs and inliers at least, and how many robust deviations an inlier may lie off (fixed values).
LEAST_PAIRS, DEVIATIONS = 12, 3.0


def _box(x: np.ndarray, reach: int) -> np.ndarray:
    """The sum over a square around each place, edges repeated."""
    size = 2 * reach + 1
    summed = np.pad(np.pad(x, reach, mode="edge").cumsum(axis=0).cumsum(axis=1), ((1, 0), (1, 0)))
    return summed[size:, size:] - summed[:-size, size:] - summed[size:, :-size] + summed[:-size, :-size]


def corners(x: np.ndarray) -> np.ndarray:
    """Row and column of the places where the grid varies most in both directions, strongest first.

    The strength is the lesser eigenvalue of the structure tensor; only the strongest place of a square
    of five counts, and none whose patch would leave the grid.
    """
    if min(x.shape) <= 2 * REACH + 2:
        return np.zeros((0, 2), dtype=np.int64)
    down, right = np.gradient(x)
    rr, cc, rc = (_box(p, 2) for p in (down * down, right * right, down * right))
    strength = (rr + cc) / 2 - np.hypot((rr - cc) / 2, rc)
    windows = np.lib.stride_tricks.sliding_window_view(np.pad(strength, 2, constant_values=-np.inf), (5, 5))
    peak = (strength >= windows.max(axis=(2, 3))) & (strength > 1e-6 * max(strength.max(), 1e-30))
    peak[: REACH + 1], peak[-REACH - 1 :], peak[:, : REACH + 1], peak[:, -REACH - 1 :] = False, False, False, False
    found = np.argwhere(peak)
    order = np.lexsort((found[:, 1], found[:, 0], -strength[peak]))
    return found[order][:CORNERS]


def _pattern() -> np.ndarray:
    """Pairs of offsets that a descriptor compares: drawn once, by a fixed rule."""
    drawn = np.random.default_rng(BITS).normal(0, REACH / 2.5, (BITS, 2, 2))
    return np.clip(drawn, -REACH / 1.5, REACH / 1.5)


def descriptors(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    """The bits of each point's patch: which of two places is brighter, the pattern turned to where the
    patch's weight lies."""
    soft = _box(x, 1) / 9
    span = np.arange(-REACH, REACH + 1)
    patch = soft[points[:, 0, None, None] + span[:, None], points[:, 1, None, None] + span]
    disc = np.hypot(*np.meshgrid(span, span)) <= REACH
    weight = (patch - patch.min(axis=(1, 2), keepdims=True)) * disc
    turn = np.arctan2((weight * span[:, None]).sum(axis=(1, 2)), (weight * span).sum(axis=(1, 2)))
    sin, cos = np.sin(turn)[:, None, None], np.cos(turn)[:, None, None]
    offset = _pattern()
    down, right = sin * offset[..., 1] + cos * offset[..., 0], cos * offset[..., 1] - sin * offset[..., 0]
    at = soft[points[:, 0, None, None] + np.rint(down).astype(int), points[:, 1, None, None] + np.rint(right).astype(int)]
    return np.packbits(at[..., 0] > at[..., 1], axis=1).view(np.uint64)


def mutual_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Pairs of rows that are each other's nearest by differing bits; the first one on ties."""
    if not len(a) or not len(b):
        return np.zeros((0, 2), dtype=np.int64)
    apart = np.bitwise_count(a[:, None, :] ^ b[None, :, :]).sum(axis=2)
    there, back = apart.argmin(axis=1), apart.argmin(axis=0)
    own = np.flatnonzero(back[there] == np.arange(len(a)))
    return np.stack([own, there[own]], axis=1)


def matched_shift(a: np.ndarray, b: np.ndarray) -> tuple[float, float, int] | None:
    """How far ``b`` lies right of and below ``a``, and the number of pairs that say so; none with fewer than
    LEAST_PAIRS pairs or inliers.

    The median of the pairs' shifts; inliers are those within DEVIATIONS robust deviations of it, and
    their median is the answer.
    """
    pa, pb = corners(a), corners(b)
    pairs = mutual_pairs(descriptors(a, pa), descriptors(b, pb)) if len(pa) and len(pb) else []
    if len(pairs) < LEAST_PAIRS:
        return None
    moved = (pb[pairs[:, 1]] - pa[pairs[:, 0]]).astype(np.float64)
    middle = np.median(moved, axis=0)
    off = np.hypot(*(moved - middle).T)
    close = off <= max(DEVIATIONS * 1.4826 * float(np.median(off)), 1.0)
    if close.sum() < LEAST_PAIRS:
        return None
    down, right = np.median(moved[close], axis=0)
    return float(right), float(down), int(close.sum())
