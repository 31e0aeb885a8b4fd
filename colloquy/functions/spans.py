"""Interval algebra on the (start, end) lists of one call, for Python stages that hold the call's sound anyway.

The same rules as operators.intervals and operators.ledger, which serve tables of segments.
"""

from __future__ import annotations

import numpy as np

Span = tuple[float, float]


def quantile(values: np.ndarray, share: float) -> float:
    """The exact quantile, between two values in proportion."""
    ordered = np.sort(values)
    at = (len(ordered) - 1) * share
    low, high = int(np.floor(at)), int(np.ceil(at))
    return float(ordered[low]) if low == high else float((high - at) * ordered[low] + (at - low) * ordered[high])


def runs(active: np.ndarray, frame: float, gap: float, least: float) -> list[tuple[int, float, float]]:
    """(first frame, start, end) of the segments of a mask; see ledger.mask_segments."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], active.astype(np.int8), [0]])))
    found: list[list] = []
    for low, after in zip(edges[::2].tolist(), edges[1::2].tolist()):
        end = len(active) * frame if after >= len(active) else after * frame + frame
        if found and low * frame - found[-1][3] < gap:
            found[-1][2], found[-1][3] = max(found[-1][2], end), end
        else:
            found.append([low, low * frame, end, end])
    return [(low, start, end) for low, start, end, _ in found if end - start >= least]


def pauses(spans: list[Span], duration: float, whole_if_silent: bool) -> np.ndarray:
    """Lengths of the positive gaps before, between and after spans; see timing.caller_gaps."""
    if not spans:
        return np.array([duration] if whole_if_silent and duration > 0 else [])
    starts, ends = (np.array(x) for x in zip(*spans))
    found = np.concatenate([starts - np.concatenate([[0.0], ends[:-1]]), [duration - ends[-1]]])
    return found[found > 0]


def free(spans: list[Span], duration: float) -> list[Span]:
    """What spans leave free of [0, duration)."""
    cursor, out = 0.0, []
    for start, end in spans:
        if start > cursor:
            out.append((cursor, start))
        cursor = max(cursor, end)
    return [*out, (cursor, duration)] if duration > cursor else out


def alone(spans: list[Span], others: list[Span]) -> list[Span]:
    """Where spans are active and others are not, cut at every boundary of either."""
    if not spans:
        return []
    cuts = np.unique(np.array([t for s in (*spans, *others) for t in s]))

    def covered(those: list[Span]) -> np.ndarray:
        starts, ends = (np.sort([s[i] for s in those]) for i in (0, 1))
        return np.searchsorted(starts, cuts[:-1], "right") - np.searchsorted(ends, cuts[:-1], "right")

    wanted = (covered(spans) > 0) & ((covered(others) == 0) if others else True)
    return [(float(a), float(b)) for a, b in zip(cuts[:-1][wanted], cuts[1:][wanted])]


def inside(points: list[float], spans: list[Span]) -> list[float]:
    """Points strictly inside a span."""
    return [p for p in points if any(s < p < e for s, e in spans)]


def bits_of(values: np.ndarray, bins: int = 8) -> float:
    """Entropy of the counts in equal bins of the values' range; one bin where all are equal."""
    if not len(values):
        return 0.0
    low, high = values.min(), values.max()
    at = np.zeros(len(values), np.int64) if high <= low else np.minimum(np.floor((values - low) / ((high - low) / bins)), bins - 1).astype(np.int64)
    share = np.bincount(at) / len(values)
    share = share[share > 0]
    return float(-(share * np.log2(share)).sum())


def spread(values: np.ndarray) -> tuple[float, float, float]:
    """(mean, population deviation, deviation over a positive mean); zeros for nothing."""
    if not len(values):
        return 0.0, 0.0, 0.0
    mean, std = float(np.mean(values)), float(np.std(values))
    return mean, std, std / mean if mean > 0 else 0.0
