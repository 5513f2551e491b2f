"""The earlier rows most alike to each row of a block, by an amount and a fixed share of a score (numpy, inside a task).

Rows stand in order of time.  A score is (fixed + 2 * nearness) / total, where nearness of
two amounts is 1 - min(1, |q - c| / max(q, c, 1)); it falls as amounts move apart, so among
rows that are all earlier the best are the next ones in order of amount.  Halves of halves
of a block are taken in turn: each row of a right half asks its whole left half.
"""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal

import numpy as np

PLACES, SHIFT = 10**6, 32


def scores(asked: np.ndarray, other: np.ndarray, fixed: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Scores as whole millionths, halves up in their shortest decimal form as Spark rounds."""
    with np.errstate(invalid="ignore"):
        near = 1 - np.fmin(1.0, np.abs(asked - other) / np.fmax(np.fmax(asked, other), 1.0))
    exact = (fixed + near * 2.0) / total
    scaled = exact * PLACES
    whole = np.floor(scaled)
    rounded = (whole + (scaled - whole >= 0.5)).astype(np.int64)
    for at in zip(*np.nonzero(np.abs(scaled - whole - 0.5) < 1e-6), strict=True):
        rounded[at] = int((Decimal(repr(float(exact[at]))) * PLACES).quantize(Decimal(1), ROUND_HALF_UP))
    return rounded


def _best(keys: np.ndarray, k: int) -> np.ndarray:
    """The k largest different keys of each row, falling, -1 where there are fewer."""
    keys = -np.sort(-keys, axis=1)
    keys[:, 1:][keys[:, 1:] == keys[:, :-1]] = -1
    return -np.sort(-keys, axis=1)[:, :k]


def best_earlier(amount: np.ndarray, found: np.ndarray, asks: np.ndarray, fixed: np.ndarray, total: np.ndarray, k: int) -> np.ndarray:
    """Per row the k best of the earlier rows that may be found, as score << SHIFT | row, falling, -1 for none; the latest first on ties."""
    n = len(amount)
    steps, rows = np.arange(k), np.arange(n)
    top = np.full((n, k), -1, dtype=np.int64)

    def offer(asking: np.ndarray, other: np.ndarray, there: np.ndarray) -> None:
        a = asking[:, None]
        s = scores(amount[a], amount[other], fixed[a], total[a])
        top[asking] = _best(np.concatenate([top[asking], np.where(there, s << SHIFT | other, -1)], axis=1), k)

    asking, findable = rows[asks], rows[found]
    if not len(asking) or not len(findable):
        return top
    latest = np.searchsorted(findable, asking)[:, None] - 1 - steps  # rows whose amounts don't count score alike: the latest of them
    offer(asking, findable[np.maximum(latest, 0)], latest >= 0)
    distinct, rank = np.unique(amount, return_inverse=True)
    half = 1
    while half < n:
        pair, right = rows // (2 * half), (rows // half) & 1 == 1
        asking, left = rows[right & asks], rows[~right & found]
        key = pair * len(distinct) + rank
        down, up = left[np.lexsort((left, key[left]))], left[np.lexsort((-left, key[left]))]  # of equal amounts the latest comes first either way
        sorted_key, first = key[down], pair[asking] * len(distinct)
        at = np.searchsorted(sorted_key, key[asking], "right")[:, None]
        begin, end = np.searchsorted(sorted_key, first)[:, None], np.searchsorted(sorted_key, first + len(distinct))[:, None]
        below, above = at - 1 - steps, at + steps
        if len(left) and len(asking):
            other = np.concatenate([down[np.clip(below, 0, len(left) - 1)], up[np.clip(above, 0, len(left) - 1)]], axis=1)
            offer(asking, other, np.concatenate([below >= begin, above < end], axis=1))
        half *= 2
    _settle_ties(top, amount, findable, rows[asks], fixed, total, k)
    return top


def _settle_ties(top: np.ndarray, amount: np.ndarray, findable: np.ndarray, asking: np.ndarray, fixed: np.ndarray, total: np.ndarray, k: int) -> None:
    """Rows of different amounts whose scores are equal once rounded: the latest are taken from all within that range."""
    order = findable[np.argsort(amount[findable], kind="stable")]
    ordered = amount[order]
    distinct = np.unique(ordered)
    asking = asking[top[asking, -1] >= 0]
    q, f, t, last = amount[asking], fixed[asking], total[asking], top[asking, -1] >> SHIFT
    near = lambda score: np.clip((score / PLACES * t - f) / 2, 0.0, 1.0)
    worst, best = near(last - 0.51), near(last + 0.51)

    def ends(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        with np.errstate(divide="ignore", invalid="ignore"):
            high = np.fmax(np.fmin(q + (1 - at), 1.0), np.where(q > 0, q / at, -np.inf))
        return q - (1 - at) * np.fmax(q, 1.0), np.fmax(high, q)

    (low, high), (low_in, high_in) = ends(worst), ends(best)
    wide = 1e-9 * (1 + np.abs(q))
    low, high = low - wide, high + wide + np.where(np.isfinite(high), np.abs(high) * 1e-9, 0)
    held = lambda a, b: np.searchsorted(distinct, b, "right") - np.searchsorted(distinct, a, "left")
    several = (held(low, low_in + wide) > 1) | (held(high_in - wide, high) > 1)
    counts = (last > scores(q, np.full_like(q, np.inf), f, t)) & several  # at the least score the latest of all are in already
    begin, end = np.searchsorted(ordered, low, "left"), np.searchsorted(ordered, high, "right")
    for i in np.nonzero(counts)[0]:
        other = order[begin[i] : end[i]]
        other = other[other < asking[i]]
        row = np.full(len(other), asking[i])
        keys = scores(amount[row], amount[other], fixed[row], total[row]) << SHIFT | other
        top[asking[i]] = _best(np.concatenate([keys, top[asking[i]]])[None, :], k)[0]
