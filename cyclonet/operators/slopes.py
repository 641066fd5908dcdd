"""The median of all slopes between the points of a group, by counting inversions."""

from __future__ import annotations

import numpy as np

#: Slopes between the bounds are listed once there are at most so many a point.
CANDIDATES = 4


def inversions(rank: np.ndarray, listed: bool = False) -> int | tuple[np.ndarray, np.ndarray]:
    """How many pairs of places i < j have rank[i] > rank[j], or the two arrays of such places.

    rank holds 0 to n - 1, once each. From the highest bit down: places of equal higher bits are one group, in order;
    there a place with the bit set is inverted with each later one without it. Each pair parts at exactly one bit.
    """
    n, total = len(rank), 0
    at = np.arange(n)
    first, second = [], []
    for bit in range(max(1, (n - 1).bit_length()) - 1, -1, -1):
        r = rank[at]
        one = (r >> bit & 1).astype(bool)
        group = r >> (bit + 1)
        start = np.searchsorted(group, group)
        ones = np.r_[0, np.cumsum(one)]
        zeros = np.flatnonzero(~one)
        begin, end = ones[start[zeros]], ones[zeros]
        if listed:
            counts = end - begin
            into = np.repeat(begin - np.r_[0, np.cumsum(counts)[:-1]], counts) + np.arange(counts.sum())
            first.append(at[np.flatnonzero(one)[into]])
            second.append(np.repeat(at[zeros], counts))
        else:
            total += int((end - begin).sum())
        # Stable by the bit within each group, so that groups of one more bit are runs again.
        place = np.empty(n, dtype=np.int64)
        span = np.searchsorted(group, group, side="right")
        place[zeros] = start[zeros] + (zeros - start[zeros]) - (ones[zeros] - ones[start[zeros]])
        ups = np.flatnonzero(one)
        place[ups] = span[ups] - (ones[span[ups]] - ones[ups])
        moved = np.empty_like(at)
        moved[place] = at
        at = moved
    return (np.concatenate(first), np.concatenate(second)) if listed else total


def _order(x: np.ndarray, y: np.ndarray, slope: float) -> np.ndarray:
    """Rank of each point by y - slope x; of equal ones the greater x is first, so equal slopes are inversions too."""
    rest = y.astype(np.longdouble) - np.longdouble(slope) * x.astype(np.longdouble)
    rank = np.empty(len(x), dtype=np.int64)
    rank[np.lexsort((np.arange(len(x)), -x, rest))] = np.arange(len(x))
    return rank


def _middle(low: float, high: float, by_place: bool) -> float:
    """Between two doubles: half way in value, or half way in the list of all doubles."""
    if not by_place:
        return low + (high - low) / 2

    def place(v: float) -> int:
        bits = int(np.float64(v).view(np.int64))
        return bits if bits >= 0 else -(bits & 0x7FFFFFFFFFFFFFFF)

    mid = (place(low) + place(high)) >> 1
    return float(np.int64(mid).view(np.float64)) if mid >= 0 else -float(np.int64(-mid).view(np.float64))


def _kth(x: np.ndarray, y: np.ndarray, k: int, total: int) -> float:
    """The k-th least slope (from 1); points are ordered by x, then y."""
    # Near their middles the points keep more digits in v - slope u; slopes themselves come from the points as they are.
    u, v = x - np.median(x), y - np.median(y)
    low, high, below, upto = -np.finfo(float).max, np.finfo(float).max, 0, total
    most, step = CANDIDATES * len(x), 0
    # A first guess from drawn pairs saves rounds; the seed is fixed and the bounds are counted, so it cannot change the result.
    rng = np.random.default_rng(0)
    i, j = rng.integers(0, len(x), (2, 4 * len(x)))
    i, j = i[x[i] < x[j]], j[x[i] < x[j]]
    drawn = np.sort((y[j] - y[i]) / (x[j] - x[i]))
    drawn = drawn[np.isfinite(drawn)]
    guesses = []
    if len(drawn):
        middle, wide = k / total * len(drawn), 2 * np.sqrt(len(drawn)) + 1
        guesses = [float(drawn[int(np.clip(middle + d, 0, len(drawn) - 1))]) for d in (-wide, wide)]
    while upto - below > most:
        mid = guesses.pop() if guesses else _middle(low, high, step % 2 == 1)
        step += 1
        if not low < mid < high:
            mid = _middle(low, high, True)
            if not low < mid < high:
                # More slopes than can be listed agree to rounding; a drawn pair that is one of them gives their value.
                near = drawn[np.argmin(np.abs(drawn - high))] if len(drawn) else high
                return float(near) if abs(near - high) <= 1e-15 * np.abs(drawn).max(initial=0) else high
        count = inversions(_order(u, v, mid))
        if count >= k:
            high, upto = mid, count
        else:
            low, below = mid, count
    # Slopes over low and up to high: inverted at high and not at low.
    a, b = _order(u, v, low), _order(u, v, high)
    by_low = np.argsort(a)
    p, q = inversions(b[by_low], listed=True)
    p, q = by_low[p], by_low[q]
    left, right = np.minimum(p, q), np.maximum(p, q)
    slopes = np.sort((y[right] - y[left]) / (x[right] - x[left]))
    return float(slopes[k - below - 1])


def median_slope(x: np.ndarray, y: np.ndarray) -> tuple[float, int]:
    """The median of (y[j] - y[i]) / (x[j] - x[i]) over all pairs with x[i] < x[j], the mean of the middle two if their
    number is even, and that number; nan and 0 if there is none."""
    at = np.lexsort((y, x))
    x, y = x[at], y[at]
    same = np.unique(x, return_counts=True)[1].astype(object)
    total = len(x) * (len(x) - 1) // 2 - int((same * (same - 1) // 2).sum()) if len(x) else 0
    if not total:
        return float("nan"), 0
    low = _kth(x, y, (total + 1) // 2, total)
    return (low if total % 2 else low * 0.5 + _kth(x, y, total // 2 + 1, total) * 0.5), total
