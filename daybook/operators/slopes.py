"""Mann-Kendall S and Sen's slope of a long series without its pairs: counts of inversions, and selection among slopes.

A slope between two points is at most m just where the later point less m times its place
lies no higher than the earlier one's, so slopes up to m are counted as inversions of one
sequence, in n log n. Bisection on m closes in on the median until few slopes are left
between its ends; those are listed and ranked.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _dense(x: np.ndarray) -> np.ndarray:
    return np.unique(x, return_inverse=True)[1].astype(np.int64)


def _merge_levels(ranks: np.ndarray):
    """For each level of a merge sort: the later halves' values and places, how far the sorted earlier half reaches, and that half."""
    n = len(ranks)
    size = 1 << max(0, n - 1).bit_length()
    top = int(ranks.max(initial=0)) + 1
    held = np.full(size, top, np.int64)  # padding is larger than all and last, so it is in no inversion
    held[:n] = ranks
    place = np.arange(size)
    width = 1
    while width < size:
        rows = held.reshape(-1, 2 * width)
        spots = place.reshape(-1, 2 * width)
        left, right = rows[:, :width], rows[:, width:]
        yield left, right, spots[:, :width], spots[:, width:], top
        order = np.argsort(rows, axis=1, kind="stable")
        held = np.take_along_axis(rows, order, 1).ravel()
        place = np.take_along_axis(spots, order, 1).ravel()
        width *= 2


def _reach(left: np.ndarray, right: np.ndarray, top: int) -> np.ndarray:
    """How many of the (sorted) left half are no larger than each of the right half."""
    base = np.arange(len(left), dtype=np.int64)[:, None] * (top + 1)
    found = np.searchsorted((left + base).ravel(), (right + base).ravel(), side="right").reshape(right.shape)
    return found - np.arange(len(left), dtype=np.int64)[:, None] * left.shape[1]


def inversions(ranks: np.ndarray) -> int:
    """Pairs of which the later is smaller."""
    return sum(int((left.shape[1] - _reach(left, right, top))[right < top].sum()) for left, right, _, _, top in _merge_levels(ranks))


def inverted_pairs(ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Their places: earlier, later."""
    before, after = [], []
    for left, right, at_left, at_right, top in _merge_levels(ranks):
        reach = _reach(left, right, top)
        many = np.where(right < top, left.shape[1] - reach, 0)
        row, column = np.nonzero(many)
        times = many[row, column]
        if len(times):
            start = np.repeat(reach[row, column], times)
            step = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            before.append(at_left[np.repeat(row, times), start + step])
            after.append(np.repeat(at_right[row, column], times))
    empty = np.zeros(0, np.int64)
    return (np.concatenate(before), np.concatenate(after)) if before else (empty, empty)


def mann_kendall(y: np.ndarray) -> int:
    """Rising pairs less falling ones."""
    ranks = _dense(y)
    return inversions(ranks.max(initial=0) - ranks) - inversions(ranks)


def _order(y: np.ndarray, m: float) -> np.ndarray:
    """Points by height over the line of slope m, later ones first where they are level."""
    place = np.arange(len(y))
    return np.lexsort((-place, y - m * place))


def _up_to(y: np.ndarray, m: float) -> int:
    """How many slopes are m at most."""
    place = np.empty(len(y), np.int64)
    place[_order(y, m)] = np.arange(len(y))
    return inversions(place)  # a later point that comes first


def sen_slope(y: np.ndarray, listed: int | None = None) -> float | None:
    """The median of the slopes of all pairs of points, one step apart each."""
    n = len(y)
    if n < 2:
        return None
    total = n * (n - 1) // 2
    r1, r2 = (total - 1) // 2, total // 2
    listed = max(4 * n, 200_000) if listed is None else listed
    steps = np.diff(y)
    low, high = float(steps.min()), float(steps.max())  # every slope is a mean of steps
    if low == high:
        return low
    low = np.nextafter(low, -np.inf) - 1e-9 * max(1.0, abs(low))
    high = high + 1e-9 * max(1.0, abs(high))
    below, upto = 0, total
    if total > listed:  # a guess of where the median lies saves most turns
        rng = np.random.default_rng(0)
        a, b = rng.integers(0, n, 20_000), rng.integers(0, n, 20_000)
        guess = np.sort((y[b] - y[a])[a != b] / (b - a)[a != b])
        spread = len(guess) // 40
        for m in (guess[len(guess) // 2 - spread], guess[len(guess) // 2 + spread]):
            if low < m < high:
                c = _up_to(y, m)
                if c <= r1:
                    low, below = m, c
                elif c > r2:
                    high, upto = m, c
    while upto - below > listed:
        m = low + (high - low) / 2
        if not low < m < high:
            return float(high)  # all that are left lie within one step of precision
        c = _up_to(y, m)
        if c <= r1:
            low, below = m, c
        elif c > r2:
            high, upto = m, c
        else:  # m parts the two middle slopes
            return (_select(y, low, m, below, c, r1, listed) + _select(y, m, high, c, upto, r2, listed)) / 2
    a, b = _between(y, low, high)
    slopes = np.sort((y[b] - y[a]) / (b - a))
    return float((slopes[r1 - below] + slopes[r2 - below]) / 2)


def _between(y: np.ndarray, low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs with a slope over ``low`` and up to ``high``: they change places between the two orders."""
    by_low, place = _order(y, low), np.empty(len(y), np.int64)
    place[_order(y, high)] = np.arange(len(y))
    first, second = inverted_pairs(place[by_low])
    return by_low[first], by_low[second]


def _select(y: np.ndarray, low: float, high: float, below: int, upto: int, rank: int, listed: int) -> float:
    """The slope of a rank, which lies over ``low`` (``below`` slopes don't) and up to ``high`` (``upto`` do)."""
    while upto - below > listed:
        m = low + (high - low) / 2
        if not low < m < high:
            return float(high)
        c = _up_to(y, m)
        if c <= rank:
            low, below = m, c
        else:
            high, upto = m, c
    a, b = _between(y, low, high)
    return float(np.sort((y[b] - y[a]) / (b - a))[rank - below])


def trend(df: DataFrame, key: str, order: str, value: str, short: int = 300) -> DataFrame:
    """key, s, slope, n of each series over its points in order.

    Where no series has more than ``short`` points their pairs are few, and are joined; else a series is one task's, and its pairs
    are not made.
    """
    kind = dict(df.dtypes)[key]
    w = Window.partitionBy(key).orderBy(order)
    points = df.where(F.col(value).isNotNull()).select(key, F.row_number().over(w).alias("_i"), F.col(value).cast("double").alias("_x"))
    if (points.groupBy(key).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0) <= short:
        later = points.select(key, F.col("_i").alias("_j"), F.col("_x").alias("_y"))
        pairs = points.join(later, key).where("_i < _j")
        slope = (F.col("_y") - F.col("_x")) / (F.col("_j") - F.col("_i"))
        return pairs.groupBy(key).agg(F.sum(F.signum(F.col("_y") - F.col("_x"))).cast("long").alias("s"), F.percentile(slope, F.lit(0.5)).alias("slope"), F.max("_j").cast("long").alias("n"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        y = rows.sort_values("_i")["_x"].to_numpy(float)
        return pd.DataFrame({key: rows[key].iloc[:1], "s": [mann_kendall(y)], "slope": [sen_slope(y)], "n": [len(y)]})

    return points.groupBy(key).applyInPandas(run, f"{key} {kind}, s long, slope double, n long").where("n > 1")
