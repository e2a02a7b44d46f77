"""Trend statistics of period-indexed series, one series per group.

Least squares runs as native aggregates. Kendall and Theil-Sen need every pair
of points; the pairs are never laid out as rows. A series (one point per period)
travels as two arrays. Kendall counts inversions. Theil-Sen counts the slopes below
a threshold t as the inversions of y - t x, brackets a rank between thresholds taken
from random pairs, and lists only the real slopes inside the last bracket: a few
O(n log n) passes. Only where a large share of all slopes is equal to the last bits
(whole numbers on a grid) are all pairs looked at, a bounded number at a time.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panelstats.functions.pvalues import kendall_exact, kendall_normal, p_slope
from panelstats.functions.scalar import is_finite, nan_to_null, pearson

LISTED = 1 << 20  # slopes held at once


def _tie_sizes(v: np.ndarray) -> np.ndarray:
    sizes = np.unique(v, return_counts=True)[1]
    return sizes[sizes > 1].astype(float)


def _inversions(ranks: np.ndarray, listed: bool = False):
    """Pairs i < j with ranks[i] > ranks[j] (ranks from 0): their number, or their places (i, j).

    Merges sorted blocks of doubling size; a level is one search over all its blocks at once.
    """
    n, width, total = len(ranks), 1, 0
    place, found = np.arange(n), []
    value = np.asarray(ranks, np.int64)
    while width < n:
        block = place // (2 * width)
        right = (place // width) % 2 == 1
        span = int(value.max(initial=0)) + 1
        # within a pair of blocks: how many values of the left one are at most the right one's value
        keys = block * span + value
        left_keys, right_keys = keys[~right], keys[right]
        starts = np.searchsorted(left_keys, block[right] * span)
        ends = np.searchsorted(left_keys, (block[right] + 1) * span)
        upto = np.searchsorted(left_keys, right_keys, side="right")
        total += int((ends - upto).sum())
        order = np.argsort(keys, kind="stable")
        if listed:
            size = ends - np.maximum(upto, starts)
            own = np.repeat(np.flatnonzero(right), size)
            step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            found.append((np.flatnonzero(~right)[np.repeat(upto, size) + step], own))
            if width == 1:
                origin = np.arange(n)
            i, j = found.pop()
            found.append((origin[i], origin[j]))
            origin = origin[order]
        value = value[order]
        width *= 2
    if not listed:
        return total
    return tuple(np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))


def _count_descents(v: np.ndarray) -> int:
    """Pairs i < j with v[i] > v[j]."""
    return _inversions(np.unique(v, return_inverse=True)[1])


def _kendall(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    n = len(x)
    order = np.lexsort((y, x))
    discordant = _count_descents(y[order])
    pairs = n * (n - 1) // 2
    xt, yt = _tie_sizes(x), _tie_sizes(y)
    half = lambda t: float((t * (t - 1)).sum() / 2)
    both = half(_tie_sizes(np.unique(np.column_stack([x, y]), axis=0, return_inverse=True)[1].ravel()))
    score = pairs - half(xt) - half(yt) + both - 2 * discordant
    scale = math.sqrt(pairs - half(xt)) * math.sqrt(pairs - half(yt))
    if scale == 0:
        return math.nan, math.nan
    tau = min(1.0, max(-1.0, score / scale))
    exact = not len(xt) and not len(yt) and (n <= 33 or min(discordant, pairs - discordant) <= 1)
    p = kendall_exact(n, discordant) if exact else kendall_normal(score, n, xt, yt)
    return tau, p


def _slope_parts(x: np.ndarray, y: np.ndarray):
    """The slopes of all pairs with different x, a bounded number at a time."""
    n, step = len(x), max(1, LISTED // max(1, len(x)))
    for a in range(0, n, step):
        dx = x[None, :] - x[a:a + step, None]
        later = np.arange(n)[None, :] > np.arange(a, min(a + step, n))[:, None]
        keep = later & (dx != 0)
        yield (y[None, :] - y[a:a + step, None])[keep] / dx[keep]


class _Slopes:
    """All slopes of a series, counted and listed without laying out the pairs."""

    def __init__(self, x: np.ndarray, y: np.ndarray) -> None:
        order = np.lexsort((y, x))
        self.x, self.y = x[order], y[order]
        self.at = self.x - self.x[len(x) // 2]  # smaller numbers lose fewer digits in y - t x
        gaps = np.diff(self.x)
        self.gap = gaps[gaps > 0].min(initial=math.inf)
        self.most = 1 + 2 * (self.y.max() - self.y.min()) / self.gap  # beyond every slope

    def doubt(self, t: float) -> float:
        """Slopes nearer to t than this may be counted on the wrong side."""
        size = np.abs(self.y).max() + abs(t) * np.abs(self.at).max() + (1 + abs(t)) * np.abs(self.x).max() * 2.0 ** -40
        return 2.0 ** -49 * (size / self.gap + abs(t))

    def _ranked(self, t: float) -> np.ndarray:
        """Ranks of y - t x; points of equal x keep their order."""
        order = np.lexsort((self.y, self.y - t * self.at))
        ranks = np.empty(len(order), np.int64)
        ranks[order] = np.arange(len(order))
        return ranks

    def below(self, t: float) -> int:
        """How many slopes are below t, but for doubtful ones."""
        return _inversions(self._ranked(t))

    def between(self, low: float, high: float) -> np.ndarray:
        """The slopes of a little more than [low, high]."""
        low, high = low - 2 * self.doubt(low), high + 2 * self.doubt(high)
        first = np.argsort(self._ranked(low))
        i, j = (first[k] for k in _inversions(self._ranked(high)[first], listed=True))
        i, j = np.minimum(i, j), np.maximum(i, j)
        dx = self.x[j] - self.x[i]
        return (self.y[j] - self.y[i])[dx != 0] / dx[dx != 0]

    def some(self, low: float, high: float, rng: np.random.Generator) -> np.ndarray:
        """Slopes of random pairs in (low, high), sorted."""
        found, n = [], len(self.x)
        for _ in range(8):
            i, j = rng.integers(0, n, (2, 1 << 20))
            dx = self.x[j] - self.x[i]
            s = (self.y[j] - self.y[i])[dx != 0] / dx[dx != 0]
            found.append(s[(s > low) & (s < high)])
            if sum(map(len, found)) >= 20_000:
                break
        return np.sort(np.concatenate(found))

    def bracket(self, rank: int, total: int) -> tuple[float, float, int, int]:
        """(low, high, slopes below low, slopes below high) around a rank, small enough to be listed where possible."""
        rng = np.random.default_rng(rank)
        low, high, under, upto = -self.most, self.most, 0, total
        while upto - under > LISTED:
            s = self.some(low, high, rng)
            if len(s) < 100:
                break
            at, reach = (rank - under) / (upto - under) * len(s), 3 * math.sqrt(len(s))
            ends = []
            for place, side in ((at - reach, -1), (at + reach, 1)):
                if not 0 <= place < len(s):
                    ends.append(low if side < 0 else high)
                    continue
                t = s[int(place)]
                ends.append(t + side * 4 * self.doubt(t))  # past the slopes that equal it
            counts = [under if ends[0] == low else self.below(ends[0]), upto if ends[1] == high else self.below(ends[1])]
            before = upto - under
            if counts[0] <= rank < counts[1]:
                low, high, under, upto = *ends, *counts
            elif rank < counts[0] and ends[0] > low:
                high, upto = ends[0], counts[0]
            elif ends[1] < high:
                low, under = ends[1], counts[1]
            if upto - under > 0.9 * before:
                break  # many equal slopes
        return low, high, under, upto


def _slopes_at(x: np.ndarray, y: np.ndarray, ranks: list[int]) -> list[float]:
    """The slopes of the given 0-based ranks among all pairs, as they come from real pairs."""
    n = len(x)
    if n * (n - 1) // 2 <= LISTED:
        listed = np.sort(np.concatenate(list(_slope_parts(x, y))))
        return [float(listed[r]) for r in ranks]
    slopes, found = _Slopes(x, y), {}
    ties = _tie_sizes(x)
    total = n * (n - 1) // 2 - int((ties * (ties - 1)).sum() // 2)
    for rank in sorted(set(ranks)):
        low, high, under, upto = slopes.bracket(rank, total)
        value = None
        if upto - under <= 2 * LISTED and math.isfinite(slopes.most):
            # a place between listed slopes, below the wanted one, near which no slope is: there the count is exact
            s = np.sort(slopes.between(low, high))
            wide = np.flatnonzero(np.diff(s) > 4 * slopes.doubt(max(abs(low), abs(high)))) + 1
            wide = wide[(s[wide] > low) & (wide <= np.searchsorted(s, low) + max(rank - under, 0))]
            if under == 0:
                value = float(s[rank]) if rank < len(s) and s[rank] < high else None
            elif len(wide):
                a = int(wide[-1])
                at = a + rank - slopes.below((s[a - 1] + s[a]) / 2)
                value = float(s[at]) if a <= at < len(s) and s[at] < high else None
        found[rank] = _by_bins(x, y, rank) if value is None else value
    return [found[r] for r in ranks]


def _by_bins(x: np.ndarray, y: np.ndarray, rank: int) -> float:
    """The slope of a rank by counting all slopes in bins, and the bin that holds it again, until it can be listed."""
    lo, hi, before = -math.inf, math.inf, 0  # the slope is in [lo, hi); before: slopes under lo
    while True:
        parts, size, low, high = [], 0, math.inf, -math.inf
        for s in _slope_parts(x, y):
            s = s[(s >= lo) & (s < hi)] if math.isfinite(hi) or math.isfinite(lo) else s
            if len(s):
                size, low, high = size + len(s), min(low, s.min()), max(high, s.max())
                if size <= LISTED:
                    parts.append(s)
        if size <= LISTED:
            return float(np.sort(np.concatenate(parts))[rank - before])
        if low == high:
            return float(low)
        edges = np.unique(np.linspace(low, high, 4097))
        if len(edges) < 3:
            edges = np.array([low, high, np.nextafter(high, math.inf)])
        count = np.zeros(len(edges), np.int64)
        for s in _slope_parts(x, y):
            s = s[(s >= low) & (s <= high)]
            count += np.bincount(np.searchsorted(edges, s, side="right") - 1, minlength=len(edges))
        upto = before + np.cumsum(count)
        k = int(np.searchsorted(upto, rank, side="right"))
        before, lo = int(upto[k] - count[k]), float(edges[k])
        hi = float(edges[k + 1]) if k + 1 < len(edges) else float(np.nextafter(high, math.inf))


def _theil_sen(x: np.ndarray, y: np.ndarray, alpha: float) -> tuple[float, float, float]:
    n = len(x)
    xt, yt = _tie_sizes(x), _tie_sizes(y)
    total = int(n * (n - 1) / 2 - (xt * (xt - 1)).sum() / 2)
    if total == 0:
        return math.nan, math.nan, math.nan
    inner = [total // 2] if total % 2 else [total // 2 - 1, total // 2]
    weight = lambda t: float((t * (t - 1) * (2 * t + 5)).sum())
    var = (n * (n - 1) * (2 * n + 5) - weight(xt) - weight(yt)) / 18
    if var < 0:
        return float(np.mean(_slopes_at(x, y, inner))), math.nan, math.nan
    reach = normal_quantile(0.5 + alpha / 2) * math.sqrt(var)
    low = max(round((total - reach) / 2) - 1, 0)
    high = min(round((total + reach) / 2), total - 1)
    *inner, low, high = _slopes_at(x, y, [*inner, low, high])
    return (inner[0] if total % 2 else (inner[0] + inner[1]) / 2), low, high


def normal_quantile(p: float) -> float:
    """Inverse of the normal distribution function."""
    from statistics import NormalDist

    return NormalDist().inv_cdf(p)


def _robust_kernel(alpha: float):
    @F.pandas_udf("kendall_tau double, kendall_p double, theil_sen_slope double, theil_sen_low double, theil_sen_high double")
    def robust(xs: pd.Series, ys: pd.Series) -> pd.DataFrame:
        rows = []
        for x, y in zip(xs, ys):
            x, y = np.asarray(x, float), np.asarray(y, float)
            rows.append(_kendall(x, y) + _theil_sen(x, y, alpha) if len(x) >= 3 else (math.nan,) * 5)
        names = ["kendall_tau", "kendall_p", "theil_sen_slope", "theil_sen_low", "theil_sen_high"]
        return pd.DataFrame(rows, columns=names, dtype=float)
    return robust


ROBUST = ["kendall_tau", "kendall_p", "theil_sen_slope", "theil_sen_low", "theil_sen_high"]


def finite_points(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    points = df.dropna(subset=list(by)).select(
        *by, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")
    )
    return points.where(is_finite("_x") & is_finite("_y"))


def _least_squares():
    enough = lambda c: F.when(F.count("*") >= 3, c)
    # a flat series has r = 0 by convention, and no slope exists on a single x
    r2 = F.when(F.var_pop("_y") == 0, 0.0).otherwise(F.regr_r2("_y", "_x"))
    spread = F.var_pop("_x") > 0
    return [
        F.count("*").alias("n"),
        enough(F.when(spread, F.regr_slope("_y", "_x"))).alias("ols_slope"),
        enough(F.when(spread, F.regr_intercept("_y", "_x"))).alias("ols_intercept"),
        enough(F.when(spread, r2)).alias("ols_r2"),
    ]


def trend_ols(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """Slope, intercept, r squared and two-sided p; all missing below three points."""
    fit = finite_points(df, by, x, y).groupBy(*by).agg(*_least_squares())
    return fit.withColumn("ols_p", nan_to_null(p_slope("ols_r2", "n")))


def series_arrays(points: DataFrame, by: Sequence[str], extra: Sequence = ()) -> DataFrame:
    """One row per series with its points as arrays xs, ys in x order."""
    packed = points.groupBy(*by).agg(
        F.array_sort(F.collect_list(F.struct("_x", "_y"))).alias("p"), *extra
    )
    return packed.withColumn("xs", F.col("p._x")).withColumn("ys", F.col("p._y")).drop("p")


def trend_robust(df: DataFrame, by: Sequence[str], x: str, y: str, alpha: float = 0.95) -> DataFrame:
    """Kendall tau-b with p, Theil-Sen slope with its interval."""
    arrays = series_arrays(finite_points(df, by, x, y), by, [F.count("*").alias("n")])
    out = arrays.withColumn("t", _robust_kernel(alpha)("xs", "ys"))
    return out.select(*by, "n", *[nan_to_null(F.col(f"t.{c}")).alias(c) for c in ROBUST])


def trend_table(df: DataFrame, by: Sequence[str], x: str, y: str, alpha: float = 0.95) -> DataFrame:
    """All trend statistics of every series from a single grouping.

    The series must be period-indexed (reduced to one point per period).
    """
    packed = series_arrays(finite_points(df, by, x, y), by, _least_squares())
    out = packed.withColumn("t", _robust_kernel(alpha)("xs", "ys")).withColumn("p", p_slope("ols_r2", "n"))
    return out.select(
        *by, "n", "ols_slope", "ols_intercept", "ols_r2", nan_to_null("p").alias("ols_p"),
        *[nan_to_null(F.col(f"t.{c}")).alias(c) for c in ROBUST],
    )


def detrend(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """Rows with fitted value and centred residual of the group's straight line."""
    whole = Window.partitionBy(*by)
    points = df.dropna(subset=[*by]).where(is_finite(F.col(x).cast("double")) & is_finite(F.col(y).cast("double")))
    xd, yd = F.col(x).cast("double"), F.col(y).cast("double")
    fitted = F.regr_intercept(yd, xd).over(whole) + F.regr_slope(yd, xd).over(whole) * xd
    out = points.withColumn("fitted", fitted).withColumn("raw", yd - F.col("fitted"))
    return out.withColumn("residual", F.col("raw") - F.avg("raw").over(whole)).drop("raw")


def residual_memory(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """Lag-1 autocorrelation and Durbin-Watson of the residuals."""
    w = Window.partitionBy(*by).orderBy(x)
    steps = detrend(df, by, x, y).withColumn("before", F.lag("residual").over(w))
    return steps.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.when(F.count("*") >= 3, pearson("before", "residual")).alias("lag1"),
        F.try_divide(
            F.sum((F.col("residual") - F.col("before")) * (F.col("residual") - F.col("before"))),
            F.sum(F.col("residual") * F.col("residual")),
        ).alias("durbin_watson"),
    )
