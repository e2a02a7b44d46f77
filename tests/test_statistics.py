import itertools
import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelstats.functions import pvalues
from panelstats.operators import bootstrap, correlation, trend

SERIES = [5, 4, 4.5, 2, 1]


def frame(spark, values=SERIES, name="s"):
    return spark.createDataFrame([(name, i + 1, float(v)) for i, v in enumerate(values)], "series string, year int, value double")


def test_trend_fixture(spark):
    t = trend.trend_table(frame(spark), ["series"], "year", "value").first()
    assert (t.n, t.ols_slope, t.ols_intercept) == (5, pytest.approx(-1), pytest.approx(6.3))
    assert t.ols_r2 == pytest.approx(0.8474576271) and t.ols_p == pytest.approx(0.0265478855)
    assert t.kendall_tau == pytest.approx(-0.8) and t.kendall_p == pytest.approx(0.0833333333)
    assert (t.theil_sen_slope, t.theil_sen_low, t.theil_sen_high) == (-1.0, -2.5, 0.5)


def test_short_flat_and_missing_series(spark):
    short = trend.trend_table(frame(spark, [1, 2]), ["series"], "year", "value").first()
    assert short.n == 2 and all(short[c] is None for c in short.asDict() if c not in ("series", "n"))
    flat = trend.trend_table(frame(spark, [2, 2, 2, 2]), ["series"], "year", "value").first()
    assert (flat.ols_slope, flat.ols_r2, flat.ols_p) == (0.0, 0.0, 1.0) and flat.kendall_tau is None
    gap = frame(spark).unionByName(spark.createDataFrame([("s", 6, float("nan"))], "series string, year int, value double"))
    assert trend.trend_ols(gap, ["series"], "year", "value").first().n == 5


def test_sign_flip(spark):
    up = trend.trend_robust(frame(spark, [-v for v in SERIES]), ["series"], "year", "value").first()
    assert up.kendall_tau == pytest.approx(0.8) and (up.theil_sen_slope, up.theil_sen_low, up.theil_sen_high) == (1.0, -0.5, 2.5)


def test_memory_and_residuals(spark):
    m = trend.residual_memory(frame(spark), ["series"], "year", "value").first()
    assert m.lag1 == pytest.approx(-1 / 3) and m.durbin_watson == pytest.approx(2.5)
    e = trend.detrend(frame(spark), ["series"], "year", "value").agg(F.sum("residual")).first()[0]
    assert abs(e) < 1e-12


def inversions(p):
    return sum(p[i] > p[j] for i, j in itertools.combinations(range(len(p)), 2))


@pytest.mark.parametrize("n", [3, 4, 5, 6])
def test_kendall_exact_by_enumeration(n):
    counts = [inversions(p) for p in itertools.permutations(range(n))]
    total = n * (n - 1) // 2
    for d in range(total + 1):
        tail = sum(c <= min(d, total - d) for c in counts) / len(counts)
        assert pvalues.kendall_exact(n, d) == pytest.approx(min(1.0, 2 * tail))


def test_t_tail():
    # closed forms for 1, 2 and 4 degrees of freedom
    t = np.array([0.3, 1.0, 2.5, 40.0])
    one = 1 - 2 / math.pi * np.arctan(t)
    two = 1 - t / np.sqrt(2 + t * t)
    c = 4 / (4 + t * t)
    four = 1 - t / np.sqrt(4 + t * t) * (1 + c / 2)
    for df, want in ((1, one), (2, two), (4, four)):
        assert pvalues.t_two_sided(t, np.full(4, df)) == pytest.approx(want, rel=1e-7, abs=1e-12)
    assert pvalues.t_two_sided(np.array([0.0, np.inf]), np.array([5, 5])) == pytest.approx([1.0, 0.0])


POINT = st.tuples(st.integers(0, 12), st.integers(-6, 6))


@settings(max_examples=200, deadline=None)
@given(st.lists(POINT, min_size=3, max_size=25))
def test_kendall_kernel_against_pairs(points):
    x, y = np.array(points, float).T
    tau, p = trend._kendall(x, y)
    s = sum(np.sign(b[0] - a[0]) * np.sign(b[1] - a[1]) for a, b in itertools.combinations(points, 2))
    nx = sum(a[0] != b[0] for a, b in itertools.combinations(points, 2))
    ny = sum(a[1] != b[1] for a, b in itertools.combinations(points, 2))
    if nx == 0 or ny == 0:
        assert math.isnan(tau)
    else:
        assert tau == pytest.approx(s / math.sqrt(nx * ny)) and 0 <= p <= 1


def all_slopes(x, y):
    i, j = np.triu_indices(len(x), k=1)
    keep = x[i] != x[j]
    return np.sort((y[j][keep] - y[i][keep]) / (x[j][keep] - x[i][keep]))


@settings(max_examples=100, deadline=None)
@given(st.lists(POINT, min_size=3, max_size=25))
def test_slopes_at_ranks(points):
    x, y = np.array(points, float).T
    want = all_slopes(x, y)
    ranks = sorted({0, len(want) // 2, len(want) - 1}) if len(want) else []
    assert trend._slopes_at(x, y, ranks) == [want[k] for k in ranks]


@pytest.mark.parametrize("n, listed", [(3, 1), (60, 40), (400, 1000), (3000, 1 << 20)])
def test_bounded_listing_gives_the_same_bits(monkeypatch, n, listed):
    rng = np.random.default_rng(n)
    x, y = np.arange(float(n)), np.round(rng.normal(size=n).cumsum(), 2)
    want = all_slopes(x, y)
    monkeypatch.setattr(trend, "LISTED", listed)
    ranks = [0, 1, len(want) // 3, len(want) // 2, len(want) - 1]
    assert trend._slopes_at(x, y, ranks) == [want[k] for k in ranks]


@pytest.mark.parametrize("kind", ["noise", "walk", "tied x", "irregular", "clock", "grid"])
def test_slope_ranks_equal_brute_force(monkeypatch, kind):
    """Ranks come from inversion counts and short lists; values are those of real pairs, to the bit."""
    rng = np.random.default_rng(4)
    monkeypatch.setattr(trend, "LISTED", 3000)
    for n in (3, 80, 400, 3000):
        x = {"tied x": rng.integers(0, max(n // 3, 2), n) * 1.0, "irregular": np.sort(rng.normal(size=n)),
             "clock": 1.7e9 + np.arange(n)}.get(kind, np.arange(n) * 1.0)
        y = {"walk": rng.normal(size=n).cumsum(), "grid": rng.integers(0, 5, n) * 1.0}.get(kind, rng.normal(size=n))
        order = np.lexsort((y, x))
        x, y = x[order], y[order]
        want = all_slopes(x, y)
        ranks = sorted({0, len(want) // 3, (len(want) - 1) // 2, len(want) // 2, len(want) - 1}) if len(want) else []
        assert trend._slopes_at(x, y, ranks) == [want[k] for k in ranks], (kind, n)


def test_long_series_need_no_pass_over_all_pairs(monkeypatch):
    rng = np.random.default_rng(5)
    monkeypatch.setattr(trend, "_slope_parts", None)  # would look at every pair
    n = 30_000
    x, y = np.arange(n) * 1.0, 0.25 * np.arange(n) + rng.normal(size=n).cumsum()
    slope, low, high = trend._theil_sen(x, y, 0.95)
    assert low < slope < high and slope == pytest.approx(np.polyfit(x, y, 1)[0], rel=0.05)


def test_inversions_are_counted_and_listed():
    rng = np.random.default_rng(6)
    for n in (0, 1, 2, 3, 9, 64, 200):
        v = rng.integers(0, 12, n)
        want = sorted((i, j) for i in range(n) for j in range(i + 1, n) if v[i] > v[j])
        i, j = trend._inversions(v, listed=True)
        assert sorted(zip(i.tolist(), j.tolist())) == want and trend._inversions(v) == len(want)


def test_bootstrap_against_refits(spark):
    """Every replicate equals a least-squares refit of fitted plus resampled residuals."""
    values = [3.0, 2.5, 2.7, 1.9, 2.2, 1.1, 1.4, 0.2]
    df = frame(spark, values)
    out = bootstrap.replicate_slopes(df, ["series"], "year", "value", [3], 700, 11)
    got = sorted(r.slope for r in out.select("slope").collect())
    x, y = np.arange(1.0, 9.0), np.array(values)
    slope, intercept = np.polyfit(x, y, 1)
    fitted = intercept + slope * x
    e = y - fitted - (y - fitted).mean()
    at = bootstrap.circular_positions("11|s|3", 8, 3, np.arange(700))
    want = sorted(np.polyfit(x, fitted + e[row], 1)[0] for row in at)
    assert got == pytest.approx(want, abs=1e-10)


def test_blocks_are_consecutive_and_uniform():
    at = bootstrap.circular_positions("5", 10, 4, np.arange(4000))
    assert ((at[:, 1] - at[:, 0]) % 10 == 1).all() and ((at[:, 9] - at[:, 8]) % 10 == 1).all()
    starts = np.bincount(at[:, [0, 4, 8]].ravel(), minlength=10)
    assert (abs(starts - 1200) < 150).all()


def test_bootstrap_summary(spark):
    df = frame(spark, [10 - 0.5 * i + (0.3 if i % 3 else -0.4) for i in range(22)])
    out = bootstrap.block_bootstrap(df, ["series"], "year", "value", [3, 4], 2000, 7)
    first, again = out.collect(), out.repartition(3).collect()
    assert sorted(first) == sorted(again)
    for r in first:
        assert r.low95 < r.observed_slope < r.high95 and r.share_negative == 1.0
        assert r.median_slope == pytest.approx(r.observed_slope, abs=0.01)


SENSORS = [("d1", 1, 2, 4), ("d2", 2, 4, 3), ("d3", 3, None, 2), ("d4", 4, 8, 1)]


def readings(spark):
    data = [(2001, "t", s, f"2001-01-0{i + 1}", None if v is None else float(v))
            for i, row in enumerate(SENSORS) for s, v in zip(("s1", "s2", "s3"), row[1:])]
    return spark.createDataFrame(data, "year int, treatment string, sensor string, d string, depth double").withColumn(
        "date", F.to_date("d"))


@pytest.mark.parametrize("tiles, block", [(1, 64), (3, 1), (2, 2)])
def test_matrix(spark, rows, tiles, block):
    m = correlation.correlation_matrix(readings(spark), ["year"], "date", "sensor", "depth", block, tiles)
    assert rows(m, "a", "b", "n", "r") == [("s1", "s2", 3, pytest.approx(1)), ("s1", "s3", 4, pytest.approx(-1)),
                                           ("s2", "s3", 3, pytest.approx(-1))]
    s = correlation.correlation_summary(m, ["year"]).first()
    assert (s.n_entities, s.median_r, s.min_r, s.max_r) == pytest.approx((3, -1, -1, 1)) and s.mean_r == pytest.approx(-1 / 3)
    wide = correlation.pivot_matrix(m, ["year"], ["s1", "s2", "s3"]).where("a = 's2'").first()
    assert (wide.s1, wide.s2, wide.s3) == (pytest.approx(1), 1.0, pytest.approx(-1))


def pair_frame(spark):
    ys = [1.0, 3.0, 2.0, 5.0, 4.0, 4.0, 6.0]
    xs = [2.0, 2.0, None, 3.0, 5.0, 1.0, 4.0]
    data = [(2001, i, y, x) for i, (y, x) in enumerate(zip(ys, xs))]
    return spark.createDataFrame(data, "year int, i int, y double, x double").withColumn(
        "date", F.date_add(F.lit("2001-01-01").cast("date"), F.col("i")))


def average_ranks(v):
    return [1 + sum(b < a for b in v) + (sum(b == a for b in v) - 1) / 2 for a in v]


@pytest.mark.parametrize("long_series", [False, True])
def test_spearman_drops_pairs_before_ranking(spark, long_series):
    c = correlation.correlate(pair_frame(spark), ["year"], "y", ["x"], long_series).first()
    y, x = [1.0, 3.0, 5.0, 4.0, 4.0, 6.0], [2.0, 2.0, 3.0, 5.0, 1.0, 4.0]
    assert c.n == 6 and c.pearson_r == pytest.approx(np.corrcoef(x, y)[0, 1])
    assert c.spearman_rho == pytest.approx(np.corrcoef(average_ranks(x), average_ranks(y))[0, 1])


def test_lags(spark, rows):
    df = pair_frame(spark)
    row = correlation.correlate_lagged(df, ["year"], "date", "y", ["x"], [0, 1, 2])
    calendar = correlation.correlate_lagged(df, ["year"], "date", "y", ["x"], [0, 1, 2], "calendar")
    assert rows(row) == rows(calendar)
    now = correlation.correlate(df, ["year"], "y", ["x"]).first()
    zero = row.where("lag = 0").first()
    assert (zero.n, zero.pearson_r, zero.spearman_rho) == (now.n, now.pearson_r, now.spearman_rho)


def test_best_lag_ties_take_the_first(spark, rows):
    df = spark.createDataFrame(
        [("v", 0, 5, 0.1, None), ("v", 1, 5, 0.1, -0.6), ("v", 3, 5, 0.1, 0.6), ("w", 0, 5, None, None)],
        "variable string, lag int, n long, pearson_r double, spearman_rho double")
    assert rows(correlation.best_lag(df, ["variable"]), "variable", "best_lag", "spearman_rho") == [("v", 1, -0.6)]


def test_constant_sides_give_missing(spark):
    df = spark.createDataFrame([(2001, float(i), 1.0, None) for i in range(5)], "year int, y double, flat double, none double")
    c = {r.variable: r for r in correlation.correlate(df, ["year"], "y", ["flat", "none"]).collect()}
    assert (c["flat"].n, c["flat"].pearson_r, c["flat"].spearman_rho) == (5, None, None) and "none" not in c
    m = trend.residual_memory(frame(spark, [1, 1, 1, 1]), ["series"], "year", "value").first()
    assert m.lag1 is None and m.durbin_watson is None
    same_x = spark.createDataFrame([("s", 1, float(i)) for i in range(4)], "series string, year int, value double")
    t = trend.trend_table(same_x, ["series"], "year", "value").first()
    assert t.n == 4 and t.ols_slope is None and t.kendall_tau is None and t.theil_sen_slope is None


def test_long_series_reduce_once(spark):
    """Ties, large offsets and constant sides; equal to the windowed form and to numpy."""
    rng = np.random.default_rng(8)
    x = 1.7e9 + rng.integers(0, 40, 3000)
    y = 0.1 * (x - 1.7e9) + rng.integers(0, 5, 3000)
    df = spark.createDataFrame([(1, float(a), float(b), 0.1) for a, b in zip(x, y)], "g int, x double, y double, flat double")
    long = {r.variable: r for r in correlation.correlate(df, ["g"], "y", ["x", "flat"], True).collect()}
    short = {r.variable: r for r in correlation.correlate(df, ["g"], "y", ["x", "flat"]).collect()}
    assert long["x"].n == 3000 and long["x"].pearson_r == pytest.approx(np.corrcoef(x, y)[0, 1], abs=1e-9)
    assert long["x"].spearman_rho == pytest.approx(short["x"].spearman_rho, abs=1e-12)
    assert long["flat"].pearson_r is None and long["flat"].spearman_rho is None


def test_long_series_scan_the_pairs_twice(spark):
    """Long correlations read their rows twice, however many steps there are, and cut large buckets on either side."""
    n, seen = 40000, spark.sparkContext.accumulator(0)

    def read(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    a = 1.7e9 + F.pmod(F.col("id") * 7919, F.lit(n))
    b = (F.pmod(F.col("id") * 7919, F.lit(n)) / 5 + F.pmod(F.col("id") * 31, F.lit(9001))).cast("long") % 700
    made = spark.range(n).select(a.alias("a"), b.cast("double").alias("b"))
    df = made.mapInPandas(read, "a double, b double")
    want = made.toPandas()
    for x, y in (("a", "b"), ("b", "a")):
        seen.value = 0
        row = correlation.correlate_pairs(df.select(F.lit("g").alias("g"), F.col(x).alias("x"), F.col(y).alias("y")), ["g"], True).first()
        assert seen.value == 2 * n
        assert row.n == n and row.pearson_r == pytest.approx(np.corrcoef(want.a, want.b)[0, 1], abs=1e-12)
        assert row.spearman_rho == pytest.approx(np.corrcoef(want.a.rank(), want.b.rank())[0, 1], abs=1e-12)


def test_long_series_without_groups(spark):
    pairs = spark.createDataFrame([(float(k), float(k * k)) for k in range(9)], "x double, y double")
    row = correlation.correlate_pairs(pairs, [], True).first()
    assert (row.n, row.spearman_rho) == (9, pytest.approx(1.0))


def test_tiles_follow_from_the_sensors(spark):
    """More sensors than a tile holds: dealt to several, with the same matrix as numpy's."""
    rng = np.random.default_rng(9)
    values = rng.normal(size=(12, 150)).cumsum(axis=0)
    rows = [(1, f"2024-01-{d + 1:02d}", f"s{k:03d}", float(values[d, k])) for d in range(12) for k in range(150)]
    df = spark.createDataFrame(rows, "g int, day string, sensor string, v double").withColumn("day", F.to_date("day"))
    assert [correlation.tiles_for(df, "sensor", size) for size in (512, 150, 149, 40, 1)] == [1, 1, 2, 4, 150]
    out = correlation.correlation_matrix(df, ["g"], "day", "sensor", "v", sensors_per_tile=40).collect()
    want = np.corrcoef(values.T)
    assert len(out) == 150 * 149 // 2
    assert all(r.r == pytest.approx(want[int(r.a[1:]), int(r.b[1:])], abs=1e-9) and r.n == 12 for r in out)
