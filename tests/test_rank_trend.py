"""Kendall's tau of long series against the array kernel."""

import math

import numpy as np
import pytest

from panelstats.operators import rank_trend, trend


def series(kind, n, rng):
    x = {"ties": rng.integers(0, 7, n) * 1.0, "hot x": np.where(rng.random(n) < 0.6, 3.0, rng.normal(size=n))}.get(kind, np.arange(n) * 1.0)
    y = {"ties": rng.integers(0, 5, n) * 1.0, "hot y": np.where(rng.random(n) < 0.6, 3.0, rng.normal(size=n)), "flat": np.ones(n),
         "rising": np.arange(n) * 2.0}.get(kind, rng.normal(size=n) + 0.01 * np.arange(n))
    return x, y


@pytest.mark.parametrize("block", [3, 40, rank_trend.BLOCK_ROWS])
def test_equals_the_array_kernel(spark, block):
    rng = np.random.default_rng(3)
    kinds = ["plain", "ties", "hot x", "hot y", "flat", "rising", "short", "pair", "one"]
    data = {k: series(k, {"short": 3, "pair": 2, "one": 1}.get(k, 150), rng) for k in kinds}
    rows = [(k, float(a), float(b)) for k, (x, y) in data.items() for a, b in zip(x, y)]
    rows += [("plain", None, 1.0), ("plain", 1.0, float("nan")), (None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "s string, x double, y double").repartition(5)
    got = {r.s: r for r in rank_trend.kendall_long(df, ["s"], "x", "y", block).collect()}
    assert set(got) == set(kinds)
    for k, (x, y) in data.items():
        assert got[k].n == len(x)
        tau, p = trend._kendall(x, y) if len(x) >= 3 else (math.nan, math.nan)
        if math.isnan(tau):
            assert got[k].kendall_tau is None and got[k].kendall_p is None
        else:
            assert got[k].kendall_tau == pytest.approx(tau, abs=1e-14) and got[k].kendall_p == pytest.approx(p, rel=1e-9)
            i, j = np.triu_indices(len(x), 1)
            signs = np.sign(x[j] - x[i]) * np.sign(y[j] - y[i])
            assert (got[k].score, got[k].discordant) == (signs.sum(), (signs < 0).sum())


def test_without_groups_and_without_rows(spark):
    df = spark.createDataFrame([(float(k), float(-k)) for k in range(50)], "x double, y double")
    row = rank_trend.kendall_long(df, [], "x", "y", 8).first()
    assert (row.n, row.discordant, row.kendall_tau) == (50, 1225, -1.0)
    empty = spark.createDataFrame([], "s string, x double, y double")
    assert rank_trend.kendall_long(empty, ["s"], "x", "y").count() == 0


def test_weighted_inversions():
    rng = np.random.default_rng(7)
    for n in (0, 1, 2, 5, 33, 100):
        v, w = rng.permutation(n), rng.integers(1, 9, n)
        want = sum(int(w[i] * w[j]) for i in range(n) for j in range(i + 1, n) if v[i] > v[j])
        assert rank_trend.weighted_inversions(v, w) == want
