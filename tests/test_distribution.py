import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelstats.operators import distribution as distribution_module
from panelstats.operators.distribution import distribution, magnitude_bucket, narrowed, ranks_within

PROBS = {"p05": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95}


def check(got, values, sd_tol=1e-9):
    v = np.array(values, float)
    assert got.n == len(v)
    assert math.isclose(got["mean"], v.mean(), rel_tol=1e-12, abs_tol=1e-12)
    assert (got["min"], got["max"]) == (v.min(), v.max())
    assert (got.n_zero, got.n_negative) == ((v == 0).sum(), (v < 0).sum())
    for name, p in PROBS.items():
        assert math.isclose(got[name], np.quantile(v, p), rel_tol=1e-12, abs_tol=1e-12), name
    if len(v) > 1:
        assert math.isclose(got.sd, v.std(ddof=1), rel_tol=sd_tol, abs_tol=1e-12)
    else:
        assert got.sd is None


def test_fixture(spark):
    df = spark.createDataFrame([("g", float(v)) for v in [5, 0, -2, 3, 4, 0, 7]], "g string, v double")
    r = distribution(df, ["g"], ["v"]).first()
    assert (r.median, r.n_zero, r.n_negative, r.sum) == (3.0, 2, 1, 17.0)
    assert (r.p05, r.p25, r.p75, r.p95) == pytest.approx((-1.4, 0.0, 4.5, 6.4))
    assert r.sd == pytest.approx(3.2071349030)


NUMBER = st.one_of(
    st.sampled_from([0.0, -0.0, 1.0, -1.0, 2.0, 0.5, 1024.0, 1e-12, 1.7e9]),
    st.floats(-1e9, 1e9, allow_nan=False), st.integers(-5, 5).map(float))


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(NUMBER, min_size=1, max_size=40), min_size=1, max_size=3), st.sampled_from([0, 3, 12]))
def test_against_numpy(spark, groups, bits):
    df = spark.createDataFrame([(g, v) for g, vs in enumerate(groups) for v in vs], "g int, v double")
    for r in distribution(df, ["g"], ["v"], bits=bits).collect():
        check(r, groups[r.g])


def test_hot_group_with_ties(spark):
    """One group and one value hold most rows; results stay whole and exact."""
    df = spark.range(30_000).select(
        F.when(F.col("id") % 10 == 0, "cold").otherwise("hot").alias("g"),
        F.when(F.col("id") % 3 == 0, 7.25).otherwise((F.col("id") % 1013) / 8.0).cast("double").alias("v"))
    local = df.toPandas()
    for r in distribution(df, ["g"], ["v"]).collect():
        check(r, local[local.g == r.g].v)


def test_large_offset_keeps_precision(spark):
    """A mean of half a thousand million standard deviations; plain sums of squares keep no digit here."""
    values = [1e9 + k / 7 for k in range(50)]
    df = spark.createDataFrame([("g", v) for v in values], "g string, v double")
    check(distribution(df, ["g"], ["v"]).first(), values, sd_tol=1e-8)


def test_missing_values_and_keys(spark, rows):
    df = spark.createDataFrame([("a", None), ("a", float("nan")), ("b", 1.0), (None, 2.0)], "g string, v double")
    out = distribution(df, ["g"], ["v"], {"median": 0.5}, carry={"last": ("max", F.col("v").isNull().cast("int"))})
    assert rows(out, "g", "n_rows", "n", "mean", "median") == [("a", 2, 0, None, None), ("b", 1, 1, 1.0, 1.0)]


def test_several_variables(spark, rows):
    df = spark.createDataFrame([("a", 1.0, 10), ("a", 3.0, 30)], "g string, v double, w int")
    assert rows(distribution(df, ["g"], ["v", "w"], {"median": 0.5}), "variable", "median") == [("v", 2.0), ("w", 20.0)]


def test_bucket_is_monotone(spark):
    rng = np.random.default_rng(1)
    values = np.sort(np.concatenate([
        rng.normal(size=400), 10.0 ** rng.uniform(-300, 300, 400), -(10.0 ** rng.uniform(-300, 300, 400)),
        [0.0, 5e-324, -5e-324, math.inf, -math.inf], 2.0 ** np.arange(-40, 40), np.nextafter(2.0 ** np.arange(-40, 40), 0)]))
    df = spark.createDataFrame([(float(v),) for v in values], "v double").coalesce(1)
    keys = [r[0] for r in df.select(magnitude_bucket("v")).collect()]
    assert keys == sorted(keys)


def test_ranks(spark, rows):
    df = spark.createDataFrame([("a", v) for v in [3.0, 1.0, 3.0, 2.0, -1.0]], "g string, v double")
    assert rows(ranks_within(df, ["g"], "v"), "v", "avg_rank") == [(-1.0, 1.0), (1.0, 2.0), (2.0, 3.0), (3.0, 4.5)]


def clock(spark, count):
    """Seconds of eleven days at a clock's offset, all in one magnitude bucket."""
    return spark.range(count).select(F.lit("g").alias("g"), (F.lit(1.7e9) + (F.col("id") * 7919 % count)).alias("v"))


def test_one_bucket_holds_all(spark):
    """Values that share a magnitude bucket are spread over parts; what meets in the end is a small share of them."""
    count = 1_000_000
    df = clock(spark, count)
    assert df.select(magnitude_bucket("v")).distinct().count() < 10
    values = 1.7e9 + np.arange(count)
    check(distribution(df, ["g"], ["v"]).first(), values, sd_tol=1e-8)
    rows = df.select("g", F.col("v").alias("_v"), F.lit(1).alias("_c"), F.lit(0).alias("_before"), F.lit(count).alias("_d"),
                     F.lit(1.7e9).alias("_lo"), F.lit(1.7e9 + count - 1).alias("_hi"))
    near, keys = narrowed(rows, ["g"])
    assert max(r["count"] for r in near.groupBy(*keys).count().collect()) <= 0.02 * count
    assert near.groupBy("g", "_part0").count().agg(F.max("count")).first()[0] <= 0.02 * count
    ranked = ranks_within(df, ["g"], "v")
    assert ranked.where("avg_rank <> v - 1.7e9 + 1").count() == 0 and ranked.count() == count


@pytest.mark.parametrize("listed", [distribution_module.LISTED, 0, 3])
def test_doubles_next_to_each_other(spark, monkeypatch, listed):
    """Neighbouring doubles, and clusters on many scales, keep their ranks with and without cuts."""
    monkeypatch.setattr(distribution_module, "LISTED", listed)
    rng = np.random.default_rng(2)
    values = np.concatenate([1.0 + np.arange(300) * 2.0 ** -52, 1.0 + 2.0 ** -rng.uniform(10, 52, 700), [1.0] * 5,
                             -1.0 - np.arange(50) * 2.0 ** -40])
    df = spark.createDataFrame([("g", float(v)) for v in values], "g string, v double")
    got = distribution(df, ["g"], ["v"]).first()
    for name, p in PROBS.items():
        assert got[name] == pytest.approx(np.quantile(values, p), rel=1e-15)
    order = {v: (np.sum(values < v) + 1 + np.sum(values <= v)) / 2 for v in set(values.tolist())}
    assert {r["v"]: r["avg_rank"] for r in ranks_within(df, ["g"], "v").collect()} == order
