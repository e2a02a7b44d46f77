"""End-to-end plans on small tables: every result exists and the key figures agree."""

import datetime as dt
import subprocess
import sys
import os

import pytest
from pyspark.sql import functions as F

from panelstats.functions.scalar import classify, equals_ci
from panelstats.plans import daily_study, evidence_study, panel_trend
from panelstats.session import new_folder

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture(scope="module")
def study(spark):
    """Nine pixels over six years; pixel 9 misses a year. Values fall steadily."""
    base = spark.range(54).select((F.col("id") % 9).alias("p"), (2000 + F.floor(F.col("id") / 9)).cast("int").alias("year"))
    pixels = base.where("not (p = 8 and year = 2003)").select(
        F.col("p").cast("string").alias("x"), F.lit("1").alias("y"), F.when(F.col("p") < 4, "A").otherwise("B").alias("subdistrict"),
        "year", (0.9 - 0.1 * (F.col("year") - 2000) + 0.005 * F.col("p") + 0.01 * (F.col("year") % 2)).alias("ff"),
        (1 + F.col("p") % 4).alias("count"))
    areas = spark.range(18).select(
        F.element_at(F.array(F.lit("All"), F.lit("A"), F.lit("B")), (F.col("id") % 3 + 1).cast("int")).alias("subdistrict"),
        (2000 + F.floor(F.col("id") / 3)).cast("int").alias("year"),
        (0.5 + 0.01 * F.col("id") + 0.02 * (F.col("id") % 5)).alias("ws"), F.lit(5).alias("count"))
    return pixels, areas


def test_panel_study(spark, study, rows):
    out = panel_trend.panel_tables(*study, panel_trend.PanelColumns(), 2000, 2005, block=2, n_boot=500)
    annual = out["annual"].orderBy("year").collect()
    assert [r.n_balanced for r in annual] == [8] * 6 and [r.n_full for r in annual] == [9, 9, 9, 8, 9, 9]
    trends = {r.series: r for r in out["series_trends"].collect()}
    assert set(trends) == {*panel_trend.SERIES, "area_total"}
    assert trends["balanced"].kendall_tau == pytest.approx(-1) and -0.11 < trends["balanced"].ols_slope < -0.09
    assert out["robustness"].count() == 15
    assert rows(out["coverage"]) == [(5, 1), (6, 8)]
    assert {r[0] for r in rows(out["subarea_trends"], "subdistrict")} == {"A", "B"}
    assert {r[0] for r in rows(out["area_trends"], "subdistrict")} == {"A", "B"}
    assert out["diagnostics"].first().balanced_rows == 48
    folder = new_folder(spark, "results")
    panel_trend.write_all(out, folder)
    for name in out:
        assert spark.read.parquet(f"{folder}/{name}").count() == out[name].count(), name


def test_panel_gates(study):
    pixels, areas = study
    c = panel_trend.PanelColumns()
    with pytest.raises(ValueError, match="unique_pixel_period"):
        panel_trend.prepare(pixels.unionByName(pixels.limit(1)), areas, c, 2000, 2005)
    with pytest.raises(ValueError, match="missing columns"):
        panel_trend.prepare(pixels.drop("ff"), areas, c, 2000, 2005)
    with pytest.raises(ValueError, match="n_periods"):
        panel_trend.prepare(pixels, areas, c, 2000, 2006)


@pytest.fixture(scope="module")
def hydrology(spark):
    days = []
    for year in (2019, 2020):
        for g, late in (("W", 0), ("D", 2)):
            for i in range(late, 20):
                level = float((i * 7 + year + len(days)) % 11 - 4)
                inflow, outflow = float(i % 3), float(i % 2)
                net = inflow - outflow
                days.append((year, g, dt.date(year, 5, 1) + dt.timedelta(days=i), inflow, outflow, net,
                             net if year == 2020 else None, level, 1.5, 0.5, 0.1, 0.2, net + 0.7,
                             1.0 if year == 2019 else None, None if year == 2019 else 2.0))
    c = daily_study.DailyColumns()
    return c, spark.createDataFrame(days, ["year", "treatment", "date", *c.numeric])


def test_hydrology_study(hydrology, rows):
    c, daily = hydrology
    out = daily_study.hydrology_tables(daily, c, "W", (0, 1, 5), (2019, 2020))
    for name, df in out.items():
        assert df.count() > 0, name
    assert rows(out["net_reproduction"], "year", "n_compared", "rmse") == [(2020, 18, 0.0), (2020, 20, 0.0)]
    assert all(r[0] < 1e-12 for r in rows(out["balance_reproduction"], "max_absolute_difference"))
    common = {(r.year, r.treatment): r for r in out["common_window"].collect()}
    assert {r.n_days for r in common.values()} == {18}
    assert common[2019, "W"].model_b_sum is None and common[2020, "W"].model_a_sum is None
    base = out["contrasts"].where("treatment = 'W'").select("mean_level_difference").collect()
    assert [r[0] for r in base] == [0.0, 0.0]
    total = out["spells"].groupBy("year", "treatment").agg(F.sum("length").alias("n"))
    assert rows(total, "n") == [(18,), (18,), (20,), (20,)]
    assert out["thresholds"].count() == 12 and out["threshold_change"].count() == 8
    with pytest.raises(ValueError, match="unique_day"):
        daily_study.hydrology_tables(daily.unionByName(daily), c, "W")


def test_sensor_study(spark, hydrology, rows):
    c, daily = hydrology
    readings = daily.select("year", "treatment", "date", F.explode(F.array(F.lit("P1"), F.lit("P2"))).alias("sensor"), "level").select(
        "year", "treatment", "date", "sensor",
        F.when(F.col("sensor") == "P1", F.col("level")).otherwise(3 - F.col("level") / 2).alias("depth"))
    out = daily_study.sensor_tables(readings, daily, c)
    for name, df in out.items():
        assert df.count() > 0, name
    assert {r.n_entities for r in out["correlation_summary"].collect()} == {4}
    zero = out["lagged"].where("lag = 0").drop("lag")
    assert rows(zero) == rows(out["contemporaneous"])
    assert rows(out["platform_monthly"], "year", "month") == [(2019, dt.date(2019, 5, 1)), (2020, dt.date(2020, 5, 1))]


def test_yield_study(spark, rows):
    data = [(y, r, loc, float(loc % 5 + (y - 2018) * (2 if r == "A" else 1))) for y in (2019, 2020)
            for r, lo in (("W", 1), ("A", 9)) for loc in range(lo, lo + 8)]
    plots = spark.createDataFrame([*data, (2019, "W", 99, 1.0)], "year int, regime string, location int, yield double")
    groups = {(y, r): {"n0": list(range(lo, lo + 8, 2)), "n1": list(range(lo + 1, lo + 8, 2))}
              for y in (2019, 2020) for r, lo in (("W", 1), ("A", 9))}
    rules = [((None, "W"), 1, 4, 1), ((None, "W"), 5, 8, 2), ((None, "A"), 9, 12, 1), ((None, "A"), 13, 16, 2)]
    out = daily_study.yield_tables(plots, groups, rules, ["n0", "n1"], "W", (2019, 2020), "n0")
    assert out["unresolved"].count() == 1 and out["plot_means"].count() == 16 and out["regime_by_stratum"].count() == 8
    assert out["assignment_qa"].count() == 17
    assert {r[0] for r in rows(out["common_index_plots"], "n_strata")} == {2}
    assert out["direction"].count() == 2 and out["primary"].count() == 4


def test_evidence_study(spark, rows):
    r = spark.createDataFrame([("s1", "A1", "yes", "up"), ("s2", "C", "no", None)], "study_id string, evidence_tier string, direct string, d string")
    out = evidence_study.evidence_tables(
        r, {"is_direct": equals_ci("direct", "yes")}, {"direct": F.col("is_direct")}, ["d"],
        {"c": classify([(F.col("d") == "up", "support")], "unclear")}, F.col("is_direct"), ["study_id"])
    assert rows(out["claim_summary"]) == [("c", "support", 1), ("c", "unclear", 1)]
    assert rows(out["local"]) == [("s1",)] and rows(out["directions"]) == [("direct", "d", "up", 1)]


def test_kernels_run_without_the_package_on_the_path(tmp_path):
    """Executors get the vectorised kernels with the query."""
    code = (
        f"import sys; sys.path.insert(0, {ROOT!r})\n"
        "from panelstats.session import build_session\n"
        "from panelstats.operators import trend\n"
        "spark = build_session(1, **{'spark.driver.memory': '1g'})\n"
        "df = spark.range(9).selectExpr('1 as s', 'id as x', 'id * 2.0 as y')\n"
        "print('tau', trend.trend_table(df, ['s'], 'x', 'y').first().kendall_tau)\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "tau 1.0" in done.stdout, done.stderr[-2000:]
