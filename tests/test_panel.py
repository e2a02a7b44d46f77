"""Panels, quality reports, contrasts, joins, lookups, evidence."""

import pytest
from pyspark.sql import functions as F

from panelstats.functions.scalar import classify, equals_ci, matches_ci
from panelstats.operators import contrast, evidence, joins, mapping, panel, quality, series

PANEL = [
    (1.0, 1.0, "a", 2000, 0.4, 2), (1.0, 1.0, "a", 2001, 0.2, 4), (1.0, 1.0, "a", 2002, 0.1, 6),
    (2.0, 1.0, "a", 2000, 0.6, 6), (2.0, 1.0, "a", 2001, 0.4, 4), (2.0, 1.0, "a", 2002, 0.3, 1),
    (3.0, 1.0, "b", 2000, 0.2, 3), (3.0, 1.0, "b", 2002, 0.1, 3),
]
KEY = ["x", "y"]


@pytest.fixture(scope="module")
def pixels(spark):
    return spark.createDataFrame(PANEL, "x double, y double, area string, year int, value double, support int")


def test_annual_table(pixels, rows):
    t = panel.annual_table(pixels, KEY, "year", "value", "support", 3)
    got = {r.year: r for r in t.collect()}
    for year, n, bal, full, ge3, n3, w in [
        (2000, 2, 0.5, 0.4, 0.6, 1, 0.55), (2001, 2, 0.3, 0.3, 0.3, 2, 0.3), (2002, 2, 0.2, 1 / 6, 0.1, 1, 0.9 / 7)]:
        r = got[year]
        assert (r.n_balanced, r.n_balanced_support_ge3) == (n, n3)
        assert (r.mean_balanced, r.mean_full, r.mean_balanced_support_ge3, r.mean_balanced_weighted) == pytest.approx((bal, full, ge3, w))
        assert r.full_minus_balanced == pytest.approx(full - bal)
        assert r.spatial_se_balanced == pytest.approx(r.sd_balanced / n ** 0.5)


def test_coverage_and_balance(pixels, rows):
    assert rows(panel.coverage_histogram(pixels, KEY, "year")) == [(2, 1), (3, 2)]
    sizes = panel.balanced_panel(pixels, KEY, "year", 3).groupBy("year").count()
    assert {n for _, n in rows(sizes)} == {2}
    quality.enforce(quality.expect_equal_sizes(panel.balanced_panel(pixels, KEY, "year", 3), "year", 2))
    with pytest.raises(ValueError, match="equal_sizes"):
        quality.enforce(quality.expect_equal_sizes(pixels, "year", 3))


def test_differences_are_rounded_last(pixels):
    marked = panel.mark_balanced(pixels, KEY, "year", 3)
    r = panel.compare_populations(marked, ["year"], "balanced", "value", 2).where("year = 2002").first()
    assert (r.mean_full, r.mean_balanced, r.difference) == (0.17, 0.2, 0.03)


def test_whole_table_reports(spark, pixels):
    more = pixels.unionByName(spark.createDataFrame(
        [(1.0, 1.0, "all", 2000, 0.9, 1), (None, 1.0, "B", 2003, None, 1)], pixels.schema))
    q = quality.qa_summary(more, KEY, "year", "area", "value", "support").first()
    assert (q.n_rows, q.unique_keys, q.n_periods, q.duplicate_key_periods) == (10, 3, 3, 1)
    assert (q.period_min, q.period_max, q.missing_x, q.missing_value) == (2000, 2002, 1, 1)
    assert q.areas == "a,all,b,B" or q.areas == "a,all,B,b"
    d = quality.diagnostics(pixels, KEY, "year", "area", "value", 3).first()
    assert (d.n_rows, d.unique_keys, d.balanced_keys, d.balanced_rows, d.balanced_areas) == (8, 3, 2, 6, "a")
    assert quality.unstable_keys(pixels, KEY, "area").count() == 0
    # a key is known by its identified rows; rows without key or period still lend their area
    odd = spark.createDataFrame([("1", None, "a"), ("1", 2000, "a"), ("2", 2000, "b"), (None, 2000, "c"), ("", 2001, "d")],
                                "k string, year int, area string").selectExpr("*", "0.5 AS value", "1 AS support")
    q = quality.qa_summary(odd, ["k"], "year", "area", "value", "support").first()
    assert (q.unique_keys, q.n_periods, q.duplicate_key_periods, q.areas) == (2, 1, 0, "a,b,c,d")
    c = {r["year"]: r[1:] for r in quality.completeness(odd, ["k"], "year", "area").collect()}
    assert c == {2000: (2, 2, "a,b,c"), 2001: (0, 0, "d")}
    u = quality.unstable_keys(more, KEY, "area").first()
    assert (u.n_categories, u.categories) == (2, "a,all")


def test_text_and_number_keys_agree(pixels):
    text = pixels.select(F.concat_ws("|", "x", "y").alias("k"), "year")
    numbers = panel.coverage(pixels, KEY, "year").count()
    assert panel.coverage(text, ["k"], "year").count() == numbers


def test_frequency(spark, rows):
    df = spark.createDataFrame([("10",), ("2",), ("2",), ("2",), ("1",), ("10",), ("2",), ("2",)], "c string")
    assert [tuple(r) for r in quality.frequency(df, "c").collect()] == [("1", 1, 12.5), ("2", 5, 62.5), ("10", 2, 25.0)]
    assert [r[0] for r in quality.value_frequency(df, "c").collect()] == ["2", "10", "1"]


def test_duplicates(spark, rows):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string")
    assert rows(quality.duplicate_rows(df, ["k"])) == [(1, "a"), (1, "b")]
    assert tuple(quality.surplus_rows(df, ["k"]).first()) == (3, 2, 1, 1)
    with pytest.raises(ValueError, match="unique"):
        quality.enforce(quality.expect_unique(df, ["k"]))


def test_size_and_count_differ(spark):
    df = spark.createDataFrame([("g", 1.0, 1.5), ("g", None, 1.0)], "g string, a double, b double")
    by_rows = quality.reproduction_error(df, ["g"], "a", "b").first()
    present = quality.reproduction_error(df, ["g"], "a", "b", "present").first()
    assert (by_rows.n_compared, present.n_compared) == (2, 1) and by_rows.rmse == present.rmse == 0.5


def test_null_groups(spark, rows):
    df = spark.createDataFrame([("a", 1.0), (None, 2.0)], "g string, v double")
    assert rows(quality.group_qa(df, ["g"], "v"), "g") == [("a",), (None,)]
    assert rows(quality.group_sizes(df, ["g"])) == [("a", 1)]
    assert rows(contrast.unit_means(df, ["g"], "v"), "g") == [("a",)]


def test_rules_and_columns(spark):
    df = spark.createDataFrame([(0.5,), (1.5,), (None,)], "v double")
    report = quality.rule_report(df, {"in_range": F.col("v").between(0, 1), "any": F.lit(True)})
    assert {tuple(r) for r in report.collect()} == {("in_range", 2, False), ("any", 0, True)}
    with pytest.raises(ValueError, match="found"):
        quality.require_columns(df, ["v", "w"])
    found = spark.createDataFrame([("a",)], "f string")
    wanted = spark.createDataFrame([("a",), ("b",)], "f string")
    assert quality.expect_present(wanted, found, ["f"]).first().failed == 1


def test_changes(spark):
    df = spark.createDataFrame([("s", i + 1, v) for i, v in enumerate([5.0, 4.0, 4.5, 2.0, 1.0])], "s string, year int, v double")
    c = panel.block_change(df, ["s"], "year", "v", (1, 2), (4, 5)).first()
    assert (c.early_mean, c.late_mean, c.absolute_change) == (4.5, 1.5, -3.0)
    assert c.relative_change_percent == pytest.approx(-66.6666666667)
    e = panel.endpoint_change(df, ["s"], "year", "v", 1, 5).first()
    assert (e.first_value, e.last_value, e.relative_change_percent) == (5.0, 1.0, -80.0)


TRIAL = [("A", 1, 1, 10.0), ("A", 1, 2, None), ("A", 2, 3, 8.0), ("A", 2, 4, 9.0),
         ("B", 1, 5, 6.0), ("B", 1, 6, 6.0), ("B", 2, 7, 7.0), ("B", 2, 8, 9.0)]


@pytest.fixture(scope="module")
def trial(spark):
    return spark.createDataFrame([(2001, r, p, loc, "s", y) for r, p, loc, y in TRIAL],
                                 "year int, regime string, plot int, location int, stratum string, yield double")


def test_nested_rollup(trial, rows):
    units = contrast.unit_means(trial, ["year", "regime", "stratum", "plot"], "yield")
    assert rows(units, "regime", "plot", "n_subunits", "unit_mean") == [("A", 1, 2, 10.0), ("A", 2, 2, 8.5), ("B", 1, 2, 6.0), ("B", 2, 2, 8.0)]
    g = contrast.rollup_nested(trial, ["year", "regime", "stratum"], ["plot"], "yield")
    assert rows(g, "regime", "mean_value") == [("A", 9.25), ("B", 7.0)]
    sds = {r.regime: r.sd_between for r in g.collect()}
    assert sds == pytest.approx({"A": 1.0606601718, "B": 1.4142135624})
    c = contrast.contrast(g, ["year", "stratum"], "regime", "B", ["mean_value"])
    by = {r.regime: r for r in c.collect()}
    assert by["A"].mean_value_difference == 2.25 and by["A"].mean_value_percent == pytest.approx(32.1428571429)
    assert (by["B"].mean_value_difference, by["B"].mean_value_percent) == (0.0, 0.0)


def test_missing_baseline(trial):
    g = contrast.rollup_nested(trial.where("regime = 'A'"), ["year", "regime", "stratum"], ["plot"], "yield")
    assert contrast.contrast(g, ["year", "stratum"], "regime", "B", ["mean_value"], "skip").count() == 0
    with pytest.raises(Exception, match="exactly one B row"):
        contrast.contrast(g, ["year", "stratum"], "regime", "B", ["mean_value"]).collect()


def test_common_index(spark, rows):
    u = spark.createDataFrame([("A", 1, "s", 4.0), ("A", 1, "t", 8.0), ("A", 1, "other", 100.0), ("A", 2, "s", 2.0)],
                              "regime string, plot int, stratum string, unit_mean double")
    assert rows(contrast.common_index(u, ["regime"], ["plot"], "stratum", ["s", "t"])) == [("A", 1, 2, 6.0), ("A", 2, 1, 2.0)]
    assert rows(contrast.common_index_groups(u, ["regime"], ["plot"], "stratum", ["s", "t"]), "mean_value") == [(4.0,)]


def test_period_pairs(spark, rows):
    df = spark.createDataFrame([("a", 2019, 2.0), ("a", 2020, 3.0), ("b", 2019, 0.0), ("b", 2020, 1.0), ("c", 2019, 1.0)],
                               "e string, year int, m double")
    p = contrast.period_pair(df, ["e"], "year", 2019, 2020, ["m"])
    assert rows(p, "e", "change", "percent_change", "ratio") == [("a", 1.0, 50.0, 1.5), ("b", 1.0, None, None)]
    with pytest.raises(Exception, match="lacks a period"):
        contrast.period_pair(df, ["e"], "year", 2019, 2020, ["m"], "error").collect()
    d = contrast.direction_consistency(df, ["e"], "year", 2019, 2020, "m")
    assert rows(d, "e", "same_direction") == [("a", True), ("b", False)]


def test_checked_merge(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k int, a string")
    b = spark.createDataFrame([(1, "p"), (1, "q")], "k int, b string")
    assert joins.merge_checked(a, b, ["k"], "left", "one_to_many").count() == 3
    with pytest.raises(Exception, match="repeated key on the right side"):
        joins.merge_checked(a, b, ["k"]).collect()


def test_spine_and_enrichment(spark, rows):
    df = spark.createDataFrame([(2001, 3, "a")], "year int, n long, areas string")
    assert rows(joins.with_spine(spark, df, "year", 2000, 2002, ["n"], ["areas"])) == [(2000, 0, ""), (2001, 3, "a"), (2002, 0, "")]
    base = spark.createDataFrame([("i", "t1"), ("j", "t2")], "id string, original string")
    detail = spark.createDataFrame([("i", "T")], "id string, title string")
    assert rows(joins.enrich_left(base, detail, "id", ["title"], {"title": "original"}), "title") == [("T",), ("t2",)]


def test_lookups(spark, rows):
    df = spark.createDataFrame([(2019, "W", 3), (2019, "W", 99), (2019, "X", 17), (2020, "W", 3)], "year int, regime string, loc int")
    named = mapping.lookup(df, ["year", "regime", "loc"], {(2019, "W"): {"0 N": [2, 3], "100 N": [5]}}, "agro")
    ruled = mapping.range_lookup(named, ["year", "regime"], "loc", [
        ((2019, "W"), 1, 8, 1), ((2019, "W"), None, None, 2), ((2019, "X"), 17, 24, 1)], "plot")
    assert rows(ruled, "year", "regime", "loc", "agro", "plot") == [
        (2019, "W", 3, "0 N", 1), (2019, "W", 99, None, 2), (2019, "X", 17, None, 1), (2020, "W", 3, None, None)]
    assert mapping.unresolved(ruled, ["agro", "plot"]).count() == 3


REGISTER = [("s1", "A1", "yes", "Italy", "decrease", "increase"), ("s2", "C", "yes", "Global", "decrease", None),
            ("s3", "A2", "no", "northern ITALY", "not_measured", "not_measured"),
            ("s4", "C", "YES", "Global", "increase", "no_clear_increase")]


def test_evidence(spark, rows):
    r = spark.createDataFrame(REGISTER, "study_id string, tier string, direct string, location string, dir_1 string, dir_2 string")
    f = evidence.add_flags(r, {"direct_": equals_ci("direct", "yes"), "italian": matches_ci("location", "italy|italian"),
                               "local": F.col("tier").isin("A1", "A2"), "synthesis": F.col("tier") == "C"})
    inv = evidence.inventory(f, ["direct_", "italian", "local", "synthesis"])
    assert dict(rows(inv)) == {"total": 4, "direct_": 3, "italian": 2, "local": 2, "synthesis": 2}
    counts = evidence.directional_counts(f, {"direct": F.col("direct_")}, ["dir_1", "dir_2"])
    assert rows(counts, "outcome", "direction", "n_studies") == [
        ("dir_1", "decrease", 2), ("dir_1", "increase", 1), ("dir_2", "increase", 1), ("dir_2", "missing", 1),
        ("dir_2", "no_clear_increase", 1)]
    rule = classify([(F.col("dir_1") == "decrease", "support"),
                     (F.col("dir_1").isin("not_measured", "not_primary"), "not_applicable")], "mixed_or_no_support")
    m = evidence.claim_matrix(r, ["study_id"], {"claim": rule})
    assert rows(m, "study_id", "support") == [("s1", "support"), ("s2", "support"), ("s3", "not_applicable"), ("s4", "mixed_or_no_support")]
    assert rows(evidence.claim_summary(m), "support", "n_studies") == [("mixed_or_no_support", 1), ("not_applicable", 1), ("support", 2)]
    assert rows(evidence.local_evidence(f, F.col("direct_") & F.col("local"), ["study_id"])) == [("s1",)]


def test_sensor_tables(spark, rows):
    df = spark.createDataFrame([("d1", "s1", 1.0), ("d1", "s2", 2.0), ("d1", "s3", 4.0), ("d3", "s1", 3.0), ("d3", "s2", None),
                                ("d3", "s3", 2.0)], "d string, s string, v double")
    assert rows(series.spatial_mean(df, ["d"], "v"), "d", "n", "mean") == [("d1", 3, pytest.approx(7 / 3)), ("d3", 2, 2.5)]
    e = series.entity_summary(df, ["s"], "d", "v")
    assert rows(e, "s", "n", "first_date", "last_date", "range") == [("s1", 2, "d1", "d3", 2.0), ("s2", 1, "d1", "d3", 0.0), ("s3", 2, "d1", "d3", 2.0)]


def test_plot_series(spark, rows):
    a = spark.createDataFrame([(2000, 1.0, 2.0)], "year int, p double, q double")
    b = spark.createDataFrame([("A", 2000, 3)], "area string, year int, v int")
    out = series.series_for_plot({"one": (a, "year", ["p", "q"], None), "two": (b, "year", ["v"], "area")})
    assert rows(out) == [("one", "p", 2000.0, 1.0), ("one", "q", 2000.0, 2.0), ("two", "A", 2000.0, 3.0)]
