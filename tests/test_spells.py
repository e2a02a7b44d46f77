import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelstats.operators import series, spells
from panelstats.workload import all_queries

LEVELS = [5, 0, -2, 3, 4, 0, 7]
START = dt.date(2001, 5, 1)


def daily(spark, levels=LEVELS, start=START, group="g", year=2001):
    data = [(year, group, start + dt.timedelta(days=i), None if v is None else float(v)) for i, v in enumerate(levels)]
    return spark.createDataFrame(data, "year int, grp string, date date, level double")


def runs_of(states):
    out, start = [], 0
    for i in range(1, len(states) + 1):
        if i == len(states) or states[i] != states[start]:
            out.append((states[start], start, i - 1, i - start))
            start = i
    return out


@pytest.mark.parametrize("threshold, want", [
    (0, [(1, 0, 0), (0, 1, 2), (1, 3, 4), (0, 5, 5), (1, 6, 6)]),
    (3, [(1, 0, 0), (0, 1, 3), (1, 4, 4), (0, 5, 5), (1, 6, 6)]),
])
def test_spells(spark, rows, threshold, want):
    states = spells.daily_states(daily(spark), ["year", "grp"], "date", "level", threshold)
    got = rows(spells.spells(states, ["year", "grp"], "date", "wet").orderBy("start_index"), "wet", "start_index", "end_index")
    assert got == sorted(want, key=repr)
    moves = spells.transitions(states, ["year", "grp"], "date", "wet").first()
    assert (moves.wet_to_dry, moves.dry_to_wet) == (2, 2)


def test_hydroperiod(spark):
    h = spells.hydroperiod(daily(spark), ["year", "grp"], "date", "level").first()
    assert (h.n_days, h.wet_days, h.dry_days, h.n_wet_spells, h.n_dry_spells) == (7, 4, 3, 3, 2)
    assert (h.longest_wet, h.longest_dry, h.first_dry_length, h.days_to_first_dry) == (2, 2, 2, 1)
    assert (h.longest_dry_start, h.longest_dry_end) == (dt.date(2001, 5, 2), dt.date(2001, 5, 3))
    assert h.p25_level == 0.0 and h.median_level == 3.0 and h.p75_level == 4.5 and h.p95_level == pytest.approx(6.4)
    assert h.cumulative_level == 19 and h.median_positive_level == 4.5


def test_earliest_of_equally_long_runs(spark):
    h = spells.hydroperiod(daily(spark, [1, 0, 0, 1, 0, 0, 1]), ["year", "grp"], "date", "level").first()
    assert h.longest_dry_start == dt.date(2001, 5, 2)


def test_never_dry(spark):
    h = spells.hydroperiod(daily(spark, [1, 2]), ["year", "grp"], "date", "level").first()
    assert (h.longest_dry, h.n_dry_spells, h.first_dry_start, h.days_to_first_dry, h.first_dry_length) == (0, 0, None, None, 0)


def test_completeness_guard(spark):
    gap = daily(spark, [1, None, 2])
    with pytest.raises(ValueError):
        spells.require_complete(gap, ["year", "grp"], "level")
    with pytest.raises(Exception, match="missing level"):
        spells.hydroperiod(gap, ["year", "grp"], "date", "level").collect()
    # the guard covers the rows handed in: a gap outside the common window is allowed
    other = daily(spark, [1, 1], START + dt.timedelta(days=2), "h")
    inside = series.common_window(gap.unionByName(other), "year", "grp", "date")
    assert spells.require_complete(inside, ["year", "grp"], "level").count() == 2


def test_sensitivity_and_delta(spark, rows):
    s = spells.threshold_sensitivity(daily(spark), ["year", "grp"], "date", "level", [0, 3])
    d = spells.delta_vs(s, ["year", "grp"], "threshold", 0.0, ["wet_days", "longest_dry", "n_dry_spells"])
    assert rows(d, "threshold", "wet_days_change", "longest_dry_change", "n_dry_spells_change") == [(3.0, -1, 1, 0)]


def test_row_adjacency_not_calendar(spark, rows):
    data = daily(spark, [1, 1]).unionByName(daily(spark, [1], START + dt.timedelta(days=30)))
    states = spells.daily_states(data, ["year", "grp"], "date", "level")
    assert rows(spells.spells(states, ["grp"], "date", "wet"), "length") == [(3,)]


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.integers(0, 1), min_size=1, max_size=30), min_size=1, max_size=3), st.integers(1, 7))
def test_chunked_equals_plain(spark, groups, width):
    data = [(g, i, s) for g, states in enumerate(groups) for i, s in enumerate(states)]
    df = spark.createDataFrame(data, "g int, t int, s int")
    want = sorted((g, *r) for g, states in enumerate(groups) for r in runs_of(states))
    cols = ["g", "s", "start_index", "end_index", "length"]
    plain = spells.spells(df, ["g"], "t", "s")
    chunked = spells.spells_chunked(df, ["g"], "t", "s", F.floor(F.col("t") / width))
    assert sorted(tuple(r) for r in plain.select(*cols).collect()) == want
    assert sorted(tuple(r) for r in chunked.select(*cols).collect()) == want
    both = ["g", "s", "spell_id", "start", "end", "length"]
    assert sorted(map(tuple, plain.select(*both).collect())) == sorted(map(tuple, chunked.select(*both).collect()))
    # lengths add up to the rows, and runs exceed transitions by one
    assert sum(r[-1] for r in want) == len(data)
    moves = spells.transitions(df, ["g"], "t", "s").agg(F.sum(F.col("wet_to_dry") + F.col("dry_to_wet"))).first()[0]
    assert moves == len(want) - len(groups)


def test_chunked_ties_follow_the_given_columns(spark, rows):
    """Rows of one time, handed in either way round: the id decides, then the state."""
    data = [("g", 0, 1, 1), ("g", 5, 3, 1), ("g", 5, 2, 0), ("g", 5, 4, 0), ("g", 5, None, 1), ("g", 9, 6, 1), ("g", 9, 6, 0)]
    want = sorted([("g", 1, 1, 0, 0), ("g", 0, 1, 1, 1), ("g", 1, 2, 2, 2), ("g", 0, 2, 3, 3), ("g", 1, 3, 4, 4),
                   ("g", 0, 3, 5, 5), ("g", 1, 4, 6, 6)], key=repr)
    for given in (data, data[::-1]):
        df = spark.createDataFrame(given, "g string, t int, id int, s int").coalesce(1)
        out = spells.spells_chunked(df, ["g"], "t", "s", F.floor(F.col("t") / 10), ["id"])
        assert rows(out, "g", "s", "spell_id", "start_index", "end_index") == want


def test_spells_chunked_query_with_shared_times(spark, tmp_path):
    """The registered query and its SQL on events that share a time but not a state, in two orders of the rows."""
    duckdb = pytest.importorskip("duckdb")
    query = all_queries()["spells_chunked"]
    at = dt.datetime(2024, 1, 1, 0, 0, 30, 250)
    data = [(k, at + dt.timedelta(seconds=20 * (k // 6)), "click", 40.0 if k % 3 else 60.0) for k in range(60)]
    seen = []
    for name, given in (("up", data), ("down", data[::-1])):
        path = f"{tmp_path}/{name}/events.parquet"
        spark.createDataFrame(given, "event_id long, ts timestamp_ntz, event_type string, value double").coalesce(1).write.parquet(path)
        out = query.run(spark, f"{tmp_path}/{name}")
        seen.append(sorted(map(tuple, out.collect())))
        con = duckdb.connect()
        con.execute(f"CREATE VIEW events AS SELECT * FROM '{path}/*.parquet'")
        cols = ", ".join(f'"{c}"' for c in out.columns)
        assert seen[-1] == sorted(con.execute(f"SELECT {cols} FROM ({query.sql})").fetchall())
    assert seen[0] == seen[1] and len(seen[0]) == 40


def test_common_window(spark, rows):
    a = daily(spark, LEVELS, START, "A")
    b = daily(spark, LEVELS, START + dt.timedelta(days=2), "B")
    w = series.windows(a.unionByName(b), "year", "grp", "date").first()
    assert (w.common_start, w.common_end) == (dt.date(2001, 5, 3), dt.date(2001, 5, 7))
    assert series.common_window(a.unionByName(b), "year", "grp", "date").count() == 10


def test_season_summary_sums(spark):
    df = daily(spark).withColumn("a", F.lit(None).cast("double"))
    s = series.season_summary(df.withColumn("b", F.col("a")), ["grp"], "date", ["a"], ["b"], "level").first()
    assert (s.a_sum, s.b_sum, s.positive_days, s.valid_days) == (0.0, None, 4, 7)


def test_consistency_and_resample(spark, rows):
    a, b = daily(spark, [1, 2, 3], group="A"), daily(spark, [1, 5], group="B")
    c = series.consistency(a.unionByName(b), "year", "date", "grp", "level").first()
    assert (c.n_common_dates, c.max_spread, c.days_differing) == (2, 3.0, 1)
    late = daily(spark, [9], dt.date(2001, 7, 15), "A")
    m = series.resample_month(a.unionByName(late), ["grp"], "date", {"m": F.avg("level")})
    assert rows(m, "month", "m") == [(dt.date(2001, 5, 1), 2.0), (dt.date(2001, 6, 1), None), (dt.date(2001, 7, 1), 9.0)]


def test_denominators(spark):
    df = daily(spark, [5, None, 0, -1]).withColumn("out", F.lit(None).cast("double"))
    e = series.event_structure(df, ["grp"], "level", "out", "level").first()
    assert (e.n_days, e.days_positive_inflow, e.fraction_positive_inflow, e.mean_inflow_positive_days) == (4, 1, 0.25, 5.0)
    p = series.profile(df, ["grp"], ["level"]).first()
    assert (p.n_rows, p.n, p.n_negative, p.n_zero) == (4, 3, 1, 1) and p.pct_negative == pytest.approx(100 / 3)
