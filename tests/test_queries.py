"""Every registered query against its SQL on the smallest tables."""

import math
import os

import pytest

import __spark_entry__ as driver
from panelstats.workload import all_queries

DATA = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()
QUERIES = {name: q.run for name, q in all_queries().items()}
SQL = {name: q.sql for name, q in all_queries().items() if q.sql}

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables not present")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def clean(row):
    out = []
    for v in row:
        if isinstance(v, float):
            v = None if math.isnan(v) else (0.0 if v == 0 else v)
        out.append(v)
    return tuple(out)


# results are rounded to six digits, those of these queries to four: one unit of the last digit is allowed
COARSE = {"balance", "reproduction_error"}


def close(a, b, name):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-6, abs_tol=1.1e-4 if name in COARSE else 1.1e-6)
    return a == b


def test_all_queries_are_registered():
    assert set(QUERIES) <= set(driver.queries()) and set(SQL) <= set(driver.oracle_sql())


def test_all_sql_belongs_to_a_query():
    assert set(SQL) <= set(QUERIES)
    assert set(QUERIES) == set(SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    order = sorted(df.columns)
    got = sorted((clean(r) for r in df.select(*[f"`{c}`" for c in order]).collect()), key=repr)
    if name not in SQL:
        assert got
        return
    cursor = duck.execute(SQL[name])
    cols = [d[0] for d in cursor.description]
    assert sorted(cols) == order
    want = sorted((clean(r[cols.index(c)] for c in order) for r in cursor.fetchall()), key=repr)
    assert len(got) == len(want)
    assert all(close(x, y, name) for g, w in zip(got, want) for x, y in zip(g, w)) or got == want


def test_entry(spark):
    assert driver.entry(spark).columns[:3] == ["event_type", "wet", "spell_id"]
