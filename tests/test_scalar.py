import datetime as dt
import math

import pytest
from pyspark.sql import functions as F

from panelstats.functions import scalar as S


def one(spark, *cols, sql="select 1 as i"):
    return tuple(spark.sql(sql).select(*cols).first())


def test_parse_number(spark, rows):
    df = spark.createDataFrame(
        [("1,234",), (" 7 ",), ("",), (None,), ("x",), ("1e3",), ("-2.5",), ("(3)",), ("+4",), ("NaN",),
         ("12 34",), ("1d",), ("5f",), (".5",), ("7.",), ("--1",), ("(-1)",), ("1e",), ("1,2,3.5",), ("9" * 400,)], "t string")
    got = [r[0] for r in df.select(S.parse_number("t")).collect()]
    assert got == [1234.0, 7.0, None, None, None, 1000.0, -2.5, -3.0, 4.0, None,
                   None, None, None, 0.5, 7.0, None, None, None, 123.5, math.inf]


def test_serial_date(spark):
    df = spark.createDataFrame([("43599",), ("2019-05-15",), ("43599.75",), ("later",), ("",), (None,), ("15/05/2020",)], "t string")
    got = [tuple(r) for r in df.select(S.parse_serial_date("t"), S.parse_serial_date("t", 2019)).collect()]
    d = dt.date
    assert [g[0] for g in got] == [d(2019, 5, 14), d(2019, 5, 15), d(2019, 5, 14), None, None, None, d(2020, 5, 15)]
    assert got[6][1] is None and got[0][1] == d(2019, 5, 14)


def test_dates_as_written(spark):
    texts = ["05/14/2019", "14-May-2019", "5/7/2019", "14 May 2019", "May 14, 2019", "2019-5-7", "05/14/2019 10:30",
             "2019-05-14 10:30:00", "99999999999", "-1e300", "1e5", "14.5.2019", "31/31/2019", "12 34"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    d = dt.date
    day = [r[0] for r in df.select(S.parse_serial_date("t")).collect()]
    month = [r[0] for r in df.select(S.parse_serial_date("t", patterns=S.date_patterns(day_first=False))).collect()]
    m14 = d(2019, 5, 14)
    rest = [m14, m14, d(2019, 5, 7), m14, m14, None, None, d(2173, 10, 14), m14, None, None]
    assert day == [m14, m14, d(2019, 7, 5), *rest]
    assert month == [m14, m14, d(2019, 5, 7), *rest]


def test_percent_forms(spark):
    df = spark.createDataFrame([(2.0, 3.0), (0.0, 3.0), (0.0, 0.0), (0.0, -1.0), (None, 1.0)], "a double, b double")
    got = [tuple(r) for r in df.select(
        S.percent_change("a", "b"), S.percent_change("a", "b", guard=False), S.ratio("a", "b")).collect()]
    assert got == [(50.0, 50.0, 1.5), (None, math.inf, None), (None, None, None), (None, -math.inf, None), (None, None, None)]


def test_sums_of_nothing(spark):
    df = spark.createDataFrame([(None,), (None,)], "v double")
    assert tuple(df.agg(S.plain_sum("v"), S.min_count_sum("v"), F.count("v"), F.count("*")).first()) == (0.0, None, 0, 2)


def test_nan_is_missing_before_comparison(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,), (None,)], "v double")
    clean = df.select(S.nan_to_null("v").alias("v"))
    assert tuple(clean.agg(F.count_if(F.col("v") > 0), S.share_true(F.col("v") > 0)).first()) == (1, pytest.approx(1 / 3))


def test_clip_keeps_missing(spark):
    df = spark.createDataFrame([(-1.0,), (2.0,), (None,)], "v double")
    assert [r[0] for r in df.select(S.clip_lower("v")).collect()] == [0.0, 2.0, None]


def test_half_even_rounding(spark):
    assert one(spark, F.bround(F.lit(0.5), 0), F.bround(F.lit(1.5), 0), F.bround(F.lit(2.5), 0)) == (0.0, 2.0, 2.0)


def test_sorted_ci(spark):
    assert one(spark, F.array_join(S.sorted_ci(F.array(*[F.lit(x) for x in ("all", "B", "A")])), ",")) == ("A,all,B",)


def test_cell_address(spark):
    df = spark.createDataFrame([(1, 1), (2, 26), (3, 27), (4, 52), (5, 702), (6, 703), (7, 18278)], "r int, c int")
    assert [x[0] for x in df.select(S.cell_address("r", "c")).collect()] == ["A1", "Z2", "AA3", "AZ4", "ZZ5", "AAA6", "ZZZ7"]


def test_checksum_and_algorithms(spark):
    df = spark.createDataFrame([("md5:d41d8cd98f00b204e9800998ecf8427e",), ("plain",), (None,)], "c string")
    kind, value = S.split_checksum("c")
    assert [tuple(r) for r in df.select(kind, value).collect()] == [("md5", "d41d8cd98f00b204e9800998ecf8427e"), ("", ""), ("", "")]
    names = spark.createDataFrame([("md5",), ("SHA-1",), ("sha1",), ("SHA-256",), ("sha256",), ("CRC32",)], "n string")
    assert [r[0] for r in names.select(S.normal_algorithm("n")).collect()] == ["MD5", "SHA1", "SHA1", "SHA256", "SHA256", None]


def test_switch_default(spark):
    df = spark.createDataFrame([("a",), ("z",)], "k string")
    assert [r[0] for r in df.select(S.switch("k", {"a": "x"}, "null")).collect()] == ["x", None]
    with pytest.raises(Exception, match="unexpected key: z"):
        df.select(S.switch("k", {"a": "x"})).collect()


def test_location_and_text(spark):
    df = spark.createDataFrame([("12.9",), ("x",), (None,)], "t string")
    assert [r[0] for r in df.select(S.to_location("t")).collect()] == [12, None, None]
    assert one(spark, S.leaf_name(F.lit("a\\b/c.csv")), S.url_encode(F.lit("doi:10/x y")), S.is_blank(F.lit("  ")),
               S.matches_ci(F.lit("northern ITALY"), "italy|italian")) == ("c.csv", "doi%3A10%2Fx%20y", True, True)


def test_weighted_mean_of_nothing(spark):
    df = spark.createDataFrame([(1.0, 0.0), (None, 2.0)], "v double, w double")
    assert df.agg(S.weighted_mean("v", "w")).first()[0] is None


def test_composite_key_missing_part(spark):
    df = spark.createDataFrame([("a", 1), ("a", None)], "k string, n int")
    assert [r[0] for r in df.select(S.composite_key(["k", "n"], "_")).collect()] == ["a_1", None]
