"""The summary of a stream in parts equals the batch form, whatever arrives late."""

import datetime as dt

from panelstats.streaming import daily

SCHEMA = "kind string, ts timestamp, value double"


def at(day, hour=0):
    return dt.datetime(2024, 1, 1, hour) + dt.timedelta(days=day)


def test_parts_and_late_rows(spark, tmp_path):
    parts = [
        [("a", at(0), 1.0), ("a", at(0, 5), -1.0), ("b", at(3), None), (None, None, 2.0)],
        [("a", at(2), 4.0), ("a", at(1, 23), 4.0), ("a", at(9), 5.0), ("b", None, 6.0)],  # day 2 lies on the border: late
        [],
        [("a", at(8, 1), 0.0), ("b", at(7), 1.0), ("b", at(0), 1.0)],
    ]
    landing, state = str(tmp_path / "in"), str(tmp_path / "state")
    spark.createDataFrame([], SCHEMA).write.parquet(landing)
    got = daily.fill_qa(daily.file_stream(spark, landing, "*.parquet"), ["kind"], "ts", "value", state)
    assert got.count() == 0
    for part in parts:
        spark.createDataFrame(part, SCHEMA).write.mode("append").parquet(landing)
        got = daily.fill_qa(daily.file_stream(spark, landing, "*.parquet"), ["kind"], "ts", "value", state, "1 day")
    rows = {r["kind"]: r.asDict() for r in got.collect()}
    assert rows["a"] == {"kind": "a", "n_rows": 6, "n_missing": 0, "n_negative": 1, "n_late": 2, "min_value": -1.0, "max_value": 5.0,
                         "first_ts": at(0), "last_ts": at(9), "n_days": 5}
    assert rows["b"]["n_late"] == 2 and rows["b"]["n_days"] == 3 and rows["b"]["n_rows"] == 4 and rows["b"]["n_missing"] == 1
    assert rows[None]["n_days"] == 0 and rows[None]["first_ts"] is None
    again = daily.fill_qa(daily.file_stream(spark, landing, "*.parquet"), ["kind"], "ts", "value", state)
    assert sorted(map(tuple, again.collect()), key=repr) == sorted(map(tuple, got.collect()), key=repr)
