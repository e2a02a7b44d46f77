"""Structured Streaming forms of the quality, daily, monthly and spell operators.

Every function takes a streaming DataFrame and returns one (or starts a query that
fills a table). Timestamps must be TIMESTAMP; ``event_stream`` casts on read.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from panelstats.session import new_folder


def file_stream(spark: SparkSession, folder: str, pattern: str, files_per_batch: int = 1000) -> DataFrame:
    """Parquet files of a folder as a stream, with the schema of the files present."""
    schema = spark.read.option("pathGlobFilter", pattern).parquet(folder).schema
    return (
        spark.readStream.schema(schema).option("pathGlobFilter", pattern)
        .option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    )


def event_stream(spark: SparkSession, folder: str, pattern: str, ts: str) -> DataFrame:
    return file_stream(spark, folder, pattern).withColumn(ts, F.col(ts).cast("timestamp"))


def fill_table(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over all data available now and return the resulting table.

    Progress and output live in the shared folder. Complete mode replaces the table
    with each batch; append mode uses the exactly-once file sink.
    """
    spark = stream.sparkSession
    out, state = new_folder(spark, name), new_folder(spark, f"{name}-progress")
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", out).start()
    else:
        query = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(out)).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


# ---- running quality summary ---------------------------------------------

def stream_qa(stream: DataFrame, by: Sequence[str], ts: str, value: str) -> DataFrame:
    """Running counters and extremes per group. Distinct days need ``fill_qa``."""
    return stream.groupBy(*by).agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.col(value).isNull()).alias("n_missing"),
        F.count_if(F.col(value) < 0).alias("n_negative"),
        F.min(value).alias("min_value"),
        F.max(value).alias("max_value"),
        F.min(ts).alias("first_ts"),
        F.max(ts).alias("last_ts"),
    )


def fill_qa(
    stream: DataFrame, by: Sequence[str], ts: str, value: str, folder: str, watermark: str = "1 day"
) -> DataFrame:
    """Runs the stream over what is available now and returns the whole summary so far, with distinct days and late rows.

    Every batch leaves one row per group and day below `folder`, under the number of the batch, so a batch that is run
    again replaces its own rows; days are counted once over all batches, without a set in the state. A row is late where
    its time is not after the largest time of earlier batches less `watermark`; late rows still count in all other columns.
    Call again with the same folder to go on with new rows. Rows without a time have no day and are never late; a stream
    that never had a row gives an empty table.
    """
    spark = stream.sparkSession
    cells, seen = f"{folder}/cells", f"{folder}/seen"
    keys = ", ".join(f"`{c}` {stream.schema[c].dataType.simpleString()}" for c in by)
    kind = stream.schema[value].dataType.simpleString()
    schema = (f"{keys}, _day date, n_rows bigint, n_missing bigint, n_negative bigint, n_late bigint, "
              f"min_value {kind}, max_value {kind}, first_ts timestamp, last_ts timestamp")

    def add(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        before = session.read.schema("micros bigint").parquet(f"{seen}/batch={number - 1}").first().micros if number else None
        top = F.timestamp_micros(F.lit(before).cast("bigint"))
        late = F.coalesce(F.col(ts) <= top - F.expr(f"INTERVAL {watermark}"), F.lit(False))
        batch.groupBy(*by, F.to_date(ts).alias("_day")).agg(
            F.count("*").alias("n_rows"), F.count_if(F.col(value).isNull()).alias("n_missing"),
            F.count_if(F.col(value) < 0).alias("n_negative"), F.count_if(late).alias("n_late"),
            F.min(value).alias("min_value"), F.max(value).alias("max_value"),
            F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"),
        ).write.mode("overwrite").parquet(f"{cells}/batch={number}")
        own = session.read.schema(schema).parquet(f"{cells}/batch={number}")
        own.agg(F.unix_micros(F.greatest(F.max("last_ts"), top)).alias("micros")) \
            .write.mode("overwrite").parquet(f"{seen}/batch={number}")

    writer = stream.writeStream.option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True)
    query = writer.foreachBatch(add).start()
    query.awaitTermination()
    try:
        held = spark.read.schema(f"{schema}, batch bigint").parquet(cells)
    except AnalysisException:  # no batch yet
        held = spark.createDataFrame([], f"{schema}, batch bigint")
    sums, least, most = ["n_rows", "n_missing", "n_negative", "n_late"], ["min_value", "first_ts"], ["max_value", "last_ts"]
    merged = [*[F.sum(c).alias(c) for c in sums], *[F.min(c).alias(c) for c in least], *[F.max(c).alias(c) for c in most]]
    days = held.groupBy(*by, "_day").agg(*merged)
    return days.groupBy(*by).agg(*merged, F.count("_day").alias("n_days"))


def stream_duplicates(
    stream: DataFrame, keys: Sequence[str], ts: str, watermark: str = "1 day"
) -> DataFrame:
    """Days of a key with more than one row, with their counts, once the watermark has closed the day.

    The day is part of the key, so closed days leave the state.
    """
    return (
        stream.withWatermark(ts, watermark)
        .groupBy(F.window(ts, "1 day").alias("w"), *keys)
        .agg(F.count("*").alias("n_members"))
        .where("n_members > 1")
        .select(*keys, F.to_date("w.start").alias("day"), "n_members")
    )


# ---- daily and monthly buckets -------------------------------------------

def daily_stream(
    stream: DataFrame, by: Sequence[str], ts: str, value: str, watermark: str = "1 day"
) -> DataFrame:
    """Closed days per group: count, mean, sum. Rows behind the watermark are dropped."""
    return (
        stream.withWatermark(ts, watermark)
        .groupBy(F.window(ts, "1 day").alias("w"), *by)
        .agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.sum(value).alias("total"))
        .select(*by, F.to_date("w.start").alias("date"), "n", "mean", "total")
    )


def monthly_stream(days: DataFrame, by: Sequence[str]) -> DataFrame:
    """Month-start buckets over a stream of closed days, updated with every batch (complete mode).

    The state is one row per group and month.
    """
    return days.groupBy(*by, F.trunc("date", "MM").alias("month")).agg(
        F.avg("mean").alias("mean_of_days"), F.min("mean").alias("min_day"), F.max("mean").alias("max_day"),
        F.count("*").alias("n_days"),
    )


# ---- spells ---------------------------------------------------------------

def spells_stream(
    stream: DataFrame, key: str, order: str, level: str, threshold: float, watermark: str = "7 days"
) -> DataFrame:
    """Closed runs per key from a stream of (key, order, level), in event-time order.

    Rows of the last ``watermark`` wait in the state, whatever order they arrive in; once the watermark has passed
    a day it joins the open run. So the state of a key is one run and a bounded span of days, and the result does not
    depend on how rows are spread over batches as long as none is later than the watermark. Feed closed days
    (``daily_stream``), so that a key brings one row per day.
    """
    kind = stream.schema[key].dataType.simpleString()
    out = f"{key} {kind}, state int, start date, end date, length bigint"
    held = "state int, start int, end int, length bigint, days array<int>, levels array<double>"

    def track(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        wet, start, end, length, days, levels = state.get if state.exists else (None, None, None, 0, [], [])
        came = [] if state.hasTimedOut else list(batches)
        day = np.concatenate([np.asarray(days, np.int64), *[(b[order] - EPOCH).dt.days.to_numpy(np.int64) for b in came]])
        h = np.concatenate([np.asarray(levels, np.float64), *[b[level].to_numpy(np.float64) for b in came]])
        passed = state.getCurrentWatermarkMs() // DAY_MS  # days before this one are complete
        sorting = np.argsort(day, kind="stable")
        day, h = day[sorting], h[sorting]
        ready = int(np.searchsorted(day, passed))
        now, flags = day[:ready], (h[:ready] > threshold).astype(np.int64)
        if ready:
            head = np.flatnonzero(np.r_[True, flags[1:] != flags[:-1]])
            tail = np.r_[head[1:], ready] - 1
            runs = list(zip(flags[head].tolist(), now[head].tolist(), now[tail].tolist(), (tail - head + 1).tolist()))
            if length and wet == runs[0][0]:
                runs[0] = (wet, start, runs[0][2], length + runs[0][3])
            elif length:
                runs.insert(0, (wet, start, end, length))
            *closed, (wet, start, end, length) = runs
        else:
            closed = []
        state.update((wet, start, end, length, day[ready:].tolist(), h[ready:].tolist()))
        if ready < len(day):
            state.setTimeoutTimestamp(max((int(day[ready]) + 1) * DAY_MS, state.getCurrentWatermarkMs() + 1))
        if closed:
            table = pd.DataFrame(closed, columns=["state", "start", "end", "length"])
            for c in ("start", "end"):
                table[c] = (EPOCH + pd.to_timedelta(table[c], unit="D")).dt.date
            table.insert(0, key, name[0])
            yield table

    rows = stream.select(key, F.col(order).cast("timestamp").alias(order), F.col(level).cast("double").alias(level))
    return rows.withWatermark(order, watermark).groupBy(key).applyInPandasWithState(
        track, out, held, "append", GroupStateTimeout.EventTimeTimeout
    )


EPOCH = pd.Timestamp("1970-01-01")
DAY_MS = 86_400_000
