"""Exact distribution statistics that survive a group holding most of the rows.

One scan of the facts. Rows are first reduced to (group, value, count), so equal
values meet already on the map side and a hot group spreads over its values.
A value's magnitude bucket (octave plus leading fraction bits) is monotone in
the value, so ranks resolve in two short steps: a running count over the
occupied buckets of a group, then a running count inside just the few buckets
that hold a wanted rank. A bucket spans 1/4096 of an octave; one that is looked into and
has more than LISTED different values is cut twice more, each time into 8,192 parts between
its own least and largest value, and only the part that holds the rank goes on. A double has 52 fraction bits, so what is left
in the end holds some 16,000 different values at most, whatever the data: clock readings
of a few days spread like any other values.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelstats.session import materialise

QUARTILES = {"p05": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95}
LOWEST_OCTAVE = -1100
MISSING = -(1 << 62)  # bucket of missing values, below every other
PARTS, CUTS = 1 << 13, 2  # parts of a bucket, and how often it is cut
LISTED = 1 << 14  # different values of a bucket that may meet in one task


def _octave(a: Column) -> Column:
    top = F.lit(1100.0)
    raw = F.when(a == float("inf"), top).when(a > 0, F.log2(a)).otherwise(float(LOWEST_OCTAVE))
    return F.floor(raw).cast("double")


def magnitude_bucket(value: str | Column, bits: int = 12, octave: Column | None = None) -> Column:
    """Monotone bucket number; 0 only for zero, negative only for negative values."""
    v = F.col(value) if isinstance(value, str) else value
    a = F.abs(v)
    octave = _octave(a) if octave is None else octave
    part = F.when(a == float("inf"), 0.0).otherwise(
        F.floor(a / F.pow(F.lit(2.0), octave) * float(1 << bits))
    )
    key = (octave - LOWEST_OCTAVE) * float(1 << (bits + 2)) + part
    return F.when(v == 0, F.lit(0)).otherwise((F.signum(v) * key).cast("bigint")).cast("bigint")


def _anchor(v: Column, bits: int, octave: Column) -> Column:
    """Point of the value's bucket, subtracted before squaring to keep precision."""
    a = F.abs(v)
    scale = F.pow(F.lit(2.0), octave)
    return F.when((v == 0) | (a == float("inf")), 0.0).otherwise(
        F.signum(v) * F.floor(a / scale * float(1 << bits)) / float(1 << bits) * scale
    )


def present(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows whose keys are all known, as plain filters that every branch of a plan shares."""
    for c in cols:
        df = df.where(F.col(c).isNotNull())
    return df


def value_counts(
    df: DataFrame,
    by: Sequence[str],
    values: Sequence[str],
    carry: Mapping[str, tuple[str, Column]] | None = None,
) -> DataFrame:
    """(by, variable, _v, _c): equal values merged; a missing value is its own row.

    ``carry`` adds sums, minima or maxima of other expressions: name -> (kind, column).
    """
    carry = dict(carry or {})
    keyed = present(df, by)
    fixed = [F.col(b) for b in by] + [c.alias(name) for name, (_, c) in carry.items()]
    doubles = [F.col(v).cast("double").alias(v) for v in values]
    wide = keyed.select(*fixed, *doubles)
    if len(values) == 1:
        name = values[0]
        ids = [*by, *carry]
        long = wide.select(*ids, F.lit(name).alias("variable"), F.col(name).alias("_v"))
    else:
        # an inline array keeps what is known about the keys, which an unpivot forgets
        pairs = F.array(*[F.struct(F.lit(n).alias("variable"), F.col(n).alias("_v")) for n in values])
        long = present(wide.select(*by, *carry, F.inline(pairs)), ["variable"])
    long = long.withColumn("_v", F.when(~F.isnan("_v"), F.col("_v")))
    merge = {"sum": F.sum, "min": F.min, "max": F.max}
    return long.groupBy(*by, "variable", "_v").agg(
        F.count("*").alias("_c"),
        *[merge[kind](name).alias(name) for name, (kind, _) in carry.items()],
    )


def _part() -> Column:
    """Monotone number of the value's part between _lo and _hi; a single value is one part."""
    return F.coalesce(F.floor(F.try_divide(F.col("_v") - F.col("_lo"), F.col("_hi") - F.col("_lo")) * PARTS), F.lit(0))


def narrowed(
    rows: DataFrame, keys: Sequence[str], wanted=None, carried: Sequence[str] = (), large: bool = True
) -> tuple[DataFrame, list[str]]:
    """Rows (keys, _v, _c, _d, _lo, _hi, _before) in parts, and the keys of a part.

    Keys with more than ``LISTED`` different values (_d) are cut ``CUTS`` times, the others are one part. _before is the
    running count ahead of the part. ``wanted(before, upto)`` says which parts are looked into, all if it is missing.
    Parts are summed on the map side, so a large bucket spreads over its parts. Where nothing is large, adaptive
    execution finds the cutting branch empty and leaves it out; naming the ``carried`` columns in it lets both branches
    read one exchange. ``large`` is False where it is known that no keys are large: there is then no such branch.
    """
    names = [f"_part{level}" for level in range(CUTS)]
    few = rows.where(F.col("_d") <= LISTED).drop("_d", "_lo", "_hi").withColumns({n: F.lit(0).cast("bigint") for n in names})
    if not large:
        return few, [*keys, *names]
    cut = _cut(rows.where(F.col("_d") > LISTED).drop("_d"), list(keys), wanted, carried)
    return few.unionByName(cut), [*keys, *names]


def _cut(rows: DataFrame, keys: list[str], wanted, carried: Sequence[str]) -> DataFrame:
    for level in range(CUTS):
        name = f"_part{level}"
        rows = rows.withColumn(name, _part()).drop("_lo", "_hi")
        parts = rows.groupBy(*keys, name).agg(
            F.sum("_c").alias("_sum"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"),
            F.first("_before").alias("_before"), *([F.first("_n").alias("_n")] if wanted else []),
            *[F.first(c).alias(f"_{c}_read") for c in carried])
        run = Window.partitionBy(*keys).orderBy(name).rowsBetween(Window.unboundedPreceding, 0)
        parts = parts.withColumn("_upto", F.col("_before") + F.sum("_sum").over(run))
        parts = parts.withColumn("_before", F.col("_upto") - F.col("_sum"))
        if wanted:
            parts = parts.where(wanted(F.col("_before"), F.col("_upto"))).drop("_n")
        keys.append(name)
        rows = rows.drop("_before").join(parts.drop("_upto", "_sum", *[f"_{c}_read" for c in carried]), keys)
    return rows.drop("_lo", "_hi")


def distribution(
    df: DataFrame,
    by: Sequence[str],
    values: Sequence[str],
    quantiles: Mapping[str, float] | None = None,
    carry: Mapping[str, tuple[str, Column]] | None = None,
    bits: int = 12,
) -> DataFrame:
    """One row per (by, variable): counts, moments, extremes and exact quantiles.

    Columns: n_rows, n, sum, mean, sd, min, max, n_zero, n_negative, one per
    quantile (linear interpolation), one per carried expression.
    """
    return distribution_of_counts(value_counts(df, by, values, carry), [*by, "variable"], quantiles, carry, bits)


def distribution_of_counts(
    counts: DataFrame,
    group: Sequence[str],
    quantiles: Mapping[str, float] | None = None,
    carry: Mapping[str, tuple[str, Column]] | None = None,
    bits: int = 12,
) -> DataFrame:
    """As ``distribution``, of rows (group, _v, _c and the carried columns); a value may come in several rows."""
    quantiles = QUARTILES if quantiles is None else dict(quantiles)
    carry = dict(carry or {})
    # named once and read several times, so that the generated code stays short
    octave = F.col("_octave")
    bucket = F.coalesce(magnitude_bucket("_v", bits, octave), F.lit(MISSING))
    counts = counts.withColumn("_octave", _octave(F.abs("_v"))).withColumn("_bucket", bucket)

    v, c, off = F.col("_v"), F.col("_c"), F.col("_off")
    anchored = counts.withColumn("_anchor", _anchor(v, bits, octave)).withColumn("_off", v - F.col("_anchor"))
    merge = {"sum": F.sum, "min": F.min, "max": F.max}
    carried = lambda: [merge[kind](name).alias(name) for name, (kind, _) in carry.items()]
    hist = anchored.groupBy(*group, "_bucket").agg(
        F.sum("_c").alias("_c"),
        F.count("*").alias("_d"),
        F.sum(c * v).alias("_s"),
        F.first("_anchor").alias("_at"),
        F.sum(c * off).alias("_d1"),
        F.sum(c * off * off).alias("_d2"),
        F.min("_v").alias("_lo"),
        F.max("_v").alias("_hi"),
        *carried(),
    )
    # one short window per group: its rows are the occupied buckets, not the data
    whole = Window.partitionBy(*group)
    here = F.col("_bucket") != MISSING
    known = F.when(here, F.col("_c")).otherwise(0)
    hist = hist.select(
        "*",
        F.sum(known).over(whole).alias("_n"),
        F.try_divide(F.sum("_s").over(whole), F.sum(known).over(whole)).alias("_mean"),
        F.sum(known)
        .over(whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0))
        .alias("_upto"),
    )
    bucket_mean = F.col("_at") + F.col("_d1") / F.col("_c")
    spread = F.col("_d2") - F.col("_d1") * F.col("_d1") / F.col("_c")
    spread = spread + F.col("_c") * (bucket_mean - F.col("_mean")) * (bucket_mean - F.col("_mean"))

    def ranks(p: float) -> tuple[Column, Column, Column]:
        at = F.lit(p) * (F.col("_n") - 1)
        return F.floor(at), F.ceil(at), at - F.floor(at)

    def holds(rank: Column, before: Column, upto: Column) -> Column:
        return (rank >= before) & (rank < upto)

    def wanted(before: Column, upto: Column) -> Column:
        found = F.col("_n") == 0  # a group without any value keeps its row of missing values
        for p in quantiles.values():
            for r in ranks(p)[:2]:
                found = found | holds(r, before, upto)
        return found

    ahead = F.col("_upto") - F.col("_c")
    looked_into = (F.col("_n") == 0) | (here & wanted(ahead, F.col("_upto")))
    mark = F.struct("_bucket", ahead.alias("_before"), "_d", "_lo", "_hi")
    stats = hist.groupBy(*group).agg(
        F.sum("_c").alias("n_rows"),
        F.max("_n").alias("n"),
        F.sum("_s").alias("sum"),
        F.max("_mean").alias("mean"),
        F.sqrt(
            F.try_divide(
                F.greatest(F.sum(F.when(here, spread)), F.lit(0.0)),
                F.when(F.max("_n") > 1, F.max("_n") - 1),
            )
        ).alias("sd"),
        F.min("_lo").alias("min"),
        F.max("_hi").alias("max"),
        F.coalesce(F.sum(F.when(F.col("_bucket") == 0, F.col("_c"))), F.lit(0)).alias("n_zero"),
        F.coalesce(F.sum(F.when(here & (F.col("_bucket") < 0), F.col("_c"))), F.lit(0)).alias("n_negative"),
        *carried(),
        *([F.collect_list(F.when(looked_into, mark)).alias("_marks")] if quantiles else []),
    )
    if not quantiles:
        return stats
    names = [x for x in stats.columns if x not in (*group, "_marks")]
    marks = stats.select(*group, F.col("n").alias("_n"), F.struct(*names).alias("_stats"), F.inline("_marks"))
    near, keys = narrowed(counts.drop("_octave").join(marks, [*group, "_bucket"]), [*group, "_bucket"], wanted, list(carry))
    inside = Window.partitionBy(*keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = near.withColumn("_upto", F.col("_before") + F.sum("_c").over(inside))
    picks = []
    for name, p in quantiles.items():
        lo, hi, frac = ranks(p)
        low, high = (F.max(F.when(holds(r, ahead, F.col("_upto")), F.col("_v"))) for r in (lo, hi))
        picks.append((low + (high - low) * F.max(frac)).alias(name))
    # reading the carried columns here too leaves both readers of the value counts
    # with the same columns, so that one exchange, and one scan, serves both
    again = [m.alias(f"{name}_part") for m, name in zip(carried(), carry)]
    found = ranked.groupBy(*group).agg(F.first("_stats").alias("_stats"), *picks, *again)
    settled = lambda x: F.coalesce(F.col(f"_stats.{x}"), F.col(f"{x}_part")).alias(x) if x in carry else F.col(f"_stats.{x}")
    return found.select(*group, *[settled(x) for x in names], *quantiles)


def ranks_within(df: DataFrame, by: Sequence[str], value: str, bits: int = 12) -> DataFrame:
    """(by, value, avg_rank): tie-averaged ranks for groups too large for one window."""
    known = present(df, [*by, value]).select(*by, F.col(value).cast("double").alias("_v"))
    counts = materialise(known.groupBy(*by, "_v").agg(F.count("*").alias("_c")), "counts")
    return ranks_of_counts(counts, by, bits).withColumnRenamed("_v", value)


def ranks_of_counts(counts: DataFrame, by: Sequence[str], bits: int = 12, keep: Sequence[str] = ()) -> DataFrame:
    """(by, _v, avg_rank) of rows (by, _v, _c) with each value once in its group; ``keep`` names further columns to return.

    The counts are read twice. The histogram is written, so that its size is known where it is joined,
    and whether any bucket has to be cut.
    """
    counts = counts.withColumn("_bucket", F.coalesce(magnitude_bucket("_v", bits), F.lit(MISSING)))
    hist = counts.groupBy(*by, "_bucket").agg(
        F.sum("_c").alias("_bc"), F.count("*").alias("_d"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    run = Window.partitionBy(*by).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    hist = materialise(hist.withColumn("_before", F.sum("_bc").over(run) - F.col("_bc")).drop("_bc"), "buckets")
    large = not hist.where(F.col("_d") > LISTED).isEmpty()
    near, keys = narrowed(counts.join(hist, [*by, "_bucket"]), [*by, "_bucket"], carried=keep, large=large)
    inside = Window.partitionBy(*keys).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.col("_before") + F.sum("_c").over(inside)
    return near.withColumn("_upto", upto).select(
        *by, "_v", (F.col("_upto") - F.col("_c") + (F.col("_c") + 1) / 2).alias("avg_rank"), *keep)
