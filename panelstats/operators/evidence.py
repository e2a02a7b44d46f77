"""Evidence registers: flags, inventories, direction counts and claim matrices."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelstats.functions.scalar import fill_label


def add_flags(df: DataFrame, flags: Mapping[str, Column]) -> DataFrame:
    """Boolean columns; an unknown condition is false."""
    return df.select("*", *[F.coalesce(c, F.lit(False)).alias(name) for name, c in flags.items()])


def inventory(df: DataFrame, flags: Sequence[str], total: str = "total") -> DataFrame:
    """Long (metric, value): all rows and the rows carrying each flag."""
    one = df.agg(F.count("*").alias(total), *[F.count_if(f).alias(f) for f in flags])
    return one.unpivot([], [total, *flags], "metric", "value")


def directional_counts(
    df: DataFrame, subsets: Mapping[str, Column], outcomes: Sequence[str]
) -> DataFrame:
    """(subset, outcome, direction, n) for overlapping subsets; missing is a direction.

    Wide rows are counted first, so the subsets and outcomes fan out over the
    distinct combinations rather than over the register.
    """
    member = {name: F.coalesce(c, F.lit(False)) for name, c in subsets.items()}
    combos = df.select(
        *[c.alias(f"in_{name}") for name, c in member.items()],
        *[fill_label(F.col(o).cast("string")).alias(o) for o in outcomes],
    ).groupBy(*[f"in_{n}" for n in member], *outcomes).agg(F.count("*").alias("c"))
    inside = F.array_compact(F.array(*[F.when(F.col(f"in_{n}"), F.lit(n)) for n in member]))
    long = combos.select(F.explode(inside).alias("evidence_subset"), "c", *outcomes).unpivot(
        ["evidence_subset", "c"], list(outcomes), "outcome", "direction"
    )
    return (
        long.groupBy("evidence_subset", "outcome", "direction").agg(F.sum("c").alias("n_studies"))
        .orderBy("evidence_subset", "outcome", F.desc("n_studies"), "direction")
    )


def claim_matrix(df: DataFrame, keep: Sequence[str], claims: Mapping[str, Column]) -> DataFrame:
    """One row per study and claim with its class. Rules differ from claim to claim."""
    items = F.array(*[F.struct(F.lit(n).alias("claim"), c.alias("support")) for n, c in claims.items()])
    return df.select(*keep, F.inline(items))


def claim_summary(matrix: DataFrame) -> DataFrame:
    return matrix.groupBy("claim", "support").agg(F.count("*").alias("n_studies"))


def local_evidence(df: DataFrame, condition: Column, cols: Sequence[str]) -> DataFrame:
    return df.where(F.coalesce(condition, F.lit(False))).select(*cols)
