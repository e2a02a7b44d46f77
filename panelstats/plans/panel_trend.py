"""Unit-by-year panel study from landed tables to result tables.

contract and gates -> balanced panel -> annual tables -> trends -> bootstrap -> changes.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelstats.operators import bootstrap, joins, panel, quality, series, trend
from panelstats.session import materialise
from panelstats.sources.tables import cast_strict, write_table


@dataclass(frozen=True)
class PanelColumns:
    """Names in the pixel table and in the area table with its stored total row."""
    key: tuple[str, ...] = ("x", "y")
    area: str = "subdistrict"
    period: str = "year"
    value: str = "ff"
    support: str = "count"
    area_value: str = "ws"
    total: str = "all"


def prepare(pixels: DataFrame, areas: DataFrame, c: PanelColumns, first: int, last: int) -> tuple[DataFrame, DataFrame]:
    """Column contract, strict types, and the gates that stop a broken input."""
    quality.require_columns(pixels, [*c.key, c.area, c.period, c.value, c.support])
    quality.require_columns(areas, [c.area, c.period, c.area_value, c.support])
    numbers = {k: "double" for k in c.key}
    pixels = cast_strict(pixels, {**numbers, c.period: "int", c.value: "double", c.support: "int"})
    areas = cast_strict(areas, {c.period: "int", c.area_value: "double", c.support: "int"})
    n = last - first + 1
    quality.enforce(joins.union_all([
        quality.expect_values(pixels, {
            "first_period": (F.min(c.period), first), "last_period": (F.max(c.period), last),
            "n_periods": (F.countDistinct(c.period), n)}),
        quality.rule_report(pixels, {"value_in_unit_range": F.col(c.value).between(0, 1)}),
        quality.rule_report(areas, {"area_value_in_unit_range": F.col(c.area_value).between(0, 1)}),
        quality.expect_unique(pixels, [*c.key, c.period], "unique_pixel_period"),
        quality.expect_unique(areas, [c.area, c.period], "unique_area_period"),
    ]))
    return pixels, areas


def split_total(areas: DataFrame, c: PanelColumns) -> tuple[DataFrame, DataFrame]:
    """The stored total row of each period, and the rows of the single areas."""
    total = F.lower(c.area) == c.total.lower()
    return areas.where(total), areas.where(~total)


def named_series(annual: DataFrame, period: str, names: Mapping[str, str]) -> DataFrame:
    """Long (series, period, value) of the chosen annual columns."""
    wide = annual.select(period, *[F.col(col).alias(name) for name, col in names.items()])
    return wide.unpivot(period, list(names), "series", "value")


SERIES = {  # series name: annual column; callers may pass their own
    "balanced": "mean_balanced",
    "all_units": "mean_full",
    "well_supported": "mean_balanced_support_ge3",
    "weighted": "mean_balanced_weighted",
}


def panel_tables(
    pixels: DataFrame, areas: DataFrame, c: PanelColumns, first: int, last: int, block: int = 6, n_boot: int = 20_000,
    names: Mapping[str, str] | None = None,
) -> dict[str, DataFrame]:
    """All result tables by name. The annual table is written once and read by the rest."""
    pixels, areas = prepare(pixels, areas, c, first, last)
    n = last - first + 1
    key, p = list(c.key), c.period
    annual = materialise(panel.annual_table(pixels, key, p, c.value, c.support, n), "annual")
    sub = materialise(
        panel.annual_summary(panel.balanced_panel(pixels, key, p, n), [c.area, p], c.value, c.support), "subarea")
    total, single = split_total(areas, c)
    lines = named_series(annual, p, SERIES if names is None else names)
    whole = total.select(F.lit("area_total").alias("series"), p, F.col(c.area_value).alias("value"))
    every = lines.unionByName(whole)
    return {
        "qa_summary": quality.qa_summary(pixels, key, p, c.area, c.value, c.support),
        "completeness": joins.with_spine(
            pixels.sparkSession, quality.completeness(pixels, key, p, c.area), p, first, last,
            ["n_records", "n_keys"], ["areas"]),
        "coverage": panel.coverage_histogram(pixels, key, p),
        "stability": quality.unstable_keys(pixels, key, c.area),
        "support_distribution": quality.frequency(pixels, c.support),
        "annual": annual,
        "subarea_annual": sub,
        "series_trends": trend.trend_table(every, ["series"], p, "value"),
        "subarea_trends": trend.trend_table(sub, [c.area], p, "mean_value"),
        "area_trends": trend.trend_table(single, [c.area], p, c.area_value),
        "early_late": panel.block_change(every, ["series"], p, "value", (first, first + block - 1), (last - block + 1, last)),
        "endpoints": panel.endpoint_change(every, ["series"], p, "value", first, last),
        "robustness": bootstrap.block_bootstrap(every, ["series"], p, "value", n_boot=n_boot),
        "diagnostics": quality.diagnostics(pixels, key, p, c.area, c.value, n),
        "chart": series.series_for_plot({
            "levels": (annual, p, ["mean_balanced", "mean_full"], None),
            "area_total": (total, p, [c.area_value], None),
            "subareas": (sub, p, ["mean_value"], c.area)}),
    }


def write_all(results: Mapping[str, DataFrame], folder: str, fmt: str = "parquet") -> None:
    for name, df in results.items():
        write_table(df, f"{folder}/{name}", fmt)
