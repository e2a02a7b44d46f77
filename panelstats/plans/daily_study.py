"""Daily hydrology, sensor and yield studies from tidy tables to result tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelstats.operators import contrast, correlation, mapping, quality, series, spells
from panelstats.session import materialise
from panelstats.sources.tables import cast_coerce, where_present


@dataclass(frozen=True)
class DailyColumns:
    period: str = "year"
    group: str = "treatment"
    date: str = "date"
    inflow: str = "inflow"
    outflow: str = "outflow"
    net: str = "net_calculated"
    net_reported: str = "net_reported"
    level: str = "level"
    rain: str = "rain"
    et: str = "et"
    storage: tuple[str, ...] = ("d_storage_1", "d_storage_2")
    balance: str = "balance_reported"
    models: tuple[str, ...] = ("model_a", "model_b")  # filled in different periods, never pooled

    @property
    def numeric(self) -> list[str]:
        return [self.inflow, self.outflow, self.net, self.net_reported, self.level, self.rain, self.et,
                *self.storage, self.balance, *self.models]


def hydrology_tables(
    daily: DataFrame, c: DailyColumns, baseline: str, thresholds: Sequence[float] = (0, 1, 5),
    pair: tuple | None = None,
) -> dict[str, DataFrame]:
    """Quality, reproduction, common-window, spell and contrast tables of a daily series."""
    d = cast_coerce(daily, c.numeric)
    by = [c.period, c.group]
    quality.enforce(quality.expect_unique(d, [*by, c.date], "unique_day"))
    spells.require_complete(d, by, c.level)
    inside = series.common_window(d, c.period, c.group, c.date)
    sums = [c.inflow, c.outflow, c.net, c.rain, c.et, c.balance]
    common = materialise(
        series.common_window_summary(d, c.period, c.group, c.date, sums, c.models, c.level), "common-window")
    sensitivity = materialise(
        spells.threshold_sensitivity(inside, by, c.date, c.level, thresholds, ["common_start", "common_end"]), "thresholds")
    states = spells.daily_states(d, by, c.date, c.level)
    balance = quality.recompute_balance(d, [c.net, c.rain], [c.et, *c.storage], c.balance)
    metrics = [f"{c.inflow}_sum", f"{c.outflow}_sum", f"{c.net}_sum", f"{c.balance}_sum", "mean_level", "fraction_positive"]
    out = {
        "date_coverage": quality.date_coverage(d, by, c.date),
        "missingness": quality.missingness(d, by, c.numeric),
        "net_reproduction": quality.reproduction_error(where_present(d, [c.net_reported]), by, c.net, c.net_reported),
        "balance_reproduction": quality.reproduction_error(balance, by, "recalculated", c.balance, "present"),
        "negatives": quality.negatives(d, by, [c.net, *c.storage, c.balance, *c.models]),
        "season": series.season_summary(d, by, c.date, sums, c.models, c.level),
        "common_window": common,
        "distribution": series.profile(inside, by, [c.inflow, c.outflow, c.net, c.rain, c.et, c.level, c.balance]),
        "event_structure": series.event_structure(inside, by, c.inflow, c.outflow, c.net),
        "rain_consistency": series.consistency(inside, c.period, c.date, c.group, c.rain),
        "daily_states": states,
        "spells": spells.spells(states, by, c.date, "wet"),
        "hydroperiod": spells.hydroperiod(d, by, c.date, c.level),
        "hydroperiod_common": spells.hydroperiod(inside, by, c.date, c.level, keep=["common_start", "common_end"]),
        "thresholds": sensitivity,
        "threshold_change": spells.delta_vs(
            sensitivity, by, "threshold", float(thresholds[0]),
            ["wet_fraction", "n_wet_spells", "n_dry_spells", "wet_to_dry", "longest_dry"]),
        "contrasts": contrast.contrast(common, [c.period], c.group, baseline, metrics),
    }
    if pair:
        out["period_ratios"] = contrast.period_pair(common, [c.group], c.period, *pair, [*metrics, f"{c.rain}_sum", f"{c.et}_sum"], "error")
    return out


def sensor_tables(
    readings: DataFrame, daily: DataFrame, c: DailyColumns, sensor: str = "sensor", value: str = "depth",
    lags: Sequence[int] = (0, 1, 3, 7),
) -> dict[str, DataFrame]:
    """Sensor summaries, coherence, platform signal, and its coupling to surface flows."""
    p = c.period
    r = cast_coerce(readings, [value]).withColumn("sensor_id", F.concat_ws("_", c.group, sensor))
    platform = materialise(series.spatial_mean(r, [p, c.date], value), "platform")
    surface = series.mixed_daily(
        cast_coerce(daily, c.numeric), [p, c.date], [c.rain, c.level], [c.inflow, c.outflow, c.net, c.balance])
    merged = materialise(
        platform.select(p, c.date, F.col("mean").alias("signal")).join(surface, [p, c.date]), "coupled")
    variables = [col for col in surface.columns if col not in (p, c.date)]
    matrix = materialise(correlation.correlation_matrix(r, [p], c.date, "sensor_id", value), "matrix")
    lagged = materialise(correlation.correlate_lagged(merged, [p], c.date, "signal", variables, lags), "lagged")
    return {
        "sensor_summary": series.entity_summary(r, [p, c.group, sensor], c.date, value),
        "correlation_matrix": matrix,
        "correlation_summary": correlation.correlation_summary(matrix, [p]),
        "platform_daily": platform,
        "platform_monthly": series.resample_month(platform, [p], c.date, {
            "mean_depth": F.avg("mean"), "min_mean": F.min("mean"), "max_mean": F.max("mean"), "mean_spread": F.avg("spread")}),
        "contemporaneous": correlation.correlate(merged, [p], "signal", variables),
        "lagged": lagged,
        "first_difference": correlation.correlate_differences(merged, [p], c.date, "signal", variables),
        "best_lag": correlation.best_lag(lagged, [p, "variable"]),
    }


def yield_tables(
    plots: DataFrame, groups: Mapping, plot_rules: Sequence[tuple], common: Sequence[str], baseline: str, pair: tuple,
    primary: str,
) -> dict[str, DataFrame]:
    """Nested experiment (year, regime, location, yield): assignment, rollups, contrasts."""
    located = mapping.lookup(plots, ["year", "regime", "location"], groups, "stratum")
    d = materialise(mapping.range_lookup(located, ["year", "regime"], "location", plot_rules, "plot"), "yield")
    units = contrast.unit_means(d, ["year", "regime", "stratum", "plot"], "yield")
    rolled = materialise(contrast.group_of_means(units, ["year", "regime", "stratum"]), "rollup")
    against = contrast.contrast(rolled, ["year", "stratum"], "regime", baseline, ["mean_value"], "skip", guard=False)
    others = against.where((F.col("regime") != baseline) & F.col("stratum").isin(list(common)))
    return {
        "assignment_qa": quality.group_qa(d, ["year", "regime", "plot", "stratum"], "yield"),
        "unresolved": mapping.unresolved(d, ["plot", "stratum"]),
        "plot_means": units,
        "regime_by_stratum": rolled,
        "common_index_plots": contrast.common_index(units, ["year", "regime"], ["plot"], "stratum", common),
        "common_index": contrast.common_index_groups(units, ["year", "regime"], ["plot"], "stratum", common),
        "contrasts": against,
        "direction": contrast.direction_consistency(others, ["stratum", "regime"], "year", *pair, "mean_value_difference"),
        "primary": contrast.primary_stratum(rolled, "stratum", primary),
    }
