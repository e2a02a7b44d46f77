"""What the physical plans must look like: scans, exchanges, pushdown, no pair products."""

import os
import re

import pytest

import __spark_entry__ as driver

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables not present")


def final_plan(spark, name):
    df = driver.queries()[name](spark, DATA)
    df.collect()
    mode = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple")
    return df._jdf.queryExecution().explainString(mode).split("== Initial Plan ==")[0]


def count(plan, word):
    return len(re.findall(rf"\b{word}\b", plan))


@pytest.mark.parametrize("name, scans, exchanges", [
    ("spells", 1, 2), ("spell_summary", 1, 2), ("annual_summary", 1, 4), ("distribution_profile", 1, 4),
    ("sensor_summary", 1, 4), ("qa_summary", 1, 3), ("diagnostics", 1, 3), ("missingness", 1, 2),
    ("monthly_resample", 1, 3), ("event_structure", 2, 4), ("corr_lagged", 1, 4), ("group_qa", 1, 1),
])
def test_scans_and_exchanges(spark, name, scans, exchanges):
    plan = final_plan(spark, name)
    assert count(plan, "FileScan") == scans
    assert count(plan, "Exchange") <= exchanges


def test_columns_are_pruned(spark):
    schema = re.search(r"ReadSchema: struct<([^>]*)>", final_plan(spark, "spells")).group(1)
    assert {c.split(":")[0] for c in schema.split(",")} == {"ts", "event_type", "value"}


def test_filters_reach_the_scan(spark):
    pushed = re.search(r"PushedFilters: \[([^]]*)\]", final_plan(spark, "support_filtered")).group(1)
    assert "GreaterThanOrEqual(l_linenumber,3)" in pushed


@pytest.mark.parametrize("name", ["trend_table", "corr_matrix", "block_bootstrap", "threshold_sensitivity", "common_window",
                                  "baseline_contrast", "directional_counts", "group_consistency"])
def test_no_pair_products(spark, name):
    plan = final_plan(spark, name)
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_python_only_where_needed(spark):
    for name in ("annual_table", "spell_summary", "claim_matrix", "header_discovery", "corr_lagged", "manifest_integrity"):
        plan = final_plan(spark, name)
        assert "Python" not in plan and "Pandas" not in plan, name
