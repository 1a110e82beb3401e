"""What the plans must and must not contain."""

from __future__ import annotations

import re

import pytest
from catalog import CATALOG
from sensorspark.functions import ordering

SF = "/root/testdata/sf0.001"
QUERIES = {name: q.run for name, q in CATALOG.items()}
# Queries that fit models or run streams build their plans while running.
STATIC = sorted(n for n in QUERIES if not n.startswith(("ml_", "str_", "evl_champion")))


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", STATIC)
def test_no_pairwise_join_and_no_python_on_rows(spark, name):
    plan = plan_of(QUERIES[name](spark, SF))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    # Python only finishes p-values, on one-row results.
    if "EvalPython" in plan:
        assert name.startswith(("stat_", "drf_"))
    assert "BatchEvalPython" not in plan


@pytest.mark.parametrize(
    "name", ["agg_describe", "agg_outliers_iqr_by_source", "stat_ks_2samp", "win_group_threshold_median"]
)
def test_ordered_scans_read_the_counts_once(spark, name, monkeypatch):
    """Both uses of the distinct counts share one exchange, also where the result is stored for a join."""
    stored, via_table = [], ordering.via_table
    monkeypatch.setattr(ordering, "via_table", lambda df, label: (stored.append(df), via_table(df, label))[1])
    df = QUERIES[name](spark, SF)
    df = stored[0] if stored else df
    df.collect()
    assert "ReusedExchange" in plan_of(df)


@pytest.mark.parametrize(
    "name, pushed",
    [
        ("src_warehouse_window", "GreaterThanOrEqual(ts"),
        ("agg_freshness_check", "GreaterThanOrEqual(ts"),
        ("flt_high_water", "GreaterThan(ts"),
        ("src_unified_view", "LessThanOrEqual(ts"),
    ],
)
def test_filters_reach_the_scan(spark, name, pushed):
    assert pushed in plan_of(QUERIES[name](spark, SF))


def test_only_needed_columns_are_read(spark):
    read = re.findall(r"ReadSchema: struct<([^>]*)>", plan_of(QUERIES["agg_mean_by_hour"](spark, SF)))
    assert read == ["ts:timestamp_ntz,value:double"]


def test_no_window_over_all_rows(spark):
    """Windows without keys only ever see bucket summaries."""
    for name in ("agg_describe_all", "stat_ks_2samp"):
        plan = plan_of(QUERIES[name](spark, SF))
        single = [part for part in plan.split("SinglePartition")[1:]]
        assert all("FileScan" not in part.split("Exchange")[0] for part in single)
