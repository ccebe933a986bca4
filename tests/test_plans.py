"""Physical plans: nothing unbounded in one task, no Python per row, filters pushed down."""

import re

import pytest

from txnrisk.plans.catalog import QUERIES, txns
from txnrisk.operators import investigate as I, ordering

EAGER = {"live_hourly"}


@pytest.mark.parametrize("name", [q for q in QUERIES if q not in EAGER])
def test_no_python_nodes_and_no_pair_joins(name, spark, sf):
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    for node in ("EvalPython", "InPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert node not in plan, node


def windows_over_raw_rows(plan: str) -> list[str]:
    """Single-partition exchanges that are not fed by an aggregate or a top-k."""
    lines = plan.splitlines()
    bad = []
    for i, line in enumerate(lines):
        if "SinglePartition" in line:
            below = lines[i + 1] if i + 1 < len(lines) else ""
            if not re.search(r"HashAggregate|TakeOrdered|ObjectHash|SortAggregate|LocalLimit|Project", below):
                bad.append(line + "\n" + below)
    return bad


@pytest.mark.parametrize("name", ["amount_ranks", "roc_curve", "model_metrics", "sender_ranking",
                                  "amount_percentiles_all", "hourly_running_loss"])
def test_single_partitions_hold_aggregates_only(name, spark, sf):
    plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert windows_over_raw_rows(plan) == []


def test_rank_ranges_reuse_the_value_counts(spark, sf):
    ranked = ordering.global_rank(txns(spark, sf).select("id", "amount"), "amount")
    ranked.collect()
    plan = ranked._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "ReusedExchange" in plan or plan.count("FileScan") <= 3


def test_top_k_is_not_a_sort(spark, sf):
    plan = QUERIES["top_fraud"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan


def test_mean_is_a_scalar_subquery(spark, sf):
    plan = I.above_average_fraud(txns(spark, sf))._jdf.queryExecution().executedPlan().toString()
    assert "Subquery" in plan
