"""Plan checks: no cartesian products, no per-row Python, pruned scans."""

import pytest

import __spark_entry__ as entry
from conftest import SF_SMALL

FORBIDDEN = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython")


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_no_cartesian_or_row_udf(spark, name):
    plan = _plan(entry.queries()[name](spark, SF_SMALL))
    for bad in FORBIDDEN:
        assert bad not in plan, f"{name}: {bad}"
    assert "ArrowEvalPython" not in plan, f"{name}: Python in an oracle-checked plan"


def test_scan_reads_only_needed_columns(spark):
    plan = _plan(entry.queries()["filtered_count"](spark, SF_SMALL))
    scan = [line for line in plan.splitlines() if "FileScan parquet" in line][0]
    assert "l_quantity" in scan and "l_returnflag" in scan and "l_extendedprice" not in scan
    assert "PushedFilters: [" in scan and "GreaterThanOrEqual(l_quantity,10.0)" in scan


def test_aggregates_are_partial_before_exchange(spark):
    plan = _plan(entry.queries()["grouped_moments"](spark, SF_SMALL))
    assert "partial_var_samp" in plan and plan.index("Exchange") < plan.index("partial_var_samp")


def test_shard_filter_prunes_partition_folders(spark):
    df = entry.queries()["partitioned_roundtrip"](spark, SF_SMALL)
    plan = _plan(df)
    assert "PartitionFilters: [" in plan and "key" in plan.split("PartitionFilters: [")[1][:200]


def test_histogram_broadcasts_only_bounded_counts(spark):
    plan = _plan(entry.queries()["histogram_half"](spark, SF_SMALL))
    assert "BroadcastHashJoin" in plan and "Range (0, 61" in plan
