"""Physical plans: what must not be in them at scale."""

import pytest

from fieldtally.plans import REGISTRY

# Tail probabilities of finished tests are the only Python functions.
WITH_P_VALUES = {
    "t1_welch", "t2_mann_whitney", "t3_spearman", "t4_verdicts", "j5_cross_log_test",
    "h1a_threshold_grain", "h1b_backoff_profit", "h1d_immigration_profit",
}


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_plan(spark, folder, name):
    frame = REGISTRY[name].plan(spark, folder)
    text = frame._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in text
    assert "BroadcastNestedLoopJoin" not in text
    # Strings in min or max would turn hashing into sorting; only the few finished
    # conditions are compared that way.
    assert "SortAggregate" not in text or name == "sr2_best_and_worst"
    has_python = "ArrowEvalPython" in text or "BatchEvalPython" in text or "InPandas" in text
    assert has_python == (name in WITH_P_VALUES)
    # A single partition may hold a final aggregate, but never feed a window.
    lines = text.splitlines()
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" in line:
            assert not any("Window [" in above for above in lines[max(0, i - 2):i])
    # Columns that no plan uses do not reach the scan.
    scans = [line for line in lines if "FileScan" in line]
    assert not any("l_orderkey" in line or "props" in line for line in scans)


def shuffles(frame):
    return frame._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_rank_correlation_ranks_both_sides_in_one_pass(spark, folder):
    assert shuffles(REGISTRY["t3_spearman"].plan(spark, folder)) <= 8


def test_neighbourhoods_copy_no_row(spark, folder):
    text = REGISTRY["j6_neighbour_mean"].plan(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in text and "Expand" not in text and text.count("Window [") == 1


def test_dirty_lines_are_scanned_and_parsed_once(spark, folder):
    text = REGISTRY["io5_clean_log"].plan(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert text.count("FileScan text") == 1 and text.count("from_csv(") == 1


@pytest.mark.parametrize(
    "name", ["w1_cumulative_exposure", "w2_days_above_threshold", "w3_days_since_spray", "w5_heat_accumulation", "w6_growth_accumulation"]
)
def test_daily_windows_need_no_exchange_of_their_own(spark, folder, name):
    """The view brings plots together; the check of repeated days rides on the same pass."""
    text = REGISTRY[name].plan(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") <= 2
