"""Every registered query against its SQL on DuckDB."""

import compare
import pytest

import __spark_entry__ as entry
from fieldtally.plans import REGISTRY


@pytest.fixture(scope="module")
def con(folder):
    return compare.connect(folder)


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query_equals_sql(spark, folder, con, name):
    item = REGISTRY[name]
    assert compare.differences(item.plan(spark, folder), con, item.sql) is None


def test_entry(spark):
    result = entry.entry(spark)
    assert result.columns == [
        "strategy", "pesticide_choice", "fixation_season", "max_season", "final_mean_rf",
    ]
    assert result.count() == 9


def test_all_queries_have_sql():
    assert set(REGISTRY) <= set(entry.queries())
    assert set(REGISTRY) <= set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())
