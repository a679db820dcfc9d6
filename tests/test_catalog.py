"""Every registered query with SQL gives the same rows as DuckDB; the rest runs."""

import pytest
from compare import compare
from conftest import SF

import __spark_entry__ as entry

# Model comparisons with full boosting take minutes; their parts are tested in test_learning.
SLOW = {"M1_regression", "M2_residuals", "M3_classification", "M5_clustering", "M5_cluster_curve", "M7_quick_clusters",
        "M11_forecast", "M17_forest_importance", "C5_exploration"}
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SLOW))
def test_query(spark, duck, name):
    status, note = compare(spark, duck, SF, name, QUERIES[name], SQL.get(name))
    assert status in ("OK", "ROWS") or (status == "EMPTY" and SF.endswith("sf0.001")), f"{status}: {note}"


def test_sql_only_for_known_queries():
    assert set(SQL) <= set(QUERIES)


def test_entry(spark):
    assert entry.entry(spark).columns == ["column", "n_outliers", "ratio", "lower", "upper"]
