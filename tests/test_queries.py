"""Every registered query runs; those with SQL equal DuckDB's result."""

import pytest
from compare import connect, difference

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
# Fits of whole models; tests/test_models.py covers them on planted data.
SLOW = {"svm_predictions", "linear_svm_predictions", "kmeans_clusters", "class_probabilities", "feature_importance"}


@pytest.fixture(scope="module")
def duck():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, duck, name):
    assert difference(QUERIES[name](spark, FOLDER), duck, ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - SLOW))
def test_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 500


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
