"""Every registered query against DuckDB (or for rows only) on the smallest data set."""

import pytest
from conftest import SMALL

import __spark_entry__ as entry
from oracle import statements
from oracle.compare import compare, connect
from oracle.derived import session_star
from orderlens import registry

QUERIES, STATEMENTS = registry.queries(session_star), statements()
# A forest of 200 trees takes minutes locally; test_risk.py runs all of these with a small one.
SLOW = {
    "rf_metrics", "rf_importance", "rf_confusion", "rf_class_report", "rf_roc_points", "best_model", "score_orders",
    "cv_auc", "cv_auc_forest", "rf_metrics_oof",
}


@pytest.fixture(scope="module")
def duck():
    return connect(SMALL)


def test_every_statement_has_a_query():
    assert set(STATEMENTS) <= set(QUERIES)


@pytest.mark.parametrize("name", [n for n in QUERIES if n not in SLOW])
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    if name in STATEMENTS:
        assert compare(df, duck, STATEMENTS[name]) is None
    else:
        assert df.count() > 0


def test_all_are_registered():
    assert set(QUERIES) <= set(entry.queries()) and set(STATEMENTS) <= set(entry.oracle_sql())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
