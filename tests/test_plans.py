"""The shape of the physical plans: what a small result would not show."""

import contextlib
import io

import pytest
from conftest import SMALL

from oracle.derived import session_star
from orderlens import __main__ as cli
from orderlens import registry

QUERIES = registry.queries(session_star)
# These fit a model when they are called.
FITTING = {
    "rf_metrics", "rf_importance", "best_model", "score_orders", "cv_auc", "cv_auc_forest",
    "rf_confusion", "rf_class_report", "rf_roc_points", "lr_metrics", "lr_coefficients",
    "lr_metrics_oof", "rf_metrics_oof",
}


def plan(df) -> str:
    text = io.StringIO()
    with contextlib.redirect_stdout(text):
        df.explain("formatted")
    return text.getvalue()


@pytest.fixture(scope="module")
def plans(spark):
    return {n: plan(q(spark, SMALL)) for n, q in QUERIES.items() if n not in FITTING}


def test_no_cross_joins(plans):
    for name, text in plans.items():
        assert "CartesianProduct" not in text and "NestedLoopJoin" not in text, name


def test_no_python_workers(plans):
    assert not {name for name, text in plans.items() if "EvalPython" in text}


def test_delivered_filter_and_columns_reach_the_scan(plans):
    text = plans["gmv_monthly"]
    assert "EqualTo(is_delivered,1)" in text
    schema = next(line for line in text.splitlines() if line.startswith("ReadSchema"))
    assert schema.count(":") - 1 == 4  # order, date, value and the flag


def test_scoring_customers_needs_no_window(plans):
    for name in ("rfm_scores", "rfm_by_state", "delay_by_seller_tier"):
        assert "Window" not in plans[name], name


def test_command_line_end_to_end(spark, tmp_path, monkeypatch):
    from test_sources import FILES

    from orderlens.sources import store

    for name, text in FILES.items():
        (tmp_path / name).write_text(text)
    monkeypatch.setattr(cli, "build_session", lambda master: spark)
    where = str(tmp_path / "store")
    cli.main(["etl", "--raw", str(tmp_path), "--store", where, "--extracts", str(tmp_path / "x")])
    assert store.read_extracts(spark, str(tmp_path / "x"))["monthly_kpis"].count() == 2
    cli.main(["report", "gmv_monthly", "aov", "--store", where, "--out", str(tmp_path / "out")])
    assert spark.read.csv(str(tmp_path / "out" / "aov"), header=True).first()["total_orders"] == "2"
    with pytest.raises(SystemExit):
        cli.main(["score", "--model", str(tmp_path / "m"), "--orders", "x", "--out", "y"])
