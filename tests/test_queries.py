"""Every registered query against its SQL answer, and the shape of the plans."""

from __future__ import annotations

import pytest
from check_queries import compare, connect

import __spark_entry__ as entry
from slopeworks.catalog.oracles import all_oracles
from slopeworks.catalog.queries import all_queries

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = all_queries(), all_oracles()

pytestmark = pytest.mark.filterwarnings("ignore::UserWarning")


@pytest.fixture(scope="module")
def db():
    return connect(FOLDER)


def test_every_query_has_sql_and_is_registered():
    assert QUERIES.keys() == ORACLES.keys()
    assert QUERIES.keys() <= entry.queries().keys()


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, db, name):
    assert compare(spark, db, FOLDER, name, QUERIES[name], ORACLES[name]) is None


@pytest.mark.parametrize(
    "name",
    ["grad_logistic", "loss_validation", "predict_lr", "eval_confusion", "sample_minibatch", "parse_run_log",
     "log_best_rate", "upd_adam", "reg_value", "feat_std_scale_sparse", "grad_logistic_join", "sweep_best_curves"],
)
def test_plans_have_no_product_of_rows(spark, name):
    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_sampling_and_scoring_do_not_shuffle(spark):
    for name in ("sample_minibatch", "split_validation", "predict_lr", "predict_svm", "src_training_set"):
        plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan


def test_entry(spark):
    assert entry.entry(spark).count() > 0
