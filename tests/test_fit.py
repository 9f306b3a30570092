"""Training end to end on small tables."""

from __future__ import annotations

import math
import warnings

import numpy as np
import pytest
from helpers import as_sparse, four_rows, random_rows

from slopeworks import SgdConfig, fit, register_loss, register_updater, train_logistic, train_svm
from slopeworks.functions.updates import UPDATER_NAMES
from slopeworks.operators.gradient import batch_sums, prepare

pytestmark = pytest.mark.filterwarnings("ignore::UserWarning")


def plain(**changes):
    return SgdConfig(**({"updater": "simple", "num_iterations": 3, "convergence_tol": 0.0} | changes))


POINT = np.array([[0.5, -0.25]])


@pytest.mark.parametrize("layout", ["columns", "arrow"])
@pytest.mark.parametrize(
    "loss,gradient,total",
    [("logistic", [0.6770590535512367, -2.339476362060489], 3.4950926659642683), ("hinge", [0.0, -4.0], 5.0)],
)
def test_gradient_of_four_rows(spark, layout, loss, gradient, total):
    rows = prepare(four_rows(spark), 2)
    sums = batch_sums(rows, rows.df, POINT, np.zeros(1), [loss], layout)
    np.testing.assert_allclose(sums.gradient[0], gradient, rtol=1e-12)
    assert sums.loss[0] == pytest.approx(total, rel=1e-12)
    assert sums.n == 4


@pytest.mark.parametrize("layout", ["columns", "arrow", "join"])
@pytest.mark.parametrize(
    "loss,losses,weights",
    [
        ("logistic", [0.6931471806, 0.4886407091, 0.3992810784], [0.01525384, 1.05670494]),
        ("hinge", [1.0, 0.25, 0.3125], [0.0, 1.25]),
    ],
)
def test_three_steps(spark, layout, loss, losses, weights):
    result = fit(four_rows(spark), plain(loss=loss), layout=layout)[0]
    np.testing.assert_allclose(result.losses, losses, atol=1e-10)
    np.testing.assert_allclose(result.model.weights, weights, atol=1e-8)
    scored = result.model.transform(four_rows(spark))
    assert [r["prediction"] for r in scored.collect()] == [1.0, 0.0, 1.0, 0.0]
    assert result.stop_reason == "max_iterations"


@pytest.mark.parametrize("layout", ["arrow", "join"])
def test_sparse_equals_dense(spark, layout):
    rows = random_rows(spark, 300, 6)
    configs = [plain(updater=u, step_size=0.5, intercept=True) for u in ("momentum", "adam", "adagrad")]
    dense = fit(rows, configs, layout="arrow")
    sparse = fit(as_sparse(rows), configs, num_features=6, layout=layout)
    for a, b in zip(dense, sparse):
        np.testing.assert_allclose(a.model.weights, b.model.weights, atol=1e-10)
        np.testing.assert_allclose(a.losses, b.losses, atol=1e-10)


def test_layouts_agree_with_everything_switched_on(spark):
    rows = random_rows(spark, 400, 5)
    shared = {
        "intercept": True, "scale": True, "mini_batch_fraction": 0.5, "validation_split": 0.3,
        "reg_type": 2, "reg_param": 0.01, "decay": True, "num_iterations": 4,
    }
    configs = [plain(updater=u, step_size=0.3, **shared) for u in ("nesterov", "adadelta", "amsgrad")]
    found = {layout: fit(rows, configs, layout=layout) for layout in ("columns", "arrow", "join")}
    for layout in ("arrow", "join"):
        for a, b in zip(found["columns"], found[layout]):
            np.testing.assert_allclose(a.model.weights, b.model.weights, atol=1e-10)
            np.testing.assert_allclose(a.losses, b.losses, atol=1e-10)
            np.testing.assert_allclose(
                [s.val_loss for s in a.steps], [s.val_loss for s in b.steps], atol=1e-10
            )
            assert a.model.intercept == pytest.approx(b.model.intercept, abs=1e-10)


def test_lock_step_equals_single_fits(spark):
    rows = random_rows(spark, 300, 4)
    configs = [plain(updater=u, mini_batch_fraction=0.5) for u in UPDATER_NAMES] + [plain(loss="hinge")]
    together = fit(rows, configs)
    for config, result in zip(configs, together):
        alone = fit(rows, config)[0]
        np.testing.assert_allclose(alone.model.weights, result.model.weights, atol=1e-12)
        assert alone.losses == pytest.approx(result.losses, abs=1e-12, nan_ok=True)


def test_partitioning_does_not_matter(spark):
    rows = random_rows(spark, 300, 4)
    config = plain(mini_batch_fraction=0.5, validation_split=0.25)
    a, b = fit(rows.repartition(1), config)[0], fit(rows.repartition(13, "row_key"), config)[0]
    np.testing.assert_allclose(a.model.weights, b.model.weights, atol=1e-12)
    assert [s.batch_n for s in a.steps] == [s.batch_n for s in b.steps]


def test_tables_without_key_sample_too(spark):
    rows = random_rows(spark, 2000, 3).drop("row_key")
    result = fit(rows, plain(mini_batch_fraction=0.25, validation_split=0.2))[0]
    assert all(250 < s.batch_n < 550 for s in result.steps)
    assert all(s.val_loss is not None for s in result.steps)


def test_intercept_starts_at_one(spark):
    result = fit(four_rows(spark), plain(num_iterations=0, intercept=True))[0]
    assert result.model.intercept == 1.0 and not result.steps


def test_no_iterations_returns_initial_weights(spark):
    result = fit(four_rows(spark), plain(num_iterations=0), initial_weights=[2.0, 3.0])[0]
    np.testing.assert_array_equal(result.model.weights, [2.0, 3.0])


def test_no_rows_returns_initial_weights(spark):
    empty = four_rows(spark).filter("label > 5")
    with pytest.warns(UserWarning, match="no rows"):
        result = fit(empty, plain(), initial_weights=[2.0, 3.0])[0]
    assert result.stop_reason == "no_data" and result.losses == []
    np.testing.assert_array_equal(result.model.weights, [2.0, 3.0])


def test_empty_batch_is_skipped(spark):
    one = spark.createDataFrame([(1.0, [1.0], "a")], "label double, features array<double>, row_key string")
    with warnings.catch_warnings(record=True) as said:
        warnings.simplefilter("always")
        result = fit(one, plain(mini_batch_fraction=0.5, num_iterations=8))[0]
    missing = [s for s in result.steps if s.batch_n == 0]
    assert missing and len(result.losses) == 8 - len(missing) and len(result.steps) == 8
    assert any("empty" in str(w.message) for w in said)


@pytest.mark.parametrize("layout", ["arrow", "join"])
def test_early_stop_keeps_the_weights_before_the_stop(spark, layout):
    rows = random_rows(spark, 300, 4)
    config = plain(step_size=40.0, num_iterations=30, validation_split=0.3, iter_validation=2)
    result = fit(rows, config, layout=layout)[0]
    assert result.stop_reason == "early_stop"
    stop = result.steps[-1].iteration
    assert 2 < stop < 30
    val = [s.val_loss for s in result.steps]
    assert not val[-1] < val[-2]
    before = fit(rows, config.with_(num_iterations=stop - 1, iter_validation=50), layout=layout)[0]
    np.testing.assert_allclose(result.model.weights, before.model.weights, atol=1e-10)


@pytest.mark.parametrize("layout", ["arrow", "join"])
def test_convergence_ends_a_fit_but_not_at_the_first_step(spark, layout):
    result = fit(four_rows(spark), plain(step_size=0.1, num_iterations=9, convergence_tol=1.0), layout=layout)[0]
    assert (result.stop_reason, len(result.steps)) == ("converged", 2)
    never = fit(four_rows(spark), plain(step_size=1e-9, num_iterations=4), layout=layout)[0]
    assert never.stop_reason == "max_iterations"


def test_configurations_end_at_their_own_time(spark):
    configs = [plain(num_iterations=n) for n in (1, 4, 2)]
    found = fit(four_rows(spark), configs)
    assert [len(r.steps) for r in found] == [1, 4, 2]
    alone = fit(four_rows(spark), configs[2])[0]
    np.testing.assert_allclose(found[2].model.weights, alone.model.weights, atol=1e-12)


@pytest.mark.parametrize("layout", ["columns", "arrow", "join"])
def test_adamax_and_a_dead_feature(spark, layout):
    rows = spark.createDataFrame(
        [(1.0, [1.0, 0.0]), (0.0, [-1.0, 0.0]), (1.0, [2.0, 0.0])], "label double, features array<double>"
    )
    reference = fit(rows, plain(updater="adamax", num_iterations=2), layout=layout)[0]
    assert math.isnan(reference.model.weights[1]) and math.isnan(reference.losses[1])
    standard = fit(rows, plain(updater="adamax", num_iterations=2, semantics="standard"), layout=layout)[0]
    assert standard.model.weights[1] == 0.0 and np.isfinite(standard.losses).all()


def test_nan_in_one_configuration_leaves_the_others_alone(spark):
    rows = spark.createDataFrame(
        [(1.0, [1.0, 0.0]), (0.0, [-1.0, 0.0]), (1.0, [2.0, 0.0])], "label double, features array<double>"
    )
    found = fit(rows, [plain(updater="adamax"), plain()])
    assert np.isnan(found[0].model.weights).any() and np.isfinite(found[1].model.weights).all()


def test_adadelta_ignores_the_rate_without_regularization(spark):
    rows = random_rows(spark, 100, 3)
    found = fit(rows, [plain(updater="adadelta", step_size=s) for s in (10.0, 1.0, 0.1)])
    assert found[0].losses == found[1].losses == found[2].losses


def test_zero_penalty_equals_none(spark):
    rows = random_rows(spark, 100, 3)
    none, l1, l2 = fit(rows, [plain(reg_type=t) for t in (0, 1, 2)])
    np.testing.assert_allclose(none.model.weights, l1.model.weights)
    np.testing.assert_allclose(none.model.weights, l2.model.weights)


def test_vanishing_momentum_is_simple(spark):
    rows = random_rows(spark, 100, 3)
    a, b = fit(rows, [plain(), plain(updater="momentum", momentum_fraction=1e-12)])
    np.testing.assert_allclose(a.model.weights, b.model.weights, atol=1e-9)


def test_scaling_equals_training_on_scaled_rows(spark):
    from slopeworks.operators.features import column_stddev, inverse_sd, collect_vector, scaled

    rows = random_rows(spark, 200, 3)
    sd = column_stddev(rows, 3)
    direct = fit(scaled(rows, sd, 3), plain(intercept=True))[0]
    found = fit(rows, plain(intercept=True, scale=True))[0]
    back = direct.model.weights * inverse_sd(collect_vector(sd, "sd", 3))
    np.testing.assert_allclose(found.model.weights, back, atol=1e-10)
    np.testing.assert_allclose(found.losses, direct.losses, atol=1e-10)


def test_bad_labels_and_widths_are_refused(spark):
    bad = spark.createDataFrame([(2.0, [1.0])], "label double, features array<double>")
    with pytest.raises(ValueError, match="Input validation failed"):
        fit(bad, plain())
    assert fit(bad, plain(validate=False))[0].steps
    ragged = spark.createDataFrame([(1.0, [1.0]), (0.0, [1.0, 2.0])], "label double, features array<double>")
    with pytest.raises(ValueError, match="widths"):
        fit(ragged, plain())
    with pytest.raises(ValueError, match="initial weights"):
        fit(four_rows(spark), plain(), initial_weights=[1.0])


def test_user_updater_and_loss(spark):
    def signs(ops, g, state, tick):
        return tick.step * ops.sign(g), ()

    def squared(ops, margin, label):
        return margin - label, 0.5 * (margin - label) * (margin - label)

    register_updater("signs", signs, 0)
    register_loss("squared", squared)
    for layout in ("columns", "arrow", "join"):
        result = fit(four_rows(spark), plain(updater="signs", loss="squared", num_iterations=1), layout=layout)[0]
        # at zero weights the gradient is -(x1 + x3)/4 = -(1, 3)/4
        np.testing.assert_allclose(result.model.weights, [1.0, 1.0])
        assert result.losses == pytest.approx([0.25])


def test_call_forms(spark):
    rows = random_rows(spark, 200, 3)
    a = train_logistic(rows, 5, updater="adam", step_size=0.1)
    b = train_logistic(rows, 5, updater="adam", step_size=0.1, initial_weights=[0.0, 0.0, 0.0])
    np.testing.assert_allclose(a.model.weights, b.model.weights)
    svm = train_svm(rows, 5, reg_type=2, reg_param=0.01)
    assert svm.model.loss == "hinge" and "num_features=3" in repr(svm.model)
    history = a.history(spark)
    assert history.count() == len(a.steps)
