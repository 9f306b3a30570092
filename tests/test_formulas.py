"""Losses and updates against hand-computed values, on numpy and on Columns."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from slopeworks import SgdConfig, updater_by_id
from slopeworks.functions.losses import hinge, logistic
from slopeworks.functions.ops import ColumnOps, NumpyOps
from slopeworks.functions.updates import (
    UPDATER_NAMES,
    Tick,
    penalty,
    regularized,
    updater_named,
)
from slopeworks.operators.update import fresh_params, penalties, updated

W0 = np.array([0.5, -0.25, 0.0])
G1 = np.array([0.1, -0.2, 0.0])
G2 = np.array([-0.05, 0.3, 0.0])
NAN = float("nan")

# Weights after one and two steps with step size 0.1, from W0 with gradients G1 and G2.
TWO_STEPS = {
    ("simple", "standard"): ([0.49, -0.23, 0], [0.495, -0.26, 0]),
    ("momentum", "standard"): ([0.49, -0.23, 0], [0.486, -0.242, 0]),
    ("nesterov", "standard"): ([0.49, -0.23, 0], [0.486, -0.242, 0]),
    ("adagrad", "standard"): ([0.40000005, -0.15000001, 0], [0.44472139, -0.23320504, 0]),
    ("adadelta", "standard"): ([0.49968377, -0.24968377, 0], [0.49989229, -0.25006174, 0]),
    ("rmsprop", "standard"): ([0.18377382, 0.06622737, 0], [0.33121513, -0.20103377, 0]),
    ("adam", "standard"): ([0.40000001, -0.15, 0], [0.37336631, -0.17477019, 0]),
    ("adam", "reference"): ([0.42558633, -0.17558632, 0], [0.40272229, -0.1968506, 0]),
    ("adamax", "standard"): ([0.4, -0.15, 0], [0.37892629, -0.17105263, 0]),
    ("adamax", "reference"): ([0.44736842, -0.19736842, NAN], [0.4325935, -0.21212857, NAN]),
    ("nadam", "standard"): ([0.35263159, -0.10263159, 0], [0.36911795, -0.18018693, 0]),
    ("nadam", "reference"): ([0.37863158, -0.12863157, 0], [0.39099604, -0.19687325, 0]),
    ("amsgrad", "standard"): ([0.18377323, 0.06622727, 0], [0.07059119, -0.0390358, 0]),
    ("amsgrad", "reference"): ([0.18377323, 0.06622727, 0], [0.07059119, -0.0390358, 0]),
}


def numpy_steps(config, w, gradients):
    rule = updater_named(config.updater)
    state = tuple(np.zeros_like(w) for _ in range(rule.state_size))
    out = []
    with np.errstate(all="ignore"):
        for t, g in enumerate(gradients, 1):
            step = config.step_at(t)
            move, state = rule.move(NumpyOps, g, state, Tick(config, step, t))
            w = regularized(NumpyOps, w, move, config, step)
            out.append(w)
    return out, state


@pytest.mark.parametrize("updater,semantics", list(TWO_STEPS))
def test_two_steps_on_numpy(updater, semantics):
    config = SgdConfig(updater=updater, step_size=0.1, semantics=semantics)
    found, _ = numpy_steps(config, W0, [G1, G2])
    for got, want in zip(found, TWO_STEPS[updater, semantics]):
        np.testing.assert_allclose(got, want, atol=6e-9)


@pytest.mark.parametrize("updater,semantics", list(TWO_STEPS))
def test_two_steps_on_columns(spark, updater, semantics):
    config = SgdConfig(updater=updater, step_size=0.1, semantics=semantics)
    rows = [(j, float(W0[j]), float(G1[j]), float(G2[j])) for j in range(3)]
    start = spark.createDataFrame(rows, "idx int, w double, g1 double, g2 double")
    once = updated(fresh_params(start, config), F.col("g1"), config, 1, 1)
    twice = updated(once, F.col("g2"), config, 2, 2)
    got = [r["w"] for r in twice.orderBy("idx").collect()]
    np.testing.assert_allclose(got, TWO_STEPS[updater, semantics][1], atol=6e-9)


def test_nesterov_looks_ahead(spark):
    config = SgdConfig(updater="nesterov", step_size=0.1)
    rows = [(j, float(W0[j]), float(G1[j])) for j in range(3)]
    start = spark.createDataFrame(rows, "idx int, w double, g1 double")
    once = updated(fresh_params(start, config), F.col("g1"), config, 1, 1)
    got = [r["ahead"] for r in once.orderBy("idx").collect()]
    np.testing.assert_allclose(got, [0.481, -0.212, 0], atol=1e-12)


@pytest.mark.parametrize("semantics,second", [("standard", -0.1039948421), ("reference", -0.1041244248)])
def test_amsgrad_forms_differ_when_the_gradient_shrinks(semantics, second):
    config = SgdConfig(updater="amsgrad", step_size=0.1, semantics=semantics)
    found, _ = numpy_steps(config, np.array([0.5]), [np.array([1.0]), np.array([0.01])])
    assert found[0][0] == pytest.approx(0.183772334, abs=1e-9)
    assert found[1][0] == pytest.approx(second, abs=1e-9)


def test_regularization_tails(spark):
    for kind, weights, value in ((1, [0.44, -0.18, 0], 0.31), (2, [0.465, -0.2175, 0], 0.0658828125)):
        config = SgdConfig(updater="simple", step_size=0.1, reg_type=kind, reg_param=0.5)
        found, _ = numpy_steps(config, W0, [G1])
        np.testing.assert_allclose(found[0], weights, atol=1e-12)
        assert penalty(config, np.abs(found[0]).sum(), found[0] @ found[0]) == pytest.approx(value)
        table = spark.createDataFrame([(j, float(w)) for j, w in enumerate(weights)], "idx int, w double")
        assert penalties(table, config).first()["penalty"] == pytest.approx(value)


def test_decay_divides_by_the_root_of_the_iteration():
    config = SgdConfig(updater="simple", step_size=0.1, decay=True)
    assert config.step_at(4) == pytest.approx(0.05)


def test_the_opening_penalty_is_a_number():
    make = lambda **c: SgdConfig(reg_type=2, reg_param=0.5, **c)
    for config in (make(updater="adamax"), make(updater="simple", decay=True), make(updater="adamax", semantics="standard")):
        assert penalty(config, 1.0, 1.0) == 0.25
    assert penalty(SgdConfig(updater="adamax"), 1.0, 1.0) == 0.0



def test_losses_agree_between_numpy_and_columns(spark):
    margins = [-800.0, -3.0, -1.0, 0.0, 0.5, 1.0, 40.0, 800.0, NAN]
    rows = [(m, y) for m in margins for y in (0.0, 1.0)]
    table = spark.createDataFrame(rows, "m double, y double")
    m, y = np.array(rows).T
    for loss in (logistic, hinge):
        with np.errstate(all="ignore"):
            want = loss(NumpyOps, m, y)
        p, q = loss(ColumnOps, F.col("m"), F.col("y"))
        got = np.array([tuple(r) for r in table.select(p, q).collect()]).T
        np.testing.assert_allclose(got, want, rtol=1e-12, atol=1e-15)


def test_gradient_is_the_slope_of_the_loss():
    h = 1e-6
    for loss in (logistic, hinge):
        for m in (-2.0, -0.3, 0.4, 3.0):
            for y in (0.0, 1.0):
                up, down = (float(loss(NumpyOps, np.float64(m + s), y)[1]) for s in (h, -h))
                assert float(loss(NumpyOps, np.float64(m), y)[0]) == pytest.approx((up - down) / (2 * h), abs=1e-5)


def test_updaters_by_id():
    assert [updater_by_id(i).name for i in range(10)] == list(UPDATER_NAMES)
    for bad in (-1, 10):
        with pytest.raises(ValueError):
            updater_by_id(bad)
