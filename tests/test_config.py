from __future__ import annotations

import pytest

from slopeworks import LinearSvm, LogisticRegression, SgdConfig


def test_defaults():
    c = SgdConfig()
    assert (c.step_size, c.num_iterations, c.reg_param, c.mini_batch_fraction) == (1.0, 100, 0.0, 1.0)
    assert (c.updater, c.convergence_tol, c.smoothing_term) == ("adagrad", 0.001, 1e-8)
    assert (c.beta, c.beta_s, c.momentum_fraction, c.iter_validation) == (0.9, 0.999, 0.9, 50)
    assert LogisticRegression().config.loss == "logistic"
    svm = LinearSvm().config
    assert (svm.loss, svm.reg_param, svm.reg_type) == ("hinge", 0.01, 0)


@pytest.mark.parametrize(
    "field,bad",
    [
        ("step_size", 0.0), ("step_size", -1.0), ("num_iterations", -1), ("reg_param", -0.1), ("reg_type", 3),
        ("mini_batch_fraction", 0.0), ("mini_batch_fraction", 1.1), ("convergence_tol", -0.1),
        ("convergence_tol", 1.1), ("beta", 0.0), ("beta", 1.5), ("beta_s", 0.0), ("momentum_fraction", 0.0),
        ("validation_split", 0.6), ("validation_split", -0.1), ("iter_validation", 0), ("updater", "none"),
        ("loss", "none"), ("semantics", "none"),
    ],
)
def test_bad_values_are_refused(field, bad):
    with pytest.raises(ValueError):
        SgdConfig(**{field: bad})
    with pytest.raises(ValueError):
        SgdConfig().with_(**{field: bad})


def test_warnings():
    with pytest.warns(UserWarning, match="tolerance"):
        SgdConfig(mini_batch_fraction=0.5).warn_unusual()
    with pytest.warns(UserWarning, match="not every row"):
        SgdConfig(mini_batch_fraction=0.5, num_iterations=1, convergence_tol=0.0).warn_unusual()
    with pytest.warns(UserWarning, match="no effect"):
        SgdConfig(reg_param=0.1).warn_unusual()
