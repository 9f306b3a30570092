"""Fits that are taken up again from a snapshot."""

from __future__ import annotations

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from slopeworks import SgdConfig, fit
from slopeworks.functions.updates import UPDATER_NAMES
from slopeworks.plans.snapshots import Snapshots


def rows(spark):
    return spark.range(300).select(
        (F.col("id") % 3 == 0).cast("double").alias("label"),
        F.array((F.col("id") % 7).cast("double"), (F.col("id") % 5 - 2).cast("double")).alias("features"),
        F.col("id").cast("string").alias("row_key"),
    )


def same_fit(a, b):
    """Up to the order in which partial sums are added."""
    np.testing.assert_allclose([*a.model.weights, a.model.intercept], [*b.model.weights, b.model.intercept], rtol=1e-11, atol=1e-14)
    assert [(s.iteration, s.batch_n) for s in a.steps] == [(s.iteration, s.batch_n) for s in b.steps]
    np.testing.assert_allclose(a.losses, b.losses, rtol=1e-11)
    assert a.stop_reason == b.stop_reason


def test_every_rule_goes_on_as_if_unbroken(spark, tmp_path):
    configs = [SgdConfig(updater=u, num_iterations=7, convergence_tol=0.0, step_size=0.1, intercept=True, validation_split=0.2,
                         mini_batch_fraction=0.5, semantics="standard") for u in UPDATER_NAMES]
    whole = fit(rows(spark), configs, num_features=2)
    kept = Snapshots(str(tmp_path / "state"), every=2)
    calls = []

    def dies(place, step):
        calls.append(step.iteration)
        if step.iteration == 6:
            raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        fit(rows(spark), configs, num_features=2, snapshots=kept, on_step=dies)
    assert [n for n in os.listdir(tmp_path / "state" / "0") if n.isdigit()] == ["4"]
    again = []
    taken_up = fit(rows(spark), configs, num_features=2, snapshots=kept, on_step=lambda k, s: again.append(s.iteration))
    assert min(again) == 5 and max(calls) == 6
    for a, b in zip(whole, taken_up):
        same_fit(a, b)


def test_more_iterations_and_other_settings(spark, tmp_path):
    kept = Snapshots(str(tmp_path / "state"), every=5)
    config = SgdConfig(updater="adam", num_iterations=3, convergence_tol=0.0)
    fit(rows(spark), config, num_features=2, snapshots=kept)
    longer = fit(rows(spark), config.with_(num_iterations=6), num_features=2, snapshots=kept)[0]
    whole = fit(rows(spark), config.with_(num_iterations=6), num_features=2)[0]
    same_fit(longer, whole)
    with pytest.raises(ValueError, match="other settings"):
        fit(rows(spark), config.with_(step_size=0.5), num_features=2, snapshots=kept)
    with pytest.raises(ValueError, match="broadcast bound"):
        fit(rows(spark), config, num_features=2, layout="join", snapshots=kept)
    with pytest.raises(ValueError, match="every"):
        Snapshots("x", every=0)
