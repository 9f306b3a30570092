"""Users' rules and losses are run on numpy and on Columns before they are accepted."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from slopeworks.functions import losses, updates
from slopeworks.functions.ops import NumpyOps
from slopeworks.plans.plugins import checked_loss, checked_updater


def test_built_in_rules_and_losses_pass(spark):
    for name in updates.UPDATER_NAMES:
        rule = updates.updater_named(name)
        checked_updater(spark, f"again_{name}", rule.move, rule.state_size, rule.looks_ahead)
        assert updates.updater_named(f"again_{name}").state_size == rule.state_size
    checked_loss(spark, "again_hinge", losses.hinge)
    assert losses.link_of("again_hinge") == "margin"


@pytest.mark.parametrize(
    ("move", "size", "what"),
    [
        (lambda ops, g, s, t: (t.step * (np.abs(g) if ops is NumpyOps else g), ()), 0, "m1"),
        (lambda ops, g, s, t: (t.step * g, (s[0] + 1.0 if ops is NumpyOps else s[0] + 2.0,)), 1, "s0"),
        (lambda ops, g, s, t: (t.step * g, ()), 1, "states"),
        (lambda ops, g, s, t: (t.step * g + (s[0] if ops is NumpyOps else F.lit(0.0)), (g + 0.0,)), 1, "m2"),
    ],
)
def test_rules_that_differ_are_refused(spark, move, size, what):
    with pytest.raises(ValueError, match=what):
        checked_updater(spark, "refused", move, size)
    with pytest.raises(ValueError, match="unknown"):
        updates.updater_named("refused")


def test_losses_that_differ_are_refused(spark):
    with pytest.raises(ValueError, match="slope"):
        checked_loss(spark, "refused", lambda ops, m, y: (m - y, (m - y) * (m - y)))
    with pytest.raises(ValueError, match="numpy"):
        checked_loss(spark, "refused", lambda ops, m, y: (m - y, (m - y) * (m - y) / (2.0 if ops is NumpyOps else 3.0)))
    with pytest.raises(ValueError, match="unknown"):
        losses.loss_named("refused")
    with pytest.raises(ValueError, match="velocity"):
        checked_updater(spark, "refused", lambda ops, g, s, t: (g, ()), 0, looks_ahead=True)
