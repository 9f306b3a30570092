"""Adaptive-gradient training of binary linear classifiers on Spark DataFrames."""

from __future__ import annotations

import sys

from pyspark import cloudpickle

# Ship our small task-side functions by value, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from slopeworks.config import SgdConfig  # noqa: E402
from slopeworks.functions.losses import register_loss  # noqa: E402
from slopeworks.functions.updates import register_updater, updater_by_id  # noqa: E402
from slopeworks.plans.estimators import (  # noqa: E402
    LinearSvm,
    LogisticRegression,
    train_logistic,
    train_svm,
)
from slopeworks.plans.fit import FitResult, fit  # noqa: E402
from slopeworks.plans.sweep import sweep, sweep_configs  # noqa: E402
from slopeworks.sources.training import dense_set, sparse_set, vector_set  # noqa: E402

__all__ = [
    "FitResult",
    "LinearSvm",
    "LogisticRegression",
    "SgdConfig",
    "dense_set",
    "fit",
    "register_loss",
    "register_updater",
    "sparse_set",
    "sweep",
    "sweep_configs",
    "train_logistic",
    "train_svm",
    "updater_by_id",
    "vector_set",
]
