"""Estimators and one-call training functions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from slopeworks.config import SgdConfig
from slopeworks.plans.fit import FitResult, fit


@dataclass
class LogisticRegression:
    """Logistic regression; ``run`` returns the model together with its loss history."""

    config: SgdConfig = field(default_factory=SgdConfig)

    def run(
        self, df: DataFrame, initial_weights: Sequence[float] | None = None, num_features: int | None = None
    ) -> FitResult:
        return fit(df, self.config.with_(loss="logistic"), num_features, initial_weights)[0]


@dataclass
class LinearSvm:
    """Linear support vector machine.

    The default ``reg_param`` of 0.01 takes effect once ``reg_type`` is 1 or 2.
    """

    config: SgdConfig = field(default_factory=lambda: SgdConfig(loss="hinge", reg_param=0.01))

    def run(
        self, df: DataFrame, initial_weights: Sequence[float] | None = None, num_features: int | None = None
    ) -> FitResult:
        return fit(df, self.config.with_(loss="hinge"), num_features, initial_weights)[0]


def train_logistic(
    df: DataFrame, num_iterations: int = 100, *, initial_weights: Sequence[float] | None = None, **settings
) -> FitResult:
    """Train logistic regression; ``settings`` are fields of ``SgdConfig``."""
    return LogisticRegression(SgdConfig(num_iterations=num_iterations, **settings)).run(df, initial_weights)


def train_svm(
    df: DataFrame, num_iterations: int = 100, *, initial_weights: Sequence[float] | None = None, **settings
) -> FitResult:
    """Train a linear SVM; ``settings`` are fields of ``SgdConfig``."""
    return LinearSvm(SgdConfig(loss="hinge", num_iterations=num_iterations, **settings)).run(df, initial_weights)
