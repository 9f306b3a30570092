"""Hyper-parameters of one training run."""

from __future__ import annotations

import warnings
from dataclasses import dataclass, replace

# Seeds of the train/validation split and of the mini-batch drawn at iteration i.
SPLIT_SEED = 41
BATCH_SEED_BASE = 42

NO_REG, L1, L2 = 0, 1, 2


@dataclass(frozen=True)
class SgdConfig:
    """One set of hyper-parameters; every field is checked when the object is made.

    ``semantics`` picks between two readings of four updaters.  ``"reference"`` (the default)
    reproduces the established trajectories: Adam, AdaMax and Nadam start their bias correction at
    the second power, AMSGrad divides by the plain second moment, and AdaMax yields NaN for a
    weight that never saw a gradient.  ``"standard"`` follows the published papers.
    """

    # The established defaults.
    loss: str = "logistic"
    updater: str = "adagrad"
    step_size: float = 1.0
    num_iterations: int = 100
    reg_param: float = 0.0
    reg_type: int = NO_REG
    mini_batch_fraction: float = 1.0
    convergence_tol: float = 0.001
    smoothing_term: float = 1e-8
    beta: float = 0.9
    beta_s: float = 0.999
    momentum_fraction: float = 0.9
    decay: bool = False
    validation_split: float = 0.0
    iter_validation: int = 50
    intercept: bool = False
    initial_intercept: float = 1.0
    scale: bool = False
    validate: bool = True
    semantics: str = "reference"

    def __post_init__(self) -> None:
        from slopeworks.functions.losses import loss_named
        from slopeworks.functions.updates import updater_named

        loss_named(self.loss)
        updater_named(self.updater)
        checks = [
            ("step_size", self.step_size > 0, "must be > 0"),
            ("num_iterations", self.num_iterations >= 0, "must be >= 0"),
            ("reg_param", self.reg_param >= 0, "must be >= 0"),
            ("reg_type", self.reg_type in (NO_REG, L1, L2), "must be 0, 1 or 2"),
            ("mini_batch_fraction", 0 < self.mini_batch_fraction <= 1, "must lie in (0, 1]"),
            ("convergence_tol", 0 <= self.convergence_tol <= 1, "must lie in [0, 1]"),
            ("beta", 0 < self.beta <= 1, "must lie in (0, 1]"),
            ("beta_s", 0 < self.beta_s <= 1, "must lie in (0, 1]"),
            ("momentum_fraction", 0 < self.momentum_fraction <= 1, "must lie in (0, 1]"),
            ("validation_split", 0 <= self.validation_split <= 0.5, "must lie in [0, 0.5]"),
            ("iter_validation", self.iter_validation >= 1, "must be >= 1"),
            ("semantics", self.semantics in ("reference", "standard"), "must be 'reference' or 'standard'"),
        ]
        for name, ok, rule in checks:
            if not ok:
                raise ValueError(f"{name} {rule}, got {getattr(self, name)!r}")

    def with_(self, **changes) -> "SgdConfig":
        """A copy with some fields changed; the new values are checked."""
        return replace(self, **changes)

    def step_at(self, iteration: int) -> float:
        """Step size in force at a 1-based iteration."""
        return self.step_size / iteration**0.5 if self.decay else self.step_size

    def warn_unusual(self) -> None:
        if self.mini_batch_fraction < 1.0 and self.convergence_tol > 0.0:
            warnings.warn(
                "a convergence tolerance is unstable with mini-batches: the sampled gradient is noisy",
                stacklevel=3,
            )
        if self.num_iterations * self.mini_batch_fraction < 1.0:
            warnings.warn(
                f"not every row will be used: {self.num_iterations} iterations of "
                f"fraction {self.mini_batch_fraction}",
                stacklevel=3,
            )
        if self.reg_param > 0 and self.reg_type == NO_REG:
            warnings.warn("reg_param has no effect while reg_type is 0", stacklevel=3)
