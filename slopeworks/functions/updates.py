"""Weight-update rules.

A rule turns the mean batch gradient into a step vector and its next state.  It is written once
over ``ops`` and runs on numpy vectors (weights that fit the driver) and on Columns (weights kept
as a table).  State always starts at zero and belongs to one fit.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from slopeworks.config import L1, L2, SgdConfig


@dataclass(frozen=True)
class Tick:
    """Scalars of one update: the step size in force and how many updates there have been."""

    config: SgdConfig
    step: float
    count: int

    @property
    def power(self) -> int:
        """Exponent of the bias corrections."""
        return self.count + 1 if self.config.semantics == "reference" else self.count


@dataclass(frozen=True)
class Updater:
    """``move(ops, gradient, state, tick) -> (step vector, next state)``."""

    name: str
    state_size: int
    move: Callable
    looks_ahead: bool = False


def _simple(ops, g, state, tick):
    return tick.step * g, ()


def _momentum(ops, g, state, tick):
    velocity = tick.config.momentum_fraction * state[0] + tick.step * g
    return velocity, (velocity,)


def _adagrad(ops, g, state, tick):
    total = state[0] + g * g
    return ops.ratio(tick.step * g, ops.sqrt(total + tick.config.smoothing_term)), (total,)


def _adadelta(ops, g, state, tick):
    rho, eps = tick.config.momentum_fraction, tick.config.smoothing_term
    seen = rho * state[0] + (1.0 - rho) * g * g
    move = ops.ratio(ops.sqrt(state[1] + eps), ops.sqrt(seen + eps)) * g
    return move, (seen, rho * state[1] + (1.0 - rho) * move * move)


def _rmsprop(ops, g, state, tick):
    # This rule always averages with 0.9 and 0.1.
    seen = 0.9 * state[0] + 0.1 * g * g
    return ops.ratio(tick.step * g, ops.sqrt(seen + tick.config.smoothing_term)), (seen,)


def _moments(g, state, tick):
    b1, b2 = tick.config.beta, tick.config.beta_s
    return b1 * state[0] + (1.0 - b1) * g, b2 * state[1] + (1.0 - b2) * g * g


def _corrected(value, decay: float, power: int):
    """Moving average freed from its zero start."""
    return value * _inverse(1.0 - decay**power)


def _inverse(x: float) -> float:
    return 1.0 / x if x else float("inf")


def _adam(ops, g, state, tick):
    first, second = _moments(g, state, tick)
    spread = ops.sqrt(_corrected(second, tick.config.beta_s, tick.power)) + tick.config.smoothing_term
    return ops.ratio(tick.step * _corrected(first, tick.config.beta, tick.power), spread), (first, second)


def _adamax(ops, g, state, tick):
    first = tick.config.beta * state[0] + (1.0 - tick.config.beta) * g
    peak = ops.maximum(tick.config.beta_s * state[1], ops.abs(g))
    move = ops.ratio(tick.step * _corrected(first, tick.config.beta, tick.power), peak)
    if tick.config.semantics == "standard":
        move = ops.where(peak == 0.0, 0.0, move)
    return move, (first, peak)


def _nadam(ops, g, state, tick):
    b1 = tick.config.beta
    first, second = _moments(g, state, tick)
    spread = ops.sqrt(_corrected(second, tick.config.beta_s, tick.power)) + tick.config.smoothing_term
    ahead = b1 * _corrected(first, b1, tick.power + 1) + (1.0 - b1) * _corrected(g, b1, tick.power)
    return ops.ratio(tick.step * ahead, spread), (first, second)


def _amsgrad(ops, g, state, tick):
    first, second = _moments(g, state, tick)
    peak = ops.maximum(state[2], second)
    under = peak if tick.config.semantics == "standard" else second
    move = ops.ratio(tick.step * first, ops.sqrt(under) + tick.config.smoothing_term)
    return move, (first, second, peak)


# The numeric ids 0 to 9 of the built-in updaters are their positions here.
_BUILT_IN = (
    Updater("simple", 0, _simple),
    Updater("momentum", 1, _momentum),
    Updater("nesterov", 1, _momentum, looks_ahead=True),
    Updater("adagrad", 1, _adagrad),
    Updater("adadelta", 2, _adadelta),
    Updater("rmsprop", 1, _rmsprop),
    Updater("adam", 2, _adam),
    Updater("adamax", 2, _adamax),
    Updater("nadam", 2, _nadam),
    Updater("amsgrad", 3, _amsgrad),
)
UPDATER_NAMES = tuple(u.name for u in _BUILT_IN)
_UPDATERS = {u.name: u for u in _BUILT_IN}


def register_updater(name: str, move: Callable, state_size: int, looks_ahead: bool = False) -> None:
    """Add a user rule with the given number of per-weight state values."""
    _UPDATERS[name] = Updater(name, state_size, move, looks_ahead)


def updater_named(name: str) -> Updater:
    if name not in _UPDATERS:
        raise ValueError(f"unknown updater {name!r}; known: {', '.join(_UPDATERS)}")
    return _UPDATERS[name]


def updater_by_id(number: int) -> Updater:
    if not 0 <= number < len(_BUILT_IN):
        raise ValueError(f"updater id must lie in 0..{len(_BUILT_IN) - 1}, got {number}")
    return _BUILT_IN[number]


def regularized(ops, weights, move, config: SgdConfig, step: float):
    """New weights: take the step, then shrink (L1) or scale beforehand (L2).

    The shrinkage uses the scalar step size whatever the updater does per weight.
    """
    if config.reg_type == L2:
        return weights * (1.0 - step * config.reg_param) - move
    moved = weights - move
    if config.reg_type == L1:
        kept = ops.maximum(ops.abs(moved) - config.reg_param * step, 0.0)
        return ops.sign(moved) * kept
    return moved


def penalty(config: SgdConfig, l1_norm: float, squared_l2_norm: float) -> float:
    """Regularization value that is added to the mean loss."""
    if config.reg_type == L1:
        return config.reg_param * l1_norm
    if config.reg_type == L2:
        return 0.5 * config.reg_param * squared_l2_norm
    return 0.0

