"""Per-row losses of a linear margin.

A loss is a function ``(ops, margin, label) -> (multiplier, loss)``: the row's gradient is
``multiplier * x``.  The same source serves numpy batches and Column expressions.
"""

from __future__ import annotations

from collections.abc import Callable


def logistic(ops, margin, label):
    # e^-|m| never overflows and serves both the probability and the loss
    small = ops.exp(-ops.abs(margin))
    probability = ops.where(margin < 0, small, 1.0) / (1.0 + small)
    against = ops.where(label > 0, -margin, margin)
    # a NaN margin makes both results NaN through "small"
    return probability - label, ops.log1p(small) + ops.maximum(against, 0.0)


def hinge(ops, margin, label):
    sign = 2.0 * label - 1.0
    slack = 1.0 - sign * margin
    # "active" is spelled as a positive test, so a NaN margin contributes nothing
    active = sign * margin < 1.0
    return ops.where(active, -sign, 0.0), ops.where(active, slack, 0.0)


_LOSSES: dict[str, Callable] = {"logistic": logistic, "hinge": hinge}
# Margin above which class 1 is predicted, and whether a probability exists.
_LINKS: dict[str, str] = {"logistic": "sigmoid", "hinge": "margin"}


def register_loss(name: str, function: Callable, link: str = "margin") -> None:
    """Add a user loss; ``link`` is "sigmoid" when the margin is a log-odds."""
    if link not in ("sigmoid", "margin"):
        raise ValueError(f"unknown link {link!r}")
    _LOSSES[name] = function
    _LINKS[name] = link


def loss_named(name: str) -> Callable:
    if name not in _LOSSES:
        raise ValueError(f"unknown loss {name!r}; known: {', '.join(sorted(_LOSSES))}")
    return _LOSSES[name]


def link_of(name: str) -> str:
    loss_named(name)
    return _LINKS[name]
