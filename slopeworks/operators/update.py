"""One update of weights that are kept as a table: ``(config_id, idx, w, s0, s1, ...)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slopeworks.config import L1, L2, SgdConfig
from slopeworks.functions.ops import ColumnOps
from slopeworks.functions.updates import Tick, regularized, updater_named


def state_columns(config: SgdConfig, key: str = "") -> list[str]:
    return [f"s{key}{i}" for i in range(updater_named(config.updater).state_size)]


def fresh_params(weights: DataFrame, config: SgdConfig) -> DataFrame:
    """Weights ``(idx, w)`` with the updater's zero state."""
    return weights.select("*", *[F.lit(0.0).alias(s) for s in state_columns(config)])


def updated(
    params: DataFrame, gradient: Column, config: SgdConfig, iteration: int, count: int, key: str = ""
) -> DataFrame:
    """Next weights and state, given the mean gradient of each row's weight.

    Adds ``ahead``, the point at which the next gradient is to be taken.  A table with the weights of several
    configurations names the columns of each by its ``key``: ``w{key}``, ``s{key}0``, ``ahead{key}``.
    """
    rule = updater_named(config.updater)
    step = config.step_at(iteration)
    names, own, look = state_columns(config, key), f"w{key}", f"ahead{key}"
    state = tuple(F.col(s) for s in names)
    move, after = rule.move(ColumnOps, gradient, state, Tick(config, step, count))
    kept = [c for c in params.columns if c not in (own, look, *names)]
    # The step is named first, so the new weight does not expand its expression twice.
    moved = params.select(
        *kept, own, move.alias("_move"), *[value.alias(name) for value, name in zip(after, names)]
    )
    weight = regularized(ColumnOps, F.col(own), F.col("_move"), config, step)
    stepped = moved.select(*kept, weight.alias(own), *names)
    ahead = F.col(own) - config.momentum_fraction * F.col(names[0]) if rule.looks_ahead else F.col(own)
    return stepped.select("*", ahead.alias(look))


def weight_norms(params: DataFrame, *by: str) -> DataFrame:
    """L1 norm and squared L2 norm of the weights, per group."""
    return params.groupBy(*by).agg(
        F.sum(F.abs("w")).alias("l1_norm"), F.sum(F.col("w") * F.col("w")).alias("squared_l2_norm")
    )


def penalties(params: DataFrame, config: SgdConfig, *by: str) -> DataFrame:
    """Regularization value of the weights, per group."""
    value = F.lit(0.0)
    if config.reg_type == L1:
        value = F.lit(config.reg_param) * F.col("l1_norm")
    elif config.reg_type == L2:
        value = F.lit(0.5 * config.reg_param) * F.col("squared_l2_norm")
    return weight_norms(params, *by).select(*by, value.alias("penalty"))
