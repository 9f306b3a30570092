"""When to stop: convergence and early stopping, for one fit and for tables of many."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def has_converged(change_norm: float, weight_norm: float, tolerance: float) -> bool:
    """IEEE compare: a tolerance of 0 and NaN norms never converge."""
    return change_norm < tolerance * float(np.maximum(weight_norm, 1.0))


def must_stop(iteration: int, warm_up: int, current: float, previous: float) -> bool:
    """After the warm-up, stop unless the validation loss fell; ties and NaN stop."""
    return iteration > warm_up and not current < previous


def norm(vector: np.ndarray) -> float:
    return math.sqrt(float(vector @ vector))


def _falls(current, previous):
    """current < previous with IEEE treatment of NaN (Spark orders NaN above every number)."""
    return F.coalesce((current < previous) & ~F.isnan(current) & ~F.isnan(previous), F.lit(False))


def early_stops(history: DataFrame, warm_up: int) -> DataFrame:
    """First stopping iteration per ``config_id`` of a ``(config_id, iteration, val_loss)`` table.

    Each iteration meets its predecessor through an equi-join on (config_id, iteration), whose keys
    are unique, so a configuration with most of the rows still spreads over all tasks.
    """
    now = history.select("config_id", "iteration", F.col("val_loss").alias("now"))
    before = history.select(
        "config_id", (F.col("iteration") + 1).alias("iteration"), F.col("val_loss").alias("before")
    )
    stops = now.filter(F.col("iteration") > warm_up).join(before, ["config_id", "iteration"])
    return (
        stops.filter(~_falls(F.col("now"), F.col("before")))
        .groupBy("config_id")
        .agg(F.min("iteration").alias("stop_iteration"))
    )


def convergence_norms(weights: DataFrame, tolerance: float) -> DataFrame:
    """Change and size of the weights per step of a ``(config_id, iteration, idx, w)`` table.

    The first iteration has no predecessor and is not tested.  Keys of the join are unique and the
    norms are partial sums.
    """
    now = weights.select("config_id", "iteration", "idx", "w")
    before = weights.select(
        "config_id", (F.col("iteration") + 1).alias("iteration"), "idx", F.col("w").alias("w_before")
    )
    change = F.col("w_before") - F.col("w")
    norms = (
        now.join(before, ["config_id", "iteration", "idx"])
        .groupBy("config_id", "iteration")
        .agg(
            F.sqrt(F.sum(change * change)).alias("change_norm"),
            F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("weight_norm"),
        )
    )
    limit = F.lit(float(tolerance)) * F.greatest(F.col("weight_norm"), F.lit(1.0))
    return norms.withColumn("converged", _falls(F.col("change_norm"), limit))
