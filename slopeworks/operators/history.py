"""Reports over loss histories.

Tables: ``history(run_id, iteration, loss, ...)`` and ``runs(run_id, updater, rate, ...)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slopeworks.functions.updates import UPDATER_NAMES

# The loss a first candidate is held to when it ended before the criterion
# iteration, and the updater ids shown together in each of the two report panels.
SHORT_RUN_LOSS = 1.0
PANELS = ((0, 1, 2, 3, 4, 5), (0, 6, 7, 8, 9))


def last_losses(history: DataFrame, n: int = 10) -> DataFrame:
    """The last n losses of one run, newest first."""
    return history.orderBy(F.col("iteration").desc()).limit(n)


def best_rates(history: DataFrame, runs: DataFrame, criterion_iteration: int = 20) -> DataFrame:
    """Per updater, the run with the smallest loss at the criterion iteration.

    Runs count in run_id order: the earliest wins a tie, a NaN first run is kept, a first run that
    is too short is held to a loss of 1, and later short or NaN runs are passed over.  Two partial
    minima per updater decide it, so no updater's runs are gathered in one place.
    """
    at = history.filter(F.col("iteration") == criterion_iteration).select("run_id", "loss")
    runs = runs.select("run_id", "updater", "rate").join(at, "run_id", "left")
    loss = F.col("loss")
    picked = runs.groupBy("updater").agg(
        F.min(F.struct("run_id", "rate", "loss")).alias("first"),
        F.min(F.when(loss.isNotNull() & ~F.isnan(loss), F.struct("loss", "run_id", "rate"))).alias("best"),
    )
    first, best = F.col("first"), F.col("best")
    opening = F.coalesce(first["loss"], F.lit(SHORT_RUN_LOSS))
    keep_first = F.isnan(opening) | best.isNull() | ~(best["loss"] < opening)
    chosen = lambda name: F.when(keep_first, first[name]).otherwise(best[name]).alias(name)
    return picked.select("updater", chosen("run_id"), chosen("rate"), chosen("loss"))


def loss_curves(history: DataFrame, runs: DataFrame) -> DataFrame:
    """``(updater, rate, run_id, iteration, loss)`` for plotting every rate of every updater.

    The join is spread over (run, iteration slice) pairs, so one long run does not land in one task.
    """
    return _with_runs(history, runs.select("run_id", "updater", "rate"))


_SLICES = 16


def _with_runs(history: DataFrame, runs: DataFrame) -> DataFrame:
    slices = F.explode(F.sequence(F.lit(0), F.lit(_SLICES - 1))).alias("_slice")
    spread = history.select("run_id", "iteration", "loss", F.pmod("iteration", F.lit(_SLICES)).alias("_slice"))
    return spread.join(runs.select("*", slices), ["run_id", "_slice"]).drop("_slice")


def best_curves(
    history: DataFrame,
    runs: DataFrame,
    criterion_iteration: int = 20,
    panels: Sequence[Sequence[int]] = PANELS,
) -> DataFrame:
    """Loss curve of each updater's best run, once per panel the updater (by id or name) is in."""
    best = best_rates(history, runs, criterion_iteration).select("run_id", "updater", "rate")
    if dict(best.dtypes)["updater"] == "string":
        panels = [[UPDATER_NAMES[u] for u in p] for p in panels]
    shown = F.array_compact(
        F.array(*[F.when(F.col("updater").isin(list(p)), F.lit(i + 1)) for i, p in enumerate(panels)])
    )
    return _with_runs(history, best.select("*", F.explode(shown).alias("panel")))
