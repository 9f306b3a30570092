"""Training: many configurations advance in lock-step, one Spark job per iteration.

The mini-batch of an iteration depends only on the iteration, so every configuration that shares
the data-level settings sees the same rows and one pass serves them all.
"""

from __future__ import annotations

import time
import warnings
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slopeworks.config import SgdConfig
from slopeworks.functions.ops import NumpyOps
from slopeworks.functions.updates import Tick, penalty, regularized, updater_named
from slopeworks.operators.control import has_converged, must_stop, norm
from slopeworks.operators.evaluate import accuracy_of
from slopeworks.operators.features import (
    MAX_DRIVER_VALUES,
    checked_shape,
    collect_vector,
    column_stddev,
    first_width,
    inverse_sd,
    is_sparse,
)
from slopeworks.operators.gradient import (
    Rows,
    Sums,
    held_out,
    keyed_once,
    looks_small,
    minibatch_sums,
    prepare,
    spread_small,
)
from slopeworks.operators.joined import identified
from slopeworks.plans import snapshots as kept_state
from slopeworks.plans.model import LinearModel
from slopeworks.plans.snapshots import Snapshots


@dataclass(frozen=True)
class Step:
    """One recorded iteration."""

    iteration: int
    train_loss: float | None
    val_loss: float | None
    batch_n: int


@dataclass
class FitResult:
    """What a fit returns: the model, one ``Step`` per iteration and why it ended."""

    config: SgdConfig
    model: LinearModel
    steps: list[Step]
    stop_reason: str
    elapsed_ms: int
    train_accuracy: float | None = None

    @property
    def losses(self) -> list[float]:
        """Training loss per iteration whose batch had rows."""
        return [s.train_loss for s in self.steps if s.train_loss is not None]

    def history(self, spark: SparkSession) -> DataFrame:
        return history_table(spark, [self])


def history_table(spark: SparkSession, results: Sequence[FitResult]) -> DataFrame:
    """``(config_id, updater, rate, iteration, train_loss, val_loss, batch_n)`` of finished fits."""
    flat = [(i, r.config, s) for i, r in enumerate(results) for s in r.steps]
    return spark.createDataFrame(
        pa.table(
            {
                "config_id": pa.array([i for i, _, _ in flat], pa.int32()),
                "updater": pa.array([c.updater for _, c, _ in flat], pa.string()),
                "rate": pa.array([c.step_size for _, c, _ in flat], pa.float64()),
                "iteration": pa.array([s.iteration for _, _, s in flat], pa.int32()),
                "train_loss": pa.array([s.train_loss for _, _, s in flat], pa.float64()),
                "val_loss": pa.array([s.val_loss for _, _, s in flat], pa.float64()),
                "batch_n": pa.array([s.batch_n for _, _, s in flat], pa.int64()),
            }
        )
    )


@dataclass(eq=False)
class _Run:
    """Moving parts of one configuration. The bias, when there is one, is the last weight."""

    config: SgdConfig
    weights: np.ndarray
    state: tuple[np.ndarray, ...]
    penalty: float
    look_ahead: np.ndarray | None = None
    updates: int = 0
    val_losses: list[float] = field(default_factory=list)
    steps: list[Step] = field(default_factory=list)
    stop_reason: str | None = None

    @classmethod
    def start(cls, config: SgdConfig, weights: np.ndarray) -> "_Run":
        rule = updater_named(config.updater)
        opening = penalty(config, float(np.abs(weights).sum()), float(weights @ weights))
        state = tuple(np.zeros_like(weights) for _ in range(rule.state_size))
        run = cls(config, weights, state, opening)
        if config.num_iterations == 0:
            run.stop_reason = "max_iterations"
        return run

    @property
    def position(self) -> np.ndarray:
        """Where the next gradient is taken."""
        return self.weights if self.look_ahead is None else self.look_ahead

    def record(self, iteration: int, loss: float, n: int, held_loss: float, n_held: int) -> bool:
        """Note an iteration's losses; whether the weights are to be moved."""
        config = self.config
        val_loss = None
        if config.validation_split > 0:
            val_loss = (held_loss / n_held if n_held else float("nan")) + self.penalty
            self.val_losses.append(val_loss)
        if n == 0:
            warnings.warn(f"iteration {iteration} of {config.num_iterations}: the sampled batch is empty")
            self.steps.append(Step(iteration, None, val_loss, 0))
            return False
        self.steps.append(Step(iteration, loss / n + self.penalty, val_loss, n))
        if config.validation_split > 0 and iteration > config.iter_validation:
            if must_stop(iteration, config.iter_validation, self.val_losses[-1], self.val_losses[-2]):
                self.stop_reason = "early_stop"
                return False
        return True

    def move_weights(self, gradient: np.ndarray, tick: Tick) -> None:
        """One update of the weights held here."""
        config, rule = self.config, updater_named(self.config.updater)
        with np.errstate(all="ignore"):
            move, self.state = rule.move(NumpyOps, gradient, self.state, tick)
            self.weights = regularized(NumpyOps, self.weights, move, config, tick.step)
            if rule.looks_ahead:
                self.look_ahead = self.weights - config.momentum_fraction * self.state[0]

    def advance(self, iteration: int, gradient: np.ndarray, loss: float, n: int, held_loss: float, n_held: int):
        """One iteration on totals of a pass: record, move, decide whether to go on."""
        config = self.config
        if self.record(iteration, loss, n, held_loss, n_held):
            self.updates += 1
            before = self.weights
            self.move_weights(gradient / n, Tick(config, config.step_at(iteration), self.updates))
            after = self.weights
            with np.errstate(all="ignore"):
                self.penalty = penalty(config, float(np.abs(after).sum()), float(after @ after))
                # The first comparison is between the results of the first two updates.
                if self.updates > 1 and has_converged(norm(after - before), norm(after), config.convergence_tol):
                    self.stop_reason = "converged"
        if self.stop_reason is None and iteration >= config.num_iterations:
            self.stop_reason = "max_iterations"


def fit(
    df: DataFrame,
    configs: SgdConfig | Sequence[SgdConfig],
    num_features: int | None = None,
    initial_weights: Sequence[float] | DataFrame | None = None,
    storage: StorageLevel | None = StorageLevel.MEMORY_AND_DISK,
    layout: str = "auto",
    score: bool = False,
    on_step: Callable[[int, Step], None] | None = None,
    snapshots: Snapshots | None = None,
) -> list[FitResult]:
    """Train every configuration on a canonical training table; results keep the given order.

    Weights start at zero unless ``initial_weights`` (without intercept) is given, as a vector or as
    a table ``(idx, w)``.  The table is read once: its prepared form is persisted for the duration of the
    fit (or settled in the shared folder, where weights are too many to broadcast), and count, checks, width
    and deviations are taken from that.  Batches and the validation split are drawn by ``row_key`` in every
    layout; a table without one that is to be drawn from is numbered and settled first.

    ``score`` adds the accuracy on the whole table, taken while it is still persisted.  ``layout`` is
    "auto", "columns", "arrow" or "join"; "auto" moves on to "join" when the weights of one configuration
    exceed the broadcast bound, and takes configurations in groups whose weights together stay within it.

    ``on_step`` is called as each iteration ends, with the place of the configuration and its ``Step``, so that
    the losses of a fit that dies are not lost.

    ``snapshots`` keeps the state of the fit every few iterations, and takes up the fit whose state lies there: same
    rows and settings, the number of iterations excepted.  Only for weights within the broadcast bound.
    """
    began = time.perf_counter()
    configs = [configs] if isinstance(configs, SgdConfig) else list(configs)
    for config in configs:
        config.warn_unusual()
    groups: dict[tuple, list[int]] = {}
    for i, c in enumerate(configs):
        shared = (c.mini_batch_fraction, c.validation_split, c.intercept, c.scale)
        groups.setdefault(shared, []).append(i)

    sparse = is_sparse(df)
    given = initial_weights is not None and not isinstance(initial_weights, DataFrame)
    validate = any(c.validate for c in configs)
    sampled = any(c.mini_batch_fraction < 1.0 or c.validation_split > 0 for c in configs)
    if sampled:
        df = keyed_once(df)
    if not validate:
        df = df.filter(F.col("label").isNotNull())
    if num_features is None and not sparse:
        num_features = first_width(df) or None
    if given:
        num_features = num_features or len(initial_weights)
        if len(initial_weights) != num_features:
            raise ValueError(f"{len(initial_weights)} initial weights for {num_features} features")

    def too_wide(width: int | None) -> bool:
        return layout == "join" or (layout == "auto" and (width or 0) + 1 > MAX_DRIVER_VALUES)

    cores = df.sparkSession.sparkContext.defaultParallelism
    spread_first = not too_wide(num_features) and looks_small(df)
    base = prepare(df.repartition(cores) if spread_first else df, num_features or 0, sampled=sampled)
    kept: list[DataFrame] = []

    def keep(table: DataFrame) -> DataFrame:
        if storage is not None:
            kept.append(table.persist(storage))
        return table

    results: list[FitResult | None] = [None] * len(configs)
    try:
        wide = too_wide(num_features)
        base = replace(base, df=identified(base.df) if wide else keep(base.df))
        shape = checked_shape(base.df, sparse, num_features, validate)
        base = replace(base, width=shape.width, n_rows=shape.n_rows)
        if wide or too_wide(shape.width):
            rows = base.df if wide else identified(base.df)
            start = weight_table(df.sparkSession, initial_weights) if given else initial_weights
            from slopeworks.plans.wide import fit_wide

            if snapshots:
                raise ValueError("snapshots are kept for weights within the broadcast bound")
            fit_groups = lambda chosen, told, _: fit_wide(rows, chosen, shape, start, storage, told)
            scored, most = replace(base, df=rows), len(configs)
        else:
            if spread_first:
                scored = replace(base, tasks=cores)
            else:
                spread, tasks = spread_small(base.df, shape.n_rows, shape.width, sparse)
                scored = replace(base, df=keep(spread) if tasks else spread, tasks=tasks)
            opening = _start(initial_weights, shape.width)
            factors = None
            if any(c.scale for c in configs) and shape.n_rows:
                deviations = column_stddev(base.df, shape.width, shape.n_rows)
                factors = inverse_sd(collect_vector(deviations, "sd", shape.width))
            fit_groups = lambda chosen, told, kept: _fit_group(scored, chosen, opening, factors, layout, told, kept)
            most = max(1, MAX_DRIVER_VALUES // (shape.width + 1))
        for members in groups.values():
            for first in range(0, len(members), most):
                places = members[first : first + most]
                told = (lambda k, step, places=places: on_step(places[k], step)) if on_step else None
                state = snapshots.of_group(places[0]) if snapshots else None
                for i, result in zip(places, fit_groups([configs[i] for i in places], told, state)):
                    results[i] = replace(result, elapsed_ms=round((time.perf_counter() - began) * 1000))
        if score and shape.n_rows:
            for result, value in zip(results, accuracies(scored, [r.model for r in results])):
                result.train_accuracy = value
    finally:
        for table in kept:
            table.unpersist()
    return results


def accuracies(rows: Rows, models: Sequence) -> list[float | None]:
    """Accuracy of models on a prepared table: those with bounded weights in as few passes as the
    broadcast bound allows, those with weight tables in one join."""
    found: list[float | None] = [None] * len(models)
    bounded = [i for i, m in enumerate(models) if isinstance(m, LinearModel)]
    most = max(1, MAX_DRIVER_VALUES // max(1, max((models[i].num_features for i in bounded), default=1)))
    for first in range(0, len(bounded), most):
        places = bounded[first : first + most]
        for row in accuracy_of(rows, [models[i] for i in places]).collect():
            found[places[row["config_id"]]] = row["accuracy"]
    tables = [i for i in range(len(models)) if i not in bounded]
    if tables:
        from slopeworks.plans.wide import table_accuracies

        for i, value in zip(tables, table_accuracies(rows.df, [models[i] for i in tables])):
            found[i] = value
    return found


def _start(initial_weights: Sequence[float] | DataFrame | None, width: int) -> np.ndarray:
    if initial_weights is None:
        return np.zeros(width)
    if isinstance(initial_weights, DataFrame):
        return collect_vector(initial_weights, "w", width)
    return np.asarray(initial_weights, dtype=float)


def weight_table(spark: SparkSession, weights: Sequence[float]) -> DataFrame:
    """``(idx, w)`` of a weight vector."""
    values = np.asarray(weights, dtype=float)
    return spark.createDataFrame(
        pa.table({"idx": pa.array(np.arange(len(values)), pa.int32()), "w": pa.array(values, pa.float64())})
    )


def _fit_group(rows: Rows, configs, start: np.ndarray, factors, layout: str, told, state: Snapshots | None) -> list[FitResult]:
    lead, width, n_rows = configs[0], len(start), rows.n_rows
    split = lead.validation_split
    if split > 0:
        rows = replace(rows, df=rows.df.withColumn("held_out", held_out(split)), split=split)
    runs = [_Run.start(c, np.append(start, c.initial_intercept) if c.intercept else start.copy()) for c in configs]
    if n_rows == 0:
        warnings.warn("no rows to train on: the initial weights are returned")
        for run in runs:
            run.stop_reason = "no_data"
    elif n_rows * lead.mini_batch_fraction < 1:
        warnings.warn("the mini-batch fraction is too small for the number of rows")

    factors = np.ones(width) if factors is None or not lead.scale else factors
    spark = rows.df.sparkSession
    iteration = (kept_state.restore(spark, state, runs) if state else 0) + 1
    while active := [run for run in runs if run.stop_reason is None]:
        sums = _one_pass(rows, active, iteration, width, factors, layout)
        for k, run in enumerate(active):
            gradient = sums.gradient[k] * factors
            if lead.intercept:
                gradient = np.append(gradient, sums.bias[k])
            run.advance(
                iteration, gradient, float(sums.loss[k]), sums.n, float(sums.held_out_loss[k]), sums.n_held_out
            )
            if told:
                told(runs.index(run), run.steps[-1])
        if state and (iteration % state.every == 0 or all(run.stop_reason for run in runs)):
            kept_state.save(spark, state, runs, iteration)
        iteration += 1

    results = []
    for run in runs:
        weights, bias = (run.weights[:-1], run.weights[-1]) if lead.intercept else (run.weights, 0.0)
        model = LinearModel(weights * factors if lead.scale else weights, float(bias), run.config.loss)
        results.append(FitResult(run.config, model, run.steps, run.stop_reason, 0))
    return results


def _one_pass(rows: Rows, active: list[_Run], iteration: int, width: int, factors, layout: str) -> Sums:
    """Scaling is applied to the weights and the gradient, never to the rows."""
    config = active[0].config
    points = np.array([run.position for run in active])
    bias = points[:, width] if config.intercept else np.zeros(len(active))
    weights, losses = points[:, :width] * factors, [r.config.loss for r in active]
    return minibatch_sums(rows, iteration, config.mini_batch_fraction, weights, bias, losses, layout)
