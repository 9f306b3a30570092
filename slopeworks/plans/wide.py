"""Training with weights that stay a table: for more weights than may be broadcast.

Per iteration two tables are settled in the shared folder: the gradient (margins part by part of a
grid, sums per index) and the next weights (an equi-join of weights and gradient).  The driver
sees totals only.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slopeworks.config import SgdConfig
from slopeworks.functions.sampling import WORD, key_word
from slopeworks.functions.updates import Tick, penalty
from slopeworks.operators.control import has_converged
from slopeworks.operators.features import MAX_DRIVER_VALUES, collect_vector, column_stddev, is_sparse
from slopeworks.operators.gradient import Rows, held_out
from slopeworks.operators.joined import (
    BIAS,
    HELD_LOSS,
    TRAIN_LOSS,
    entries_of,
    grid_of,
    identified,
    sparse_form,
    spread_by_id,
    spread_by_part,
    table_gradient,
    table_margins,
)
from slopeworks.operators.update import state_columns, updated, weight_norms
from slopeworks.plans.fit import FitResult, _Run
from slopeworks.plans.model import LinearModel, cut_of, predicted, prediction_of, with_prediction
from slopeworks.shared import removed, settled, written

# Configurations that share the columns of one weight table.
_TOGETHER = 8


@dataclass(frozen=True, eq=False)
class TableModel:
    """A linear classifier whose weights ``(idx, w)`` stay a table; in all else like ``LinearModel``."""

    weights: DataFrame
    intercept: float
    loss: str
    num_features: int
    threshold: float | None = None

    @property
    def cut(self) -> float:
        return cut_of(self.loss, self.threshold)

    def __repr__(self) -> str:
        return (
            f"{type(self).__name__}(loss={self.loss}, intercept={self.intercept}, "
            f"num_features={self.num_features}, threshold={self.cut})"
        )

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``margin``, ``probability`` (logistic only) and ``prediction``.

        The table is kept in the shared folder with row ids, so that its rows never meet the weights: only their
        entries do, part by part of a grid, and one margin a row joins back.
        """
        kept = settled(df.withColumn("row_id", F.monotonically_increasing_id()))
        slim = sparse_form(kept).select("row_id", "idx", "val")
        grid = grid_of(slim, self.num_features)
        margins = table_margins(entries_of(slim, grid), self.weights, [F.col("w")], grid)
        has = F.col("idx").isNotNull() if is_sparse(df) else F.col("features").isNotNull()
        margin = F.when(has, F.coalesce("m_0", F.lit(0.0)) + F.lit(self.intercept))
        met = kept.join(margins, "row_id", "left").select(*df.columns, margin.alias("margin"))
        return with_prediction(met, self.loss, self.cut)

    def predict_one(self, features: Sequence[float]) -> float:
        """The class of one dense vector; only its non-zero places are looked up."""
        values = {j: float(x) for j, x in enumerate(features) if x}
        spark = self.weights.sparkSession
        own = spark.createDataFrame(list(values.items()), "idx int, x double")
        total = self.weights.join(own, "idx").agg(F.sum(F.col("w") * F.col("x"))).first()[0] or 0.0
        return prediction_of(total + self.intercept, self.loss, self.cut)

    def params(self, spark: SparkSession) -> DataFrame:
        """``(idx int, w double, is_intercept boolean)``; the intercept has the last index."""
        last = spark.range(1).select(
            F.lit(self.num_features).cast("int").alias("idx"),
            F.lit(float(self.intercept)).alias("w"),
            F.lit(True).alias("is_intercept"),
        )
        return self.weights.select("idx", "w", F.lit(False).alias("is_intercept")).unionByName(last)

    def save(self, spark: SparkSession, path: str) -> None:
        about = F.lit(self.loss).alias("loss"), F.lit(float(self.cut)).alias("threshold")
        self.params(spark).select("*", *about).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> "TableModel":
        table = spark.read.parquet(path)
        last = table.filter("is_intercept").first()
        weights = table.filter("not is_intercept").select("idx", "w")
        return TableModel(weights, last["w"], last["loss"], last["idx"], last["threshold"])


def table_predictions(rows: DataFrame, models: Sequence[TableModel]) -> DataFrame:
    """``(label, predictions)``: the classes of every model with a weight table, one place a model."""
    rows = rows if "row_id" in rows.columns else identified(rows)
    params = None
    for k, model in enumerate(models):
        own = model.weights.select("idx", F.col("w").alias(f"v{k}"))
        params = own if params is None else params.join(own, "idx", "full")
    weights = [F.coalesce(f"v{k}", F.lit(0.0)) for k in range(len(models))]
    grid = grid_of(rows, max(model.num_features for model in models))
    margins = table_margins(entries_of(rows, grid), params, weights, grid)
    scored = rows.select("row_id", "label").join(margins, "row_id", "left")
    predictions = []
    for k, model in enumerate(models):
        margin = F.coalesce(f"m_{k}", F.lit(0.0)) + F.lit(model.intercept)
        predictions.append(predicted(margin, model.loss, model.cut))
    return scored.select("label", F.array(*predictions).alias("predictions"))


def table_accuracies(rows: DataFrame, models: Sequence[TableModel]) -> list[float | None]:
    """Accuracy of models with weight tables on prepared rows, in one pass for all of them."""
    scored = table_predictions(rows, models)
    hits = [F.avg((F.col("predictions")[k] == F.col("label")).cast("double")) for k in range(len(models))]
    return list(scored.agg(*hits).first())


def table_confusion(rows: DataFrame, models: Sequence[TableModel]) -> DataFrame:
    """``(model, label, prediction, n)``: confusion counts of models with weight tables, by one grouped count."""
    each = table_predictions(rows, models).select("label", F.posexplode("predictions").alias("model", "prediction"))
    return each.groupBy("model", "label", "prediction").agg(F.count("*").alias("n"))


@dataclass
class _WideRun:
    """One configuration: bookkeeping in ``run`` (whose own weights hold the intercept, if any),
    weights in columns ``w{key}_``, ``s{key}_*`` and ``ahead{key}_`` of ``table``."""

    key: int
    run: _Run
    table: DataFrame
    path: str = ""

    @property
    def state(self) -> list[str]:
        return state_columns(self.run.config, f"{self.key}_")

    @property
    def columns(self) -> list[str]:
        return [f"w{self.key}_", f"ahead{self.key}_", *self.state]


def fit_wide(rows: DataFrame, configs: list[SgdConfig], shape, start, storage, told=None) -> list[FitResult]:
    """Fit configurations that share their data-level settings; ``rows`` come from ``identified`` and are
    spread over the partitions once for all of them."""
    lead = configs[0]
    table = rows
    if WORD not in table.columns and (lead.mini_batch_fraction < 1.0 or lead.validation_split > 0):
        table = table.withColumn(WORD, key_word(F.col("row_id")))
    marks = [F.col(WORD)] if WORD in table.columns else []
    if lead.validation_split > 0:
        marks.append(held_out(lead.validation_split).alias("held_out"))
    table = table.select("row_id", "label", "idx", "val", *marks)
    if storage is not None:
        table = spread_by_id(table).persist(storage)
    entries = None
    try:
        grid = grid_of(table, shape.width)
        entries = entries_of(table, grid)
        if storage is not None:
            entries = spread_by_part(entries).persist(storage)
        found: list[FitResult] = []
        for first in range(0, len(configs), _TOGETHER):
            told_own = (lambda k, step, first=first: told(first + k, step)) if told else None
            found += _fit_together(
                table, entries, configs[first : first + _TOGETHER], shape, start, grid, told_own
            )
        return found
    finally:
        if storage is not None:
            table.unpersist()
            if entries is not None:
                entries.unpersist()


def _fit_together(
    rows: DataFrame, entries: DataFrame, configs: list[SgdConfig], shape, start: DataFrame | None, grid, told
) -> list[FitResult]:
    lead, spark = configs[0], rows.sparkSession
    base = spark.range(shape.width).select(F.col("id").cast("int").alias("idx"))
    opening, scale, l1, l2 = F.lit(0.0), F.lit(1.0), 0.0, 0.0
    if start is not None:
        base = base.join(start.select("idx", "w"), "idx", "left")
        opening = F.coalesce(F.col("w"), F.lit(0.0))
        norms = weight_norms(start).first()
        l1, l2 = norms["l1_norm"] or 0.0, norms["squared_l2_norm"] or 0.0
    if lead.scale:
        sd = column_stddev(rows, shape.width, shape.n_rows)
        base = base.join(sd, "idx", "left")
        scale = F.when(F.col("sd") > 0.0, 1.0 / F.col("sd")).otherwise(0.0)
    base = base.select("idx", scale.alias("scale"), opening.alias("w"))

    runs = []
    for key, config in enumerate(configs):
        bias = np.array([config.initial_intercept] if config.intercept else [])
        run = _Run.start(config, bias)
        run.penalty = penalty(config, l1 + float(np.abs(bias).sum()), l2 + float(bias @ bias))
        runs.append(_WideRun(key, run, base))
        if shape.n_rows == 0:
            run.stop_reason = "no_data"
    columns = ["idx", "scale"]
    for r in runs:
        zero = [F.lit(0.0).alias(s) for s in r.state]
        columns += [F.col("w").alias(f"w{r.key}_"), F.col("w").alias(f"ahead{r.key}_"), *zero]
    params, path = written(base.select(*columns), "weights")
    for r in runs:
        r.table, r.path = params, path

    sampled, split_up = (Rows(x, "sparse", shape.width, lead.validation_split) for x in (rows, entries))
    iteration = 1
    while active := [r for r in runs if r.run.stop_reason is None]:
        batch, own = (x.batch(iteration, lead.mini_batch_fraction) for x in (sampled, split_up))
        before = path
        params, path = _iterate(batch, own, params, path, active, iteration, grid)
        if path != before and not any(r.path == before for r in runs):
            removed(spark, before)  # no run's weights lie there any more
        if told:
            for r in active:
                told(r.key, r.run.steps[-1])
        iteration += 1
    return [FitResult(r.run.config, _model(r, lead, shape), r.run.steps, r.run.stop_reason, 0) for r in runs]


def _iterate(batch: DataFrame, entries: DataFrame, params: DataFrame, path: str, active: list[_WideRun], iteration: int, grid):
    """One pass and update; the weight table after it, and where it lies."""
    configs = [r.run.config for r in active]
    points = [F.col(f"ahead{r.key}_") * F.col("scale") for r in active]
    margins = table_margins(entries, params, points, grid)
    biases = [float(r.run.position[-1]) if c.intercept else 0.0 for r, c in zip(active, configs)]
    gradient, sums_path = written(table_gradient(batch, margins, [c.loss for c in configs], biases), "gradient")
    totals = {r["idx"]: r for r in gradient.filter(F.col("idx") < 0).collect()}

    def total(of: int, name: str) -> float:
        return totals[of][name] if of in totals else 0

    n, n_held = total(TRAIN_LOSS, "n"), total(HELD_LOSS, "n")
    movers = []
    for i, r in enumerate(active):
        run = r.run
        loss, held_loss = total(TRAIN_LOSS, f"g_{i}"), total(HELD_LOSS, f"g_{i}")
        if run.record(iteration, loss, n, held_loss, n_held):
            movers.append((i, r))
    if movers:
        params, path = _move_all(params, gradient.filter(F.col("idx") >= 0), movers, iteration, n, totals)
    removed(batch.sparkSession, sums_path)
    for r in active:
        if r.run.stop_reason is None and iteration >= r.run.config.num_iterations:
            r.run.stop_reason = "max_iterations"
    return params, path


def _move_all(params, gradient, movers, iteration: int, n: int, totals) -> DataFrame:
    """The next weight table with its place and, per configuration, its penalty and convergence."""
    table = params.drop(*[c for c in params.columns if c.startswith("old")])
    table = table.join(gradient.drop("n"), "idx", "left")
    table = table.select("*", *[F.col(f"w{r.key}_").alias(f"old{r.key}") for _, r in movers])
    steps = []
    for i, r in movers:
        config = r.run.config
        r.run.updates += 1
        mean = F.coalesce(F.col(f"g_{i}"), F.lit(0.0)) / F.lit(float(n)) * F.col("scale")
        table = updated(table, mean, config, iteration, r.run.updates, f"{r.key}_")
        steps.append((r, config, Tick(config, config.step_at(iteration), r.run.updates)))
    columns = ["idx", "scale", *[c for _, r in movers for c in (*r.columns, f"old{r.key}")]]
    table, path = written(table.select(*columns), "weights")

    norms = []
    for _, r in movers:
        w, change = F.col(f"w{r.key}_"), F.col(f"w{r.key}_") - F.col(f"old{r.key}")
        norms += [
            F.sum(F.abs(w)).alias(f"a{r.key}"),
            F.sum(w * w).alias(f"q{r.key}"),
            F.sum(change * change).alias(f"d{r.key}"),
        ]
    measured = table.agg(*norms).first()
    for (i, _), (r, config, tick) in zip(movers, steps):
        run = r.run
        r.table, r.path = table, path
        before = run.weights
        if config.intercept:
            run.move_weights(np.array([totals[BIAS][f"g_{i}"] / n]), tick)
        after = run.weights
        l1 = measured[f"a{r.key}"] + float(np.abs(after).sum())
        l2 = measured[f"q{r.key}"] + float(after @ after)
        change = measured[f"d{r.key}"] + float((after - before) @ (after - before))
        run.penalty = penalty(config, l1, l2)
        if run.updates > 1 and has_converged(change**0.5, l2**0.5, config.convergence_tol):
            run.stop_reason = "converged"
    return table, path


def _model(r: _WideRun, lead: SgdConfig, shape) -> LinearModel | TableModel:
    config = r.run.config
    weight = F.col(f"w{r.key}_") * F.col("scale") if lead.scale else F.col(f"w{r.key}_")
    table = r.table.select("idx", weight.alias("w"))
    intercept = float(r.run.weights[-1]) if config.intercept else 0.0
    if shape.width <= MAX_DRIVER_VALUES:
        return LinearModel(collect_vector(table, "w", shape.width), intercept, config.loss)
    return TableModel(table, intercept, config.loss, shape.width)
