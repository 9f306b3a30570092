"""Learning-rate sweeps: every updater at every rate, trained in lock-step."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slopeworks.config import SgdConfig
from slopeworks.functions.updates import UPDATER_NAMES
from slopeworks.operators.features import checked_shape, is_sparse
from slopeworks.operators.gradient import prepare
from slopeworks.plans.fit import FitResult, accuracies, fit, history_table

# Base rate per updater in id order, and the relative variations tried around it.
BASE_RATES = (0.1, 0.1, 0.1, 1.0, 100.0, 0.1, 0.2, 2.0, 0.2, 0.2)
VARIATIONS = (9.0, 6.0, 3.0, 0.0, -0.3, -0.6, -0.9)


def sweep_configs(
    base: SgdConfig | None = None,
    updaters: Sequence[str] = UPDATER_NAMES,
    variations: Sequence[float] = VARIATIONS,
) -> list[SgdConfig]:
    """One configuration per updater and variation, in updater order.

    Without a base: 200 iterations over mini-batches of a quarter, with the default tolerance.
    """
    base = base or SgdConfig(num_iterations=200, mini_batch_fraction=0.25)
    rates = dict(zip(UPDATER_NAMES, BASE_RATES))
    return [
        base.with_(updater=u, step_size=rates[u] + rates[u] * v) for u in updaters for v in variations
    ]


def config_table(spark: SparkSession, configs: Sequence[SgdConfig]) -> DataFrame:
    """``(config_id, updater, rate)`` of a list of configurations."""
    return spark.createDataFrame(
        pa.table(
            {
                "config_id": pa.array(range(len(configs)), pa.int32()),
                "updater": pa.array([c.updater for c in configs], pa.string()),
                "rate": pa.array([c.step_size for c in configs], pa.float64()),
            }
        )
    )


@dataclass
class SweepResult:
    """``runs``: one row per configuration; ``history``: one row per iteration of each."""

    runs: DataFrame
    history: DataFrame
    results: list[FitResult]

    def save(self, folder: str, mode: str = "append") -> None:
        """Write ``runs`` and ``history`` as Parquet tables under a folder."""
        self.runs.write.mode(mode).parquet(f"{folder}/runs")
        self.history.write.mode(mode).parquet(f"{folder}/history")


def sweep(
    train: DataFrame,
    test: DataFrame,
    configs: Sequence[SgdConfig],
    num_features: int | None = None,
    **fit_options,
) -> SweepResult:
    """Train all configurations and score them on both tables.

    ``elapsed_ms`` is the time of the lock-step group a run belonged to.
    """
    spark = train.sparkSession
    results = fit(train, configs, num_features, score=True, **fit_options)
    models = [r.model for r in results]
    rows = prepare(test, models[0].num_features, sampled=False)
    # The same checks as on the training table; indices beyond the training width count as weight 0.
    checked_shape(rows.df, is_sparse(test), None if is_sparse(test) else rows.width, configs[0].validate)
    test_accuracy = accuracies(rows, models)
    alg = [r.config.loss for r in results]
    about = spark.createDataFrame(
        pa.table(
            {
                "config_id": pa.array(range(len(results)), pa.int32()),
                "alg": pa.array(alg, pa.string()),
                "iterations": pa.array([len(r.steps) for r in results], pa.int32()),
                "stop_reason": pa.array([r.stop_reason for r in results], pa.string()),
                "elapsed_ms": pa.array([r.elapsed_ms for r in results], pa.int64()),
                "train_acc": pa.array([r.train_accuracy for r in results], pa.float64()),
                "test_acc": pa.array(test_accuracy, pa.float64()),
            }
        )
    )
    runs = config_table(spark, [r.config for r in results]).join(about, "config_id")
    history = history_table(spark, results)
    return SweepResult(
        runs.withColumn("run_id", F.col("config_id")),
        history.withColumn("run_id", F.col("config_id")).withColumn("loss", F.col("train_loss")),
        results,
    )
