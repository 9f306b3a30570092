"""One named experiment: dataset, updater, rate, fraction, iterations and algorithm to one run row."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from slopeworks.config import SgdConfig
from slopeworks.functions.updates import UPDATER_NAMES, updater_by_id
from slopeworks.plans.sweep import SweepResult, sweep
from slopeworks.sources.libsvm import dataset_pair
from slopeworks.sources.run_log import run_log_lines

# Names of the two algorithms on the command line.
ALGORITHMS = {"lr": "logistic", "svm": "hinge"}


def named_experiment(
    spark: SparkSession,
    folder: str,
    dataset: str,
    updater_id: int,
    rate: float,
    fraction: float,
    iterations: int,
    algorithm: str,
) -> SweepResult:
    """Train on the dataset's training file and score both of its files."""
    if algorithm not in ALGORITHMS:
        raise ValueError(f"unknown algorithm {algorithm!r}; known: {', '.join(ALGORITHMS)}")
    config = SgdConfig(
        loss=ALGORITHMS[algorithm],
        updater=updater_by_id(updater_id).name,
        step_size=rate,
        mini_batch_fraction=fraction,
        num_iterations=iterations,
    )
    train, test, width = dataset_pair(spark, dataset, folder)
    return sweep(train, test, [config], width)


def summary_text(result: SweepResult) -> list[str]:
    """The losses and the summary line of a finished experiment, in run-log form."""
    ids = F.create_map(*[F.lit(x) for i, name in enumerate(UPDATER_NAMES) for x in (name, str(i))])
    names = F.create_map(*[F.lit(x) for name, loss in ALGORITHMS.items() for x in (loss, name)])
    runs = result.runs.withColumns(
        {
            "updater": F.coalesce(F.try_element_at(ids, F.col("updater")), F.col("updater")),
            "alg": F.coalesce(F.try_element_at(names, F.col("alg")), F.col("alg")),
        }
    )
    lines = run_log_lines(result.history.filter("loss IS NOT NULL"), runs).orderBy("run_id", "position")
    return [r["value"] for r in lines.select("value").collect()]
