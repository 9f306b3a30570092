"""``python -m slopeworks DATASET UPDATER RATE FRACTION ITERATIONS {lr,svm} [--data FOLDER]``"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import SparkSession

from slopeworks.functions.updates import UPDATER_NAMES
from slopeworks.plans.experiment import ALGORITHMS, named_experiment, summary_text
from slopeworks.sources.libsvm import DATASETS


def main(arguments: Sequence[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="slopeworks", description="Run one training experiment.")
    parser.add_argument("dataset", choices=list(DATASETS))
    ids = ", ".join(f"{i} {name}" for i, name in enumerate(UPDATER_NAMES))
    parser.add_argument("updater", type=int, choices=range(len(UPDATER_NAMES)), metavar="updater", help=ids)
    parser.add_argument("rate", type=float)
    parser.add_argument("fraction", type=float)
    parser.add_argument("iterations", type=int)
    parser.add_argument("algorithm", choices=list(ALGORITHMS))
    parser.add_argument("--data", default="data", help="folder of the LIBSVM files")
    given = parser.parse_args(arguments)
    spark = SparkSession.builder.appName("slopeworks").getOrCreate()
    result = named_experiment(
        spark, given.data, given.dataset, given.updater, given.rate, given.fraction, given.iterations, given.algorithm
    )
    print("\n".join(summary_text(result)))


if __name__ == "__main__":
    main()
