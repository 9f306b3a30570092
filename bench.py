"""Headline timings: ``python bench.py`` prints one JSON line.

``BENCH_SF_DIR`` names the tables (default sf0.1), ``BENCH_CPUS`` the local cores (default 8).
Training entries are whole fits of 20 iterations: reading, validating and caching the table
included.  Each is timed once after one small warm-up fit.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time
import warnings

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from slopeworks import SgdConfig, fit, sweep, sweep_configs  # noqa: E402
from slopeworks.catalog.queries import all_queries  # noqa: E402
from slopeworks.catalog.tables import BUCKETS, document_set, embedding_set, lineitem_set  # noqa: E402
from slopeworks.operators.sampling import train_validation  # noqa: E402

ITERATIONS = 20
# Rate variations of the published 30-run sweep.
PUBLISHED_VARIATIONS = (9.0, 0.0, -0.9)
SINGLE_PASSES = (
    "src_training_set", "src_libsvm", "feat_std_scale", "val_feature_width", "sample_minibatch", "grad_logistic",
    "grad_hinge", "grad_logistic_sparse", "grad_logistic_join", "loss_validation", "upd_adam", "predict_lr",
    "eval_confusion", "parse_run_log", "log_best_rate",
)


def config(**changes) -> SgdConfig:
    return SgdConfig(**({"num_iterations": ITERATIONS, "convergence_tol": 0.0} | changes))


def training_cases(spark: SparkSession, folder: str):
    lines = lineitem_set(spark, folder)
    train, test = train_validation(lines, 0.2)
    return {
        "train_lr_simple_20": lambda: fit(lines, config(updater="simple"), 4),
        "train_lr_adam_20": lambda: fit(lines, config(updater="adam", step_size=0.2), 4),
        "train_svm_adagrad_20": lambda: fit(lines, config(loss="hinge"), 4),
        "train_lr_minibatch_20": lambda: fit(lines, config(updater="adam", mini_batch_fraction=0.25), 4),
        "train_lr_validated_20": lambda: fit(lines, config(validation_split=0.2, intercept=True), 4),
        "train_lr_embeddings_20": lambda: fit(embedding_set(spark, folder), config(updater="adam"), 64),
        "train_lr_documents_20": lambda: fit(document_set(spark, folder), config(step_size=0.1), BUCKETS),
        "train_lr_documents_join_20": lambda: fit(
            document_set(spark, folder), config(step_size=0.1), BUCKETS, layout="join"
        ),
        "sweep_30_runs_20": lambda: sweep(
            train, test, sweep_configs(config(), variations=PUBLISHED_VARIATIONS), 4
        ).runs.collect(),
        "sweep_70_runs_20": lambda: sweep(
            train, test, sweep_configs(config(mini_batch_fraction=0.25)), 4
        ).runs.collect(),
    }


def main() -> None:
    warnings.simplefilter("ignore")
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("slopeworks-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    fit(lineitem_set(spark, folder), config(updater="simple", num_iterations=3), 4)

    timings: dict[str, float] = {}
    for name, run in training_cases(spark, folder).items():
        began = time.perf_counter()
        run()
        timings[name] = round(time.perf_counter() - began, 3)
    queries = all_queries()
    for name in SINGLE_PASSES:
        began = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - began, 3)
    scale = re.search(r"sf([0-9.]+)", folder)
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": float(scale.group(1)) if scale else None,
                "ms_per_iteration": {
                    n: round(t * 1000 / ITERATIONS) for n, t in timings.items() if n.endswith(f"_{ITERATIONS}")
                },
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
