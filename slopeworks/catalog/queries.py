"""One query per operator, over the given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slopeworks.catalog.tables import BUCKETS, document_set, embedding_set, lineitem_set, read
from slopeworks.config import L1, L2, SgdConfig
from slopeworks.functions.updates import UPDATER_NAMES
from slopeworks.operators import control, evaluate, features, history, joined, sampling, update
from slopeworks.operators.gradient import batch_sums, column_sums, prepare
from slopeworks.plans.estimators import LinearSvm, LogisticRegression, train_logistic, train_svm
from slopeworks.plans.experiment import named_experiment
from slopeworks.plans.fit import FitResult, fit, history_table
from slopeworks.plans.model import LinearModel
from slopeworks.plans.sweep import sweep, sweep_configs
from slopeworks.plans.plugins import checked_loss, checked_updater
from slopeworks.plans.snapshots import Snapshots
from slopeworks.plans.wide import TableModel, table_confusion
from slopeworks.shared import settled, shared_folder
from slopeworks.sources.libsvm import DATASETS, read_libsvm, to_libsvm_lines
from slopeworks.sources.run_log import log_tables, parse_run_log, read_run_log

Query = Callable[[SparkSession, str], DataFrame]

# Weights at which single passes over the line items are taken.
POINT = (0.8, 1.5, -0.4, 0.3)
POINT_BIAS = -1.1
STEP = 0.5
REG = 0.05
BATCH = 0.25
SPLIT = 0.2
# Iterations of the sweeps; the best rate is judged at the last of them.
SWEEP_STEPS = CRITERION = 20
# Steps of the longer training queries.
LONG_STEPS = 10
STANDARD_FORMS = ("adam", "adamax", "nadam", "amsgrad")


def rounded(column: Column, digits: int = 6) -> Column:
    """Rounded, with -0.0 turned into 0.0."""
    return F.round(column, digits) + F.lit(0.0)


def wide_form(df: DataFrame, width: int, *others: str) -> DataFrame:
    return df.select(*others, *[F.col("features")[j].alias(f"x{j}") for j in range(width)])


# --- sources, features, sampling ----------------------------------------------------------------


def src_training_set(spark, folder):
    return wide_form(lineitem_set(spark, folder), 4, "row_key", "label")


def src_libsvm(spark, folder):
    """Line items written as LIBSVM text, read back, and summed per feature."""
    path = shared_folder(spark, f"libsvm-{uuid.uuid4().hex}")
    to_libsvm_lines(lineitem_set(spark, folder)).write.text(path)
    rows = read_libsvm(spark, path, num_features=4)
    entries = rows.select("label", F.inline(F.arrays_zip("idx", "val")))
    return entries.groupBy("label", "idx").agg(
        F.count(F.lit(1)).alias("n"), rounded(F.avg("val")).alias("mean")
    )


def feat_append_bias(spark, folder):
    return wide_form(features.append_bias(lineitem_set(spark, folder)), 5, "row_key")


def feat_std_scale(spark, folder):
    rows = lineitem_set(spark, folder)
    scaled = features.scaled(rows, features.column_stddev(rows, 4), 4)
    return scaled.select("row_key", *[rounded(F.col("features")[j]).alias(f"x{j}") for j in range(4)])


def feat_std_scale_sparse(spark, folder):
    rows = document_set(spark, folder)
    sd = features.column_stddev(rows, BUCKETS)
    return sd.select("idx", rounded(F.col("sd")).alias("sd"))


def feat_unscale_weights(spark, folder):
    rows = features.append_bias(lineitem_set(spark, folder))
    sd = features.column_stddev(rows, 4)
    mean = rows.agg(*[F.avg(F.col("features")[j]).alias(f"m{j}") for j in range(5)])
    params = mean.select(F.inline(F.array(*[F.struct(F.lit(j).alias("idx"), F.col(f"m{j}").alias("w")) for j in range(5)])))
    return features.unscaled_weights(params, sd).select("idx", rounded(F.col("w")).alias("w"))


def val_binary_label(spark, folder):
    rows = read(spark, folder, "lineitem").select(F.col("l_linenumber").cast("double").alias("label"))
    return features.bad_labels(rows).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


def val_feature_width(spark, folder):
    sets = {
        "lineitem": lineitem_set(spark, folder),
        "embeddings": embedding_set(spark, folder),
        "documents": document_set(spark, folder),
    }
    parts = [features.width_summary(s).select(F.lit(n).alias("source"), "*") for n, s in sets.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def sample_minibatch(spark, folder):
    rows = lineitem_set(spark, folder)
    batches = [
        sampling.minibatch(rows, i, BATCH).select("row_key", F.lit(i).alias("iteration")) for i in (1, 2, 3)
    ]
    return batches[0].unionByName(batches[1]).unionByName(batches[2])


def split_validation(spark, folder):
    return sampling.with_split(lineitem_set(spark, folder), SPLIT).select("row_key", "held_out")


# --- gradients and losses -----------------------------------------------------------------------


def _point_sums(spark, folder, losses: Sequence[str], bias: float = 0.0, iteration=None, split=0.0) -> DataFrame:
    rows = prepare(lineitem_set(spark, folder), 4, split)
    batch = rows.batch(iteration, BATCH)
    points = np.array([POINT] * len(losses))
    return column_sums(rows, batch, points, np.full(len(losses), bias), losses)


def _gradient_rows(sums: DataFrame, width: int, k: int = 0) -> DataFrame:
    parts = [F.struct(F.lit(j).alias("idx"), (F.col(f"g_{k}_{j}") / F.col("n")).alias("g")) for j in range(width)]
    return sums.select("n", (F.col(f"l_{k}") / F.col("n")).alias("loss_mean"), F.inline(F.array(*parts)))


def _gradient_query(loss: str) -> Query:
    def run(spark, folder):
        found = _gradient_rows(_point_sums(spark, folder, [loss], POINT_BIAS), 4)
        return found.select(
            "idx", "n", rounded(F.col("loss_mean")).alias("loss_mean"), rounded(F.col("g")).alias("grad_mean")
        )

    return run


def _gradient_table(spark: SparkSession, sums, n_round: int = 6) -> DataFrame:
    width = sums.gradient.shape[1]
    table = pa.table(
        {
            "idx": pa.array(range(width), pa.int32()),
            "n": pa.array([sums.n] * width, pa.int64()),
            "l": pa.array([sums.loss[0] / sums.n] * width, pa.float64()),
            "g": pa.array(sums.gradient[0] / sums.n, pa.float64()),
        }
    )
    return spark.createDataFrame(table).select(
        "idx", "n", rounded(F.col("l")).alias("loss_mean"), rounded(F.col("g")).alias("grad_mean")
    )


def pattern_weights(width: int) -> np.ndarray:
    """Small weights that repeat with period 7."""
    return (np.arange(width) % 7 - 3) / 10.0


def grad_logistic_dense64(spark, folder):
    rows = prepare(embedding_set(spark, folder), 64)
    sums = batch_sums(rows, rows.df, pattern_weights(64)[None, :], np.zeros(1), ["logistic"])
    return _gradient_table(spark, sums)


def grad_logistic_sparse(spark, folder):
    rows = prepare(document_set(spark, folder), BUCKETS)
    sums = batch_sums(rows, rows.df, pattern_weights(BUCKETS)[None, :], np.zeros(1), ["logistic"])
    return _gradient_table(spark, sums)


def grad_logistic_join(spark, folder):
    """The sparse gradient with the weights kept as a table."""
    rows = joined.identified(document_set(spark, folder))
    pattern = ((F.col("id") % 7 - 3) / 10.0).alias("w")
    params = spark.range(BUCKETS).select(F.col("id").cast("int").alias("idx"), pattern)
    grid = joined.grid_of(rows, BUCKETS)
    margins = joined.table_margins(joined.entries_of(rows, grid), params, [F.col("w")], grid)
    found = joined.table_gradient(rows, margins, ["logistic"], [0.0])
    return found.filter("idx >= 0").select("idx", F.col("n").alias("n_entries"), rounded(F.col("g_0")).alias("grad_sum"))


def loss_validation(spark, folder):
    sums = _point_sums(spark, folder, ["logistic", "hinge"], POINT_BIAS, iteration=2, split=SPLIT)
    parts = [
        F.struct(
            F.lit(name).alias("loss"),
            rounded(F.col(f"l_{k}") / F.col("n")).alias("train_loss"),
            rounded(F.col(f"lv_{k}") / F.col("nv")).alias("val_loss"),
        )
        for k, name in enumerate(("logistic", "hinge"))
    ]
    return sums.select("n", F.col("nv").alias("n_val"), F.inline(F.array(*parts)))


# --- updates and regularization -----------------------------------------------------------------


def _two_gradients(spark, folder) -> DataFrame:
    """(idx, w, g1, g2): a start and the mean gradients of the first two mini-batches there."""
    found = []
    for name, iteration in (("g1", 1), ("g2", 2)):
        sums = _point_sums(spark, folder, ["logistic"], iteration=iteration)
        found.append(_gradient_rows(sums, 4).select("idx", F.col("g").alias(name)))
    start = F.array(*[F.lit(w) for w in POINT])
    return found[0].join(found[1], "idx").select("idx", start[F.col("idx")].alias("w"), "g1", "g2")


def _update_query(config: SgdConfig) -> Query:
    def run(spark, folder):
        params = update.fresh_params(_two_gradients(spark, folder), config)
        once = update.updated(params, F.col("g1"), config, 1, 1)
        kept = once.select("*", F.col("w").alias("w1"), F.col("ahead").alias("ahead1"))
        twice = update.updated(kept, F.col("g2"), config, 2, 2)
        return twice.select(
            "idx",
            rounded(F.col("w1")).alias("w1"),
            rounded(F.col("ahead1")).alias("ahead1"),
            rounded(F.col("w")).alias("w2"),
            rounded(F.col("ahead")).alias("ahead2"),
        )

    return run


def reg_value(spark, folder):
    """Penalties of the weights after one step, per kind of regularization."""
    sums = _point_sums(spark, folder, ["logistic"], iteration=1)
    start = F.array(*[F.lit(w) for w in POINT])
    # Four rows: kept, so that the three kinds share one pass over the line items.
    first = settled(_gradient_rows(sums, 4).select("idx", start[F.col("idx")].alias("w"), F.col("g").alias("g1")))
    parts = []
    for kind in (0, L1, L2):
        config = SgdConfig(updater="simple", step_size=STEP, reg_type=kind, reg_param=REG)
        params = update.fresh_params(first, config)
        moved = update.updated(params, F.col("g1"), config, 1, 1).withColumn("reg_type", F.lit(kind))
        parts.append(update.penalties(moved, config, "reg_type"))
    table = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return table.select("reg_type", rounded(F.col("penalty")).alias("penalty"))


# --- training -----------------------------------------------------------------------------------


def digits_of(loss: str) -> int:
    """Decimals to compare.  Hinge weights are short decimals that often end in a 5 at the seventh
    place, where rounding to six would hang on the last bit."""
    return 9 if loss == "hinge" else 6


def result_rows(spark: SparkSession, results: Sequence[FitResult]) -> DataFrame:
    """Weights, intercept and losses of fits in long form: (updater, entry, pos, value)."""
    rows = []
    for r in results:
        rows += [(r.config.updater, "weight", j, float(w)) for j, w in enumerate(r.model.weights)]
        if r.config.intercept:
            rows.append((r.config.updater, "intercept", 0, float(r.model.intercept)))
        for s in r.steps:
            rows.append((r.config.updater, "loss", s.iteration, float(s.train_loss)))
            if s.val_loss is not None:
                rows.append((r.config.updater, "val_loss", s.iteration, float(s.val_loss)))
    updater, entry, pos, value = zip(*rows)
    table = pa.table(
        {
            "updater": pa.array(updater, pa.string()),
            "entry": pa.array(entry, pa.string()),
            "pos": pa.array(pos, pa.int32()),
            "value": pa.array(value, pa.float64()),
        }
    )
    digits = digits_of(results[0].config.loss)
    return spark.createDataFrame(table).withColumn("value", rounded(F.col("value"), digits))


def training_config(**changes) -> SgdConfig:
    """Three full-batch steps without a tolerance."""
    settings = {"updater": "simple", "step_size": STEP, "num_iterations": 3, "convergence_tol": 0.0}
    return SgdConfig(**(settings | changes))


def _train_query(make_set=lineitem_set, width: int = 4, layout: str = "auto", **changes) -> Query:
    def run(spark, folder):
        results = fit(make_set(spark, folder), training_config(**changes), num_features=width, layout=layout)
        return result_rows(spark, results)

    return run


def _resumed_query(**changes) -> Query:
    """A fit in two parts, the second from the snapshot of the first."""

    def run(spark, folder):
        snapshots = Snapshots(shared_folder(spark, f"snapshots-{uuid.uuid4().hex}"), every=3)
        rows = lineitem_set(spark, folder)
        fit(rows, training_config(**changes, num_iterations=4), num_features=4, snapshots=snapshots)
        results = fit(rows, training_config(**changes, num_iterations=LONG_STEPS), num_features=4, snapshots=snapshots)
        return result_rows(spark, results)

    return run


def _halved(ops, g, state, tick):
    return 0.5 * tick.step * g, ()


def _by_sign(ops, margin, label):
    """The logistic loss written by the sign of the label."""
    sign = 2.0 * label - 1.0
    small = ops.exp(-ops.abs(margin))
    against = ops.where(sign * margin < 0, 1.0, small) / (1.0 + small)
    return -sign * against, ops.log1p(small) + ops.maximum(-sign * margin, 0.0)


def train_lr_plugged(spark, folder):
    """A user's rule and loss, checked and registered: steps of half the size under a loss like the logistic one."""
    checked_updater(spark, "halved", _halved, 0)
    checked_loss(spark, "by_sign", _by_sign, "sigmoid")
    configs = training_config(updater="halved", loss="by_sign", num_iterations=LONG_STEPS)
    return result_rows(spark, fit(lineitem_set(spark, folder), configs, num_features=4))


def history_last10(spark, folder):
    result = fit(lineitem_set(spark, folder), training_config(num_iterations=12), num_features=4)[0]
    return history.last_losses(result.history(spark)).select(
        "iteration", rounded(F.col("train_loss")).alias("train_loss")
    )


def ctl_convergence(spark, folder):
    """Weights of all updaters after 1, 2, 3 and 4 steps, trained in lock-step, and their norms."""
    steps = 4
    configs = [training_config(updater=u, num_iterations=t) for u in UPDATER_NAMES for t in range(1, steps + 1)]
    results = fit(lineitem_set(spark, folder), configs, num_features=4)
    flat = [
        (i // steps, i % steps + 1, j, float(w)) for i, r in enumerate(results) for j, w in enumerate(r.model.weights)
    ]
    weights = spark.createDataFrame(flat, "config_id int, iteration int, idx int, w double")
    found = control.convergence_norms(weights, 0.05)
    return found.select(
        "config_id",
        "iteration",
        rounded(F.col("change_norm")).alias("change_norm"),
        rounded(F.col("weight_norm")).alias("weight_norm"),
        "converged",
    )


# Step sizes that make some validation losses rise.
RESTLESS_STEP = 8.0
STOP_STEPS = 6


def ctl_early_stop(spark, folder):
    """First iteration after the warm-up whose validation loss did not fall, per updater."""
    configs = [
        training_config(
            updater=u, step_size=RESTLESS_STEP, num_iterations=STOP_STEPS, validation_split=SPLIT, iter_validation=50
        )
        for u in UPDATER_NAMES
    ]
    results = fit(lineitem_set(spark, folder), configs, num_features=4)
    return control.early_stops(history_table(spark, results), warm_up=1)


# --- scoring ------------------------------------------------------------------------------------


def point_model(loss: str) -> LinearModel:
    return LinearModel(np.array(POINT), POINT_BIAS, loss)


def predict_lr(spark, folder):
    scored = point_model("logistic").transform(lineitem_set(spark, folder))
    return scored.select(
        "row_key", "label", "margin", rounded(F.col("probability")).alias("probability"), "prediction"
    )


def predict_svm(spark, folder):
    scored = point_model("hinge").transform(lineitem_set(spark, folder))
    return scored.select("row_key", "label", "margin", "prediction")


def predict_dense64(spark, folder):
    scored = LinearModel(pattern_weights(64), 0.05).transform(embedding_set(spark, folder))
    return scored.select("row_key", "label", rounded(F.col("probability")).alias("probability"), "prediction")


def predict_sparse(spark, folder):
    scored = LinearModel(pattern_weights(BUCKETS), 0.05).transform(document_set(spark, folder))
    return scored.select("row_key", "label", rounded(F.col("probability")).alias("probability"), "prediction")


def eval_accuracy(spark, folder):
    scored = point_model("logistic").transform(lineitem_set(spark, folder))
    return evaluate.accuracy(scored).select(rounded(F.col("accuracy")).alias("accuracy"))


def eval_confusion(spark, folder):
    return evaluate.confusion(point_model("hinge").transform(lineitem_set(spark, folder)))


def eval_majority(spark, folder):
    return evaluate.majority_accuracy(lineitem_set(spark, folder)).select(
        rounded(F.col("accuracy")).alias("accuracy")
    )


# --- sweeps and logs ----------------------------------------------------------------------------


def sweep_base(**changes) -> SgdConfig:
    settings = {"num_iterations": SWEEP_STEPS, "mini_batch_fraction": BATCH, "convergence_tol": 0.0}
    return SgdConfig(**(settings | changes))


def _sweep_tables(spark, folder, **changes) -> tuple[DataFrame, DataFrame]:
    configs = sweep_configs(sweep_base(**changes))
    results = fit(lineitem_set(spark, folder), configs, num_features=4)
    table = history_table(spark, results).withColumnsRenamed({"config_id": "run_id", "train_loss": "loss"})
    return table, table.select("run_id", "updater", "rate").dropDuplicates(["run_id"])


def sweep_grid(spark, folder):
    """Every configuration of the sweep with its first two losses."""
    table, _ = _sweep_tables(spark, folder, num_iterations=2)
    first, second = (F.max(F.when(F.col("iteration") == i, F.col("loss"))) for i in (1, 2))
    return table.groupBy("run_id", "updater", "rate").agg(
        rounded(first).alias("loss1"), rounded(second).alias("loss2")
    ).withColumn("rate", rounded(F.col("rate")))


def _sweep_runs(loss: str) -> Query:
    def run(spark, folder):
        rows = lineitem_set(spark, folder)
        train, test = sampling.train_validation(rows, SPLIT)
        found = sweep(train, test, sweep_configs(sweep_base(loss=loss)), num_features=4)
        return found.runs.select(
            "run_id",
            "updater",
            "alg",
            "iterations",
            rounded(F.col("rate")).alias("rate"),
            rounded(F.col("train_acc")).alias("train_acc"),
            rounded(F.col("test_acc")).alias("test_acc"),
        )

    return run


def sweep_best_rate(spark, folder):
    tables = _sweep_tables(spark, folder, num_iterations=CRITERION)
    found = history.best_rates(*tables, criterion_iteration=CRITERION)
    return found.select(
        "updater", "run_id", rounded(F.col("rate")).alias("rate"), rounded(F.col("loss")).alias("loss")
    )


def sweep_curves(spark, folder):
    table, runs = _sweep_tables(spark, folder)
    return history.loss_curves(table, runs).select(
        "updater", "run_id", rounded(F.col("rate")).alias("rate"), "iteration", rounded(F.col("loss")).alias("loss")
    )


def sweep_best_curves(spark, folder):
    table, runs = _sweep_tables(spark, folder)
    found = history.best_curves(table, runs, criterion_iteration=SWEEP_STEPS)
    return found.select(
        "panel", "updater", "run_id", rounded(F.col("rate")).alias("rate"), "iteration",
        rounded(F.col("loss")).alias("loss"),
    )


# Lines per block when log lines come from a table with unique increasing ids.
LOG_BLOCK = 500
# Lines per log file, and bytes per split when files are read back as text.
LOG_FILE, LOG_SPLIT = 20_000, 64 << 10


def event_log(spark, folder) -> DataFrame:
    """Events told as log lines: purchases close a run, errors are noise, the rest are losses."""
    value = F.col("value").cast("string")
    closing = F.format_string(
        "Testing accuracy  of updater %d on alg %d with rate %s = %s, training accuracy %s, "
        "time elapsed: %d millisecond.",
        F.col("user_id") % 10,
        F.col("user_id") % 2,
        value,
        (F.col("user_id") / 1000).cast("string"),
        (F.col("user_id") / 2000).cast("string"),
        F.col("event_id"),
    )
    loss = F.format_string("Loss in iteration %d : %s", F.col("event_id") % 20 + 1, value)
    line = F.when(F.col("event_type") == "purchase", closing).when(F.col("event_type") == "error", "ERROR").otherwise(loss)
    return read(spark, folder, "events").select(
        F.lit("events").alias("source"),
        F.floor(F.col("event_id") / LOG_BLOCK).alias("block"),
        F.col("event_id").alias("seq"),
        line.alias("value"),
    )


def parse_run_log_history(spark, folder):
    return log_tables(parse_run_log(event_log(spark, folder)))[0].drop("source")


def parse_run_log_runs(spark, folder):
    return log_tables(parse_run_log(event_log(spark, folder)))[1].drop("source")


def log_best_rate(spark, folder):
    """Best rate per updater from a parsed log."""
    table, runs = log_tables(parse_run_log(event_log(spark, folder)))
    return history.best_rates(table.groupBy("run_id", "iteration").agg(F.min("loss").alias("loss")), runs, 5)


def parse_run_log_text(spark, folder):
    """The event log written as text files of many lines each, and read back in many splits."""
    path = shared_folder(spark, f"run-log-{uuid.uuid4().hex}")
    lines = event_log(spark, folder).select(F.floor(F.col("seq") / LOG_FILE).alias("file"), "seq", "value")
    files = lines.repartition("file").sortWithinPartitions("file", "seq")
    files.select("file", "value").write.partitionBy("file").text(path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(LOG_SPLIT))
    try:
        runs = log_tables(parse_run_log(read_run_log(spark, path)))[1]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    return runs.withColumn("source", F.regexp_extract("source", r"file=(\d+)/", 1).cast("bigint"))


# --- one answer in every layout -------------------------------------------------------------------


def sample_unkeyed(spark, folder):
    """Batches of line items without a key: whether every layout draws as many rows, near the share asked for."""
    rows = lineitem_set(spark, folder).drop("row_key")
    config = training_config(mini_batch_fraction=BATCH, validation_split=SPLIT)
    found = [fit(rows, config, num_features=4, layout=layout)[0] for layout in ("columns", "arrow", "join")]
    share = BATCH * (1 - SPLIT)
    n = spark.read.parquet(f"{folder}/lineitem.parquet").agg(F.count(F.lit(1)).alias("n_rows"))
    steps = [
        (a.iteration, a.batch_n == b.batch_n == c.batch_n, a.batch_n)
        for a, b, c in zip(*[result.steps for result in found])
    ]
    table = spark.createDataFrame(steps, "iteration int, layouts_agree boolean, batch_n bigint")
    near = F.abs(F.col("batch_n") / F.col("n_rows") - share) < 0.1 * share
    return n.join(F.broadcast(table)).select("iteration", "n_rows", "layouts_agree", near.alias("near_share"))


def val_features(spark, folder):
    """Rows of a sparse table that are bad in one way or another, counted per kind."""
    rows = read(spark, folder, "lineitem")
    number = F.col("l_linenumber").cast("int")
    places = (
        F.when(number == 1, F.array(F.lit(0), F.lit(-1)))
        .when(number == 2, F.array(F.lit(0), F.lit(None).cast("int")))
        .when(number == 3, F.array(F.lit(0)))
        .when(number == 4, F.lit(None).cast("array<int>"))
        .otherwise(F.array(F.lit(0), F.lit(1)))
    )
    values = F.when(number == 5, F.array(F.lit(None).cast("double"), F.col("l_tax"))).otherwise(
        F.array("l_discount", "l_tax")
    )
    label = F.when(F.col("l_returnflag") == "A", F.lit(None).cast("double")).otherwise(
        F.when(F.col("l_returnflag") == "N", 2.0).otherwise(1.0)
    )
    key = F.when(number != 6, F.concat_ws("-", "l_orderkey", "l_linenumber"))
    table = rows.select(label.alias("label"), places.alias("idx"), values.alias("val"), key.alias("row_key"))
    return features.unclean_counts(table)


def eval_confusion_many(spark, folder):
    """Confusion of two models at once, with labels outside 0 and 1 and null labels kept apart."""
    rows = lineitem_set(spark, folder)
    number = F.split("row_key", "-")[1].cast("int")
    rows = rows.withColumn("label", F.when(number != 5, (number % 4 - 1).cast("double")))
    models = [point_model("logistic"), point_model("hinge")]
    return evaluate.confusion_of(prepare(rows, 4, sampled=False), models)


def eval_confusion_join(spark, folder):
    """As ``eval_confusion_many``, by models whose weights are tables."""
    number = F.split("row_key", "-")[1].cast("int")
    rows = lineitem_set(spark, folder).withColumn("label", F.when(number != 5, (number % 4 - 1).cast("double")))
    places = spark.createDataFrame(list(enumerate(POINT)), "idx int, w double")
    models = [TableModel(places, POINT_BIAS, loss, len(POINT)) for loss in ("logistic", "hinge")]
    counted = table_confusion(joined.identified(prepare(rows, 4, sampled=False).df), models)
    return counted.withColumnRenamed("model", "config_id")


# --- stopping inside the fit ------------------------------------------------------------------------

STOPPING = ("simple", "momentum", "nesterov", "adam", "rmsprop")
CONVERGING_STEPS, TOLERANCE = 10, 0.2


def _stopped_rows(spark, results: Sequence[FitResult]) -> DataFrame:
    rows = [
        (r.config.updater, r.stop_reason, len(r.steps), j, float(w)) for r in results for j, w in enumerate(r.model.weights)
    ]
    table = spark.createDataFrame(rows, "updater string, stop_reason string, steps int, idx int, w double")
    return table.withColumn("w", rounded(F.col("w")))


def train_lr_early_stop(spark, folder):
    """Fits that end when the validation loss does not fall, with the weights they return."""
    configs = [
        training_config(
            updater=u, step_size=RESTLESS_STEP, num_iterations=STOP_STEPS, validation_split=SPLIT, iter_validation=1
        )
        for u in STOPPING
    ]
    return _stopped_rows(spark, fit(lineitem_set(spark, folder), configs, num_features=4))


def train_lr_converged(spark, folder):
    """Fits that end when their weights hardly change."""
    configs = [
        training_config(updater=u, num_iterations=CONVERGING_STEPS, convergence_tol=TOLERANCE) for u in STOPPING
    ]
    return _stopped_rows(spark, fit(lineitem_set(spark, folder), configs, num_features=4))


# --- the public functions and estimators with their defaults ------------------------------------------

API_STEPS = 10


def api_train_logistic(spark, folder):
    return result_rows(spark, [train_logistic(lineitem_set(spark, folder), API_STEPS)])


def api_train_svm(spark, folder):
    return result_rows(spark, [train_svm(lineitem_set(spark, folder), API_STEPS)])


def api_logistic_estimator(spark, folder):
    estimator = LogisticRegression()
    estimator.config = estimator.config.with_(num_iterations=API_STEPS)
    return result_rows(spark, [estimator.run(lineitem_set(spark, folder))])


def api_svm_estimator(spark, folder):
    estimator = LinearSvm()
    estimator.config = estimator.config.with_(num_iterations=API_STEPS, reg_type=L2)
    return result_rows(spark, [estimator.run(lineitem_set(spark, folder), initial_weights=list(POINT))])


EXPERIMENT = {"updater_id": 6, "rate": 0.2, "fraction": 1.0, "iterations": 5, "algorithm": "lr"}


def experiment_run(spark, folder):
    """A named experiment over line items written as the LIBSVM files of a pair: its run row and last loss."""
    path = shared_folder(spark, f"experiment-{uuid.uuid4().hex}")
    parts = sampling.train_validation(lineitem_set(spark, folder), SPLIT)
    for rows, name in zip(parts, DATASETS["svmguide"][:2]):
        to_libsvm_lines(rows).write.text(f"{path}/{name}")
    found = named_experiment(spark, path, "svmguide", **EXPERIMENT)
    last = found.history.filter(F.col("iteration") == EXPERIMENT["iterations"])
    return found.runs.join(last.select("run_id", "loss"), "run_id").select(
        "updater",
        "alg",
        "iterations",
        "stop_reason",
        rounded(F.col("loss")).alias("loss"),
        rounded(F.col("train_acc")).alias("train_acc"),
        rounded(F.col("test_acc")).alias("test_acc"),
    )


# --- weights as a table -----------------------------------------------------------------------------


def predict_sparse_join(spark, folder):
    """As ``predict_sparse``, by a model whose weights are a table."""
    pattern = ((F.col("id") % 7 - 3) / 10.0).alias("w")
    weights = spark.range(BUCKETS).select(F.col("id").cast("int").alias("idx"), pattern)
    scored = TableModel(weights, 0.05, "logistic", BUCKETS).transform(document_set(spark, folder))
    return scored.select("row_key", "label", rounded(F.col("probability")).alias("probability"), "prediction")


def feat_std_scale_rows_sparse(spark, folder, scale=features.scaled):
    rows = settled(document_set(spark, folder))
    scaled = scale(rows, features.column_stddev(rows, BUCKETS), BUCKETS)
    entries = scaled.select("row_key", F.inline(F.arrays_zip("idx", "val")))
    return entries.select("row_key", "idx", rounded(F.col("val")).alias("x"))


def feat_std_scale_rows_join(spark, folder):
    """As ``feat_std_scale_rows_sparse``, by the form for more features than may be broadcast."""
    return feat_std_scale_rows_sparse(spark, folder, features.scaled_by_join)


SPARSE_RATES = (0.01, 0.1)


def sweep_runs_sparse(spark, folder):
    """A sweep over bags of words; the width is found in the training part, the test part may go beyond it."""
    train, test = sampling.train_validation(settled(document_set(spark, folder)), SPLIT)
    configs = [training_config(updater="simple", step_size=rate) for rate in SPARSE_RATES]
    found = sweep(train, test, configs)
    return found.runs.select(
        "run_id",
        rounded(F.col("rate")).alias("rate"),
        rounded(F.col("train_acc")).alias("train_acc"),
        rounded(F.col("test_acc")).alias("test_acc"),
    )


def all_queries() -> dict[str, Query]:
    plain = [
        src_training_set, src_libsvm, feat_append_bias, feat_std_scale, feat_std_scale_sparse,
        feat_unscale_weights, val_binary_label, val_feature_width, sample_minibatch, split_validation,
        grad_logistic_dense64, grad_logistic_sparse, grad_logistic_join, loss_validation, reg_value, ctl_convergence,
        ctl_early_stop, history_last10, predict_lr, predict_svm, predict_dense64, predict_sparse,
        eval_accuracy, eval_confusion, eval_majority, sweep_grid, sweep_best_rate, sweep_curves,
        sweep_best_curves, parse_run_log_runs, parse_run_log_text, log_best_rate, sample_unkeyed, val_features,
        eval_confusion_many, eval_confusion_join, train_lr_plugged, feat_std_scale_rows_join, train_lr_early_stop, train_lr_converged, api_train_logistic, api_train_svm,
        api_logistic_estimator, api_svm_estimator, experiment_run, predict_sparse_join, feat_std_scale_rows_sparse, sweep_runs_sparse,
    ]
    found: dict[str, Query] = {q.__name__: q for q in plain}
    found["parse_run_log"] = parse_run_log_history
    found["grad_logistic"] = _gradient_query("logistic")
    found["grad_hinge"] = _gradient_query("hinge")
    found["sweep_runs"] = _sweep_runs("logistic")
    found["sweep_runs_svm"] = _sweep_runs("hinge")
    for name, changes in update_cases().items():
        found[name] = _update_query(SgdConfig(**({"updater": "simple", "step_size": STEP} | changes)))
    for name, changes in training_cases().items():
        found[name] = _train_query(**changes)
    for updater in ("adam", "nesterov"):
        found[f"train_lr_resumed_{updater}"] = _resumed_query(updater=updater)
    found["train_lr_dense64"] = _train_query(embedding_set, 64, updater="adam")
    found["train_lr_sparse"] = _train_query(document_set, BUCKETS, updater="simple", step_size=0.01)
    found["train_lr_sparse_join"] = _train_query(
        document_set, BUCKETS, "join", updater="simple", step_size=0.01
    )
    return found


def update_cases() -> dict[str, dict]:
    """Settings of the two-step update queries."""
    cases = {f"upd_{u}": {"updater": u} for u in UPDATER_NAMES}
    cases |= {f"upd_{u}_standard": {"updater": u, "semantics": "standard"} for u in STANDARD_FORMS}
    cases["reg_none"] = {"reg_type": 0, "reg_param": REG}
    cases["reg_l1"] = {"reg_type": L1, "reg_param": REG}
    cases["reg_l2"] = {"reg_type": L2, "reg_param": REG}
    cases["reg_decay"] = {"decay": True}
    return cases


def training_cases() -> dict[str, dict]:
    """Settings of the training queries over the line items."""
    long = {"num_iterations": LONG_STEPS}
    cases = {f"train_lr_{u}": {"updater": u} for u in UPDATER_NAMES}
    cases |= {f"train_lr_{u}": {"updater": u} | long for u in ("adam", "nadam", "amsgrad", "nesterov")}
    cases |= {f"train_lr_{u}_standard": {"updater": u, "semantics": "standard"} for u in STANDARD_FORMS}
    cases["train_svm_simple"] = {"loss": "hinge"}
    cases["train_svm_adam"] = {"loss": "hinge", "updater": "adam"} | long
    cases["train_lr_adam_l1"] = {"updater": "adam", "reg_type": L1, "reg_param": REG}
    cases["train_lr_nesterov_l2"] = {"updater": "nesterov", "reg_type": L2, "reg_param": REG}
    cases["train_lr_adagrad_decay_l2"] = {"updater": "adagrad", "reg_type": L2, "reg_param": REG, "decay": True}
    cases["train_lr_adamax_l2"] = {"updater": "adamax", "reg_type": L2, "reg_param": REG}
    cases["train_lr_l1"] = {"reg_type": L1, "reg_param": REG}
    cases["train_lr_l2"] = {"reg_type": L2, "reg_param": REG, "updater": "momentum"}
    cases["train_lr_decay"] = {"decay": True, "updater": "adagrad"}
    cases["train_lr_intercept"] = {"intercept": True}
    cases["train_lr_minibatch"] = {"mini_batch_fraction": BATCH, "updater": "nesterov"}
    cases["train_lr_validated"] = {
        "mini_batch_fraction": BATCH, "validation_split": SPLIT, "updater": "rmsprop", "intercept": True,
    }
    cases["train_lr_scaled"] = {"scale": True, "intercept": True}
    return cases
