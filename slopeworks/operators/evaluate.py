"""Accuracy and confusion counts of scored tables and of many models at once."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slopeworks.functions.losses import link_of
from slopeworks.operators.features import MAX_DRIVER_VALUES
from slopeworks.operators.gradient import DENSE_CHUNK, Rows, margins_of


def confusion(scored: DataFrame) -> DataFrame:
    """``(label, prediction, n)`` of a scored table."""
    return scored.groupBy("label", "prediction").agg(F.count(F.lit(1)).alias("n"))


def accuracy(scored: DataFrame) -> DataFrame:
    """Share of rows whose prediction equals the label, as one row."""
    return scored.agg(F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy"))


def majority_accuracy(df: DataFrame) -> DataFrame:
    """Accuracy of always answering the most frequent label."""
    sizes = df.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg((F.max("n") / F.sum("n")).alias("accuracy"))


def confusion_of(rows: Rows, models: Sequence) -> DataFrame:
    """``(config_id, label, prediction, n)`` for many models in one pass over a prepared table.

    Labels are told apart as they are, null among them; every task sends two counts per label and model.
    """
    weights = np.array([m.weights for m in models])
    if weights.size > MAX_DRIVER_VALUES:
        raise ValueError(f"{weights.shape} weights exceed the broadcast bound of {MAX_DRIVER_VALUES}")
    bias = np.array([m.intercept for m in models])
    cuts = np.array([m.cut for m in models])
    log_odds = np.array([link_of(m.loss) == "sigmoid" for m in models])
    kind = rows.kind

    def count(batches):
        # Per label (as it is, null apart) and model: how many rows were said to be 0 and 1.
        total: dict[float | None, np.ndarray] = {}
        with np.errstate(all="ignore"):
            for whole in batches:
                step = max(1, DENSE_CHUNK // len(cuts))
                for start in range(0, whole.num_rows, step):
                    batch = whole.slice(start, step)
                    score = margins_of(batch, kind, weights, bias)
                    score = np.where(log_odds, 1.0 / (1.0 + np.exp(-score)), score)
                    said = score > cuts
                    labels = batch.column("label")
                    for label in labels.unique().to_pylist():
                        among = said[_equal(labels, label)]
                        ones = among.sum(axis=0)
                        key = None if label is None else label + 0.0
                        total.setdefault(key, np.zeros((len(cuts), 2), np.int64))
                        total[key] += np.stack([len(among) - ones, ones], axis=1)
        for label, sums in total.items():
            config, prediction = np.nonzero(sums)
            yield pa.RecordBatch.from_pydict(
                {
                    "config_id": pa.array(config, pa.int32()),
                    "label": pa.array([label] * len(config), pa.float64()),
                    "prediction": pa.array(prediction, pa.float64()),
                    "n": pa.array(sums[config, prediction], pa.int64()),
                }
            )

    counts = rows.df.select("label", *rows.vector_columns()).mapInArrow(
        count, "config_id int, label double, prediction double, n bigint"
    )
    return counts.groupBy("config_id", "label", "prediction").agg(F.sum("n").alias("n"))


def _equal(labels: pa.Array, label: float | None) -> np.ndarray:
    if label is None:
        return labels.is_null().to_numpy(zero_copy_only=False)
    values = labels.to_numpy(zero_copy_only=False)
    own = np.isnan(values) & labels.is_valid().to_numpy(zero_copy_only=False) if label != label else values == label
    return own


def accuracy_of(rows: Rows, models: Sequence) -> DataFrame:
    """``(config_id, accuracy)`` for many models in one pass."""
    known = confusion_of(rows, models).filter(F.col("label").isNotNull())  # as in ``accuracy``
    hits = F.sum(F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0))
    return known.groupBy("config_id").agg((hits / F.sum("n")).alias("accuracy"))
