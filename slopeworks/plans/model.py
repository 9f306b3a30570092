"""Trained linear classifiers."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slopeworks.functions.losses import link_of
from slopeworks.operators.features import NARROW_WIDTH, is_sparse


@dataclass(frozen=True, eq=False)
class LinearModel:
    """Weights and intercept of a binary classifier; ``loss`` decides how margins become classes.

    ``threshold`` is the score above which class 1 is predicted: 0.5 on the probability of a
    logistic model, 0 on the margin of an SVM.  Ties and NaN give class 0.
    """

    weights: np.ndarray
    intercept: float = 0.0
    loss: str = "logistic"
    threshold: float | None = None

    @property
    def num_features(self) -> int:
        return len(self.weights)

    @property
    def cut(self) -> float:
        return cut_of(self.loss, self.threshold)

    def __repr__(self) -> str:
        return (
            f"{type(self).__name__}(loss={self.loss}, intercept={self.intercept}, "
            f"num_features={self.num_features}, threshold={self.cut})"
        )

    def margin(self, df: DataFrame) -> Column:
        """w.x + b as a column of a canonical training table."""
        if not is_sparse(df) and self.num_features <= NARROW_WIDTH:
            total = F.lit(0.0)
            for j, w in enumerate(self.weights):
                term = F.col("features")[j] * F.lit(float(w))
                total = term if j == 0 else total + term
            return total + F.lit(float(self.intercept))
        columns = ["idx", "val"] if is_sparse(df) else ["features"]
        return _margin_udf(self.weights, float(self.intercept), columns)(*columns)

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``margin``, ``probability`` (logistic only) and ``prediction``.  A row without a vector has
        a null margin and class 0."""
        return with_prediction(df.withColumn("margin", self.margin(df)), self.loss, self.cut)

    def predict_one(self, features: Sequence[float]) -> float:
        margin = float(np.dot(self.weights, np.asarray(features, dtype=float))) + self.intercept
        return prediction_of(margin, self.loss, self.cut)

    def params(self, spark: SparkSession) -> DataFrame:
        """``(idx int, w double, is_intercept boolean)``; the intercept has the last index."""
        idx = np.arange(self.num_features + 1, dtype=np.int32)
        table = pa.table(
            {
                "idx": pa.array(idx, pa.int32()),
                "w": pa.array(np.append(self.weights, self.intercept), pa.float64()),
                "is_intercept": pa.array(idx == self.num_features),
            }
        )
        return spark.createDataFrame(table)

    def save(self, spark: SparkSession, path: str) -> None:
        about = F.lit(self.loss).alias("loss"), F.lit(float(self.cut)).alias("threshold")
        self.params(spark).select("*", *about).write.mode("overwrite").parquet(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> "LinearModel":
        table = spark.read.parquet(path).toArrow().sort_by("idx")
        w = table["w"].to_numpy()
        return LinearModel(
            w[:-1].copy(), float(w[-1]), table["loss"][0].as_py(), table["threshold"][0].as_py()
        )


def cut_of(loss: str, threshold: float | None) -> float:
    """The score above which class 1 is predicted."""
    if threshold is not None:
        return threshold
    return 0.5 if link_of(loss) == "sigmoid" else 0.0


def _score(margin: Column, loss: str) -> Column:
    return 1.0 / (1.0 + F.exp(-margin)) if link_of(loss) == "sigmoid" else margin


def _class(score: Column, cut: float) -> Column:
    # NaN sorts above every number in Spark, so it is named
    return F.when((score > F.lit(cut)) & ~F.isnan(score), 1.0).otherwise(0.0)


def predicted(margin: Column, loss: str, cut: float) -> Column:
    """The class of a margin; 0 where it is null or NaN."""
    return _class(_score(margin, loss), cut)


def with_prediction(scored: DataFrame, loss: str, cut: float) -> DataFrame:
    """Adds ``probability`` (logistic only) and ``prediction`` to a table with ``margin``."""
    score = F.col("margin")
    if link_of(loss) == "sigmoid":
        scored = scored.withColumn("probability", _score(score, loss))
        score = F.col("probability")
    return scored.withColumn("prediction", _class(score, cut))


def prediction_of(margin: float, loss: str, cut: float) -> float:
    if link_of(loss) == "sigmoid":
        with np.errstate(over="ignore"):
            margin = float(1.0 / (1.0 + np.exp(-margin)))
    return 1.0 if margin > cut else 0.0


def _margin_udf(weights: np.ndarray, intercept: float, columns: list[str]):
    """Vectorized margin for rows too wide for one expression per feature; null for a row without one."""
    if len(columns) == 1:

        def dense(features: pa.Array) -> pa.Array:
            held = features.is_valid()
            block = features.filter(held).flatten().to_numpy(zero_copy_only=False)
            if len(block) != held.true_count * len(weights):
                raise ValueError(f"rows do not have {len(weights)} features each")
            margins = np.full(len(features), np.nan)
            margins[held.to_numpy(zero_copy_only=False)] = block.reshape(-1, len(weights)) @ weights + intercept
            return pa.array(margins, mask=~held.to_numpy(zero_copy_only=False))

        return F.arrow_udf(dense, "double")

    def sparse(idx: pa.Array, val: pa.Array) -> pa.Array:
        missing = ~(idx.is_valid().to_numpy(zero_copy_only=False) & val.is_valid().to_numpy(zero_copy_only=False))
        lengths = pa.compute.fill_null(pa.compute.list_value_length(idx), 0).to_numpy(zero_copy_only=False)
        row_of = np.repeat(np.arange(len(idx)), np.where(missing, 0, lengths))
        kept = pa.array(~missing)
        at, value = idx.filter(kept).flatten().to_numpy(), val.filter(kept).flatten().to_numpy()
        inside = (at >= 0) & (at < len(weights))
        sums = np.bincount(row_of[inside], weights=value[inside] * weights[at[inside]], minlength=len(idx))
        return pa.array(sums + intercept, mask=missing)

    return F.arrow_udf(sparse, "double")
