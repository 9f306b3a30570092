"""Mini-batches and the validation split as table operators, for tables with a ``row_key``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slopeworks.functions.sampling import in_batch, in_validation, key_word


def minibatch(df: DataFrame, iteration: int, fraction: float) -> DataFrame:
    """Rows of the mini-batch of a 1-based iteration; a narrow filter, no shuffle."""
    return df.filter(in_batch(key_word(F.col("row_key")), iteration, fraction))


def with_split(df: DataFrame, split: float) -> DataFrame:
    """Marks the validation rows in ``held_out``."""
    return df.withColumn("held_out", in_validation(key_word(F.col("row_key")), split))


def train_validation(df: DataFrame, split: float) -> tuple[DataFrame, DataFrame]:
    """Training and validation rows."""
    held = in_validation(key_word(F.col("row_key")), split)
    return df.filter(~held), df.filter(held)
