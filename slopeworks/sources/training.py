"""Training tables.

Canonical shapes, with an optional string ``row_key`` for reproducible sampling:

* dense:  ``label double, features array<double>``
* sparse: ``label double, idx array<int>, val array<double>`` (0-based idx, absent index = 0)
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slopeworks.functions.sampling import row_key


def _expr(value: str | Column) -> Column:
    return F.expr(value) if isinstance(value, str) else value


def _keyed(columns: list[Column], key: Sequence[str] | None) -> list[Column]:
    return columns + ([row_key(*key).alias("row_key")] if key else [])


def dense_set(
    df: DataFrame,
    label: str | Column,
    features: str | Column | Sequence[str | Column],
    key: Sequence[str] | None = None,
) -> DataFrame:
    """Label and features from expressions; only the columns they name are scanned.

    ``features`` is one array expression or a list of numeric expressions.  ``key`` names the
    columns that together identify a row.
    """
    if isinstance(features, (str, Column)):
        vector = _expr(features).cast("array<double>")
    else:
        vector = F.array(*[_expr(f).cast("double") for f in features])
    return df.select(*_keyed([_expr(label).cast("double").alias("label"), vector.alias("features")], key))


def sparse_set(
    df: DataFrame,
    label: str | Column,
    idx: str | Column,
    val: str | Column,
    key: Sequence[str] | None = None,
) -> DataFrame:
    """Label and stored entries from expressions."""
    columns = [
        _expr(label).cast("double").alias("label"),
        _expr(idx).cast("array<int>").alias("idx"),
        _expr(val).cast("array<double>").alias("val"),
    ]
    return df.select(*_keyed(columns, key))


def vector_set(
    df: DataFrame, label: str = "label", features: str = "features", key: Sequence[str] | None = None
) -> DataFrame:
    """Sparse table from a column of Spark ML vectors, without widening the sparse ones."""
    parts = F.unwrap_udt(F.col(features))
    values = parts.getField("values")
    positions = F.coalesce(
        parts.getField("indices"),
        F.transform(values, lambda _, i: i.cast("int")),
    )
    return sparse_set(df, F.col(label), positions, values, key)

