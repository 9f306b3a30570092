"""Validation, bias and scaling of training tables."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slopeworks.shared import settled

# Up to this many dense features, one column per feature beats one array per row.
NARROW_WIDTH = 32
# Largest number of weights, over all configurations, that may sit on the driver or be broadcast
# (40 MB of doubles); beyond it weights stay a table.
MAX_DRIVER_VALUES = 5_000_000


def is_sparse(df: DataFrame) -> bool:
    return "idx" in df.columns


def append_bias(df: DataFrame) -> DataFrame:
    """The constant 1.0 as last feature of a dense table."""
    return df.withColumn("features", F.concat("features", F.array(F.lit(1.0))))


def label_is_binary(label: Column) -> Column:
    return F.coalesce(label.isin(0.0, 1.0), F.lit(False))


def bad_labels(df: DataFrame) -> DataFrame:
    """Rows whose label is neither 0 nor 1, with null counted as bad."""
    return df.filter(~label_is_binary(F.col("label")))


def row_width(df: DataFrame) -> Column:
    """Features of a row: the array's size, or the largest stored index + 1; null without any."""
    if is_sparse(df):
        return F.when(F.col("idx").isNotNull() & F.col("val").isNotNull(), F.coalesce(F.array_max("idx") + 1, F.lit(0)))
    return F.size("features")


def bad_vector(df: DataFrame) -> Column:
    """Whether a row's vector is unclean: a null element, or in sparse form a null or negative index, a
    null value, or index and value lists of unequal length.  A row without a vector is not unclean but
    missing."""
    if is_sparse(df):
        broken = (F.size("idx") != F.size("val")) | F.exists("idx", lambda i: i.isNull() | (i < 0))
        return F.coalesce(broken | F.exists("val", lambda x: x.isNull()), F.lit(False))
    return F.coalesce(F.exists("features", lambda x: x.isNull()), F.lit(False))


def cleaned(df: DataFrame, unclean: Column) -> list[Column]:
    """The vector columns with one meaning for unclean rows in every layout: a null element or value is
    0, and entries with a null or negative index, or without a partner, are not there."""
    if not is_sparse(df):
        whole = F.transform("features", lambda x: F.coalesce(x, F.lit(0.0)))
        return [F.when(unclean, whole).otherwise(F.col("features")).alias("features")]
    pairs = F.filter(
        F.arrays_zip("idx", "val"), lambda e: e["idx"].isNotNull() & (e["idx"] >= 0) & e["val"].isNotNull()
    )
    return [F.when(unclean, pairs[c]).otherwise(F.col(c)).alias(c) for c in ("idx", "val")]


def width_summary(df: DataFrame) -> DataFrame:
    """Row count, bad labels, rows without features and feature widths, in one aggregate."""
    return _summary(df.select("label", row_width(df).alias("length")))


def unclean_counts(df: DataFrame) -> DataFrame:
    """``n_bad_labels, n_missing, n_bad_vectors, n_no_key`` of a training table, in one aggregate."""
    key = F.col("row_key").isNull() if "row_key" in df.columns else F.lit(False)
    rows = df.select("label", row_width(df).alias("length"), bad_vector(df).alias("unclean"), key.alias("no_key"))
    return rows.agg(*_bad_rows("label", "length"), *_unclean_rows())


def _bad_rows(label: str, length: str) -> list[Column]:
    return [
        F.count_if(~label_is_binary(F.col(label))).alias("n_bad_labels"),
        F.count_if(F.col(length).isNull()).alias("n_missing"),
    ]


def _unclean_rows() -> list[Column]:
    return [F.count_if("unclean").alias("n_bad_vectors"), F.count_if("no_key").alias("n_no_key")]


def _summary(df: DataFrame) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        *_bad_rows("label", "length"),
        F.min("length").alias("min_width"),
        F.max("length").alias("max_width"),
        *(_unclean_rows() if "unclean" in df.columns else []),
    )


@dataclass(frozen=True)
class Shape:
    n_rows: int
    width: int


def first_width(df: DataFrame) -> int:
    """Feature count of the first row of a dense table; 0 for an empty one."""
    row = df.select(row_width(df).alias("length")).first()
    return 0 if row is None or row["length"] is None else row["length"]


def checked_shape(prepared: DataFrame, sparse: bool, width: int | None, validate: bool) -> Shape:
    """Count a prepared table and turn bad labels, vectors, keys or widths into errors, in one pass.

    A sparse table without a given width is as wide as its largest index.
    """
    row = _summary(prepared).first().asDict()
    if row["n_rows"] == 0:
        return Shape(0, width or 0)
    if validate:
        for name, what in (
            ("n_bad_labels", "labels are not 0 or 1"),
            ("n_bad_vectors", "rows have null elements, null or negative indices, or lists of unequal length"),
            ("n_no_key", "rows have no key"),
        ):
            if row.get(name):
                raise ValueError(f"Input validation failed. {row[name]} {what}")
    if row["n_missing"]:
        raise ValueError(f"{row['n_missing']} rows have no features")
    width = width if width is not None else row["max_width"]
    if row["max_width"] > width or (not sparse and row["min_width"] != width):
        raise ValueError(f"feature widths run from {row['min_width']} to {row['max_width']}, expected {width}")
    return Shape(row["n_rows"], width)


def column_stddev(df: DataFrame, width: int, n_rows: int | None = None) -> DataFrame:
    """Sample standard deviation per feature as ``(idx int, sd double)``.

    Narrow dense tables need one aggregate row.  Otherwise entries are summed per index with
    partial aggregation; absent entries enter as zeros by the parallel-variance identity, so a
    sparse table is never widened.
    """
    spark = df.sparkSession
    narrow = "x0" in df.columns  # a prepared narrow table
    if narrow or (not is_sparse(df) and width <= NARROW_WIDTH):
        value = (lambda j: F.col(f"x{j}")) if narrow else (lambda j: F.col("features")[j])
        stats = df.agg(*[F.stddev_samp(value(j)).alias(f"sd{j}") for j in range(width)])
        pairs = F.array(*[F.struct(F.lit(j).alias("idx"), F.col(f"sd{j}").alias("sd")) for j in range(width)])
        return stats.select(F.inline(pairs))
    if is_sparse(df):
        entries = df.select(F.inline(F.arrays_zip(F.col("idx"), F.col("val"))).alias("idx", "x"))
    else:
        entries = df.select(F.posexplode("features").alias("idx", "x"))
    n = df.count() if n_rows is None else n_rows
    moments = entries.groupBy("idx").agg(
        F.count("x").alias("k"), F.avg("x").alias("mean"), F.var_pop("x").alias("var")
    )
    k, absent = F.col("k"), F.lit(float(n)) - F.col("k")
    squares = k * F.col("var") + F.col("mean") * F.col("mean") * k * absent / F.lit(float(n))
    seen = moments.select("idx", F.sqrt(F.greatest(squares, F.lit(0.0)) / F.lit(float(max(n - 1, 1)))).alias("sd"))
    every = spark.range(width).select(F.col("id").cast("int").alias("idx"))
    return every.join(seen, "idx", "left").select("idx", F.coalesce("sd", F.lit(0.0)).alias("sd"))


def inverse_sd(sd: np.ndarray) -> np.ndarray:
    """1/sd with 0 for a constant column."""
    known = np.array([0.0 if v is None or math.isnan(v) else float(v) for v in sd])
    return np.where(known > 0, 1.0 / np.where(known > 0, known, 1.0), 0.0)


def scaled(df: DataFrame, sd: DataFrame, width: int) -> DataFrame:
    """Features divided by their standard deviation; constant columns become 0.

    Up to the bound of a driver vector the factors are broadcast to vectorised functions; beyond it entries
    meet their deviation by a join on the index.  Training does not use this: it scales the weights and the
    gradient instead of the rows.
    """
    if width > MAX_DRIVER_VALUES:
        return scaled_by_join(df, sd, width)
    factors = df.sparkSession.sparkContext.broadcast(inverse_sd(collect_vector(sd, "sd", width)))
    if is_sparse(df):

        def entries(idx: pa.Array, val: pa.Array) -> pa.Array:
            at = idx.flatten().to_numpy(zero_copy_only=False)
            known = np.append(factors.value, 0.0)[np.where(at < width, at, width)]
            values = pa.array(val.flatten().to_numpy(zero_copy_only=False) * known)
            return _with_lists_of(val, values)

        return df.withColumn("val", F.arrow_udf(entries, "array<double>")("idx", "val"))

    def dense(rows: pa.Array) -> pa.Array:
        values = rows.flatten().to_numpy(zero_copy_only=False).reshape(-1, width) * factors.value
        return _with_lists_of(rows, pa.array(values.ravel()))

    return df.withColumn("features", F.arrow_udf(dense, "array<double>")("features"))


def _with_lists_of(lists: pa.Array, values: pa.Array) -> pa.Array:
    """``values`` cut like the lists, null where they are null."""
    lengths = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    ends = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
    return pa.ListArray.from_arrays(ends, values, mask=lists.is_null())


def scaled_by_join(df: DataFrame, sd: DataFrame, width: int) -> DataFrame:
    """Entries meet the deviations of their index block, part by part of a grid; a row's entries come together
    again and join back to the row, which is kept in the shared folder and never meets the deviations."""
    from slopeworks.operators.joined import grid_of, met_by_part, places_of, sparse_form

    sparse = is_sparse(df)
    kept = settled(df.withColumn("row_id", F.monotonically_increasing_id()))
    slim = sparse_form(kept).select("row_id", "idx", "val")
    grid = grid_of(slim, width)
    entries = slim.select("row_id", F.posexplode(F.arrays_zip("idx", "val")).alias("place", "e")).select("row_id", "place", "e.*")
    part = grid.part(F.coalesce("idx", F.lit(0)), F.col("row_id")).alias("part")

    def divided(own: pa.Table, other: pa.Table) -> pa.Table:
        at, there = places_of(own["idx"].fill_null(-1).to_numpy(), other["idx"].to_numpy())
        factors = np.where(there, inverse_sd(other["sd"].to_numpy())[at], 0.0) if other.num_rows else np.zeros(len(at))
        values = pa.compute.multiply(own["val"].combine_chunks(), pa.array(factors))
        return pa.table([own["row_id"], own["place"], own["idx"], values], names=["row_id", "place", "idx", "val"])

    schema = "row_id long, place int, idx int, val double"
    met = met_by_part(entries.select(part, "row_id", "place", "idx", "val"), sd.select("idx", "sd"), grid, divided, schema)
    lists = met.groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct("place", "idx", "val"))).alias("e"))
    others = [c for c in df.columns if c not in ("idx", "val", "features")]
    none = F.array().cast("array<double>")
    if sparse:
        vector = [F.when(F.col("idx").isNotNull(), F.coalesce(f"e.{c}", none.cast(f"array<{t}>"))).alias(c) for c, t in (("idx", "int"), ("val", "double"))]
    else:
        vector = [F.when(F.col("features").isNotNull(), F.coalesce("e.val", none)).alias("features")]
    return kept.join(lists, "row_id", "left").select(*others, *vector).select(*df.columns)


def unscaled_weights(params: DataFrame, sd: DataFrame) -> DataFrame:
    """Weights ``(idx, w)`` brought back to the original feature space; an index without a
    standard deviation (the intercept) stays as it is."""
    divided = F.when(F.col("sd").isNull(), F.col("w")).when(F.col("sd") == 0.0, F.lit(0.0))
    return params.join(sd, "idx", "left").select("idx", divided.otherwise(F.col("w") / F.col("sd")).alias("w"))


def collect_vector(table: DataFrame, column: str, width: int) -> np.ndarray:
    """A per-feature table as one driver vector of a checked width."""
    if width > MAX_DRIVER_VALUES:
        raise ValueError(f"{width} features do not fit a driver vector (limit {MAX_DRIVER_VALUES})")
    found = table.select("idx", column).toArrow()
    out = np.zeros(width)
    out[found["idx"].to_numpy()] = found[column].to_numpy()
    return out
