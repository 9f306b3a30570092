"""LIBSVM text files and the named train/test pairs."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slopeworks.sources.training import vector_set

# File names of the known pairs, their feature counts and their natural shape.
DATASETS = {
    "adult": ("a9a", "a9at", 123, "sparse"),
    "mushroom": ("mushroom-small", "mushroom-small-t", 112, "sparse"),
    "svmguide": ("svmguide1", "svmguide1.t", 4, "dense"),
    "susy": ("susy_s", "susyt_s", 18, "dense"),
}


def read_libsvm(
    spark: SparkSession, path: str, num_features: int | None = None, dense: bool = False
) -> DataFrame:
    """Read ``label index:value ...`` lines (1-based indices) as a sparse or dense table.

    Give ``num_features`` for any file that is paired with another: the width found in one file
    may be smaller, and finding it costs a pass over the text.
    """
    reader = spark.read.format("libsvm")
    if num_features is not None:
        reader = reader.option("numFeatures", num_features)
    rows = reader.load(path)
    if dense:
        return rows.select("label", vector_to_array(F.col("features")).alias("features"))
    return vector_set(rows)


def dataset_pair(spark: SparkSession, name: str, folder: str) -> tuple[DataFrame, DataFrame, int]:
    """Train table, test table and width of a named pair under a folder."""
    if name not in DATASETS:
        raise ValueError(f"unknown dataset {name!r}; known: {', '.join(DATASETS)}")
    train, test, width, shape = DATASETS[name]
    train_df, test_df = (
        read_libsvm(spark, f"{folder.rstrip('/')}/{file}", width, dense=shape == "dense")
        for file in (train, test)
    )
    return train_df, test_df, width


def to_libsvm_lines(df: DataFrame) -> DataFrame:
    """A dense table as LIBSVM text lines (zero entries left out)."""
    entries = F.transform("features", lambda x, i: F.struct((i + 1).alias("i"), x.alias("x")))
    stored = F.filter(entries, lambda e: e["x"] != 0.0)
    words = F.transform(stored, lambda e: F.concat(e["i"].cast("string"), F.lit(":"), e["x"].cast("string")))
    return df.select(F.concat_ws(" ", F.col("label").cast("string"), F.array_join(words, " ")).alias("value"))
