"""The folder that all executors of a cluster see, and what is kept there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``.

    Where the setting is unset, a local master gets a folder of its own; a cluster does not, since
    a machine-local folder would be lost with its machine.
    """
    context = spark.sparkContext
    current = context.getCheckpointDir()
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named and not current:
        context.setCheckpointDir(named)
    if not named and not current:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="slopeworks-"))
    return (named or context.getCheckpointDir()).rstrip("/")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A path for a written table under the shared folder."""
    return f"{shared_root(spark)}/{name}"


def settled(df: DataFrame) -> DataFrame:
    """The table as computed now, kept in the shared folder: its lineage ends there and the loss of
    an executor neither recomputes nor changes it."""
    shared_root(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """The table kept in the shared folder like ``settled``, with its path, so that it can be removed once a
    later one takes its place."""
    spark = df.sparkSession
    path = shared_folder(spark, f"{name}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def removed(spark: SparkSession, path: str) -> None:
    """Delete a table made by ``written``."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
