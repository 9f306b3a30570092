"""Training sets made from the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from slopeworks.sources.training import dense_set, sparse_set

LINEITEM_KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
# Number of hash buckets of the bag-of-words features.
BUCKETS = 4096


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def lineitem_set(spark: SparkSession, folder: str) -> DataFrame:
    """Dense, 4 features: is the discounted price above 50,000?"""
    return dense_set(
        read(spark, folder, "lineitem"),
        "l_extendedprice * (1 - l_discount) > 50000",
        ["l_quantity / 50", "l_extendedprice / 1e5", "l_discount * 10 + 0e0", "l_tax * 10 + 0e0"],
        LINEITEM_KEY,
    )


def embedding_set(spark: SparkSession, folder: str) -> DataFrame:
    """Dense, 64 features: is the class below 5?"""
    return dense_set(read(spark, folder, "embeddings"), "label < 5", "embedding", ["vec_id"])


def document_set(spark: SparkSession, folder: str, label: str = "toxic") -> DataFrame:
    """Sparse bag of hashed words of the labelled documents, over their whole texts.

    Words are counted per (document, bucket) with partial aggregation before anything is gathered,
    and a document gathers at most one entry per bucket, however long its text is.
    """
    documents = read(spark, folder, "documents").select("doc_id", "text")
    labels = read(spark, folder, "labels").select("doc_id", F.col(label).alias("y"))
    labelled = documents.join(labels, "doc_id")
    words = labelled.select("doc_id", "y", F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("word"))
    bucket = F.conv(F.substring(F.md5("word"), 1, 8), 16, 10).cast("bigint") % BUCKETS
    counts = (
        words.filter("word <> ''")
        .groupBy("doc_id", "y", bucket.cast("int").alias("idx"))
        .agg(F.count(F.lit(1)).cast("double").alias("val"))
    )
    entries = F.array_sort(F.collect_list(F.struct("idx", "val")))
    rows = counts.groupBy("doc_id", "y").agg(entries.alias("e"))
    return sparse_set(rows, F.col("y"), F.col("e.idx"), F.col("e.val"), ["doc_id"])
