"""Operator 13: exact duplicates by a persistent index of digests, bucketed and sorted by digest.

Two texts are equal if they are the same after each run of white space (``[\\x20\\x09-\\x0D]+``) has become one
space; null is empty.  A text's digest is the SHA-256 of that form.  The index is a table in files: a folder
for each delivery, in it ``digest, keep_id`` once for every digest that no earlier delivery had, bucketed and
sorted by digest.  ``add`` reduces new data to one row a digest, drops by a sort-merge anti-join what the
index has (the index side is read in its buckets, not shuffled), and appends the rest.  ``resolve`` names the
row that stays for any rows of deliveries added.

* A null id comes after all others; of repeated rows (one id, one text) exactly one stays.
* An empty table appends nothing; empty texts are equal to each other and to null, not to one space.
* Texts are hashed whole, in the JVM, and never shuffled: rows move as id and digest.
* A text in a third of all rows is one row a task after the partial count; its rows meet the index through a
  broadcast of at most 1,000 such digests.
* A delivery added again under its name replaces what it had appended, so a job begun anew changes nothing.
* Other columns of a table are kept by ``distinct_texts`` and left out elsewhere.
"""

from __future__ import annotations

from dataclasses import dataclass
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from slopeworks.llm.graph import join_spread, maybe_among, row_key, without_ids
from slopeworks.shared import settled

# An index has at least so many buckets; a first delivery of more rows asks for one in ROWS_A_BUCKET.
LEAST_BUCKETS = 16
ROWS_A_BUCKET = 2_000_000
_WHITE = "[\\x20\\x09-\\x0D]+"


def digest_of(text: Column) -> Column:
    """SHA-256 (32 bytes) of a text with its white space made single."""
    one_space = F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), _WHITE, " ")
    return F.unhex(F.sha2(one_space, 256))


def digests(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id, digest, row``: one row per input row, numbered once and for all, kept in the shared folder."""
    found = df.select(F.col(id_column).alias("id"), digest_of(F.col(text_column)).alias("digest"))
    return settled(found.withColumn("row", F.monotonically_increasing_id()))


def buckets_for(rows: int) -> int:
    """Buckets of an index that begins with so many rows."""
    return max(LEAST_BUCKETS, rows // ROWS_A_BUCKET)


def _first() -> Column:
    """The smallest id of a group and the row that has it; null ids last."""
    return F.min(F.struct(F.col("id").isNull().alias("absent"), "id", "row"))


@dataclass(frozen=True)
class DigestIndex:
    """An index of digests in a folder; the folder outlives the session, the table's name does not."""

    spark: SparkSession
    buckets: int
    name: str

    @staticmethod
    def at(spark: SparkSession, path: str, id_type: str = "bigint", buckets: int = LEAST_BUCKETS) -> DigestIndex:
        """The index in ``path``; if it is not there it is begun, with ids of a type and a number of buckets."""
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/made")
        if not where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where):
            made = spark.range(1).select(F.lit(id_type).alias("id_type"), F.lit(buckets).alias("buckets"))
            made.write.parquet(f"{path}/made")
        id_type, buckets = spark.read.parquet(f"{path}/made").first()
        files = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/digests")
        files.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(files)
        name = f"digests_{uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {name} (digest BINARY, keep_id {id_type}, delivery STRING) USING parquet "
            f"PARTITIONED BY (delivery) CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS "
            f"LOCATION '{path}/digests'"
        )
        spark.sql(f"MSCK REPAIR TABLE {name}")
        return DigestIndex(spark, buckets, name)

    def entries(self) -> DataFrame:
        return self.spark.table(self.name)

    def add(self, rows: DataFrame, delivery: str) -> None:
        """Append the digests of ``rows`` (as ``digests`` gives them) that no other delivery has."""
        groups = rows.groupBy("digest").agg(_first()["id"].alias("keep_id")).repartition(self.buckets, "digest")
        known = self.entries().filter(F.col("delivery") != delivery).select("digest").hint("merge")
        fresh = settled(groups.join(known, "digest", "left_anti"))
        self.spark.sql(
            f"INSERT OVERWRITE TABLE {self.name} PARTITION (delivery = :delivery) SELECT digest, keep_id FROM {{fresh}}",
            args={"delivery": delivery},
            fresh=fresh,
        )

    def resolve(self, rows: DataFrame) -> DataFrame:
        """``id, keep_id, group_size, kept, digest`` of every row: the id that stays, the number of given rows
        with the text, and whether this row is the one that stays."""
        groups = rows.groupBy("digest").agg(_first().alias("first"), F.count("*").alias("group_size"))
        groups = groups.repartition(self.buckets, "digest")
        named = settled(groups.join(self.entries().select("digest", "keep_id").hint("merge"), "digest"))
        met = join_spread(rows, named, "digest", "group_size", rows.count())
        kept = (F.col("row") == F.col("first.row")) & F.col("id").eqNullSafe(F.col("keep_id"))
        return met.select("id", "keep_id", "group_size", kept.alias("kept"), "digest")

    def drop(self) -> None:
        """Forget the table's name; the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")


def distinct_texts(df: DataFrame, index: DigestIndex, delivery: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Add a table to an index and return its rows, all columns, whose text no earlier delivery had, one row a
    text.  Rows of one id whose texts differ are told apart by their text."""
    keyed = df.withColumn("__key", row_key(id_column, text_column))
    rows = settled(
        keyed.select(F.col(id_column).alias("id"), digest_of(F.col(text_column)).alias("digest"), F.col("__key").alias("key"))
        .withColumn("row", F.monotonically_increasing_id())
    )
    index.add(rows, delivery)
    mine = index.entries().filter(F.col("delivery") == delivery).select("digest")
    least = rows.groupBy("digest").agg(F.min("key").alias("__key"))
    stay = least.join(mine.hint("merge"), "digest", "left_semi").select("__key")
    counted = rows.groupBy(F.col("key").alias("__key")).count()
    gone = counted.select("__key").join(stay, "__key", "left_anti")
    kept = without_ids(keyed, "__key", gone)
    repeated = maybe_among(counted.filter("count > 1"), "__key")(F.col("__key"))
    once = kept.filter(repeated).dropDuplicates(["__key"])
    return kept.filter(~repeated).unionByName(once).drop("__key")
