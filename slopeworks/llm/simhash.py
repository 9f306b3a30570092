"""Operator 4: near copies by SimHash, found by meet-in-the-middle ball hashing.

Two fingerprints of at most ``2 * r`` differing bits share a value within ``r`` bits of both.  With r = 1
every distinct fingerprint emits itself and its 64 one-bit variants, and a shuffle on the variants brings
linked fingerprints together.  All fingerprints at one variant lie within one bit of it, so there are at
most 65 of them and any two are linked: linking each to the smallest loses no component.  Copies share a
fingerprint and take part once.

Null text and text without words have fingerprint zero, which links like any other.  Every input row gives
one output row; repeated rows share a component; a null id never names a component that has another id.  Other
columns are left out.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from slopeworks.llm.blocks import column_of, row_blocks
from slopeworks.llm.graph import components, join_spread, maybe_among, row_key, without_ids
from slopeworks.shared import settled

SHINGLE = 3
MAX_BITS = 2
_SEED = 42
_CHUNK = 1 << 15


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    """64 bits: a bit is set if it is set in over half of the hashes of all word shingles."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()  # both touch ASCII only
    if not words:
        return 0
    joined, size = b" ".join(words), min(shingle, len(words))
    ends = np.cumsum([len(word) + 1 for word in words])
    starts = ends - [len(word) + 1 for word in words]
    spans = zip(starts[: len(words) - size + 1].tolist(), (ends[size - 1 :] - 1).tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], _SEED) for a, b in spans], "<u8")
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _CHUNK):
        bits = np.unpackbits(hashes[at : at + _CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The id column and ``fingerprint`` (long, the 64 bits)."""
    id_type = df.schema[id_column].dataType.simpleString()

    def run(batches):
        for block in row_blocks(batches):
            values = [fingerprint(text or "") for text in column_of(block, "text").to_pylist()]
            bits = np.array(values, np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([column_of(block, "id"), pa.array(bits)], ["id", "fingerprint"])

    rows = df.select(df[id_column].alias("id"), df[text_column].cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {id_type}, fingerprint long").withColumnRenamed("id", id_column)


def _variants(fingerprint: Column) -> Column:
    flipped = [fingerprint.bitwiseXOR(F.lit(1 << k if k < 63 else -(1 << 63)).cast("long")) for k in range(64)]
    return F.array(fingerprint, *flipped)


def links(distinct: DataFrame) -> DataFrame:
    """``a, b``: fingerprints of at most two differing bits, each with the smallest one at a shared variant."""
    # Spread first: 65 rows come of each, and a few small partitions would make them all.
    parts = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = distinct.repartition(parts, "fingerprint")
    balls = spread.select("fingerprint", F.explode(_variants(F.col("fingerprint"))).alias("variant"))
    smallest = F.min("fingerprint").over(Window.partitionBy("variant"))  # of at most 65
    met = balls.select(F.col("fingerprint").alias("a"), smallest.alias("b"))
    pairs = met.filter("a <> b").distinct()
    return pairs.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS)


def near_copies(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The id column, ``fingerprint`` (long) and ``component_id`` (smallest id reachable by links)."""
    marked = settled(fingerprints(df, id_column, text_column))
    groups = settled(
        marked.groupBy("fingerprint").agg(F.min(id_column).alias("first"), F.count("*").alias("times"))
    )
    total = groups.agg(F.sum("times")).first()[0] or 0
    roots = components(links(groups.select("fingerprint")), "a", "b")
    rooted = groups.join(roots.withColumnRenamed("node", "fingerprint"), "fingerprint", "left").withColumn(
        "root", F.coalesce("root", "fingerprint")
    )
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(smallest, "root").select("fingerprint", "times", "component_id")
    return join_spread(marked, named, "fingerprint", "times", total).select(id_column, "fingerprint", "component_id")


def one_of_each(
    df: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    grouping: Callable[[DataFrame, str, str], DataFrame] = near_copies,
) -> DataFrame:
    """The rows of ``df``, all columns as they are, with one row of each component: that with the smallest id, or
    one without an id where no row has one.  Of rows of a component that share such an id (null included) one stays,
    by the hash of the text; rows that share an id in different components do not touch each other.  ``grouping`` gives
    each id its ``component_id``."""
    rows = df.withColumn("__key", row_key(id_column, text_column))
    found = grouping(rows, "__key", text_column)
    own = F.max(F.col("__key") == F.col("component_id")).alias("own")
    keys = settled(found.groupBy("__key").agg(F.count("*").alias("times"), own))
    kept = without_ids(rows, "__key", keys.filter("not own"))
    again = keys.filter("own and times > 1").select("__key")
    if again.isEmpty():
        return kept.drop("__key")
    # Repeated rows are aggregated before they are shuffled, however many they are.
    several = rows.filter(maybe_among(again, "__key")(F.col("__key"))).withColumn("__place", F.monotonically_increasing_id())
    first = several.groupBy("__key").agg(F.min_by(F.struct(*df.columns), "__place").alias("__row"))
    first = first.join(again, "__key", "left_semi").select("__row.*")
    return without_ids(kept, "__key", again).drop("__key").unionByName(first)
