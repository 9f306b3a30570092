"""Connected components of an edge table, joins that keep hot keys apart, and bitmaps of fixed size."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slopeworks.shared import settled

# A bitmap of ids has 2 ** ID_BITS bits: 4 MB.
ID_BITS = 25
# A key with more than this share of the rows is hot, so there are at most 1 / HOT_SHARE hot keys.
HOT_SHARE = 1 / 1000


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """``node, root``: for every node with an edge, the smallest node it is linked to by any path.

    Alternates two steps until nothing changes: each node hands its larger neighbours, then its smaller
    ones, to the smallest node it knows.  Neighbourhoods are never gathered: minima are aggregated (partly
    before the shuffle) and joined back, so a node with many edges is split like any skewed join.  Edges after
    each round lie in the shared folder; only their number and a checksum come to the driver.
    """
    pairs = edges.select(F.col(left).alias("u"), F.col(right).alias("v")).filter("u <> v")
    current = settled(pairs.selectExpr("greatest(u, v) as u", "least(u, v) as v").distinct())
    state = None
    while True:
        seen = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == state or seen[0] == 0:
            return current.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
                current.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        state = tuple(seen)
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u <> v").distinct()
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(lowest, "u")
        small = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(lowest.select("u", "m"))
        current = settled(small.filter("u <> v").distinct())


def join_spread(left: DataFrame, right: DataFrame, key: str, times: str, total: int) -> DataFrame:
    """Inner join with a table that has each key once and, in ``times``, how often ``left`` has it.

    Hot keys (at most 1 / HOT_SHARE of them) meet a broadcast; the others are shuffled."""
    hot = right.filter(F.col(times) > F.lit(total * HOT_SHARE))
    cold = right.filter(F.col(times) <= F.lit(total * HOT_SHARE))
    near = left.join(F.broadcast(hot), key)
    far = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key)
    return near.unionByName(far)


def join_salted(left: DataFrame, right: DataFrame, key: str, times: str, total: int, spread: str) -> DataFrame:
    """Like ``join_spread`` where rows of ``right`` may be large: only hot keys, of fixed size, and their ways are
    broadcast.  A hot key's rows in ``left`` are dealt to its ways by a hash of ``spread``; ``right`` goes to each."""
    ways = F.ceil(F.col(times) / F.lit(max(total * HOT_SHARE, 1))).cast("int")
    hot = right.select(key, ways.alias("__ways")).filter("__ways > 1")
    dealt = left.join(F.broadcast(hot), key, "left")
    dealt = dealt.withColumn("__way", F.pmod(F.xxhash64(spread), F.coalesce("__ways", F.lit(1))).cast("int")).drop("__ways")
    copies = right.withColumn("__way", F.explode(F.sequence(F.lit(0), F.greatest(ways, F.lit(1)) - 1)))
    return dealt.join(copies, [key, "__way"]).drop("__way")


def bitmap(df: DataFrame, place: Column, bits: int) -> np.ndarray:
    """The places (0 to 2 ** bits - 1) that occur in a table, as a bitmap of 64-bit words; at most
    2 ** (bits - 6) rows come to the driver."""
    places = df.select(place.alias("place"))
    words = places.groupBy(F.shiftright("place", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("bits")
    )
    found = words.toArrow()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[found["word"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    return out


def held(words: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Whether each place is set in a bitmap."""
    places = places.astype(np.uint64)
    return ((words[places >> np.uint64(6)] >> (places & np.uint64(63))) & np.uint64(1)).astype(bool)


def maybe_among(ids: DataFrame, id_column: str) -> Callable[[Column], Column]:
    """A test for whether an id may be among ``ids``: never false for one that is, rarely true for another
    (often, once ids are as many as the bitmap's bits).  Only the ids pass through Python."""
    words = ids.sparkSession.sparkContext.broadcast(bitmap(ids, _place(F.col(id_column)), ID_BITS))

    def test(places: pa.Array) -> pa.Array:
        return pa.array(held(words.value, places.to_numpy(zero_copy_only=False)))

    return lambda column: F.arrow_udf(test, "boolean")(_place(column))


def _place(column: Column) -> Column:
    return F.pmod(F.xxhash64(column.cast("string")), F.lit(1 << ID_BITS).cast("long"))


def row_key(id_column: str, text_column: str) -> Column:
    """A key that rows share only if they have one id (null is an id) and one text, by 128 bits of hash.  Keys with
    an id come before those without, then keys are ordered by id."""
    text = F.col(text_column).cast("string")
    return F.struct(
        F.col(id_column).isNull().alias("absent"),
        F.col(id_column).alias("id"),
        F.xxhash64(text).alias("one"),
        F.xxhash64(F.lit(1), text).alias("two"),
    )


def without_ids(df: DataFrame, id_column: str, ids: DataFrame) -> DataFrame:
    """The rows of ``df``, all columns as they are, whose id is not among ``ids`` (null is an id).

    Rows that a bitmap of the ids clears stay where they are; only the others are shuffled to be compared."""
    ids = settled(ids.select(F.col(id_column).alias("__id")).distinct())
    maybe = maybe_among(ids, "__id")(F.col(id_column))
    rest = df.filter(maybe).join(ids, F.col(id_column).eqNullSafe(F.col("__id")), "left_anti")
    return df.filter(~maybe).unionByName(rest)
