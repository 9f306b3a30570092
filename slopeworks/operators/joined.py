"""Margins and gradients by meeting in a grid of rows and indices, for weights too many to broadcast.

``rows``: ``(row_id, label, idx array, val array[, row_key, held_out])``, spread by ``row_id``.
``params``: one row per index with one weight column per configuration.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slopeworks.functions.losses import loss_named
from slopeworks.functions.ops import ColumnOps
from slopeworks.functions.sampling import WORD
from slopeworks.operators.features import is_sparse
from slopeworks.shared import settled

# An index space is cut into at most so many blocks, and a part of the grid holds about so many entries at most.
MAX_BLOCKS = 1024
PART_ENTRIES = 1 << 22

# Indices below 0 carry totals through the gradient sum.
TRAIN_LOSS, HELD_LOSS, BIAS = -1, -2, -3


def identified(df: DataFrame) -> DataFrame:
    """A sparse form of a training table, prepared or not, with a ``row_id`` that no recomputation can
    change."""
    return settled(sparse_form(df).withColumn("row_id", F.monotonically_increasing_id()))


def sparse_form(df: DataFrame) -> DataFrame:
    """Dense and narrow prepared rows with ``idx`` and ``val`` in place of their vector."""
    if is_sparse(df):
        return df
    narrow = [c for c in df.columns if c[0] == "x" and c[1:].isdigit()]
    vector = F.array(*[F.col(f"x{j}") for j in range(len(narrow))]) if narrow else F.col("features")
    others = [c for c in df.columns if c not in ("features", *narrow)]
    rows = df.select(*others, vector.alias("val"))
    return rows.withColumn("idx", F.transform("val", lambda _, i: i.cast("int")))


def partitions_of(df: DataFrame) -> int:
    """Partitions a shuffle is dealt to."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def spread_by_id(rows: DataFrame) -> DataFrame:
    """Rows partitioned as margins are, so that once this is persisted no join moves them again."""
    return rows.repartition(partitions_of(rows), "row_id")


@dataclass(frozen=True)
class Grid:
    """A matrix of rows and indices cut both ways: indices into blocks (remainders), the rows of a block into as many
    ways as its entries need.  A part is one way of one block."""

    ways: tuple[int, ...]

    def _of_block(self, values: Sequence[int], idx: Column) -> Column:
        return F.element_at(F.lit([int(v) for v in values]), (F.pmod(idx, F.lit(len(self.ways))) + 1).cast("int"))

    def _first(self) -> list[int]:
        return np.concatenate([[0], np.cumsum(self.ways)[:-1]]).tolist()

    def part(self, idx: Column, row_id: Column) -> Column:
        """The part of an entry: a row has at most one in each block."""
        way = F.pmod(F.xxhash64(row_id), self._of_block(self.ways, idx))
        return (self._of_block(self._first(), idx) + way).cast("int")

    def parts(self, idx: Column) -> Column:
        """All parts that need what belongs to an index."""
        first = self._of_block(self._first(), idx)
        return F.sequence(first, first + self._of_block(self.ways, idx) - 1)


def grid_of(rows: DataFrame, width: int) -> Grid:
    """The grid that moves least: weights go to every way of their block, margins come from every block of a
    row.  A block with many entries (a hot index) has more ways.  One row a block comes to the driver."""
    partitions = partitions_of(rows)
    seen = rows.agg(F.count("*").alias("n"), F.sum(F.size("idx")).alias("entries")).first()
    n, entries = seen["n"], seen["entries"] or 0
    each = entries / n if n else 0.0
    choices = [1 << k for k in range(11) if 1 << k <= min(MAX_BLOCKS, max(1, width), max(1, partitions))]
    blocks = min(choices, key=lambda c: width * partitions / c + n * min(each, c))
    block = F.pmod("idx", F.lit(blocks)).alias("block")
    each_idx = rows.select(F.explode("idx").alias("idx")).filter("idx >= 0")
    counts = dict(each_idx.groupBy(block).count().collect())
    room = max(1.0, min(entries / partitions, PART_ENTRIES))
    return Grid(tuple(max(1, math.ceil(counts.get(c, 0) / room)) for c in range(blocks)))


def entries_of(rows: DataFrame, grid: Grid) -> DataFrame:
    """``(row_id, idx, val, part[, h])``: the stored entries and the part of the grid each lies in."""
    kept = [c for c in ("row_id", WORD) if c in rows.columns]
    entries = rows.select(*kept, F.inline(F.arrays_zip("idx", "val"))).filter("idx >= 0 and val is not null")
    return entries.select(*kept, "idx", "val", grid.part(F.col("idx"), F.col("row_id")).alias("part"))


def spread_by_part(entries: DataFrame) -> DataFrame:
    """Entries partitioned and sorted by part, as they are when they meet weights, so that once this is persisted
    they stay where they are: an iteration moves weights and partial margins only."""
    return entries.repartition(partitions_of(entries), "part").sortWithinPartitions("part")


def met_by_part(entries: DataFrame, points: DataFrame, grid: Grid, made: Callable, schema: str) -> DataFrame:
    """``made`` of each part's entries and of what ``points`` has for the indices of its block (two Arrow tables)."""
    sent = points.withColumn("part", F.explode(grid.parts(F.col("idx"))))
    return entries.groupBy("part").cogroup(sent.groupBy("part")).applyInArrow(made, schema)


def places_of(wanted: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each wanted index stands among the known ones (each there once), and whether it is there."""
    if len(known) == 0:
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    order = np.argsort(known, kind="stable")
    at = np.minimum(np.searchsorted(known, wanted, sorter=order), len(known) - 1)
    place = order[at]
    return place, known[place] == wanted


def table_margins(entries: DataFrame, params: DataFrame, weights: Sequence[Column], grid: Grid) -> DataFrame:
    """``(row_id, m_0, ..)``: w.x per row and weight column.

    Entries meet the weights of their block part by part; what moves after that is one partial margin per row
    and block.  An index without a weight counts nothing.
    """
    names = [f"m_{k}" for k in range(len(weights))]
    points = params.select("idx", *[w.alias(f"w_{k}") for k, w in enumerate(weights)])

    def margins(own: pa.Table, other: pa.Table) -> pa.Table:
        place, there = places_of(own["idx"].to_numpy(), other["idx"].to_numpy())
        rows, at = np.unique(own["row_id"].to_numpy()[there], return_inverse=True)
        values, place = own["val"].to_numpy()[there], place[there]
        sums = [np.bincount(at, values * other[f"w_{k}"].to_numpy()[place], len(rows)) for k in range(len(names))]
        return pa.table([pa.array(rows, pa.int64()), *[pa.array(x, pa.float64()) for x in sums]], names=["row_id", *names])

    columns = entries.select("part", "row_id", "idx", "val")
    partial = met_by_part(columns, points, grid, margins, ", ".join(["row_id long", *[f"{m} double" for m in names]]))
    return partial.groupBy("row_id").agg(*[F.sum(m).alias(m) for m in names])


def table_gradient(
    rows: DataFrame, margins: DataFrame, losses: Sequence[str], bias: Sequence[float]
) -> DataFrame:
    """``(idx, n, g_0, ..)``: gradient sums per index, and totals at the negative indices.

    ``rows`` and ``margins`` have one row per ``row_id``; a row without entries has margin 0.  Sums
    per index are partial before the shuffle, so a hot index costs no more than any other.
    """
    held = F.col("held_out") if "held_out" in rows.columns else F.lit(False)
    k = len(losses)
    scored = rows.select("row_id", "label", "idx", "val", held.alias("held")).join(margins, "row_id", "left")
    scored = scored.select(
        "label", "idx", "val", "held",
        *[(F.coalesce(F.col(f"m_{i}"), F.lit(0.0)) + F.lit(float(bias[i]))).alias(f"m_{i}") for i in range(k)],
    )
    terms = []
    for i, name in enumerate(losses):
        multiplier, loss = loss_named(name)(ColumnOps, F.col(f"m_{i}"), F.col("label"))
        terms += [multiplier.alias(f"p_{i}"), loss.alias(f"l_{i}")]
    totals = F.array(*[F.struct(F.lit(t).alias("idx"), F.lit(1.0).alias("val")) for t in (TRAIN_LOSS, HELD_LOSS, BIAS)])
    flat = scored.select("idx", "val", "held", *terms).select(
        "held",
        *[f"p_{i}" for i in range(k)],
        *[f"l_{i}" for i in range(k)],
        F.inline(F.concat(totals, F.arrays_zip("idx", "val"))),
    )
    # Validation rows count only towards their own loss, and nothing else counts towards it.
    counted = flat.filter(F.col("held") == (F.col("idx") == HELD_LOSS))
    value = lambda i: F.when(F.col("idx").isin(TRAIN_LOSS, HELD_LOSS), F.col(f"l_{i}")).otherwise(
        F.col(f"p_{i}") * F.col("val")
    )
    return counted.groupBy("idx").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(value(i)).alias(f"g_{i}") for i in range(k)]
    )
