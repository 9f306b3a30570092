"""Batch gradient, loss and row count for many weight vectors in one pass over the rows.

Two layouts for weights of a bounded size (``MAX_DRIVER_VALUES``):

* ``columns``: large narrow dense tables and few weight vectors; plain aggregate expressions that
  stay inside generated JVM code (compiled anew as the weights change, which a small table does
  not repay).
* ``arrow``: everything else; each task folds its Arrow batches into one partial sum per weight
  vector, and a grouped sum adds the partials.

Weights that are wider than the bound are handled by joins in ``plans.wide``.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slopeworks.config import BATCH_SEED_BASE
from slopeworks.functions.losses import loss_named
from slopeworks.functions.ops import ColumnOps, NumpyOps
from slopeworks.functions.sampling import LOW_BITS, PRIME, WORD, in_batch, in_validation, key_word, rule
from slopeworks.operators.features import MAX_DRIVER_VALUES, NARROW_WIDTH, bad_vector, cleaned, is_sparse, row_width
from slopeworks.shared import settled

# The columns layout pays one generated expression per sum; measured to win up to about here.
_COLUMN_SUMS = 48
# Fewer rows than this do not repay compiling the expressions anew for every set of weights.
_COLUMN_ROWS = 2_000_000
# Gradient values that travel together in one partial row.
_BLOCK = 32
# A table of up to this many feature values (400 MB) is spread evenly over the cores.
_SMALL_VALUES = 50_000_000
# One that is expected to have up to this many bytes is so before it is prepared.
_SMALL_BYTES = 64 << 20
# So is a sparse one of up to this many rows.
_SMALL_ROWS = 2_000_000
# Partial sums of up to this many values (8 MB) go straight to the driver, without a second stage.
_DIRECT_VALUES = 1_000_000
# Rows times weight vectors held at once by a task: dense chunks are to stay in a core's cache,
# sparse ones are to outweigh a pass over all indices.
DENSE_CHUNK = 32_768
_SPARSE_CHUNK = 2_000_000
# Entries of sparse rows held at once by a task (48 MB).
_SPARSE_ENTRIES = 4_000_000


@dataclass(frozen=True)
class Rows:
    """A prepared training table.

    ``kind`` is "narrow" (columns x0..), "dense" (array ``features``) or "sparse" (``idx``/``val``).
    ``split`` > 0 adds a boolean ``held_out`` column for the validation rows.  ``n_rows`` and
    ``tasks`` (partitions) are None where unknown; ``tasks`` is known for small tables.
    """

    df: DataFrame
    kind: str
    width: int
    split: float
    n_rows: int | None = None
    tasks: int | None = None

    @property
    def keyed(self) -> bool:
        return WORD in self.df.columns

    def batch(self, iteration: int | None, fraction: float) -> DataFrame:
        """Rows of one mini-batch, by key; a row without a key (null) is in none but the whole table."""
        if iteration is None or fraction >= 1.0:
            return self.df
        return self.df.filter(in_batch(F.col(WORD), iteration, fraction))

    def rule(self, iteration: int | None, fraction: float) -> tuple[int, int, int, int] | None:
        """How tasks are to draw the mini-batch themselves.  Small keyed tables do: the numbers of a
        filter are compiled into it, which costs more than reading all of a small table."""
        if iteration is None or self.tasks is None or not self.keyed:
            return None
        return rule(BATCH_SEED_BASE + iteration, fraction)

    def vector_columns(self) -> list[str]:
        if self.kind == "narrow":
            return [f"x{j}" for j in range(self.width)]
        return ["features"] if self.kind == "dense" else ["idx", "val"]


def keyed_once(df: DataFrame) -> DataFrame:
    """The table with a ``row_key``: its own, or a number settled in the shared folder before anything is
    drawn, so that every layout and every retry draws the same rows."""
    if "row_key" in df.columns:
        return df
    return settled(df.withColumn("row_key", F.monotonically_increasing_id().cast("string")))


def held_out(split: float) -> Column:
    """Whether a prepared row is kept for validation; a row without a key is not."""
    return F.coalesce(in_validation(F.col(WORD), split), F.lit(False))


def looks_small(df: DataFrame) -> bool:
    """Whether the optimizer expects few enough bytes to deal them to the cores before they are prepared,
    instead of preparing them in the few tasks that read a small file.  No result depends on it."""
    expected = df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return int(str(expected)) <= _SMALL_BYTES


def spread_small(df: DataFrame, n_rows: int, width: int | None, sparse: bool) -> tuple[DataFrame, int | None]:
    """A small table dealt evenly to the cores, with the number of its partitions; a large one as it is,
    since it is never worth moving.  No result depends on it."""
    small = n_rows <= _SMALL_ROWS if sparse else n_rows * (width or 1) <= _SMALL_VALUES
    if not small:
        return df, None
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores), cores


def prepare(df: DataFrame, width: int, split: float = 0.0, sampled: bool = True) -> Rows:
    """Reshape a canonical training table once, ahead of many passes.

    ``length`` keeps what the row's own vector says about the number of features, ``unclean`` and
    ``no_key`` what validation is to find; unclean vectors are given their one meaning.  Hash words are made
    only for tables with a ``row_key`` that are ``sampled``.
    """
    kind = "sparse" if is_sparse(df) else "narrow" if 0 < width <= NARROW_WIDTH else "dense"
    if kind == "narrow":
        vector = [F.coalesce(F.get("features", F.lit(j)), F.lit(0.0)).alias(f"x{j}") for j in range(width)]
        # Elements that are there and null; a generated expression, unlike a look through the array.
        nulls = [(F.size("features") > j) & F.get("features", F.lit(j)).isNull() for j in range(width)]
        unclean = F.coalesce(reduce(Column.__or__, nulls), F.lit(False))
    else:
        unclean = bad_vector(df)
        vector = cleaned(df, unclean)
    keyed = "row_key" in df.columns
    columns = [F.col("label"), *vector, row_width(df).alias("length"), unclean.alias("unclean")]
    columns.append((F.col("row_key").isNull() if keyed else F.lit(False)).alias("no_key"))
    if keyed and sampled:
        columns.append(key_word(F.col("row_key")).alias(WORD))
    prepared = df.select(*columns)
    if split > 0:
        prepared = prepared.withColumn("held_out", held_out(split))
    return Rows(prepared, kind, width, split)


@dataclass
class Sums:
    """Totals of one pass: K gradients, K bias gradients, K losses, and row counts."""

    gradient: np.ndarray
    bias: np.ndarray
    loss: np.ndarray
    n: int
    held_out_loss: np.ndarray
    n_held_out: int


def batch_sums(
    rows: Rows,
    batch: DataFrame,
    weights: np.ndarray,
    bias: np.ndarray,
    losses: Sequence[str],
    layout: str = "auto",
) -> Sums:
    """Gradient and loss totals of a batch at K weight vectors (K x width), in one Spark job.

    Validation rows add to ``held_out_loss`` only.
    """
    return _sums(rows, batch, None, weights, bias, losses, layout)


def minibatch_sums(
    rows: Rows,
    iteration: int,
    fraction: float,
    weights: np.ndarray,
    bias: np.ndarray,
    losses: Sequence[str],
    layout: str = "auto",
) -> Sums:
    """``batch_sums`` over the mini-batch of an iteration."""
    found = rows.rule(iteration, fraction) if layout in ("auto", "arrow") else None
    batch = rows.df if found is not None else rows.batch(iteration, fraction)
    return _sums(rows, batch, found, weights, bias, losses, "arrow" if found is not None else layout)


def _sums(rows: Rows, batch: DataFrame, drawn, weights, bias, losses, layout: str) -> Sums:
    k, width = weights.shape
    if k * width > MAX_DRIVER_VALUES:
        raise ValueError(f"{k} x {width} weights exceed the broadcast bound of {MAX_DRIVER_VALUES}")
    if layout == "auto":
        few = rows.kind == "narrow" and k * (width + 2) <= _COLUMN_SUMS
        many_rows = rows.n_rows is None or rows.n_rows >= _COLUMN_ROWS
        layout = "columns" if few and many_rows else "arrow"
    if layout == "columns":
        if rows.kind != "narrow":
            raise ValueError("the columns layout needs a narrow dense table")
        row = column_sums(rows, batch, weights, bias, losses).first()
        return _from_row(row, k, width)
    return _arrow_sums(rows, batch, drawn, weights, bias, losses)


# --- columns layout -----------------------------------------------------------------------------


def margin_column(vector: Sequence[str], weights: Sequence[float], bias: float = 0.0) -> Column:
    """w.x + b over scalar columns, added from left to right."""
    total = F.lit(0.0)
    for j, name in enumerate(vector):
        term = F.col(name) * F.lit(float(weights[j]))
        total = term if j == 0 else total + term
    return total + F.lit(float(bias)) if bias else total


def column_sums(
    rows: Rows, batch: DataFrame, weights: np.ndarray, bias: np.ndarray, losses: Sequence[str]
) -> DataFrame:
    """One lazy row of totals: n, nv and per vector k the sums l_k, lv_k, b_k and g_k_j."""
    vector = rows.vector_columns()
    held = F.col("held_out") if rows.split > 0 else None
    margins = [margin_column(vector, w, b).alias(f"m_{i}") for i, (w, b) in enumerate(zip(weights, bias))]
    with_margin = batch.select("label", *vector, *(["held_out"] if rows.split > 0 else []), *margins)
    factors = []
    for i, name in enumerate(losses):
        multiplier, loss = loss_named(name)(ColumnOps, F.col(f"m_{i}"), F.col("label"))
        factors += [multiplier.alias(f"p_{i}"), loss.alias(f"q_{i}")]
    terms = with_margin.select(*vector, *(["held_out"] if rows.split > 0 else []), *factors)

    def total(value: Column, name: str, of_held_out: bool = False) -> Column:
        if held is not None:
            value = F.when(held if of_held_out else ~held, value)
        return F.coalesce(F.sum(value), F.lit(0.0)).alias(name)

    sums = [
        (F.count_if(~held) if held is not None else F.count(F.lit(1))).alias("n"),
        (F.count_if(held) if held is not None else F.lit(0).cast("bigint")).alias("nv"),
    ]
    for i in range(len(losses)):
        sums.append(total(F.col(f"q_{i}"), f"l_{i}"))
        if held is not None:
            sums.append(total(F.col(f"q_{i}"), f"lv_{i}", of_held_out=True))
        sums.append(total(F.col(f"p_{i}"), f"b_{i}"))
        sums += [total(F.col(f"p_{i}") * F.col(x), f"g_{i}_{j}") for j, x in enumerate(vector)]
    return terms.agg(*sums)


def _from_row(row, k: int, width: int) -> Sums:
    held = f"lv_{0}" in row.asDict()
    return Sums(
        gradient=np.array([[row[f"g_{i}_{j}"] for j in range(width)] for i in range(k)]).reshape(k, width),
        bias=np.array([row[f"b_{i}"] for i in range(k)]),
        loss=np.array([row[f"l_{i}"] for i in range(k)]),
        n=row["n"],
        held_out_loss=np.array([row[f"lv_{i}"] if held else 0.0 for i in range(k)]),
        n_held_out=row["nv"],
    )


# --- arrow layout -------------------------------------------------------------------------------


def _grouped(losses: Sequence[str]) -> list[tuple[Callable, list[int]]]:
    by_name: dict[str, list[int]] = {}
    for i, name in enumerate(losses):
        by_name.setdefault(name, []).append(i)
    return [(loss_named(name), positions) for name, positions in by_name.items()]


def _row_terms(loss_groups, margins: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if len(loss_groups) == 1:
        return loss_groups[0][0](NumpyOps, margins, label[:, None])
    multiplier, loss = np.empty_like(margins), np.empty_like(margins)
    for function, at in loss_groups:
        multiplier[:, at], loss[:, at] = function(NumpyOps, margins[:, at], label[:, None])
    return multiplier, loss


def dense_block(batch: pa.RecordBatch, kind: str, width: int) -> np.ndarray:
    """The rows of an Arrow batch as an (n x width) array."""
    if kind == "narrow":
        return np.column_stack([batch.column(f"x{j}").to_numpy(zero_copy_only=False) for j in range(width)])
    flat = batch.column("features").flatten().to_numpy(zero_copy_only=False)
    if len(flat) != batch.num_rows * width:
        raise ValueError(f"rows do not have {width} features each")
    return flat.reshape(-1, width)


def sparse_entries(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, idx, value) of every stored entry of an Arrow batch."""
    idx, val = batch.column("idx"), batch.column("val")
    lengths = np.diff(idx.offsets.to_numpy())
    row_of = np.repeat(np.arange(batch.num_rows), lengths)
    return row_of, idx.flatten().to_numpy(), val.flatten().to_numpy()


def margins_of(batch: pa.RecordBatch, kind: str, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """(n x K) margins of an Arrow batch; sparse entries beyond the weights count as weight 0."""
    if kind != "sparse":
        return dense_block(batch, kind, weights.shape[1]) @ weights.T + bias
    row_of, idx, val = sparse_entries(batch)
    return _sparse_margins(row_of, idx, val, batch.num_rows, weights, bias)


def _sparse_margins(row_of, idx, val, n, weights, bias):
    if len(idx) and idx.max() >= weights.shape[1]:
        inside = idx < weights.shape[1]
        row_of, idx, val = row_of[inside], idx[inside], val[inside]
    sums = [np.bincount(row_of, weights=val * w[idx], minlength=n) for w in weights]
    return np.column_stack(sums) + bias


def _drawn(batch: pa.RecordBatch, rule: tuple[int, int, int, int]) -> pa.RecordBatch:
    """The rows of a mini-batch; the same sums as the column form, in 64-bit integers."""
    a, b, c, limit = rule
    if batch.column(WORD).null_count:
        batch = batch.filter(batch.column(WORD).is_valid())
    word = batch.column(WORD).to_numpy()
    return batch.filter(pa.array(((word & PRIME) * a + (word >> LOW_BITS) * b + c) % PRIME < limit))


def _gathered(batches, rows: int):
    """Arrow batches joined until they have ``rows`` rows or ``_SPARSE_ENTRIES`` entries."""
    held, n, entries = [], 0, 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        entries += len(batch.column("idx").flatten())
        if n >= rows or entries >= _SPARSE_ENTRIES:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0] if n else held[0]
            held, n, entries = [], 0, 0
    if n:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _partial_sums(
    kind: str, width: int, losses: Sequence[str], split: bool, drawn: tuple[int, int, int, int] | None, shared
) -> Callable:
    loss_groups = _grouped(losses)
    k = len(losses)

    def fold(batches):
        weights, bias = shared.value
        gradient, bias_gradient = np.zeros((k, width)), np.zeros(k)
        loss, held_loss, n, n_held = np.zeros(k), np.zeros(k), 0, 0
        with np.errstate(all="ignore"):
            step = max(1, (_SPARSE_CHUNK if kind == "sparse" else DENSE_CHUNK) // k)
            if drawn is not None:
                batches = (_drawn(batch, drawn) for batch in batches)
            # A sparse chunk is gathered from many Arrow batches: it pays for one pass over all indices.
            for whole in _gathered(batches, step) if kind == "sparse" else batches:
                for start in range(0, whole.num_rows, step):
                    batch = whole.slice(start, step)
                    label = batch.column("label").to_numpy(zero_copy_only=False)
                    if kind == "sparse":
                        row_of, idx, val = sparse_entries(batch)
                        margins = _sparse_margins(row_of, idx, val, batch.num_rows, weights, bias)
                    else:
                        block = dense_block(batch, kind, width)
                        margins = block @ weights.T + bias
                    multiplier, row_loss = _row_terms(loss_groups, margins, label)
                    if split:
                        held = batch.column("held_out").to_numpy(zero_copy_only=False)
                        multiplier[held] = 0.0
                        held_loss += row_loss[held].sum(axis=0)
                        n_held += int(held.sum())
                        row_loss = row_loss[~held]
                    n += len(row_loss)
                    loss += row_loss.sum(axis=0)
                    bias_gradient += multiplier.sum(axis=0)
                    if kind == "sparse":
                        for i in range(k):
                            gradient[i] += np.bincount(
                                idx, weights=multiplier[row_of, i] * val, minlength=width
                            )
                    else:
                        gradient += multiplier.T @ block
        if n or n_held:
            yield _partial_rows(gradient, bias_gradient, loss, n, held_loss, n_held)

    return fold


def _partial_rows(gradient, bias_gradient, loss, n, held_loss, n_held) -> pa.RecordBatch:
    """One row per weight vector and touched block; scalars ride on block 0."""
    k, width = gradient.shape
    block = min(_BLOCK, max(width, 1))
    blocks = max(1, -(-width // block))
    padded = np.zeros((k, blocks * block))
    padded[:, :width] = gradient
    cells = padded.reshape(k, blocks, block)
    touched = (cells != 0).any(axis=2)
    touched[:, 0] = True
    which, at = np.nonzero(touched)
    first = at == 0

    def scalar(values, kind):
        return pa.array(np.where(first, np.broadcast_to(values, k)[which], 0), kind)

    arrays = {
        "config": pa.array(which, pa.int32()),
        "block": pa.array(at, pa.int32()),
        "n": scalar(n, pa.int64()),
        "nv": scalar(n_held, pa.int64()),
        "l": scalar(loss, pa.float64()),
        "lv": scalar(held_loss, pa.float64()),
        "b": scalar(bias_gradient, pa.float64()),
    }
    chosen = cells[which, at]
    arrays.update({f"g{j}": pa.array(chosen[:, j], pa.float64()) for j in range(block)})
    return pa.RecordBatch.from_pydict(arrays)


def _arrow_sums(rows: Rows, batch: DataFrame, drawn, weights, bias, losses) -> Sums:
    k, width = weights.shape
    block = min(_BLOCK, max(width, 1))
    columns = ["label", *rows.vector_columns()] + (["held_out"] if rows.split > 0 else [])
    columns += [WORD] if drawn is not None else []
    values = ["n", "nv", "l", "lv", "b", *[f"g{j}" for j in range(block)]]
    types = "config int, block int, n bigint, nv bigint" + "".join(f", {v} double" for v in values[2:])
    shared = batch.sparkSession.sparkContext.broadcast((weights, bias))
    try:
        fold = _partial_sums(rows.kind, width, losses, rows.split > 0, drawn, shared)
        partials = batch.select(*columns).mapInArrow(fold, types)
        if rows.tasks is not None and rows.tasks * k * (width + 5) <= _DIRECT_VALUES:
            totals = partials.toArrow().group_by(["config", "block"]).aggregate([(v, "sum") for v in values])
            totals = totals.select(["config", "block", *[f"{v}_sum" for v in values]])
        else:
            totals = partials.groupBy("config", "block").sum(*values).toArrow()
    finally:
        shared.destroy()
    return _from_blocks(totals.rename_columns(["config", "block", *values]), k, width, block)


def _from_blocks(totals: pa.Table, k: int, width: int, block: int) -> Sums:
    config, at = totals["config"].to_numpy(), totals["block"].to_numpy()
    blocks = max(1, -(-width // block))
    cells = np.zeros((k, blocks, block))
    for j in range(block):
        cells[config, at, j] = totals[f"g{j}"].to_numpy()
    head = at == 0

    def scalars(name):
        out = np.zeros(k, dtype=totals[name].to_numpy().dtype)
        out[config[head]] = totals[name].to_numpy()[head]
        return out

    n, n_held = scalars("n"), scalars("nv")
    return Sums(
        gradient=cells.reshape(k, -1)[:, :width],
        bias=scalars("b"),
        loss=scalars("l"),
        n=int(n[0]) if k else 0,
        held_out_loss=scalars("lv"),
        n_held_out=int(n_held[0]) if k else 0,
    )
