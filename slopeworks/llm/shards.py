"""Operator 8: token ids of documents as files, compressed by a Re-Pair grammar.

Documents are put in ascending order by ranges of the id, encoded, and cut into blocks of at most
``BLOCK_TOKENS`` ids (a longer document is a block of its own).  In each block frequent pairs of
neighbouring symbols are replaced by nonterminals, round after round: a round counts all pairs, takes
the most frequent ones together, and replaces their occurrences from left to right.  Rounds end when they
no longer pay.  No pair spans two documents, so a document is decoded alone from its own symbols.

File format: a Parquet table with a row per block, written and read by Spark's own writers, so that
the loss of an executor leaves no half file:

=============  ===============================================================================
shard, block   the task that wrote the block, and the block's place in it
first_id       smallest document id in the block; blocks in (first_id, block) order are the corpus
doc_ids        ids in ascending order
doc_tokens     decoded length of each document, end id included (u4 binary)
doc_symbols    number of grammar symbols of each document (u4 binary)
symbols        the documents' symbols, end to end (u2 or u4 binary, ``width`` bytes each)
left, right    the rules: nonterminal ``base + k`` is the pair left[k], right[k] (u4 binary)
lengths        expansion length of each rule (u4 binary)
rounds         number of rules made in each round (array of int)
n_tokens       decoded length of the block
before         decoded length of the shard's earlier blocks
=============  ===============================================================================

Null text is an empty text (the end id alone).  Repeated ids are separate documents, ordered by text; a
null id comes first.  Other columns are left out.  An empty table gives an empty file set.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from slopeworks.llm.blocks import column_of, row_blocks
from slopeworks.llm.bytepairs import word_table

BLOCK_TOKENS = 1 << 20
# A pair is replaced from this many occurrences on.
MIN_COUNT = 24
# A round that removes a smaller share of the symbols is the last.
MIN_GAIN = 0.02
MAX_ROUNDS = 12
PAIRS_A_ROUND = 4096
# Start offsets of so many shards are broadcast; of more, joined.
BROADCAST_SHARDS = 1_000_000
_BUCKET_BITS = 18

_SCHEMA = (
    "shard int, block int, first_id long, doc_ids array<bigint>, doc_tokens binary, doc_symbols binary, "
    "symbols binary, width int, base int, left binary, right binary, lengths binary, rounds array<int>, "
    "n_tokens long, before long"
)


def replaced_once(
    symbols: np.ndarray, last: np.ndarray, base: int, limit: int, min_count: int = MIN_COUNT
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One round: the most frequent neighbour pairs (keys ``left << 32 | right``, at most ``limit``), and the
    symbols and document ends after each occurrence has become ``base + place of the pair``.

    Pairs are counted by buckets of a hash first, so that only those in a frequent bucket are sorted.  Of
    pairs that share a bucket one is taken in this round."""
    keys = (symbols[:-1].astype(np.uint64) << np.uint64(32)) | symbols[1:]
    buckets = _bucket(keys)
    buckets[last[:-1]] = 1 << _BUCKET_BITS  # no pair across documents
    counts = np.bincount(buckets, minlength=(1 << _BUCKET_BITS) + 1)
    counts[-1] = 0
    frequent = counts >= min_count
    if int(frequent.sum()) > limit:
        frequent &= counts >= np.partition(counts, -limit)[-limit]
    spots = np.flatnonzero(frequent[buckets])
    pairs, times = np.unique(keys[spots], return_counts=True)
    order = np.lexsort((pairs, -times))
    pairs = pairs[order][times[order] >= min_count]
    _, firsts = np.unique(_bucket(pairs), return_index=True)
    pairs = pairs[np.sort(firsts)][:limit]
    if not len(pairs):
        return pairs, symbols, last
    places = np.zeros(1 << _BUCKET_BITS, np.int32)
    places[_bucket(pairs)] = np.arange(len(pairs))
    place = places[buckets[spots]]
    hit = pairs[place] == keys[spots]
    spots, place = spots[hit], place[hit]
    # Occurrences that overlap form runs of neighbouring spots: take every second one of a run.
    fresh = np.ones(len(spots), bool)
    fresh[1:] = np.diff(spots) != 1
    starts = np.maximum.accumulate(np.where(fresh, np.arange(len(spots)), 0))
    taken = (np.arange(len(spots)) - starts) % 2 == 0
    spots, place = spots[taken], place[taken]
    symbols, last, kept = symbols.copy(), last.copy(), np.ones(len(symbols), bool)
    symbols[spots] = base + place
    kept[spots + 1] = False
    last[spots] = last[spots + 1]
    return pairs, symbols[kept], last[kept]


def _bucket(keys: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _BUCKET_BITS)).astype(np.int32)


def compressed(ids: np.ndarray, counts: np.ndarray, base: int) -> dict:
    """Grammar and symbols of one block: ``ids`` of all documents and the number of ids by document."""
    symbols = ids.astype(np.uint32)
    last = np.zeros(len(symbols), bool)
    last[np.cumsum(counts) - 1] = True  # every document has its end id
    left, right, lengths, rounds = [], [], np.ones(base, np.uint32), []
    room = (1 << 16) - base if base < 1 << 16 else 1 << 20
    while len(rounds) < MAX_ROUNDS and len(symbols) > 1:
        before = len(symbols)
        limit = min(PAIRS_A_ROUND, base + room - len(lengths))
        pairs, symbols, last = replaced_once(symbols, last, len(lengths), limit) if limit else ([], symbols, last)
        if not len(pairs):
            break
        left.append((pairs >> np.uint64(32)).astype(np.uint32))
        right.append((pairs & np.uint64(0xFFFFFFFF)).astype(np.uint32))
        lengths = np.concatenate([lengths, lengths[left[-1]] + lengths[right[-1]]])
        rounds.append(len(pairs))
        if before - len(symbols) < MIN_GAIN * before:
            break
    width = 2 if len(lengths) <= 1 << 16 else 4
    ends = np.flatnonzero(last)
    joined = (lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.uint32))
    return {
        "doc_symbols": np.diff(np.concatenate([[-1], ends])).astype("<u4").tobytes(),
        "symbols": symbols.astype(f"<u{width}").tobytes(),
        "width": width,
        "left": joined(left).astype("<u4").tobytes(),
        "right": joined(right).astype("<u4").tobytes(),
        "lengths": lengths[base:].astype("<u4").tobytes(),
        "rounds": rounds,
    }


def rule_expansions(block: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every symbol: where its expansion begins in a flat array of ids, and its length."""
    base = block["base"]
    left, right = (np.frombuffer(block[side], "<u4").astype(np.int64) for side in ("left", "right"))
    lengths = np.concatenate([np.ones(base, np.int64), np.frombuffer(block["lengths"], "<u4").astype(np.int64)])
    starts = np.cumsum(lengths) - lengths
    flat = np.empty(int(lengths.sum()), np.uint32)
    flat[:base] = np.arange(base)
    done = 0
    for count in block["rounds"]:  # the rules of a round stand on earlier ones only
        rules = np.arange(done, done + count)
        for half, begin in ((left, starts[base + rules]), (right, starts[base + rules] + lengths[left[rules]])):
            own = half[rules]
            sizes = lengths[own]
            steps = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            flat[np.repeat(begin, sizes) + steps] = flat[np.repeat(starts[own], sizes) + steps]
        done += count
    return flat, starts, lengths


def expanded(block: dict, first: int = 0, stop: int | None = None) -> np.ndarray:
    """The ids of documents ``first`` to ``stop`` of a block; other documents' symbols are not touched."""
    counts = np.cumsum(np.concatenate([[0], np.frombuffer(block["doc_symbols"], "<u4").astype(np.int64)]))
    stop = len(counts) - 1 if stop is None else stop
    symbols = np.frombuffer(block["symbols"], f"<u{block['width']}")[counts[first] : counts[stop]]
    flat, starts, lengths = rule_expansions(block)
    sizes = lengths[symbols]
    before = np.cumsum(sizes) - sizes
    return flat[np.repeat(starts[symbols] - before, sizes) + np.arange(int(sizes.sum()))]


def write_token_shards(
    df: DataFrame,
    path: str,
    tokenizer_path: str,
    end_id: int,
    id_column: str = "doc_id",
    text_column: str = "text",
    block_tokens: int = BLOCK_TOKENS,
) -> None:
    """Encode every text, append ``end_id`` and write the blocks to ``path`` in ascending id order."""

    def run(batches):
        table, shard, number = word_table(tokenizer_path), TaskContext.get().partitionId(), 0
        base = max(table.vocabulary, end_id + 1)
        ids, counts, docs, held, before = [], [], [], 0, 0

        def block():
            tokens, sizes = np.concatenate(ids), np.concatenate(counts)
            row = compressed(tokens, sizes, base) | {
                "shard": shard, "block": number, "doc_ids": docs, "base": base, "n_tokens": len(tokens),
                "first_id": docs[0], "doc_tokens": sizes.astype("<u4").tobytes(), "before": before,
            }
            return pa.RecordBatch.from_pylist([{name: row[name] for name in _ARROW.names}], schema=_ARROW)

        for rows in row_blocks(batches):
            texts = [text or "" for text in column_of(rows, "text").to_pylist()]
            values, sizes = table.encoded(texts)
            total = int(sizes.sum()) + len(sizes)
            if held and held + total > block_tokens:
                yield block()
                number, before, ids, counts, docs, held = number + 1, before + held, [], [], [], 0
            # The end id goes behind each document's own ids.
            ids.append(np.insert(values, np.cumsum(sizes), end_id))
            counts.append(sizes + 1)
            docs = docs + column_of(rows, "id").to_pylist()
            held += total
        if held:
            yield block()

    rows = df.select(df[id_column].cast("long").alias("id"), df[text_column].cast("string").alias("text"))
    ordered = rows.repartitionByRange(F.asc_nulls_first("id")).sortWithinPartitions(F.asc_nulls_first("id"), "text")
    ordered.mapInArrow(run, _SCHEMA).write.mode("overwrite").parquet(path)


_ARROW = pa.schema(
    [
        ("shard", pa.int32()), ("block", pa.int32()), ("first_id", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
        ("doc_tokens", pa.binary()), ("doc_symbols", pa.binary()), ("symbols", pa.binary()), ("width", pa.int32()),
        ("base", pa.int32()), ("left", pa.binary()), ("right", pa.binary()), ("lengths", pa.binary()),
        ("rounds", pa.list_(pa.int32())), ("n_tokens", pa.int64()), ("before", pa.int64()),
    ]
)


def shard_starts(blocks: DataFrame) -> DataFrame:
    """``shard, first``: ids in all earlier shards.  A row per write task, so one ordered sum is small."""
    ordered = F.struct(F.col("first_id").isNotNull(), "first_id")
    shards = blocks.groupBy("shard").agg(F.min(ordered).alias("key"), F.sum("n_tokens").alias("tokens"))
    before = F.sum("tokens").over(Window.orderBy("key").rowsBetween(Window.unboundedPreceding, -1))
    return shards.select("shard", F.coalesce(before, F.lit(0)).alias("first"))


def read_token_shards(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` for every document; ``ids`` are packed little-endian u4."""
    blocks = spark.read.parquet(path)
    starts = shard_starts(blocks.select("shard", "first_id", "n_tokens"))
    if blocks.select("shard").distinct().count() <= BROADCAST_SHARDS:  # 16 bytes a row
        starts = F.broadcast(starts)

    def run(batches):
        for batch in batches:
            for block in batch.to_pylist():
                data = expanded(block).astype("<u4", copy=False).tobytes()
                counts = np.frombuffer(block["doc_tokens"], "<u4").astype(np.int64)
                ends = np.cumsum(counts)
                parts = [data[4 * (end - count) : 4 * end] for end, count in zip(ends.tolist(), counts.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(block["doc_ids"], pa.int64()),
                        pa.array(block["first"] + block["before"] + ends - counts, pa.int64()),
                        pa.array(counts, pa.int64()),
                        pa.array(parts, pa.binary()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids"],
                )

    kept = ("doc_ids", "doc_tokens", "doc_symbols", "symbols", "width", "base", "left", "right", "lengths", "rounds")
    rows = blocks.join(starts, "shard").select("first", "before", *kept)
    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")
