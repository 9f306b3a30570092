"""Operator 3: documents that hold passages of a benchmark, by a prefix-filtered set join.

A benchmark item is cut into windows of ``window`` words (a shorter item is one window), a window into
shingles of ``shingle`` words.  A document holds a window only if it holds all its shingles, so any one
of them is a sufficient prefix: the rarest one, counted over all documents, is joined.

1. Documents are scanned once.  Shingles whose hash is absent from a bitmap of fixed size over all
   benchmark shingles are passed over; what remains are runs of words, kept with their place.  A benchmark
   larger than the bitmap lets more runs through and changes no result.
2. Equal runs of different documents are joined once, so a passage in a third of all documents is one row.  A
   shingle carries only the words that a window around it can have, so the work is linear in a run's length.
3. Shingles are ordered by rarity; windows with a shingle that no document has are out; the rarest shingle
   of each other window meets the runs' shingles; place and length bounds drop windows that would begin
   before or end behind the run; the words themselves are compared at last.
4. Hits return to the documents by their run, those of frequent runs dealt to many tasks.
   All item ids of one run are held in one row.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z.  Null texts have no words and no
hits; items without words have no windows.  Repeated rows of documents are judged one by one, repeated items
count once; an item without an id marks words but is not listed.  Other columns are left out.  Empty tables
give no rows, or rows without hits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slopeworks.llm.blocks import column_of, row_blocks, runs, shingle_hashes, span_hashes, text_bytes
from slopeworks.llm.graph import bitmap, held, join_salted, row_key, without_ids
from slopeworks.shared import settled

WINDOW = 10
SHINGLE = 5
# The bitmap has 2 ** FILTER_BITS bits: 4 MB.
FILTER_BITS = 25
# Places of a run handed on at once.
_PLACES = 4096

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[128:] = True
_RUN = "struct<size:int,at:bigint,words:string>"


def block_words(texts: pa.Array) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes of the texts, word starts and ends, and the number of words before each text."""
    data, breaks = text_bytes(texts)
    data = _LOWER[data]
    starts, ends, before = runs(_IS_WORD[data], breaks)
    return data, starts, ends, before


def benchmark_windows(items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """``item_id, window (words joined by a space), n, size, buckets`` for every window of every item;
    ``buckets`` are the places of its shingles in the bitmap."""

    def run(batches):
        for block in row_blocks(batches):
            data, starts, ends, before = block_words(column_of(block, "text"))
            words = [data[a:b].tobytes().decode() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
            keys = span_hashes(data, starts, ends)
            hashes = {size: shingle_hashes(keys, size) for size in range(1, shingle + 1)}
            rows = []
            for item, first, stop in zip(
                column_of(block, "id").to_pylist(), before[:-1].tolist(), before[1:].tolist(), strict=True
            ):
                length = min(window, stop - first)
                size = min(shingle, length)
                for at in range(first, stop - length + 1) if length else ():
                    places = hashes[size][at : at + length - size + 1] >> np.uint64(64 - FILTER_BITS)
                    rows.append((item, " ".join(words[at : at + length]), length, size, places.tolist()))
            names = ("item_id", "window", "n", "size", "buckets")
            yield pa.RecordBatch.from_pylist([dict(zip(names, row, strict=True)) for row in rows], schema=schema)

    schema = pa.schema(
        [("item_id", pa.string()), ("window", pa.string()), ("n", pa.int32()), ("size", pa.int32())]
        + [("buckets", pa.list_(pa.int64()))]
    )
    rows = items.select(F.col("item_id").cast("string").alias("id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "item_id string, window string, n int, size int, buckets array<bigint>").distinct()


def _scanned(documents: DataFrame, filter_words, sizes: list[int], id_type: str) -> DataFrame:
    """Every document with its number of words and its runs of possible benchmark shingles."""

    def run(batches):
        words_of_filter = filter_words.value
        for block in row_blocks(batches):
            data, starts, ends, before = block_words(column_of(block, "text"))
            found: list[list[dict]] = [[] for _ in range(block.num_rows)]
            words = span_hashes(data, starts, ends)
            owner = np.repeat(np.arange(block.num_rows), np.diff(before))
            for size in sizes:
                hashes = shingle_hashes(words, size)
                inside = owner[: len(hashes)] == owner[size - 1 :] if len(hashes) else np.zeros(0, bool)
                possible = held(words_of_filter, hashes >> np.uint64(64 - FILTER_BITS))
                firsts, stops, _ = runs(possible & inside, before)
                for row, first, stop in zip(
                    (np.searchsorted(before, firsts, "right") - 1).tolist(), firsts.tolist(), stops.tolist(), strict=True
                ):
                    last = stop + size - 1
                    spans = zip(starts[first:last].tolist(), ends[first:last].tolist(), strict=True)
                    text = b" ".join(data[a:b].tobytes() for a, b in spans).decode()
                    found[row].append({"size": size, "at": first - int(before[row]), "words": text})
            yield pa.RecordBatch.from_arrays(
                [column_of(block, "id"), pa.array(np.diff(before), pa.int64()), pa.array(found, kind)],
                ["doc_id", "n_words", "runs"],
            )

    kind = pa.list_(pa.struct([("size", pa.int32()), ("at", pa.int64()), ("words", pa.string())]))
    return documents.mapInArrow(run, f"doc_id {id_type}, n_words long, runs array<{_RUN}>")


def _run_grams(texts: DataFrame, window: int) -> DataFrame:
    """Every shingle of every run (``run, size, words, times``) by its place ``at``, with the run's ``length`` and what
    a window that holds the shingle may cover: ``around``, in which ``before`` words stand before the shingle.  So a
    row has at most ``2 * window`` words, however long its run is."""

    def run(batches):
        for block in row_blocks(batches, "words"):
            columns = [column_of(block, name).to_pylist() for name in ("run", "size", "words", "times")]
            for number, size, text, times in zip(*columns, strict=True):
                words = text.split(" ")
                for first in range(0, len(words) - size + 1, _PLACES):
                    places = range(first, min(first + _PLACES, len(words) - size + 1))
                    lows = [max(at - window + size, 0) for at in places]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([number] * len(places), pa.int64()),
                            pa.array([size] * len(places), pa.int32()),
                            pa.array([times] * len(places), pa.int64()),
                            pa.array(places, pa.int64()),
                            pa.array([len(words)] * len(places), pa.int64()),
                            pa.array([" ".join(words[at : at + size]) for at in places], pa.string()),
                            pa.array([at - low for at, low in zip(places, lows, strict=True)], pa.int32()),
                            pa.array([" ".join(words[low : at + window]) for at, low in zip(places, lows, strict=True)]),
                        ],
                        ["run", "size", "times", "at", "length", "gram", "before", "around"],
                    )

    schema = "run long, size int, times long, at long, length long, gram string, before int, around string"
    return texts.select("run", "size", "words", "times").mapInArrow(run, schema)


def _covered(spans: Column) -> Column:
    """How many places a list of spans (start, end) covers."""
    zero = F.struct(F.lit(0).cast("long").alias("covered"), F.lit(0).cast("long").alias("end"))

    def add(total, span):
        fresh = F.greatest(F.lit(0).cast("long"), span["end"] - F.greatest(span["start"], total["end"]))
        return F.struct((total["covered"] + fresh).alias("covered"), F.greatest(total["end"], span["end"]).alias("end"))

    return F.aggregate(F.array_sort(spans), zero, add, lambda total: total["covered"])


def contamination(documents: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, n_words, n_hit, items``: words of each document, how many of them lie in an occurrence of a
    window, and the ids (as sorted strings) of the items whose windows occur."""
    spark = documents.sparkSession
    id_type = documents.schema["doc_id"].dataType.simpleString()
    windows = settled(benchmark_windows(items, window, shingle))
    sizes = sorted(row["size"] for row in windows.select("size").distinct().collect())  # at most ``shingle``
    filter_words = spark.sparkContext.broadcast(bitmap(windows, F.explode("buckets"), FILTER_BITS))
    rows = documents.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text"))
    scanned = settled(_scanned(rows, filter_words, sizes, id_type)).withColumn("row", F.monotonically_increasing_id())
    found = scanned.select("row", F.explode("runs").alias("run")).select("row", "run.*")

    # Equal runs once, with the number of documents that hold them; from here on a run goes by its number.
    texts = settled(found.groupBy("size", "words").agg(F.count("*").alias("times")))
    texts = texts.withColumn("run", F.monotonically_increasing_id())
    grams = _run_grams(texts, window)
    rarity = grams.groupBy("size", "gram").agg(F.sum("times").alias("times"))
    parts = windows.select("window", "n", "size").distinct().withColumn("own", F.split("window", " "))
    parts = parts.withColumn("offset", F.explode(F.expr("sequence(0, n - size)")))
    parts = parts.withColumn("gram", F.array_join(F.expr("slice(own, offset + 1, size)"), " ")).drop("own")
    prefix = (
        parts.join(rarity, ["size", "gram"], "left")
        .groupBy("window", "n", "size")
        .agg(
            F.min(F.struct("times", "offset", "gram")).alias("rarest"),
            F.max(F.col("times").isNull()).alias("absent"),
        )
        .filter(~F.col("absent"))
        .select("window", "n", "size", "rarest.offset", "rarest.gram")
    )
    met = grams.join(prefix, ["size", "gram"])
    met = met.withColumn("start", F.col("at") - F.col("offset"))
    met = met.filter((F.col("start") >= 0) & (F.col("start") + F.col("n") <= F.col("length")))
    own = F.split("around", " ")
    met = met.filter(F.array_join(F.slice(own, F.col("before") - F.col("offset") + 1, F.col("n")), " ") == F.col("window"))
    named = met.select("run", "window", "start", "n").join(windows.select("window", "item_id"), "window")
    run_hits = named.groupBy("run").agg(
        F.collect_set(F.struct("start", (F.col("start") + F.col("n")).alias("end"))).alias("spans"),
        F.collect_set("item_id").alias("items"),
    )
    # A passage that many documents share is one hot key.
    same = F.struct("size", F.xxhash64("words").alias("one"), F.xxhash64(F.lit(1), "words").alias("two")).alias("same")
    run_hits = settled(texts.join(run_hits, "run").select(same, F.col("words").alias("own"), "times", "spans", "items"))
    total = run_hits.agg(F.sum("times")).first()[0] or 0
    hits = join_salted(found.select("row", "at", "words", same), run_hits, "same", "times", total, "row")
    hits = hits.filter(F.col("words") == F.col("own")).select(
        "row",
        F.transform("spans", lambda s: F.struct((s["start"] + F.col("at")).alias("start"), (s["end"] + F.col("at")).alias("end"))).alias("spans"),
        "items",
    )
    by_row = hits.groupBy("row").agg(
        F.flatten(F.collect_list("spans")).alias("spans"), F.flatten(F.collect_list("items")).alias("items")
    )
    none = F.array().cast("array<string>")
    return scanned.drop("runs").join(by_row, "row", "left").select(
        "doc_id",
        "n_words",
        F.coalesce(_covered("spans"), F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce(F.array_sort(F.array_distinct("items")), none).alias("items"),
    )


def clean(documents: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``documents``, all columns as they are, that hold no window; a row goes for its own text only,
    whatever other rows share its id."""
    rows = documents.withColumn("__key", row_key("doc_id", "text"))
    found = contamination(rows.select(F.col("__key").alias("doc_id"), "text"), items).filter("n_hit > 0")
    return without_ids(rows, "__key", found.select(F.col("doc_id").alias("__key"))).drop("__key")
