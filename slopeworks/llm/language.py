"""Operator 9: language by word-first backoff.

Words (runs of letters, lower-cased) and character n-grams of words (with a mark at either end) are counted
by language over all training texts.  A text's words vote: a known word by its log frequency in every
language; an unseen word by the mean log frequency of its known character n-grams of the longest order that
has any, from ``MAX_ORDER`` down to 1.  A word with no known n-gram does not vote.

No word and no n-gram is dropped: the ``MAX_WORDS`` most frequent words and ``MAX_GRAMS`` n-grams an order are broadcast,
the others stay tables.  A text's votes of broadcast words are summed where it is read; its other words are joined as
keys with their number, and n-grams are looked up once for each distinct unseen word, joined where a bitmap cannot rule
them out.  Keys are 64-bit hashes.

Texts that are null or have no letter are ``und`` with score 0, and so is every text if there is nothing
to learn from.  Rows with a null language or text teach nothing; an empty table gives no rows.  Every input row
gives one output row, repeated rows and rows without an id included; equally likely languages are taken in
alphabetical order.  A very long text is a block of its own, a very long word travels once for each task that meets
it.  Other columns are left out.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slopeworks.llm.blocks import column_of, letter_words, list_array, row_blocks, shingle_hashes, span_hashes, sums_by_text
from slopeworks.llm.graph import ID_BITS, bitmap, held, join_spread
from slopeworks.shared import removed, written

MAX_ORDER = 4
# Words, and n-grams an order, in the broadcast; the others are joined.
MAX_WORDS = 1 << 17
MAX_GRAMS = 1 << 16
# Entries a task gathers before it hands them on.
_GATHERED = 1 << 20
# Distinct words a task remembers to have named.
_NAMED = 1 << 20
_ALPHA = 0.5


@dataclass
class LanguageModel:
    """``keys`` (sorted) and ``votes`` (log frequency in every language) of the most frequent words, and the same by
    order in ``grams``; ``rest`` (``key, votes``) and ``rest_grams`` (``n, key, votes``) have the others, if any."""

    languages: list[str]
    keys: np.ndarray
    votes: np.ndarray
    rest: DataFrame | None = None
    grams: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)
    rest_grams: DataFrame | None = None


def _gram_spans(points, starts, ends, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams of words, and the word each belongs to.  A word stands between two marks."""
    sizes = ends - starts + 2
    offsets = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(starts)), sizes)
    inside = np.arange(int(sizes.sum())) - offsets[owner]
    marked = np.zeros(len(owner), np.uint64)
    letter = (inside > 0) & (inside < sizes[owner] - 1)
    marked[letter] = points[(starts[owner] + inside - 1)[letter]].astype(np.uint64)
    hashes = shingle_hashes(marked + np.uint64(1), order)
    own = owner[: len(hashes)]
    kept = own == owner[order - 1 :] if len(hashes) else np.zeros(0, bool)
    if order == 1:
        kept &= letter  # a mark alone says nothing
    return hashes[kept], own[kept]


def _gathered(batches):
    """``lang, n, key, times`` of the texts of a task, summed in the task."""
    held: dict[tuple[str, int], list[pd.Series]] = {}
    size = 0

    def flush():
        for (lang, order), parts in held.items():
            total = pd.concat(parts).groupby(level=0, sort=False).sum()
            count = len(total)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * count, pa.string()),
                    pa.array(np.full(count, order, np.int32)),
                    pa.array(total.index.to_numpy().view(np.int64)),
                    pa.array(total.to_numpy(np.int64)),
                ],
                ["lang", "n", "key", "times"],
            )

    for block in row_blocks(batches):
        texts, langs = column_of(block, "text").to_pylist(), column_of(block, "lang").to_pylist()
        for lang in sorted(set(langs)):
            points, starts, ends, _ = letter_words([t for t, own in zip(texts, langs, strict=True) if own == lang])
            if not len(starts):
                continue
            codes, keys = pd.factorize(span_hashes(points, starts, ends))
            times = np.bincount(codes)
            first = np.empty(len(keys), np.int64)
            first[codes[::-1]] = np.arange(len(codes))[::-1]
            held.setdefault((lang, 0), []).append(pd.Series(times, keys))
            size += len(keys)
            for order in range(1, MAX_ORDER + 1):
                grams, own = _gram_spans(points, starts[first], ends[first], order)
                codes_, keys_ = pd.factorize(grams)
                held.setdefault((lang, order), []).append(
                    pd.Series(np.bincount(codes_, times[own], len(keys_)).astype(np.int64), keys_)
                )
                size += len(keys_)
        if size > 4 * _GATHERED:
            held = {key: [pd.concat(parts).groupby(level=0, sort=False).sum()] for key, parts in held.items()}
            size = sum(len(parts[0]) for parts in held.values())
            if size > _GATHERED:
                yield from flush()
                held, size = {}, 0
    yield from flush()


def train(df: DataFrame, text_column: str = "text", lang_column: str = "lang") -> LanguageModel:
    """Learn from every row with a text and a language."""
    spark = df.sparkSession
    rows = df.select(df[text_column].cast("string").alias("text"), df[lang_column].cast("string").alias("lang"))
    rows = rows.filter("text is not null and lang is not null")
    counts, path = written(
        rows.mapInArrow(_gathered, "lang string, n int, key long, times long")
        .groupBy("n", "key", "lang")
        .agg(F.sum("times").alias("times")),
        "language-counts",
    )
    languages = sorted(row["lang"] for row in counts.select("lang").distinct().collect())
    if not languages:
        removed(spark, path)
        return LanguageModel([], np.zeros(0, np.uint64), np.zeros((0, 0), np.float32))
    own = [F.sum(F.when(F.col("lang") == lang, F.col("times")).otherwise(0)) for lang in languages]
    table = counts.groupBy("n", "key").agg(F.sum("times").alias("total"), F.array(*own).alias("times"))
    table, table_path = written(table, "language-table")
    removed(spark, path)
    whole = table.groupBy("n").agg(F.count("*").alias("keys"), F.array(*[F.sum(F.col("times")[k]) for k in range(len(languages))]).alias("sums"))
    # One row for words and one an order: what a count is divided by.
    below = {row["n"]: [total + _ALPHA * row["keys"] for total in row["sums"]] for row in whole.collect()}

    def votes(order: int) -> Column:
        parts = [F.log((F.col("times")[k] + _ALPHA) / F.lit(float(total))) for k, total in enumerate(below[order])]
        return F.array(*parts).cast("array<float>")

    chosen = F.when(F.col("n") == 0, votes(0))
    for order in sorted(set(below) - {0}):
        chosen = chosen.when(F.col("n") == order, votes(order))
    model, _ = written(table.select("n", "key", "total", chosen.alias("votes")), "language-votes")
    removed(spark, table_path)
    keys, logs, rest = _split(model.filter("n = 0"), MAX_WORDS, len(languages))
    grams, others = {}, []
    for order in range(1, MAX_ORDER + 1):
        own_keys, own_logs, other = _split(model.filter(F.col("n") == order), MAX_GRAMS, len(languages))
        grams[order] = own_keys, own_logs
        others += [other.select("n", "key", "votes")] if other is not None else []
    return LanguageModel(languages, keys, logs, rest, grams, reduce(DataFrame.unionByName, others) if others else None)


def _split(table: DataFrame, most: int, languages: int) -> tuple[np.ndarray, np.ndarray, DataFrame | None]:
    """Keys (sorted) and votes of the most frequent entries of ``n, key, total, votes``, and the others as a table."""
    top = table.orderBy(F.desc("total"), "key").limit(most + 1).select("total", "key", "votes").toArrow().to_pandas()
    rest = None
    if len(top) > most:
        top = top.iloc[:most]
        total, key = (F.lit(int(top.iloc[-1][name])) for name in ("total", "key"))
        rest = table.filter((F.col("total") < total) | ((F.col("total") == total) & (F.col("key") > key)))
    keys = top["key"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(keys)
    logs = np.stack(top["votes"].to_list()).astype(np.float32) if len(top) else np.zeros((0, languages), np.float32)
    return keys[order], logs[order], rest


def _looked_up(keys: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    spots = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    return table[spots] == keys, spots


def _structs(counts: np.ndarray, **columns) -> pa.ListArray:
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(list(columns.values()), list(columns)))


def _read(rows: DataFrame, model: LanguageModel, id_type: str) -> DataFrame:
    """``id``, a number ``row``, the number ``n`` of words, the sum ``votes`` of the broadcast words' votes, the other
    words (``asked``: keys and how often), and ``fresh``: those of them that the task has not named yet."""
    shared = rows.sparkSession.sparkContext.broadcast((model.keys, model.votes))  # bounded by MAX_WORDS

    def run(batches):
        known_keys, known_votes = shared.value
        row, seen = TaskContext.get().partitionId() << 33, set()
        for block in row_blocks(batches):
            size = block.num_rows
            points, starts, ends, before = letter_words([text or "" for text in column_of(block, "text").to_pylist()])
            codes, keys = pd.factorize(span_hashes(points, starts, ends))
            first = np.empty(len(keys), np.int64)
            first[codes[::-1]] = np.arange(len(codes))[::-1]
            known, spots = _looked_up(keys, known_keys)
            votes = np.zeros((len(keys), known_votes.shape[1]))
            votes[known] = known_votes[spots[known]]
            open_ = np.flatnonzero(~known[codes])
            owner = np.repeat(np.arange(size), np.diff(before))[open_]
            pairs, number = np.unique(owner * max(len(keys), 1) + codes[open_], return_counts=True)
            asked, code = np.divmod(pairs, max(len(keys), 1))
            signed = keys.view(np.int64)
            new = [k for k in np.flatnonzero(~known).tolist() if int(signed[k]) not in seen]
            if len(seen) + len(new) > _NAMED:
                seen.clear()
            seen.update(signed[new].tolist())
            named = [points[starts[first[k]] : ends[first[k]]].tobytes().decode("utf-32-le") for k in new]
            sums = sums_by_text(votes[codes], before) if len(codes) else np.zeros((size, votes.shape[1]))
            yield pa.RecordBatch.from_arrays(
                [
                    column_of(block, "id"),
                    pa.array(np.arange(row, row + size)),
                    pa.array(np.diff(before), pa.int64()),
                    list_array(sums.ravel(), np.full(size, votes.shape[1]), pa.float64()),
                    _structs(np.bincount(asked, minlength=size), key=pa.array(signed[code]), number=pa.array(number, pa.int64())),
                    # Named in the block's first row, whichever row has them.
                    _structs(np.bincount([0], [len(new)], size).astype(np.int64), key=pa.array(signed[new], pa.int64()), word=pa.array(named, pa.string())),
                ],
                ["id", "row", "n", "votes", "asked", "fresh"],
            )
            row += size

    schema = f"id {id_type}, row long, n long, votes array<double>"
    return rows.mapInArrow(run, schema + ", asked array<struct<key:bigint,number:bigint>>, fresh array<struct<key:bigint,word:string>>")


def _gram_votes(words: DataFrame, model: LanguageModel) -> DataFrame:
    """For words ``key, word``, from the longest order down to one with a broadcast n-gram: ``key, n``, how many of the
    word's n-grams are in the broadcast, the sum of their votes, and which may be in the rest (``asked``)."""
    languages = len(model.languages)
    maybe = bitmap(model.rest_grams, F.shiftrightunsigned("key", 64 - ID_BITS), ID_BITS) if model.rest_grams is not None else None
    # Bounded by MAX_GRAMS an order, and a bitmap of fixed size.
    shared = words.sparkSession.sparkContext.broadcast((model.grams, maybe))

    def run(batches):
        tables, maybe = shared.value
        for block in row_blocks(batches, "word"):
            points, starts, ends, _ = letter_words(column_of(block, "word").to_pylist())
            keys = span_hashes(points, starts, ends).view(np.int64)
            open_ = np.arange(len(keys))
            for order in range(MAX_ORDER, 0, -1):
                grams, own = _gram_spans(points, starts[open_], ends[open_], order)
                hit, spots = _looked_up(grams, tables[order][0])
                number = np.bincount(own[hit], minlength=len(open_))
                ask = np.zeros(len(grams), bool) if maybe is None else ~hit & held(maybe, grams >> np.uint64(64 - ID_BITS))
                asks = np.bincount(own[ask], minlength=len(open_))
                sums = np.zeros((len(open_), languages))
                for place in range(languages):
                    sums[:, place] = np.bincount(own[hit], tables[order][1][spots[hit], place], len(open_))
                told = (number > 0) | (asks > 0)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys[open_[told]]),
                        pa.array(np.full(int(told.sum()), order, np.int32)),
                        pa.array(number[told], pa.int64()),
                        list_array(sums[told].ravel(), np.full(int(told.sum()), languages), pa.float64()),
                        list_array(grams[ask].view(np.int64), asks[told], pa.int64()),
                    ],
                    ["key", "n", "number", "sums", "asked"],
                )
                open_ = open_[number == 0]

    return words.select("word").mapInArrow(run, "key long, n int, number long, sums array<double>, asked array<long>")


def _per_language(languages: int, function, column: str = "votes") -> Column:
    return F.array(*[function(F.col(column)[k].cast("double")) for k in range(languages)])


def backed_off(words: DataFrame, model: LanguageModel) -> DataFrame:
    """``key, votes`` of words ``key, word`` by the longest order of which any n-gram is known; none without one."""
    size = len(model.languages)
    found = _gram_votes(words, model)
    if model.rest_grams is not None:
        found, _ = written(found, "language-grams")
        asked = found.select("key", "n", F.explode("asked").alias("gram")).select("key", "n", F.struct("n", "gram").alias("which"))
        times = asked.groupBy("which").agg(F.count("*").alias("times"))
        rest = model.rest_grams.select(F.struct("n", F.col("key").alias("gram")).alias("which"), "votes")
        known, _ = written(times.join(rest, "which"), "language-known-grams")
        total = known.agg(F.sum("times")).first()[0] or 0
        met = join_spread(asked, known, "which", "times", total).groupBy("key", "n")
        met = met.agg(F.count("*").alias("number"), _per_language(size, F.sum).alias("sums"))
        found = found.select("key", "n", "number", "sums").unionByName(met).groupBy("key", "n")
        found = found.agg(F.sum("number").alias("number"), _per_language(size, F.sum, "sums").alias("sums"))
    means = found.filter("number > 0").select("key", "n", F.transform("sums", lambda total: total / F.col("number")).alias("votes"))
    return means.groupBy("key").agg(F.max_by("votes", "n").alias("votes"))


def _other_votes(marked: DataFrame, model: LanguageModel) -> DataFrame:
    """``row, more``: the votes of the words that were not in the broadcast."""
    size = len(model.languages)
    asked = marked.select("row", F.explode("asked").alias("one")).select("row", "one.key", "one.number")
    named = asked.groupBy("key").agg(F.count("*").alias("times"))
    if model.rest is None:
        unseen = named.withColumn("votes", F.lit(None).cast("array<double>"))
    else:
        unseen = named.join(model.rest.select("key", F.col("votes").cast("array<double>").alias("votes")), "key", "left")
    named, _ = written(unseen, "language-asked")
    words = marked.select(F.explode("fresh").alias("one")).groupBy("one.key").agg(F.min("one.word").alias("word"))
    unseen = named.filter("votes is null").select("key", "times")
    votes = unseen.join(backed_off(unseen.join(words, "key"), model), "key")
    resolved, _ = written(named.filter("votes is not null").unionByName(votes), "language-resolved")
    total = resolved.agg(F.sum("times")).first()[0] or 0
    met = join_spread(asked, resolved, "key", "times", total)
    return met.groupBy("row").agg(_per_language(size, lambda vote: F.sum(vote * F.col("number"))).alias("more"))


def identify(df: DataFrame, model: LanguageModel, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The id column, ``lang_pred`` and ``score`` (its share of the likelihood, all languages being equally likely
    before) for every row."""
    id_type = df.schema[id_column].dataType.simpleString()
    rows = df.select(df[id_column].alias("id"), df[text_column].cast("string").alias("text"))
    if not model.languages:
        return rows.select(F.col("id").alias(id_column), F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    marked, _ = written(_read(rows, model, id_type), "language-rows")
    more = _other_votes(marked, model)
    none = F.array_repeat(F.lit(0.0), len(model.languages))
    votes = F.zip_with("votes", F.coalesce("more", none), lambda a, b: a + b)
    judged = marked.select("id", "row", "n", "votes").join(more, "row", "left").select("id", "n", votes.alias("votes"))
    best = F.array_max("votes")
    share = F.aggregate("votes", F.lit(0.0), lambda total, vote: total + F.exp(vote - best))
    first = F.array_position("votes", best).cast("int")
    names = F.array(*[F.lit(lang) for lang in model.languages])
    return judged.select(
        F.col("id").alias(id_column),
        F.when(F.col("n") > 0, F.element_at(names, first)).otherwise(F.lit("und")).alias("lang_pred"),
        F.when(F.col("n") > 0, 1 / share).otherwise(F.lit(0.0)).alias("score"),
    )
