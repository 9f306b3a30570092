"""Operator 7: quality by a generalised additive model with pairwise interactions.

Features of the whole text (shares of character kinds, lengths, repetition) are cut into bins.  Shallow
trees are boosted in turn, one feature after the other, round after round; the trees of a feature add up to
one lookup table over its bins.  Then the pairs of features that explain most of what is left get tables of
their own, boosted the same way.  A score is the sum of the looked-up entries through the logistic
function.

The model is fitted on at most ``SAMPLE`` labelled documents (those with the smallest hash of the id); the tables
have ``BINS`` entries per feature and ``PAIR_BINS`` squared per pair.  Null and empty texts have features, all
zero, and get a score.  Without labelled rows every score is 0.5.  Repeated rows are scored each; a document
with several labels has its largest.  Other columns are left out.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slopeworks.llm.blocks import column_of, mixed, row_blocks, runs, span_hashes, sums_by_text, text_bytes

SAMPLE = 50_000
BINS = 48
PAIR_BINS = 10
PAIRS = 6
ROUNDS = 160
PAIR_ROUNDS = 60
RATE = 0.12
MIN_LEAF = 12
_SMOOTH = 2.0

FEATURES = (
    "log_bytes", "log_words", "word_length", "letters", "upper", "digits", "marks", "symbols", "pipes", "shouts",
    "spaces", "lines", "line_length", "stops", "distinct_words", "top_word", "same_next", "distinct_lines", "glued",
)


def _mask(*ranges: tuple[int, int]) -> np.ndarray:
    mask = np.zeros(256, bool)
    for first, last in ranges:
        mask[first : last + 1] = True
    return mask


def _these(characters: str) -> np.ndarray:
    mask = np.zeros(256, bool)
    mask[list(characters.encode())] = True
    return mask


_WORD = _mask((33, 255))
_LETTER = _mask((65, 90), (97, 122), (128, 255))
_CLASSES = {
    "letters": _LETTER,
    "upper": _mask((65, 90)),
    "digits": _mask((48, 57)),
    "marks": _these(",;:'\"()-.?"),
    "symbols": _these("#$%&*+=@^_~<>{}[]\\/"),
    "pipes": _these("|"),
    "shouts": _these("!"),
    "spaces": _these(" \t\n\r\x0b\x0c"),
}


def block_features(texts: pa.Array) -> np.ndarray:
    """A row of ``FEATURES`` for every text."""
    data, breaks = text_bytes(texts)
    sizes = np.diff(breaks).astype(np.float64)
    per = np.maximum(sizes, 1)
    out = dict.fromkeys(FEATURES, np.zeros(len(texts)))
    if not len(data):
        return np.zeros((len(texts), len(FEATURES)))
    out["log_bytes"] = np.log1p(sizes)
    for name, mask in _CLASSES.items():
        out[name] = sums_by_text(mask[data], breaks) / per
    starts, ends, before = runs(_WORD[data], breaks)
    words = np.diff(before).astype(np.float64)
    some = np.maximum(words, 1)
    owner = np.repeat(np.arange(len(texts)), np.diff(before))
    lengths = (ends - starts).astype(np.float64)
    out["log_words"] = np.log1p(words)
    out["word_length"] = np.minimum(sums_by_text(lengths, before) / some, 100)
    hashes = span_hashes(data, starts, ends)
    codes, _ = pd.factorize(mixed(hashes ^ (owner.astype(np.uint64) << np.uint64(40))))
    times = np.bincount(codes)
    place = np.zeros(len(times), np.int64)
    place[codes] = owner
    out["distinct_words"] = np.bincount(place, minlength=len(texts)) / some
    top = np.zeros(len(texts))
    np.maximum.at(top, place, times)
    out["top_word"] = top / some
    same = np.zeros(len(hashes))
    same[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    out["same_next"] = sums_by_text(same, before) / some
    closing = _these(".!?")[data[np.maximum(ends - 1, 0)]] if len(ends) else np.zeros(0, bool)
    out["stops"] = sums_by_text(closing, before) / some
    # Words that end in a symbol that is no punctuation.
    glued = _CLASSES["symbols"][data[np.maximum(ends - 1, 0)]] & (lengths > 1) if len(ends) else closing
    out["glued"] = sums_by_text(glued, before) / some
    line_starts, line_ends, line_before = runs(data != 10, breaks)
    lines = np.maximum(np.diff(line_before).astype(np.float64), 1)
    line_owner = np.repeat(np.arange(len(texts)), np.diff(line_before)).astype(np.uint64)
    kinds, _ = pd.factorize(mixed(span_hashes(data, line_starts, line_ends) ^ (line_owner << np.uint64(40))))
    line_place = np.zeros(int(kinds.max()) + 1 if len(kinds) else 0, np.int64)
    line_place[kinds] = line_owner.astype(np.int64)
    out["distinct_lines"] = np.bincount(line_place, minlength=len(texts)) / lines
    out["lines"] = np.log1p(np.diff(line_before))
    out["line_length"] = np.log1p(sums_by_text((line_ends - line_starts).astype(np.float64), line_before) / lines)
    return np.stack([out[name] for name in FEATURES], axis=1)


def features(df: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The id column and ``features`` (array of double, as ``FEATURES``) for every row."""
    id_type = df.schema[id_column].dataType.simpleString()

    def run(batches):
        for block in row_blocks(batches):
            rows = block_features(column_of(block, "text"))
            flat = pa.array(rows.ravel(), pa.float64())
            offsets = pa.array(np.arange(len(rows) + 1, dtype=np.int32) * len(FEATURES))
            yield pa.RecordBatch.from_arrays(
                [column_of(block, "id"), pa.ListArray.from_arrays(offsets, flat)], ["id", "features"]
            )

    rows = df.select(df[id_column].alias("id"), df[text_column].cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {id_type}, features array<double>").withColumnRenamed("id", id_column)


@dataclass
class AdditiveModel:
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    base: float = 0.0

    def scores(self, rows: np.ndarray) -> np.ndarray:
        total = np.full(len(rows), self.base)
        for place, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += table[np.searchsorted(edges, rows[:, place], "right")]
        for first, second, table in self.pairs:
            one = np.searchsorted(self.coarse[first], rows[:, first], "right")
            two = np.searchsorted(self.coarse[second], rows[:, second], "right")
            total += table[one, two]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    """Cuts between the quantiles; ties share a bin."""
    cuts = np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))
    return cuts[cuts > values.min()]


def _best_cut(gradient: np.ndarray, weight: np.ndarray, count: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best cut of a row of bins; place 0 if there is none."""
    if len(gradient) < 2:
        return 0.0, 0
    g, h, n = np.cumsum(gradient)[:-1], np.cumsum(weight)[:-1], np.cumsum(count)[:-1]
    rest_g, rest_h, rest_n = gradient.sum() - g, weight.sum() - h, count.sum() - n
    gain = g**2 / (h + _SMOOTH) + rest_g**2 / (rest_h + _SMOOTH) - gradient.sum() ** 2 / (weight.sum() + _SMOOTH)
    gain = np.where((n >= MIN_LEAF) & (rest_n >= MIN_LEAF), gain, 0.0)
    at = int(gain.argmax())
    return float(gain[at]), at + 1 if gain[at] > 0 else 0


def _tree(gradient: np.ndarray, weight: np.ndarray, count: np.ndarray, depth: int = 2) -> np.ndarray:
    """The step of a shallow tree over a row of bins."""
    _, cut = _best_cut(gradient, weight, count) if depth else (0.0, 0)
    if not cut:
        return np.full(len(gradient), gradient.sum() / (weight.sum() + _SMOOTH))
    parts = ((slice(None, cut)), (slice(cut, None)))
    return np.concatenate([_tree(gradient[p], weight[p], count[p], depth - 1) for p in parts])


def _pair_tree(gradient: np.ndarray, weight: np.ndarray, count: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and step of a tree that cuts one feature, then the other on either side."""
    whole = gradient.sum() ** 2 / (weight.sum() + _SMOOTH)
    best, step = 0.0, np.zeros_like(gradient)
    for turned in (False, True):
        g, h, n = (x.T if turned else x for x in (gradient, weight, count))
        _, cut = _best_cut(g.sum(1), h.sum(1), n.sum(1))
        if not cut:
            continue
        own, total = np.zeros_like(g), -whole
        for part in (slice(None, cut), slice(cut, None)):
            columns = g[part].sum(0), h[part].sum(0), n[part].sum(0)
            own[part] = _tree(*columns, depth=1)
            total += float((own[part][0] * columns[0]).sum())
        if total > best:
            best, step = total, own.T if turned else own
    return best, step


def fit(rows: np.ndarray, labels: np.ndarray) -> AdditiveModel:
    """Boost one table per feature in turn, then tables for the pairs that explain most of the rest."""
    model = AdditiveModel()
    if not len(rows):
        return model
    share = (labels.sum() + 1) / (len(labels) + 2)
    model.base = float(np.log(share / (1 - share)))
    model.edges = [_edges(column, BINS) for column in rows.T]
    model.coarse = [_edges(column, PAIR_BINS) for column in rows.T]
    model.tables = [np.zeros(len(edges) + 1) for edges in model.edges]
    bins = [np.searchsorted(edges, column, "right") for edges, column in zip(model.edges, rows.T, strict=True)]
    counts = [np.bincount(own, minlength=len(table)) for own, table in zip(bins, model.tables, strict=True)]
    total = np.full(len(rows), model.base)

    def left_over():
        chance = 1 / (1 + np.exp(-total))
        return labels - chance, chance * (1 - chance)

    for _ in range(ROUNDS):
        for own, table, count in zip(bins, model.tables, counts, strict=True):
            gradient, weight = left_over()
            sums = np.bincount(own, gradient, len(table)), np.bincount(own, weight, len(table))
            step = RATE * _tree(*sums, count)
            table += step
            total += step[own]
    coarse = [np.searchsorted(edges, column, "right") for edges, column in zip(model.coarse, rows.T, strict=True)]
    sizes = [len(edges) + 1 for edges in model.coarse]

    def grid(first: int, second: int, values: np.ndarray) -> np.ndarray:
        flat = np.bincount(coarse[first] * sizes[second] + coarse[second], values, sizes[first] * sizes[second])
        return flat.reshape(sizes[first], sizes[second])

    gradient, weight = left_over()
    ones = np.ones(len(rows))
    ranked = sorted(
        (
            (-_pair_tree(grid(a, b, gradient), grid(a, b, weight), grid(a, b, ones))[0], a, b)
            for a in range(len(bins))
            for b in range(a + 1, len(bins))
        )
    )
    model.pairs = [(a, b, np.zeros((sizes[a], sizes[b]))) for gain, a, b in ranked[:PAIRS] if gain < 0]
    for _ in range(PAIR_ROUNDS):
        for a, b, table in model.pairs:
            gradient, weight = left_over()
            _, step = _pair_tree(grid(a, b, gradient), grid(a, b, weight), grid(a, b, ones))
            table += RATE * step
            total += RATE * step[coarse[a], coarse[b]]
    return model


def _asked(labels: DataFrame, id_column: str, label_column: str, sample: int) -> DataFrame:
    """``id, label`` of at most ``sample`` labelled documents, those whose id has the smallest hash."""
    known = labels.filter(F.col(label_column).isNotNull() & F.col(id_column).isNotNull()).groupBy(id_column)
    known = known.agg(F.max(label_column).cast("double").alias("__label"))
    return known.orderBy(F.xxhash64(F.col(id_column).cast("string")), id_column).limit(sample)


def train(
    rows: DataFrame, labels: DataFrame, id_column: str, label_column: str, sample: int = SAMPLE
) -> AdditiveModel:
    """Fit on at most ``sample`` rows of ``rows`` (id and features) that have a label; the labels asked for are
    few enough to be broadcast."""
    asked = F.broadcast(_asked(labels, id_column, label_column, sample))
    taken = rows.select(id_column, "features").join(asked, id_column)
    found = taken.orderBy(id_column, "features").limit(sample).select("features", "__label").toArrow()
    if not len(found):
        return AdditiveModel()
    flat = found["features"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return fit(flat.reshape(len(found), len(FEATURES)), found["__label"].to_numpy())


def train_on_texts(
    rows: DataFrame, labels: DataFrame, id_column: str, text_column: str, label_column: str, sample: int = SAMPLE
) -> AdditiveModel:
    """As ``train``, from texts: features are taken from the labelled rows asked for only."""
    asked = F.broadcast(_asked(labels, id_column, label_column, sample).select(id_column))
    known = rows.join(asked, id_column, "left_semi")
    return train(features(known, id_column, text_column), labels, id_column, label_column, sample)


def score(rows: DataFrame, model: AdditiveModel, id_column: str = "doc_id") -> DataFrame:
    """The id column and ``score`` for rows of id and features."""
    id_type = rows.schema[id_column].dataType.simpleString()

    def run(batches):
        for batch in batches:
            flat = column_of(batch, "features").flatten().to_numpy(zero_copy_only=False)
            scores = model.scores(flat.reshape(-1, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([column_of(batch, "id"), pa.array(scores)], ["id", "score"])

    own = rows.select(rows[id_column].alias("id"), "features")
    return own.mapInArrow(run, f"id {id_type}, score double").withColumnRenamed("id", id_column)


def accepted(df: DataFrame, model: AdditiveModel, limit: float, text_column: str = "text") -> DataFrame:
    """The rows of ``df``, all columns as they are, whose text scores ``limit`` or more."""

    def run(batches):
        for block in row_blocks(batches, text_column):
            scores = model.scores(block_features(column_of(block, text_column)))
            yield block.filter(pa.array(scores >= limit))

    return df.mapInArrow(run, df.schema)
