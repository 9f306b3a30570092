"""Operator 1: toxicity by two class-conditional Kneser-Ney models of word pairs.

Words are runs of letters, lower-cased.  A class's probability of a word behind another comes from three levels: what
the class's count of the pair has above ``PAIR_DISCOUNT``; what the pair's count over both classes has; the class's
probability of the word alone.  A discount frees mass for the next level (``entries`` has the formula).  The last level
is made of Kneser-Ney continuation counts, the number of different words a word stands behind in the class's training
texts, discounted by ``DISCOUNT``; the mass this frees goes to counts both classes share: the continuation count over
both classes, dealt to a class as words of like frequency are dealt between the classes.  A rare expression thus says
nothing of itself: its class probabilities stand in the common ratio; and a pair of copied texts says little.

The log-likelihoods of a text in the toxic and in the ordinary model are compared per word, over the whole text and
over the ``WORST`` words that lean most to the toxic class behind the word before them (all of a shorter text), as the
few toxic words drown in a long text.  A logistic curve over a floor (the share of toxic labels that no ratio explains)
turns the sum of the two, the whole text weighted, into a score; curve and weight are fitted on a fold of the training
rows under counts that leave the fold out, at most ``SAMPLE`` rows.  The model is then that of the counts over every
training row; one pass makes both counts.

Pairs meet by a shuffle on the pair.  A text's ratio is a sum of entries: one for a word, one for the word before it,
and one for a pair where both classes together have it more often than the discount; other pairs add nothing.  The
``MAX_WORDS`` heaviest entries are broadcast; where there are more, the rest stays a table: a text's words whose keys a
bitmap of the rest may hold are joined with it, place by place.

Null texts and texts without words have ratio zero.  With no toxic or no ordinary training rows every score is 0
(or 1 if all are toxic).  Rows without a label teach nothing; a document with several labels has its
largest.  Repeated rows are scored each.  Other columns are left out.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from slopeworks.llm.blocks import column_of, letter_words, list_array, row_blocks, span_hashes
from slopeworks.llm.graph import ID_BITS, bitmap, held, join_spread, maybe_among
from slopeworks.shared import removed, written

WORST = 2
DISCOUNT = 2.0
# The discount of pairs: their counts are occurrences, which copies multiply.
PAIR_DISCOUNT = 5
# Entries (words, contexts, pairs) that are broadcast; further ones are joined.
MAX_WORDS = 1 << 20
# A toxic count weighs as much as so many ordinary ones when the heaviest words are chosen.
TOXIC_WEIGHT = 32
SAMPLE = 20_000
# Distinct pairs a task gathers before it hands them on.
_GATHERED = 1 << 21
_BEGIN = np.uint64(1)
# Keys of entries: a word has 32 bits; a pair has the word before it in the upper half; a context has no lower half.
_HALF = np.uint64(32)
_LOWER = np.uint64(0xFFFFFFFF)
_COUNTS = ("ordinary", "toxic", "types", "more", "both")


def word_keys(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """32-bit word keys of all texts, and the number of words before each text."""
    points, starts, ends, before = letter_words(texts)
    if not len(starts):
        return np.zeros(0, np.uint64), before
    return span_hashes(points, starts, ends) >> np.uint64(32) | np.uint64(4), before


def pair_keys(texts: list[str]) -> np.ndarray:
    """A 64-bit key for every word with the word before it; a text's first word stands behind a mark."""
    words, before = word_keys(texts)
    return _paired(words, before)


def _paired(words: np.ndarray, before: np.ndarray) -> np.ndarray:
    previous = np.empty_like(words)
    previous[1:] = words[:-1]
    firsts = before[:-1][np.diff(before) > 0]
    previous[firsts] = _BEGIN
    return (previous << _HALF) | words


def places(keys: np.ndarray) -> np.ndarray:
    """The places of keys in a bitmap of 2 ** ID_BITS."""
    return (keys ^ (keys >> _HALF)) & np.uint64((1 << ID_BITS) - 1)


@dataclass
class ToxicityModel:
    """What each broadcast entry (sorted keys) adds to a log-likelihood ratio, and the curve: floor, slope, middle and
    the weight of the whole text.  ``rest``: a table ``key, ratio`` of all other entries, and ``maybe``, a bitmap of
    their keys; or None."""

    words: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    ratios: np.ndarray = field(default_factory=lambda: np.zeros(0))
    curve: tuple[float, float, float, float] = (0.0, 1.0, 2.0, 1.0)
    fixed: float | None = None
    rest: DataFrame | None = None
    maybe: np.ndarray | None = None

    def entries(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The broadcast ratio of each key (0 where it has none), and whether the rest may have it."""
        if not len(self.words):
            return np.zeros(len(keys)), np.zeros(len(keys), bool)
        spots = np.minimum(np.searchsorted(self.words, keys), len(self.words) - 1)
        found = self.words[spots] == keys
        asked = np.zeros(len(keys), bool) if self.maybe is None else ~found & held(self.maybe, places(keys))
        return np.where(found, self.ratios[spots], 0.0), asked

    def pair_ratios(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each word in its pair: log of its probability behind the word before it in the toxic model over that in
        the ordinary one, as far as it is broadcast, and which of its three keys (a column each) the rest may have."""
        codes, distinct = pd.factorize(pairs)
        distinct = distinct.astype(np.uint64)
        parts = [self.entries(keys) for keys in entry_keys(distinct)]
        return sum(part[0] for part in parts)[codes], np.stack([part[1] for part in parts], axis=1)[codes]


def entry_keys(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys of the word, the context and the pair."""
    return pairs & _LOWER, pairs & ~_LOWER, pairs


def band_sums(counts: DataFrame) -> DataFrame:
    """``band, ordinary, toxic, kept_ordinary, kept_toxic`` over all words: sums by the number of binary digits
    of ``types``, before and after the discount; some 40 rows at most."""
    left = {side: F.greatest(F.col(side) - F.lit(DISCOUNT), F.lit(0.0)) for side in ("ordinary", "toxic")}
    return counts.groupBy((F.length(F.bin("types")) - 1).alias("band")).agg(
        *[F.sum(side).alias(side) for side in left],
        *[F.sum(value).alias(f"kept_{side}") for side, value in left.items()],
    )


def word_table(counts: DataFrame) -> DataFrame:
    """``key, ratio, weight, ordinary_p, toxic_p`` of every word: its probability in each class without a word before
    it, from continuation counts, and the log of their ratio (0 for a word that no class has above the discount)."""
    sides = ["ordinary", "toxic"]
    bands = band_sums(counts).toArrow().to_pandas()
    whole, kept = bands[sides].to_numpy(np.float64).sum(0), bands[["kept_ordinary", "kept_toxic"]].to_numpy(np.float64).sum(0)
    freed = float(np.mean(1 - kept / whole))
    shares = np.full(64, 0.5)
    shares[bands["band"].to_numpy(np.int64)] = (bands["toxic"] + 1) / (bands["ordinary"] + bands["toxic"] + 2)
    total = float(whole.sum())

    def run(batches):
        for batch in batches:
            types = column_of(batch, "types").to_numpy().astype(np.int64)
            share = shares[np.frexp(types.astype(np.float64))[1] - 1]
            own = np.stack([column_of(batch, side).to_numpy().astype(np.float64) for side in sides], axis=1)
            deal = np.stack([1 - share, share], axis=1)
            chances = (np.maximum(own - DISCOUNT, 0) + freed * types[:, None] * deal) / deal / total
            ratios = np.where((own > DISCOUNT).any(axis=1), np.log(chances[:, 1] / chances[:, 0]), 0.0)
            weights = own[:, 0] + TOXIC_WEIGHT * own[:, 1]
            arrays = [column_of(batch, "key"), *map(pa.array, (ratios, weights, chances[:, 0], chances[:, 1]))]
            yield pa.RecordBatch.from_arrays(arrays, ["key", "ratio", "weight", "ordinary_p", "toxic_p"])

    kinds = "key long, ratio double, weight double, ordinary_p double, toxic_p double"
    return counts.select("key", *sides, "types").mapInArrow(run, kinds)


def entries(counts: DataFrame) -> DataFrame:
    """``key, ratio, weight``: what word, context and pair add to the log of p(toxic) / p(ordinary), with, in each class,

    p(w | v) = (1 - l(v)) kept(v, w) / kept(v) + l(v) b(w | v),    b(w | v) = (kept'(v, w) + freed'(v) p(w)) / n'(v)

    where kept is what a class's pair counts have above the discount, l(v) the share that the discount frees, the mean of
    both classes (1 in a class with nothing kept), and dashes are counts over both classes.  A word adds the ratio of
    p(w), a context that of l(v), and a pair that both classes together have more often than the discount the rest of
    it; other pairs add nothing."""
    upper = F.shiftrightunsigned("key", 32)
    words = word_table(counts.filter(upper == 0))
    low = F.col("key").bitwiseAND(F.lit(int(_LOWER)))
    contexts = counts.filter((upper != 0) & (low == 0)).select(F.col("key").alias("context"), *[F.col(n).alias(f"c_{n}") for n in _COUNTS])
    share = "(case when c_{0} > 0 then c_{1} / c_{0} else 1.0D end)"
    contexts = contexts.selectExpr(
        "*", "c_ordinary - c_types as kept_ordinary", "c_toxic - c_more as kept_toxic",
        f"({share.format('ordinary', 'types')} + {share.format('toxic', 'more')}) / 2 as freed",
    )
    left = {side: f"(case when kept_{side} > 0 then freed else 1.0D end)" for side in ("ordinary", "toxic")}
    weigh = f"double({{0}}ordinary + {TOXIC_WEIGHT} * {{0}}toxic) as weight"
    gaps = contexts.selectExpr("context as key", f"ln({left['toxic']} / {left['ordinary']}) as ratio", weigh.format("c_"))
    pairs = counts.filter((upper != 0) & (low != 0) & (F.col("ordinary") + F.col("toxic") > PAIR_DISCOUNT))
    pairs = pairs.withColumns({"context": F.col("key").bitwiseAND(F.lit(-(1 << 32))), "word": low}).select("key", "context", "word", "ordinary", "toxic")
    pairs = pairs.join(words.selectExpr("key as word", "ordinary_p", "toxic_p"), "word").join(contexts, "context")

    def more(side: str) -> str:
        """Log of p(w | v) over l(v) p(w), but for a factor that both classes share."""
        back = f"(ordinary + toxic - {PAIR_DISCOUNT} + c_both * {side}_p) / (c_ordinary + c_toxic)"
        kept = f"(case when kept_{side} > 0 then (1 - freed) * greatest({side} - {PAIR_DISCOUNT}, 0) / kept_{side} else 0.0D end)"
        return f"ln(({kept} + {left[side]} * {back}) / ({left[side]} * {side}_p))"

    pairs = pairs.selectExpr("key", f"{more('toxic')} - {more('ordinary')} as ratio", weigh.format(""))
    return words.select("key", "ratio", "weight").union(gaps).union(pairs).filter("ratio <> 0")


def built(counts: DataFrame) -> ToxicityModel:
    """The model of counts ``key, ordinary, toxic, types, more``, without its curve."""
    words, path = written(entries(counts), "toxicity-entries")
    top = words.orderBy(F.desc("weight"), "key").limit(MAX_WORDS + 1).toArrow().to_pandas()
    rest = maybe = None
    if len(top) > MAX_WORDS:
        top = top.iloc[:MAX_WORDS]
        # Not by the row: that would make a float of its key.
        weight, key = F.lit(float(top["weight"].iloc[-1])), F.lit(int(top["key"].iloc[-1]))
        behind = (F.col("weight") < weight) | ((F.col("weight") == weight) & (F.col("key") > key))
        rest, _ = written(words.filter(behind).select("key", "ratio"), "toxicity-rest")
        key = F.col("key")
        maybe = bitmap(rest, key.bitwiseXOR(F.shiftrightunsigned(key, 32)).bitwiseAND(F.lit((1 << ID_BITS) - 1)), ID_BITS)
    removed(counts.sparkSession, path)
    top = top.assign(key=top["key"].to_numpy().astype(np.int64).view(np.uint64)).sort_values("key")
    return ToxicityModel(top["key"].to_numpy(), top["ratio"].to_numpy(), rest=rest, maybe=maybe)


# Weights of the whole text's ratio beside that of its worst words.
_WHOLE = (0.25, 0.5, 1.0, 2.0)


def fitted_curve(worst: np.ndarray, whole: np.ndarray, labels: np.ndarray) -> tuple[float, float, float, float]:
    """Floor, slope, middle and weight of the likeliest curve ``floor + (1 - floor) / (1 + exp(-slope (x - middle)))``
    of ``x = worst + weight * whole``."""
    best, found = -np.inf, (0.0, 1.0, 2.0, 1.0)

    def tried(ratios: np.ndarray, middles: np.ndarray, weight: float) -> None:
        nonlocal best, found
        scale = max(float(np.std(ratios)), 1e-6)
        for floor in (0.0, 0.01, 0.02, 0.04, 0.06, 0.1, 0.15):
            for slope in (1, 2, 4, 8, 16, 32):
                for middle in middles:
                    chance = floor + (1 - floor) / (1 + np.exp(-np.clip(slope / scale * (ratios - middle), -30, 30)))
                    chance = np.clip(chance, 1e-6, 1 - 1e-6)
                    value = float((labels * np.log(chance) + (1 - labels) * np.log(1 - chance)).sum())
                    if value > best:
                        best, found = value, (floor, slope / scale, float(middle), weight)

    for weight in _WHOLE:
        ratios = worst + weight * whole
        tried(ratios, np.unique(np.quantile(ratios, np.linspace(0.5, 0.995, 30))), weight)
    ratios = worst + found[3] * whole
    middles = np.unique(np.quantile(ratios, np.linspace(0.5, 0.995, 30)))
    at = int(np.searchsorted(middles, found[2]))
    # Once more between the neighbours of the likeliest middle.
    tried(ratios, np.linspace(middles[max(at - 1, 0)], middles[min(at + 1, len(middles) - 1)], 40), found[3])
    return found


def _seen(batches):
    """``key, seen, n``: pairs of a task's texts and how often they occur, with 1 for ordinary, 2 for toxic; four
    times that for texts of the fold."""
    gathered: dict[int, list[np.ndarray]] = {1: [], 2: [], 4: [], 8: []}
    size = 0

    def flush():
        for seen, parts in gathered.items():
            if parts:
                keys, n = np.unique(np.concatenate(parts), return_counts=True)
                arrays = [pa.array(keys.view(np.int64)), pa.array(np.full(len(keys), seen, np.int32)), pa.array(n, pa.int64())]
                yield pa.RecordBatch.from_arrays(arrays, ["key", "seen", "n"])

    for block in row_blocks(batches):
        texts, labels = column_of(block, "text").to_pylist(), column_of(block, "label").to_pylist()
        kinds = [(2 if label > 0 else 1) << (2 * bool(fold)) for label, fold in zip(labels, column_of(block, "fold").to_pylist(), strict=True)]
        for seen in gathered:
            keys = pair_keys([t or "" for t, kind in zip(texts, kinds, strict=True) if kind == seen])
            if len(keys):
                gathered[seen].append(keys)
                size += len(keys)
        if size > _GATHERED:
            yield from flush()
            gathered, size = {seen: [] for seen in gathered}, 0
    yield from flush()


def _pairs(rows: DataFrame) -> DataFrame:
    """``key, all, outer``: each pair of the rows with its occurrences in ordinary and toxic texts, and those without
    the rows of the fold (a column ``fold``, if there is one)."""
    if "fold" not in rows.columns:
        rows = rows.withColumn("fold", F.lit(False))
    found = rows.mapInArrow(_seen, "key long, seen int, n long").groupBy("key")
    found = found.agg(*[F.sum(F.when(F.col("seen") == seen, F.col("n")).otherwise(0)).alias(f"n{seen}") for seen in (1, 2, 4, 8)])
    return found.selectExpr("key", "n1 + n4 as ordinary", "n2 + n8 as toxic", "n1 as outer_ordinary", "n2 as outer_toxic")


def counted(rows: DataFrame) -> DataFrame:
    """``key, ordinary, toxic, types``: for every word of the rows (text, label) the number of different words
    before it in ordinary texts, in toxic texts, and in either; and ``outer_ordinary, outer_toxic, outer_types``,
    the same without the rows of the fold (a column ``fold``, if there is one)."""
    return all_counts(rows).filter(F.shiftrightunsigned("key", 32) == 0)


def all_counts(rows: DataFrame) -> DataFrame:
    """``counted``, and in the same columns for every context the occurrences of what follows it in ordinary and in
    toxic texts and (``types, more``) how much of each the discount frees, and for every pair that one class has more
    often than the discount its occurrences."""
    pairs = _pairs(rows)
    names = [f"{pre}{name}" for pre in ("", "outer_") for name in _COUNTS]
    word, ctx, own = [], [], []
    for pre in ("", "outer_"):
        o, t = f"{pre}ordinary", f"{pre}toxic"
        word += [f"bigint({o} > 0)", f"bigint({t} > 0)", f"bigint({o} + {t} > 0)", "0L", "0L"]
        ctx += [o, t, *[f"least({n}, bigint({PAIR_DISCOUNT}))" for n in (o, t, f"{o} + {t}")]]
        own += [o, t, "0L", "0L", "0L"]

    def struct(key: str, fields: list[str]) -> str:
        return "named_struct('key', " + key + "".join(f", '{name}', {value}" for name, value in zip(names, fields, strict=True)) + ")"

    often = f"ordinary + toxic > {PAIR_DISCOUNT}"
    two = f"{struct('key & 4294967295L', word)}, {struct('key & -4294967296L', ctx)}"
    spread = pairs.select(F.explode(F.expr(f"if({often}, array({two}, {struct('key', own)}), array({two}))")).alias("of")).select("of.*")
    return spread.groupBy("key").agg(*[F.sum(name).alias(name) for name in names])


def train(
    df: DataFrame, labels: DataFrame, id_column: str, text_column: str, label_column: str, fold: Column
) -> ToxicityModel:
    """Fit the curve on the labelled rows in ``fold`` by counts over the others, then count over all of them."""
    known = labels.filter(F.col(label_column).isNotNull()).groupBy(id_column).agg(F.max(label_column).alias("label"))
    known = known.select(F.col(id_column).alias("id"), F.col("label").cast("int").alias("label"))
    rows = df.select(F.col(id_column).alias("id"), F.col(text_column).cast("string").alias("text"))
    # Rows without a label stop at a bitmap of fixed size, so that only labelled texts are shuffled; a
    # join by sorting both sides, whatever the size of the labels.
    labelled = rows.filter(maybe_among(known, "id")(F.col("id")))
    learned = known.withColumn("fold", F.coalesce(fold, F.lit(False)))
    # As Parquet: a checkpoint takes several times the room.
    counts, path = written(all_counts(labelled.join(learned.hint("merge"), "id").select("text", "label", "fold")), "toxicity-counts")
    words = counts.filter(F.shiftrightunsigned("key", 32) == 0)
    sums = words.agg(*[F.sum(name) for name in ("ordinary", "toxic", "outer_ordinary", "outer_toxic")]).first()
    if not (sums[0] and sums[1]):
        removed(df.sparkSession, path)
        return ToxicityModel(fixed=1.0 if sums[1] else 0.0)
    curve = ToxicityModel.curve
    if sums[2] and sums[3]:
        outer = counts.select("key", *[F.col(f"outer_{name}").alias(name) for name in _COUNTS])
        # At most SAMPLE ids are broadcast.
        asked = known.filter(fold).orderBy(F.xxhash64(F.col("id").cast("string")), "id").limit(SAMPLE)
        left_out = rows.join(F.broadcast(asked), "id")
        found = ratios(left_out.select("label", "text"), built(outer.filter("ordinary + toxic > 0")), "label int").toArrow()
        if len(found["label"].unique()) == 2:
            curve = fitted_curve(found["worst"].to_numpy(), found["whole"].to_numpy(), found["label"].to_numpy().astype(np.float64))
    model = replace(built(counts), curve=curve)
    removed(df.sparkSession, path)
    return model


def ratios(rows: DataFrame, model: ToxicityModel, carried: str) -> DataFrame:
    """The carried column, ``name type``, and of rows of it and ``text``: ``whole``, the log of the text's likelihood in
    the toxic model over that in the ordinary one, a word, and ``worst``, that of its ``WORST`` worst words."""
    shared = rows.sparkSession.sparkContext.broadcast(replace(model, rest=None))  # bounded by MAX_WORDS
    name = carried.split()[0]

    def run(batches):
        row = TaskContext.get().partitionId() << 33
        for block in row_blocks(batches):
            words, before = word_keys([text or "" for text in column_of(block, "text").to_pylist()])
            counts = np.diff(before)
            pairs = _paired(words, before)
            values, asked = shared.value.pair_ratios(pairs)
            open_ = np.flatnonzero(asked.any(axis=1))
            owner = np.repeat(np.arange(len(counts)), counts)
            totals = np.bincount(owner, values, minlength=len(counts))
            closed = values.copy()
            closed[open_] = -np.inf
            order = np.lexsort((-closed, owner))
            rank = np.arange(len(order)) - np.repeat(before[:-1], counts)
            top = order[(rank < WORST) & np.isfinite(closed[order])]
            # A word whose keys the rest may have: its place, what is broadcast of it, and those keys.
            keys = np.stack(entry_keys(pairs[open_]), axis=1)[asked[open_]].view(np.int64)
            structs = pa.StructArray.from_arrays(
                [pa.array(open_), pa.array(values[open_]), list_array(keys, asked[open_].sum(axis=1), pa.int64())],
                ["place", "value", "keys"],
            )
            ends = np.concatenate([[0], np.cumsum(np.bincount(owner[open_], minlength=len(counts)))]).astype(np.int32)
            arrays = [
                column_of(block, name),
                pa.array(np.arange(row, row + len(counts))),
                pa.array(counts, pa.int64()),
                pa.array(totals, pa.float64()),
                list_array(values[top], np.bincount(owner[top], minlength=len(counts)), pa.float64()),
                pa.ListArray.from_arrays(pa.array(ends), structs),
            ]
            row += len(counts)
            yield pa.RecordBatch.from_arrays(arrays, [name, "__row", "n", "total", "worst", "asked"])

    asked = "asked array<struct<place:long,value:double,keys:array<long>>>"
    found = rows.select(name, "text").mapInArrow(run, f"{carried}, __row long, n long, total double, worst array<double>, {asked}")
    if model.rest is not None:
        found = _with_rest(found, model.rest)
    taken = F.aggregate("worst", F.lit(0.0), lambda total, value: total + value)
    return found.select(
        name,
        F.when(F.col("n") > 0, F.col("total") / F.col("n")).otherwise(F.lit(0.0)).alias("whole"),
        F.when(F.col("n") > 0, taken / F.least("n", F.lit(WORST))).otherwise(F.lit(0.0)).alias("worst"),
    )


def _with_rest(found: DataFrame, rest: DataFrame) -> DataFrame:
    """The rows with totals and worst words of both, what they have and what they ask the rest for."""
    marked, _ = written(found, "toxicity-rows")
    open_ = marked.select("__row", F.explode("asked").alias("of")).select("__row", "of.*")
    asked = open_.select("__row", "place", F.explode("keys").alias("key"))
    named = asked.groupBy("key").agg(F.count("*").alias("times")).join(rest, "key", "left")
    # The bitmap lets keys through that have no entry.
    named, _ = written(named.withColumn("ratio", F.coalesce("ratio", F.lit(0.0))), "toxicity-asked")
    total = named.agg(F.sum("times")).first()[0] or 0
    met = join_spread(asked, named, "key", "times", total).select("__row", "place", "ratio", F.col("ratio").alias("more"))
    both = met.unionByName(open_.select("__row", "place", F.col("value").alias("ratio"), F.lit(0.0).alias("more")))
    by_word = both.groupBy("__row", "place").agg(F.sum("ratio").alias("ratio"), F.sum("more").alias("more"))
    at = Window.partitionBy("__row").orderBy(F.desc("ratio"), "place")
    by_word = by_word.withColumn("rank", F.row_number().over(at))
    by_row = by_word.groupBy("__row").agg(
        F.sum("more").alias("more"), F.collect_list(F.when(F.col("rank") <= WORST, F.col("ratio"))).alias("others")
    )
    worst = F.concat("worst", F.coalesce("others", F.array().cast("array<double>")))
    found = marked.join(by_row, "__row", "left").withColumn("worst", F.slice(F.sort_array(worst, asc=False), 1, WORST))
    return found.withColumn("total", F.col("total") + F.coalesce("more", F.lit(0.0))).drop("more", "others", "__row")


def score(df: DataFrame, model: ToxicityModel, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The id column, ``ratio`` (of the worst words and the whole text), its two parts and ``score`` for every row."""
    id_type = df.schema[id_column].dataType.simpleString()
    rows = df.select(df[id_column].alias("id"), df[text_column].cast("string").alias("text"))
    found = ratios(rows, model, f"id {id_type}").withColumnRenamed("id", id_column)
    floor, slope, middle, weight = model.curve
    found = found.withColumn("ratio", F.col("worst") + F.lit(weight) * F.col("whole"))
    curve = floor + (1 - floor) / (1 + F.exp(-F.lit(slope) * (F.col("ratio") - F.lit(middle))))
    found = found.select(id_column, "ratio", "whole", "worst")
    return found.withColumn("score", curve if model.fixed is None else F.lit(model.fixed))
