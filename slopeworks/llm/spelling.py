"""Operator 12: spelling variants by a trie over frequency vectors.

Letters are dealt into ``GROUPS`` groups of about equal frequency; a word's frequency vector counts its letters
by group, and a trie arranges the words by successive counts.  Words that differ by one inserted, deleted or
replaced letter have vectors with a surplus of at most one and a deficit of at most one, so a depth-first search that
spends one surplus and one deficit meets every near word; the words of a leaf are verified letter by letter.

The upper levels of the trie are Spark's: words whose first counts are equal form a node; a node of more than
``NODE_WORDS`` words is taken apart by its next ``STEP`` counts.  A word is sent, as a query, to the nodes its
budget reaches, tier by tier.  Each node's lower levels are searched in one task, which holds the node's words and
streams the queries past them.  A node that holds too many words with one whole vector is split by word, and its queries
go to each part, so no case is dropped and no task holds more than about ``NODE_WORDS`` words.

``near_words`` names each word's near words' number and the most frequent of them; ``forms`` chooses a word's form
and follows forms to the root.

* Words with null counts or null words are left out; a word given twice is one word with the sum of its counts.
* Of near words of one count the first in code-point order is taken.
* An empty table gives an empty table.  Words may have any letters and any length.
* Other columns are left out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slopeworks.llm.graph import join_spread
from slopeworks.shared import removed, settled, written

GROUPS = 16
STEP = 4
# A node with more words is taken apart further.
NODE_WORDS = 1 << 14
# A tier with more nodes (some 60 bytes each) is joined by a shuffle.
MAX_NODES = 200_000
# Inside a task a subtrie of at most so many words is a leaf.
_LEAF_WORDS = 256
# Letters beyond these are compared word by word.
_WIDTH = 48
_PAIRS = 1 << 20


def letter_groups(words: DataFrame) -> dict[str, int]:
    """The group of each letter: letters by falling frequency, each into the group that is lightest so far.  At most
    one row a letter comes to the driver."""
    letters = words.select(F.explode(F.split("word", "")).alias("letter")).filter("letter <> ''")
    found = letters.groupBy("letter").count().orderBy(F.desc("count"), "letter").collect()
    weight, groups = [0] * GROUPS, {}
    for letter, count in found:
        lightest = weight.index(min(weight))
        groups[letter] = lightest
        weight[lightest] += count
    return groups


def _ways(size: int, budget: int) -> np.ndarray:
    """Changes of a tier's counts that spend at most one surplus and one deficit; without budget, none."""
    one = np.eye(size, dtype=np.int64)
    moved = [one[a] - one[b] for a in range(size) for b in range(size) if a != b]
    return np.array([np.zeros(size, np.int64), *([*one, *-one, *moved] if budget else [])])


def _vectors(words: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Frequency vectors of words; the words' letters, end to end, with the word and the place of each."""
    lengths = np.fromiter((len(word) for word in words), np.int64, len(words))
    points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(words)), lengths)
    place = np.arange(len(points)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    group = table[np.minimum(points, len(table) - 1)]
    vectors = np.bincount(owner * GROUPS + group, minlength=len(words) * GROUPS).reshape(-1, GROUPS)
    return vectors, points, owner, place


def _sent(table: np.ndarray, start: int, size: int, budget: int):
    """A mapInArrow function: rows of a node (word, n, node, up, down) with the keys of the subtrees they go to.

    A key holds a tier's counts, 16 bits each; larger counts share a key, and a word is sent to it once."""
    ways = _ways(size, budget)
    more, less = np.maximum(ways, 0).sum(1), np.maximum(-ways, 0).sum(1)
    shifts = np.arange(size, dtype=np.int64) * 16

    def sent(batches):
        for batch in batches:
            if batch.num_rows == 0:
                continue
            up, down = batch.column(3).to_numpy(), batch.column(4).to_numpy()
            part = _vectors(batch.column(0).to_pylist(), table)[0][:, start : start + size]
            counts = part[:, None, :] + ways[None]
            fine = (counts >= 0).all(2) & (more[None] <= up[:, None]) & (less[None] <= down[:, None])
            rows, way = np.nonzero(fine)
            keys = (np.minimum(counts[rows, way], 0xFFFF) << shifts).sum(1)
            if part.max(initial=0) >= 0xFFFF - 1:
                once = np.unique(np.stack([rows, keys]), axis=1, return_index=True)[1]
                rows, keys, way = rows[once], keys[once], way[once]
            taken = [batch.column(k).take(pa.array(rows)) for k in range(3)]
            # Where a key is shared the search itself counts what is spent, from whole vectors.
            left = [pa.array((a[rows] - b[way]).astype(np.int8)) for a, b in ((up, more), (down, less))]
            yield pa.RecordBatch.from_arrays([*taken, pa.array(keys), *left], names=["word", "n", "node", "key", "up", "down"])

    return sent


def _dealt(words: DataFrame, table: np.ndarray, paths: list[str]) -> DataFrame:
    """``node, part, role, word, n``: members of every node (role 0) and queries to it (role 1).

    A tier's nodes are broadcast where they have been counted to be few, else joined by a shuffle.  ``paths``
    receives the tables kept on the way."""
    fields = "word string, n long, node long, key long, up byte, down byte"
    begin = [F.lit(value).cast("byte").alias(name) for name, value in (("up", 1), ("down", 1))]
    asked = members = words.select("word", "n", "node", "key", *begin)
    out, depth = [], 0
    while True:
        last = depth >= GROUPS
        sizes = members.groupBy("node", "key").agg(F.count("*").alias("size"))
        sizes = settled(sizes.withColumn("child", F.monotonically_increasing_id()))
        known = F.broadcast(sizes) if sizes.count() <= MAX_NODES else sizes
        sized, reached = (df.join(known, ["node", "key"]) for df in (members, asked))
        parts = F.ceil(F.col("size") / NODE_WORDS).cast("int")
        fits = F.lit(True) if last else F.col("size") <= NODE_WORDS
        node = (F.col("child") * (GROUPS + 1) + depth).alias("node")
        part = F.pmod(F.xxhash64("word"), parts).cast("int").alias("part")
        each = F.explode(F.sequence(F.lit(0), parts - 1)).alias("part")
        out.append(sized.filter(fits).select(node, part, F.lit(0).alias("role"), "word", "n"))
        out.append(reached.filter(fits).select(node, each, F.lit(1).alias("role"), "word", F.lit(None).cast("long").alias("n")))
        if last or sizes.filter(F.col("size") > NODE_WORDS).isEmpty():
            break
        size = min(STEP, GROUPS - depth)
        deeper = []
        for df, budget in ((sized, 0), (reached, 1)):
            rest = df.filter(~fits).select("word", "n", F.col("child").alias("node"), "up", "down")
            kept, path = written(rest, "spelling")
            paths.append(path)
            deeper.append(kept.mapInArrow(_sent(table, depth, size, budget), fields))
        members, asked = deeper
        depth += size
    found = out[0]
    for more in out[1:]:
        found = found.union(more)
    return found


class _Words:
    """Words as numpy arrays: letters (cut at ``_WIDTH``, zero beyond the end), lengths, vectors, counts."""

    def __init__(self, words: list[str], counts: np.ndarray, table: np.ndarray) -> None:
        self.words, self.counts = words, counts
        self.vectors, points, owner, place = _vectors(words, table)
        self.lengths = np.fromiter((len(word) for word in words), np.int64, len(words))
        # As doubles, whose products are exact for any word that fits in memory.
        self.exact = self.vectors.astype(np.float64)
        self.squares = (self.exact**2).sum(1)
        self.letters = np.zeros((len(words), _WIDTH), np.uint32)
        near = place < _WIDTH
        self.letters[owner[near], place[near]] = points[near]


def one_apart(one: str, two: str) -> bool:
    """Whether two words differ by exactly one inserted, deleted or replaced code point."""
    if len(one) > len(two):
        one, two = two, one
    if len(two) - len(one) > 1 or one == two:
        return False
    head = 0
    while head < len(one) and one[head] == two[head]:
        head += 1
    return one[head + (len(one) == len(two)) :] == two[head + 1 :]


def _verified(asked: _Words, a: np.ndarray, held: _Words, b: np.ndarray) -> np.ndarray:
    """Whether the words of each pair are one apart."""
    first, second = asked.lengths[a], held.lengths[b]
    swap = first > second
    short = np.where(swap[:, None], held.letters[b], asked.letters[a])
    long = np.where(swap[:, None], asked.letters[a], held.letters[b])
    differs = short != long
    head = np.where(differs.any(1), differs.argmax(1), _WIDTH)
    # The rest must agree when both, or only the longer word, have moved on by one letter.
    place = np.arange(_WIDTH)[None, :]
    after = place > head[:, None]
    replaced = ~(differs & after).any(1)
    moved = np.zeros_like(long)
    moved[:, :-1] = long[:, 1:]
    inserted = ~((short != moved) & (place >= head[:, None])).any(1)
    gap = np.abs(first - second)
    near = np.where(gap == 0, replaced & (head < _WIDTH), (gap == 1) & inserted)
    for k in np.flatnonzero(np.maximum(first, second) > _WIDTH).tolist():
        near[k] = one_apart(asked.words[a[k]], held.words[b[k]])
    return near


class _Trie:
    """The lower levels: words sorted by vector, so that every subtrie is a range of them."""

    def __init__(self, held: _Words) -> None:
        self.order = np.lexsort(held.vectors.T[::-1]) if len(held.words) else np.zeros(0, np.int64)
        self.held, self.vectors = held, held.vectors[self.order]
        self.exact, self.squares = held.exact[self.order], held.squares[self.order]

    def near(self, asked: _Words) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, word) that are one apart."""
        found: list[tuple[np.ndarray, np.ndarray]] = []
        count = len(asked.words)
        stack = [(0, len(self.order), 0, np.arange(count), np.ones(count, np.int64), np.ones(count, np.int64))]
        while stack:
            low, high, level, who, up, down = stack.pop()
            if len(who) == 0 or low == high:
                continue
            if high - low <= _LEAF_WORDS or level == GROUPS:
                room = max(1, _PAIRS // (high - low))
                for start in range(0, len(who), room):
                    found.append(self._leaf(asked, who[start : start + room], low, high))
                continue
            column = self.vectors[low:high, level]
            values, starts = np.unique(column, return_index=True)
            ends = np.append(starts[1:], high - low)
            for value, start, end in zip(values.tolist(), starts.tolist(), ends.tolist(), strict=True):
                # Positive: this branch has one letter more of the group than the query.
                change = value - asked.vectors[who, level]
                more, less = up - np.maximum(change, 0), down - np.maximum(-change, 0)
                reached = (more >= 0) & (less >= 0)
                stack.append((low + start, low + end, level + 1, who[reached], more[reached], less[reached]))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found])

    def _leaf(self, asked: _Words, who: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
        # One surplus and one deficit at most: a squared distance of 2 at most, and lengths at most one apart.
        squares = self.squares[None, low:high] + asked.squares[who][:, None] - 2 * (asked.exact[who] @ self.exact[low:high].T)
        a, b = np.nonzero(squares <= 2)
        a, b = who[a], self.order[low + b]
        fine = np.abs(asked.lengths[a] - self.held.lengths[b]) <= 1
        a, b = a[fine], b[fine]
        near = _verified(asked, a, self.held, b)
        return a[near], b[near]


def _search(table: np.ndarray):
    """A mapInArrow function over rows sorted by node, part and role."""
    schema = pa.schema([("word", pa.string()), ("n_near", pa.int64()), ("best", pa.int64()), ("form", pa.string())])

    def answered(trie: _Trie, words: list[str], counts: np.ndarray) -> pa.RecordBatch:
        asked = _Words(words, counts, table)
        a, b = trie.near(asked)
        held = trie.held
        ranked = np.lexsort((np.array([held.words[k] for k in b.tolist()], object) if len(b) else b, -held.counts[b], a))
        a, b = a[ranked], b[ranked]
        who, first, number = np.unique(a, return_index=True, return_counts=True)
        best = b[first]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([words[k] for k in who.tolist()], pa.string()),
                pa.array(number, pa.int64()),
                pa.array(held.counts[best], pa.int64()),
                pa.array([held.words[k] for k in best.tolist()], pa.string()),
            ],
            schema=schema,
        )

    def search(batches):
        current, words, counts, trie = None, [], [], None
        for batch in batches:
            node, part, role = (batch.column(k).to_pylist() for k in range(3))
            word, n = batch.column(3).to_pylist(), batch.column(4).fill_null(0).to_numpy()
            state = list(zip(node, part, role, strict=True))
            cuts = [0, *[k for k in range(1, len(state)) if state[k] != state[k - 1]], len(state)]
            for start, end in zip(cuts, cuts[1:], strict=False):
                if start == end:
                    continue
                place, asking = state[start][:2], state[start][2] == 1
                if place != current:
                    current, words, counts, trie = place, [], [], None
                if not asking:
                    words += word[start:end]
                    counts.append(n[start:end])
                    continue
                if trie is None:
                    trie = _Trie(_Words(words, np.concatenate(counts) if counts else np.zeros(0, np.int64), table))
                found = answered(trie, word[start:end], n[start:end])
                if found.num_rows:
                    yield found

    return search


def near_words(words: DataFrame) -> DataFrame:
    """``word, n, n_near, best, form`` for words with counts (``word, n``): how many words are one apart, and the most
    frequent of them with its count (0 and nulls if there is none)."""
    clean = words.filter("word is not null and n is not null").select("word", F.col("n").cast("long").alias("n"))
    known = settled(clean.groupBy("word").agg(F.sum("n").alias("n")).selectExpr("*", "0L as node", "0L as key"))
    groups = letter_groups(known)
    table = np.zeros(max([ord(letter) for letter in groups], default=0) + 1, np.int64)
    for letter, group in groups.items():
        table[ord(letter)] = group
    paths: list[str] = []
    dealt = _dealt(known, table, paths).repartition("node", "part").sortWithinPartitions("node", "part", "role")
    found = dealt.mapInArrow(_search(table), "word string, n_near long, best long, form string")
    ranked = F.min(F.struct((-F.col("best")).alias("less"), "form"))
    near = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), ranked.alias("top"))
    named = near.select("word", "n_near", (-F.col("top.less")).alias("best"), F.col("top.form").alias("form"))
    result = settled(known.drop("node", "key").join(named, "word", "left").fillna(0, ["n_near"]))
    for path in paths:
        removed(words.sparkSession, path)
    return result


def forms(words: DataFrame, factor: int = 5) -> DataFrame:
    """``word, form, root, n, n_near, form_n``: a word's form is its most frequent near word, if that is at least
    ``factor`` (2 or more) times as frequent; the root is the last word on the way from form to form."""
    chosen = F.col("best") >= factor * F.col("n")
    found = near_words(words).withColumn("form", F.when(chosen, F.col("form"))).withColumn("form_n", F.when(chosen, F.col("best")))
    found = found.select("word", "form", "n", "n_near", "form_n")
    # Counts grow by the factor at each step, so ways are short; each round doubles how far a word has come.
    way = settled(found.filter("form is not null").select("word", F.col("form").alias("root")))
    while True:
        total = way.count()
        step = way.select(F.col("word").alias("root"), F.col("root").alias("further"))
        times = way.groupBy("root").agg(F.count("*").alias("turn"))
        step = step.join(times, "root")
        moved = settled(join_spread(way, step, "root", "turn", total).select("word", F.col("further").alias("root")))
        if moved.isEmpty():
            break
        rest = way.join(moved.select("word"), "word", "left_anti")
        way = settled(rest.unionByName(moved))
    root = F.coalesce("root", "word").alias("root")
    return found.join(way, "word", "left").select("word", "form", root, "n", "n_near", "form_n")
