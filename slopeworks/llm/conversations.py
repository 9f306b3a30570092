"""Operator 11: repair of conversation structure by a Viterbi search in parallel chunks.

Rows are taken by turn (nulls first; rows of one turn by role, then by the digest of their text).  A row's first fault
counts: *blank* (no character but white space), *duplicate* (role and text seen earlier), *truncated* (the last
character that is not white space is none of ``.!?``).  Edits keep a row (0), give it the role user or
assistant (3), delete it (4; blank and duplicate rows must go) or insert an empty row of either role (3); a truncated row
that is not deleted adds 3.  The initials of the roles that remain must match ``(s?(ua)+)?``.  Of the cheapest edits
those whose initials (D, I, K, R) are the least string win.

* *Chunks.*  Rows are dealt by range of (conversation, turn, role, digest), so a conversation of any size lies in
  consecutive tasks; each task cuts its conversations into chunks of at most ``CHUNK_ROWS`` rows or about
  ``CHUNK_CHARS`` characters, kept in the shared folder.
* *Whole conversations* of one chunk are searched at once: costs to go from the end, then the edits from the start.
* *Longer ones* run the same search chunk by chunk.  A pass gives every chunk costs to go at its end, at first
  speculative ones, and carries them to its beginning; a chunk whose successor has come to another vector
  runs again, and stops early where the old and the new vector differ by a constant only.  Passes end when no vector
  changes.  Then each chunk tells, for each of the four states it may be entered in, the state it is left in; these maps
  are composed by doubling until each is constant, and every chunk traces its own edits from the state it is entered in.

A vector of costs to go matters up to a constant, and few such vectors exist, so a chunk's pass is a walk through a table
of (vector, kind of row) that is filled as it is needed.

The repaired text of a conversation is hashed in one stream, since SHA-256 is sequential; the stream holds a chunk
at a time.  What is gathered for a long conversation besides is one small row a chunk.

* A null text or role is one space, so a null text is blank; a null id is a conversation of its own; a null turn comes
  first.  Identical rows are handed on as one row with a number.  An empty table gives an empty table.  Texts are
  handled whole; other columns are left out.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from slopeworks.shared import settled

CHUNK_ROWS = 4096
CHUNK_CHARS = 1 << 22
WHITE = " \t\n\x0b\x0c\r"
_RANK = {"D": 0, "I": 1, "K": 2, "R": 3}
# States of the pattern: nothing yet, after s, after u, after a.
_MOVES = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
_USER, _ASSISTANT = "user", "assistant"
_STATES = range(4)
# What remains to be inserted at the end, from each state.
END = (0, 6, 3, 0)


def _next(state: int) -> tuple[int, str]:
    """Where an inserted or renamed row leads, and its role: the pattern leaves one choice."""
    return (3, _ASSISTANT) if state == 2 else (2, _USER)


def _row_ways(kind: str, state: int) -> list[tuple[int, str, int]]:
    """(cost, edit, next state) for one row; its kind is D (must go) or its initial (- if none of s, u, a), with !
    if truncated."""
    ways = [(4, "D", state)]
    if kind == "D":
        return ways
    cut = 3 if kind.endswith("!") else 0
    kept = _MOVES.get(kind[0], {}).get(state)
    if kept is not None:
        ways.append((cut, "K", kept))
    return [*ways, (3 + cut, "R", _next(state)[0])]


def _before(kind: str, after: tuple[int, ...]) -> tuple[int, ...]:
    """Costs to go in front of a row from those behind it, insertions in front of it included."""
    costs = [min(cost + after[to] for cost, _, to in _row_ways(kind, state)) for state in _STATES]
    for _ in _STATES:
        costs = [min(costs[state], 3 + costs[_next(state)[0]]) for state in _STATES]
    return tuple(costs)


@lru_cache(maxsize=1 << 16)
def _stage(kind: str, after: tuple[int, ...]) -> tuple[int, ...]:
    """``_before`` with its least cost taken off."""
    costs = _before(kind, after)
    least = min(costs)
    return tuple(cost - least for cost in costs)


def backward(kinds: list[str], end: tuple[int, ...]) -> list[tuple[int, ...]]:
    """Costs to go, up to a constant each, in front of every row, and behind the last one."""
    vectors = [end]
    for kind in reversed(kinds):
        vectors.append(_stage(kind, vectors[-1]))
    return vectors[::-1]


def front(kinds: list[str], end: tuple[int, ...], old_end: tuple[int, ...] | None, old_front: tuple[int, ...] | None):
    """Costs to go in front of a chunk.  Where a vector agrees with that of an earlier pass, the rest is known."""
    vector, old = end, old_end
    for kind in reversed(kinds):
        if vector == old:
            return old_front
        vector = _stage(kind, vector)
        old = None if old is None else _stage(kind, old)
    return vector


@lru_cache(maxsize=1 << 16)
def _choices(kind: str, state: int, after: tuple[int, ...]) -> tuple[tuple[int, str, int], ...]:
    """The cheapest, then least, edits from a state up to and with one row: any insertions, then the row's edit."""
    goal, out = _before(kind, after), []
    while True:
        ways = [(*way, True) for way in _row_ways(kind, state)]
        best = [(edit, cost, to, done) for cost, edit, to, done in ways if cost + after[to] == goal[state]]
        to = _next(state)[0]
        if 3 + goal[to] == goal[state]:
            best.append(("I", 3, to, False))
        edit, cost, to, done = min(best)
        out.append((cost, edit, to))
        if done:
            return tuple(out)
        state = to


def trace(kinds: list[str], vectors: list[tuple[int, ...]], state: int) -> tuple[list[tuple[int, str, int]], list[int], int]:
    """(cost, edit, next state) of every edit from a state on, how many come up to each row, and the last state."""
    edits, counts = [], []
    for kind, after in zip(kinds, vectors[1:], strict=True):
        found = _choices(kind, state, after)
        edits += found
        counts.append(len(found))
        state = found[-1][2]
    return edits, counts, state


def closing(state: int) -> list[tuple[int, str, int]]:
    """Insertions after the last row."""
    out = []
    while END[state]:
        state = _next(state)[0]
        out.append((3, "I", state))
    return out


def _lines(edits, counts, roles: list[str], texts: list[str], ended: bool, state: int):
    """Repaired ``role:text`` lines of a chunk."""
    at = 0
    for row, count in enumerate(counts):
        for _, edit, to in edits[at : at + count]:
            if edit == "K":
                yield f"{roles[row]}:{texts[row]}"
            elif edit == "R":
                yield f"{_ASSISTANT if to == 3 else _USER}:{texts[row]}"
            elif edit == "I":
                yield f"{_ASSISTANT if to == 3 else _USER}:"
        at += count
    for _, _, to in closing(state) if ended else []:
        yield f"{_ASSISTANT if to == 3 else _USER}:"


# ---------------------------------------------------------------------------------------------- chunks

_ROW = ["conv_id", "turn", "role", "text", "digest", "mark"]


def _marked(df: DataFrame) -> DataFrame:
    """Rows with the digest of their text and a mark: blank, truncated or fine."""
    space = F.lit(" ")
    rows = df.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), space).alias("role"),
        F.coalesce(F.col("text").cast("string"), space).alias("text"),
    )
    trimmed = F.rtrim("text", F.lit(WHITE))
    last = F.right(trimmed, F.lit(1))
    mark = F.when(trimmed == "", "B").when(last.isin(".", "!", "?"), "").otherwise("!")
    return rows.withColumn("digest", F.unhex(F.sha2("text", 256))).withColumn("mark", mark)


def _combined(batches):
    """Identical rows of a batch as one row with a number, so that a very common one does not gather in one task."""
    for batch in batches:
        if batch.num_rows:
            for part in pa.Table.from_batches([batch]).group_by(_ROW).aggregate([([], "count_all")]).to_batches():
                yield pa.RecordBatch.from_arrays(part.columns, names=[*_ROW, "copies"])


class _Chunk:
    """Rows of one conversation as they come: kinds, roles, texts, digests, and what counts need."""

    def __init__(self) -> None:
        self.kinds, self.roles, self.texts, self.keys = [], [], [], []
        self.turns, self.no_turn, self.chars = [], 0, 0

    def add(self, turn, role: str, text: str, digest: bytes, mark: str, copies: int) -> None:
        # The copies of a row that is not blank are duplicates of it.
        initial = role[:1] if role[:1] in _MOVES else "-"
        kinds = ["D"] * copies if mark == "B" else [initial + mark, *["D"] * (copies - 1)]
        key = hashlib.md5(digest + role.encode("utf-8", "surrogatepass")).digest()
        self.kinds += kinds
        self.roles += [role] * copies
        self.texts += [text, *[""] * (copies - 1)]
        self.keys += [None] * copies if mark == "B" else [key, *[b""] * (copies - 1)]
        self.chars += len(text) + copies
        if turn is not None and (not self.turns or self.turns[-1] != turn):
            self.turns.append(turn)


def _cut(id_type: pa.DataType):
    """A mapInArrow function over sorted rows; one output row per chunk."""
    schema = pa.schema(
        [
            ("conv_id", id_type),
            ("place", pa.int64()),
            ("inner", pa.bool_()),
            ("kinds", pa.list_(pa.string())),
            ("roles", pa.list_(pa.string())),
            ("texts", pa.list_(pa.string())),
            ("keys", pa.list_(pa.binary())),
            ("low", pa.int64()),
            ("high", pa.int64()),
            ("turns", pa.int64()),
        ]
    )

    def cut(batches):
        place = TaskContext.get().partitionId() << 33
        chunk, current, first, begun, waiting = _Chunk(), None, True, False, []

        def row(inner: bool):
            turns = chunk.turns
            return (current, place, inner, chunk.kinds, chunk.roles, chunk.texts, chunk.keys, turns[0] if turns else None, turns[-1] if turns else None, len(turns))

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        size = 0
        for batch in batches:
            for conv, turn, role, text, digest, mark, copies in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                changes = begun and conv != current
                full = begun and (len(chunk.kinds) >= CHUNK_ROWS or chunk.chars >= CHUNK_CHARS)
                if changes or full:
                    # Inner: neither the partition's first nor last conversation, and in one chunk.
                    waiting.append(row(changes and not first))
                    size += chunk.chars
                    place, chunk = place + 1, _Chunk()
                    first = first if changes and not first else not changes
                    if size >= CHUNK_CHARS or len(waiting) >= 4096:
                        yield batch_of(waiting)
                        waiting, size = [], 0
                current, begun = conv, True
                chunk.add(turn, role, text, digest, mark, copies)
        if begun:
            waiting.append(row(False))
        if waiting:
            yield batch_of(waiting)

    return cut


def chunks_of(df: DataFrame) -> DataFrame:
    """Chunks of all conversations, kept in the shared folder.

    ``inner`` is true only if the chunk is a whole conversation; ``place`` orders the chunks of all."""
    marked = _marked(df)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in marked.schema)
    combined = marked.mapInArrow(_combined, f"{fields}, copies long")
    order = [F.col(name).asc_nulls_first() for name in ("conv_id", "turn", "role", "digest")]
    placed = combined.repartitionByRange(*order).sortWithinPartitions(*order)
    id_type = df.schema["conv_id"].dataType
    arrow_type = marked.select("conv_id").limit(0).toArrow().schema.field(0).type
    out = (
        f"conv_id {id_type.simpleString()}, place long, inner boolean, kinds array<string>, roles array<string>, "
        "texts array<string>, keys array<binary>, low long, high long, turns long"
    )
    return settled(placed.mapInArrow(_cut(arrow_type), out))


# ---------------------------------------------------------------------------------------------- results

_REPORT = [
    ("blank", pa.int64()),
    ("duplicate", pa.int64()),
    ("truncated", pa.int64()),
    ("illegal", pa.int64()),
    ("cost", pa.int64()),
    ("audit", pa.string()),
]


def _initials(roles: list[str]) -> list[str]:
    return [role[:1] for role in roles]


def _illegal(initials: list[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))


def _local_duplicates(kinds: list[str], keys: list[bytes | None]) -> list[str]:
    """Kinds with later rows of an equal key marked as rows that must go."""
    seen, out = set(), []
    for kind, key in zip(kinds, keys, strict=True):
        out.append("D" if key and key in seen else kind)
        if key:
            seen.add(key)
    return out


def _counts(kinds: list[str], keys: list[bytes | None]) -> tuple[int, int, int]:
    blank = sum(key is None for key in keys)
    return blank, kinds.count("D") - blank, sum(kind.endswith("!") for kind in kinds)


def _judged(schema: pa.Schema):
    """A mapInArrow function over chunks that are whole conversations."""

    def judged(batches):
        for batch in batches:
            rows = []
            columns = [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("conv_id", "kinds", "roles", "texts", "keys", "low", "high", "turns")]
            for conv, kinds, roles, texts, keys, low, high, turns in zip(*columns, strict=True):
                kinds = _local_duplicates(kinds, keys)
                edits, counts, state = trace(kinds, backward(kinds, END), 0)
                done = [*edits, *closing(state)]
                text = "\n".join(_lines(edits, counts, roles, texts, True, state))
                digest = hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
                gaps = 0 if low is None else high - low + 1 - turns
                audit = "".join(edit for _, edit, _ in done)
                rows.append((conv, gaps, *_counts(kinds, keys), _illegal(_initials(roles)), sum(c for c, _, _ in done), audit, digest))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return judged


def _mapped(df: DataFrame, columns: list[str], made, out: str, types: list[pa.DataType]) -> DataFrame:
    """``mapInArrow`` that gives each row's columns to ``made`` and takes one tuple back."""
    names = [field.split()[0] for field in out.split(", ")]
    schema = pa.schema(list(zip(names, types, strict=True)))

    def run(batches):
        for batch in batches:
            rows = [made(*row) for row in zip(*(batch.column(k).to_pylist() for k in range(len(columns))), strict=True)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return df.select(*columns).mapInArrow(run, out)


_VECTOR = pa.list_(pa.int64())


def _costs_behind(rows: DataFrame) -> DataFrame:
    """``place, after, kinds``: true costs to go behind every chunk, by passes that rerun what has changed."""
    chunk = rows.select("place", "following", "kinds")
    speculative = F.array(*[F.lit(cost).cast("long") for cost in END])

    def run(place, kinds, after, old_after, old_before):
        as_tuple = [None if v is None else tuple(v) for v in (after, old_after, old_before)]
        return place, after, list(front(kinds, *as_tuple))

    def passed(df: DataFrame) -> DataFrame:
        return _mapped(df, ["place", "kinds", "after", "old_after", "old_before"], run, "place long, after array<long>, before array<long>", [pa.int64(), _VECTOR, _VECTOR])

    none = F.lit(None).cast("array<long>")
    state = settled(passed(chunk.select("place", "kinds", speculative.alias("after"), none.alias("old_after"), none.alias("old_before"))))
    while True:
        ahead = state.select(F.col("place").alias("following"), F.col("before").alias("given"))
        wanted = chunk.join(ahead, "following").join(state.select("place", "after", "before"), "place")
        changed = settled(wanted.filter("given <> after").select("place", "kinds", F.col("given").alias("after"), F.col("after").alias("old_after"), F.col("before").alias("old_before")))
        if changed.isEmpty():
            return chunk.join(state.select("place", "after"), "place")
        fresh = passed(changed)
        state = settled(state.join(changed.select("place"), "place", "left_anti").unionByName(fresh))


def _entered(rows: DataFrame, costs: DataFrame) -> DataFrame:
    """``place, entered``: the state in which the cheapest edits enter each chunk."""

    def run(place, kinds, after):
        vectors = backward(kinds, tuple(after))
        return place, [trace(kinds, vectors, state)[2] for state in _STATES]

    maps = _mapped(costs, ["place", "kinds", "after"], run, "place long, leads array<long>", [pa.int64(), _VECTOR])
    links = rows.select("place", F.col("previous").alias("back"))
    # A first chunk is entered in state 0, whatever comes before it.
    leads = F.when(F.col("back").isNull(), F.array_repeat(F.col("leads")[0], 4)).otherwise(F.col("leads"))
    current = settled(maps.join(links, "place").select("place", "back", leads.alias("leads")))
    while not current.filter("back is not null and array_max(leads) <> array_min(leads)").isEmpty():
        earlier = current.select(F.col("place").alias("back"), F.col("back").alias("further"), F.col("leads").alias("first"))
        composed = F.transform("first", lambda state: F.element_at("leads", (state + 1).cast("int")))
        linked = current.join(earlier, "back", "left")
        current = settled(
            linked.select(
                "place",
                F.when(F.col("first").isNotNull(), F.col("further")).otherwise(F.col("back")).alias("back"),
                F.when(F.col("first").isNotNull(), composed).otherwise(F.col("leads")).alias("leads"),
            )
        )
    left = current.select(F.col("place").alias("previous"), F.col("leads")[0].alias("entered"))
    return rows.select("place", "previous").join(left, "previous", "left").select("place", F.coalesce("entered", F.lit(0)).alias("entered"))


def _cross_duplicates(rows: DataFrame) -> DataFrame:
    """``rows`` with kinds in which rows whose key an earlier chunk of the conversation has must go as well."""
    each = rows.select("conv_id", "place", F.posexplode("keys").alias("row", "key")).filter("length(key) > 0")
    each = each.groupBy("conv_id", "place", "key").agg(F.min("row").alias("row"))
    firsts = each.groupBy("conv_id", "key").agg(F.min("place").alias("first"), F.count("*").alias("times"))
    again = each.join(firsts.filter("times > 1").drop("times"), (each.key == firsts.key) & each.conv_id.eqNullSafe(firsts.conv_id)).filter("place > first")
    gone = again.groupBy("place").agg(F.collect_list("row").alias("gone"))

    def run(place, kinds, keys, gone):
        kinds = _local_duplicates(kinds, keys)
        for row in gone or []:
            kinds[row] = "D"
        return place, kinds

    joined = rows.join(gone, "place", "left")
    fixed = _mapped(joined, ["place", "kinds", "keys", "gone"], run, "place long, kinds array<string>", [pa.int64(), pa.list_(pa.string())])
    return settled(rows.drop("kinds").join(fixed, "place"))


def _stitched(rows: DataFrame, id_type: str, arrow_type: pa.DataType) -> DataFrame:
    """Reports of conversations that may lie in several chunks (``rows``: those chunks)."""
    by_conv = W.partitionBy("conv_id").orderBy("place")
    slim = rows.select(
        "conv_id", "place", "low", "high", F.element_at("roles", 1).alias("head"), F.element_at("roles", -1).alias("tail")
    )
    slim = settled(
        slim.select(
            "place",
            F.lag("place").over(by_conv).alias("previous"),
            F.lead("place").over(by_conv).alias("following"),
            F.coalesce((F.lag("high").over(by_conv) == F.col("low")).cast("int"), F.lit(0)).alias("shared"),
            F.concat(F.substring(F.lag("tail").over(by_conv), 1, 1), F.substring("head", 1, 1)).alias("border"),
        )
    )
    rows = _cross_duplicates(rows.join(slim, "place"))
    costs = settled(_costs_behind(rows))
    entered = _entered(rows, costs)
    ready = rows.join(costs.select("place", "after"), "place").join(entered, "place")

    def run(conv, place, following, kinds, roles, texts, keys, after, entered, border):
        edits, counts, state = trace(kinds, backward(kinds, tuple(after)), entered)
        ended = following is None
        lines = list(_lines(edits, counts, roles, texts, ended, state))
        done = [*edits, *(closing(state) if ended else [])]
        illegal = _illegal(_initials(roles)) + (border is not None and border not in ("su", "ua", "au"))
        audit = "".join(edit for _, edit, _ in done)
        return conv, place, *_counts(kinds, keys), illegal, sum(c for c, _, _ in done), audit, lines

    out = f"conv_id {id_type}, place long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, lines array<string>"
    columns = ["conv_id", "place", "following", "kinds", "roles", "texts", "keys", "after", "entered", "border"]
    types = [arrow_type, pa.int64(), *[t for _, t in _REPORT], pa.list_(pa.string())]
    pieces = settled(_mapped(ready, columns, run, out, types))
    sums = [F.sum(name).alias(name) for name in ("blank", "duplicate", "truncated", "illegal", "cost")]
    audit = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "audit"))), lambda x: x["audit"]), "").alias("audit")
    report = pieces.groupBy("conv_id").agg(*sums, audit)
    turns = (F.max("high") - F.min("low") + 1 - (F.sum("turns") - F.sum("shared"))).alias("gaps")
    gaps = rows.groupBy("conv_id").agg(F.coalesce(turns, F.lit(0)).cast("long").alias("gaps"))

    def hashed(batches):
        schema = pa.schema([("conv_id", arrow_type), ("repaired_sha256", pa.string())])
        current, digest, begun = None, None, False

        def row():
            return pa.RecordBatch.from_arrays([pa.array([current], arrow_type), pa.array([digest.hexdigest()])], schema=schema)

        for batch in batches:
            for conv, lines in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if digest is None or conv != current:
                    if digest is not None:
                        yield row()
                    current, digest, begun = conv, hashlib.sha256(), False
                for line in lines:
                    digest.update((("\n" if begun else "") + line).encode("utf-8", "surrogatepass"))
                    begun = True
        if digest is not None:
            yield row()

    lines = pieces.select("conv_id", "place", "lines").repartition("conv_id").sortWithinPartitions("conv_id", "place")
    digests = lines.mapInArrow(hashed, f"conv_id {id_type}, repaired_sha256 string")
    same = lambda a, b: a.conv_id.eqNullSafe(b.conv_id)
    joined = report.join(gaps, same(report, gaps)).drop(gaps.conv_id)
    return joined.join(digests, same(joined, digests)).drop(digests.conv_id)


_COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def repair(df: DataFrame) -> DataFrame:
    """One row per conversation: faults, the cost and initials of the cheapest edits, the repaired text's SHA-256."""
    chunks = chunks_of(df)
    id_type = chunks.schema["conv_id"].dataType.simpleString()
    arrow_type = chunks.select("conv_id").limit(0).toArrow().schema.field(0).type
    schema = pa.schema([("conv_id", arrow_type), ("gaps", pa.int64()), *_REPORT, ("repaired_sha256", pa.string())])
    out = f"conv_id {id_type}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    whole = chunks.filter("inner").mapInArrow(_judged(schema), out)
    rest = _stitched(chunks.filter("not inner"), id_type, arrow_type)
    return whole.select(*_COLUMNS).unionByName(rest.select(*_COLUMNS))
