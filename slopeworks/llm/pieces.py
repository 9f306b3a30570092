"""Operator 10: SentencePiece encoding and decoding through a table of distinct chunks.

Where no piece of the model joins an ordinary character to a following white-space marker, a text
falls apart at its markers: a run of markers with the characters after it is segmented the same way
wherever it stands.  Each task keeps a table of the distinct chunks it has met, segments a new chunk
once, and joins the ids back by position.  The table is emptied when it holds ``max_chunks`` chunks or ``MAX_CHARS`` characters, so
a worker's memory is bounded; what a chunk encodes to does not depend on it.  Models whose pieces cross
a marker, or that normalise text, are run on whole texts instead.

Null is an empty text: no ids, empty decoded text.  Every input row gives one output row, repeated
rows included; other columns are left out.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from slopeworks.llm.blocks import column_of, list_array, row_blocks

MARK = "▁"
MAX_CHUNKS = 250_000
# So it is when its chunks have so many characters together.
MAX_CHARS = 16_000_000
# Plain chunks that go through the model in one call.
_GROUP = 32


def separable(processor) -> bool:
    """Whether texts of this model can be cut before every run of markers."""
    pieces = (processor.id_to_piece(i) for i in range(processor.get_piece_size()))
    crossing = any(re.search(f"[^{MARK}]{MARK}", piece) for piece in pieces)
    same = all(
        processor.decode(processor.encode(text)) == text for text in ("  a  b ", "ﬁ ½　 x", "\t\r\n é")
    )
    return same and not crossing


class ChunkTable:
    """Distinct chunks with their ids and decoded text; a chunk's key lacks its first marker."""

    def __init__(self, path: str, max_chunks: int = MAX_CHUNKS):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        self.max_chunks = max_chunks
        self.whole = not separable(self.processor)
        lead = self.processor.encode("a")
        self.lead, self.lead_chars = lead, len(self.processor.decode(lead))
        pieces = (self.processor.id_to_piece(i) for i in range(self.processor.get_piece_size()))
        self.opens = np.array([piece.startswith(MARK) for piece in pieces])
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.chars = 0
        # What decoding gives where it is not the chunk itself.
        self.other: dict[int, str] = {}
        self.flat = array("i")
        self.starts = array("q", [0])

    def add(self, chunks: list[str]) -> None:
        """Segment new chunks.  Plain ones, with one marker each, go through the model many at a time:
        every piece that begins with a marker begins the next chunk."""
        plain = [chunk for chunk in chunks if chunk and MARK not in chunk]
        rest = [chunk for chunk in chunks if not chunk or MARK in chunk]
        groups = [plain[k : k + _GROUP] for k in range(0, len(plain), _GROUP)]
        ids = self.processor.encode([MARK.join(group) for group in groups], num_threads=1)
        texts = [text.split(" ") for text in self.processor.decode(ids, num_threads=1)]
        flat = np.fromiter(chain.from_iterable(ids), np.int32)
        starts = np.flatnonzero(self.opens[flat])
        if len(starts) == len(plain) and list(map(len, texts)) == list(map(len, groups)):
            before = len(self.place)
            parts = list(chain.from_iterable(texts))
            self.other.update((before + k, f" {part}") for k, part in enumerate(parts) if part != plain[k])
            self.place.update(zip(plain, range(before, before + len(plain)), strict=True))
            if plain:
                self.starts.frombytes((np.append(starts[1:], len(flat)) + len(self.flat)).astype(np.int64).tobytes())
            self.flat.frombytes(flat.tobytes())
        else:
            rest = chunks
        for chunk in rest:
            # A last marker without characters is a chunk; alone, an empty text has no ids.
            own = self.processor.encode(chunk) if chunk else self.processor.encode(f"a{MARK}")[len(self.lead) :]
            text = self.processor.decode(self.lead + own)[self.lead_chars :]
            if text != f" {chunk}".replace(MARK, " "):
                self.other[len(self.place)] = text
            self.place[chunk] = len(self.place)
            self.flat.extend(own)
            self.starts.append(len(self.flat))

    def encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, list[str]]:
        """Ids of all texts, number of ids by text, decoded texts."""
        if self.whole:
            ids = self.processor.encode(texts, num_threads=1)
            flat = np.fromiter(chain.from_iterable(ids), np.int32)
            return flat, np.array([len(x) for x in ids], np.int64), self.processor.decode(ids, num_threads=1)
        if len(self.place) > self.max_chunks or self.chars > MAX_CHARS:
            self.clear()
        cut = [chunks_of(text) for text in texts]
        fresh = set(chain.from_iterable(cut)).difference(self.place)
        if fresh:
            self.add(list(fresh))
            self.chars += sum(map(len, fresh))
        spots = np.fromiter(map(self.place.__getitem__, chain.from_iterable(cut)), np.int64)
        starts = np.frombuffer(self.starts, np.int64)
        flat = np.frombuffer(self.flat, np.int32) if self.flat else np.zeros(0, np.int32)
        sizes = starts[spots + 1] - starts[spots]
        before = np.cumsum(sizes) - sizes
        values = flat[np.repeat(starts[spots] - before, sizes) + np.arange(int(sizes.sum()))]
        del starts, flat  # they hold the arrays that the next call extends
        ends = np.cumsum([len(chunks) for chunks in cut])
        sums = np.concatenate([[0], np.cumsum(sizes)])
        counts = np.diff(sums[np.concatenate([[0], ends])]) if texts else np.zeros(0, np.int64)
        return values, counts, [self._decoded(text, chunks) for text, chunks in zip(texts, cut, strict=True)]

    def _decoded(self, text: str, chunks: list[str]) -> str:
        """The text of its chunks: the first as the model decodes it, the others from the table."""
        if not chunks:
            return ""
        first = self.processor.decode(self.processor.encode(chunks[0]))
        if not self.other and first == chunks[0].replace(MARK, " "):
            return text.replace(MARK, " ")
        parts = (self.other.get(self.place[chunk], f" {chunk}".replace(MARK, " ")) for chunk in chunks[1:])
        return first + "".join(parts)


def chunks_of(text: str) -> list[str]:
    """The chunks of a text, each without its first marker; an empty text has none."""
    if not text:
        return []
    parts = text.replace(" ", MARK).split(MARK)
    if "" not in parts:
        return parts
    # An empty part is a marker without characters: it belongs to the run before the next part.
    chunks, open_marks = [], 0
    for part in parts:
        if part:
            chunks.append(MARK * open_marks + part)
            open_marks = 0
        else:
            open_marks += 1
    if open_marks:
        chunks.append(MARK * (open_marks - 1))
    return chunks


@lru_cache(maxsize=2)
def _table(path: str, max_chunks: int) -> ChunkTable:
    """One table for a Python worker: it outlives a task and stays within its bound."""
    return ChunkTable(path, max_chunks)


def encode_pieces(
    df: DataFrame, model_path: str, id_column: str = "doc_id", text_column: str = "text", max_chunks: int = MAX_CHUNKS
) -> DataFrame:
    """The id column, ``ids`` (array of int) and ``decoded`` (string) for every row."""
    id_type = df.schema[id_column].dataType.simpleString()

    def run(batches):
        table = _table(model_path, max_chunks)
        for block in row_blocks(batches):
            texts = [text or "" for text in column_of(block, "text").to_pylist()]
            values, counts, decoded = table.encoded(texts)
            yield pa.RecordBatch.from_arrays(
                [column_of(block, "id"), list_array(values, counts), pa.array(decoded, pa.string())],
                ["id", "ids", "decoded"],
            )

    rows = df.select(df[id_column].alias("id"), df[text_column].cast("string").alias("text"))
    return rows.mapInArrow(run, f"id {id_type}, ids array<int>, decoded string").withColumnRenamed("id", id_column)
