"""Texts of an Arrow batch as byte blocks, and words, hashes and shingles of a block as numpy arrays."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute

# Bytes of text handled at once; a longer text is a block of its own.
BLOCK_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)


def row_blocks(batches, column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of the batches with at most ``limit`` bytes of text in a slice (one row at least)."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        if batch.num_rows == 0:
            continue
        ends = np.cumsum([0 if n is None else n for n in pa.compute.binary_length(texts).to_pylist()])
        start, done = 0, 0
        while start < batch.num_rows:
            stop = max(start + 1, int(np.searchsorted(ends, done + limit, "right")))
            yield batch.slice(start, stop - start)
            start, done = stop, int(ends[stop - 1])


def column_of(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' UTF-8 bytes, end to end, and where each begins (one more than texts); null is empty."""
    texts = pa.compute.fill_null(texts.cast(pa.large_string()), "")
    _, offsets, data = texts.buffers()
    starts = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None or starts[-1] == starts[0]:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[starts[0] : starts[-1]], starts - starts[0]


def runs(mask: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true in ``mask``, cut at ``breaks`` (text starts, then the end),
    and the number of runs before each break."""
    size = len(mask)
    if size == 0:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(len(breaks), np.int64)
    before = np.empty(size, bool)
    before[0], before[1:] = False, mask[:-1]
    after = np.empty(size, bool)
    after[-1], after[:-1] = False, mask[1:]
    inner = breaks[(breaks > 0) & (breaks < size)]
    before[inner], after[inner - 1] = False, False
    starts = np.flatnonzero(mask & ~before)
    ends = np.flatnonzero(mask & ~after) + 1
    return starts, ends, np.searchsorted(starts, breaks)


@lru_cache(maxsize=2)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
    with np.errstate(over="ignore"):
        ups = np.full(size + 1, _BASE, np.uint64)
        downs = np.full(size + 1, inverse, np.uint64)
        ups[0] = downs[0] = 1
        return np.multiply.accumulate(ups), np.multiply.accumulate(downs)


def mixed(words: np.ndarray) -> np.ndarray:
    """Finalise 64-bit words so that every output bit depends on every input bit."""
    with np.errstate(over="ignore"):
        words = (words ^ (words >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        words = (words ^ (words >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return words ^ (words >> np.uint64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of the block, from prefix sums; equal spans have equal hashes."""
    size = len(data)
    room = max(BLOCK_BYTES, 1 << int(size - 1).bit_length() if size > 1 else 1)
    ups, downs = _powers(room)
    sums = np.zeros(size + 1, np.uint64)
    with np.errstate(over="ignore"):
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * ups[:size], out=sums[1:])
        return mixed((sums[ends] - sums[starts]) * downs[starts] + (ends - starts).astype(np.uint64))


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every ``size`` consecutive word hashes, also over text borders (callers drop those)."""
    count = len(words) - size + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        total = np.zeros(count, np.uint64)
        for k in range(size):
            total = total * _BASE + words[k : k + count]
        return mixed(total + np.uint64(size))


def list_array(values: np.ndarray, counts: np.ndarray, kind=pa.int32()) -> pa.ListArray:
    offsets = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """0: not looked at yet, 1: no letter, 2: letter; by code point."""
    return np.zeros(0x110000, np.uint8)


def letter_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts, end to end, starts and ends of the runs of letters, and the
    number of such words before each text (one more than texts)."""
    lowered = [text.lower() for text in texts]
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    table = _letters()
    known = table[points]
    if not known.all():
        fresh = np.unique(points[known == 0])
        table[fresh] = [2 if chr(point).isalpha() else 1 for point in fresh.tolist()]
        known = table[points]
    breaks = np.concatenate([[0], np.cumsum([len(text) for text in lowered], dtype=np.int64)])
    starts, ends, before = runs(known == 2, breaks)
    return points, starts, ends, before


def sums_by_text(values: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Sums of the values of each text; ``before`` counts the values before each text."""
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    return total[before[1:]] - total[before[:-1]]
