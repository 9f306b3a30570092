"""Byte-level BPE ids of whole texts, each distinct pre-token encoded once per worker.

The pre-tokenizer cuts a text by character class (letters, numbers, white space, the rest); the cut is
found here on arrays of code points, with classes learned by asking the library's own pre-tokenizer, and
every new pre-token is encoded by the library.  What a pre-token encodes to does not depend on where it
stands, so the ids are those of the whole text.  Strings of added tokens, such as ``<|endoftext|>``, get the ids the
library gives them.
"""

from __future__ import annotations

from array import array
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd

from slopeworks.llm.blocks import span_hashes

# Distinct pre-tokens a worker keeps.
MAX_WORDS = 500_000
# Ids it keeps for them.
MAX_IDS = 8_000_000
_GROUP = 32
_UNKNOWN, _LETTER, _NUMBER, _SPACE, _OTHER = range(5)
# The contractions of the byte-level pattern.
_CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")


class WordTable:
    """Pre-tokens met so far with their ids."""

    def __init__(self, path: str, max_words: int = MAX_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.opens = np.zeros(self.vocabulary, bool)
        for piece, place in self.tokenizer.get_vocab().items():
            self.opens[place] = piece.startswith("Ġ")
        self.max_words = max_words
        self.kinds = np.zeros(0x110000, np.uint8)
        self.clear()

    def clear(self) -> None:
        self.place: dict[int, int] = {}
        self.flat = array("i")
        self.starts = array("q", [0])

    def _learn_kinds(self, points: np.ndarray) -> None:
        cut = self.tokenizer.pre_tokenizer.pre_tokenize_str
        for point in points.tolist():
            one = chr(point)
            if len(cut(f"a{one}a")) == 1:
                kind = _LETTER
            elif len(cut(f"1{one}1")) == 1:
                kind = _NUMBER
            elif len(cut(f"!{one}!")) == 1:
                kind = _OTHER
            else:
                kind = _SPACE
            self.kinds[point] = kind

    def _cuts(self, points: np.ndarray, breaks: np.ndarray) -> np.ndarray:
        """Where pre-tokens start."""
        kinds = self.kinds[points]
        if not kinds.all():
            self._learn_kinds(np.unique(points[kinds == _UNKNOWN]))
            kinds = self.kinds[points]
        size = len(points)
        first = np.zeros(size + 1, bool)
        first[breaks] = True
        space = kinds == _SPACE
        start = first[:size].copy()
        start[1:] |= (kinds[1:] != kinds[:-1]) & (points[:-1] != 32)
        # White space before something else: its last character stands apart, or goes with what follows.
        start[:-1] |= space[:-1] & ~space[1:] & ~first[1:size]
        start[1:] |= space[1:] & ~space[:-1]
        quotes = np.flatnonzero((points == 39) & start)
        for text in _CONTRACTIONS:
            rest = [ord(x) for x in text[1:]]
            hit = quotes[quotes + len(rest) < size]
            for k, point in enumerate(rest, 1):
                hit = hit[(points[hit + k] == point) & ~first[hit + k]]
            start[hit + 1] = False
            after = hit + len(text)
            start[after[after < size]] = True
        return np.flatnonzero(start)

    def _add(self, words: list[str], hashes: list[int]) -> None:
        encode = self.tokenizer.encode_batch_fast
        plain = [k for k, word in enumerate(words) if len(word) > 1 and word[0] == " " and word[1:].isalpha()]
        rest = sorted(set(range(len(words))).difference(plain))
        groups = ["".join(words[k] for k in plain[at : at + _GROUP]) for at in range(0, len(plain), _GROUP)]
        flat = np.fromiter(chain.from_iterable(x.ids for x in encode(groups, add_special_tokens=False)), np.int32)
        starts = np.flatnonzero(self.opens[flat])
        if len(starts) == len(plain):
            before, base = len(self.place), len(self.flat)
            self.place.update((hashes[k], before + n) for n, k in enumerate(plain))
            if plain:
                self.starts.frombytes((np.append(starts[1:], len(flat)) + base).astype(np.int64).tobytes())
            self.flat.frombytes(flat.tobytes())
        else:
            rest = range(len(words))
        for k, own in zip(rest, encode([words[k] for k in rest], add_special_tokens=False), strict=True):
            self.place[hashes[k]] = len(self.place)
            self.flat.extend(own.ids)
            self.starts.append(len(self.flat))

    def encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, and the number of ids by text.

        A text that holds an added token's string is cut there before anything else; the library encodes such texts
        whole, so the token's own rules (strip, single word) hold."""
        joined = "".join(texts)
        marked = [k for k, text in enumerate(texts) if any(token in text for token in self.added)] if any(t in joined for t in self.added) else []
        if not marked:
            return self._plain(texts, joined)
        own = self.tokenizer.encode_batch_fast([texts[k] for k in marked], add_special_tokens=False)
        rest = list(texts)
        for k in marked:
            rest[k] = ""
        values, counts = self._plain(rest, "".join(rest))
        ends = np.cumsum(counts)
        parts, done = [], 0
        for k, ids in zip(marked, own, strict=True):
            parts += [values[done : ends[k]], np.array(ids.ids, np.int32)]
            counts[k], done = len(ids.ids), ends[k]
        return np.concatenate([*parts, values[done:]]), counts

    def _plain(self, texts: list[str], joined: str) -> tuple[np.ndarray, np.ndarray]:
        """``encoded`` for texts without added tokens."""
        breaks = np.cumsum([0, *map(len, texts)])
        if not joined:
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        if len(self.place) > self.max_words or len(self.flat) > MAX_IDS:
            self.clear()
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        cuts = self._cuts(points, breaks[:-1][breaks[:-1] < len(points)])
        ends = np.append(cuts[1:], len(points))
        codes, hashes = pd.factorize(span_hashes(points, cuts, ends))
        keys = hashes.tolist()
        spots = [self.place.get(key, -1) for key in keys]
        fresh = [k for k, spot in enumerate(spots) if spot < 0]
        if fresh:
            sample = np.empty(len(keys), np.int64)
            sample[codes[::-1]] = np.arange(len(codes))[::-1]
            words = [joined[a:b] for a, b in zip(cuts[sample[fresh]].tolist(), ends[sample[fresh]].tolist(), strict=True)]
            self._add(words, [keys[k] for k in fresh])
            spots = list(map(self.place.__getitem__, keys))
        starts = np.frombuffer(self.starts, np.int64)
        flat = np.frombuffer(self.flat, np.int32)
        spots = np.array(spots, np.int64)[codes]
        sizes = starts[spots + 1] - starts[spots]
        sums = np.concatenate([[0], np.cumsum(sizes)])
        values = flat[np.repeat(starts[spots] - sums[:-1], sizes) + np.arange(int(sums[-1]))]
        del starts, flat  # they hold the arrays that the next call extends
        return values, np.diff(sums[np.searchsorted(cuts, breaks)])


@lru_cache(maxsize=2)
def word_table(path: str, max_words: int = MAX_WORDS) -> WordTable:
    """One table for a Python worker: it outlives a task and stays within its bound."""
    return WordTable(path, max_words)
