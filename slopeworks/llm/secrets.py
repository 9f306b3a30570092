"""Operator 2: secrets by pattern, and by novelty under a dictionary-primed zstandard compressor.

Base kinds are found by pattern (leftmost, not overlapping within a kind):

* ``assign``: ``(password|passwd|secret|token|api_?key)["']?\\x20*[:=]\\x20*["']?([A-Za-z0-9+/_.=-]+)``, the
  names in either case, with six or more characters in group 2;
* ``access``: ``AKIA[A-Z0-9]+`` of 20 or more characters;
* ``hex``: ``[0-9a-f]+`` of 24 or more characters.

The method adds ``novel`` spans: a candidate is a string of 12 or more key
characters, with a letter and a digit, within
``CONTEXT`` characters behind a sensitive word.  It costs what it adds to the compressed size of the text
around it, under a dictionary of the identifiers that stand around all candidates of the corpus.  Strings
that cost ``NOVEL_BITS`` bits per character or more cannot be predicted from code or prose and are reported,
unless a base span holds them already.  So are strings that cost ``NOVEL_SHARE`` or more of what random strings of
their alphabet and length cost in their place: where the compressor codes single characters by their frequency, a
random string of few characters costs its own entropy only.

Spans are in code points, end exclusive.  Null and empty texts have none.  Every input row gives one output
row, repeated rows included; other columns are left out.
"""

from __future__ import annotations

import random
import re
import string
from bisect import bisect_right
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from slopeworks.llm.blocks import column_of, row_blocks

# The kinds, in the order in which ties are listed.
KINDS = ("assign", "access", "hex", "novel")
CONTEXT = 120
NOVEL_BITS = 7.0
NOVEL_SHARE = 0.8
# Random strings a candidate is compared with.
_DRAWS = 4
DICTIONARY_WORDS = 4096
DICTIONARY_BYTES = 32768

_ASSIGN = re.compile(
    r"""(?:[pP][aA][sS][sS][wW](?:[oO][rR])?[dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"""
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{12,}")
_SENSITIVE = re.compile(
    r"(?a:passw(?:or)?d|passphrase|secret|token|api_?key|credential|authori[sz]ation|bearer|private|access|signature)",
    re.IGNORECASE | re.ASCII,
)
#: One of these is in every text with an ``assign`` span or a sensitive word, once it is lower-cased.
_STEMS = ("passw", "passphrase", "secret", "token", "key", "credential", "authori", "bearer", "private", "access", "signature")
_MIXED = re.compile(r"(?=.*[0-9])(?=.*[A-Za-z])")
_IDENTIFIER = re.compile(r"[^\W\d]\w{3,31}")


def sensitive(text: str) -> bool:
    low = text.lower()
    return any(stem in low for stem in _STEMS)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """``(start, end, kind)`` of the base kinds, by start and kind."""
    found = []
    if sensitive(text):
        found += [(m.start(), m.end(), "assign") for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in _ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex") for m in _HEX.finditer(text)]
    return sorted(found, key=lambda span: (span[0], KINDS.index(span[2])))


def candidates(text: str) -> list[tuple[int, int]]:
    """Strings of key characters, letters and digits among them, close behind a sensitive word."""
    if not sensitive(text):
        return []
    zones: list[list[int]] = []
    for word in _SENSITIVE.finditer(text):
        start, stop = word.start(), min(len(text), word.end() + CONTEXT)
        if zones and start <= zones[-1][1]:
            zones[-1][1] = stop
        else:
            zones.append([start, stop])
    found, at = [], 0
    for match in _CANDIDATE.finditer(text) if zones else ():
        while at < len(zones) and zones[at][1] <= match.start():
            at += 1
        if at == len(zones):
            break
        if match.end() > zones[at][0] and _MIXED.match(match.group()):
            found.append(match.span())
    return found


def around(text: str, start: int, end: int) -> tuple[str, str]:
    return text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]


@lru_cache(maxsize=2)
def _compressor(dictionary: bytes):
    import zstandard

    content = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if dictionary else None
    parameters = zstandard.ZstdCompressionParameters.from_level(9, write_checksum=0, write_content_size=0, write_dict_id=0)
    return zstandard.ZstdCompressor(dict_data=content, compression_params=parameters)


def _alphabet(own: str) -> str:
    """The characters a random string like this one is drawn from: digits, and hex digits or the letters of its cases."""
    letters = set(re.findall("[A-Za-z]", own))
    lower, upper = any(c.islower() for c in letters), any(c.isupper() for c in letters)
    if lower != upper and letters <= set("abcdefABCDEF"):
        return "0123456789" + ("abcdef" if lower else "ABCDEF")
    return string.digits + string.ascii_lowercase * lower + string.ascii_uppercase * upper


def _drawn(own: str) -> list[str]:
    """Random strings of the same length, with the same marks in the same places; the same for the same span."""
    draw, alphabet = random.Random(own), _alphabet(own)
    return ["".join(draw.choice(alphabet) if c.isalnum() else c for c in own) for _ in range(_DRAWS)]


def unpredictable(text: str, start: int, end: int, dictionary: bytes) -> bool:
    """Whether the span costs as much as a random string would there."""
    bits = novelty(text, start, end, dictionary)
    if bits >= NOVEL_BITS:
        return True
    own = text[start:end]
    before, after = around(text, start, end)
    before, after = before.replace(own, " "), after.replace(own, " ")
    at = len(before)
    costs = [novelty(f"{before}{other}{after}", at, at + len(own), dictionary) for other in _drawn(own)]
    return bits >= NOVEL_SHARE * sum(costs) / len(costs)


def novelty(text: str, start: int, end: int, dictionary: bytes) -> float:
    """Bits per character that the span adds to the compressed size of the text around it."""
    before, after = around(text, start, end)
    # Copies of the span in its own surroundings say nothing of how predictable it is.
    own = text[start:end]
    before, after = before.replace(own, " "), after.replace(own, " ")
    compress = _compressor(dictionary).compress
    plain = len(compress(f"{before}{after}".encode("utf-8", "replace")))
    whole = len(compress(f"{before}{own}{after}".encode("utf-8", "replace")))
    return 8 * (whole - plain) / (end - start)


def spans_of(text: str, dictionary: bytes) -> list[tuple[int, int, str]]:
    """Base and novel spans, by start and kind."""
    found = base_spans(text)
    starts, reach = [span[0] for span in found], list(accumulate((span[1] for span in found), max))
    for start, end in candidates(text):
        before = bisect_right(starts, start)
        if before and reach[before - 1] >= end:  # a base span holds it
            continue
        if unpredictable(text, start, end, dictionary):
            found.append((start, end, "novel"))
    return sorted(found, key=lambda span: (span[0], KINDS.index(span[2])))


def surroundings(df: DataFrame, text_column: str = "text") -> DataFrame:
    """``word, times``: identifiers around the candidates of all texts."""

    def run(batches):
        for block in row_blocks(batches):
            counts: dict[str, int] = {}
            for text in column_of(block, "text").to_pylist():
                if not text:
                    continue
                for start, end in candidates(text):
                    for side in around(text, start, end):
                        for word in _IDENTIFIER.findall(side):
                            # A secret near another one must not teach the compressor.
                            if len(word) < 8 or not _MIXED.match(word):
                                counts[word] = counts.get(word, 0) + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "times"]
            )

    rows = df.select(df[text_column].cast("string").alias("text")).mapInArrow(run, "word string, times long")
    return rows.groupBy("word").agg(F.sum("times").alias("times"))


def identifier_dictionary(df: DataFrame, text_column: str = "text") -> bytes:
    """The most frequent identifiers around candidates, the most frequent last, where they are cheapest
    to refer to.  At most ``DICTIONARY_WORDS`` words come to the driver."""
    top = surroundings(df, text_column).orderBy(F.desc("times"), "word").limit(DICTIONARY_WORDS).collect()
    words: list[bytes] = []
    size = 0
    for row in top:
        word = row["word"].encode() + b" "
        if size + len(word) > DICTIONARY_BYTES:
            break
        words.append(word)
        size += len(word)
    return b"".join(reversed(words))


def find_secrets(
    df: DataFrame, id_column: str = "doc_id", text_column: str = "text", dictionary: bytes | None = None
) -> DataFrame:
    """The id column and ``spans`` (array of kind, start, end, by start and kind) for every row."""
    id_type = df.schema[id_column].dataType.simpleString()
    dictionary = identifier_dictionary(df, text_column) if dictionary is None else dictionary

    def run(batches):
        for block in row_blocks(batches):
            spans = [
                [{"kind": kind, "start": start, "end": end} for start, end, kind in spans_of(text, dictionary)]
                if text
                else []
                for text in column_of(block, "text").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([column_of(block, "id"), pa.array(spans, kind)], ["id", "spans"])

    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    rows = df.select(df[id_column].alias("id"), df[text_column].cast("string").alias("text"))
    schema = f"id {id_type}, spans array<struct<kind:string,start:bigint,end:bigint>>"
    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_column)


def without_spans(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span, or run of overlapping spans, replaced by the kind of its first."""
    parts, at = [], 0
    for start, end, kind in spans:
        if start >= at:
            parts += [text[at:start], f"[{kind}]"]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def redact(df: DataFrame, text_column: str = "text", length_column: str = "n_chars") -> DataFrame:
    """The rows of ``df`` with secrets taken out of the text, and the length as it is then; other columns
    and rows without secrets stay as they are."""
    dictionary = identifier_dictionary(df, text_column)

    def run(batches):
        for block in row_blocks(batches, text_column):
            columns = {name: block.column(place) for place, name in enumerate(block.schema.names)}
            texts = columns[text_column].to_pylist()
            spans = [spans_of(text, dictionary) if text else [] for text in texts]
            if any(spans):
                changed = [without_spans(text, own) if own else text for text, own in zip(texts, spans, strict=True)]
                columns[text_column] = pa.array(changed, columns[text_column].type)
                if length_column in columns:
                    lengths = zip(columns[length_column].to_pylist(), changed, spans, strict=True)
                    columns[length_column] = pa.array(
                        [len(text) if own else length for length, text, own in lengths], columns[length_column].type
                    )
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return df.mapInArrow(run, df.schema)
