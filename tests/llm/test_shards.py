from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tokenizers import Tokenizer

from slopeworks.llm import shards
from slopeworks.llm.bytepairs import WordTable
from slopeworks.llm.shards import compressed, expanded, read_token_shards, write_token_shards
from tests.llm.fixtures import documents, no_documents, texts

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def words():
    return WordTable(PATH, max_words=60)


@pytest.fixture(scope="module")
def library():
    """The tokenizer as it is in its file."""
    return Tokenizer.from_file(PATH)


@settings(max_examples=300, deadline=None)
@given(
    st.lists(
        st.lists(st.sampled_from([*"ab'sretvmld 1½é\n\t.!東 \x1c\x85<|>", "<|endoftext|>", "<|endoftext"]), max_size=40).map("".join), max_size=5
    )
)
def test_ids_as_the_library(words, library, rows):
    values, counts = words.encoded(rows)
    expected = [x.ids for x in library.encode_batch(rows, add_special_tokens=False)]
    assert [x for ids in expected for x in ids] == values.tolist()
    assert [len(ids) for ids in expected] == counts.tolist()


def test_added_tokens_have_their_own_ids(words, library):
    token = "<|endoftext|>"
    rows = [f"{token} b", f"a {token} b", f"a {token}", f"a{token}{token} \n b", "", f"{token}", "a <|endoftext b", "plain", f" {token} " * 50]
    values, counts = words.encoded(rows)
    expected = [library.encode(row, add_special_tokens=False).ids for row in rows]
    assert [x for ids in expected for x in ids] == values.tolist() and [len(x) for x in expected] == counts.tolist()
    assert library.token_to_id(token) in values and expected[1] == [64, 220, 50256, 275]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 5), max_size=60), min_size=1, max_size=8), st.integers(2, 5))
def test_grammar_round_trip(rows, least):
    shards.MIN_COUNT, kept = least, shards.MIN_COUNT
    try:
        ids = np.array([x for row in rows for x in [*row, 7]], np.uint32)
        counts = np.array([len(row) + 1 for row in rows])
        block = compressed(ids, counts, 8) | {"base": 8}
    finally:
        shards.MIN_COUNT = kept
    assert expanded(block).tolist() == ids.tolist()
    ends = np.cumsum(counts)
    for k in range(len(rows)):  # any document alone
        assert expanded(block, k, k + 1).tolist() == ids[ends[k] - counts[k] : ends[k]].tolist()


def test_repeats_are_compressed():
    ids = np.array(([5, 6, 7, 8] * 500 + [2]) * 20, np.uint32)
    block = compressed(ids, np.full(20, 2001), 10)
    assert len(block["symbols"]) // block["width"] < len(ids) / 20


def test_files_round_trip_and_offsets(spark, tmp_path, library):
    path = str(tmp_path / "tokens")
    write_token_shards(documents(spark), path, PATH, end_id=2, block_tokens=300)
    found = sorted((tuple(r) for r in read_token_shards(spark, path).collect()), key=lambda r: r[1])
    start = 0
    encode = lambda t: [*library.encode(t, add_special_tokens=False).ids, 2]
    for (doc_id, text), row in zip(sorted(texts(), key=lambda r: (r[0], r[1] or "")), found, strict=True):
        ids = encode(text or "")
        assert row[:3] == (doc_id, start, len(ids))
        assert zlib.crc32(bytes(row[3])) == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_no_documents(spark, tmp_path):
    path = str(tmp_path / "none")
    write_token_shards(no_documents(spark), path, PATH, end_id=2)
    assert read_token_shards(spark, path).count() == 0
