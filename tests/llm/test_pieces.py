from __future__ import annotations

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from slopeworks.llm.pieces import ChunkTable, chunks_of, encode_pieces, separable
from tests.llm.fixtures import documents, no_documents, texts

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def table():
    return ChunkTable(PATH, max_chunks=50)


def test_model_can_be_cut_at_markers(table):
    assert separable(table.processor) and not table.whole


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab é東\n\t▁ \x00.1🙂\U0001d518<>"), max_size=30), max_size=5))
def test_ids_and_text_as_the_library(table, rows):
    values, counts, decoded = table.encoded(rows)
    expected = table.processor.encode(rows)
    assert [x for ids in expected for x in ids] == values.tolist()
    assert [len(ids) for ids in expected] == counts.tolist()
    assert decoded == [table.processor.decode(ids) for ids in expected]


def test_chunks_keep_runs_of_markers_with_what_follows():
    assert chunks_of("a b  c ") == ["a", "b", "▁c", ""]
    assert chunks_of("") == [] and chunks_of(" ") == ["▁"]


def test_rows(spark, table):
    found = {(r.doc_id, tuple(r.ids), r.decoded) for r in encode_pieces(documents(spark), PATH).collect()}
    sp = table.processor
    assert found == {(i, tuple(sp.encode(t or "")), sp.decode(sp.encode(t or ""))) for i, t in texts()}
    assert encode_pieces(documents(spark), PATH).count() == len(texts())
    assert encode_pieces(no_documents(spark), PATH).count() == 0


def test_whole_text_models_take_the_plain_way(table):
    whole = ChunkTable(PATH)
    whole.whole = True
    rows = [t or "" for _, t in texts()]
    for a, b in zip(whole.encoded(rows), table.encoded(rows), strict=True):
        assert list(a) == list(b)
