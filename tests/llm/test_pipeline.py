from __future__ import annotations

import hashlib
import re
import subprocess
import sys

import public_tokenizers
import pytest
import sentencepiece

import corpus_pipeline
from slopeworks.llm.queries import llm_queries
from tests.llm.fixtures import documents, no_documents, texts
from tests.llm.test_decontaminate import brute_force as contaminated
from tests.llm.test_near_texts import shingles, similarity
from tests.llm.test_secrets import plain as plain_spans

SF = "/root/testdata/sf0.01"
SMALL = "/root/testdata/sf0.001"


def write(frame, folder, name):
    frame.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Every stage's input and output over the given tables."""
    out, docs = [], spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "rows")
        stage(spark, docs, SF).write.parquet(path)
        after = spark.read.parquet(path)
        out.append((name, docs, after))
        docs = after
    return {name: (before.toPandas(), after.toPandas()) for name, before, after in out}


def test_stages_return_the_columns_of_documents(stages):
    columns = ["doc_id", "text", "lang", "source", "n_chars"]
    assert list(stages) == ["quality", "near_duplicates", "decontamination", "secrets", "pieces"]
    for name in list(stages)[:-1]:
        assert list(stages[name][1].columns) == columns


def test_quality_rejects_poor_documents_and_keeps_good_ones(spark, stages):
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas().set_index("doc_id").quality
    before, after = stages["quality"]
    known = before[before.doc_id.isin(labels.index)]
    kept = known.doc_id.isin(after.doc_id)
    assert (kept == (known.doc_id.map(labels) == 1)).mean() > 0.95


def test_one_of_each_group_stays(stages):
    before, after = stages["near_duplicates"]
    sets = {i: shingles(text) for i, text in zip(before.doc_id, before.text, strict=True)}
    kept, holders = set(after.doc_id), {}
    assert len(kept) == len(after) and kept < set(sets)
    for i, own in sets.items():
        for shingle in own or {()}:
            holders.setdefault(shingle, []).append(i)
    pairs = {(a, b) for ids in holders.values() for k, b in enumerate(ids) for a in ids[:k]}
    alike = [(a, b) for a, b in pairs if similarity(sets[a], sets[b]) >= 0.8]
    # Components of all true pairs: each has one that stays, and nothing else goes.
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in alike:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    assert {top(i) for i in sets} <= kept
    assert len(kept) - len({top(i) for i in sets}) <= 0.05 * (len(sets) - len({top(i) for i in sets}))


def test_contaminated_documents_go(spark, stages):
    before, after = stages["decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    # A document can only hold a window if it holds its first words.
    starts = {" ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.lower())[k : k + 3]) for _, text in items for k in range(400)}
    rows = [
        row
        for row in zip(before.doc_id, before.text, strict=True)
        if any(s and s in " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", row[1].lower())) for s in starts)
    ]
    bad = {row[0] for row in contaminated(rows, items) if row[2]}
    assert set(after.doc_id) == set(before.doc_id) - bad and bad


def test_secrets_are_taken_out(stages):
    before, after = stages["secrets"]
    assert set(before.doc_id) == set(after.doc_id)
    assert any(plain_spans(text) for text in before.text)
    assert not any(plain_spans(text) for text in after.text)
    clean = [i for i, text in zip(before.doc_id, before.text, strict=True) if not plain_spans(text)]
    old, new = before.set_index("doc_id").text, after.set_index("doc_id").text
    assert sum(old[i] == new[i] for i in clean) >= 0.99 * len(clean)


def test_pieces_as_the_library(stages):
    before, after = stages["pieces"]
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    expected = {}
    for doc_id, text in zip(before.doc_id, before.text, strict=True):
        ids = sp.encode(text)
        digests = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), sp.decode(ids))]
        expected[doc_id] = (len(ids), *digests)
    assert {r[0]: tuple(r[1:]) for r in after.itertuples(index=False)} == expected


def test_run_applies_all_stages(spark, stages):
    found = corpus_pipeline.run(spark, SF).toPandas().sort_values("doc_id")
    expected = stages["pieces"][1].sort_values("doc_id")
    assert found.values.tolist() == expected.values.tolist()


def test_stages_on_unclean_and_empty_rows(spark, tmp_path):
    folder = str(tmp_path)
    labels = spark.createDataFrame([(0, 1), (1, 0), (105, 0), (5, None)], "doc_id long, quality int")
    write(labels, folder, "labels")
    write(spark.createDataFrame([(1, None), (2, "so few")], "item_id long, text string"), folder, "benchmark")
    rows = [*texts(), (None, "no id at all"), (None, None)]
    for docs in (documents(spark, rows), no_documents(spark)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            found = stage(spark, docs, folder)
            assert found.columns == docs.columns
            assert found.count() <= docs.count()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, folder).count() == docs.count()


@pytest.mark.parametrize("name", sorted(llm_queries()))
def test_queries_have_a_row_per_input_row(spark, name):
    source, key = {"op5_pages": ("pages", "page_id"), "op6_vectors": ("embeddings", "vec_id")}.get(name, ("documents", "doc_id"))
    found = llm_queries()[name](spark, SMALL)
    ids = sorted(r[0] for r in found.select(key).collect())
    assert ids == sorted(r[0] for r in spark.read.parquet(f"{SMALL}/{source}.parquet").select(key).collect())


def test_nothing_else_imports_the_folder():
    code = "import sys, slopeworks; import slopeworks.catalog.queries; print(any('llm' in m for m in sys.modules if 'slopeworks' in m))"
    assert subprocess.run([sys.executable, "-c", code], capture_output=True, text=True).stdout.strip() == "False"
