"""Exact duplicates against grouping by normalised text."""

import hashlib
import re
from uuid import uuid4

import pytest

from slopeworks.llm.exact import DigestIndex, digests, distinct_texts
from slopeworks.llm.queries import op13_exact

SCHEMA = "doc_id long, text string"
ROWS = [
    (5, "one  two"), (3, "one two"), (9, "one\ttwo"), (9, "one\ttwo"), (4, "One two"), (None, "one two"), (None, "alone"), (None, "alone"),
    (7, None), (8, ""), (2, " "), (6, "\n\n"), (1, "a b"), (10, "a b"), (11, "x" * 200_000), (12, "x" * 200_000 + " "),
]


def form(text):
    return re.sub(r"[\x20\x09-\x0d]+", " ", text or "")


@pytest.fixture
def path(tmp_path):
    return str(tmp_path / uuid4().hex)


def brute(rows):
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(form(text), []).append(doc_id)
    out = []
    for text, ids in groups.items():
        keep = min((i for i in ids if i is not None), default=None)
        digest = hashlib.sha256(text.encode()).digest()
        kept = [k == ids.index(keep) for k in range(len(ids))]
        out += [(i, keep, len(ids), k, digest) for i, k in zip(ids, kept, strict=True)]
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(x if not isinstance(x, bytearray) else bytes(x) for x in r) for r in df.collect()), key=str)


def test_one_delivery(spark, path):
    rows = digests(spark.createDataFrame(ROWS, SCHEMA))
    index = DigestIndex.at(spark, path, buckets=3)
    index.add(rows, "1")
    assert found(index.resolve(rows)) == brute(ROWS)
    assert index.entries().count() == len({form(t) for _, t in ROWS})


def test_later_deliveries_append_what_is_new_and_may_be_repeated(spark, path):
    rows = digests(spark.createDataFrame(ROWS, SCHEMA))
    index = DigestIndex.at(spark, path, buckets=3)
    index.add(rows.filter("id <= 5"), "1")
    again = DigestIndex.at(spark, path, buckets=99)  # opened anew: as it was begun
    assert again.buckets == 3
    again.add(rows.filter("id > 5 or id is null"), "2")
    before = found(again.entries())
    again.add(rows.filter("id > 5 or id is null"), "2")
    assert found(again.entries()) == before
    assert found(again.resolve(rows)) == brute(ROWS)
    assert len({bytes(r["digest"]) for r in again.entries().collect()}) == len(before)


def test_the_index_is_read_in_its_buckets(spark, path):
    rows = digests(spark.createDataFrame(ROWS, SCHEMA))
    index = DigestIndex.at(spark, path, buckets=8)
    index.add(rows, "1")
    known = index.entries().select("digest").hint("merge")
    fresh = rows.groupBy("digest").count().repartition(8, "digest").join(known, "digest", "left_anti")
    plan = fresh._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan


def test_distinct_texts_keep_all_columns(spark, path):
    df = spark.createDataFrame([(*row, k, "x") for k, row in enumerate(ROWS)], SCHEMA + ", digest int, keep_id string")
    index = DigestIndex.at(spark, path, buckets=2)
    first = distinct_texts(df.filter("doc_id < 5"), index, "1").collect()
    second = distinct_texts(df.filter("doc_id >= 5 or doc_id is null"), index, "2").collect()
    texts = [form(r["text"]) for r in first + second]
    assert sorted(texts) == sorted({form(t) for _, t in ROWS})
    assert first[0].__fields__ == ["doc_id", "text", "digest", "keep_id"]


def test_empty_table(spark, path):
    rows = digests(spark.createDataFrame([], SCHEMA))
    index = DigestIndex.at(spark, path)
    index.add(rows, "1")
    assert index.entries().count() == 0 and index.resolve(rows).collect() == []


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    want = [(*r[:4], r[4].hex()) for r in brute(rows)]
    assert found(op13_exact(spark, folder)) == sorted(want, key=str)
