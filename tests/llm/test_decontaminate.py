from __future__ import annotations

import re

from slopeworks.llm import decontaminate
from slopeworks.llm.decontaminate import clean, contamination
from tests.llm.fixtures import ascii_lower, documents, no_documents, sentence, texts

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ITEMS = [
    (1, sentence(5, 25)), (2, "Totally unrelated words that no document has, ever and ever again, really."), (3, "東京"),
    (4, None), (5, "... !!!"), (6, sentence(3, 6)), (7, sentence(5, 12)), (7, sentence(5, 12)), (9, sentence(9, 10).upper()),
]


def words(text):
    return WORD.findall(ascii_lower(text or ""))


def brute_force(rows, items, window=10):
    out = []
    for doc_id, text in rows:
        own, hit, found = words(text), set(), set()
        for item, passage in items:
            theirs = words(passage)
            size = min(window, len(theirs))
            for at in range(len(theirs) - size + 1) if size else ():
                for k in range(len(own) - size + 1):
                    if own[k : k + size] == theirs[at : at + size]:
                        hit.update(range(k, k + size))
                        found.add(str(item))
        out.append((doc_id, len(own), len(hit), sorted(found)))
    return sorted(out, key=str)


def rows_with_passages():
    rows = [row for row in texts() if row[0] != 108]
    rows += [(200, "before, " + sentence(5, 25) + " after"), (201, sentence(5, 9) + " x " + sentence(5, 25)[40:])]
    rows += [(202, f"see 東京. {sentence(3, 6)}; {sentence(3, 6)}"), (203, sentence(9, 10).title()), (204, sentence(9, 9))]
    return rows


def test_against_brute_force(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string").selectExpr("*", "1 as n", "2 as window")
    rows = rows_with_passages()
    found = contamination(documents(spark, rows), items).collect()
    expected = brute_force(rows, ITEMS)
    assert sorted(((r.doc_id, r.n_words, r.n_hit, list(r["items"])) for r in found), key=str) == expected
    assert sum(row[2] > 0 for row in expected) > 5


def test_clean_keeps_columns_and_clean_rows(spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = rows_with_passages()
    docs = documents(spark, rows)
    kept = clean(docs, items)
    assert kept.columns == docs.columns
    bad = {row[0] for row in brute_force(rows, ITEMS) if row[2]}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, _ in rows if i not in bad)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    found = contamination(documents(spark), none).collect()
    assert len(found) == len(texts()) and all(r.n_hit == 0 and r["items"] == [] for r in found)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert contamination(no_documents(spark), items).count() == 0


def test_clean_rows_stay_whatever_rows_share_their_id(spark):
    passage = sentence(11, 30)
    rows = [(None, f"x {passage} y"), (None, sentence(2, 40)), (7, passage), (7, sentence(3, 40)), (8, sentence(4, 40))]
    items = spark.createDataFrame([(1, passage)], "item_id long, text string")
    found = sorted(((r.doc_id, r.text) for r in clean(documents(spark, rows), items).collect()), key=str)
    assert found == sorted([rows[1], rows[3], rows[4]], key=str)


def test_a_long_run_and_a_frequent_one(spark):
    """A run carries few words a place however long it is; a run of most documents is dealt to many tasks."""
    long = " ".join(f"w{k}" for k in range(6000))
    rows = [(k, sentence(5, 25)) for k in range(60)] + [(100, long), (101, "x " + long + " y"), (102, "clear")]
    items = spark.createDataFrame([("a", long), ("b", sentence(5, 25))], "item_id string, text string")
    found = {r.doc_id: (r.n_words, r.n_hit, r["items"]) for r in contamination(documents(spark, rows), items).collect()}
    assert found[100] == (6000, 6000, ["a"]) and found[101] == (6002, 6000, ["a"]) and found[102] == (1, 0, [])
    assert {found[k] == (len(words(rows[k][1])),) * 2 + (["b"],) for k in range(60)} == {True}
    texts = spark.createDataFrame([(1, 5, long, 1)], "run long, size int, words string, times long")
    places = decontaminate._run_grams(texts, 10).collect()
    assert len(places) == 5996 and max(len(r.around.split()) for r in places) == 15
    assert all(r.around.split()[r.before : r.before + 5] == r.gram.split() for r in places)
