from __future__ import annotations

import re

import pytest
import xxhash

from slopeworks.llm.graph import components, join_spread
from slopeworks.llm.simhash import fingerprint, links, near_copies, one_of_each
from tests.llm.fixtures import ascii_lower, documents, no_documents, sentence, texts


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(text or ""))
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def rows_with_copies():
    base = sentence(11, 60)
    rows = [*texts(), *[(300 + k, base.replace(WORD, WORD + "s" * k)) for k in range(6)]]
    return rows + [(400, base.upper()), (401, base + "  "), (None, base)]


WORD = sentence(11, 60).split()[30]


def brute_force(rows):
    prints = [(doc_id, plain_fingerprint(text)) for doc_id, text in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= 2 and group[a] != group[b]:
                group = [group[b] if g == group[a] else g for g in group]
    out = []
    for (doc_id, own), g in zip(prints, group, strict=True):
        out.append((doc_id, own, min((i for (i, _), h in zip(prints, group, strict=True) if h == g and i is not None))))
    return out


@pytest.mark.parametrize("text", [t or "" for _, t in texts()])
def test_fingerprint(text):
    assert fingerprint(text) == plain_fingerprint(text)


def test_near_copies(spark):
    rows = rows_with_copies()
    found = [(r.doc_id, r.fingerprint % (1 << 64), r.component_id) for r in near_copies(documents(spark, rows)).collect()]
    assert sorted(found, key=str) == sorted(brute_force(rows), key=str)
    assert near_copies(no_documents(spark)).count() == 0


def test_links_cross_the_sign_bit_and_stop_at_two_bits(spark):
    values = [0, 1, 3, 7, -1 << 63, (-1 << 63) | 1, -1, 0x0F0F]
    frame = spark.createDataFrame([(v,) for v in values], "fingerprint long")
    found = components(links(frame), "a", "b")
    roots = {v: v for v in values} | {r.node: r.root for r in found.collect()}
    assert len({roots[v] for v in (0, 1, 3, 7, -1 << 63, (-1 << 63) | 1)}) == 1
    assert roots[-1] == -1 and roots[0x0F0F] == 0x0F0F


def test_one_of_each(spark):
    rows = rows_with_copies()
    docs = documents(spark, rows)
    kept = one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({c for _, _, c in brute_force(rows)})


def test_one_of_each_component_without_or_with_repeated_ids(spark):
    copied = sentence(11, 60)
    rows = [(None, sentence(k, 40)) for k in (2, 3, 4)] + [(5, sentence(6, 40)), (5, sentence(7, 40)), (9, copied), (None, copied)]
    rows += [(None, sentence(2, 40)), (5, sentence(6, 40)), (5, sentence(6, 40))]
    found = sorted(((r.doc_id, r.text) for r in one_of_each(documents(spark, rows)).collect()), key=str)
    assert found == sorted(rows[:6], key=str)


def test_components_of_a_chain_a_star_and_a_ring(spark):
    chain = [(k, k + 1) for k in range(50)]
    star = [(1000 + k, 100) for k in range(40)]
    ring = [(200 + k, 200 + (k + 1) % 9) for k in range(9)]
    edges = spark.createDataFrame([*chain, *star, *ring, (5, 5)], "a long, b long")
    found = {r.node: r.root for r in components(edges, "a", "b").collect()}
    expected = {k: 0 for k in range(51)} | {1000 + k: 100 for k in range(40)} | {100: 100} | {200 + k: 200 for k in range(9)}
    assert found == expected


def test_join_spread_handles_hot_keys(spark):
    left = spark.range(5000).selectExpr("id", "case when id % 3 = 0 then 7 else id end as key")
    right = left.groupBy("key").count().withColumnRenamed("count", "times").selectExpr("key", "times", "key * 2 as value")
    found = join_spread(left, right, "key", "times", 5000)
    assert found.count() == 5000 and found.filter("value <> key * 2").count() == 0
