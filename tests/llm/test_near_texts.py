from __future__ import annotations

import random
import re
from itertools import combinations

import pyarrow as pa
import pytest

from slopeworks.llm.near_texts import layout, long_fingerprint, near_texts, shingle_sets
from slopeworks.llm.simhash import one_of_each
from tests.llm.fixtures import ascii_lower, documents, no_documents, sentence, texts

SF = "/root/testdata/sf0.01"


def shingles(text, size=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(text or ""))
    return {tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))} if words else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def grouped(rows):
    """The place of each row's component, by comparing all pairs."""
    sets, group = [shingles(text) for _, text in rows], list(range(len(rows)))
    for a, b in combinations(range(len(rows)), 2):
        if group[a] != group[b] and similarity(sets[a], sets[b]) >= 0.8:
            old, new = group[b], group[a]
            group = [new if g == old else g for g in group]
    return group


def with_words(base, places):
    words = base.split()
    for k in places:
        words[k] = f"other{k}"
    return " ".join(words)


def messy():
    rng = random.Random(5)
    base = " ".join(f"w{rng.randrange(400)}" for _ in range(300))
    rows = [*texts(), (None, None), (None, "no id at all")]
    rows += [(500 + k, with_words(base, [3 * k + 7])) for k in range(30)]  # a group of near copies
    rows += [(600, base.upper()), (601, "\n" + base.replace(" ", "\t ")), (None, base), (602, base), (602, base)]
    rows += [(700, with_words(base, range(0, 300, 20))), (701, with_words(base, range(5, 300, 10)))]  # too far away
    return rows


def test_shingle_sets():
    rows = [text for _, text in texts()]
    found = [len(s) for s in shingle_sets(pa.array(rows), 5)]
    assert found == [len(shingles(text)) for text in rows]


def test_fingerprint_of_many_shingles_counts_every_bit():
    import numpy as np

    from slopeworks.llm.blocks import mixed
    from slopeworks.llm.near_texts import _SALTS

    hashes = mixed(np.arange(1, 1000, dtype=np.uint64))
    words = [[int(w) for w in row] for row in mixed(hashes[:, None] + _SALTS[None, :])]
    expected = [sum(1 << b for b in range(64) if 2 * sum(row[k] >> b & 1 for row in words) > len(words)) for k in range(16)]
    assert [int(w) for w in long_fingerprint(hashes)] == expected


def test_as_all_pairs(spark):
    rows = messy()
    group = grouped(rows)
    numbered = spark.createDataFrame([(k, text) for k, (_, text) in enumerate(rows)], "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in near_texts(numbered.repartition(3)).collect()}
    assert len(found) == len(rows)
    # Nothing unlike is linked; what is alike is met nearly always.
    assert all(group[k] == group[root] for k, root in found.items())
    pairs = [found[a] == found[b] for a, b in combinations(range(len(rows)), 2) if group[a] == group[b]]
    assert sum(pairs) >= 0.95 * len(pairs)
    assert len(set(found.values())) <= 1.05 * len(set(group))
    ids = near_texts(documents(spark, rows)).collect()
    assert sorted((r.doc_id for r in ids), key=str) == sorted((i for i, _ in rows), key=str)
    assert {r.component_id for r in ids if r.doc_id in (500, 515, 600, 601, 602)} == {500}
    kept = one_of_each(documents(spark, rows), grouping=near_texts)
    assert kept.columns == documents(spark, rows).columns
    assert kept.count() == len(set(found.values()))


def test_empty_table(spark):
    assert near_texts(no_documents(spark)).count() == 0
    assert one_of_each(no_documents(spark), grouping=near_texts).count() == 0


@pytest.mark.parametrize("share", [0.0, 0.01, 0.02])
def test_recall_on_changed_documents(spark, share):
    rng = random.Random(1)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    base = [(i, t) for i, t in sorted(docs) if 100 <= len((t or "").split()) <= 2000][:200]
    words = sorted({w for _, t in base for w in t.split()})
    changed = {}
    for i, t in base:
        own = t.split()
        for k in rng.sample(range(len(own)), max(1, round(share * len(own)))):
            own[k] = rng.choice(words)
        changed[10_000_000 + i] = " ".join(own)
    frame = spark.createDataFrame([*docs, *changed.items()], "doc_id long, text string").repartition(8)
    found = {r.doc_id: r.component_id for r in near_texts(frame).collect()}
    alike = [i for i, t in base if similarity(shingles(t), shingles(changed[10_000_000 + i])) >= 0.8]
    assert sum(found[i] == found[10_000_000 + i] for i in alike) >= 0.9 * len(alike) and len(alike) > 150


def test_layout_grows_slowly():
    sizes = [(width + 1) * blocks for width, blocks in map(layout, (10**5, 10**7, 10**9))]
    assert sizes[1] < 4 * sizes[0] and sizes[2] < 4 * sizes[1]
    for count in (0, 1, 10**5, 10**7, 10**10):
        width, blocks = layout(count)
        assert 2**width >= 2 * count * (width + 1) and blocks >= 1


def test_every_pair_at_a_variant_is_compared(spark, monkeypatch):
    """Two variants hold all classes: each is met by texts between which, by name, lie many unlike ones."""
    from slopeworks.llm import near_texts as module

    monkeypatch.setattr(module, "layout", lambda classes: (1, 1))
    monkeypatch.setattr(module, "_COMPARED", 100, raising=False)
    rng = random.Random(9)
    bases = [" ".join(f"w{rng.randrange(5000)}" for _ in range(200)) for _ in range(40)]
    rows = [(k, with_words(base, [])) for k, base in enumerate(bases)]
    rows += [(100 + k, with_words(base, [20, 150])) for k, base in enumerate(bases)]
    rows += [(200 + k, with_words(bases[0], [7 * k % 200])) for k in range(20)]
    group = grouped(rows)
    found = {r.doc_id: r.component_id for r in near_texts(documents(spark, rows)).collect()}
    assert found == {i: rows[g][0] for (i, _), g in zip(rows, group, strict=True)}


def test_texts_of_one_first_word_keep_their_own_links(spark, monkeypatch):
    """Texts whose fingerprints share their first word are not one class: each has its own partners."""
    from slopeworks.llm import near_texts as module

    rng = random.Random(3)
    first = " ".join(f"w{rng.randrange(5000)}" for _ in range(200)).split()
    other = " ".join(f"v{rng.randrange(5000)}" for _ in range(210)).split()
    rows = [(1, " ".join(first)), (2, " ".join(other)), (3, with_words(" ".join(other), [100]))]

    def same_word(shingles):
        bits = long_fingerprint(shingles)
        bits[0] = 5
        return bits

    monkeypatch.setattr(module, "long_fingerprint", same_word)
    monkeypatch.setattr(module, "layout", lambda classes: (1, 1))
    found = {r.doc_id: r.component_id for r in near_texts(documents(spark, rows)).collect()}
    assert found == {1: 1, 2: 2, 3: 2}


def counted_pairs(module, monkeypatch):
    """The numbers of pairs that are compared, filled as they are."""
    counts, told = [], module.told

    def counting(pairs, *args):
        counts.append(pairs.count())
        return told(pairs, *args)

    monkeypatch.setattr(module, "told", counting)
    return counts


def test_texts_that_share_a_passage_are_few_pairs(spark, monkeypatch):
    """Texts of one long passage and words of their own meet nearly never, and near copies among them are linked."""
    from slopeworks.llm import near_texts as module

    counts = counted_pairs(module, monkeypatch)
    rng = random.Random(4)
    passage = " ".join(f"p{rng.randrange(5000)}" for _ in range(120))
    rows = [(k, " ".join(f"w{rng.randrange(5000)}" for _ in range(40)) + " " + passage) for k in range(400)]
    rows += [(1000 + k, with_words(rows[k][1], [20])) for k in range(0, 400, 20)]
    found = {r.doc_id: r.component_id for r in near_texts(documents(spark, rows)).collect()}
    assert found == {i: i % 1000 for i, _ in rows}
    assert sum(counts) < 2000


def test_every_pair_alike_is_met(spark):
    """Pairs of just 0.8: some would be lost by meeting at random."""
    rng = random.Random(8)
    rows = []
    for k in range(300):
        own = [f"w{rng.randrange(100_000)}" for _ in range(4 + 45 + k % 3)]
        # One word replaced: five of 45 shingles in each.
        rows += [(k, " ".join(own)), (1000 + k, with_words(" ".join(own), [10 + k % 20]))]
    sets = {i: shingles(text) for i, text in rows}
    assert all(0.8 <= similarity(sets[k], sets[1000 + k]) < 0.82 for k in range(300))
    found = {r.doc_id: r.component_id for r in near_texts(documents(spark, rows)).collect()}
    assert found == {i: i % 1000 for i, _ in rows}


def test_short_texts_are_verified_on_their_shingles(spark):
    rng = random.Random(2)
    rows = []
    for k in range(100):
        own = [f"w{rng.randrange(100_000)}" for _ in range(9)]
        rows += [(k, " ".join(own)), (1000 + k, " ".join(own[:-1]))]  # five shingles, four of them
    found = {r.doc_id: r.component_id for r in near_texts(documents(spark, rows)).collect()}
    assert found == {i: i % 1000 for i, _ in rows}


def test_any_order_of_shingles_gives_the_same(spark, monkeypatch):
    from slopeworks.llm import near_texts as module

    rows = [(k, text) for k, (_, text) in enumerate(messy())]
    expected = sorted(map(tuple, near_texts(documents(spark, rows)).collect()))
    monkeypatch.setattr(module, "MAX_COMMON", 3)
    assert sorted(map(tuple, near_texts(documents(spark, rows)).collect())) == expected
