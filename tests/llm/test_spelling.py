"""Spelling variants against edit distances of all pairs."""

import random
import re
import zlib
from collections import Counter

import pytest

from slopeworks.llm import spelling
from slopeworks.llm.queries import op12_spelling
from slopeworks.llm.spelling import forms


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(counts):
    words = sorted(counts)
    near = {word: [v for v in words if abs(len(v) - len(word)) < 2 and distance(v, word) == 1] for word in words}
    form = {}
    for word in words:
        best = min(near[word], key=lambda v: (-counts[v], v), default=None)
        form[word] = best if best is not None and counts[best] >= 5 * counts[word] else None

    def root(word):
        while form[word] is not None:
            word = form[word]
        return word

    return sorted((w, form[w] or "", root(w), counts[w], len(near[w]), counts[form[w]] if form[w] else -1) for w in words)


def found(df):
    return sorted((r[0], r[1] or "", r[2], r[3], r[4], -1 if r[5] is None else r[5]) for r in df.collect())


def made():
    rng = random.Random(5)
    words = {"".join(rng.choice("abcdéñü") for _ in range(rng.randint(6, 8))) for _ in range(50)}
    for word in list(words):
        for _ in range(4):
            letters, k = list(word), rng.randrange(len(word))
            way = rng.randrange(3)
            letters[k : k + (way != 0)] = [rng.choice("abcxyz")] if way != 2 else []
            words.add("".join(letters))
    words |= {"a" * n for n in (46, 47, 48, 49, 50)} | {"b" * 60 + "c", "b" * 60 + "d", "b" * 61, "c" + "b" * 60, "😀bcdef", "bcdef", "😀bcdeg"}
    return {word: rng.choice([5, 6, 7, 31, 200, 1500, 9000]) for word in sorted(words)}


@pytest.mark.parametrize("room", [1 << 14, 12])
def test_same_as_all_pairs(spark, monkeypatch, room):
    monkeypatch.setattr(spelling, "NODE_WORDS", room)
    monkeypatch.setattr(spelling, "MAX_NODES", room)
    counts = made()
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert found(forms(df)) == brute(counts)


def test_many_words_of_one_vector_are_split(spark, monkeypatch):
    monkeypatch.setattr(spelling, "NODE_WORDS", 4)
    counts = {f"{'a' * k}b{'a' * (9 - k)}": 5 + 30 * (k % 3) for k in range(10)} | {"a" * 10: 900, "a" * 9: 5}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert found(forms(df)) == brute(counts)


def test_messy_rows(spark):
    rows = [("abcdef", 3, "x"), ("abcdef", 4, "y"), (None, 9, "x"), ("abcdeg", None, "x"), ("abcdeh", 100, "x"), ("", 2, "z"), ("q", 1, "z")]
    df = spark.createDataFrame(rows, "word string, n long, node string")
    assert found(forms(df)) == brute({"abcdef": 7, "abcdeh": 100, "": 2, "q": 1})
    assert forms(spark.createDataFrame([], "word string, n long")).collect() == []


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    counts = Counter()
    for row in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect():
        for run in re.findall("[A-Za-zÀ-ÿ]+", row["text"] or ""):
            word = run.translate(lower)
            hashed = zlib.crc32(f"{row['doc_id']}:{word}".encode())
            at = hashed % len(word)
            counts[word if hashed % 199 else word[:at] + word[at + 1 :]] += 1
    assert found(op12_spelling(spark, folder)) == brute({w: n for w, n in counts.items() if len(w) >= 6 and n >= 5})
