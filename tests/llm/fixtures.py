"""Small messy tables, and brute-force answers."""

from __future__ import annotations

import hashlib
import re

WORDS = "the of and quick brown fox jumps over lazy dog while rain falls on old stone walls near a river bank".split()
CLASH = ["cast(null as string) as id", "'x' as words", "1 as times", "'y' as spans", "'z' as score", "2 as fingerprint"]


def sentence(start: int, count: int) -> str:
    return " ".join(WORDS[(start * 7 + k * (start % 5 + 1)) % len(WORDS)] + str((start + k) % 3) for k in range(count))


def texts() -> list[tuple[int, str | None]]:
    rows: list[tuple[int, str | None]] = [(k, sentence(k, 20 + k % 30)) for k in range(40)]
    rows += [(100, None), (101, ""), (102, "   \n\t "), (103, "one"), (104, "Été à la plage, 東京 １２ ½ 🙂"), (105, "!!! ??? ...")]
    rows += [(106, sentence(3, 23)), (107, sentence(3, 23)), (107, sentence(3, 23))]  # copies, and a repeated row
    rows += [(108, " ".join(sentence(k, 50) for k in range(400)))]  # very long
    rows += [(109, "x" * 5000), (110, "a\x00b ▁ c  d　e f"), (111, "it's we'll <|endoftext|> 'tis ''s")]
    return rows


def documents(spark, rows=None):
    rows = texts() if rows is None else rows
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return frame.selectExpr("*", "'en' as lang", "'s' as source", "cast(length(text) as long) as n_chars", *CLASH)


def no_documents(spark):
    return documents(spark, [])


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def by_id(df, id_column="doc_id"):
    return sorted((tuple(row) for row in df.collect()), key=lambda row: (row[0] is not None, row))


def ascii_lower(text: str) -> str:
    return re.sub("[A-Z]", lambda m: m.group().lower(), text)
