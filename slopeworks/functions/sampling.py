"""Reproducible row sampling by key: no shuffle, independent of partitioning.

A row's key is hashed once into a word of 60 bits.  Each seed then places every row in [0, P) by an
affine map of the word's low 31 and high 29 bits modulo the prime P, and a sample of a share takes
the rows below share * P.  Seeds use unrelated maps, and drawing a batch costs two multiplications
per row instead of a hash.
"""

from __future__ import annotations

import hashlib
import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from slopeworks.config import BATCH_SEED_BASE, SPLIT_SEED

# 2^31 - 1: two products of numbers below it, and a third number, fit a signed 64-bit sum.
PRIME = 2**31 - 1
LOW_BITS = 31
# Hash word of a prepared table.
WORD = "h"


def row_key(*columns: str | Column) -> Column:
    """One string that identifies a row."""
    return F.concat_ws("-", *[(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns])


def key_word(key: Column) -> Column:
    """The first 60 bits of md5(key) as a number."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 15), 16, 10).cast("bigint")


def affine(seed: int) -> tuple[int, int, int]:
    """The map of a seed: two factors in [1, P) and a shift in [0, P)."""
    digits = hashlib.md5(str(seed).encode()).hexdigest()
    a, b, c = (int(digits[at : at + 8], 16) for at in (0, 8, 16))
    return a % (PRIME - 1) + 1, b % (PRIME - 1) + 1, c % PRIME


def rule(seed: int, share: float) -> tuple[int, int, int, int] | None:
    """The map of a seed and the limit of a share; None when every row is taken."""
    limit = math.ceil(share * PRIME)
    return None if limit >= PRIME else (*affine(seed), limit)


def place(word: Column, seed: int) -> Column:
    """Where a seed places a row in [0, P)."""
    a, b, c = (F.lit(x).cast("bigint") for x in affine(seed))
    low = word.bitwiseAND(F.lit(PRIME).cast("bigint"))
    return (low * a + F.shiftright(word, LOW_BITS) * b + c) % PRIME


def _below(word: Column, seed: int, share: float) -> Column:
    found = rule(seed, share)
    return F.lit(True) if found is None else place(word, seed) < found[-1]


def in_batch(word: Column, iteration: int, fraction: float) -> Column:
    """Whether a row belongs to the mini-batch of a 1-based iteration."""
    return _below(word, BATCH_SEED_BASE + iteration, fraction)


def in_validation(word: Column, split: float) -> Column:
    """Whether a row is set aside for validation."""
    return ~_below(word, SPLIT_SEED, 1.0 - split)
