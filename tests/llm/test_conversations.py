"""Conversation repair against a forward search that carries whole edit strings."""

import hashlib
import itertools
import random
import zlib

import pytest

from slopeworks.llm import conversations
from slopeworks.llm.conversations import END, WHITE, backward, closing, repair, trace
from slopeworks.llm.queries import op11_conversations

SCHEMA = "conv_id long, turn long, role string, text string"
GOES = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}


def cheapest(rows):
    """Least (cost, initials, lines) over all edits; ``rows``: (role, text, fault)."""
    names = {"u": "user", "a": "assistant"}
    best = {0: (0, "", ())}

    def offer(into, state, cost, edits, lines):
        if state not in into or (cost, edits) < into[state][:2]:
            into[state] = (cost, edits, lines)

    def inserted(states):
        out = dict(states)
        for _ in range(4):
            for state, (cost, edits, lines) in list(out.items()):
                for letter, to in GOES[state].items():
                    if letter in names:
                        offer(out, to, cost + 3, edits + "I", (*lines, names[letter] + ":"))
        return out

    for role, text, fault in rows:
        after = {}
        for state, (cost, edits, lines) in inserted(best).items():
            offer(after, state, cost + 4, edits + "D", lines)
            if fault in ("blank", "duplicate"):
                continue
            more = 3 if fault == "truncated" else 0
            for letter, to in GOES[state].items():
                if role[:1] == letter:
                    offer(after, to, cost + more, edits + "K", (*lines, f"{role}:{text}"))
                if letter in names:
                    offer(after, to, cost + 3 + more, edits + "R", (*lines, f"{names[letter]}:{text}"))
        best = after
    return min(found for state, found in inserted(best).items() if state in (0, 3))


def brute(rows):
    """The contract for one conversation's rows (turn, role, text)."""
    rows = [(turn, " " if role is None else role, " " if text is None else text) for turn, role, text in rows]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
    seen, marked = set(), []
    for _, role, text in rows:
        plain = text.rstrip(WHITE)
        fault = "blank" if not plain else "duplicate" if (role, text) in seen else "" if plain[-1] in ".!?" else "truncated"
        seen.add((role, text))
        marked.append((role, text, fault))
    turns = [turn for turn, _, _ in rows if turn is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    pairs = [a[0][:1] + b[0][:1] for a, b in itertools.pairwise(marked)]
    cost, audit, lines = cheapest(marked)
    counts = [sum(f == fault for *_, f in marked) for fault in ("blank", "duplicate", "truncated")]
    illegal = sum(pair not in ("su", "ua", "au") for pair in pairs)
    return (gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def made(seed, conversations_, longest):
    rng, rows = random.Random(seed), []
    for conv in [None, *range(conversations_)]:
        for turn in range(rng.randint(1, longest)):
            turn = rng.choice([turn, turn, turn, turn, None, turn + 1])
            text = rng.choice(["Yes.", "No", "Why?  ", " \t", "", None, "é!", f"{turn} words.", f"{rng.random()}"])
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "Digest", "ultra"])
            rows.append((conv, turn, role, text))
            if rng.random() < 0.1:
                rows.append(rows[-1])
    rng.shuffle(rows)
    return rows


def answers(df):
    return {row[0]: tuple(row[1:]) for row in repair(df).collect()}


def wanted(rows):
    by_conv = {}
    for conv, *row in rows:
        by_conv.setdefault(conv, []).append(row)
    return {conv: brute(of) for conv, of in by_conv.items()}


@pytest.mark.parametrize(("chunk", "longest"), [(4096, 9), (3, 40), (1, 12)])
def test_same_as_brute_force(spark, monkeypatch, chunk, longest):
    monkeypatch.setattr(conversations, "CHUNK_ROWS", chunk)
    rows = made(chunk, 25, longest)
    assert answers(spark.createDataFrame(rows, SCHEMA)) == wanted(rows)


def test_one_long_conversation_in_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(conversations, "CHUNK_ROWS", 16)
    rows = [(7, turn, ["user", "assistant"][turn % 2] if turn % 11 else "assistant", f"Line {turn % 90}.") for turn in range(400)]
    rows += [(7, 400 + k, "user", "") for k in range(60)] + [(8, None, "user", "Same.")] * 50
    assert answers(spark.createDataFrame(rows, SCHEMA).repartition(6)) == wanted(rows)


def test_edits_of_short_conversations_are_the_least_of_all():
    kinds = ["D", "s", "u", "a", "u!", "a!", "-"]
    fault = {"D": "blank", "!": "truncated"}
    for size in range(4):
        for chosen in itertools.product(kinds, repeat=size):
            edits, _, state = trace(list(chosen), backward(list(chosen), END), 0)
            done = [*edits, *closing(state)]
            rows = [(k[0], str(n), fault.get(k[-1], "")) for n, k in enumerate(chosen)]
            assert (sum(c for c, _, _ in done), "".join(e for _, e, _ in done)) == cheapest(rows)[:2]


def test_empty_table_and_other_columns(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert repair(empty).collect() == []
    rows = [(1, 0, "user", "Hi."), (1, 1, "assistant", "Hi!")]
    more = spark.createDataFrame([(*row, 5, "x") for row in rows], SCHEMA + ", place int, kinds string")
    assert answers(more) == wanted(rows)


def test_query_on_given_table(spark):
    folder = "/root/testdata/sf0.01"
    original = [tuple(row) for row in spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    damaged = []
    for conv, turn, role, text in original:
        way = zlib.crc32(f"{conv}:{turn}".encode()) % 20
        text = "" if way == 1 else "".join(c for c in text if c not in ".!?") if way == 2 else text
        row = (conv, turn, "user" if way == 4 else role, text)
        damaged += [] if way == 0 else [row, row] if way == 3 else [row]
    want = {conv: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for conv, *_ in original} | wanted(damaged)
    assert {row[0]: tuple(row[1:]) for row in op11_conversations(spark, folder).collect()} == want
