"""Conversation repair against a search over all edits."""

from __future__ import annotations

import hashlib
import heapq
import random

import pytest
from pyspark.sql import functions as F

from lociframe.llm import conversation_repair as cr

WHITE = " \t\n\v\f\r"


def searched(rows):
    """(cost, audit, lines) of the least of the cheapest edits of (role, fault, text) rows, by a best-first search."""
    due = ("user", "user", "assistant", "user")
    kept = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    todo, seen = [(0, "", 0, 0, ())], set()
    while todo:
        cost, audit, i, state, lines = heapq.heappop(todo)
        if (i, state) in seen:
            continue
        seen.add((i, state))
        if i == len(rows) and state in (0, 3):
            return cost, audit, list(lines)
        after = 3 if due[state] == "assistant" else 2
        heapq.heappush(todo, (cost + 2, audit + "I", i, after, (*lines, due[state] + ":")))
        if i < len(rows):
            role, fault, text = rows[i]
            heapq.heappush(todo, (cost + 3, audit + "D", i + 1, state, lines))
            if fault not in ("blank", "duplicate"):
                extra = fault == "truncated"
                heapq.heappush(todo, (cost + 2 + extra, audit + "R", i + 1, after, (*lines, f"{due[state]}:{text}")))
                if (state, role[:1]) in kept:
                    heapq.heappush(todo, (cost + extra, audit + "K", i + 1, kept[state, role[:1]], (*lines, f"{role}:{text}")))
    raise AssertionError


def brute(turns):
    """The report and lines of one conversation's (turn, role, text)."""
    filled = [(t, " " if r is None else r, " " if x is None else x) for t, r, x in turns]
    filled.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, rows = set(), []
    for _, role, text in filled:
        last = text.rstrip(WHITE)[-1:]
        fault = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else ""
        seen.add((role, text))
        rows.append((role, fault, text))
    numbers = [t for t, _, _ in filled if t is not None]
    gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))
    cost, audit, lines = searched(rows)
    return (gaps, *(sum(f == k for _, f, _ in rows) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit), "\n".join(lines)


def conversation(rng, n):
    roles = ["user", "assistant", "system", "tool", None, "", "umpire"]
    texts = ["Yes.", "No!", "cut off", "", " \t", None, "Why?\n ", "more, ", "long " * 400 + "end."]
    weights = [8, 8, 2, 1, 1, 1, 1]
    return [(rng.choice([None, *range(9)]), rng.choices(roles, weights)[0], rng.choice(texts) if rng.random() < 0.6 else f"Text {rng.random()}.") for _ in range(n)]


@pytest.mark.parametrize("block_bits", [1, 13])
def test_against_search(spark, block_bits):
    rng = random.Random(5)
    talks = {i: conversation(rng, n) for i, n in enumerate([1, 2, 3, 5, 8, 13, 40] * 8)} | {None: conversation(rng, 30)}
    rows = [(k, *t) for k, v in talks.items() for t in v]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"block": F.lit(1), "at": F.lit("x"), "audit": F.lit(2)})
    report, edits = cr.repair_conversations(df.repartition(5), block_bits=block_bits)
    digests = {r["conv_id"]: r["sha256"] for r in cr.line_digests(edits).collect()}
    found = {r["conv_id"]: r for r in report.collect()}
    assert set(found) == set(talks)
    for k, v in talks.items():
        counts, lines = brute(v)
        assert tuple(found[k])[1:] == counts, (k, v)
        assert digests.get(k, hashlib.sha256(b"").hexdigest()) == hashlib.sha256(lines.encode()).hexdigest()


def test_crossings_of_blocks():
    """Blocks as steps name the same states as all turns at once."""
    rng = random.Random(1)
    for _ in range(200):
        turns = [(rng.choice(["s", "u", "a", ""]), rng.choice([0, 0, 1, 2, 3])) for _ in range(rng.randrange(1, 30))]
        ends = [2 * len(e) for e in cr.END]
        states = cr.crossings([cr.STEPS[t][0] for t in turns], 0, ends)
        cuts = sorted({0, len(turns), *(rng.randrange(len(turns) + 1) for _ in range(4))})
        blocks = [cr.folded(turns[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
        assert cr.crossings(blocks, 0, ends) == [states[b - 1] for b in cuts[1:]]


def test_empty(spark):
    report, edits = cr.repair_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert report.count() == 0
    assert cr.line_digests(edits).count() == 0


def test_damage(spark):
    import zlib

    rows = [(c, t, "assistant", "One. Two?") for c in range(8) for t in [*range(12), None]] + [(None, 3, None, None)]
    found = cr.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    expected = []
    for c, t, role, text in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        row = (c, t, "user" if k == 4 else role or " ", "" if k == 1 else "One Two" if k == 2 and text else text or " ")
        expected += [row] * (0 if k == 0 else 2 if k == 3 else 1)
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, expected))
