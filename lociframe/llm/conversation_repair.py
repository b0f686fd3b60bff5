"""Cheapest repair of a conversation's turn order, by Hirschberg's divide and conquer.

A repaired conversation's roles follow ``(system? (user assistant)+)?``, four states: nothing yet, after system, after
user, after assistant. A turn is kept (0), gets the role that is due (2) or is deleted (3); empty turns are inserted (2).
Blank turns and repeated ones must go; a truncated one that stays costs 1. Of the cheapest edits, those whose initials
(D, I, K, R) are least in ASCII order are taken.

Method: inserted turns count to the turn behind them, so edits of equally many turns are never one a prefix of the
other, and at a cut the four states' least edits have a strict order. A stretch is cut in the middle: a forward vector
(cost and order of each state) meets a backward vector (cost), the least sum and then the least order name the state at
the cut, and both halves follow in the same way. Only vectors and the states at the cuts are held.

On Spark: turns are sorted by range, so that a conversation of any size lies over many tasks. Blocks of at most
``BLOCK`` turns of a conversation are first folded into what they cost between any two states; the same routine finds
the states at the blocks' ends, with blocks as its steps, and then each block is repaired on its own. Texts never pass
through Python here.

Defined results: null roles and texts count as one space; a null id is a conversation of its own; null turns come first;
turns of equal number are ordered by role and text; a role is judged by its first letter; a repeated row is a duplicate;
long texts are taken whole; an empty table gives empty tables; only the named columns are read, whatever else there is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from lociframe.llm.shared import materialize, named

BLOCK_BITS = 13
NONE = 1 << 50
FAULTS = ("", "truncated", "blank", "duplicate")
# What the role due in each state is, and the state after it.
DUE = (("user", 2), ("user", 2), ("assistant", 3), ("user", 2))
KEEP = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
END = ("", "II", "I", "")
EDITS = sorted("I" * n + e for n in range(3) for e in "DKR")

# A value is cost * 64 + order of the prefix (0 to 3) * 16 + order of what is appended (0 to 15).
Step = list[list[int]]


def _step(initial: str, fault: int) -> tuple[Step, dict[tuple[int, int], str]]:
    """The values and edits between any two states for a turn."""
    values, edits = [[NONE] * 4 for _ in range(4)], {}
    for before in range(4):
        state = before
        for n in range(3):
            ways = [("D", 3, state)]
            if fault < 2:
                ways.append(("R", 2 + fault, DUE[state][1]))
                if (state, initial) in KEEP:
                    ways.append(("K", fault, KEEP[state, initial]))
            for edit, cost, after in ways:
                value = (2 * n + cost) * 64 + EDITS.index("I" * n + edit)
                if value < values[before][after]:
                    values[before][after], edits[before, after] = value, "I" * n + edit
            state = DUE[state][1]
    return values, edits


STEPS = {(i, f): _step(i, f) for i in ("s", "u", "a", "") for f in range(4)}


def forward(entry: Sequence[int], steps: Sequence[Step]) -> list[int]:
    """Cost and order of each state after ``steps``, from such a vector before them."""
    a, b, c, d = entry
    for p, q, r, s in steps:
        best = [min(a + p[y], b + q[y], c + r[y], d + s[y]) for y in range(4)]
        order = sorted(range(4), key=lambda y: best[y] & 63 if best[y] < NONE else 64)
        for rank, y in enumerate(order):
            best[y] = (min(best[y], NONE) >> 6 << 6) + (rank << 4)
        a, b, c, d = best
    return [a, b, c, d]


def backward(exits: Sequence[int], steps: Sequence[Step]) -> list[int]:
    """Cost from each state before ``steps`` to the end, from such a vector behind them."""
    a, b, c, d = exits
    for step in reversed(steps):
        a, b, c, d = (min((m[0] >> 6) + a, (m[1] >> 6) + b, (m[2] >> 6) + c, (m[3] >> 6) + d) for m in step)
    return [a, b, c, d]


def only(state: int) -> list[int]:
    return [0 if s == state else NONE for s in range(4)]


def crossings(steps: Sequence[Step], entry: int, exits: Sequence[int]) -> list[int]:
    """The state after each step on the least of the cheapest ways from ``entry``, with the cost of ending in each state."""
    out = [0] * len(steps)
    todo = [(0, len(steps), entry, list(exits))]
    while todo:
        low, high, state, ends = todo.pop()
        if low == high:
            continue
        middle = (low + high + 1) // 2
        reach, rest = forward(only(state), steps[low:middle]), backward(ends, steps[middle:high])
        at = out[middle - 1] = min(range(4), key=lambda s: ((reach[s] >> 6) + rest[s], reach[s] & 63))
        todo.append((low, middle - 1, state, [steps[middle - 1][s][at] >> 6 for s in range(4)]))
        todo.append((middle, high, at, ends))
    return out


def repair(turns: Sequence[tuple[str, int]], entry: int, at_end: int) -> list[str]:
    """The edits of each turn (initial, fault) with what is inserted before it, between two states."""
    kinds = [STEPS[t] for t in turns]
    states = [entry, *crossings([k[0] for k in kinds], entry, only(at_end))]
    return [k[1][pair] for k, pair in zip(kinds, zip(states, states[1:], strict=False), strict=True)]


def folded(turns: Sequence[tuple[str, int]]) -> Step:
    """A block of turns as one step."""
    steps = [STEPS[t][0] for t in turns]
    return [[min(v >> 6 << 6, NONE) + (v >> 4 & 3) for v in forward(only(s), steps)] for s in range(4)]


def _by_group(df: DataFrame, keys: list[str], order: list[str], each: Callable[[tuple, list[tuple]], list[tuple]], schema: T.StructType) -> DataFrame:
    """``each(key, rows)`` for the rows of a key, in order; a key's rows lie together and are held together."""
    columns = [*keys, *order, *(c for c in df.columns if c not in (*keys, *order))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)

        def batch(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)], schema=arrow)

        rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in columns), strict=True))
        out: list[tuple] = []
        for key, group in groupby(rows, key=lambda r: r[: len(keys)]):
            out += each(key, [r[len(keys) :] for r in group])
            if len(out) >= 4096:
                yield batch(out)
                out = []
        if out:
            yield batch(out)

    return df.select(*columns).repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


def _fold_block(key: tuple, rows: list[tuple]) -> list[tuple]:
    conv, block = key
    initials, turns = [r[1] for r in rows], [r[3] for r in rows if r[3] is not None]
    pairs = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
    counts = [sum(r[2] == f for r in rows) for f in (2, 3, 1)]
    values = [v for line in folded([_kind(r) for r in rows]) for v in line]
    ends = (turns[0], turns[-1]) if turns else (None, None)
    return [(conv, block, *counts, pairs, *ends, len(set(turns)), initials[0], initials[-1], values)]


def _kind(row: tuple) -> tuple[str, int]:
    return (row[1] if row[1] in ("s", "u", "a") else "", row[2])


def _cross(key: tuple, rows: list[tuple]) -> list[tuple]:
    """The states at the ends of a conversation's blocks, and its counts beside the first."""
    steps = [[r[10][4 * s : 4 * s + 4] for s in range(4)] for r in rows]
    ends = [2 * len(e) for e in END]
    states = [0, *crossings(steps, 0, ends)]
    cost = min(a + b for a, b in zip((v >> 6 for v in forward(only(0), steps)), ends, strict=True))
    blank, duplicate, truncated, illegal = (sum(r[i] for r in rows) for i in range(1, 5))
    distinct, first, last = 0, None, None
    for i, r in enumerate(rows):
        illegal += bool(i) and rows[i - 1][9] + r[8] not in ("su", "ua", "au")
        if r[5] is not None:
            distinct += r[7] - (last is not None and last == r[5])
            first, last = r[5] if first is None else first, r[6]
    gaps = 0 if first is None else last - first + 1 - distinct
    counts = (gaps, blank, duplicate, truncated, illegal, cost)
    return [(*key, r[0], states[i], states[i + 1], i + 1 == len(rows), *(counts if i == 0 else [None] * 6)) for i, r in enumerate(rows)]


def _edit_block(key: tuple, rows: list[tuple]) -> list[tuple]:
    state, at_end, last = rows[0][3:6]
    edits = repair([_kind(r) for r in rows], state, at_end)
    if last:
        edits[-1] += END[at_end]
    out = []
    for r, text in zip(rows, edits, strict=True):
        made = []
        for e in text:
            if e == "D":
                made.append((e, None))
            elif e == "K":
                made.append((e, None))
                state = KEEP[state, r[1]]
            else:
                role, state = DUE[state]
                made.append((e, role))
        out.append((*key, r[0], text, [{"edit": e, "role": role} for e, role in made]))
    return out


def _long(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.LongType()) for n in names]


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def repair_conversations(turns: DataFrame, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block_bits: int = BLOCK_BITS) -> tuple[DataFrame, DataFrame]:
    """``(conversations, edits)``.

    conversations: the id, ``gaps, blank, duplicate, truncated, illegal, cost`` and ``audit``, the edits' initials.
    edits: the id, ``at, sub`` (their order), ``edit``, and ``role`` and ``text`` of the turn as repaired (of a deleted one, as it was).
    """
    filled = lambda c: F.coalesce(named(c).cast("string"), F.lit(" "))
    given = turns.select(named(id).alias("conv"), named(turn).cast("long").alias("turn"), filled(role).alias("role"), filled(text).alias("text"))
    dealt = given.repartitionByRange("conv", "turn", "role", F.substring("text", 1, 32)).sortWithinPartitions("conv", "turn", "role", "text")
    hashes = {"h1": F.xxhash64("role", "text"), "h2": F.xxhash64(F.lit(1), "text", "role")}
    ordered = materialize(dealt.withColumn("at", F.monotonically_increasing_id()), "repair-turns").withColumns(hashes)
    first = ordered.groupBy("conv", "h1", "h2").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = materialize(first.select(F.col("conv").alias("_c"), F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), "first"), "repair-firsts")
    known = F.col("conv").eqNullSafe(F.col("_c")) & (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2"))
    word = F.regexp_extract("text", "([^\\x20\\x09-\\x0D])[\\x20\\x09-\\x0D]*\\z", 1)
    judged = ordered.select("conv", "turn", "at", F.substring("role", 1, 1).alias("initial"), word.alias("last"), "h1", "h2").join(first, known, "left")
    fault = F.when(F.col("last") == "", 2).when(F.col("at") > F.col("first"), 3).when(~F.col("last").isin(".", "!", "?"), 1).otherwise(0)
    rows = materialize(judged.select("conv", F.shiftright("at", block_bits).alias("block"), "at", "initial", fault.alias("fault"), "turn"), "repair-rows")

    conv = T.StructField("conv", turns.schema[id].dataType)
    blocks = T.StructType(
        [conv, *_long("block", "blank", "duplicate", "truncated", "illegal", "first_turn", "last_turn", "distinct"), T.StructField("first_initial", T.StringType()), T.StructField("last_initial", T.StringType()), T.StructField("step", T.ArrayType(T.LongType()))]
    )
    steps = _by_group(rows, ["conv", "block"], ["at"], _fold_block, blocks)
    ends = T.StructType([conv, *_long("block", "state", "at_end"), T.StructField("last", T.BooleanType()), *_long(*COUNTS)])
    crossed = materialize(_by_group(steps, ["conv"], ["block"], _cross, ends), "repair-crossings")

    c = crossed.select(F.col("conv").alias("_c"), F.col("block").alias("_b"), "state", "at_end", F.col("last").alias("is_last"))
    met = rows.join(c, F.col("conv").eqNullSafe(F.col("_c")) & (F.col("block") == F.col("_b"))).drop("_c", "_b", "turn")
    made = T.ArrayType(T.StructType([T.StructField("edit", T.StringType()), T.StructField("role", T.StringType())]))
    edited = T.StructType([conv, *_long("block", "at"), T.StructField("audit", T.StringType()), T.StructField("made", made)])
    edits = materialize(_by_group(met, ["conv", "block"], ["at"], _edit_block, edited), "repair-edits")

    pieces = edits.groupBy("conv", "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "audit"))), lambda x: x["audit"]), "").alias("piece"))
    audits = pieces.groupBy("conv").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "piece"))), lambda x: x["piece"]), "").alias("audit"))
    a = audits.select(F.col("conv").alias("_c"), "audit")
    conversations = crossed.where(F.col("cost").isNotNull()).join(a, F.col("conv").eqNullSafe(F.col("_c"))).select(F.col("conv").alias(id), *COUNTS, "audit")

    e = edits.select(F.col("at").alias("_at"), "made")
    whole = ordered.select("conv", "at", F.col("role").alias("old"), "text").join(e, F.col("at") == F.col("_at"))
    each = whole.select("conv", "at", "old", "text", F.posexplode("made").alias("sub", "m"))
    return conversations, each.select(
        F.col("conv").alias(id), "at", "sub", F.col("m.edit").alias("edit"), F.coalesce("m.role", "old").alias("role"), F.when(F.col("m.edit") == "I", "").otherwise(F.col("text")).alias("text")
    )


def line_digests(edits: DataFrame, id: str = "conv_id") -> DataFrame:
    """The id and ``sha256`` of each conversation's repaired ``role:text`` lines, joined by a line feed; a conversation streams through."""
    lines = edits.where("edit <> 'D'").select(named(id).alias("conv"), "at", "sub", F.concat("role", F.lit(":"), "text").cast("binary").alias("line"))
    schema = T.StructType([lines.schema["conv"], T.StructField("sha256", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, conv, kind = None, None, None
        for b in batches:
            done, kind = [], b.schema.field("conv").type
            for key, line in zip(b.column("conv").to_pylist(), b.column("line").to_pylist(), strict=True):
                if state is None or key != conv:
                    if state is not None:
                        done.append((conv, state.hexdigest()))
                    state, conv = hashlib.sha256(line), key
                else:
                    state.update(b"\n")
                    state.update(line)
            yield _batch(done, kind)
        if state is not None:
            yield _batch([(conv, state.hexdigest())], kind)

    def _batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], kind), pa.array([r[1] for r in rows], pa.string())], ["conv", "sha256"])

    return lines.repartition("conv").sortWithinPartitions("conv", "at", "sub").select("conv", "line").mapInArrow(run, schema).withColumnRenamed("conv", id)


def damaged(turns: DataFrame) -> DataFrame:
    """Turns damaged by crc32 of ``conv_id:turn`` modulo 20: 0 drops, 1 empties, 2 takes ``.!?`` out, 3 repeats, 4 makes it the user's."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    case = F.crc32(F.concat_ws(":", text_of("conv_id"), text_of("turn")).cast("binary")) % 20
    given = turns.select("conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"), case.alias("case")).where("case <> 0")
    new: Column = F.when(F.col("case") == 1, "").when(F.col("case") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("case") == 3, 2).otherwise(1)))
    return given.select("conv_id", "turn", F.when(F.col("case") == 4, "user").otherwise(F.col("role")).alias("role"), new.alias("text"), copies.alias("_copy")).drop("_copy")
