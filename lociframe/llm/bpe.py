"""Byte-level BPE encoding and decoding.

Spark's higher-order functions fold the ranked merges over the byte arrays of distinct words; the rank map is a
literal (a scalar subquery's value), bucketed since a lookup in a Spark map is a scan. Decoding concatenates the
tokens' bytes.

One stage without a shuffle: the JVM splits the text; an Arrow step numbers the words of a batch of documents
and passes each distinct one on once; the JVM folds the merges; an Arrow step puts the ids of each document
together. Frequent words come from a dictionary that is encoded first, by the same fold, from a bounded
sample of documents and broadcast; its bounds are ``warm_docs``, ``warm_chars``, ``warm_words`` and ``warm_bytes``. It only
saves work: any other word is folded where it occurs, so results don't depend on it.

Long texts and words: a word of over ``LONG`` bytes is first cut wherever no token of the vocabulary that occurs there
reaches over the place; no merge can cross it, so the pieces are encoded by themselves. A piece that is still long
is folded rank by rank, all pairs of the lowest rank in one step, so that it costs its length times the different
ranks in it. Both are exact for any vocabulary: where its ranks don't grow along the merges of its tokens
(``ranks_grow``), a step joins one pair. A piece of 64 MB or more without such a place raises an error.

Defined results: a null text counts as empty and has no tokens; rows are encoded one by one, repeated ones
too; an empty table gives an empty table; only the id column and the results are returned, so no other column can
clash with them.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lociframe.llm.shared import let, once, settle

BUCKETS = 65521  # a prime, so that keys of one left token spread
# An entry of a folded word holds, from the top, the rank of the pair that it begins, its place and its token.
TOKEN_BITS, PLACE_BITS = 18, 26
TOKEN, PLACE = (1 << TOKEN_BITS) - 1, ((1 << PLACE_BITS) - 1) << TOKEN_BITS
RANK_SHIFT = TOKEN_BITS + PLACE_BITS
NONE = 1 << TOKEN_BITS  # the rank of what is no pair
# The Unicode white space that \s means to the vocabulary's own library; \s of Java is ASCII only.
SPACE = "\\x09-\\x0D\\x20\\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000"


def java_pattern(pattern: str) -> str:
    """The splitting pattern with Unicode white space spelled out."""
    return pattern.replace("[^\\s", f"[^{SPACE}").replace("\\S", f"[^{SPACE}]").replace("\\s", f"[{SPACE}]")


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


def rank_map(spark: SparkSession, ranks: dict[bytes, int]) -> Column:
    """``array<map<pair, token>>`` by bucket, as a literal value: every pair of tokens whose bytes together are a token."""
    pairs = (x for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks for x in (ranks[t[:i]] * NONE + ranks[t[i:]], r))
    keys, values = np.fromiter(pairs, np.int64).reshape(-1, 2).T
    order = np.argsort(keys % BUCKETS, kind="stable")
    ends = np.searchsorted(keys[order] % BUCKETS, np.arange(BUCKETS + 1)).astype(np.int32)
    maps = pa.MapArray.from_arrays(pa.array(ends), pa.array(keys[order]), pa.array(values[order]))
    one = pa.table({"ranks": pa.ListArray.from_arrays(pa.array([0, BUCKETS], pa.int32()), maps)})
    return spark.createDataFrame(one).scalar()


def ranks_grow(ranks: dict[bytes, int]) -> bool:
    """Whether each token is what its bytes alone merge to, by pairs of ranks below its own but for the last.

    Then a merge never makes a pair of a lower rank: the bytes of that pair's token, which nothing crosses, would have
    been merged to it before.
    """
    for token, rank in ranks.items():
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            lowest, at = min((ranks.get(a + b, rank), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
            if lowest >= rank:
                return False
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return True


def token(e: Column) -> Column:
    return e.bitwiseAND(TOKEN)


def place(e: Column) -> Column:
    return e.bitwiseAND(PLACE)


def pair_rank(ranks: Column, a: Column, b: Column) -> Column:
    key = a * NONE + b
    return F.coalesce(F.try_element_at(F.get(ranks, (key % BUCKETS).cast("int")), key), F.lit(NONE).cast("long"))


def merge_by_rank(word: Column, ranks: Column, grow: bool) -> Column:
    """The tokens of a long word's entries: each step joins all pairs of the lowest rank from left to right, or the first one if not ``grow``.

    A fold copies its state at each step, so steps are run in lots of 1, 2, 4, ..., and no lot begins after the last merge.
    """
    doubled = F.array(*[F.lit(1 << k) for k in range(PLACE_BITS)])

    def chosen(e: Column, lowest: Column) -> Column:
        """The index at each pair to join, null elsewhere: of pairs that overlap in a run, every other one from the first."""
        begins = lambda x: F.coalesce(F.shiftright(x, RANK_SHIFT) == lowest, F.lit(False))
        firsts = F.transform(e, lambda x, i: F.when(begins(x) & ~begins(F.get(e, i - 1)), i))
        if not grow:
            return let(firsts, lambda f: let(F.array_min(f), lambda first: F.transform(f, lambda i: F.when(i == first, i))))
        overlaps = F.size(F.filter(e, lambda x, i: begins(x) & begins(F.get(e, i - 1)))) > 0
        # The last first one up to each place, by distances that double.
        runs = F.aggregate(F.filter(doubled, lambda d: d < F.size(e)), firsts, lambda v, d: F.transform(v, lambda x, i: F.greatest(x, F.get(v, i - d))))
        alternate = let(runs, lambda v: F.transform(e, lambda x, i: F.when(begins(x) & ((i - F.get(v, i)) % 2 == 0), i)))
        return F.when(overlaps, alternate).otherwise(firsts)

    def joined(e: Column, lowest: Column, at: Column) -> Column:
        one = lambda x, i: F.when(F.get(at, i).isNotNull(), place(x).bitwiseOR(lowest)).when(F.get(at, i - 1).isNull(), x)
        return F.filter(F.transform(e, one), lambda x: x.isNotNull())

    def ranked(e: Column, lowest: Column) -> Column:
        """New ranks for the pairs that a new token is part of."""

        def one(x: Column, i: Column) -> Column:
            behind = token(F.get(e, i + 1))
            rank = F.when(behind.isNull(), F.lit(NONE).cast("long")).otherwise(pair_rank(ranks, token(x), behind))
            changed = (token(x) == lowest) | F.coalesce(behind == lowest, F.lit(False))
            return F.when(changed, F.shiftleft(rank, RANK_SHIFT).bitwiseOR(x.bitwiseAND(PLACE | TOKEN))).otherwise(x)

        return F.transform(e, one)

    state = lambda e: F.struct(e.alias("e"), F.array_min(e).alias("low"))

    def unless_done(s: Column, after: Column) -> Column:
        return F.when(s.getField("low") >= NONE << RANK_SHIFT, s).otherwise(after)

    def step(s: Column, _: Column) -> Column:
        e, lowest = s.getField("e"), F.shiftright(s.getField("low"), RANK_SHIFT)
        return unless_done(s, let(chosen(e, lowest), lambda at: let(joined(e, lowest, at), lambda j: let(ranked(j, lowest), state))))

    lots = F.filter(doubled, lambda n: n <= F.size(word))
    return F.aggregate(lots, state(word), lambda s, n: unless_done(s, F.aggregate(F.sequence(F.lit(1), n), s, step)), lambda s: F.transform(s.getField("e"), token))


def merge_word(word: Column, ranks: Column) -> Column:
    """The tokens of a word's entries: each step of the fold joins the first pair of the lowest rank, until none is left."""
    rank = lambda a, b: pair_rank(ranks, a, b)

    def joined(e: Column, low: Column, at: Column) -> Column:
        merged, before, behind = F.shiftright(low, RANK_SHIFT), F.get(e, at - 1), F.get(e, at + 2)
        right = F.when(behind.isNull(), F.lit(NONE).cast("long")).otherwise(rank(merged, token(behind)))
        here = F.array(F.shiftleft(right, RANK_SHIFT).bitwiseOR(place(low)).bitwiseOR(merged))
        left = F.array(F.shiftleft(rank(token(before), merged), RANK_SHIFT).bitwiseOR(before.bitwiseAND(PLACE | TOKEN)))
        rest = F.slice(e, at + 3, F.size(e))
        return F.when(at > 0, F.concat(F.slice(e, F.lit(1), at - 1), left, here, rest)).otherwise(F.concat(here, rest))

    def step(e: Column, _: Column) -> Column:
        def merge(low: Column) -> Column:
            # Places grow along a word, so those before count up to the pair's index.
            index = let(place(low), lambda p: F.size(F.filter(e, lambda x: place(x) < p)))
            return F.when(low >= NONE << RANK_SHIFT, e).otherwise(let(index, lambda at: joined(e, low, at)))

        return let(F.array_min(e), merge)

    steps = F.when(F.size(word) > 1, F.sequence(F.lit(1), F.size(word) - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, word, step, lambda e: F.transform(e, token))


LONG = 256  # bytes of a word from which on it is cut, and folded rank by rank
SLICE = 1 << 18  # bytes of a word that are looked at together


class Cutter:
    """Words to arrays of entries: their bytes' tokens with the rank of each pair of neighbours. Long words to pieces."""

    def __init__(self, tokens: list[bytes]) -> None:
        self.bytes, self.pairs = np.zeros(256, np.int64), np.full((256, 256), NONE, np.int64)
        self.tokens, self.tree = tokens, None
        for i, t in enumerate(tokens):
            if len(t) == 1:
                self.bytes[t[0]] = i
            elif len(t) == 2:
                self.pairs[t[0], t[1]] = i

    def _tree(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The tokens as a tree of bytes: its edges (node * 256 + byte, sorted), the nodes they lead to, and whether a token ends at a node."""
        if self.tree is None:
            edges: dict[int, int] = {}
            ends = set()
            for t in self.tokens:
                node = 0
                for byte in t:
                    node = edges.setdefault(node * 256 + byte, len(edges) + 1)
                ends.add(node)
            keys = np.fromiter(edges.keys(), np.int64, len(edges))
            order = np.argsort(keys)
            final = np.zeros(len(edges) + 1, bool)
            final[list(ends)] = True
            self.tree = keys[order], np.fromiter(edges.values(), np.int64, len(edges))[order], final
        return self.tree

    def pieces(self, word: bytes) -> list[bytes]:
        """The word, cut at all places that no token occurring in it reaches over."""
        keys, nodes, final = self._tree()
        raw = np.frombuffer(word, np.uint8)
        furthest, cuts = 0, [0]
        for start in range(0, len(raw), SLICE):
            at = np.arange(start, min(start + SLICE, len(raw)))
            reach = at + 1
            node, depth = np.zeros(len(at), np.int64), 0
            while len(at):
                edge = node * 256 + raw[at + depth]
                found = np.minimum(np.searchsorted(keys, edge), len(keys) - 1)
                on = keys[found] == edge
                at, node, depth = at[on], nodes[found[on]], depth + 1
                here = at[final[node]]
                reach[here - start] = here + depth
                inside = at + depth < len(raw)
                at, node = at[inside], node[inside]
            reach = np.maximum.accumulate(np.maximum(reach, furthest))
            furthest = int(reach[-1])
            places = np.arange(start + 1, start + 1 + len(reach))
            cuts += places[reach == places].tolist()
        return [word[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def entries(self, words: pa.Array) -> pa.ListArray:
        """Of strings or byte strings."""
        if not len(words):
            return pa.array([], pa.list_(pa.int64()))
        ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
        raw = np.frombuffer(words.buffers()[2], np.uint8)[ends[0] : ends[-1]]
        ends = ends - ends[0]
        sizes = np.diff(ends)
        if sizes.max() > PLACE >> TOKEN_BITS:
            raise ValueError(f"a word has {sizes.max()} bytes, over the {PLACE >> TOKEN_BITS} that an entry can number")
        rank = np.full(len(raw), NONE, np.int64)
        rank[:-1] = self.pairs[raw[:-1], raw[1:]]
        rank[ends[1:] - 1] = NONE
        places = np.arange(len(raw)) - np.repeat(ends[:-1], sizes)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(rank << RANK_SHIFT | places << TOKEN_BITS | self.bytes[raw]))


ROW_WORDS = 500_000  # words of one row between the steps
HELD_WORDS = 200_000  # words that a task numbers besides the warm ones before it begins anew
PIECE_WORDS, PIECES = 64, 128


def _pieces(docs: DataFrame, id: Column, words: Column) -> DataFrame:
    """``id, words, last``: a document's words in rows of ``PIECE_WORDS``, or more where that were over ``PIECES`` rows, so that a batch of rows is small."""
    n = F.size("_words")
    most = F.greatest(F.lit(PIECE_WORDS), F.ceil(n / PIECES).cast("int"))
    cut = F.transform(F.sequence(F.lit(0), F.floor(F.greatest(n - 1, F.lit(0)) / most).cast("int")), lambda i: F.struct(F.slice("_words", i * most + 1, most).alias("words"), ((i + 1) * most >= n).alias("last")))
    return docs.select(id.alias("id"), once(words).alias("_words")).select("id", F.inline(cut))


def _cut(tokens):
    """Rows of words with their entries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Cutter(tokens.value)
        for b in batches:
            words = b.column("word").cast(pa.string())
            if len(words):
                one = pa.array([0, len(words)], pa.int32())
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(one, words), pa.ListArray.from_arrays(one, cutter.entries(words))], ["words", "parts"])

    return run


def _with_pieces(codes: np.ndarray, words: np.ndarray, long: dict[int, list[int]], bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of words with those of all pieces in the place of a long word's first, and the bounds among them."""
    at = np.flatnonzero(np.isin(words, list(long)))
    more = [long[w][1:] for w in words[at].tolist()]
    grown = np.zeros(len(words) + 1, np.int64)
    grown[at + 1] = [len(m) for m in more]
    return np.insert(codes, np.repeat(at + 1, grown[at + 1]), np.concatenate(more)), bounds + np.cumsum(grown)[bounds]


def _split(tokens, warm):
    """Numbers the words: warm ones first, then those new to the task, whose byte tokens go along once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter, known = Cutter(tokens.value), warm.value
        n_warm = len(known)
        held: dict[bytes, int] = {}
        begun: list[np.ndarray] = []  # codes of a document whose last piece is still to come
        one = lambda values: pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)
        for b in batches:
            ends = b.column("words").offsets.to_numpy()
            start = 0
            while start < b.num_rows:
                stop = max(start + 1, int(np.searchsorted(ends, ends[start] + ROW_WORDS, side="right")) - 1)
                part = b.slice(start, stop - start)
                coded = part.column("words").flatten().dictionary_encode()
                new, fresh = [], len(held) > HELD_WORDS and not begun
                if fresh:
                    held = {}
                # The warm words are an Arrow array, as a Python dictionary of them would take ten times the memory.
                numbers = pc.index_in(coded.dictionary, value_set=known).fill_null(-1).to_numpy(zero_copy_only=False).copy()
                rare = np.flatnonzero(numbers < 0)
                long: dict[int, list[int]] = {}
                for k, w in zip(rare.tolist(), coded.dictionary.take(pa.array(rare)).cast(pa.binary()).to_pylist(), strict=True):
                    own = []
                    for piece in (w,) if len(w) <= LONG else cutter.pieces(w):
                        code = held.get(piece)
                        if code is None:
                            code = held[piece] = n_warm + len(held)
                            new.append(piece)
                        own.append(code)
                    numbers[k] = own[0]
                    if len(own) > 1:
                        long[k] = own
                codes = numbers[coded.indices.to_numpy(zero_copy_only=False)] if len(coded) else numbers[:0]
                last = part.column("last").to_numpy(zero_copy_only=False)
                bounds = ends[start + 1 : stop + 1][last] - ends[start]  # where whole documents end
                if long:
                    codes, bounds = _with_pieces(codes, coded.indices.to_numpy(zero_copy_only=False), long, bounds)
                whole = int(bounds[-1]) if len(bounds) else 0
                before = sum(map(len, begun))
                own = np.concatenate([*begun, codes[:whole]]) if len(bounds) else codes[:0]
                sizes = np.diff(np.concatenate([[0], bounds + before])) if len(bounds) else bounds
                begun = [x for x in (*(() if len(bounds) else begun), codes[whole:]) if len(x)]
                yield pa.RecordBatch.from_arrays(
                    [one(part.column("id").filter(part.column("last"))), pa.array([sizes.astype("<i4").tobytes()], pa.binary()), pa.array([own.astype("<i4").tobytes()], pa.binary()), pa.array([fresh]), one(cutter.entries(pa.array(new, pa.binary())))],
                    ["ids", "sizes", "codes", "fresh", "parts"],
                )
                start = stop

    return run


def _lists(merged: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and lengths of a list array."""
    if not len(merged):
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    return merged.flatten().to_numpy(zero_copy_only=False).astype(np.int32), np.diff(merged.offsets.to_numpy()).astype(np.int64)


def _assemble(tokens, warm_ids):
    """Puts the ids of each document together, and their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, (warm_values, warm_lengths) = tokens.value, warm_ids.value
        values, lengths = warm_values, warm_lengths
        for b in batches:
            for row in range(b.num_rows):
                if b.column("fresh")[row].as_py():
                    values, lengths = warm_values, warm_lengths
                more, n = _lists(b.column("merged").slice(row, 1).flatten())
                values, lengths = np.concatenate([values, more]), np.concatenate([lengths, n])
                starts = np.cumsum(lengths) - lengths
                sizes, codes = (np.frombuffer(b.column(x)[row].as_py(), "<i4") for x in ("sizes", "codes"))
                at, n_tokens, encoded, decoded = 0, [], [], []
                for size in sizes:
                    own = codes[at : at + size]
                    at += size
                    each = lengths[own]
                    total = int(each.sum())
                    ids = values[np.repeat(starts[own] - np.cumsum(each) + each, each) + np.arange(total)] if total else values[:0]
                    n_tokens.append(total)
                    encoded.append(ids.astype("<u4").tobytes())
                    decoded.append(b"".join(map(pieces.__getitem__, ids.tolist())))
                ids = b.column("ids").slice(row, 1).flatten()
                yield pa.RecordBatch.from_arrays([ids, pa.array(n_tokens, pa.int64()), pa.array(encoded, pa.binary()), pa.array(decoded, pa.binary())], ["id", "n_tokens", "token_ids", "decoded"])

    return run


def _fold_all(parts: DataFrame, ranks: Column, grow: bool) -> DataFrame:
    # A subquery may not stand inside a lambda, so its value comes as a column.
    given = F.col("_ranks")
    merged = F.transform("parts", lambda w: F.when(F.size(w) > LONG, merge_by_rank(w, given, grow)).otherwise(merge_word(w, given)))
    return parts.withColumn("_ranks", ranks).withColumn("merged", merged).drop("parts", "_ranks")


def encode_decode(
    docs: DataFrame,
    vocabulary: str,
    pattern: str,
    id: str = "doc_id",
    text: str = "text",
    warm_docs: int = 4_000,
    warm_chars: int = 8_000,
    warm_words: int = 300_000,
    warm_bytes: int = 40,
) -> DataFrame:
    """``id, n_tokens, token_ids`` (little-endian unsigned 32-bit) and ``decoded`` (the ids' bytes, concatenated)."""
    spark = docs.sparkSession
    settle(spark)
    ranks = read_ranks(vocabulary)
    tokens = [b""] * (max(ranks.values(), default=0) + 1)
    if len(tokens) > NONE:
        raise ValueError(f"token numbers go up to {len(tokens) - 1}, over {NONE - 1}")
    for t, r in ranks.items():
        tokens[r] = t
    literal, grow = rank_map(spark, ranks), ranks_grow(ranks)
    body = F.coalesce(F.col(text), F.lit(""))
    split = lambda c: F.regexp_extract_all(c, F.lit(java_pattern(pattern)), F.lit(0))

    # The warm dictionary: the most frequent words of some documents, at most so many and so long. The documents
    # come from the first tasks that have enough, so that no exchange of texts is needed, and are cut to a size
    # that bounds what the driver holds.
    some = docs.select(F.substring(body, 1, warm_chars).alias("text")).limit(warm_docs).collect()
    some = spark.createDataFrame(pa.table({"text": pa.array([r["text"] for r in some], pa.string())})).repartition(32)
    counted = some.select(F.explode(split(F.col("text"))).alias("word")).where(F.octet_length("word") <= warm_bytes).groupBy("word").count()
    often = counted.orderBy(F.desc("count"), "word").limit(warm_words).select("word").repartition(32, "word")
    sent = spark.sparkContext.broadcast
    tokens_sent = sent(tokens)
    # Cut and folded where they are counted: only the words and their ids come to the driver, in any order.
    cut = often.mapInArrow(_cut(tokens_sent), "words array<string>, parts array<array<bigint>>")
    folded = _fold_all(cut, literal, grow).select("words", F.transform("merged", lambda w: w.cast("array<int>")).alias("merged")).toArrow().combine_chunks()
    known, known_ids = (pa.concat_arrays([c.flatten() for c in folded.column(name).chunks]) if folded.num_rows else empty for name, empty in (("words", pa.array([], pa.string())), ("merged", pa.array([], pa.list_(pa.int32())))))

    del some, counted, often, cut, folded
    settle(spark)
    words = _pieces(docs, F.col(id), split(body))
    own = words.schema["id"].dataType
    kind = lambda name, t: T.StructField(name, t)
    passed = T.StructType([kind("ids", T.ArrayType(own)), kind("sizes", T.BinaryType()), kind("codes", T.BinaryType()), kind("fresh", T.BooleanType()), kind("parts", T.ArrayType(T.ArrayType(T.LongType())))])
    results = T.StructType([kind("id", own), kind("n_tokens", T.LongType()), kind("token_ids", T.BinaryType()), kind("decoded", T.BinaryType())])
    numbered = words.mapInArrow(_split(tokens_sent, sent(known.cast(pa.string()))), passed)
    return _fold_all(numbered, literal, grow).mapInArrow(_assemble(tokens_sent, sent(_lists(known_ids))), results).withColumnRenamed("id", id)
