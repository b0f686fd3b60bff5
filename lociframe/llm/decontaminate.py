"""Benchmark decontamination by an FM-index per training shard.

Benchmark texts are cut into windows of ``width`` words (a shorter text is one window). Each task reads its
shard of documents, maps words to benchmark word numbers, and builds an FM-index over them: suffix array,
Burrows-Wheeler transform, wavelet matrix with popcount ranks, sampled suffix positions. All windows are
searched backward at once, their occurrences located through the samples, and the covered words merged into
removal spans.

A word that no benchmark text holds can't be part of an occurrence, and neither can a stretch of benchmark
words shorter than the shortest window, so only longer stretches enter the index, with separators between
them. This drops no occurrence and keeps the index small. There is no shuffle: each document is judged where
it is read.

The windows are broadcast as arrays, in blocks of items whose texts stay under ``block_bytes`` (about 40 bytes a word, and
the vocabulary); with a larger benchmark, a shard is searched for one block after the other and the spans are merged, so
that no rows are grouped. A worker holds all blocks, so the benchmark's windows must fit into its memory.

Cutting a passage joins its two sides, which may make a passage; what is left of such a document is indexed and searched
again until nothing is hit.

Defined results: null or empty texts have no words, as documents and as items; items with equal text are all
reported; an item with a null id marks what it hits but isn't listed; long texts are searched whole, a shard holding at
least one document; rows are judged one by one, repeated ones too; with no windows nothing is hit; an empty table gives
an empty table. Result columns replace input columns of the same name; other columns pass through, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lociframe.llm.shared import named, packed, unpacked

# Bytes that make words: digits, letters in lower case, all beyond ASCII; the others become spaces.
_WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile("[0-9A-Za-z\x80-\U0010ffff]+")
SAMPLE = 16  # every 16th suffix position is stored
SHARD_WORDS = 4_000_000


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(_WORD_BYTES).split() if text else []


@dataclass
class Windows:
    """Distinct windows by length, over the numbers of the benchmark's words, and the items of each (``names`` of ``members`` between ``ends``)."""

    vocabulary: dict[bytes, int]
    patterns: dict[int, np.ndarray]
    names: list[str | None]
    members: dict[int, np.ndarray]
    ends: dict[int, np.ndarray]

    @property
    def shortest(self) -> int:
        return min(self.patterns, default=0)

    def items(self, n: int, window: int) -> list[str]:
        own = self.members[n][self.ends[n][window] : self.ends[n][window + 1]]
        return [x for k in own.tolist() if (x := self.names[k]) is not None]


def cut_windows(items: list[tuple[str | None, bytes | None]], width: int) -> Windows:
    vocabulary: dict[bytes, int] = {}
    cut: dict[int, list[np.ndarray]] = {}
    owners: dict[int, list[np.ndarray]] = {}
    for k, (_, text) in enumerate(items):
        numbers = np.array([vocabulary.setdefault(w, len(vocabulary) + 1) for w in words_of(text)], np.int32)
        n = min(width, len(numbers))
        if n:
            cut.setdefault(n, []).append(np.lib.stride_tricks.sliding_window_view(numbers, n))
            owners.setdefault(n, []).append(np.full(len(numbers) - n + 1, k, np.int64))
    patterns, members, ends = {}, {}, {}
    for n, parts in cut.items():
        patterns[n], window = np.unique(np.concatenate(parts), axis=0, return_inverse=True)
        pairs = np.unique(np.stack([window.ravel(), np.concatenate(owners[n])], 1), axis=0)
        members[n] = pairs[:, 1]
        ends[n] = np.searchsorted(pairs[:, 0], np.arange(len(patterns[n]) + 1))
    return Windows(vocabulary, {n: x.astype(np.int64) for n, x in patterns.items()}, [i for i, _ in items], members, ends)


class WaveletMatrix:
    """Symbols of a sequence by bit planes; ranks by popcounts."""

    def __init__(self, symbols: np.ndarray, size: int) -> None:
        self.bits = range(max(1, int(size - 1).bit_length()))[::-1]
        self.words, self.counts, self.zeros = [], [], []
        n = len(symbols)
        for b in self.bits:
            on = (symbols >> b & 1).astype(bool)
            packed = np.packbits(np.concatenate([on, np.zeros(64 + -n % 64, bool)]), bitorder="little").view(np.uint64)
            self.words.append(packed)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int64)]))
            self.zeros.append(n - int(on.sum()))
            symbols = np.concatenate([symbols[~on], symbols[on]])
        # Where each symbol's run begins in the last order.
        self.first = np.searchsorted(self._last_keys(symbols), self._last_keys(np.arange(size)))

    def _last_keys(self, symbols: np.ndarray) -> np.ndarray:
        """The last order sorts by the bits read from the lowest up."""
        out = np.zeros(len(symbols), np.int64)
        for b in self.bits:
            out |= (symbols >> b & 1) << (len(self.bits) - 1 - b)
        return out

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        return self.counts[level][word] + np.bitwise_count(self.words[level][word] & ((np.uint64(1) << bit) - np.uint64(1)))

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        for level, b in enumerate(self.bits):
            ones = self._ones(level, at)
            at = np.where(symbols >> b & 1, self.zeros[level] + ones, at - ones)
        return at - self.first[symbols]

    def access(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and how often it stands before it."""
        symbols = np.zeros(len(at), np.int64)
        for level, b in enumerate(self.bits):
            on = (self.words[level][at >> 6] >> (at & 63).astype(np.uint64) & np.uint64(1)).astype(np.int64)
            symbols |= on << b
            ones = self._ones(level, at)
            at = np.where(on, self.zeros[level] + ones, at - ones)
        return symbols, at - self.first[symbols]


def suffix_array(text: np.ndarray) -> np.ndarray:
    """By prefix doubling. Zeros separate; each counts as a symbol of its own, so no match runs across one."""
    apart = text == 0
    rank = np.where(apart, np.cumsum(apart) - 1, text + apart.sum())
    order, step = np.argsort(rank, kind="stable"), 1
    rank = np.unique(rank, return_inverse=True)[1].astype(np.int64)
    while step < len(text) and rank.max() < len(text) - 1:
        after = np.zeros(len(text), np.int64)
        after[:-step] = rank[step:] + 1
        key = rank * (len(text) + 1) + after
        order = np.argsort(key, kind="stable")
        rank = np.empty(len(text), np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
        step *= 2
    return order


class FMIndex:
    """Over a sequence that starts with a separator 0; symbols are below ``size``."""

    def __init__(self, text: np.ndarray, size: int) -> None:
        order = suffix_array(text)
        self.length = len(text)
        self.tree = WaveletMatrix(text[order - 1], size)
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=size))[:-1]])
        # Samples stand at every SAMPLE-th place and after each separator, so that no step leads across one.
        sampled = (np.arange(len(text)) % SAMPLE == 0) | (text == 0) | (np.roll(text, 1) == 0)
        rows = sampled[order]
        self.sampled = np.packbits(np.concatenate([rows, np.zeros(64 + -len(rows) % 64, bool)]), bitorder="little")
        self.sampled_before = np.concatenate([[0], np.cumsum(rows)])
        self.samples = order[rows]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of equally long patterns: row ranges ``[low, high)``."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.length, np.int64)
        live = np.arange(len(patterns))
        for c in patterns.T[::-1]:
            c = c[live]
            low[live] = self.smaller[c] + self.tree.rank(c, low[live])
            high[live] = self.smaller[c] + self.tree.rank(c, high[live])
            live = live[low[live] < high[live]]
        dead = np.ones(len(patterns), bool)
        dead[live] = False
        high[dead] = low[dead]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in the sequence of the suffixes in these rows."""
        out, live, steps = np.zeros(len(rows), np.int64), np.arange(len(rows)), 0
        while len(live):
            done = (self.sampled[rows >> 3] >> (rows & 7).astype(np.uint8) & 1).astype(bool)
            out[live[done]] = self.samples[self.sampled_before[rows[done]]] + steps
            live, rows, steps = live[~done], rows[~done], steps + 1
            if len(live):
                symbols, before = self.tree.access(rows)
                rows = self.smaller[symbols] + before
        return out


def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """All of ``start .. start + length - 1``, one range after another."""
    return np.repeat(start - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum()) if len(start) else np.zeros(0, np.int64)


def search_shard(windows: Windows, numbers: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """``(length, window, place)`` of all occurrences in a shard's word numbers; 0 is any other word or a document's end."""
    inside = np.concatenate([[0], (numbers > 0).astype(np.int8), [0]])
    edges = np.diff(inside)
    start, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
    long = end - start >= windows.shortest
    start, length = start[long], (end - start)[long]
    if not len(start):
        return []
    place = _ranges(start - 1, length + 1)  # each stretch after its separator; of the first one the place may be -1
    text = numbers[place]
    text[np.concatenate([[0], np.cumsum(length + 1)[:-1]])] = 0
    index = FMIndex(text, len(windows.vocabulary) + 1)
    found = []
    for n, patterns in windows.patterns.items():
        low, high = index.search(patterns)
        hit = np.flatnonzero(high > low)
        at = index.locate(_ranges(low[hit], (high - low)[hit]))
        found.append((n, np.repeat(hit, (high - low)[hit]), place[at]))
    return found


def _spans(hit: np.ndarray) -> list[dict[str, int]]:
    edges = np.diff(np.concatenate([[0], hit, [0]]))
    return [{"start": int(a), "end": int(b)} for a, b in zip(np.flatnonzero(edges == 1), np.flatnonzero(edges == -1), strict=True)]


def remove_spans(text: str, spans: list[dict[str, int]]) -> str:
    """``text`` without the words of the spans and what stands between them; a space where one was cut."""
    ends = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for s in spans:
        out.append(text[at : ends[s["start"]][0]])
        at = ends[s["end"] - 1][1]
    return " ".join(x for x in (y.strip(" ") for y in [*out, text[at:]]) if x)


SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))
RESULTS = [T.StructField("n_words", T.LongType()), T.StructField("spans", SPANS), T.StructField("items", T.ArrayType(T.StringType()))]


def _judge(blocks: list, spans_type: pa.DataType, closed: bool):
    """A step that gives each row the spans and items that the windows of all blocks hit.

    ``closed``: what is hit is taken out and the rest searched again, until nothing is hit, as a cut may bring the words of a
    passage together.
    """

    def shard(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        bodies = [x for b in batches for x in b.column("body").to_pylist()]
        sizes = np.fromiter((len(words_of(x)) for x in bodies), np.int64, len(bodies))
        # Words of all documents, each document behind a separator.
        first = 1 + np.cumsum(sizes + 1) - (sizes + 1)
        total = int((sizes + 1).sum()) + 1
        hit, items = np.zeros(total, bool), {}
        live = np.arange(len(bodies))
        while len(live):
            left = np.concatenate([first[d] + np.flatnonzero(~hit[first[d] : first[d] + sizes[d]]) for d in live]) if closed and hit.any() else _ranges(first[live], sizes[live])
            doc = np.searchsorted(first, left, side="right") - 1
            # Places in what is left, with a separator before each document.
            starts = np.flatnonzero(np.diff(doc, prepend=-1))
            place = np.insert(left, starts, 0)
            found = np.zeros(total, bool)
            for block in blocks:
                w: Windows = block.value
                if not w.patterns or not len(left):
                    continue
                numbers = np.zeros(total, np.int64)
                for d in live:
                    numbers[first[d] : first[d] + sizes[d]] = np.fromiter(map(w.vocabulary.get, words_of(bodies[d]), repeat(0)), np.int64, sizes[d])
                change = np.zeros(len(place) + 2, np.int64)
                for n, window, at in search_shard(w, np.append(np.where(place > 0, numbers[place], 0), 0)):
                    np.add.at(change, at, 1)
                    np.add.at(change, at + n, -1)
                    of = np.searchsorted(first, place[at], side="right") - 1
                    for d, k in np.unique(np.stack([of, window], 1), axis=0):
                        items.setdefault(int(d), set()).update(w.items(n, k))
                found[place[np.flatnonzero(np.cumsum(change)[: len(place)] > 0)]] = True
            found[0] = False
            hit |= found
            live = np.unique(np.searchsorted(first, np.flatnonzero(found), side="right") - 1) if closed else live[:0]
        flags = hit.astype(np.int8)
        spans = [_spans(flags[first[d] : first[d] + sizes[d]]) if d in items else [] for d in range(len(sizes))]
        whole = pa.Table.from_batches(batches).combine_chunks()
        kept = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in (whole.column("row"), whole.column("body"))]
        kept = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in kept]
        out = [pa.array(sizes, pa.int64()), pa.array(spans, spans_type), pa.array([sorted(items.get(d, ())) for d in range(len(sizes))], pa.list_(pa.string()))]
        return pa.RecordBatch.from_arrays(kept + out, ["row", "body", "n_words", "spans", "items"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for b in batches:
            held.append(b)
            size += b.column("body").nbytes
            if size > 6 * SHARD_WORDS:
                yield shard(held)
                held, size = [], 0
        if held:
            yield shard(held)

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = 10, block_bytes: int = 8 << 20, closed: bool = False) -> DataFrame:
    """``docs`` with ``n_words``, ``spans array<struct<start, end>>`` (words, end exclusive), ``items`` and ``n_hit``.

    ``closed``: also what becomes a passage once others are taken out.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).cast("binary").alias("text"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)) + 64 * F.count(F.lit(1))).first()[0]
    blocks = max(1, -(-int(total) // block_bytes))
    # A text goes through Python once, as its bytes, from which its column is made again.
    kind = docs.schema[text].dataType if text in docs.columns else None
    once = isinstance(kind, (T.StringType, T.BinaryType))
    out = packed(docs, text if once else None, body=named(text).cast("binary"))
    schema = T.StructType([out.schema["row"], out.schema["body"], *RESULTS])
    arrow = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    sent = []
    for b in range(blocks):
        own = items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b) if blocks > 1 else items
        sent.append(spark.sparkContext.broadcast(cut_windows([(r["item"], bytes(r["text"]) if r["text"] is not None else None) for r in own.collect()], width)))
    out = out.mapInArrow(_judge(sent, arrow, closed), schema)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s.getField("end") - s.getField("start"))
    if once:
        out = out.withColumn("row", F.struct(*[(F.col("body").cast(kind) if c == text else F.col("row").getField(c)).alias(c) for c in docs.columns]))
    return unpacked(out.withColumn("n_hit", hit), "n_words", "spans", "items", "n_hit")


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", **options) -> DataFrame:
    """``docs`` with the benchmark passages cut out of ``text``, and those that a cut brings together, until there is none; documents of which no word remains are dropped, others stay."""
    given = packed(docs, text, text=named(text))
    judged = contamination(given, benchmark, text="text", closed=True, **options)
    out = T.StructType([judged.schema["row"], judged.schema["text"]])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [remove_spans(t, s) if s else t for t, s in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(texts, pa.string())], ["row", "text"])

    emptied = (F.col("n_hit") > 0) & (F.col("n_hit") == F.col("n_words"))
    left = judged.where(~emptied).select("row", "text", "spans").mapInArrow(cut, out)
    return left.select(*[(F.col("text") if c == text else F.col("row").getField(c)).alias(c) for c in docs.columns])
