"""Quality classifier: a generalised additive model with pairwise interactions.

Features are counts and ratios of the text alone. Cyclic boosting adds a shallow tree to one feature's lookup
table at a time, then to those of the most useful pairs; scoring finds bins and adds table entries, vectorised
over a batch of documents.

Fitting takes a bounded sample: at most ``fit_rows`` labelled rows, those with the smallest hashes of their
ids, and sends only their feature vectors to the driver. Scoring covers every document where it is read.

Defined results: null and empty texts have zero features and a score like any other text; null labels are not
learned from, and several labels of a document once each; with no labels, or one class, the score is the class share
(0.5 without labels) for all; repeated rows are scored one by one; long texts are read whole; an empty table gives an
empty table; input columns are kept, whatever their names, but those named like a result are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lociframe.llm.shared import named, packed, unpacked

FEATURES = ("log_words", "word_length", "unique_words", "same_neighbours", "symbols", "bars", "shouts", "upper", "digits", "stops", "commas", "beyond_ascii", "lines", "line_words", "ended_lines", "distinct_lines")
_UPPER = bytes(range(65, 91))
_DIGIT = bytes(range(48, 58))
_HIGH = bytes(range(128, 256))


def features(text: bytes | None) -> list[float]:
    text = text or b""
    words = text.split()
    n, size = max(1, len(words)), max(1, len(text))
    lines = [x for x in text.split(b"\n") if x.strip()]
    without = lambda chars: len(text) - len(text.translate(None, chars))
    return [
        np.log1p(len(words)),
        sum(map(len, words)) / n,
        len(set(words)) / n,
        sum(map(eq, words, words[1:])) / n,
        without(b"#*$%&<>") / n,
        text.count(b"|") / n,
        text.count(b"!") / n,
        without(_UPPER) / size,
        without(_DIGIT) / size,
        text.count(b".") / n,
        text.count(b",") / n,
        without(_HIGH) / size,
        np.log1p(len(lines)),
        n / max(1, len(lines)),
        sum(x.rstrip().endswith((b".", b"!", b"?")) for x in lines) / max(1, len(lines)),
        len(set(lines)) / max(1, len(lines)),
    ]


@dataclass
class Model:
    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pair_edges: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for f, table in enumerate(self.tables):
            total += table[np.searchsorted(self.edges[f], x[:, f], side="right")]
        for a, b, table in self.pairs:
            total += table[np.searchsorted(self.pair_edges[a], x[:, a], side="right"), np.searchsorted(self.pair_edges[b], x[:, b], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _bin_edges(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1])) if len(column) else np.zeros(0)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, damp: float) -> np.ndarray:
    """Values per bin of a tree over ordered bins, from the sums of gradients and curvatures; splits greedily."""
    cg, ch = np.concatenate([[0.0], np.cumsum(g)]), np.concatenate([[0.0], np.cumsum(h)])
    gain = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + damp)
    cuts = [0, len(g)]
    for _ in range(leaves - 1):
        best = (1e-9, 0)
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b - a > 1:
                at = np.arange(a + 1, b)
                gains = gain(a, at) + gain(at, b) - gain(a, b)
                best = max(best, (float(gains.max()), int(at[gains.argmax()])))
        if not best[1]:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.zeros(len(g))
    for a, b in zip(cuts, cuts[1:], strict=False):
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + damp)
    return out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 120, pair_rounds: int = 40, bins: int = 24, pair_bins: int = 6, n_pairs: int = 8, rate: float = 0.15, damp: float = 5.0) -> Model:
    share = float(y.mean()) if len(y) else 0.5
    edges = [_bin_edges(x[:, f], bins) for f in range(len(FEATURES))] if len(y) else [np.zeros(0)] * len(FEATURES)
    pair_edges = [_bin_edges(x[:, f], pair_bins) for f in range(len(FEATURES))] if len(y) else [np.zeros(0)] * len(FEATURES)
    base = float(np.log(np.clip(share, 1e-6, 1 - 1e-6) / np.clip(1 - share, 1e-6, 1)))
    model = Model(base, edges, [np.zeros(len(e) + 1) for e in edges], pair_edges, [])
    if not 0 < share < 1:
        return model
    bins_of = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(edges)]
    coarse = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(pair_edges)]
    total = np.full(len(y), base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for f, table in enumerate(model.tables):
            g, h = slopes()
            step = rate * _tree(np.bincount(bins_of[f], g, len(table)), np.bincount(bins_of[f], h, len(table)), 4, damp)
            table += step
            total += step[bins_of[f]]
    g, h = slopes()

    def cells(a: int, b: int, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        shape = (len(pair_edges[a]) + 1, len(pair_edges[b]) + 1)
        at = coarse[a] * shape[1] + coarse[b]
        return np.bincount(at, g, shape[0] * shape[1]).reshape(shape), np.bincount(at, h, shape[0] * shape[1]).reshape(shape)

    def use(a: int, b: int) -> float:
        gc, hc = cells(a, b, g, h)
        return float((gc**2 / (hc + damp)).sum())

    ranked = sorted(((use(a, b), a, b) for a in range(len(FEATURES)) for b in range(a)), reverse=True)[:n_pairs]
    model.pairs = [(a, b, np.zeros((len(pair_edges[a]) + 1, len(pair_edges[b]) + 1))) for _, a, b in ranked]
    for _ in range(pair_rounds):
        for a, b, table in model.pairs:
            gc, hc = cells(a, b, *slopes())
            # A tree of depth two: the rows by one feature, within each part the columns by the other.
            rows = _tree(gc.sum(1), hc.sum(1), 2, damp)
            step = np.zeros_like(table)
            for value in np.unique(rows):
                part = rows == value
                step[part] = rate * _tree(gc[part].sum(0), hc[part].sum(0), 2, damp)
            table += step
            total += step[coarse[a], coarse[b]]
    return model


def _with(column: str, kind: T.DataType, values):
    """A step over Arrow batches that adds ``column`` from the texts in ``_text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kept = [c for c in b.schema.names if c != "_text"]
            x = np.array([features(t) for t in b.column("_text").to_pylist()], np.float64).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column(c) for c in kept] + [values(x)], [*kept, column])

    return lambda df: df.mapInArrow(run, T.StructType([f for f in df.schema if f.name != "_text"] + [T.StructField(column, kind)]))


def fit_on(docs: DataFrame, labels: DataFrame, label: str, id: str = "doc_id", text: str = "text", fit_rows: int = 20_000) -> Model:
    """Fits on at most ``fit_rows`` of the labelled rows; their ids are few enough to broadcast, their features to collect."""
    chosen = labels.where(F.col(label).isNotNull()).select(F.col(id).alias("_id"), F.col(label).cast("double").alias("y"))
    chosen = chosen.orderBy(F.xxhash64("_id"), "y").limit(fit_rows)
    rows = docs.select(named(id).alias("_doc"), named(text).cast("binary").alias("_text")).join(F.broadcast(chosen), F.col("_doc") == F.col("_id")).select("y", "_text")
    found = _with("x", T.ArrayType(T.DoubleType()), lambda x: pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64())))(rows).toArrow()
    x = np.array(found.column("x").to_pylist(), np.float64).reshape(-1, len(FEATURES))
    y = found.column("y").to_numpy()
    order = np.lexsort([*x.T, y]) if len(y) else np.zeros(0, int)  # the same model whichever task ends first
    return fit(x[order], y[order])


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted``."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    given = packed(docs, _text=named(text).cast("binary"))
    scored = _with("score", T.DoubleType(), lambda x: pa.array(sent.value.score(x)))(given)
    return unpacked(scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int")), "score", "predicted")


def held_out(id: Column) -> Column:
    """True for the third of the ids that is never learned from; false for null."""
    return F.coalesce(F.pmod(F.crc32(id.cast("string")), F.lit(3)) == 1, F.lit(False))
