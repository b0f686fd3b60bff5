"""The page and quality queries against a plain reading of every row of the smallest tables."""

from __future__ import annotations

import itertools
import zlib
from collections import Counter

import duckdb
import numpy as np

from lociframe.llm import html_extract, quality_model
from lociframe.llm import queries as q
from lociframe.llm.shared import table

SF = "/root/testdata/sf0.001"


def best_labels(features, crf):
    """The labels of the greatest sum: all sequences of short pages, else all prefixes kept by their last label."""

    def total(labels):
        own = sum(crf.weights.get(f, (0.0, 0.0))[y] for fs, y in zip(features, labels, strict=True) for f in fs)
        return own + sum(crf.steps[a][b] for a, b in itertools.pairwise(labels))

    if len(features) <= 10:
        return max(itertools.product((0, 1), repeat=len(features)), key=total)
    kept = {(y,): 0.0 for y in (0, 1)}
    best = {p[-1]: (sum(crf.weights.get(f, (0.0, 0.0))[p[-1]] for f in features[0]), p) for p in kept}
    for fs in features[1:]:
        best = {y: max((s + crf.steps[p[-1]][y] + sum(crf.weights.get(f, (0.0, 0.0))[y] for f in fs), (*p, y)) for s, p in best.values()) for y in (0, 1)}
    return max(best.values())[1]


def test_pages(spark):
    crf = html_extract.trained(400, 0)
    pages = duckdb.sql(f"select page_id, url, html from '{SF}/pages.parquet'").fetchall()
    expected = []
    for page, url, html in pages:
        blocks = html_extract.leaf_blocks(html)
        labels = best_labels([b.features for b in blocks], crf) if blocks else ()
        text = "\n".join(b.text for b, y in zip(blocks, labels, strict=True) if y)
        expected.append((page, url, text, len(text)))
    found = [tuple(r) for r in q.op3_html_extract(spark, SF).collect()]
    assert sorted(found, key=repr) == sorted(expected, key=repr)


def test_quality(spark):
    docs = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet'").fetchall()
    labels = duckdb.sql(f"select doc_id, quality from '{SF}/labels.parquet'").fetchall()
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 3 == 1
    texts = dict(docs)
    rows = sorted((float(y), quality_model.features(texts[i].encode())) for i, y in labels if y is not None and not out(i) and i in texts)
    x, y = np.array([r[1] for r in rows]), np.array([r[0] for r in rows])
    order = np.lexsort([*x.T, y])
    model = quality_model.fit(x[order], y[order])

    def plain(text):
        """Each feature's bin by counting the edges at or below it, and the tables' entries added up."""
        v = quality_model.features((text or "").encode())
        at = [sum(e <= v[f] for e in edges) for f, edges in enumerate(model.edges)]
        coarse = [sum(e <= v[f] for e in edges) for f, edges in enumerate(model.pair_edges)]
        total = model.base + sum(t[k] for t, k in zip(model.tables, at, strict=True)) + sum(t[coarse[a], coarse[b]] for a, b, t in model.pairs)
        return 1 / (1 + np.exp(-total))

    found = q.op7_quality_model(spark, SF).collect()
    assert Counter(r["doc_id"] for r in found) == Counter(i for i, _ in docs)
    known = {i: plain(t) for i, t in docs}
    for r in found:
        assert r["held_out"] == out(r["doc_id"])
        assert abs(r["score"] - known[r["doc_id"]]) < 1e-9
        assert r["predicted"] == int(r["score"] >= 0.5)


def test_repeated_labels_count_again(spark):
    """A document with several labels is learned from once for each."""
    docs = table(spark, SF, "documents").select("doc_id", "text")
    labels = spark.createDataFrame([(1, 1), (1, 1), (1, 0), (2, 0), (3, None)], "doc_id long, quality int")
    model = quality_model.fit_on(docs, labels, "quality")
    assert abs(1 / (1 + np.exp(-model.base)) - 0.5) < 0.2
