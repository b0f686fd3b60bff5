"""The pipeline's near-duplicate stage against brute-force Jaccard."""

from __future__ import annotations

import random

import corpus_pipeline
import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from lociframe.llm import shingle_groups

SF = "/root/testdata/sf0.01"


def brute(docs):
    """Places of the rows that stay."""
    sets = []
    for _, t in docs:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)})
    root = list(range(len(docs)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a in range(len(docs)):
        for b in range(a):
            low, high = sorted((len(sets[a]), len(sets[b])))
            if 5 * low >= 4 * high:
                common = len(sets[a] & sets[b])
                if 5 * common >= 4 * (low + high - common):
                    root[find(a)] = find(b)
    groups = {}
    for a, (i, _) in enumerate(docs):
        groups.setdefault(find(a), []).append((i is None, i or 0, a))
    return sorted(min(g)[2] for g in groups.values())


def test_sketches_bound_the_difference():
    rng = np.random.default_rng(5)
    for n, m, common in [(1, 1, 0), (1, 1, 1), (500, 520, 400), (1000, 1030, 900), (3000, 4500, 10), (9000, 9000, 9000)]:
        pool = np.unique(rng.integers(0, 1 << 63, n + m, dtype=np.uint64))
        rng.shuffle(pool)
        a, b = np.sort(pool[:n]), np.sort(pool[n - common : n - common + m])
        found = shingle_groups.differing(shingle_groups.wide(a), shingle_groups.wide(b))
        assert found <= n + m - 2 * common and found % 2 == (n + m) % 2
        # Folded sketches are those of the smaller size; and sets far apart are told apart, however long.
        small = min(len(shingle_groups.wide(a)), len(shingle_groups.wide(b))) * 8
        assert found == shingle_groups.differing(shingle_groups.sketch(a, small), shingle_groups.sketch(b, small))
        if n > 2000 and common < n // 2:
            assert 9 * found > n + m


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        out[rng.randrange(len(out))] = f"x{rng.randrange(10**6)}"
    return out


@pytest.mark.parametrize("often", [200_000, 0])
def test_groups(spark, monkeypatch, often):
    monkeypatch.setattr(shingle_groups, "FREQUENT", often)
    monkeypatch.setattr(shingle_groups, "BLOCK", 7)
    rng = random.Random(3)
    passage = [f"p{i}" for i in range(30)]
    docs = [(0, None), (1, ""), (2, " \n"), (3, "two words"), (4, "Two  WORDS"), (5, "two other")]
    for _ in range(25):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([6, 20, 60, 200]))]
        if rng.random() < 0.6:
            base = passage + base
        for k in range(rng.choice([1, 2, 12])):
            words = edited(rng, base, rng.randrange(1 + len(base) // 30) if k else 0)
            docs.append((len(docs), " ".join(words[: len(words) - rng.choice([0, 0, len(words) // 12])])))
    # A chain whose ends are far apart.
    chain = [f"c{i}" for i in range(100)]
    docs += [(len(docs) + k, " ".join(chain[4 * k : 4 * k + 60])) for k in range(11)]
    # Equal ids and null ids: one row stays, not one id.
    docs += [(None, docs[10][1]), (7, docs[7][1]), (7, docs[7][1]), (None, "only here with a null id"), (None, "only here with a null id")]
    expected = brute(docs)
    assert len(expected) < len(docs)
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(docs)], "doc_id long, text string, at int").coalesce(1)
    assert sorted(r["at"] for r in shingle_groups.one_per_group(df).collect()) == expected
    assert shingle_groups.one_per_group(df.limit(0)).count() == 0


def test_stage_takes_near_copies(spark):
    words = [f"w{i}" for i in range(120)]
    other = words[:60] + ["changed", "two"] + words[62:]
    df = spark.createDataFrame([(1, " ".join(words), "en", "a", 1), (2, " ".join(other), "en", "a", 1), (3, " ".join(words[::-1]), "en", "a", 1)], "doc_id long, text string, lang string, source string, n_chars int")
    assert sorted(r["doc_id"] for r in corpus_pipeline.simhash_stage(spark, df, SF).collect()) == [1, 3]


def test_stage_on_documents(spark):
    docs = duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet' order by doc_id").fetchall()
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.simhash_stage(spark, df, SF).collect()) == [docs[a][0] for a in brute(docs)]


def test_simhash_finds_candidates(spark, monkeypatch):
    words = [f"w{i}" for i in range(300)]
    near, far = [*words[:-1], "other"], words[::-1]
    texts = spark.createDataFrame([(k, " ".join(w).encode()) for k, w in enumerate((words, near, far))], "row long, text binary").coalesce(1)
    marked = shingle_groups.marks(texts, 5, 4, 5).localCheckpoint()
    assert {tuple(sorted(r)) for r in shingle_groups.simhash_pairs(marked).collect()} == {(0, 1)}
    # The stage's groups come of them, even where no shingles meet.
    monkeypatch.setattr(shingle_groups, "meetings", lambda prefix, num, den: prefix.select("h", "row", "n", "at", *[F.lit(None).cast("long").alias(c) for c in ("hub", "before")]).limit(0))
    docs = texts.select(F.col("row").alias("doc_id"), F.col("text").cast("string").alias("text"))
    assert sorted(r["doc_id"] for r in corpus_pipeline.simhash_stage(spark, docs, SF).collect()) == [0, 2]
