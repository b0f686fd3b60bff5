"""Spelling variants against all pairs of words."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from lociframe.llm import spelling


def near(a, b):
    """Whether one code point inserted, deleted or replaced makes ``a`` into ``b``."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if abs(len(a) - len(b)) != 1:
        return False
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute(counts):
    forms, out = {}, {}
    for w, n in counts.items():
        around = [(-counts[o], o) for o in counts if o != w and near(w, o)]
        m, o = min(around, default=(0, None))
        forms[w] = (o, -m) if o is not None and -m >= 2 * n else (None, None)
        out[w] = len(around)
    rows = []
    for w, n in counts.items():
        root = w
        while forms[root][0] is not None:
            root = forms[root][0]
        rows.append((w, n, forms[w][0], root, out[w], forms[w][1]))
    return sorted(rows, key=repr)


@pytest.mark.parametrize("alphabet", ["ab", "abcé", "aàÿz"])
def test_against_all_pairs(spark, alphabet):
    rng = random.Random(len(alphabet))
    counts = {"".join(rng.choices(alphabet, k=rng.randint(5, 8))): rng.choice([3, 3, 4, 7, 8, 16, 32, 64, 200]) for _ in range(150)}
    # Runs of equal letters and a chain of forms.
    counts |= {"a" * k: 3 * 2 ** (k - 5) for k in range(5, 12)} | {"zzzzz": 3, "lonely": 5}
    df = spark.createDataFrame([(w, n, 1) for w, n in counts.items()], "word string, n long, form int").repartition(6)
    found = [tuple(r) for r in spelling.variants(df).collect()]
    assert sorted(found, key=repr) == brute(counts)


def test_counts(spark):
    rng = random.Random(2)
    vocabulary = ["Maison", "maison", "ÉCOLES", "écoles", "straße", "don't-stop", "x" * 4, "y" * 6, "naïveté", "word_with9digits", "Ωmega"]
    texts = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(0, 400))), i, "k") for i in range(60)]
    texts += [(60, None, 1, "k"), (61, "", 1, "k"), (None, "abcdefgh " * 5, 1, "k"), (62, "abcdefgh " * 60000, 1, "k"), (3, texts[3][1], 1, "k")]
    expected = Counter()
    for i, text, *_ in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 97 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= 5:
                expected[run] += 1
    df = spark.createDataFrame(texts, "doc_id long, text string, n long, word string").repartition(4)
    assert {r["word"]: r["n"] for r in spelling.counted(df, changed=spelling.misspelt).collect()} == expected
    plain = {r["word"]: r["n"] for r in spelling.counted(df).collect()}
    assert plain["abcdefgh"] == 60005


def test_neighbours_are_not_paired(spark):
    """A run of k words that differ in one place gives k rows, not k * k."""
    words = spark.createDataFrame([(f"ab{chr(c)}de", 3) for c in range(ord("a"), ord("z") + 1)], "word string, n long")
    found = {r["word"]: r for r in spelling.neighbours(words).collect()}
    assert len(found) == 26
    assert {r["n_near"] for r in found.values()} == {25}
    assert found["abade"]["best"]["word"] == "abbde"
    assert found["abcde"]["best"]["word"] == "abade"


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variants(spelling.counted(docs)).count() == 0
