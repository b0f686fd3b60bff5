"""Long words: cut and folded rank by rank, against the vocabulary's own library."""

from __future__ import annotations

import base64
import random
import time

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from lociframe.llm import bpe

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def library(ranks):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def encoded(spark, texts, path):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: np.frombuffer(bytes(r["token_ids"]), "<u4").tolist() for r in bpe.encode_decode(docs, path, public_tokenizers.PATTERN).collect()}


def long_words():
    pick = random.Random(5)
    letters = "abcdefghijklmnopqrstuvwxyz"
    return {
        "one letter, odd and even": "a" * 4_001 + " " + "a" * 4_096 + " " + "e" * 257,
        "two letters": "ab" * 3_000 + "ba" * 501,
        "four letters": "".join(pick.choices("ACGT", k=20_000)),
        "any letters": "".join(pick.choices(letters, k=20_000)),
        "words run together": "".join(pick.choices(["the", "quality", "of", "internationalization", "and", "straße", "niño"], k=4_000)),
        "other alphabets": "".join(pick.choices("абвгдежз漢字かな한국어", k=4_000)),
        "signs": "=" * 3_000 + "-=" * 900 + "\n" + "/" * 999,
        "spaces": " " * 5_000 + "x" + "\n" * 3_000,
        "the bound": "q" * bpe.LONG + " " + "q" * (bpe.LONG + 1) + " " + "xyz" * 85 + "x",
        "short and long in one": "a b " + "zq" * 400 + " c " + "zq" * 400 + " d",
    }


def test_long_words_equal_the_library(spark):
    lib = library(bpe.read_ranks(VOCABULARY))
    texts = list(long_words().values())
    found = encoded(spark, texts, VOCABULARY)
    for i, name in enumerate(long_words()):
        assert found[i] == lib.encode_ordinary(texts[i]), name


def test_word_of_a_megabyte(spark):
    lib = library(bpe.read_ranks(VOCABULARY))
    pick = random.Random(7)
    texts = ["".join(pick.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", k=1 << 20)), "a" * (1 << 20)]
    began = time.time()
    found = encoded(spark, texts, VOCABULARY)
    assert time.time() - began < 60
    assert [found[i] for i in range(2)] == [lib.encode_ordinary(t) for t in texts]


def lowest_first(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    parts = [word[i : i + 1] for i in range(len(word))]
    while True:
        pairs = [(ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)) if a + b in ranks]
        if not pairs:
            return [ranks[p] for p in parts]
        at = min(pairs)[1]
        parts[at : at + 2] = [parts[at] + parts[at + 1]]


@pytest.mark.parametrize("grow", [True, False])
def test_vocabularies_of_two_letters(spark, tmp_path, grow):
    """With ``ranks_grow`` and without: tokens dealt ranks by the length, or against it."""
    pick = random.Random(11)
    ranks = {bytes([b]): b for b in range(256)}
    more = [b"ab", b"ba", b"aa", b"aab", b"abab", b"aaaa", b"bba"] if grow else [b"abab", b"aaaa", b"ab", b"bab", b"aa", b"aab"]
    ranks |= {t: 256 + i for i, t in enumerate(more)}
    if grow:
        ranks = {t: r for t, r in ranks.items() if lowest_first(t, ranks) == [r]}
        ranks = {t: i for i, t in enumerate(ranks)}
    assert bpe.ranks_grow(ranks) == grow
    path = tmp_path / "ranks"
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % r for t, r in ranks.items()))
    texts = ["".join(pick.choices("ab", k=n)) for n in (257, 300, 400)] + ["a" * 333, "ab" * 150]
    found = encoded(spark, texts, str(path))
    assert [found[i] for i in range(len(texts))] == [lowest_first(t.encode(), ranks) for t in texts]


def test_pieces_join_to_the_word():
    tokens = [bytes([b]) for b in range(256)] + [b"ab", b"abc", b"cde"]
    cutter = bpe.Cutter(tokens)
    assert cutter.pieces(b"xxabcdeabx") == [b"x", b"x", b"abcde", b"ab", b"x"]
    word = bytes(random.Random(3).choices(b"abcdex", k=bpe.SLICE + 1_000))
    pieces = cutter.pieces(word)
    assert b"".join(pieces) == word and max(map(len, pieces)) < 40
