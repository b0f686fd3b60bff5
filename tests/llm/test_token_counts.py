"""Distinct misses only go to the tokenizer."""

from __future__ import annotations

import pyarrow as pa
import public_tokenizers

from lociframe.llm import token_counts


def test_repeated_texts_are_encoded_once(spark, tmp_path, monkeypatch):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = [(1, "same text")] * 300 + [(k, "same text") for k in range(2, 200)] + [(7, "another"), (7, "another"), (None, "third"), (None, None), (8, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    cache = f"file://{tmp_path}/cache"
    out = token_counts.token_counts(df, path, cache=cache).collect()
    assert len(out) == len(rows)
    assert len({r["n_tokens"] for r in out if r["text"] == "same text"}) == 1
    stored = spark.read.parquet(f"{cache}/{token_counts.tokenizer_digest(path)}")
    assert stored.count() == stored.select("digest").distinct().count() == 4
    # In a task, of equal digests one goes to the tokenizer.
    sent = []
    monkeypatch.setitem(token_counts._loaded, "own", lambda texts: [sent.append(t) or 1 for t in texts])
    batch = pa.RecordBatch.from_pydict({"_id": [1] * 500, "_text": ["x"] * 500, "digest": [b"d"] * 500})
    found = list(token_counts._encode("own")(iter([batch, batch])))
    assert sent == ["x"] and sum(b.num_rows for b in found) == 1


def test_a_filled_cache_is_used(spark, tmp_path):
    path = public_tokenizers.path("byte_bpe_50k.json")
    cache = f"file://{tmp_path}/cache"
    first = spark.createDataFrame([(k, f"text number {k % 5}") for k in range(50)], "doc_id long, text string")
    more = spark.createDataFrame([(k, f"text number {k % 7}") for k in range(50)], "doc_id long, text string")
    a = {r["text"]: r["n_tokens"] for r in token_counts.token_counts(first, path, cache=cache).collect()}
    b = {r["text"]: r["n_tokens"] for r in token_counts.token_counts(more, path, cache=cache).collect()}
    assert len(b) == 7 and all(b[t] == n for t, n in a.items())
    assert spark.read.parquet(f"{cache}/{token_counts.tokenizer_digest(path)}").count() == 7


def test_words_give_the_counts_of_whole_texts(monkeypatch):
    import random

    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    monkeypatch.setattr(token_counts, "KEPT_WORDS", 50)
    token_counts._loaded.pop(path, None)
    count, whole = token_counts._counter(path), Tokenizer.from_file(path)
    rng = random.Random(4)
    parts = [*" \t\n\x1c\x85　'sABcé12.,€|<>", "  ", " the", " word", "'s ", " 're", "<|endoftext|>", " <|endoftext|> ", "x" * 70]
    for _ in range(20):
        texts = ["".join(rng.choices(parts, k=rng.randrange(40))) for _ in range(100)]
        assert count(texts) == [len(x) for x in whole.encode_batch_fast(texts, add_special_tokens=False)]


def test_a_word_that_comes_again_is_encoded_once():
    sent = []
    count = token_counts._by_words(lambda texts: [sent.append(t) or len(t) for t in texts])
    texts = ["one two", "three two", "one two two"]
    assert count(texts) == [len(t) for t in texts] and "".join(sent).count(" two") == 1
    assert count(["one two"]) == [7] and "".join(sent).count(" two") == 1
