"""Token counts through a digest cache.

A text's digest and the tokenizer's are joined to stored counts; only distinct texts without one are encoded,
and their counts are appended to the cache. The cache is a Parquet table in the shared folder, one folder per
tokenizer digest, so another version of a vocabulary never meets its counts.

Of each distinct missing text, one row goes to the tokenizer. Digests, not texts, meet in the step that finds
these rows; the texts follow in one exchange by id, so a text that a third of all rows hold is encoded once. Rows that
are repeated with their ids lie together after that exchange, and a task encodes one of them.

A digest may come to the cache twice, by two jobs at a time or a job tried again after it failed to end; equal digests
have equal counts, so one of them is read.

Defined results: a null text counts as empty, with no tokens; long texts are encoded whole; rows with equal text share
one count, and repeated rows are returned as often as they come; an empty table gives an empty table and adds nothing to
the cache; extra columns are kept, whatever their names, but those named like a result are replaced.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections import Counter
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lociframe.llm.shared import materialize, named, packed, shared_dir, unpacked

BATCH_CHARS = 1 << 20  # texts encoded in one call of the tokenizer, which holds all their tokens
# Words whose counts a worker keeps, and the length up to which it does.
KEPT_WORDS, KEPT_CHARS = 1 << 18, 64
_BETWEEN_WORDS = re.compile(r"(?<=\S)(?= \S)")
_loaded: dict[str, object] = {}


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def _cuts_at_words(tokenizer: dict) -> bool:
    """Whether no token of this tokenizer reaches over a place between words, and none depends on what lies behind one.

    The byte-level pattern begins a match at a single space between two letters, digits or signs, whatever is around. Added
    tokens must not hold a space, or take one from their sides.
    """
    pre, added = tokenizer.get("pre_tokenizer") or {}, tokenizer.get("added_tokens") or []
    byte_level = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True)
    plain = all(" " not in t["content"] and not (t["lstrip"] or t["rstrip"] or t["single_word"]) for t in added)
    return bool(byte_level and plain and not tokenizer.get("normalizer") and not tokenizer.get("post_processor") and not tokenizer["model"].get("dropout"))


def _by_words(count: Callable[[list[str]], list[int]]) -> Callable[[list[str]], list[int]]:
    """``count`` of whole texts as sums over their words: the tokenizer encodes each word once that comes again, and the others of a text as one."""
    known: dict[str, int] = {}
    seen: set[str] = set()

    def run(texts: list[str]) -> list[int]:
        cut = [_BETWEEN_WORDS.split(x) for x in texts]
        new = []
        for word, n in Counter(chain.from_iterable(cut)).items():
            if word in known or len(word) > KEPT_CHARS:
                continue
            if n > 1 or word in seen:
                new.append(word)
            elif len(seen) < KEPT_WORDS:
                seen.add(word)
        new = new[: KEPT_WORDS - len(known)]
        known.update(zip(new, count(new), strict=True))
        found = [list(map(known.get, words)) for words in cut]
        # All but a text's first word begin with a space, so the others lie side by side as they did.
        others = count(["".join(w for w, n in zip(words, own, strict=True) if n is None) for words, own in zip(cut, found, strict=True)])
        return [sum(filter(None, own)) + n for own, n in zip(found, others, strict=True)]

    return run


def _counter(path: str):
    """Counts of a list of texts as the library gives them, without begin or end tokens."""
    if path not in _loaded:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            _loaded[path] = lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
        else:
            from tokenizers import Tokenizer

            tok = Tokenizer.from_file(path)
            tok.no_truncation()
            tok.no_padding()
            whole = lambda texts: [len(x) for x in tok.encode_batch_fast(texts, add_special_tokens=False)]
            _loaded[path] = _by_words(whole) if _cuts_at_words(json.loads(tok.to_str())) else whole
    return _loaded[path]


def _encode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(path)
        seen: set[bytes] = set()
        for b in batches:
            digests = b.column("digest").to_pylist()
            # Repeated rows lie in one task.
            new = [k for k, d in enumerate(digests) if not (d in seen or seen.add(d))]
            b = b.take(pa.array(new, pa.int64()))
            texts = b.column("_text").to_pylist()
            sizes, out, start = np.cumsum([len(x) for x in texts]), [], 0
            while start < len(texts):
                end = max(start + 1, int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + BATCH_CHARS)))
                out += count(texts[start:end])
                start = end
            yield pa.RecordBatch.from_arrays([b.column("digest"), pa.array(out, pa.int64())], ["digest", "n_tokens"])

    return run


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


CACHE_SCHEMA = T.StructType([T.StructField("digest", T.BinaryType()), T.StructField("n_tokens", T.LongType())])


def token_counts(docs: DataFrame, tokenizer: str, id: str = "doc_id", text: str = "text", limit: int = 1024, cache: str | None = None) -> DataFrame:
    """``docs`` with ``n_bytes``, ``n_tokens`` and ``over_limit``; fills the cache first (two jobs), then joins it."""
    spark = docs.sparkSession
    cache = f"{cache or shared_dir(spark) + '/token-counts'}/{tokenizer_digest(tokenizer)}"
    body = F.coalesce(named(text), F.lit(""))
    digest = F.unhex(F.sha2(body, 256))
    texts = docs.select(named(id).alias("_id"), body.alias("_text"), digest.alias("digest"))
    keys = texts.groupBy("digest").agg(F.min("_id").alias("_id"))
    if _exists(spark, cache):
        keys = keys.join(spark.read.schema(CACHE_SCHEMA).parquet(cache), "digest", "left_anti")
    # The id and the digest together pick one row of each missing text; rows repeated as a whole are dropped after.
    missing = texts.join(keys.withColumnRenamed("digest", "_d").withColumnRenamed("_id", "_i"), F.col("_id").eqNullSafe(F.col("_i")) & (F.col("digest") == F.col("_d")), "left_semi")
    missing.mapInArrow(_encode(tokenizer), CACHE_SCHEMA).dropDuplicates(["digest"]).write.mode("append").parquet(cache)
    # Written, so that the join can split a digest that many rows have.
    counts = materialize(spark.read.schema(CACHE_SCHEMA).parquet(cache).groupBy(F.col("digest").alias("stored")).agg(F.min("n_tokens").alias("n_tokens")), "token-counts-read")
    given = packed(docs, digest=digest, n_bytes=F.octet_length(body).cast("long"))
    counted = given.join(counts, F.col("digest") == F.col("stored"), "left").withColumn("over_limit", F.col("n_tokens") > limit)
    return unpacked(counted, "n_bytes", "n_tokens", "over_limit")
