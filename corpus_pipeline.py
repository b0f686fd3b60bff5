"""A training corpus from ``documents``: five stages, each written as Parquet and read again by the next.

Each stage takes ``(spark, docs, sf_dir)``. All but the last return the columns of ``documents``, whatever their names;
texts that a stage changes have their ``n_chars`` counted anew where the table has that column.

Defined results: null and empty texts have no words, so the quality rules drop them, while the other stages keep them;
long texts are taken whole; rows are judged one by one, and of rows with equal ids each that is kept stays a row of its
own, but for the near-duplicate stage, where one row of a group stays; an empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lociframe.llm import bpe, decontaminate, line_dedup, quality_rules, shingle_groups
from lociframe.llm.shared import materialize, packed, release, table


def _given(docs: DataFrame) -> DataFrame:
    """``row`` (all columns but the text), ``doc_id`` and ``text``, so that an operator's results can't be taken for columns of the table."""
    return packed(docs, "text", doc_id=F.col("doc_id"), text=F.col("text"))


def _with_text(judged: DataFrame, docs: DataFrame, text: Column) -> DataFrame:
    """The columns of ``docs`` from ``judged`` rows, with a new text."""
    kind = docs.schema["text"].dataType
    new = {"text": text.cast(kind)}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.length(text).cast(docs.schema["n_chars"].dataType)
    return judged.select(*[(new[c] if c in new else F.col("row").getField(c)).alias(c) for c in docs.columns])


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejected documents go; the others go on without the lines that failed."""
    return _with_text(quality_rules.quality_rules(_given(docs)).where("kept"), docs, F.col("clean_text"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that several documents share stay in one of them; a document left without text goes."""
    out = line_dedup.line_dedup(_given(docs))
    left = (F.col("n_dropped") == 0) | F.col("kept_text").rlike("[^\\x20\\x09-\\x0D]")
    return _with_text(out.where(left), docs, F.when(F.col("text").isNotNull(), F.col("kept_text")))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row stays of each group of texts whose 5-word shingles have a Jaccard similarity of 0.8 or more, that of the smallest id.

    SimHash finds the first candidates, an exact comparison confirms them, and shingles meet what SimHash can't find.
    """
    return shingle_groups.one_per_group(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; a document that is nothing else goes."""
    out = decontaminate.decontaminate(_given(docs), table(spark, sf_dir, "benchmark"))
    return _with_text(out, docs, F.col("text"))


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit) of each text, and whether they decode to it."""
    out = bpe.encode_decode(docs.select("doc_id", "text"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens", "token_ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_dedup_stage),
    ("simhash", simhash_stage),
    ("decontaminate", decontamination_stage),
    ("bpe", bpe_stage),
]

# The fold of merges and the connected groups have no plain SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; the tables of the stages before are deleted as soon as the next one is written."""
    docs = before = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = materialize(stage(spark, before, sf_dir), name)
        if k:
            release(before)
        before = docs
    return docs
