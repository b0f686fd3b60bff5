"""Line deduplication across documents, on DataFrame functions only.

Line hashes are range-partitioned by (hash, document) and sorted within the ranges by hash, document and position. A
window streams over that order and lets the first occurrence of a hash in each document through; these give each
range's totals, which an exchange of one row per hash and range adds up: how many documents hold a line, and which one
keeps it. The result per document is a run-length compressed keep bitmap: the runs of kept lines up to the last
dropped line, and the line after it. The text itself is only touched when a bitmap is applied.

Scale: ranges split by (hash, document), so a line in a third of all documents is spread over many partitions; totals
are pre-aggregated in each range; the join that marks the occurrences is a plain shuffle join, which adaptive execution
splits where one hash is hot.

Defined results: a null or empty text is one empty line and is kept; long texts are cut whole, and only their hashes
travel; rows with equal id are one document (each row is still returned); a null id is a document of its own, ordered
before all others; an empty table gives an empty table; extra columns pass through ``apply_keep``, but one named like a
result is replaced by it. No other name can clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociframe.llm.shared import let, lower_ascii, materialize, named, packed, unpacked


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, A-Z in lower case."""
    return lower_ascii(F.trim(line, F.lit(" \t\n\x0b\x0c\r")))


def _version(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def keep_bitmaps(docs: DataFrame, id: str = "doc_id", text: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """``(id, version, kept_runs, rest, n_dropped)`` for each document that loses lines; ``version`` is its text's hash.

    A key is compared by two independent 64-bit hashes.
    """
    body = F.coalesce(named(text), F.lit(""))
    lines = docs.select(named(id).alias("id"), _version(named(text)).alias("version"), F.posexplode(F.split(body, "\n")).alias("at", "line"))
    keys = (
        lines.withColumn("key", line_key(F.col("line")))
        .where(F.length("key") >= min_chars)
        .select("id", "version", "at", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), F.col("key")).alias("h2"))
    )
    # Hashes are written once: ranges are found by a sampling pass, and the rows are read again for the join.
    keys = materialize(keys, "line-keys")
    # The window needs no exchange, since a range holds all rows of a hash and document, and reads the ranges' order.
    ranges = keys.select("h1", "h2", "id", "at").repartitionByRange("h1", "h2", "id").sortWithinPartitions("h1", "h2", "id", "at")
    first = ranges.withColumn("nth", F.row_number().over(Window.partitionBy("h1", "h2", "id").orderBy("at"))).where("nth = 1")
    # One row per hash and range goes on. As a table, the result leaves the join below two plain inputs, so that
    # adaptive execution can split a hot hash.
    held = first.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("id").alias("keeper"))
    common = materialize(held.where(F.col("n_docs") >= min_docs).select("h1", "h2", "keeper"), "line-common")
    dropped = keys.join(common, ["h1", "h2"]).where(~F.col("id").eqNullSafe(F.col("keeper")))
    places = dropped.groupBy("id", "version").agg(F.sort_array(F.collect_set("at")).alias("gone"))
    return places.select(
        "id", "version", _kept_runs(F.col("gone")).alias("kept_runs"), (F.array_max("gone") + 1).alias("rest"), F.size("gone").alias("n_dropped")
    )


def _kept_runs(gone: Column) -> Column:
    """Sorted dropped places to the runs of kept lines between them."""
    before = lambda g, i: F.coalesce(F.get(g, i - 1), F.lit(-1))
    return let(
        gone,
        lambda g: F.filter(
            F.transform(g, lambda x, i: F.struct((before(g, i) + 1).alias("start"), (x - before(g, i) - 1).alias("n"))),
            lambda r: r.getField("n") > 0,
        ),
    )


def apply_keep(docs: DataFrame, bitmaps: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``kept_lines``, ``n_lines`` and ``n_dropped``, by a null-safe join on id and text version."""
    given = packed(docs, id=named(id), version=_version(named(text)))
    # Building a hash table of the small bitmaps spares sorting the texts.
    b = bitmaps.hint("shuffle_hash").select(F.col("id").alias("own"), F.col("version").alias("own_version"), F.col("kept_runs").alias("runs"), "rest", F.col("n_dropped").alias("gone"))
    joined = given.join(b, F.col("id").eqNullSafe(F.col("own")) & (F.col("version") == F.col("own_version")), "left")
    lines = F.split(F.coalesce(F.col("row").getField(text), F.lit("")), "\n")
    kept = let(
        lines,
        lambda line: F.concat(
            F.flatten(F.transform("runs", lambda r: F.slice(line, r.getField("start") + 1, r.getField("n")))),
            F.slice(line, F.col("rest") + 1, F.size(line)),
        ),
    )
    results = {"kept_lines": F.when(F.col("runs").isNull(), lines).otherwise(kept), "n_lines": F.size(lines).cast("long"), "n_dropped": F.coalesce("gone", F.lit(0)).cast("long")}
    return unpacked(joined.withColumns(results), *results)


def line_dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """``docs`` with the lines that stay, joined again in ``kept_text``, and ``n_lines``, ``n_dropped``; not with an input column ``kept_lines``."""
    out = apply_keep(docs, keep_bitmaps(docs, id, text, min_chars, min_docs), id, text)
    others = [named(c) for c in docs.columns if c.lower() not in ("kept_lines", "kept_text", "n_lines", "n_dropped")]
    return out.select(*others, F.array_join("kept_lines", "\n").alias("kept_text"), "n_lines", "n_dropped")
