"""Reference sequence access."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociframe.operators.reads import CHUNK, reference_chunks


def bases_at(sites: DataFrame, sequences: DataFrame, size: int = CHUNK) -> DataFrame:
    """``sites`` (``contig, position``) with ``base``; null outside."""
    c = reference_chunks(sequences, size, 0).select(F.col("contig").alias("_c"), F.col("chunk_no").alias("_n"), "chunk_start", F.col("bases").alias("_b"))
    joined = sites.join(c, (F.col("contig") == F.col("_c")) & (F.floor((F.col("position") - 1) / size) == F.col("_n")), "left")
    at = (F.col("position") - F.col("chunk_start") + 1).cast("int")
    return joined.withColumn("base", F.nullif(F.substring("_b", at, F.lit(1)), F.lit(""))).drop("_c", "_n", "chunk_start", "_b")


def region_sequences(regions: DataFrame, sequences: DataFrame, size: int = CHUNK, complete: bool = True) -> DataFrame:
    """``region_id, bases`` of regions; ``complete`` gives null where part of a region isn't there, else what there is, ``''`` at least."""
    return cut_regions(regions, reference_chunks(sequences, size, 0), size, complete)


def cut_regions(regions: DataFrame, chunks: DataFrame, size: int = CHUNK, complete: bool = True) -> DataFrame:
    """``region_sequences`` from chunks of ``size`` bases (``contig, chunk_no, chunk_start, bases``), such as those of an indexed file."""
    c = chunks.select(F.col("contig").alias("_c"), F.col("chunk_no").alias("_n"), "chunk_start", F.col("bases").alias("_b"))
    wanted = regions.select("*", F.explode(F.sequence(F.floor((F.greatest("start", F.lit(1)) - 1) / size), F.floor((F.col("end") - 1) / size))).alias("_k"))
    joined = wanted.join(c, (F.col("contig") == F.col("_c")) & (F.col("_k") == F.col("_n")))
    first = F.greatest(F.col("start") - F.col("chunk_start") + 1, F.lit(1)).cast("int")
    n = (F.col("end") - F.col("chunk_start") + 1 - first + 1).cast("int")
    piece = F.substring("_b", first, F.greatest(n, F.lit(0)))
    whole = joined.groupBy("region_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_k", piece.alias("p")))), lambda x: x["p"]), "").alias("bases"))
    out = regions.join(whole, "region_id", "left")
    if complete:
        return out.select("region_id", F.when(F.length("bases") == F.col("end") - F.col("start") + 1, F.col("bases")).alias("bases"))
    return out.select("region_id", F.coalesce("bases", F.lit("")).alias("bases"))


def base_listing(regions: DataFrame, sequences: DataFrame, size: int = CHUNK) -> DataFrame:
    """``region_id, position, text`` with ``position: base`` for each base of a region."""
    found = region_sequences(regions, sequences, size, complete=False).join(regions.select("region_id", "start"), "region_id")
    bases = found.where(F.length("bases") > 0).select("region_id", "start", F.posexplode(F.split("bases", "")).alias("p", "base")).where("base <> ''")
    position = F.greatest(F.col("start"), F.lit(1)) + F.col("p")
    return bases.select("region_id", position.alias("position"), F.concat_ws(": ", position.cast("string"), "base").alias("text"))
