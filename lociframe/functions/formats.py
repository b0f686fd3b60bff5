"""Texts of loci, variants, intervals and lengths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociframe.operators.contigs import resolve
from lociframe.operators.genes import genes_by_name


def plain_number(x: Column) -> Column:
    """A double without an exponent, with one decimal at least; below 1e-17 and from 1e20 on as Spark writes it."""
    size = F.abs(x.cast("double"))
    plain = F.regexp_replace(x.cast("double").cast("decimal(38, 18)").cast("string"), "(\\.[0-9]+?)0+$", "$1")
    return F.when((size >= 1e-17) & (size < 0.001) | (size >= 1e7) & (size < 1e20), plain).otherwise(x.cast("string"))


def describe_variant(contig: Column, pos: Column, ref: Column, alt: Column, qual: Column) -> Column:
    """``alt`` is an array; the missing alternative ``.`` is left out, missing quality is ``?``."""
    alts = F.array_join(F.filter(alt, lambda a: a != "."), ",")
    return F.concat(F.lit("Variant: "), contig, F.lit(":"), pos.cast("string"), F.lit(" "), ref, F.lit(">"), alts, F.lit(" QUAL="), F.coalesce(plain_number(qual), F.lit("?")))


def describe_interval(contig: Column, start: Column, end: Column) -> Column:
    return F.concat(F.lit("BED interval: "), contig, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))


def short_length(n: Column) -> Column:
    """bp, kb, Mb, Gb or Tb, by division without remainder."""
    text = F.when(n < 1000, F.concat(n.cast("string"), F.lit("bp")))
    for power, unit in ((3, "kb"), (6, "Mb"), (9, "Gb")):
        text = text.when(n < 10 ** (power + 3), F.concat(F.floor(n / 10**power).cast("string"), F.lit(unit)))
    return text.otherwise(F.concat(F.floor(n / 10**12).cast("string"), F.lit("Tb")))


def locus_text(contig: Column, position: Column) -> Column:
    return F.concat(contig, F.lit(":"), position.cast("string"))


def round_up_depth(x: Column) -> Column:
    """At least 10, rounded up to two significant digits."""
    low = F.greatest(x.cast("long"), F.lit(10).cast("long"))
    unit = F.pow(F.lit(10), F.length(low.cast("string")) - 2).cast("long")
    return (F.floor((low + unit - 1) / unit) * unit).cast("long")


def parse_loci(texts: DataFrame, contigs: DataFrame, genes: DataFrame) -> DataFrame:
    """``texts`` (``text``) with ``kind`` (position, locus, gene, error), ``contig, position``.

    ``contig:position`` with a known contig or alias, a bare number, else a gene's name.
    """
    parts = F.split("text", ":")
    n = F.size(parts)
    split = texts.withColumns({"_c": F.when(n == 2, F.get(parts, F.lit(0))), "_p": F.when(n == 2, F.get(parts, F.lit(1)).try_cast("long")).when(n == 1, F.col("text").try_cast("long")), "_parts": n})
    located = resolve(split, contigs, "_c").withColumn("name", F.when((F.col("_parts") == 1) & F.col("_p").isNull(), F.col("text")))
    found = genes_by_name(located, genes)
    kind = F.when((F.col("_parts") == 1) & F.col("_p").isNotNull(), "position").when(F.col("resolved").isNotNull() & F.col("_p").isNotNull(), "locus").when(F.col("gene_id").isNotNull(), "gene").otherwise("error")
    return found.withColumn("kind", kind).select(
        *texts.columns,
        "kind",
        F.when(F.col("kind") == "locus", F.col("resolved")).when(F.col("kind") == "gene", F.col("contig")).alias("contig"),
        F.when(F.col("kind").isin("position", "locus"), F.col("_p")).when(F.col("kind") == "gene", F.col("position")).alias("position"),
    )
