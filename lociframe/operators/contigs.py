"""Contig dictionary: aliases, resolution, merging, order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociframe.operators.tables import kept

BARE = (*map(str, range(1, 23)), "X", "Y", "MT")


def generated_aliases(name: Column) -> Column:
    """``chr`` added to the bare human names, taken off those that have it; else none."""
    bare = F.substring(name, F.lit(4), F.length(name))
    return (
        F.when(name.isin(*BARE), F.array(F.concat(F.lit("chr"), name)))
        .when(name.startswith("chr") & bare.isin(*BARE), F.array(bare))
        .otherwise(F.array().cast("array<string>"))
    )


def with_aliases(contigs: DataFrame, aliases: DataFrame | None) -> DataFrame:
    """``name, length, aliases`` from a contig and an alias table (``alias, chrom``); names like ``chr1_x`` are left out."""
    kept = contigs.where(~F.col("name").rlike("^chr.*_"))
    if aliases is None:
        return kept.select("name", "length", F.array().cast("array<string>").alias("aliases"))
    a = aliases.groupBy(F.col("chrom").alias("_c")).agg(F.sort_array(F.collect_set("alias")).alias("aliases"))
    return kept.join(a, F.col("name") == F.col("_c"), "left").select("name", "length", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"))


def resolve(names: DataFrame, contigs: DataFrame, column: str = "contig") -> DataFrame:
    """``names`` with ``resolved``, the contig of that name or alias; null where unknown. A name goes before an alias."""
    every = contigs.select(F.col("name").alias("_contig"), F.posexplode(F.concat(F.array("name"), "aliases")).alias("_p", "_name"))
    first = every.groupBy("_name").agg(F.min_by("_contig", F.struct(F.col("_p") > 0, "_contig")).alias("resolved"))
    return names.join(first, F.col(column) == F.col("_name"), "left").drop("_name")


def require_resolved(resolved: DataFrame, column: str = "contig") -> DataFrame:
    """The rows as they are; a task that meets an unknown name raises."""
    error = F.raise_error(F.concat(F.lit("unknown contig "), F.coalesce(column, F.lit("null"))))
    return resolved.withColumn("resolved", F.when(F.col("resolved").isNull(), error).otherwise(F.col("resolved")))


def _labelled(rows: DataFrame) -> DataFrame:
    """``rows`` with ``canonical``, the first (source, name) among all rows that names and aliases lead to.

    Labels spread from rows to names and back, and each row also takes its label's own label, until none changes: a round
    is kept, and only whether there was a change comes to the driver.
    """
    me = F.struct("source_rank", "name")
    named = rows.select(me.alias("me"), F.explode(F.array_distinct(F.array_compact(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>")))))).alias("any")).distinct()
    labels = kept(named.select("me", F.col("me").alias("label")).distinct())
    while True:
        met = named.join(labels, "me")
        least = met.groupBy("any").agg(F.min("label").alias("least"))
        near = named.join(least, "any").groupBy("me").agg(F.min("least").alias("near"))
        ahead = labels.select(F.col("me").alias("near"), F.col("label").alias("far"))
        moved = near.join(ahead, "near", "left").select("me", F.least("near", "far").alias("label"))
        changed = kept(labels.withColumnRenamed("label", "before").join(moved, "me").withColumn("changed", F.col("label") != F.col("before")))
        labels = changed.select("me", "label")
        if not changed.where("changed").limit(1).count():
            return rows.withColumn("_me", me).join(labels, F.col("_me") == F.col("me")).withColumn("canonical", F.col("label")).drop("_me", "me", "label")


def merge_sources(rows: DataFrame) -> DataFrame:
    """One row per contig of several sources (``source_rank, name, length, aliases``).

    Rows that share a name or an alias are one contig, as are chains of such rows of any length. The first name stays,
    the last length that isn't null counts, aliases are united with the other names met, names are kept by source.
    """
    canonical = _labelled(rows)
    rank = F.col("source_rank")
    source = lambda k: F.max(F.when(rank == k, F.col("name")))
    merged = canonical.groupBy("canonical").agg(
        F.min_by("name", F.struct(rank, "name")).alias("name"),
        F.max_by("length", F.when(F.col("length").isNotNull(), rank)).alias("length"),
        F.sort_array(F.array_compact(F.array_distinct(F.concat(F.flatten(F.collect_list("aliases")), F.collect_list("name"))))).alias("every"),
        source(0).alias("track_name"), source(1).alias("sequence_name"), source(2).alias("alignment_name"),
    )
    return merged.select("name", "length", F.array_remove("every", F.col("name")).alias("aliases"), "track_name", "sequence_name", "alignment_name")


def natural_order(name: Column, length: Column) -> list[Column]:
    """``orderBy`` columns: ``chr`` names first, numbers by value, then X, Y, M, others as text; names without ``chr`` by length, longest first."""
    rest = F.substring(name, F.lit(4), F.length(name))
    is_chr = name.startswith("chr")
    number = rest.try_cast("int")
    rank = F.when(number.isNotNull(), 0).when(rest == "X", 1).when(rest == "Y", 2).when(rest.isin("M", "MT"), 3).otherwise(4)
    return [(~is_chr).asc(), F.when(is_chr, rank).asc(), F.when(is_chr, number).asc_nulls_last(), F.when(~is_chr, -F.coalesce(length, F.lit(0))).asc(), name.asc()]


def indexed(contigs: DataFrame) -> DataFrame:
    """``contigs`` with ``contig_index`` in natural order; a contig dictionary is small, so one task numbers it."""
    return contigs.withColumn("contig_index", (F.row_number().over(Window.orderBy(*natural_order(F.col("name"), F.col("length")))) - 1).cast("long"))


def neighbour(contigs: DataFrame, k: int) -> DataFrame:
    """``name, neighbour``: the contig k places on (or back), around the end."""
    n = contigs.agg(F.count(F.lit(1)).alias("n"))
    moved = contigs.join(F.broadcast(n)).select("name", F.pmod(F.col("contig_index") + k, F.col("n")).alias("_to"))
    return moved.join(contigs.select(F.col("contig_index").alias("_i"), F.col("name").alias("neighbour")), F.col("_to") == F.col("_i")).select("name", "neighbour")


def same_contig(names_a: Column, names_b: Column) -> Column:
    """Whether two arrays of name and aliases share one."""
    return F.arrays_overlap(names_a, names_b)
