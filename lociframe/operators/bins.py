"""Equal-width bins and binned coverage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociframe.functions.formats import round_up_depth
from lociframe.operators.joins import overlap_join


def equal_bins(regions: DataFrame, n: Column) -> DataFrame:
    """``region_id, contig, bin, start, end``: ``n`` bins per region, by integer division; an error for no bins, an inverted region, or more bins than positions."""
    size = F.col("end") - F.col("start") + 1
    checked = F.when(n <= 0, F.raise_error(F.lit("no bins"))).when(size < 1, F.raise_error(F.lit("region ends before its start"))).when(n > size, F.raise_error(F.lit("more bins than positions"))).otherwise(n.cast("long"))
    numbered = regions.select("region_id", "contig", F.col("start").alias("_s"), size.alias("_l"), checked.alias("_n")).withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    edge = lambda i: F.col("_s") + F.floor(i * F.col("_l") / F.col("_n"))
    return numbered.select("region_id", "contig", "bin", edge(F.col("bin")).alias("start"), (edge(F.col("bin") + 1) - 1).alias("end"))


def binned_coverage(regions: DataFrame, pileup: DataFrame, n: Column, bin_size: int = 1 << 14) -> DataFrame:
    """``region_id, bin, total``: totals summed per bin, 0 for empty ones. The bin follows from the position by arithmetic."""
    sized = regions.withColumns({"_l": F.col("end") - F.col("start") + 1, "_n": n.cast("long")})
    sites = pileup.select("contig", F.col("pos").alias("start"), F.col("pos").alias("end"), "total")
    hits = overlap_join(sized, sites, bin_size, levels=1)
    # The last bin whose start isn't over the position.
    offset = F.col("r_start") - F.col("start")
    at = F.floor(((offset + 1) * F.col("_n") - 1) / F.col("_l"))
    sums = hits.groupBy("region_id", at.alias("bin")).agg(F.sum("r_total").alias("total"))
    return equal_bins(regions, n).select("region_id", "bin").join(sums, ["region_id", "bin"], "left").withColumn("total", F.coalesce("total", F.lit(0).cast("long")))


def depth_scale(binned: DataFrame) -> DataFrame:
    """``region_id, scale``: the largest bin, at least 10, rounded up to two significant digits."""
    return binned.groupBy("region_id").agg(round_up_depth(F.max("total")).alias("scale"))


def load_statistics(reads: DataFrame, laid: DataFrame) -> DataFrame:
    """``contig, n_reads, n_lanes``: all ``reads`` of a contig, and its lanes in ``laid`` (``contig, lane``). Both are counted by contig before they meet."""
    most = laid.groupBy(F.col("contig").alias("_c")).agg((F.max("lane") + 1).alias("n_lanes"))
    counted = reads.groupBy("contig").agg(F.count(F.lit(1)).alias("n_reads"))
    return counted.join(most, F.col("contig") == F.col("_c"), "left").select("contig", "n_reads", F.coalesce("n_lanes", F.lit(0)).alias("n_lanes"))
