"""Joins whose results are far larger than both tables."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from lociframe.operators import genes
from lociframe.operators.joins import dealt_join, overlap_join, overlap_pairs

SPAN = "id long, contig string, start long, end long"


def _spans(seed, n):
    """Narrow, wide, inverted and null intervals, some of them twice."""
    rng = random.Random(seed)
    rows = [(i, rng.choice(["c", "d", None]), s, s + rng.choice([0, 5, 90, 3000, 9_000, -3, -70])) for i in range(n) for s in [rng.randrange(1, 4000)]]
    return [*rows, *rows[:20], (n, "c", None, 5), (n + 1, "c", 5, None)]


def test_pairs_equal_the_plain_join(spark):
    a, b = spark.createDataFrame(_spans(1, 150), SPAN), spark.createDataFrame(_spans(2, 170), SPAN)
    pairs = lambda df: sorted((x["id"], x["r_id"]) for x in df.collect())
    for levels in (1, 2, 3):
        assert pairs(overlap_pairs(a, b, 16, levels, cell=7)) == pairs(overlap_join(a, b, 16, levels=levels))
    assert overlap_pairs(a, b, 16).columns == overlap_join(a, b, 16).columns


def test_one_deep_bin_is_dealt_over_tasks(spark):
    """Small tables with many pairs, which a plain join puts into one task by their bytes."""
    a = spark.range(6000).select("id", F.lit("c").alias("contig"), F.lit(5).cast("long").alias("start"), F.lit(9).cast("long").alias("end"))
    out = overlap_pairs(a, a, 256).select(F.spark_partition_id().alias("p")).groupBy("p").count().collect()
    assert sum(x["count"] for x in out) == 36_000_000
    assert len(out) > 3 and max(x["count"] for x in out) < 18_000_000


def test_no_rows(spark):
    a = spark.createDataFrame([], SPAN)
    assert overlap_pairs(a, a).collect() == [] and dealt_join(a.select("id"), a.select("id", "start"), ["id"]).collect() == []


def test_genes_inside_regions(spark):
    regions = spark.createDataFrame([(1, "c", 100, 400), (2, "c", 300, 300), (3, "d", 1, 9999)], "region_id long, contig string, start long, end long")
    spans = [(1, "c", 100, 400), (2, "c", 99, 200), (3, "c", 300, 401), (4, "c", 300, 300), (5, "d", 7, 9000), (6, None, 7, 8), (7, "c", 310, 305)]
    made = spark.createDataFrame([(i, f"g{i}", c, s, e) for i, c, s, e in spans], "id long, name string, contig string, tx_start long, tx_end long")
    found = genes.genes_inside(regions, made, 16)
    assert sorted((x["region_id"], x["r_id"], x["r_start"], x["r_end"]) for x in found.collect()) == [(1, 1, 100, 400), (1, 4, 300, 300), (1, 7, 310, 305), (2, 4, 300, 300), (3, 5, 7, 9000)]
