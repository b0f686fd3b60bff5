"""The first feature over a place, by plain comparison of all with all, and that no pairs are made."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lociframe.operators import genes
from lociframe.operators.joins import TOP, first_over

SPAN = "id long, contig string, start long, end long, rank long"


@pytest.mark.parametrize("length", [60, 5000, 3 * 4**TOP])
def test_first_over(spark, length):
    rng = random.Random(length)

    def make(n, wide):
        starts = [rng.randrange(-20, length) for _ in range(n)]
        return [(i, rng.choice(["c", "c", "d"]), s, s + rng.choice(wide), rng.randrange(30)) for i, s in enumerate(starts)]

    features = [*make(400, [0, 3, 4, 60, length // 7, length]), (900, None, 1, 5, 0), (901, "c", 9, 2, -1), (902, "c", None, 5, -1)]
    questions = [*make(300, [0, 1, 15, length // 5, length]), (-1, "c", 9, 2, 0), (-2, None, 1, 5, 0), (-3, "x", 1, 5, 0), (-4, "c", 1, 5, 0), (-4, "c", 1, 5, 0)]
    found = first_over(spark.createDataFrame(questions, SPAN), spark.createDataFrame(features, SPAN), "rank", "id")
    sound = [f for f in features if None not in f and f[2] <= f[3]]

    def least(c, s, e):
        return min(((f[4], f[0]) for f in sound if f[1] == c and s <= e and f[2] <= e and f[3] >= s), default=None)

    assert sorted((r["id"], r["found"] and tuple(r["found"])) for r in found.collect()) == sorted(((q[0], least(*q[1:4])) for q in questions), key=lambda x: x[0])


def largest_join(spark, df) -> int:
    """Rows of the largest join of a query that has run."""
    df.collect()
    nodes, most = [df._jdf.queryExecution().executedPlan()], 0
    while nodes:
        node = nodes.pop()
        metric = node.metrics().get("numOutputRows")
        if "Join" in node.nodeName() and metric.isDefined():
            most = max(most, metric.get().value())
        nodes += [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName() == "AdaptiveSparkPlan":
            nodes.append(node.executedPlan())
        elif "QueryStage" in node.nodeName():
            nodes.append(node.plan())
    return most


def test_a_deep_place_makes_no_pairs(spark):
    n = 3000
    deep = spark.range(n).select("id", F.concat(F.lit("g"), F.col("id")).alias("name"), F.lit("c").alias("contig"), (100 + F.col("id") % 5).alias("tx_start"), (900 - F.col("id") % 7).alias("tx_end"))
    loci = spark.range(n).select(F.col("id").alias("locus_id"), F.lit("c").alias("contig"), (500 + F.col("id") % 3).alias("position"))
    found = genes.gene_covering(loci, deep)
    # All with all would be nine million.
    assert largest_join(spark, found) <= 2 * n
    assert {r["gene_id"] for r in found.collect()} == {0}
