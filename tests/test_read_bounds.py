"""Bounds of reads from the CIGAR's text, and mates in one pass over the reads."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from lociframe.functions import reads as fr
from lociframe.operators import pairs
from lociframe.operators import reads as r


def test_bounds_from_text_are_those_of_operations(spark):
    rng = random.Random(2)
    odd = lambda: rng.choice(["", "Z", "*", "S", "7", "0", "00"]) if rng.random() < 0.15 else rng.choice(["0", "5", "00", "12", "3"]) + rng.choice("MIDNSHP=X")
    rows = [(rng.randrange(1, 30), "".join(odd() for _ in range(rng.randrange(7)))) for _ in range(5000)] + [(9, None), (9, "Z" * 20_000 + "4S7M"), (9, "0S0M" * 200 + "4S7M2S")]
    ops, start = F.col("ops"), F.col("start")
    found = r.parsed(spark.createDataFrame(rows, "start long, cigar string"))
    expected = found.select("*", fr.leading_clip(ops, start).alias("l"), fr.trailing_clip(ops, start).alias("t"), fr.reference_end(ops, start).alias("e"))
    assert expected.where("not (leading <=> l and trailing <=> t and end <=> e)").count() == 0
    assert expected.where("leading > 0 and trailing > 0").count() > 20


def test_bounds_and_pairs_make_no_operations(spark):
    reads = spark.createDataFrame([(1, "a", 1, "c", 5, "5S45M")], "read_id long, qname string, flag int, contig string, start long, cigar string")
    plan = pairs.pairs(r.parsed(reads))._jdf.queryExecution().optimizedPlan().toString()
    # The reads are taken once, and their operations aren't made for their bounds.
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") == 1 and "query_start" not in plan
