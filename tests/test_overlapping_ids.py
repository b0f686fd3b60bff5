"""Ids of overlapping intervals, many of which are equal."""

from __future__ import annotations

from pyspark.sql import functions as F
from test_pair_joins import SPAN, _spans

from lociframe.operators import joins
from lociframe.operators.joins import overlap_join, overlapping_ids
from lociframe.operators.tables import alike


def test_ids_equal_the_plain_join_and_equal_intervals_meet_once(spark, monkeypatch):
    a, b = (spark.createDataFrame(_spans(seed, n), SPAN) for seed, n in ((1, 150), (2, 170)))
    # Each interval thirty times, under ids of its own.
    b = b.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(29)))).withColumn("id", F.col("id") + 1000 * F.col("k")).drop("k")
    given, meet = [], joins.overlap_pairs
    monkeypatch.setattr(joins, "overlap_pairs", lambda x, y, *r, **k: (given.append(y.count()), meet(x, y, *r, **k))[1])
    found = overlapping_ids(a.withColumnRenamed("id", "one"), b.withColumnRenamed("id", "two"), "one", "two", 16)
    assert sorted(map(tuple, found.collect())) == sorted((x["id"], x["r_id"]) for x in overlap_join(a, b, 16).collect())
    assert given[0] <= 171


def test_arrays_are_bounded(spark):
    df = spark.range(23).withColumn("contig", F.lit("c"))
    found = alike(df, ["contig"], "id", 5).collect()
    assert sorted(len(x["ids"]) for x in found) == [3, 5, 5, 5, 5] and sorted(i for x in found for i in x["ids"]) == list(range(23))
