"""Inputs that go beyond a chunk, an island or a contig."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from lociframe.functions import formats
from lociframe.operators import lanes
from lociframe.operators import reads as r

READ = "read_id long, qname string, flag int, contig string, start long, mapq int, cigar string, seq string"


def test_mismatches_beyond_a_chunk(spark):
    rng = random.Random(5)
    bases = "".join(rng.choices("ACGT", k=220_000))
    other = str.maketrans("ACGT", "CGTA")

    def seq(*spans, wrong=()):
        return "".join(bases[p - 1].translate(other) if p in wrong else bases[p - 1] for a, b in spans for p in range(a, b + 1))

    wrong = {65_536, 65_537, 69_632, 69_633, 74_999, 131_072, 131_073, 150_009, 219_999}
    rows = [
        (1, "long", 0, "c", 65_000, 60, "10000M", seq((65_000, 74_999), wrong=wrong)),
        (2, "spliced", 0, "c", 60_000, 60, "10M89990N10M", seq((60_000, 60_009), (150_000, 150_009), wrong=wrong)),
        (3, "through", 0, "c", 60_000, 60, "140000M", seq((60_000, 199_999), wrong=wrong)),
        (4, "over the end", 0, "c", 219_995, 60, "10M", seq((219_995, 220_000), wrong=wrong) + "AAAA"),
    ]
    found = r.mismatches(r.parsed(spark.createDataFrame(rows, READ)), spark.createDataFrame([("c", bases)], "contig string, bases string"))
    expected = {(i, p) for i, spans in ((1, [(65_000, 74_999)]), (2, [(60_000, 60_009), (150_000, 150_009)]), (3, [(60_000, 199_999)]), (4, [(219_995, 220_000)])) for a, b in spans for p in wrong if a <= p <= b}
    assert sorted((x["read_id"], x["pos"]) for x in found.collect()) == sorted(expected)
    assert found.where(F.col("base").isNull()).count() == 0


def test_lanes_of_a_large_island(spark):
    n = 1_000_500
    rows = spark.range(n).select("id", F.lit("c").alias("contig"), (F.col("id") + 1).alias("start"), (F.col("id") + 1).alias("s_start"), (F.col("id") + 2).alias("s_end"))
    # Each row starts within the gap of the one before; the fifth fits the first lane again.
    found = {x["lane"]: x["n"] for x in lanes.lane_counts(lanes.assign_lanes(rows)).collect()}
    assert found == {k: n // 5 for k in range(5)}


def by_the_rule(spans, gap):
    """Written from the rule alone: all lanes are tried for room on the left, then all for room on the right."""
    bounds, out = [], []
    for start, end in spans:
        left = [i for i, (a, _) in enumerate(bounds) if end + gap < a]
        right = [i for i, (_, b) in enumerate(bounds) if start > b + gap]
        if left:
            bounds[left[0]] = (start, bounds[left[0]][1])
            out.append(left[0])
        elif right:
            bounds[right[0]] = (bounds[right[0]][0], end)
            out.append(right[0])
        else:
            bounds.append((start, end))
            out.append(len(bounds) - 1)
    return out


def test_lanes_by_the_rule():
    assert lanes.first_fit([(10, 20), (15, 16), (50, 60), (30, 40)], 3) == by_the_rule([(10, 20), (15, 16), (50, 60), (30, 40)], 3)
    laid = lanes.Lanes(3)
    for span in ((10, 20), (50, 60)):
        laid.add(*span)
    assert laid.place(30, 40) == 1  # left of the second lane, although it also fits right of the first
    rng = random.Random(8)
    for n in range(300):
        spans = [(s := rng.randrange(400), s + rng.randrange(60)) for _ in range(n)]
        assert lanes.first_fit(spans, 3) == by_the_rule(spans, 3)


def test_hidden_rows_take_no_room(spark):
    df = spark.createDataFrame([(1, "c", 10, 10, 20, True), (2, "c", 11, 11, 90, False), (3, "c", 30, 30, 40, True), (4, "c", 31, 31, 40, None)], "id long, contig string, start long, s_start long, s_end long, visible boolean")
    laid = lanes.assign_lanes(df)
    assert sorted(map(tuple, laid.collect())) == [(1, 0, True), (2, 0, False), (3, 0, True), (4, 0, False)]
    assert [tuple(r) for r in lanes.lane_counts(laid).collect()] == [(0, 2)] and lanes.depth(laid).first()[0] == 1


def test_rank_takes_the_base_first(spark):
    flags = [("a", True, True), (None, True, True), (None, False, True), ("x", False, False), (None, False, False)]
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(flags)], "i int, base string, deletion boolean, insertion boolean")
    rank = lanes.base_rank(F.col("base"), F.col("deletion"), F.col("insertion"))
    assert [r["rank"] for r in df.select("i", rank.alias("rank")).orderBy("i").collect()] == [0, 6, 7, 5, None]


def test_sorted_lanes_name_their_region(spark):
    df = spark.createDataFrame([(1, g, 10, 10, 20, None) for g in (1, 2)], "id long, region_id long, start long, s_start long, s_end long, rank int")
    assert sorted((x["region_id"], x["id"], x["lane"]) for x in lanes.assign_lanes_sorted(df).collect()) == [(1, 1, 0), (2, 1, 0)]


def test_places_over_partitions(spark):
    values = [(k * 7919) % 5003 for k in range(5003)]
    df = spark.createDataFrame([(v,) for v in values], "id long")
    assert sorted((x["id"], x["place"]) for x in lanes.multi_key_places(df, [F.col("id").desc()]).collect()) == [(v, 5003 - v) for v in range(5003)]


def test_all_variants_are_described(spark, monkeypatch):
    from lociframe.plans import gene_queries

    given = [(1, "123.45"), (2, "1000000.00"), (3, "12345678.50"), (4, None), (6, "100.00")]
    rows = spark.createDataFrame(given, "idx long, q string").selectExpr("idx", "'c' as contig", "1L as pos", "'A' as ref", "'C' as alt", "cast(q as decimal(18, 2)) as qual")
    monkeypatch.setattr(gene_queries, "view", lambda *_: rows)
    found = {x["idx"]: x["text"].partition("QUAL=")[2] for x in gene_queries.fmt_variants(spark, "").collect()}
    assert found == {1: "123.45", 2: "1000000.0", 3: "12345678.5", 4: "?", 6: "100.0"}
    small = spark.createDataFrame([(0.00012,), (3e9,), (0.0,)], "x double").select(formats.plain_number(F.col("x")).alias("x"))
    assert [x["x"] for x in small.collect()] == ["0.00012", "3000000000.0", "0.0"]
