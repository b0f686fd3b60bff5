"""Pair pieces, pair ranks and lanes on worked cases and against plain rules."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from lociframe.operators import lanes, pairs
from lociframe.operators import reads as r

READ = "read_id long, qname string, flag int, contig string, start long, mapq int, cigar string, seq string"


def made(spark, reads, calls=None):
    parsed = r.parsed(spark.createDataFrame(reads, READ))
    refs = spark.createDataFrame([("c", "A" * 200)], "contig string, bases string")
    mods = spark.createDataFrame(calls, "read_id long, pos long, call_order int, code string, probability int") if calls else None
    found = pairs.pair_pieces(pairs.pairs(parsed), r.segments(parsed), r.mismatches(parsed, refs), mods)
    return [
        (x["start"], x["end"], x["kind"], x["base"], x["insertion_len"], x["arrows"], [tuple(m) for m in x["mismatches"]], [tuple(m) for m in x["modifications"]], x["conflicts"])
        for x in found.orderBy("pair_id", "piece_no").collect()
    ]


def pair(start_1, cigar_1, seq_1, start_2, cigar_2, seq_2):
    return [(1, "q", 99, "c", start_1, 60, cigar_1, seq_1), (2, "q", 147, "c", start_2, 60, cigar_2, seq_2)]


def test_one_read(spark):
    assert made(spark, [(1, "q", 0, "c", 10, 60, "1S3M2D2M", "GACAAA")]) == [
        (9, 9, "SoftClip", "G", None, [], [], [], []), (10, 12, "Match", None, None, [], [(11, "C")], [], []), (13, 14, "Deletion", None, None, [], [], [], []), (15, 16, "Match", None, None, ["Forward"], [], [], []),
    ]


def test_mates_apart(spark):
    assert made(spark, pair(10, "3M", "AAA", 20, "3M", "ACA")) == [(10, 12, "Match", None, None, ["Forward"], [], [], []), (13, 19, "PairGap", None, None, [], [], [], []), (20, 22, "Match", None, None, ["Reverse"], [(21, "C")], [], [])]
    # Side by side, and the second mate first.
    assert [x[:3] for x in made(spark, pair(10, "3M", "AAA", 13, "3M", "AAA"))] == [(10, 12, "Match"), (13, 15, "Match")]
    assert [x[:3] for x in made(spark, pair(20, "3M", "AAA", 10, "3M", "AAA"))] == [(10, 12, "Match"), (13, 19, "PairGap"), (20, 22, "Match")]


def test_mates_over_each_other(spark):
    calls = [(1, 11, 0, "m", 200), (1, 15, 1, "h", 9), (2, 15, 0, "m", 7)]
    found = made(spark, pair(10, "8M", "ACAAGTCA", 14, "6M", "GTAAGA"), calls)
    assert found == [
        (10, 13, "Match", None, None, [], [(11, "C")], [(11, "m", 200)], []),
        # At 14 and 15 both differ alike, at 16 one alone.
        (14, 17, "Match", None, None, ["Forward", "Reverse"], [(14, "G"), (15, "T"), (16, "C")], [(15, "h", 9), (15, "m", 7)], []),
        (18, 19, "Match", None, None, [], [(18, "G")], [], []),
    ]
    assert made(spark, pair(10, "4M", "ACGA", 10, "4M", "AGGA"))[0][6:] == ([(12, "G")], [], [11])


def test_kinds_and_insertions(spark):
    deletion = made(spark, pair(10, "3M2D3M", "AAAAAA", 10, "8M", "AAAAAAAA"))
    assert [(x[0], x[1], x[2], x[8]) for x in deletion] == [(10, 12, "Match", []), (13, 14, "PairOverlap", [13, 14]), (15, 17, "Match", [])]
    assert [x[5] for x in deletion] == [["Reverse"], [], ["Forward"]]
    insertion = lambda n, m: [(x[0], x[4], x[8]) for x in made(spark, pair(10, f"3M{n}I3M", "A" * (6 + n), 10, f"3M{m}I3M", "A" * (6 + m)))]
    assert insertion(2, 2) == [(10, None, []), (13, 2, [])]
    assert insertion(2, 1) == [(10, None, []), (13, None, [13])]
    one = made(spark, pair(10, "3M2I3M", "A" * 8, 10, "6M", "A" * 6))
    assert [(x[0], x[1], x[4], x[8]) for x in one] == [(10, 12, None, []), (13, 15, 2, [])]
    clips = made(spark, pair(10, "3M2S", "AAAGC", 10, "3M2S", "AAAGT"))
    assert [(x[0], x[2], x[3], x[8]) for x in clips] == [(10, "Match", None, []), (13, "SoftClip", "G", []), (14, "PairOverlap", None, [14])]


def test_unnamed_reads_meet_nobody(spark):
    reads = [(i, None, 99, "c", 10 + i, 60, "3M", "AAA") for i in range(50)] + [(60, "a", None, "c", 1, 60, "3M", "AAA"), (61, "a", 99, "c", 1, 60, "3M", "AAA"), (62, "a", 147, "c", 9, 60, "3M", "AAA"), (63, "a", 99 + 2048, "c", 5, 60, "3M", "AAA")]
    found = pairs.pairs(r.parsed(spark.createDataFrame(reads, READ)))
    assert sorted(((x["read_1"], x["read_2"]) for x in found.collect()), key=repr) == sorted([*((i, None) for i in range(50)), (60, None), (61, 62), (63, None)], key=repr)


def test_ranks_of_hidden_mates(spark):
    reads = r.parsed(spark.createDataFrame([(1, "q", 99, "c", 10, 9, "5M", "AAAAA"), (2, "q", 147, "c", 12, 60, "5M", "CCCCC"), (3, "s", 99, "c", 10, 9, "5M", "GGGGG"), (4, "t", 99, "c", 5, 9, "3M", "AAA"), (5, "t", 147, "c", 30, 9, "3M", "AAA")], READ))
    sites = pairs.pairs(reads).withColumn("p", F.lit(13))
    ranks = lambda rows: {x["pair_id"]: x["rank"] for x in pairs.pair_ranks(sites, rows).collect()}
    assert ranks(reads) == {1: 0, 3: 3, 4: 8}
    assert ranks(reads.withColumn("visible", F.col("mapq") > 20)) == {1: 2, 3: None, 4: 8}


def test_hidden_rows_take_no_lane(spark):
    rows = [(0, 1, 10, 10, 50, 0, False), (1, 1, 20, 20, 60, 1, True), (2, 1, 90, 90, 99, None, True), (3, 1, 90, 90, 99, None, None)]
    df = spark.createDataFrame(rows, "id long, region_id long, start long, s_start long, s_end long, rank int, visible boolean")
    assert sorted((x["id"], x["lane"], x["visible"]) for x in lanes.assign_lanes_sorted(df).collect()) == [(0, 0, False), (1, 0, True), (2, 0, True), (3, 0, False)]


def test_lane_index(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice("cd"), s, max(1, s - rng.randrange(4)), s + rng.randrange(60), rng.random() < 0.8) for i in range(800) for s in [rng.randrange(1, 2500)]]
    df = spark.createDataFrame(rows, "id long, contig string, start long, s_start long, s_end long, visible boolean")
    index = lanes.lane_index(lanes.assign_lanes(df), df)
    by_lane = {}
    for x in index.collect():
        by_lane.setdefault((x["contig"], x["lane"]), []).append((x["ordinal"], x["start"], x["id"], x["s_start"], x["s_end"]))
    assert {i for own in by_lane.values() for _, _, i, _, _ in own} == {x[0] for x in rows if x[5]}
    for own in by_lane.values():
        own.sort()
        assert [o for o, *_ in own] == list(range(1, len(own) + 1))
        assert [x[1:3] for x in own] == sorted(x[1:3] for x in own)
        spans = sorted(x[3:] for x in own)
        assert all(a[1] + lanes.READ_GAP < b[0] for a, b in zip(spans, spans[1:], strict=False))
    asked = [(k, rng.choice(["c", "d", None, "x"]), rng.choice([0, 1, 5, 99, None]), left, left + rng.randrange(80)) for k in range(300) for left in [rng.randrange(2600)]]
    found = lanes.first_in_lane(index, spark.createDataFrame(asked, "q long, contig string, lane int, left long, right long"), "q").collect()
    assert len(found) == 300
    for x in found:
        over = [i for _, _, i, a, b in by_lane.get((x["contig"], x["lane"]), []) if a <= x["right"] and b >= x["left"]]
        assert x["found"] == (over[0] if over else None)
