"""Pieces of pairs from the reads alone, against those from tables of segments and mismatches."""

from __future__ import annotations

import random

from test_pair_shuffles import exchanges

from lociframe import catalog
from lociframe.operators import pairs
from lociframe.operators import reads as r

SF = "/root/testdata/sf0.001"


def test_pieces_equal_those_of_the_tables(spark):
    rng = random.Random(11)
    bases = "".join(rng.choice("ACGTacgN") for _ in range(90))
    cigars = ["10M", "3S7M", "4M2I4M", "3M2D5M2S", "2H3S2M1X1P2I3M1H", "4M3N2=2X2S", "6S4M", "10M3I", "2I8M", "30M", "*", None]
    rows = []
    for i in range(400):
        seq = rng.choice(["".join(rng.choice("ACGTNa") for _ in range(10))] * 8 + [bases[20:30], "ACG"])
        rows.append((i, rng.choice([f"n{i // 4}", "same", "7", None]), rng.choice(["c", "c", "c", "d"]), rng.randrange(1, 80), rng.choice(cigars), seq, rng.choice([1, 1, 17, 81, 257, 0])))
    reads = r.parsed(spark.createDataFrame(rows, "read_id long, qname string, contig string, start long, cigar string, seq string, flag int"))
    sequences = spark.createDataFrame([("c", bases)], "contig string, bases string")
    expected = pairs.pair_pieces(pairs.pairs(reads), r.segments(reads), r.mismatches(reads, sequences)).drop("modifications")
    # Chunks of 7 bases, so that a read takes its span from several.
    found = pairs.read_pair_pieces(reads, sequences, size=7)
    assert found.columns == expected.columns
    assert sorted(map(repr, found.collect())) == sorted(map(repr, expected.collect()))


def test_neither_segments_nor_mismatches_travel(spark):
    reads = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert sum(n for _, n in exchanges(catalog.QUERIES["pr_pieces"](spark, SF))) < 1.5 * reads
