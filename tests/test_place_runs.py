"""Reads over places: what they send between tasks, and runs of the rows of a place."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F
from test_pair_shuffles import exchanges

from lociframe.operators import lanes, tables
from lociframe.operators import reads as r
from lociframe.plans import layout_queries


def test_filled_lanes_are_those_added():
    rng = random.Random(3)
    for n in (0, 1, 5, 8):
        spans = [(s, s + rng.randrange(30)) for s in (rng.randrange(100) for _ in range(n))]
        one, all_ = lanes.Lanes(3), lanes.Lanes.filled(3, *np.array(spans, np.int64).reshape(-1, 2).T)
        for span in spans:
            one.add(*span)
        more = [(s, s + 9) for s in (rng.randrange(200) for _ in range(40))]
        assert [one.place(*x) for x in more] == [all_.place(*x) for x in more]


def test_runs_of_a_deep_place_equal_the_rows(spark, monkeypatch):
    """Runs end in the midst of a rank and of a batch, and reads in the midst of equal ones."""
    rng = random.Random(5)
    rows = [(i, "c", 7, s, max(1, s - 2), s + rng.randrange(9), rng.choice([0, 0, 2, None]), rng.choice([True, True, False, None])) for i in range(700) for s in [rng.randrange(1, 5)]]
    df = spark.createDataFrame(rows, "id long, contig string, p long, start long, s_start long, s_end long, rank int, visible boolean").repartition(3, "contig")
    monkeypatch.setattr(lanes, "RUN", 9)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        for given in (df, df.drop("visible")):
            shown = [c for c in ("visible",) if c in given.columns]
            runs = lanes.assign_lanes_sorted(given, group=["contig", "p"], runs=True)
            each = runs.select("*", F.posexplode("ids").alias("n", "id"))
            lane = F.when(F.col("lanes").isNull(), F.col("first") + F.col("n")).otherwise(F.get("lanes", F.col("n")))
            found = each.select("id", lane.cast("int").alias("lane"), *shown)
            assert runs.agg(F.max(F.size("ids"))).first()[0] == 9
            expected = lanes.assign_lanes_sorted(given, group=["contig", "p"]).select("id", "lane", *shown)
            assert sorted(map(tuple, found.collect())) == sorted(map(tuple, expected.collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_equal_reads_over_a_place_are_cut_into_runs(spark):
    reads = spark.createDataFrame([(i, "c", 5, "4M2D3M", "ACGTACG") for i in range(23)], "read_id long, contig string, start long, cigar string, seq string")
    places = spark.createDataFrame([("c", 5), ("c", 9), ("c", 12), ("d", 5)], "contig string, p long")
    found = sorted((x["p"], x["read_id"], x["rank"]) for x in r.over_places(reads, places, size=4, most=5).collect())
    assert found == sorted((p, i, rank) for p, rank in ((5, 0), (9, 6), (12, 2)) for i in range(23))


def test_reads_over_loci_are_dealt_once_and_not_by_place(spark, monkeypatch):
    """Pairs of places and reads are neither dealt out nor kept one by one."""
    sizes = []
    monkeypatch.setattr(layout_queries, "kept", lambda df: (sizes.append((exchanges(df), df.count())), tables.kept(df))[1])
    for query in (layout_queries.so_base_at, layout_queries.ln_sorted, layout_queries.ln_sorted_visible):
        rows = query(spark, "/root/testdata/sf0.001").count()
        dealt, runs = sizes.pop()
        reads = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count()
        assert max(n for _, n in dealt) < 1.5 * reads and runs < rows
