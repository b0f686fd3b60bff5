"""Tiles of equal counts where half of all rows lie at one place."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lociframe.operators import genes, joins, lanes, tiles


@pytest.fixture(scope="module")
def deep(spark):
    """``(table, rows)``: half the rows begin at 5,000, a quarter lie within 100 bases, others anywhere."""
    rng = random.Random(1)
    at = lambda: rng.choices([5000, 20_000 + rng.randrange(100), rng.randrange(1, 100_000)], [2, 1, 1])[0]
    rows = [(i, rng.choice(["c", "c", "c", "d"]), at(), rng.randrange(1, 60)) for i in range(12_000)] + [(-1, None, 5, 5), (-2, "e", 7, 7)]
    return spark.createDataFrame(rows, "id long, contig string, start long, n long").withColumn("end", F.col("start") + F.col("n")).repartition(5), rows


@pytest.mark.parametrize("size", [100, 700, 1 << 20])
def test_tiles(deep, size):
    df, rows = deep
    found = tiles.equal_tiles(df, F.col("start"), size=size).collect()
    assert len(found) == len(rows) - 1 and set(found[0].asDict()) == {*df.columns, "_tile"}
    for contig in "cde":
        own = [r for r in found if r["contig"] == contig]
        sizes = Counter(r["_tile"] for r in own)
        assert max(sizes.values()) <= 2 * max(size, len(own) / max(1, len(sizes)))
        assert len(sizes) >= min(0.7 * len(own) / size, 1000)
        bounds = {t: (min(r["start"] for r in own if r["_tile"] == t), max(r["start"] for r in own if r["_tile"] == t)) for t in sizes}
        ordered = [bounds[t] for t in sorted(bounds)]
        assert all(a[1] <= b[0] for a, b in zip(ordered, ordered[1:], strict=False))


@pytest.mark.parametrize("size", [300, 1 << 20])
def test_running_sums(deep, size):
    df, rows = deep
    changes = df.groupBy("contig", "start").agg(F.sum("n").alias("w"), F.count(F.lit(1)).alias("k"))
    total, expected = Counter(), {}
    for contig, start in sorted({(c, s) for _, c, s, _ in rows if c}):
        for _, c, s, n in rows:
            if (c, s) == (contig, start):
                total[contig] += n
        expected[contig, start] = total[contig]
    found = {(r["contig"], r["start"]): r["sum"] for r in joins.running_count(changes, "start", F.col("w"), "sum", size=size).collect()}
    assert found == expected
    # Rows of one place come in any order: each sum is one of a chain.
    each = joins.running_count(df.where("contig = 'd'"), "start", F.lit(1), "place", size=size).collect()
    assert sorted(r["place"] for r in each) == list(range(1, len(each) + 1))
    assert [r["start"] for r in sorted(each, key=lambda r: r["place"])] == sorted(r["start"] for r in each)


@pytest.mark.parametrize("size", [250, 1 << 20])
def test_counts_and_neighbours(spark, deep, size):
    df, rows = deep
    asked = [(i, c, s, s + w) for i, (c, s, w) in enumerate([("c", 5000, 0), ("c", 4999, 0), ("c", 5000, 90), ("c", 1, 99_999), ("d", 20_050, 10), ("e", 1, 6), ("x", 1, 9)] * 40)]
    left = spark.createDataFrame(asked, "q long, contig string, start long, end long")
    expected = {q: n for q, c, s, e in asked if (n := sum(k == c and a <= e and a + w >= s for _, k, a, w in rows))}
    assert {r["q"]: r["n"] for r in joins.count_overlaps(left, df.select("contig", "start", "end"), "q", size).collect()} == expected
    loci = spark.createDataFrame([(i, c, p) for i, (c, p) in enumerate([("c", 5000), ("c", 4999), ("c", 99_999), ("d", 1), ("x", 1)] * 200)], "locus_id long, contig string, position long")
    found = joins.kth_neighbour(loci, df.select("id", "contig", "start", "end"), "start", F.lit(2), after=True, size=size).collect()
    for r in found:
        starts = sorted({s for _, c, s, _ in rows if c == r["contig"] and s > r["position"]})
        assert r["f_start"] == (starts[1] if len(starts) > 1 else None)


@pytest.mark.parametrize("size", [200, 1 << 20])
def test_islands(deep, size):
    df, rows = deep
    spans = df.where("contig is not null").select("id", "contig", "start", F.greatest("start", F.lit(1)).alias("s_start"), F.col("end").alias("s_end"))
    found = {r["id"]: r["island"] for r in lanes.with_islands(spans, 3, size=size).collect()}
    for contig in "cde":
        own = sorted((s, i, s + n) for i, c, s, n in rows if c == contig)
        end, island = None, None
        for s, i, e in own:
            if end is None or s > end + 3:
                island = s
            end = e if end is None else max(end, e)
            assert found[i] == island


def test_exons_of_a_long_gene(spark):
    """Over 1,023 exons keep their own ids."""
    n = 3000
    starts, ends = [10 * k + 1 for k in range(n)], [10 * k + 4 for k in range(n)]
    gene = spark.createDataFrame([(1, "g", "c", "+", 1, 10 * n, 1, 10 * n, starts, ends, True), (2, "h", "c", "+", 1, 9, 1, 9, [5], [9], True)], "id long, name string, contig string, strand string, tx_start long, tx_end long, cds_start long, cds_end long, exon_starts array<long>, exon_ends array<long>, has_exons boolean")
    assert genes.exon_spans(gene).select("id").distinct().count() == n + 1
    loci = spark.createDataFrame([(1, "c", 20_000)], "locus_id long, contig string, position long")
    assert genes.kth_exon(loci, gene, F.lit(1), after=True).first()["f_id"].asDict() == {"id": 1, "exon_no": 2001}


def test_deep_bins_are_split(spark):
    """A join bin with half of the rows is dealt over several tasks as the query runs."""
    conf = {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "32k", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "20"}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        place = F.when(F.col("id") % 2 == 0, 5000).otherwise(F.col("id") * 37 % 2_000_000)
        reads = spark.range(120_000).select("id", F.lit("c").alias("contig"), place.alias("start"), (place + 50).alias("end"), F.sha2(F.col("id").cast("string"), 256).alias("payload"))
        regions = spark.range(300).select(F.col("id").alias("region_id"), F.lit("c").alias("contig"), (F.col("id") * 6000 + 4900).alias("start"), (F.col("id") * 6000 + 5100).alias("end"))
        out = joins.overlap_join(regions, reads, levels=1)
        assert out.count() > 60_000
        df = out.groupBy("region_id").count()
        df.collect()
        assert "skew=true" in df._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
