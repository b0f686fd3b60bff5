"""Worked examples and invariants."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lociframe.functions import formats
from lociframe.functions import reads as fr
from lociframe.operators import bins, genes, lanes
from lociframe.operators import reads as r
from lociframe.operators.joins import overlap_join
from lociframe.sources import annotation, text

READ = "read_id long, qname string, flag int, contig string, start long, mapq int, cigar string, seq string"


def read(spark, start, cigar, seq="", flag=0):
    return r.parsed(spark.createDataFrame([(1, "r0", flag, "c", start, 60, cigar, seq)], READ))


def values(df, *columns):
    return [tuple(x) for x in df.select(*columns).collect()]


def test_base_at(spark):
    df = read(spark, 10, "1S2M1I1=1X1D1M1S", "SATIGCR" + "X")
    found = values(df, *[fr.base_at(F.col("ops"), F.col("seq"), F.lit(p)).alias(f"p{p}") for p in range(9, 17)])[0]
    assert found == (None, "A", "T", "G", "C", None, "R", None)


def test_positions(spark):
    df = read(spark, 10, "2M2D1M1N1M")
    assert values(df, *[fr.is_deletion_at(F.col("ops"), F.lit(p)).alias(f"p{p}") for p in range(10, 17)])[0] == (False, False, True, True, False, True, False)
    df = read(spark, 10, "2M2I1M1I")
    assert values(df, *[fr.has_insertion_at(F.col("ops"), F.lit(p)).alias(f"p{p}") for p in range(10, 15)])[0] == (False, False, True, True, False)
    df = read(spark, 10, "2S3M1S")
    clip = [fr.is_softclip_at(F.col("start"), F.col("end"), F.col("leading"), F.col("trailing"), F.lit(p)).alias(f"p{p}") for p in (7, 8, 9, 10, 12, 13, 14)]
    assert values(df, *clip)[0] == (False, True, True, False, False, True, False)
    df = read(spark, 10, "2S2M1I2M1S")
    assert values(df, *[fr.reference_position(F.col("ops"), F.col("start"), F.lit(q)).alias(f"q{q}") for q in (0, 2, 4, 5, 7)])[0] == (8, 10, None, 12, 14)


def test_hard_clip_before_soft_clip(spark):
    assert values(read(spark, 10, "3H4S3M", "GGGGATC"), "leading", "trailing") == [(4, 0)]


@pytest.mark.parametrize(
    ("cigar", "seq", "flag", "expected"),
    [
        ("3M", "ATC", 0, [(10, 12, "Match", None, None, "Forward")]),
        ("3M2D3M", "ATCATC", 16, [(10, 12, "Match", None, None, "Reverse"), (13, 14, "Deletion", None, None, None), (15, 17, "Match", None, None, None)]),
        ("3M2N", "ATC", 0, [(10, 12, "Match", None, None, None), (13, 14, "Deletion", None, None, "Forward")]),
        ("3M2I3M", "ATCGGATC", 0, [(10, 12, "Match", None, None, None), (13, 15, "Match", None, 2, "Forward")]),
        ("2S3M1S", "GGATTC", 16, [(8, 8, "SoftClip", "G", None, "Reverse"), (9, 9, "SoftClip", "G", None, None), (10, 12, "Match", None, None, None), (13, 13, "SoftClip", "C", None, None)]),
        ("1S2M1I2M3D2M", "GATCGAAA", 0, [(9, 9, "SoftClip", "G", None, None), (10, 11, "Match", None, None, None), (12, 13, "Match", None, 1, None), (14, 16, "Deletion", None, None, None), (17, 18, "Match", None, None, "Forward")]),
        ("", "ATC", 0, []),
        ("3M", "", 0, []),
    ],
)
def test_segments(spark, cigar, seq, flag, expected):
    df = r.segments(read(spark, 10, cigar, seq, flag)).orderBy("seg_no")
    assert values(df, "start", "end", "kind", "base", "insertion_len", "arrow") == expected


def test_mismatches(spark):
    ref = spark.createDataFrame([("c", "N" * 9 + "AATG")], "contig string, bases string")
    df = r.mismatches(read(spark, 10, "2S3M1S", "GGATTC", 16), ref)
    assert values(df, "pos", "base") == [(11, "T")]
    assert sorted(values(r.mismatches(read(spark, 10, "3X", "ATT"), ref), "pos", "base")) == [(10, "A"), (11, "T"), (12, "T")]


@pytest.mark.parametrize(
    ("cigar", "seq", "mm", "ml", "expected"),
    [
        ("3M", "CCC", "C+m,0,0,0;", None, [(10, "m", 255), (11, "m", 255), (12, "m", 255)]),
        ("2M", "CC", "C+mh,0,0;", [10, 200, 180, 20], [(10, "m", 10), (10, "h", 200), (11, "m", 180), (11, "h", 20)]),
    ],
)
def test_modifications(spark, cigar, seq, mm, ml, expected):
    df = read(spark, 10, cigar, seq).withColumns({"mm": F.lit(mm), "ml": F.lit(ml).cast("array<int>") if ml is None else F.array(*map(F.lit, ml))})
    assert values(r.base_modifications(df).orderBy("call_order"), "pos", "code", "probability") == expected


def test_pileup_adds_up(spark):
    p = r.pileup(read(spark, 3, "4S3M2D2M", "ACGTNATGC"))
    assert p.where("a + t + c + g + n <> total").count() == 0
    assert p.where("softclip = 1").select("pos").orderBy("pos").collect()[0][0] == 2


def test_first_fit():
    assert lanes.first_fit([(10, 20), (21, 25), (1, 5)], 3) == [0, 1, 0]


def test_sorted_lanes(spark):
    rows = [(0, 1, 50, 50, 50, 0), (1, 1, 10, 10, 20, None), (2, 1, 80, 80, 90, None), (3, 1, 48, 48, 48, None)]
    df = spark.createDataFrame([(i, g, k, a, b, rk) for k, (i, g, _, a, b, rk) in enumerate(rows)], "id long, region_id long, start long, s_start long, s_end long, rank int")
    assert sorted(values(lanes.assign_lanes_sorted(df), "id", "lane")) == [(0, 0), (1, 0), (2, 0), (3, 1)]


def test_islands_equal_whole_first_fit(spark):
    import random

    rng = random.Random(3)
    rows = []
    for i in range(400):
        s = rng.randrange(1, 6000)
        rows.append((i, "c", s, max(1, s - rng.choice([0, 0, 5, 20])), s + rng.randrange(40)))
    df = spark.createDataFrame(rows, "id long, contig string, start long, s_start long, s_end long")
    got = dict(values(lanes.assign_lanes(df), "id", "lane"))
    ordered = sorted(rows, key=lambda x: (x[2], x[0]))
    assert [got[x[0]] for x in ordered] == lanes.first_fit([(x[3], x[4]) for x in ordered], lanes.READ_GAP)
    assert lanes.with_islands(df, 3, size=16).select("island").distinct().count() == lanes.with_islands(df, 3).select("island").distinct().count() > 10
    with pytest.raises(Exception, match="max_island"):
        lanes.assign_lanes(df, max_island=2).collect()


def test_overlap_join_equals_naive(spark):
    import random

    rng = random.Random(5)
    make = lambda n: [(i, f"c{rng.randrange(3)}", s := rng.randrange(1, 5000), s + rng.choice([0, 5, 60, 3000])) for i in range(n)]
    a, b = make(150), make(150)
    schema = "id long, contig string, start long, end long"
    got = sorted(values(overlap_join(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema), bin_size=16), "id", "r_id"))
    assert got == sorted((x[0], y[0]) for x in a for y in b if x[1] == y[1] and x[2] <= y[3] and x[3] >= y[2])


def test_round_up(spark):
    df = spark.createDataFrame([(x,) for x in (0, 10, 11, 100, 101, 150, 999, 1000, 1001, 10001)], "x long")
    assert [v for (v,) in values(df, formats.round_up_depth(F.col("x")))] == [10, 10, 11, 100, 110, 150, 1000, 1000, 1100, 11000]


@pytest.mark.parametrize(("start", "end", "n", "expected"), [(1, 5, 5, [(i, i) for i in range(1, 6)]), (5, 5, 1, [(5, 5)]), (25398019, 25398025, 3, [(25398019, 25398020), (25398021, 25398022), (25398023, 25398025)]), (5, 10, 2, [(5, 7), (8, 10)])])
def test_bins(spark, start, end, n, expected):
    df = bins.equal_bins(spark.createDataFrame([(1, "c", start, end)], "region_id long, contig string, start long, end long"), F.lit(n))
    assert values(df.orderBy("bin"), "start", "end") == expected


@pytest.mark.parametrize(("start", "end", "n"), [(1, 5, 0), (5, 1, 1), (1, 5, 6)])
def test_bad_bins(spark, start, end, n):
    with pytest.raises(Exception, match="bins|region"):
        bins.equal_bins(spark.createDataFrame([(1, "c", start, end)], "region_id long, contig string, start long, end long"), F.lit(n)).collect()


GENES = [(1, "gene1", None, "c", "+", 1, 10, 1, 10, "1,7,", "5,10,"), (2, "gene_no_exon", None, "c", "+", 20, 30, 20, 30, "", ""), (3, "gene2", None, "c", "+", 40, 50, 40, 50, "40,", "50,")]
GENE_SCHEMA = "id long, name string, name2 string, contig string, strand string, tx0 long, tx_end long, cds0 long, cds_end long, exon_starts_text string, exon_ends_text string"


def _track(spark, cases):
    g = genes.parse_genes(spark.createDataFrame(GENES, GENE_SCHEMA))
    loci = spark.createDataFrame([(i, "c", p, k) for i, (p, k) in enumerate(cases)], "locus_id long, contig string, position long, k long")
    return g, loci


def test_kth_gene(spark):
    cases = [(2, 1), (11, 1), (35, 1), (51, 1)]
    g, loci = _track(spark, cases)
    assert [x for _, x in sorted(values(genes.kth_gene(loci, g, F.col("k"), after=False), "locus_id", "f_name"))] == [None, "gene1", "gene_no_exon", "gene2"]
    cases = [(2, 1), (2, 2), (2, 3), (11, 1), (51, 1), (1, 1), (2, 0)]
    g, loci = _track(spark, cases)
    assert [x for _, x in sorted(values(genes.kth_gene(loci, g, F.col("k"), after=True), "locus_id", "f_name"))] == ["gene_no_exon", "gene2", None, "gene_no_exon", None, "gene1", None]


def test_kth_exon(spark):
    g, loci = _track(spark, [(2, 1), (35, 1), (51, 1), (51, 2)])
    assert [x for _, x in sorted(values(genes.kth_exon(loci, g, F.col("k"), after=False), "locus_id", "f_start"))] == [None, 8, 41, 8]
    g, loci = _track(spark, [(1, 2), (2, 1), (35, 1), (35, 2), (51, 1)])
    assert [x for _, x in sorted(values(genes.kth_exon(loci, g, F.col("k"), after=True), "locus_id", "f_start"))] == [8, 8, 41, None, None]


def test_feature_at(spark):
    g, loci = _track(spark, [(p, 0) for p in (1, 2, 5, 10, 42, 51)])
    assert [x for _, x in sorted(values(genes.feature_at(loci, genes._spans(g)), "locus_id", "id"))] == [None, 1, 1, 1, 3, None]


def test_dump_fields(spark):
    columns = (("u", "bigint"), ("i", "bigint"), ("f", "double"), ("s", "string"))
    lines = lambda *x: spark.createDataFrame([(v,) for v in x], "value string")
    assert values(text.dump_lines(lines("42\t-42\t3.5\t\\N\r"), "t", columns), "*") == [(42, -42, 3.5, None)]
    with pytest.raises(Exception, match="column u"):
        text.dump_lines(lines("x\t1\t1\ta"), "t", columns).collect()
    with pytest.raises(Exception, match="4 columns"):
        text.dump_lines(lines("1\t2"), "t", columns).collect()


def test_files(spark, tmp_path):
    import gzip

    (tmp_path / "a.fa").write_text(">one x\nACGT\nAC\n>two\nGG\n")
    assert sorted(values(text.read_fasta(spark, str(tmp_path / "a.fa")), "contig", "bases")) == [("one", "ACGTAC"), ("two", "GG")]
    (tmp_path / "a.bed").write_text("track x\nchr1\t0\t5\nchr2\t7\n")
    assert values(text.read_bed(spark, str(tmp_path / "a.bed")).orderBy("idx"), "contig", "start", "end") == [("chr1", 1, 5), ("chr2", 8, 8)]
    with gzip.open(tmp_path / "a.vcf.gz", "wt") as f:
        f.write("##x\n#CHROM\n1\t5\t.\tCT\t.\t.\tPASS\t.\n")
    assert values(text.read_vcf(spark, str(tmp_path / "a.vcf.gz")), "contig", "start", "end", "alt", "qual") == [("1", 5, 6, [], None)]
    folder = tmp_path / "dumps"
    folder.mkdir()
    with pytest.raises(FileNotFoundError):
        annotation.read_dump_set(spark, str(folder))
    with gzip.open(folder / "chromInfo.txt.gz", "wt") as f:
        f.write("chr1\t10\t/a/x.2bit\n")
    with gzip.open(folder / "refGene.txt.gz", "wt") as f:
        f.write("\t".join(["0", "NM", "chr1", "+", "0", "9", "0", "9", "1", "0,", "9,", "0", "G", "c", "c", "0,"]) + "\n")
    found = annotation.read_dump_set(spark, str(folder))
    assert {k: v.count() for k, v in found.items()} == {"chromInfo": 1, "chromAlias": 0, "cytoBandIdeo": 0, "genes": 1}
    cache = str(tmp_path / "cache")
    annotation.write_cache(found, cache)
    annotation.write_cache(found, cache, {"genes": "chrom"})
    assert annotation.read_cache(spark, cache)["genes"].count() == 1


def test_mirror_types():
    assert annotation.mirror_type("INT(10) UNSIGNED") == "bigint"
    with pytest.raises(ValueError, match="geometry"):
        annotation.mirror_type("geometry")
