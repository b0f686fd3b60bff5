"""Indexed FASTA files read by ranges."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, LessThan

from lociframe.operators import sequence
from lociframe.sources import fasta, files


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    """``(folder, sequences)``: whole and uneven last lines, one base, and other line lengths and ends in a file by hand."""
    rng = random.Random(2)
    made = {f"c{i}": "".join(rng.choices("ACGTNacgt", k=n)) for i, n in enumerate([1, 59, 60, 61, 120, 5000, 12_345])}
    folder = tmp_path_factory.mktemp("fasta") / "set"
    fasta.write_indexed(spark.createDataFrame(list(made.items()), "contig string, bases string").repartition(3), str(folder))
    other = "".join(rng.choices("ACGT", k=77))
    body = "\r\n".join(other[k : k + 13] for k in range(0, 77, 13))
    (folder / "hand.fasta").write_bytes(f">hand some text\r\n{body}\r\n".encode())
    (folder / "hand.fasta.fai").write_text(f"hand\t77\t{len('>hand some text') + 2}\t13\t15\n")
    return str(folder), made | {"hand": other}


@pytest.mark.parametrize("size", [7, 60, 1000, 1 << 16])
def test_whole_files(spark, written, size):
    folder, made = written
    fasta.register(spark)
    df = spark.read.format("fasta").option("chunkBases", size).option("rangeBytes", 3 * size).option("pageBytes", 64).load(folder)
    found = {}
    for r in df.orderBy("contig", "chunk_no").collect():
        assert r["chunk_start"] == r["chunk_no"] * size + 1
        found[r["contig"]] = found.get(r["contig"], "") + r["bases"]
    assert found == made
    header = spark.read.format("fasta").option("header", "true").load(folder).collect()
    assert {r["name"]: r["length"] for r in header} == {n: len(b) for n, b in made.items()}


def test_regions(spark, written):
    folder, made = written
    rng = random.Random(7)
    asked = [(i, c, s, s + rng.randrange(300)) for i in range(60) for c in [rng.choice([*made, "none"])] for s in [rng.randrange(1, len(made.get(c, "x")) + 20)]] + [(90, "c6", 12_345, 12_345), (91, "c6", 1, 12_345), (92, "c0", 1, 1)]
    regions = spark.createDataFrame(asked, "region_id int, contig string, start long, end long")
    chunks = fasta.region_chunks(spark, folder, regions, 50)
    found = {r["region_id"]: r["bases"] for r in sequence.cut_regions(regions, chunks, 50).collect()}
    plain = sequence.region_sequences(regions, spark.createDataFrame(list(made.items()), "contig string, bases string"), 50)
    assert found == {r["region_id"]: r["bases"] for r in plain.collect()}
    assert found[91] == made["c6"] and found[0] == (made.get(asked[0][1], "")[asked[0][2] - 1 : asked[0][3]] if asked[0][3] <= len(made.get(asked[0][1], "")) else None)


def test_only_what_is_asked_for_is_read(written, tmp_path):
    folder, made = written
    path = next(p for p in files.listed(folder, ".fa") if any(e.name == "c6" for e in fasta.read_index(f"{p}.fai")))
    reader = fasta.FastaReader({"path": path, "chunkBases": "100", "regions": "c6:5001-5100;c6:5050-5060;c6:9999-10001", "pageBytes": "128"})
    parts = reader.partitions()
    assert [(e.name, a, b) for p in parts for e, a, b in p.runs] == [("c6", 50, 51), ("c6", 99, 101)]
    assert [x for p in parts for b in reader.read(p) for x in b.column("bases").to_pylist()] == [made["c6"][5000:5100], made["c6"][9900:10_000], made["c6"][10_000:10_100]]
    pushed = fasta.FastaReader({"path": path, "chunkBases": "100"})
    list(pushed.pushFilters([EqualTo(("contig",), "c6"), LessThan(("chunk_no",), 3)]))
    assert [(e.name, a, b) for p in pushed.partitions() for e, a, b in p.runs] == [("c6", 0, 3)]


def test_filters_through_spark(spark, written):
    folder, made = written
    fasta.register(spark)
    df = spark.read.format("fasta").option("chunkBases", 100).load(folder).where((F.col("contig") == "c5") & F.col("chunk_no").between(3, 4))
    assert sorted(r["bases"] for r in df.collect()) == sorted([made["c5"][300:400], made["c5"][400:500]])
    assert spark.read.format("fasta").load(folder).where("contig = 'none'").count() == 0


def test_files_that_do_not_fit(spark, tmp_path):
    (tmp_path / "x.fa").write_text(">a\nACG\nT\n")
    fasta.register(spark)
    with pytest.raises(Exception, match="fai"):
        spark.read.format("fasta").load(str(tmp_path / "x.fa")).count()
    (tmp_path / "x.fa.fai").write_text("a\t40\t3\t3\t4\n")
    with pytest.raises(Exception, match="fit"):
        spark.read.format("fasta").load(str(tmp_path / "x.fa")).count()
    with pytest.raises(Exception, match="none"):
        spark.read.format("fasta").load(str(tmp_path / "none")).count()
