"""Steps on reads whose work should not grow with the depth."""

from __future__ import annotations

from lociframe.operators import reads as r

READ = "read_id long, flag int, contig string, start long, cigar string, seq string"


def test_equal_reads_are_cut_into_bases_once(spark, monkeypatch):
    rows = [(i, 0, "c", 10, "1S3M", "GACA") for i in range(50)] + [(90, 16, "c", 10, "1S3M", "GACN"), (91, 0, "c", 10, "4M", None), (92, 0, "c", 11, "2M", "A"), (93, 0, None, 11, "1M", "T")]
    given, letters = [], r._letters
    monkeypatch.setattr(r, "_letters", lambda rows, carried: (given.append(rows.count()), letters(rows, carried))[1])
    found = r.pileup(r.parsed(spark.createDataFrame(rows, READ)))
    assert given == [5]
    got = sorted(((x["contig"] or "", x["pos"], x["a"], x["t"], x["c"], x["g"], x["n"], x["total"], x["softclip"]) for x in found.collect()))
    assert got == [("", 11, 0, 1, 0, 0, 0, 1, 0), ("c", 9, 0, 0, 0, 0, 0, 0, 51), ("c", 10, 51, 0, 0, 0, 1, 52, 0), ("c", 11, 1, 0, 51, 0, 1, 53, 0), ("c", 12, 50, 0, 0, 0, 3, 53, 0), ("c", 13, 0, 0, 0, 0, 1, 1, 0)]
