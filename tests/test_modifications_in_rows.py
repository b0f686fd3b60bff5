"""Base modifications and their segments within a read's row."""

from __future__ import annotations

from lociframe.operators import reads as r

MOD = "read_id long, flag int, contig string, start long, cigar string, seq string, mm string, ml array<int>"
READS = [
    (1, 0, "c", 10, "2S6M", "CaCGcACC", "C+m,0,1;C+hm,1;A+a,5;N+n,2;", [1, 2, 3, 4]),
    (2, 16, "c", 10, "4M2I4M", "GGATTGCCGA", "C+m,0,0,0;;T-x,1;", [9]),
    (3, 0, "c", 10, "4M", None, "C+m,0;", [1]),
    (4, 0, "c", 1, "3S2M", "CCCCC", "C+m,0,0,0,0;C+21839,0;", None),
    (5, 0, "c", 10, "2M3D2M", "CACA", None, [1]),
]


def test_calls_need_no_shuffle(spark):
    calls = r.base_modifications(r.parsed(spark.createDataFrame(READS, MOD)))
    assert "Exchange" not in calls._jdf.queryExecution().executedPlan().toString()
    assert sorted(tuple(x) for x in calls.collect()) == [
        (1, 8, 0, "m", 1), (1, 10, 2, "h", 3), (1, 10, 3, "m", 4), (1, 10, 5, "n", 255), (1, 12, 1, "m", 2),
        (2, 11, 2, "m", 255), (2, 12, 3, "x", 255), (2, 16, 0, "m", 9), (4, 1, 3, "m", 255),
    ]


def test_segments_as_by_the_join(spark):
    parsed = r.parsed(spark.createDataFrame(READS, MOD))
    joined = r.attach_modifications(r.segments(parsed), r.base_modifications(parsed))
    found = r.modifications_in_segments(parsed)
    columns = ["read_id", "pos", "call_order", "code", "probability", "seg_no"]
    both = [sorted(tuple(x) for x in df.select(*columns).collect()) for df in (joined, found)]
    assert both[0] == both[1] and len(both[0]) > 5
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
