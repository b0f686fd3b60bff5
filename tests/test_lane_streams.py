"""Lanes of reads in file order: deep starts, stretches, and what travels."""

from __future__ import annotations

import random

import numpy as np
import pytest

from lociframe import catalog
from lociframe.operators import lanes
from tests.test_pair_shuffles import SF, exchanges

ROWS = 6000  # reads of SF


@pytest.mark.parametrize("lead", [0, 7])
def test_deep_starts_by_the_rule(monkeypatch, lead):
    monkeypatch.setattr(lanes.RightLanes, "BLOCK", 16)
    rng = random.Random(lead)
    for upside_down in (False, True):
        spans, runs = [], []
        for start in range(1, 300):
            n = 200 if start == 200 else rng.choice([0, 1, 2, 3, 20, 90])
            run = [(max(1, start - rng.randrange(lead + 1)), start + rng.randrange(60)) for _ in range(n)]
            if upside_down and start == 200:
                run[0] = (1, 1)  # ends before lanes begin
            spans, runs = spans + run, runs + ([run] if run else [])
        laid, found = lanes.FileOrder(3), []
        for run in runs:
            found += list(laid.place(np.array([a for a, _ in run]), np.array([b for _, b in run])))
        assert found == lanes.first_fit(spans, 3)
        assert (laid.arrays is None) == upside_down


def test_stretches_are_cut_at_islands(spark, monkeypatch):
    monkeypatch.setattr(lanes, "LEAST", 50)
    rng = random.Random(2)
    at = [(c, 1000 * k + rng.randrange(30)) for c, count in (("c", 4000), ("d", 30), ("e", 1)) for k in [rng.randrange(200) for _ in range(count)]]
    rows = [(i, c, s, max(1, s - rng.choice([0, 5])), s + rng.randrange(50)) for i, (c, s) in enumerate([*at, *[("f", 5)] * 900])]
    df = spark.createDataFrame([*rows, (-1, None, 5, 5, 9)], "id long, contig string, start long, s_start long, s_end long")
    cuts, streams = lanes.stretches(lanes.starts_of(df), 3)
    assert 20 < streams <= len(rows) // 50 + 1 and len(cuts.where("_g_contig = 'c'").first()["_cuts"]) > 20
    found = lanes.assign_lanes(df, carried=["contig"])
    assert found.rdd.getNumPartitions() == streams
    got = {x["id"]: (x["contig"], x["lane"]) for x in found.collect()}
    assert len(got) == len(rows)
    for contig in "cdef":
        own = sorted((x for x in rows if x[1] == contig), key=lambda x: (x[2], x[0]))
        assert [got[x[0]] for x in own] == [(contig, k) for k in lanes.first_fit([x[3:] for x in own], lanes.READ_GAP)]


def test_no_rows_give_no_lanes(spark):
    none = spark.createDataFrame([], "id long, contig string, start long, s_start long, s_end long")
    assert lanes.assign_lanes(none).collect() == [] and lanes.depth(lanes.assign_lanes(none)).first()[0] == 0


@pytest.mark.parametrize(("name", "most"), [("ln_reads", 1), ("ln_depth", 1), ("cov_load_statistics", 1)])
def test_reads_travel_once(spark, name, most):
    found = exchanges(catalog.QUERIES[name](spark, SF))
    assert sum(n >= ROWS for _, n in found) <= most


def test_only_lanes_asked_for_go_on(spark, monkeypatch):
    given, join = [], lanes.overlap_join
    monkeypatch.setattr(lanes, "overlap_join", lambda asked, rows, *a: given.append(rows.count()) or join(asked, rows, *a))
    found = catalog.QUERIES["pr_first_in_lane"](spark, SF).count()
    # Four lanes of 25 contigs are asked for, of all pairs' lanes.
    assert found == 150 and len(given) == 1 and 0 < given[0] < 0.9 * catalog.QUERIES["ln_pairs"](spark, SF).count()
