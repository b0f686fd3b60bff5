"""What the queries on overlapping pairs send between tasks."""

from __future__ import annotations

import pytest

from lociframe import catalog

SF = "/root/testdata/sf0.001"


def exchanges(df) -> list[tuple[str, int]]:
    """The partitioning and the rows of each exchange of a query that has run."""
    df.collect()
    nodes, found = [df._jdf.queryExecution().executedPlan()], []
    while nodes:
        node = nodes.pop()
        if node.nodeName() == "Exchange":
            found.append((node.outputPartitioning().toString(), node.metrics().get("shuffleRecordsWritten").get().value()))
        nodes += [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName() == "AdaptiveSparkPlan":
            nodes.append(node.executedPlan())
        elif "QueryStage" in node.nodeName():
            nodes.append(node.plan())
    return found


@pytest.mark.parametrize("name", ["pr_overlap_calls", "pr_pieces"])
def test_no_places_are_dealt_out(spark, name):
    found = exchanges(catalog.QUERIES[name](spark, SF))
    assert found and not [p for p, _ in found if "pair_id" in p and "pos" in p]
    # A pair's rows are dealt out by pair once.
    assert len([p for p, _ in found if p.startswith("hashpartitioning(pair_id")]) == 1
