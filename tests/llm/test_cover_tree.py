"""Cover-tree links against all pairs."""

from __future__ import annotations

import numpy as np
import pytest

from lociframe.llm import cover_tree as ct


def brute(rows, threshold):
    """(n_links, component) of each (id, vector, label) row from all pairs."""
    n = len(rows)
    good = [r[2] is not None and r[1] is not None and len(r[1]) > 0 and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1]) for r in rows]
    links = [set() for _ in rows]
    unit = [np.asarray(np.float32(r[1]), float) if g else None for r, g in zip(rows, good, strict=True)]
    for i in range(n):
        for j in range(i):
            if good[i] and good[j] and rows[i][2] == rows[j][2] and len(unit[i]) == len(unit[j]):
                if unit[i] @ unit[j] / np.sqrt((unit[i] @ unit[i]) * (unit[j] @ unit[j])) >= threshold:
                    links[i].add(j)
                    links[j].add(i)
    out, seen = [None] * n, set()
    for i in range(n):
        if i in seen:
            continue
        group, todo = {i}, [i]
        while todo:
            for k in links[todo.pop()] - group:
                group.add(k)
                todo.append(k)
        seen |= group
        ids = [rows[k][0] for k in group if rows[k][0] is not None]
        for k in group:
            out[k] = (len(links[k]), min(ids) if ids else None)
    return out


def planted(rng, dims, far, groups, size, noise):
    base = rng.normal(size=(far + groups, dims))
    near = np.repeat(base[far:], size, 0)
    return np.concatenate([base[:far], near + noise * rng.normal(size=near.shape) * np.linalg.norm(near, axis=1)[:, None] / np.sqrt(dims)])


@pytest.mark.parametrize(("dims", "noise"), [(3, 0.1), (24, 0.25), (24, 0.02)])
def test_walk_against_all_pairs(dims, noise):
    rng = np.random.default_rng(dims)
    x = ct.unit(planted(rng, dims, 150, 8, 40, noise))
    w = rng.integers(1, 5, len(x))
    near = x @ x.T >= 0.93
    np.fill_diagonal(near, False)
    tree = ct.CoverTree(x, small=5)
    for node in range(len(tree.centre)):  # nested levels: a node's centre is one of its points and the centre of its first child
        assert tree.centre[node] in tree.points(node)
        assert not tree.children[node] or tree.centre[tree.children[node][0]] == tree.centre[node]
        assert ct.distances(x[tree.points(node)], x[tree.centre[node]][None]).max() <= tree.radius[node] + 1e-7
        assert all(tree.radius[c] < tree.radius[node] for c in tree.children[node])
    found = ct.Links((len(x), 0))
    ct.walk(tree, tree, (w, w), 0.93, found)
    assert (found.weight[0] == near @ w).all()
    from lociframe.llm.simhash import forest

    i, j = np.nonzero(near)
    assert (ct.spanning(found, len(x)) == forest(len(x), i, j)).all()
    cut = len(x) // 3
    found = ct.Links((cut, len(x) - cut))
    ct.walk(ct.CoverTree(x[:cut], 5), ct.CoverTree(x[cut:], 5), (w[:cut], w[cut:]), 0.93, found)
    assert (found.weight[0] == near[:cut, cut:] @ w[cut:]).all()
    assert (found.weight[1] == w[:cut] @ near[:cut, cut:]).all()


def test_pairs_far_apart_are_dropped():
    """Well separated groups are never compared."""
    x = ct.unit(np.repeat(np.eye(16), 4, 0) + 0.01 * np.random.default_rng(0).normal(size=(64, 16)))
    pairs = list(ct.leaf_pairs(ct.CoverTree(x, small=1), np.full(64, 0.05), 0.93))
    assert len(pairs) == len(set(pairs)) == 16 * 10
    assert all(i // 4 == j // 4 for i, j in pairs)


@pytest.mark.parametrize(("pivots", "leaf"), [(1024, 1024), (6, 32), (40, 16)])
def test_query_against_all_pairs(spark, pivots, leaf):
    rng = np.random.default_rng(3)
    vectors = planted(rng, 8, 120, 10, 12, 0.2).tolist()
    rows = [(i, v, int(i % 7 > 0)) for i, v in enumerate(vectors)]
    rows += [(1000 + i, vectors[5], 1) for i in range(40)]  # copies
    rows += [(2000, [3 * x for x in vectors[5]], 1), (2001, vectors[5], 0), (2002, vectors[5], None), (2003, None, 1), (2004, [0.0] * 8, 1), (2005, [float("nan"), *[1.0] * 7], 1)]
    rows += [(2006, [None, *[1.0] * 7], 1), (2007, [float("inf"), *[1.0] * 7], 1), (2008, [], 1), (2009, [1.0, 2.0], 1), (2010, [1.0, 2.1], 1), (None, vectors[6], 1), (None, vectors[6], 1), (7, vectors[7], 1), (None, [1.0], 5)]
    rows += [(2011, [1e-30 * x for x in vectors[9]], 1), (2012, [1e30 * x for x in vectors[9]], 1)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<float>, label int, pid string, n int").repartition(5)
    found = ct.near_duplicates(df, pivots=pivots, leaf=leaf).collect()
    expected = [(r[0], n, c, r[0] == c) for r, (n, c) in zip(rows, brute(rows, 0.93), strict=True)]
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, expected))


def test_empty(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert ct.near_duplicates(df).count() == 0
