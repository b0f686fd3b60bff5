"""Exact near-duplicate vectors by dual traversal of cover trees.

Rows of one label link where the cosine is at least ``threshold``. Unit vectors of that cosine lie within the distance
sqrt(2 - 2 * threshold), so links are found among points of a metric space; each is confirmed by the cosine in double
precision.

Method: a cover tree has nested levels: a node's children are a net of its points with half its radius, its own centre
among them, and each node knows its covering radius, the largest distance of its points. Two trees are walked together:
a pair of nodes whose centres are further apart than the distance and both covering radii is dropped; a pair that lies
within the distance as a whole is linked as a whole, without its pairs; others go on to their children, and small ones
are compared point by point.

On Spark: equal vectors of a label are one point with a weight. The upper tree of a large label is built from a
bounded sample of its points (``PIVOTS``); each point goes to its nearest leaf, and covering radii are then measured over
all points, so bounds are exact whatever the sample. The upper tree's walk with itself gives the pairs of leaves that
may hold links. Leaves of over ``LEAF`` points are dealt into blocks, and each pair of blocks is a task's work, which
builds the lower trees and walks them. A pair of blocks gives weights and a spanning forest, not its links, so a dense
group costs one row per point.

Where points don't cluster (independent directions in many dimensions) covering radii stay near the distances between
points: few pairs of blocks are dropped, and the work grows with the square of a label, dealt over tasks of bounded size.

Defined results: null labels, null and zero vectors, and those with a null, infinite or NaN component link with nothing;
vectors of unequal length don't link; copies of a vector link, repeated rows too; a null id counts as a row, and a
group of null ids only has a null component; extra columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lociframe.llm.shared import materialize, named
from lociframe.llm.simhash import components, forest

PIVOTS, LEAF, SMALL = 1024, 1024, 48
SLACK = 1e-7  # over the rounding of distances; whatever it lets through is confirmed by the cosine


def matrix(column: pa.Array) -> np.ndarray:
    """The rows of a list column of equal lengths in double precision."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of all rows of ``a`` to all of ``b``."""
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


class CoverTree:
    """Nodes over unit vectors: ``centre, radius, points`` (a range of ``order``) and children."""

    def __init__(self, x: np.ndarray, small: int = SMALL) -> None:
        self.x, self.order = x, np.arange(len(x))
        self.centre, self.radius, self.span, self.children = [], [], [], []
        away = distances(x, x[:1])[:, 0]
        self._add(0, away.max(), (0, len(x)))
        todo = [(0, 2.0, away)] if len(x) else []
        while todo:
            node, level, away = todo.pop()
            low, high = self.span[node]
            while level >= self.radius[node] > 0:
                level /= 2
            if high - low <= small or self.radius[node] <= SLACK:
                continue
            for child, own in self._net(node, away, level):
                self.children[node].append(child)
                todo.append((child, level, own))

    def _add(self, centre: int, radius: float, span: tuple[int, int]) -> int:
        self.centre.append(centre)
        self.radius.append(float(radius))
        self.span.append(span)
        self.children.append([])
        return len(self.centre) - 1

    def _net(self, node: int, away: np.ndarray, level: float) -> list[tuple[int, np.ndarray]]:
        """A net of the node's points, ``level`` apart, its own centre first; each point goes to the first that covers it."""
        low, high = self.span[node]
        rest, out, at = self.order[low:high].copy(), [], low
        made = []
        centre = self.centre[node]
        while len(rest):
            covered = away <= level
            mine, d = rest[covered], away[covered]
            self.order[at : at + len(mine)] = mine
            made.append((centre, d, (at, at + len(mine))))
            at += len(mine)
            rest = rest[~covered]
            if len(rest):
                centre = rest[0]
                away = distances(self.x[rest], self.x[centre : centre + 1])[:, 0]
                away[0] = 0.0
        for centre, d, span in made:
            out.append((self._add(centre, d.max(), span), d))
        return out

    def points(self, node: int) -> np.ndarray:
        low, high = self.span[node]
        return self.order[low:high]


class Links:
    """What a walk finds for the points of two trees: weight linked to each point, and pairs that connect what is linked."""

    def __init__(self, sizes: tuple[int, int]) -> None:
        self.weight = tuple(np.zeros(n, np.int64) for n in sizes)
        self.pairs: list[tuple[np.ndarray, np.ndarray]] = []


def walk(a: CoverTree, b: CoverTree, weights: tuple[np.ndarray, np.ndarray], threshold: float, found: Links) -> None:
    """All links between the points of two trees, or of one with itself (``a is b``), each counted at both ends and a point's own left out."""
    reach, same = math.sqrt(2 - 2 * threshold), a is b
    base = 0 if same else len(a.x)
    wa, wb = weights

    def whole(p: int, q: int) -> None:
        x, y = a.points(p), b.points(q)
        if same and p == q:
            found.weight[0][x] += wa[x].sum() - wa[x]
        else:
            found.weight[0][x] += wb[y].sum()
            found.weight[0 if same else 1][y] += wa[x].sum()
        found.pairs.append((np.concatenate([x, base + y]), np.full(len(x) + len(y), base + y[0])))

    def compare(x: np.ndarray, y: np.ndarray, own: bool) -> None:
        near = a.x[x] @ b.x[y].T >= threshold
        if own:
            np.fill_diagonal(near, False)
        if not near.any():
            return
        found.weight[0][x] += near @ wb[y]
        if not own:
            found.weight[0 if same else 1][y] += wa[x] @ near
        i, j = np.nonzero(near)
        found.pairs.append((x[i], base + y[j]))

    todo = [(0, 0)] if len(a.x) and len(b.x) else []
    while todo:
        p, q = todo.pop()
        own = same and p == q
        if own and 2 * a.radius[p] <= reach - SLACK:
            whole(p, q)
            continue
        # The larger node gives way to its children, both if they are one.
        left, right = a.children[p] or [p], b.children[q] or [q]
        if left == [p] and right == [q]:
            compare(a.points(p), b.points(q), own)
            continue
        ca, cb = np.array(left), np.array(right)
        ra, rb = np.array([a.radius[i] for i in left]), np.array([b.radius[i] for i in right])
        d = distances(a.x[[a.centre[i] for i in left]], b.x[[b.centre[i] for i in right]])
        bound = ra[:, None] + rb[None, :]
        close = d <= bound + reach + SLACK
        if own:
            close = np.triu(close)
        inside = close & (d + bound <= reach - SLACK)
        if own:
            np.fill_diagonal(inside, False)
            np.fill_diagonal(close, True)
        for i, j in zip(*np.nonzero(inside), strict=True):
            whole(left[i], right[j])
        i, j = np.nonzero(close & ~inside)
        # Single points are compared together.
        na = np.array([a.span[n][1] - a.span[n][0] for n in left])
        nb = np.array([b.span[n][1] - b.span[n][0] for n in right])
        single = (na[i] == 1) & (nb[j] == 1)
        for s in range(0, int(single.sum()), 1 << 14):
            _points(a, b, ca[i[single][s : s + (1 << 14)]], cb[j[single][s : s + (1 << 14)]], base, same, weights, threshold, found)
        todo.extend(zip(ca[i[~single]].tolist(), cb[j[~single]].tolist(), strict=True))


def _points(a: CoverTree, b: CoverTree, left: np.ndarray, right: np.ndarray, base: int, same: bool, weights: tuple[np.ndarray, np.ndarray], threshold: float, found: Links) -> None:
    x, y = np.array([a.centre[n] for n in left]), np.array([b.centre[n] for n in right])
    near = np.einsum("ij,ij->i", a.x[x], b.x[y]) >= threshold
    if same:
        near &= x != y
    x, y = x[near], y[near]
    np.add.at(found.weight[0], x, weights[1][y])
    np.add.at(found.weight[0 if same else 1], y, weights[0][x])
    found.pairs.append((x, base + y))


def spanning(found: Links, n: int) -> np.ndarray:
    """The smallest index that each of ``n`` points reaches."""
    if not found.pairs:
        return np.arange(n)
    return forest(n, np.concatenate([p[0] for p in found.pairs]), np.concatenate([p[1] for p in found.pairs]))


def leaf_pairs(tree: CoverTree, radius: np.ndarray, threshold: float) -> Iterator[tuple[int, int]]:
    """Pairs of single points ``i <= j`` of a tree that may hold links, where ``radius`` is what each of them covers."""
    reach = math.sqrt(2 - 2 * threshold) + SLACK
    covers = np.zeros(len(tree.centre))
    # Children have larger numbers than their parents.
    for node in range(len(tree.centre) - 1, -1, -1):
        if tree.children[node]:
            d = distances(tree.x[[tree.centre[c] for c in tree.children[node]]], tree.x[tree.centre[node]][None])[:, 0]
            covers[node] = max(d + covers[tree.children[node]])
        else:
            own = tree.points(node)
            covers[node] = max(distances(tree.x[own], tree.x[tree.centre[node]][None])[:, 0] + radius[own])
    todo = [(0, 0)]
    while todo:
        p, q = todo.pop()
        left, right = tree.children[p] or [p], tree.children[q] or [q]
        if left == [p] and right == [q]:
            x, y = tree.points(p), tree.points(q)
            i, j = np.nonzero(distances(tree.x[x], tree.x[y]) <= radius[x][:, None] + radius[y][None, :] + reach)
            i, j = x[i], y[j]
            every = set(zip(np.minimum(i, j).tolist(), np.maximum(i, j).tolist(), strict=True))
            yield from every if p != q else every | {(k, k) for k in x.tolist()}
            continue
        d = distances(tree.x[[tree.centre[c] for c in left]], tree.x[[tree.centre[c] for c in right]])
        close = d <= covers[left][:, None] + covers[right][None, :] + reach
        if p == q:
            close = np.triu(close)
            np.fill_diagonal(close, True)
        i, j = np.nonzero(close)
        todo.extend(zip(np.array(left)[i].tolist(), np.array(right)[j].tolist(), strict=True))


def _groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of equal ``key``, which lie together."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        k = b.column(key).to_numpy()
        cuts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, int)
        if held and len(k) and held[-1].column(key)[-1].as_py() != k[0]:
            yield pa.Table.from_batches(held)
            held = []
        for low, high in zip(cuts, [*cuts[1:], len(k)], strict=True):
            held.append(b.slice(low, high - low))
            if high < len(k):
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


def _vectors(t: pa.Table) -> np.ndarray:
    return unit(matrix(t.column("embedding").combine_chunks()))


def _nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Points with the leaf nearest to each; a group's pivots (those with a ``leaf``) come first, its points stream by."""
    key, pivots, leaves = None, np.zeros((0, 0)), np.zeros(0, np.int64)
    for b in batches:
        k = b.column("gid").to_numpy()
        cuts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, int)
        for low, high in zip(cuts, [*cuts[1:], len(k)], strict=True):
            part = pa.Table.from_batches([b.slice(low, high - low)])
            is_pivot = pc.is_valid(part.column("leaf"))
            own, rest = part.filter(is_pivot), part.filter(pc.invert(is_pivot))
            if key != k[low]:
                key, pivots, leaves = k[low], np.zeros((0, 0)), np.zeros(0, np.int64)
            if len(own):
                new = _vectors(own)
                pivots = np.concatenate([pivots, new]) if len(pivots) else new
                leaves = np.concatenate([leaves, own.column("leaf").to_numpy()])
            if len(rest):
                d = distances(_vectors(rest), pivots)
                at = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([rest.column("pid").combine_chunks(), pa.array(leaves[at]), pa.array(d[np.arange(len(at)), at])], ["pid", "leaf", "away"])


def _pairs_of(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, "gid"):
            leaves, gid, out = t.column("leaf").to_numpy(), t.column("gid")[0].as_py(), []
            for pair in leaf_pairs(CoverTree(_vectors(t), small=1), t.column("radius").to_numpy(), threshold):
                out.append(pair)
                if len(out) == 1 << 16:
                    yield _pair_batch(gid, leaves, out)
                    out = []
            if out:
                yield _pair_batch(gid, leaves, out)

    return run


def _pair_batch(gid: int, leaves: np.ndarray, pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    at = leaves[np.array(pairs)]
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), gid)), pa.array(at[:, 0]), pa.array(at[:, 1])], ["gid", "i", "j"])


def _compare(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, "pair"):
            side, pid, w = t.column("side").to_numpy(), t.column("pid").to_numpy(), t.column("n").to_numpy()
            x = _vectors(t)
            first, second = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
            a = CoverTree(x[first])
            if t.column("own")[0].as_py():
                found = Links((len(first), 0))
                walk(a, a, (w[first], w[first]), threshold, found)
                weight, order = found.weight[0], first
            else:
                found = Links((len(first), len(second)))
                walk(a, CoverTree(x[second]), (w[first], w[second]), threshold, found)
                weight, order = np.concatenate(found.weight), np.concatenate([first, second])
            root = spanning(found, len(order))
            linked = np.flatnonzero(weight)
            yield pa.RecordBatch.from_arrays([pa.array(pid[order[linked]]), pa.array(weight[linked]), pa.array(pid[order[root[linked]]])], ["pid", "weight", "root"])

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, id: str = "vec_id", embedding: str = "embedding", label: str = "label", pivots: int = PIVOTS, leaf: int = LEAF) -> DataFrame:
    """The id, ``n_links``, ``component_id`` and ``kept`` of each row of ``vectors``."""
    e = named(embedding)
    real = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf"))) & F.exists(e, lambda v: v != 0)
    valid = named(label).isNotNull() & F.coalesce(real, F.lit(False))
    given = vectors.select(named(id).alias("id"), named(label).alias("label"), F.when(valid, e).alias("embedding"))
    hashes = {"dim": F.size("embedding"), "h1": F.when(F.col("embedding").isNotNull(), F.xxhash64("label", "embedding")), "h2": F.xxhash64(F.lit(1), "embedding", "label")}
    rows = materialize(given.withColumns(hashes), "cover-rows")
    same = ["label", "dim", "h1", "h2"]
    points = rows.where("h1 is not null").groupBy(*same).agg(F.any_value("embedding").alias("embedding"), F.min("id").alias("least"), F.count(F.lit(1)).alias("n"))
    gid = F.xxhash64("label", "dim")
    points = materialize(points.withColumns({"pid": F.monotonically_increasing_id(), "gid": gid}), "cover-points")

    placed, pairs = _leaves(points, threshold, pivots, leaf)
    # Each point goes to all pairs of blocks that its own is in.
    blocks = placed.groupBy("gid", "leaf").agg(F.ceil(F.count(F.lit(1)) / leaf).alias("blocks"))
    blocks = materialize(blocks, "cover-blocks")
    b = lambda c, n: blocks.select(F.col("gid").alias(f"_g{c}"), F.col("leaf").alias(f"_{c}"), F.col("blocks").alias(n))
    sized = pairs.join(b("i", "bi"), (F.col("gid") == F.col("_gi")) & (F.col("i") == F.col("_i"))).join(b("j", "bj"), (F.col("gid") == F.col("_gj")) & (F.col("j") == F.col("_j")))
    upto = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    crossed = sized.select("gid", "i", "j", "bj", upto("bi").alias("x")).select("gid", "i", "j", "x", upto("bj").alias("y")).where("i < j or x <= y")
    own = (F.col("i") == F.col("j")) & (F.col("x") == F.col("y"))
    numbered = materialize(crossed.withColumns({"pair": F.monotonically_increasing_id(), "own": own}), "cover-pairs")
    sides = numbered.select("pair", "own", F.col("gid").alias("_g"), F.col("i").alias("_l"), F.col("x").alias("_b"), F.lit(0).alias("side")).unionByName(
        numbered.where("not own").select("pair", "own", F.col("gid").alias("_g"), F.col("j").alias("_l"), F.col("y").alias("_b"), F.lit(1).alias("side"))
    )
    dealt = placed.join(blocks.withColumnsRenamed({"gid": "_g0", "leaf": "_l0"}), (F.col("gid") == F.col("_g0")) & (F.col("leaf") == F.col("_l0"))).withColumn("block", F.pmod(F.xxhash64("pid"), "blocks"))
    work = dealt.join(sides, (F.col("gid") == F.col("_g")) & (F.col("leaf") == F.col("_l")) & (F.col("block") == F.col("_b"))).select("pair", "own", "side", "pid", "n", "embedding")
    out = T.StructType([T.StructField(c, T.LongType()) for c in ("pid", "weight", "root")])
    found = materialize(work.repartition("pair").sortWithinPartitions("pair").mapInArrow(_compare(threshold), out), "cover-links")

    weights = found.groupBy(F.col("pid").alias("_p")).agg(F.sum("weight").alias("weight"))
    roots = components(found.select(F.col("pid").alias("u"), F.col("root").alias("v"))).withColumnsRenamed({"node": "_n", "root": "_root"})
    classes = points.drop("embedding").join(weights, F.col("pid") == F.col("_p"), "left").join(roots, F.col("pid") == F.col("_n"), "left")
    classes = materialize(classes.select(*same, "least", "n", (F.coalesce("weight", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("_root", "pid").alias("root")), "cover-classes")
    least = materialize(classes.groupBy(F.col("root").alias("_r")).agg(F.min("least").alias("component_id")), "cover-components")
    judged = classes.join(least, F.col("root") == F.col("_r")).select(*[F.col(c).alias(f"_{c}") for c in same], "n_links", "component_id")
    judged = materialize(judged, "cover-judged")
    met = rows.drop("embedding").join(judged, [F.col(c) == F.col(f"_{c}") for c in same], "left")
    component = F.when(F.col("h1").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return met.select(F.col("id").alias(id), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))


def _leaves(points: DataFrame, threshold: float, pivots: int, leaf: int) -> tuple[DataFrame, DataFrame]:
    """``pid, n, gid, leaf, embedding`` of all points, and the pairs ``gid, i, j`` of leaves that may hold links."""
    sizes = materialize(points.groupBy(F.col("gid").alias("_gid")).agg(F.count(F.lit(1)).alias("points")), "cover-sizes")
    small = sizes.where(F.col("points") <= leaf)
    held = points.join(small.select("_gid"), F.col("gid") == F.col("_gid"), "left_semi").select("pid", "n", "gid", F.lit(0).cast("long").alias("leaf"), "embedding")
    alone = small.select(F.col("_gid").alias("gid"), F.lit(0).cast("long").alias("i"), F.lit(0).cast("long").alias("j"))
    large = sizes.where(F.col("points") > leaf)
    if not large.limit(1).count():
        return held, alone
    # Hashes name the sample: about one and a half times as many points as wanted, of which the least are taken.
    wanted = F.least(F.ceil(2 * F.col("points") / leaf), F.lit(pivots))
    met = points.join(large, F.col("gid") == F.col("_gid")).withColumns({"wanted": wanted, "h": F.pmod(F.xxhash64("pid"), F.lit(1 << 30))})
    sample = met.where(F.col("h") * F.col("points") < (1 << 30) * (1.5 * F.col("wanted") + 8))
    numbered = sample.groupBy("gid", "wanted", "points").agg(F.array_sort(F.collect_list(F.struct("h", "pid", "embedding"))).alias("all"))
    taken = numbered.select("gid", "points", F.posexplode(F.slice("all", F.lit(1), F.col("wanted").cast("int"))).alias("at", "x"))
    centres = materialize(taken.select("gid", "points", F.col("at").cast("long").alias("leaf"), F.col("x.embedding").alias("embedding")), "cover-pivots")
    # Shares of a label's points meet a copy of its pivots each.
    shares = F.ceil(F.col("points") / 8192)
    copies = centres.select("gid", F.explode(F.sequence(F.lit(0).cast("long"), shares - 1)).alias("share"), "leaf", F.lit(None).cast("long").alias("pid"), "embedding")
    own = met.select("gid", F.pmod(F.col("h"), shares).alias("share"), F.lit(None).cast("long").alias("leaf"), "pid", "embedding")
    both = copies.unionByName(own).withColumnRenamed("gid", "_label").withColumn("gid", F.xxhash64("_label", "share"))
    near = T.StructType([T.StructField("pid", T.LongType()), T.StructField("leaf", T.LongType()), T.StructField("away", T.DoubleType())])
    order = [F.col("gid"), F.col("leaf").asc_nulls_last()]
    nearest = both.repartition("gid").sortWithinPartitions(*order).select("gid", "leaf", "pid", "embedding").mapInArrow(_nearest, near)
    nearest = materialize(nearest.withColumnsRenamed({"pid": "_pid"}), "cover-nearest")
    placed = points.select("pid", "n", "gid", "embedding").join(nearest, F.col("pid") == F.col("_pid"))
    radius = placed.groupBy(F.col("gid").alias("_g"), F.col("leaf").alias("_l")).agg(F.max("away").alias("radius"))
    known = centres.join(radius, (F.col("gid") == F.col("_g")) & (F.col("leaf") == F.col("_l"))).select("gid", "leaf", "radius", "embedding")
    pair = T.StructType([T.StructField(c, T.LongType()) for c in ("gid", "i", "j")])
    walked = known.repartition("gid").sortWithinPartitions("gid", "leaf").mapInArrow(_pairs_of(threshold), pair)
    return held.unionByName(placed.select("pid", "n", "gid", "leaf", "embedding")), alone.unionByName(walked)
