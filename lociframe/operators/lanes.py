"""Read order and lane layout.

First fit is sequential, but for reads in file order it falls apart into islands: once everything before ends,
with the gap, left of all that follows, lanes start anew. Islands are found with window aggregates over the distinct starts,
and a contig is cut where islands begin into stretches of about as many rows; each is then sorted by Spark and laid out as a
stream that holds the bounds of its lanes, whatever the number of its rows. The bounds lie in trees, so a row costs the
logarithm of the lanes; in file order the rows of a deep start are placed together, by arrays.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lociframe.operators import tiles
from lociframe.operators.joins import overlap_join, running_count
from lociframe.operators.tables import kept

READ_GAP, PAIR_GAP = 3, 10
FEW_LANES = 1 << 16  # that are broadcast
STREAMS = 256  # of a layout, but for stretches of fewer than LEAST rows
LEAST = 1 << 12
RUN = 1 << 10  # rows of an array of in_runs


def base_rank(base: Column, deletion: Column, insertion: Column, gap: Column | None = None) -> Column:
    """Sort rank at a position: A, T, C, G, N, other, deletion, insertion, pair gap; null for none of these.

    An aligned base counts before a deletion, and that before an insertion at the same position.
    """
    ranked = F.when(F.upper(base) == "A", 0)
    for i, b in enumerate("TCGN", 1):
        ranked = ranked.when(F.upper(base) == b, i)
    ranked = ranked.when(base.isNotNull(), 5).when(deletion, 6).when(insertion, 7)
    return ranked.when(gap, 8) if gap is not None else ranked


def sort_columns(keys: Sequence[str | tuple[str, bool]]) -> list[Column]:
    """``orderBy`` columns of named keys, each with an optional reverse flag; repeated keys count once.

    START, STRAND, MAPQ (high first), READ_ORDER, READ_NAME, LENGTH, READ_GROUP, SAMPLE (``with_samples``), INSERT_SIZE,
    MATE_CONTIG, TAG:XX for a tag's text, and RANK for a computed base rank.
    """
    flag = F.col("flag")
    columns = {
        "START": F.col("start"),
        "STRAND": flag.bitwiseAND(16),
        "MAPQ": -F.col("mapq"),
        "READ_ORDER": F.when(flag.bitwiseAND(64) != 0, 0).when(flag.bitwiseAND(128) != 0, 1).otherwise(2),
        "READ_NAME": F.col("qname"),
        "LENGTH": F.col("end") - F.col("start"),
        "READ_GROUP": F.col("read_group"),
        "SAMPLE": F.col("sample"),
        "INSERT_SIZE": F.col("tlen"),
        "MATE_CONTIG": F.col("mate_contig"),
        "RANK": F.col("rank"),
    }
    out, seen = [], set()
    for key in keys:
        name, reverse = key if isinstance(key, tuple) else (key, False)
        if name not in seen:
            seen.add(name)
            column = F.try_element_at("tags", F.lit(name[4:])) if name.startswith("TAG:") else columns[name]
            out.append(column.desc_nulls_last() if reverse else column.asc_nulls_last())
    return out


def with_samples(reads: DataFrame, groups: DataFrame) -> DataFrame:
    """``reads`` with ``sample``, that of their file's read group (``file, read_group, sample``); null where the header names none."""
    known = groups.groupBy(F.col("file").alias("_f"), F.col("read_group").alias("_g")).agg(F.min("sample").alias("sample"))
    return reads.join(known, (F.col("file") == F.col("_f")) & (F.col("read_group") == F.col("_g")), "left").drop("_f", "_g")


class Lanes:
    """Lanes in order with the span each is filled over; ``place`` fits a row into one.

    Two trees over the lanes, a node above its two: the greatest left bound, and the least right bound.
    """

    def __init__(self, gap: int) -> None:
        self.gap, self.count, self.size = gap, 0, 1
        self.left, self.right = [-math.inf] * 2, [math.inf] * 2

    @classmethod
    def filled(cls, gap: int, start: np.ndarray, end: np.ndarray) -> Lanes:
        """A lane for each row, in order."""
        lanes = cls(gap)
        lanes.count = len(start)
        lanes.size = 1 << max(0, lanes.count - 1).bit_length()
        for name, values, none, best in (("left", start, -math.inf, np.maximum), ("right", end, math.inf, np.minimum)):
            level = np.full(lanes.size, none)
            level[: lanes.count] = values
            levels = [level]
            while len(level) > 1:
                level = best(level[::2], level[1::2])
                levels.insert(0, level)
            setattr(lanes, name, np.concatenate([[none], *levels]).tolist())
        return lanes

    def place(self, start: int, end: int) -> int:
        """The first lane with room on its left; else the first with room on its right; else a new one."""
        left, right = self.left, self.right
        if left[1] > end + self.gap:
            node = 1
            while node < self.size:
                node *= 2
                if left[node] <= end + self.gap:
                    node += 1
            return self._set(left, max, node, start)
        if right[1] < start - self.gap:
            node = 1
            while node < self.size:
                node *= 2
                if right[node] >= start - self.gap:
                    node += 1
            return self._set(right, min, node, end)
        return self.add(start, end)

    def add(self, start: int, end: int) -> int:
        """A new lane."""
        if self.count == self.size:
            self._grow()
        node = self.size + self.count
        self.count += 1
        self._set(self.left, max, node, start)
        return self._set(self.right, min, node, end)

    def _set(self, tree: list[float], best, node: int, value: int) -> int:
        lane = node - self.size
        tree[node] = value
        while node > 1:
            node //= 2
            tree[node] = best(tree[2 * node], tree[2 * node + 1])
        return lane

    def _grow(self) -> None:
        leaves = [(self.left[self.size :], -math.inf, max), (self.right[self.size :], math.inf, min)]
        self.size *= 2
        for name, (values, none, best) in zip(("left", "right"), leaves, strict=True):
            tree = [none] * self.size + values + [none] * (self.size - len(values))
            for node in range(self.size - 1, 0, -1):
                tree[node] = best(tree[2 * node], tree[2 * node + 1])
            setattr(self, name, tree)


class RightLanes:
    """Lanes that rows in file order fill: such rows never fit on the left of a lane, so one bound of a lane decides.

    The bounds lie in blocks with the least of each, so that the first free lanes are found without a look at the others.
    """

    BLOCK = 1 << 10
    FEW = 16  # rows that are placed one by one

    def __init__(self, gap: int) -> None:
        self.gap, self.count, self.last = gap, 0, None
        self.right = np.full((1, self.BLOCK), np.iinfo(np.int64).max)
        self.left = np.zeros(self.BLOCK, np.int64)
        self.least = self.right.min(axis=1)

    def fits(self, start: np.ndarray, end: np.ndarray) -> bool:
        """Whether none of the rows has room on the left of a lane, nor on the right of one of the others."""
        last = int(start.max())
        return max(last, last if self.last is None else self.last) <= int(end.min()) + self.gap

    def place(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The lanes of rows that fit, in order: the first one free, else a new one."""
        last = int(start.max())
        self.last = last if self.last is None else max(self.last, last)
        before = start - self.gap
        if len(start) < self.FEW:
            return np.array([self._one(*row) for row in zip(before.tolist(), start.tolist(), end.tolist(), strict=True)], np.int64)
        if int(before.min()) == int(before.max()):
            free = self._free(int(before[0]), len(start))
            lanes = np.concatenate([free, np.arange(self.count, self.count + len(start) - len(free))])
        else:
            lanes = self._several(before)
        new = lanes >= self.count
        while self.count + int(new.sum()) > self.right.size:
            self._grow()
        self.count += int(new.sum())
        self.left[lanes[new]] = start[new]
        self.right.reshape(-1)[lanes] = end
        blocks = np.unique(lanes // self.BLOCK)
        self.least[blocks] = self.right[blocks].min(axis=1)
        return lanes

    def _one(self, before: int, start: int, end: int) -> int:
        free = self.least < before
        block = int(free.argmax())
        if free[block]:
            lane = block * self.BLOCK + int((self.right[block] < before).argmax())
        else:
            lane = self.count
            if lane == self.right.size:
                self._grow()
            self.count += 1
            self.left[lane] = start
            block = lane // self.BLOCK
        self.right[block, lane % self.BLOCK] = end
        self.least[block] = self.right[block].min()
        return lane

    def _free(self, before: int, n: int) -> np.ndarray:
        """The first ``n`` lanes, or fewer, that end before."""
        blocks = np.flatnonzero(self.least < before)
        found, got, at, step = [], 0, 0, 1
        while got < n and at < len(blocks):
            some = blocks[at : at + step]
            row, column = np.nonzero(self.right[some] < before)
            found.append(some[row] * self.BLOCK + column)
            got, at, step = got + len(row), at + step, 2 * step
        return np.concatenate(found)[:n] if found else np.empty(0, np.int64)

    def _several(self, before: np.ndarray) -> np.ndarray:
        """Lanes of rows of unlike starts: a lane free for one may not be for another, but all ask in the order of lanes."""
        bounds, which = np.unique(before, return_inverse=True)
        free = [iter(self._free(int(b), len(before)).tolist()) for b in bounds]
        new, used, out = self.count, set(), []
        for k in which.tolist():
            for lane in free[k]:
                if lane not in used:
                    break
            else:
                lane, new = new, new + 1
            used.add(lane)
            out.append(lane)
        return np.array(out, np.int64)

    def _grow(self) -> None:
        more = np.full_like(self.right, np.iinfo(np.int64).max)
        self.right = np.concatenate([self.right, more])
        self.left = np.concatenate([self.left, np.zeros(more.size, np.int64)])
        self.least = self.right.min(axis=1)

    @classmethod
    def of(cls, trees: Lanes) -> RightLanes:
        """The lanes of ``trees``."""
        lanes = cls(trees.gap)
        while lanes.right.size < trees.count:
            lanes._grow()
        n = lanes.count = trees.count
        lanes.left[:n], lanes.right.reshape(-1)[:n] = trees.left[trees.size :][:n], trees.right[trees.size :][:n]
        lanes.least = lanes.right.min(axis=1)
        lanes.last = int(lanes.left[:n].max()) if n else None
        return lanes

    def as_trees(self) -> Lanes:
        """The same lanes for rows in any order."""
        lanes = Lanes(self.gap)
        for start, end in zip(self.left[: self.count].tolist(), self.right.reshape(-1)[: self.count].tolist(), strict=True):
            lanes.add(start, end)
        return lanes


class FileOrder:
    """First fit of a sorted stretch, the rows of a start after those of another: by trees, and by arrays from the first deep start on.

    A start whose rows may fit on the left of a lane ends the arrays for the stretch.
    """

    DEEP = 64  # rows of a start

    def __init__(self, gap: int) -> None:
        self.trees, self.arrays, self.sound = Lanes(gap), None, True

    def place(self, start: np.ndarray, end: np.ndarray) -> np.ndarray | list[int]:
        if self.arrays is None and self.sound and len(start) >= self.DEEP:
            self.arrays = RightLanes.of(self.trees)
        if self.arrays is not None:
            if self.arrays.fits(start, end):
                return self.arrays.place(start, end)
            self.trees, self.arrays, self.sound = self.arrays.as_trees(), None, False
        return [self.trees.place(*row) for row in zip(start.tolist(), end.tolist(), strict=True)]


def first_fit(spans: Sequence[tuple[int, int]], gap: int) -> list[int]:
    """Lane of each span, placed in order."""
    lanes = Lanes(gap)
    return [lanes.place(start, end) for start, end in spans]


def with_islands(rows: DataFrame, gap: int, group: Sequence[str] = ("contig",), size: int = tiles.ROWS, known: int | None = None) -> DataFrame:
    """``rows`` (``id, start, s_start, s_end``) with ``island``, the first start of each island.

    An island begins where all later starts lie over all earlier ends plus the gap; rows of equal start are always in one.
    Windows run over tiles of equal counts, with the extremes of the tiles before and behind carried in, so neither a
    contig nor a deep locus is one task.
    """
    by = [*group, "_tile"]
    tiled = tiles.equal_tiles(rows, F.col("start"), group, size, known)
    before = Window.partitionBy(*group).orderBy("_tile").rowsBetween(Window.unboundedPreceding, -1)
    # Backwards, as Spark computes a frame up to the last row anew for each row.
    behind = Window.partitionBy(*group).orderBy(F.desc("_tile")).rowsBetween(Window.unboundedPreceding, -1)
    extremes = tiled.groupBy(*by).agg(F.max("s_end").alias("_e"), F.min("s_start").alias("_s"))
    carried = extremes.select(*by, F.max("_e").over(before).alias("_before"), F.min("_s").over(behind).alias("_behind"))
    forward = Window.partitionBy(*by).orderBy("start", "id")
    earlier = F.greatest(F.max("s_end").over(forward.rowsBetween(Window.unboundedPreceding, -1)), F.col("_before"))
    back = Window.partitionBy(*by).orderBy(F.desc("start"), F.desc("id")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    later = F.least(F.min("s_start").over(back), F.col("_behind"))
    first = F.when(earlier.isNull() | (later > earlier + gap), F.col("start"))
    marked = tiled.join(carried, by).withColumn("_first", first)
    firsts = marked.groupBy(*by).agg(F.max("_first").alias("_f")).select(*by, F.max("_f").over(before).alias("_last"))
    island = F.coalesce(F.max("_first").over(forward.rowsBetween(Window.unboundedPreceding, Window.currentRow)), F.col("_last"))
    return marked.join(firsts, by).withColumn("island", island).drop("_tile", "_before", "_behind", "_first", "_last")


def _laid_out(rows: DataFrame, keys: Sequence[str], out: Sequence[str], order: Sequence[Column], gap: int, most: int | None = None) -> DataFrame:
    """``out, lane`` of ``rows`` (``s_start, s_end, rank``), a group of ``keys`` after the other as a stream that holds lane bounds only."""
    schema = T.StructType([*[rows.schema[c] for c in out], T.StructField("lane", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, lanes, n = None, Lanes(gap), 0
        for b in batches:
            found = []
            columns = (b.column(c).to_pylist() for c in ("s_start", "s_end", "rank", *keys))
            for start, end, rank, *k in zip(*columns, strict=True):
                if k != key:
                    key, lanes, n = k, Lanes(gap), 0
                n += 1
                if most is not None and n > most:
                    raise ValueError(f"a group has over {most} rows, the max_island or max_rows given")
                found.append(lanes.place(start, end) if rank is None else lanes.add(start, end))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in out), pa.array(found, pa.int32())], [*out, "lane"])

    needed = list(dict.fromkeys([*keys, *out, "s_start", "s_end", "rank"]))
    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).select(*needed).mapInArrow(run, schema)


def starts_of(rows: DataFrame, group: Sequence[str] = ("contig",), n: Column | None = None) -> DataFrame:
    """What of ``rows`` decides where islands lie: the group, ``start, s_start, s_end, n``, a row for each start; ``n`` counts the rows that one stands for."""
    count = F.count(F.lit(1)) if n is None else F.sum(n)
    return rows.groupBy(*group, "start").agg(F.min("s_start").alias("s_start"), F.max("s_end").alias("s_end"), count.cast("long").alias("n"))


def stretches(starts: DataFrame, gap: int, group: Sequence[str] = ("contig",), max_island: int | None = None) -> tuple[DataFrame, int]:
    """Groups cut into stretches where islands begin, and the number of streams they are dealt to.

    The table has a row for each group: ``_g_*``, and ``_cuts``, the first starts of its stretches in order with their streams.
    A stretch holds about as many rows as others or is one island; short ones share a stream. There are at most as many
    cuts as rows divided by a stretch, and one for each group.
    """
    starts = kept(starts)
    found = with_islands(starts.withColumn("id", F.col("start")), gap, group, known=starts.count())
    islands = kept(found.groupBy(*group, "island").agg(F.sum("n").alias("n")))
    total, most, number = islands.agg(F.sum("n"), F.max("n"), F.count(F.lit(1))).first()
    if max_island is not None and most is not None and most > max_island:
        raise ValueError(f"a group has over {max_island} rows, the max_island given")
    size = min(max((total or 0) // STREAMS, LEAST), tiles.ROWS)
    key = F.struct(*group) if len(group) > 1 else F.col(group[0])
    counted = running_count(islands.select(key.alias("contig"), "island", "n"), "island", F.col("n"), "upto", known=number)
    cut = counted.groupBy("contig", F.floor((F.col("upto") - F.col("n")) / size).alias("_k")).agg(F.min("island").alias("first"), F.sum("n").alias("n"))
    # One window over the cuts of all groups, which are few.
    before = F.coalesce(F.sum("n").over(Window.orderBy("contig", "first").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    dealt = cut.withColumn("_s", F.floor(before / size)).withColumn("stream", F.dense_rank().over(Window.orderBy("_s")) - 1)
    own = [F.col("contig" if len(group) == 1 else f"contig.{g}").alias(f"_g_{g}") for g in group]
    cuts = kept(dealt.groupBy("contig").agg(F.array_sort(F.collect_list(F.struct("first", "stream"))).alias("_cuts")).select(*own, "_cuts"))
    streams = cuts.agg(F.max(F.array_max(F.transform("_cuts", lambda c: c["stream"])))).first()[0]
    return cuts, (streams or 0) + 1


def _in_streams(rows: DataFrame, cuts: DataFrame, streams: int, group: Sequence[str]) -> DataFrame:
    """``rows`` dealt by the streams of their stretches, each in file order, a group after the other."""
    same = [F.col(g) == F.col(f"_g_{g}") for g in group]
    steps = F.array(*[F.lit(1 << k) for k in range(20, -1, -1)])
    last = F.aggregate(steps, F.lit(0), lambda low, s: F.when(F.get("_cuts", low + s)["first"] <= F.col("start"), low + s).otherwise(low))
    at = F.when(F.size("_cuts") == 1, F.lit(0)).otherwise(last)
    met = rows.join(F.broadcast(cuts), same).withColumn("_at", F.get("_cuts", at)).select(*rows.columns, F.col("_at.stream").cast("int").alias("_stream"))
    return met.repartitionById(streams, F.col("_stream")).sortWithinPartitions(*group, "start", "id").drop("_stream")


def assign_lanes(
    rows: DataFrame, gap: int = READ_GAP, group: Sequence[str] = ("contig",), max_island: int | None = None, carried: Sequence[str] = (), starts: DataFrame | None = None
) -> DataFrame:
    """``id, lane`` and ``carried`` of ``rows`` (``id, contig, start, s_start, s_end``) by first fit in file order; over ``max_island`` rows, where given, raise an error.

    With a column ``visible``, rows for which it is false take no room and get lane 0; the result keeps the column.
    ``starts`` is what ``starts_of`` finds in the visible rows, for callers that have a shorter way to it.
    """
    filtered = "visible" in rows.columns
    shown = rows.where("visible") if filtered else rows
    group, out = list(group), ["id", *carried]
    cuts, streams = stretches(starts_of(shown, group) if starts is None else starts, gap, group, max_island)
    schema = T.StructType([*[rows.schema[c] for c in out], T.StructField("lane", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, lanes = None, None
        for b in batches:
            if not b.num_rows:
                continue
            start, s_start, s_end = (b.column(c).to_numpy(zero_copy_only=False) for c in ("start", "s_start", "s_end"))
            ends = [pa.compute.run_end_encode(b.column(c)).run_ends.to_numpy() for c in group]
            whole = np.unique(np.concatenate([np.zeros(1, np.int64), *ends]))
            found = np.empty(b.num_rows, np.int64)
            for first, last in zip(whole[:-1].tolist(), whole[1:].tolist(), strict=True):
                own = [b.column(c)[first].as_py() for c in group]
                if own != key:
                    key, lanes = own, FileOrder(gap)
                edges = [first, *(np.flatnonzero(np.diff(start[first:last])) + first + 1).tolist(), last]
                for i, j in zip(edges, edges[1:]):  # noqa: B905
                    found[i:j] = lanes.place(s_start[i:j], s_end[i:j])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in out), pa.array(found.astype(np.int32))], [*out, "lane"])

    needed = list(dict.fromkeys([*group, *out, "start", "s_start", "s_end"]))
    laid = _in_streams(shown.select(*needed), cuts, streams, group).mapInArrow(run, schema)
    if not filtered:
        return laid
    hidden = rows.where(~F.coalesce("visible", F.lit(False))).select(*out, F.lit(0).alias("lane"), F.lit(False).alias("visible"))
    return laid.withColumn("visible", F.lit(True)).unionByName(hidden)


def in_runs(rows: DataFrame, group: Sequence[str], carried: str | None = None, gap: int | None = None) -> DataFrame:
    """Rows (``id, start, rank``) of a group in the order of these, nulls last, as runs of at most ``RUN``: the group, ``carried, first, ids, lanes``.

    ``carried`` is a column that a run has one value of. Rows count from 0 on in ``first``, and the n-th id of a run stands n behind it. With a ``gap``, the places are
    lanes, also of ``s_start, s_end``: ranked rows take one each, the others are fitted around them, and runs of these name theirs in ``lanes``.
    With a column ``visible``, rows for which it isn't true come last, in lane 0. Nothing is dealt out: the rows of a group lie in one partition.
    A task holds the bounds of a group's ranked rows at most.
    """
    own = [*group, *([carried] if carried else [])]
    fields = [T.StructField("first", T.IntegerType()), T.StructField("ids", T.ArrayType(T.LongType())), T.StructField("lanes", T.ArrayType(T.IntegerType()))]
    schema = T.StructType([*[rows.schema[c] for c in own], *fields])
    hides = "visible" in rows.columns

    def cuts(columns: Sequence[pa.Array]) -> np.ndarray:
        """Where one of the columns changes, and both ends."""
        return np.unique(np.concatenate([np.zeros(1, np.int64), *[pa.compute.run_end_encode(c).run_ends.to_numpy() for c in columns]]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n, bounds, lanes = None, 0, [], None
        for b in batches:
            if not b.num_rows:
                continue
            ranked = b.column("rank").is_valid()
            visible = b.column("visible").to_numpy(zero_copy_only=False) if hides else None
            ranked_at = ranked.to_numpy(zero_copy_only=False)
            edges = cuts([*(b.column(c) for c in own), ranked, *([b.column("visible")] if hides else [])])
            spans = [b.column(c).to_numpy(zero_copy_only=False) for c in ("s_start", "s_end")] if gap is not None else []
            starts, firsts, named, named_at, none = [], [], [], [0], []
            for i, j in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                now = [b.column(c)[i].as_py() for c in group]
                if now != key:
                    key, n, bounds, lanes = now, 0, [], None
                given = None
                if visible is not None and not visible[i]:
                    given = [0] * (j - i)
                elif gap is not None and ranked_at[i]:
                    bounds.append([x[i:j] for x in spans])
                elif gap is not None:
                    if lanes is None:
                        lanes = Lanes.filled(gap, *(np.concatenate([np.empty(0, np.int64), *x]) for x in (zip(*bounds, strict=True) if bounds else ([], []))))
                        bounds = []
                    given = [lanes.place(*x) for x in zip(*(x[i:j].tolist() for x in spans), strict=True)]
                for k in range(i, j, RUN):
                    starts.append(k)
                    firsts.append(n + k - i)
                    none.append(given is None)
                    named.extend([] if given is None else given[k - i : k - i + RUN])
                    named_at.append(len(named))
                n += j - i
            lists = pa.ListArray.from_arrays(pa.array([*starts, b.num_rows], pa.int32()), b.column("id"))
            offsets = pa.array(named_at, pa.int32(), mask=np.array([*none, False]))
            taken = pa.array(starts)
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(taken) for c in own), pa.array(firsts, pa.int32()), lists, pa.ListArray.from_arrays(offsets, pa.array(named, pa.int32()))], schema.names)

    shown = [F.coalesce("visible", F.lit(False)).alias("visible")] if hides else []
    order = [*[F.desc("visible") for _ in shown], F.col("rank").asc_nulls_last(), F.col("start"), F.col("id")]
    needed = list(dict.fromkeys([*own, "id", "start", "rank", *(["s_start", "s_end"] if gap is not None else [])]))
    return rows.select(*[c for c in needed if c != "visible"], *shown).sortWithinPartitions(*group, *order).mapInArrow(run, schema)


def assign_lanes_sorted(rows: DataFrame, gap: int = READ_GAP, group: Sequence[str] = ("region_id",), max_rows: int | None = None, runs: bool = False) -> DataFrame:
    """The group, ``id, lane`` where rows with a ``rank`` take lanes 0, 1, ... in its order and the others are fitted around them, a region at a time.

    With a column ``visible``, rows for which it isn't true take no lane, whatever their rank, and get lane 0; the result keeps the column.
    With ``runs``, a group's rows lie in one partition already and come as those of ``in_runs``.
    """
    if runs:
        return in_runs(rows, group, "visible" if "visible" in rows.columns else None, gap)
    filtered = "visible" in rows.columns
    shown = rows.where("visible") if filtered else rows
    order = [F.col("rank").asc_nulls_last(), F.col("start"), F.col("id")]
    laid = _laid_out(shown.select("id", *group, "start", "s_start", "s_end", "rank"), list(group), [*group, "id"], order, gap, max_rows)
    if not filtered:
        return laid
    hidden = rows.where(~F.coalesce("visible", F.lit(False))).select(*group, "id", F.lit(0).alias("lane"), F.lit(False).alias("visible"))
    return laid.withColumn("visible", F.lit(True)).unionByName(hidden)


def multi_key_places(rows: DataFrame, order: Sequence[Column], name: str = "place") -> DataFrame:
    """``rows`` with their places in ``order``: a range sort, with the counts of the ranges before carried in."""
    # Kept, as a second run of the range sort could cut it elsewhere.
    parts = kept(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    # The number of a row's partition stands above its 33 bits.
    parts = parts.withColumn("_part", F.shiftright("_at", 33))
    sizes = parts.groupBy("_part").count()
    before = sizes.select("_part", F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = F.col("_before") + F.col("_at").bitwiseAND((1 << 33) - 1) + 1
    return parts.join(F.broadcast(before), "_part").withColumn(name, place.cast("long")).drop("_at", "_part", "_before")


def _shown(lanes: DataFrame) -> DataFrame:
    return lanes.where("visible") if "visible" in lanes.columns else lanes


def lane_index(laid: DataFrame, rows: DataFrame | None = None, group: Sequence[str] = ("contig",)) -> DataFrame:
    """The rows of each lane: the group, ``lane, ordinal, id, start, s_start, s_end``, ordinals from 1 on in file order; hidden rows aren't in it.

    ``laid`` has ``id, lane``; ``rows`` the group and bounds of each id, without ``rows`` these are carried in ``laid``. The table comes sorted by range, so a lane of any
    length is dealt over tasks: places among all rows, less those before the lane.
    """
    own = [*group, "id", "start", "s_start", "s_end"]
    if rows is None:
        met = _shown(laid).select(*own, "lane")
    else:
        met = rows.select(*own).join(_shown(laid).select(F.col("id").alias("_i"), "lane"), F.col("id") == F.col("_i")).drop("_i")
    by = [*group, "lane"]
    placed = multi_key_places(met, [F.col(c) for c in (*by, "start", "id")], "_place")
    first = placed.groupBy(*[F.col(c).alias(f"_{c}") for c in by]).agg(F.min("_place").alias("_first"))
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    return placed.join(first, same).select(*group, "lane", (F.col("_place") - F.col("_first") + 1).alias("ordinal"), "id", "start", "s_start", "s_end")


def first_in_lane(index: DataFrame, asked: DataFrame, id: str, group: Sequence[str] = ("contig",), bin_size: int = 1 << 10) -> DataFrame:
    """``asked`` (the group, ``lane, left, right`` and a key ``id``) with ``found``: the first row of the lane, in file order, over ``left..right``; null where there is none.

    ``index`` is one of ``lane_index``, or rows laid out that carry ``start, s_start, s_end`` and the group, as ordinals aren't needed.
    Only rows of lanes that are asked for go on; they meet questions by (group, lane, bin).
    """
    # A lane of a group stands for a contig; nulls meet nothing.
    place = F.struct(*[F.col(c) for c in (*group, "lane")]).alias("contig")
    whole = F.when(F.greatest(*[F.col(c).isNull().cast("int") for c in (*group, "lane")]) == 0, F.lit(True))
    questions = asked.where(whole).select(F.col(id).alias("_q"), place, F.col("left").alias("start"), F.col("right").alias("end"))
    lanes = kept(asked.where(whole).select(*group, "lane").distinct())
    few = F.broadcast(lanes) if lanes.count() <= FEW_LANES else lanes
    rows = _shown(index).join(few, [*group, "lane"], "left_semi").select(place, F.col("s_start").alias("start"), F.col("s_end").alias("end"), F.struct("start", "id").alias("row"))
    hits = overlap_join(questions, rows, bin_size)
    best = hits.groupBy("_q").agg(F.min("r_row")["id"].alias("found"))
    return asked.join(best, F.col(id) == F.col("_q"), "left").drop("_q")


def lane_counts(lanes: DataFrame) -> DataFrame:
    """``lane, n``: the number of visible rows of each lane."""
    return _shown(lanes).groupBy("lane").agg(F.count(F.lit(1)).alias("n"))


def depth(lanes: DataFrame) -> DataFrame:
    """Number of lanes."""
    return _shown(lanes).agg(F.coalesce(F.max("lane") + 1, F.lit(0)).alias("depth"))
