"""Interval overlap joins and k-th neighbour rank joins."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociframe.operators import tiles
from lociframe.operators.tables import alike, kept

CELL = 1 << 11  # rows of either side of a cell of dealt_join
PAIRS = 1 << 22  # pairs that a task of dealt_join makes
TASKS = 1 << 11  # of dealt_join at most
TOP = 10  # level of the largest blocks of first_over, 4 ** TOP positions
WIDE = 64  # bins that an interval may be copied to before a coarser size is used


def overlap_join(left: DataFrame, right: DataFrame, bin_size: int = 1 << 14, how: str = "inner", levels: int = 2) -> DataFrame:
    """Pairs of rows that share a position; both sides have ``contig, start, end``, the right ones come as ``r_*``.

    Intervals meet by (contig, bin) and a pair is kept only in the later of the two first bins, so no distinct
    is needed. An interval over more than ``WIDE`` bins meets others by bins ``WIDE`` times as large, level by
    level; the last level takes whatever is left. At each level only pairs with a side of that level meet, so narrow rows
    are never compared in wide bins. ``how='left'`` adds left rows without a partner; repeated rows of either side stay.
    """
    r = right.select([F.col(c).alias(f"r_{c}") for c in right.columns])
    level = lambda width: sum((F.when(width > bin_size * WIDE ** (i + 1), 1).otherwise(0) for i in range(levels - 1)), F.lit(0))
    a = left.withColumn("_la", level(F.col("end") - F.col("start")))
    b = r.withColumn("_lb", level(F.col("r_end") - F.col("r_start")))

    def meet(x: DataFrame, y: DataFrame, size: int) -> DataFrame:
        bins = lambda s, e: F.explode(F.sequence(F.floor(s / size), F.floor(e / size)))
        x = x.drop("_la").withColumn("_bin", bins(F.col("start"), F.col("end")))
        y = y.drop("_lb").withColumn("_rbin", bins(F.col("r_start"), F.col("r_end")))
        on = (
            (F.col("contig") == F.col("r_contig"))
            & (F.col("_bin") == F.col("_rbin"))
            & (F.col("start") <= F.col("r_end"))
            & (F.col("end") >= F.col("r_start"))
            & (F.col("_bin") == F.greatest(F.floor(F.col("start") / size), F.floor(F.col("r_start") / size)))
        )
        return x.join(y, on).drop("_bin", "_rbin")

    out = meet(a.where("_la = 0"), b.where("_lb = 0"), bin_size)
    for k in range(1, levels):
        size = bin_size * WIDE**k
        out = out.unionByName(meet(a.where(F.col("_la") == k), b.where(F.col("_lb") <= k), size))
        out = out.unionByName(meet(a.where(F.col("_la") < k), b.where(F.col("_lb") == k), size))
    if how == "left":
        met = out.select([F.col(c).alias(f"_m_{c}") for c in left.columns]).distinct()
        same = [F.col(c).eqNullSafe(F.col(f"_m_{c}")) for c in left.columns]
        out = out.unionByName(left.join(met, same, "left_anti"), allowMissingColumns=True)
    return out


def dealt_join(left: DataFrame, right: DataFrame, keys: Sequence[str], cell: int = CELL, weight: Column | None = None) -> DataFrame:
    """Inner join by ``keys`` for results far larger than both tables, with the pairs dealt over tasks evenly.

    The rows of a key are cut into runs of about ``cell`` on both sides, and each run of the one meets each of the other: the
    cells of a grid, dealt by key and cell. So the copies are about twice the pairs divided by ``cell``, whatever the depth of
    a key; with more pairs than fill ``TASKS``, cells grow with them, so that the copies grow as the tables do.
    The tasks follow from the number of pairs, as the bytes of the tables say nothing about it. Rows with a null key meet nothing.
    A row on the right counts for ``weight`` rows, where given.
    """
    count = lambda df, n, c: df.groupBy(*keys).agg(c.cast("long").alias(n))
    grid = kept(count(left, "_nl", F.count(F.lit(1))).join(count(right, "_nr", F.count(F.lit(1)) if weight is None else F.sum(weight)), list(keys)))
    total = grid.agg(F.sum(F.col("_nl") * F.col("_nr"))).first()[0] or 0
    tasks, cell = min(TASKS, total // PAIRS + 1), max(cell, math.isqrt(total // (2 * TASKS)))
    runs = lambda n: F.ceil(F.col(n) / cell)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), runs(n) - 1))
    own = lambda df, n: F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in df.columns]), runs(n))
    by = [*keys, "_a", "_b"]

    def dealt(df: DataFrame, a: Column, b: Column) -> DataFrame:
        met = df.join(grid, list(keys)).select(*df.columns, "_nl", "_nr", a.alias("_a"))
        return met.select(*df.columns, "_a", b.alias("_b")).repartition(tasks, *by)

    return dealt(left, own(left, "_nl"), every("_nr")).join(dealt(right, every("_nl"), own(right, "_nr")), by).drop("_a", "_b")


def overlap_pairs(left: DataFrame, right: DataFrame, bin_size: int = 1 << 14, levels: int = 2, cell: int = CELL) -> DataFrame:
    """The rows of an inner ``overlap_join``, for results far larger than both tables: pairs are dealt evenly, however few and deep the bins are."""
    r = right.select([F.col(c).alias(f"r_{c}") for c in right.columns])
    # Which levels meet, and in which bins: of the first size only narrow rows, of each other one those where a side is as wide.
    meets = [(0, 0, 0, 0, 0)] + [m for k in range(1, levels) for m in ((k, k, k, 0, k), (k, 0, k - 1, k, k))]

    def binned(df: DataFrame, start: Column, end: Column, side: int, first_bin: str) -> DataFrame:
        level = sum((F.when(end - start > bin_size * WIDE ** (i + 1), 1).otherwise(0) for i in range(levels - 1)), F.lit(0))
        none = F.array().cast("array<struct<_meet:int,_bin:bigint,_first:bigint>>")

        def of(i: int, k: int, low: int, high: int) -> Column:
            first, last = (F.floor(x / (bin_size * WIDE**k)) for x in (start, end))
            bins = F.transform(F.sequence(first, last), lambda b: F.struct(F.lit(i).alias("_meet"), b.alias("_bin"), first.alias("_first")))
            return F.when(level.between(low, high), bins).otherwise(none)

        own = F.concat(*[of(i, m[0], *m[1 + 2 * side : 3 + 2 * side]) for i, m in enumerate(meets)])
        return df.select("*", F.inline(own)).withColumnRenamed("_first", first_bin)

    a = binned(left.where("contig is not null"), F.col("start"), F.col("end"), 0, "_lfirst")
    b = binned(r.where("r_contig is not null"), F.col("r_start"), F.col("r_end"), 1, "_rfirst").withColumn("contig", F.col("r_contig"))
    both = dealt_join(a, b, ["contig", "_meet", "_bin"], cell)
    # Once, in the later of the two first bins.
    met = both.where((F.col("_bin") == F.greatest("_lfirst", "_rfirst")) & (F.col("start") <= F.col("r_end")) & (F.col("end") >= F.col("r_start")))
    return met.select(*left.columns, *r.columns)


def overlapping_ids(left: DataFrame, right: DataFrame, left_id: str, right_id: str, bin_size: int = 1 << 14, levels: int = 2) -> DataFrame:
    """``left_id, right_id`` of the pairs of an inner ``overlap_join``: equal intervals of a side meet the other's as one, up to 1,024 at a time, and pairs are made where they met."""
    spans = ["contig", "start", "end"]
    # Kept, as they are counted before they are joined.
    a, b = (kept(alike(df.where("contig is not null"), spans, id)) for df, id in ((left, left_id), (right, right_id)))
    # Dealt by the pairs of arrays, not of ids: else each would be copied to many cells.
    met = overlap_pairs(a, b, bin_size, levels)
    return met.select("r_ids", F.explode("ids").alias(left_id)).select(left_id, F.explode("r_ids").alias(right_id))


def _holding(position: Column, kind: int) -> Column:
    """The blocks that hold ``position``, one of each size; a block's number, its level and ``kind`` in one."""
    return F.transform(F.sequence(F.lit(0), F.lit(TOP)), lambda k: F.floor(position / F.pow(F.lit(4), k)).cast("long") * 32 + k * 2 + kind)


def _filling(start: Column, end: Column, kind: int) -> Column:
    """The fewest blocks that hold ``start..end`` and nothing else: at each level those that no larger block inside has."""

    def of(k: Column) -> Column:
        low = lambda j: F.ceil(start / F.pow(F.lit(4), j)).cast("long")
        high = lambda j: F.floor((end + 1) / F.pow(F.lit(4), j)).cast("long")
        run = lambda a, b: F.when(a < b, F.sequence(a, b - 1)).otherwise(F.array().cast("array<bigint>"))
        a, b, c, d = low(k), high(k), low(k + 1), high(k + 1)
        own = F.when((k == TOP) | (c >= d), run(a, b)).otherwise(F.concat(run(a, c * 4), run(d * 4, b)))
        return F.transform(own, lambda n: n * 32 + k * 2 + kind)

    return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(TOP)), of))


def first_over(questions: DataFrame, features: DataFrame, rank: str, id: str) -> DataFrame:
    """``questions`` (``contig, start, end``) with ``found``: ``rank, id`` of the least feature by these that shares a position; null where none does.

    A feature shares a position if it covers the first one of the question, or begins behind that within it. Intervals are
    cut into blocks of 1, 4, 16, ... positions and only the least feature of a block is kept; a position asks the blocks
    that hold it. So the work is that of the rows times the number of sizes, however many features lie over each other,
    and no pairs are made. Null or inverted intervals share nothing.
    """
    sound = lambda df: df.where("contig is not null and start <= end")
    least = lambda c: F.min(c).alias("_least")
    s, e = F.col("start"), F.col("end")
    # Rows that nothing but the id tells apart are one before they are cut.
    own = sound(features).groupBy("contig", "start", "end", F.col(rank).alias("_rank")).agg(F.min(id).alias("_id"))
    blocks = own.select("contig", F.struct("_rank", "_id").alias("_own"), F.explode(F.concat(_filling(s, e, 0), _holding(s, 1))).alias("_block"))
    best = blocks.groupBy("contig", "_block").agg(least("_own"))
    places = sound(questions).select("contig", "start", "end").distinct()
    asked = places.select("contig", "start", "end", F.explode(F.concat(_holding(s, 0), _filling(s + 1, e, 1))).alias("_block"))
    found = asked.join(best, ["contig", "_block"]).groupBy(*[F.col(c).alias(f"_q_{c}") for c in ("contig", "start", "end")]).agg(least("_least"))
    same = [F.col(c) == F.col(f"_q_{c}") for c in ("contig", "start", "end")]
    named = F.when(F.col("_least").isNotNull(), F.struct(F.col("_least._rank").alias("rank"), F.col("_least._id").alias("id"))).alias("found")
    return questions.join(found, same, "left").select(*questions.columns, named)


def count_overlaps(left: DataFrame, right: DataFrame, id: str, size: int = tiles.ROWS) -> DataFrame:
    """``id, n``: how many ``right`` intervals each ``left`` one overlaps, where any.

    Those that begin up to its end, less those that end before its start. Starts, ends and the questions are one table of
    events by position, so one running sum answers both, without the pairs: a start counts 1 before the questions at its
    place, an end takes 1 off behind them.
    """
    none = F.lit(None).cast(left.schema[id].dataType)
    events = right.select("contig", F.explode(F.array(F.struct(F.col("start").alias("_pos"), F.lit(0).alias("_turn"), F.lit(1).alias("_w")), F.struct(F.col("end").alias("_pos"), F.lit(2).alias("_turn"), F.lit(1).alias("_w")))).alias("e")).select("contig", "e.*")
    # Kept, as the tiles' bounds, their sums and the counts each read it.
    summed = kept(events.groupBy("contig", "_pos", "_turn").agg(F.sum("_w").cast("long").alias("_w")))
    own = F.explode(F.array(F.struct(F.col("end").alias("_pos"), F.lit(1).alias("_sign")), F.struct(F.col("start").alias("_pos"), F.lit(-1).alias("_sign"))))
    asked = left.select("contig", F.col(id).alias("_id"), own.alias("e")).select("contig", "_id", "e.*", F.lit(1).alias("_turn"))
    both = summed.select("contig", "_pos", "_turn", "_w", none.alias("_id"), F.lit(None).cast("int").alias("_sign")).unionByName(asked.withColumn("_w", F.lit(0).cast("long")))
    # Those begun stand in the low half of the sum, those ended in the high half.
    begun, ended = F.when(F.col("_turn") == 0, F.col("_w")).otherwise(0), F.when(F.col("_turn") == 2, F.col("_w")).otherwise(0)
    counted = running_sums(both, 3 * F.col("_pos") + F.col("_turn"), {"_begun": begun, "_ended": ended}, size).where("_turn = 1")
    part = F.when(F.col("_sign") == 1, F.col("_begun")).otherwise(-F.col("_ended"))
    return counted.groupBy(F.col("_id").alias(id)).agg(F.sum(part).cast("long").alias("n")).where("n > 0")


def running_sums(rows: DataFrame, key: Column, weights: dict[str, Column], size: int = tiles.ROWS, known: int | None = None) -> DataFrame:
    """``rows`` with the running sums of ``weights`` per contig in the order of ``key``, a number; rows of equal keys come in any order.

    One window per tile of equal counts, with the sums of the tiles before carried in, so that neither a contig nor a deep
    place is one task.
    """
    tiled = tiles.equal_tiles(rows.withColumns({"_order": key, **{f"_weight_{n}": w for n, w in weights.items()}}), F.col("_order"), size=size, known=known)
    sums = tiled.groupBy("contig", "_tile").agg(*[F.sum(f"_weight_{n}").alias(f"_sum_{n}") for n in weights])
    before = Window.partitionBy("contig").orderBy("_tile").rowsBetween(Window.unboundedPreceding, -1)
    carry = sums.select(F.col("contig").alias("_carry_contig"), F.col("_tile").alias("_carry_tile"), *[F.coalesce(F.sum(f"_sum_{n}").over(before), F.lit(0)).alias(f"_carry_{n}") for n in weights])
    within = Window.partitionBy("contig", "_tile").orderBy("_order").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    joined = tiled.join(carry, (F.col("contig") == F.col("_carry_contig")) & (F.col("_tile") == F.col("_carry_tile")))
    summed = joined.withColumns({n: (F.sum(f"_weight_{n}").over(within) + F.col(f"_carry_{n}")).cast("long") for n in weights})
    return summed.drop("_tile", "_order", "_carry_contig", "_carry_tile", *[f"_weight_{n}" for n in weights], *[f"_carry_{n}" for n in weights])


def running_count(events: DataFrame, key: str, weight: Column, name: str, first: Column | None = None, size: int = tiles.ROWS, known: int | None = None) -> DataFrame:
    """``events`` with the running sum of ``weight`` per contig by ``key``; of equal keys, rows for which ``first`` holds come before the others."""
    order = F.col(key) if first is None else 2 * F.col(key) + F.when(first, 0).otherwise(1)
    return running_sums(events, order, {name: weight}, size, known)


def kth_neighbour(
    loci: DataFrame, features: DataFrame, key: str, k: Column, after: bool, inclusive: bool = False, saturating: bool = False, size: int = tiles.ROWS
) -> DataFrame:
    """``loci`` (``contig, position``) with the k-th feature after or before each, as ``f_*``; null where there is none.

    After: features whose ``key`` is over the position; before: under it, or at it if ``inclusive``. Features
    have ``contig, id, start`` and the key; of equal keys the last by (start, id) counts. Saturating takes the
    last or first feature where fewer than k follow. Features are ranked and counted by one sort of both tables,
    then met by an equality on (contig, rank).
    """
    unique = features.groupBy("contig", F.col(key).alias("_key")).agg(F.max_by(F.struct(*features.columns), F.struct("start", "id")).alias("f"))
    n = unique.groupBy(F.col("contig").alias("_nc")).agg(F.count(F.lit(1)).alias("_n"))
    # At an equal key, whether features count before the locus decides what "over" and "under" mean.
    features_first = after or inclusive
    both = (
        unique.select("contig", "_key", "f", F.lit(None).cast(loci.select(F.struct(*loci.columns)).schema[0].dataType).alias("l"), F.lit(None).cast("long").alias("_k"), F.lit(1).alias("w"))
    ).unionByName(
        loci.select("contig", F.col("position").alias("_key"), F.lit(None).cast(unique.schema["f"].dataType).alias("f"), F.struct(*loci.columns).alias("l"), k.cast("long").alias("_k"), F.lit(0).alias("w"))
    )
    counted = running_count(both, "_key", F.col("w"), "_c", F.col("w") == (1 if features_first else 0), size)
    ranked = counted.where("w = 1").select(F.col("contig").alias("_fc"), F.col("_c").alias("_rank"), "f")
    wanted = counted.where("w = 0").select("l", "_k", "contig", F.when(F.lit(after), F.col("_c") + F.col("_k")).otherwise(F.col("_c") - F.col("_k") + 1).alias("_want"))
    if saturating:
        wanted = wanted.join(n, F.col("contig") == F.col("_nc"), "left").withColumn("_want", F.greatest(F.lit(1), F.least(F.col("_want"), F.col("_n"))))
    found = wanted.join(ranked, (F.col("contig") == F.col("_fc")) & (F.col("_want") == F.col("_rank")) & (F.col("_k") > 0), "left")
    return found.select("l.*", *[F.col(f"f.{c}").alias(f"f_{c}") for c in features.columns])
