"""Tiles of equal counts: runs of a contig with about as many rows each, however deep a place is.

Windows over a whole contig would be one task, and over stretches of fixed length a deep locus is one. Here the bounds are
quantiles of the rows' own keys. Where one key fills several tiles, its rows are dealt among these by hash, so the order
of tiles is an order of keys and nothing finer.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociframe.operators.tables import kept

ROWS = 1 << 20  # of a tile
MOST = 1024  # tiles of a contig, a power of two


def equal_tiles(rows: DataFrame, key: Column, group: Sequence[str] = ("contig",), size: int = ROWS, known: int | None = None) -> DataFrame:
    """``rows`` with ``_tile``; rows with a null in ``group`` go. Tiles hold about ``size`` rows, or a ``MOST``-th of their group where that is more.

    The bounds are kept, as quantiles found again could differ. They are at most ``MOST`` numbers for each group, of which
    there are as many as contigs, and are broadcast. Where the number of rows is ``known`` to be that of one tile, none are sought.
    """
    if known is not None and known <= size:
        return rows.where(F.greatest(*[F.col(g).isNull().cast("int") for g in [*group, group[0]]]) == 0).withColumn("_tile", F.lit(0))
    # The tail of a digest is short enough for any number of rows.
    quantiles = F.percentile_approx("_key", [k / MOST for k in range(1, MOST)], 8 * MOST)
    found = rows.select(*group, key.alias("_key")).groupBy(*group).agg(F.count(F.lit(1)).alias("_n"), quantiles.alias("_q"))
    wanted = F.least(F.ceil(F.col("_n") / size), F.lit(MOST)).cast("int")
    chosen = F.transform(F.sequence(F.lit(1), wanted - 1), lambda k: F.get("_q", F.floor(k * MOST / wanted).cast("int") - 1))
    bounds = kept(found.select(*[F.col(g).alias(f"_g_{g}") for g in group], F.when(wanted > 1, chosen).otherwise(F.array().cast("array<bigint>")).alias("_bounds")))
    joined = rows.withColumn("_key", key).join(F.broadcast(bounds), [F.col(g) == F.col(f"_g_{g}") for g in group])
    steps = F.array(*[F.lit(MOST >> k) for k in range(1, MOST.bit_length())])

    def below(inclusive: bool) -> Column:
        """How many bounds are less than the key, or at most the key: a binary search."""
        less = lambda b: b <= F.col("_key") if inclusive else b < F.col("_key")
        return F.aggregate(steps, F.lit(0), lambda low, s: F.when(less(F.get("_bounds", low + s - 1)), low + s).otherwise(low))

    low = F.when(F.size("_bounds") == 0, 0).otherwise(below(False))
    found_low = joined.withColumn("_low", low)
    # Of equal bounds, the rows on them go to any tile between.
    several = F.get("_bounds", F.col("_low") + 1) == F.col("_key")
    spread = F.col("_low") + F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns]), below(True) - F.col("_low") + 1)
    tile = F.when(several, spread).otherwise(F.col("_low")).cast("int")
    return found_low.withColumn("_tile", tile).drop("_low", "_bounds", "_key", *[f"_g_{g}" for g in group])
