"""Interval arithmetic on 1-based coordinates, both ends inside."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def length(start: Column, end: Column) -> Column:
    return end - start + 1


def covers(start: Column, end: Column, position: Column) -> Column:
    return position.between(start, end)


def middle(start: Column, end: Column) -> Column:
    return F.floor((start + end) / 2).cast("long")


def overlaps(start: Column, end: Column, other_start: Column, other_end: Column) -> Column:
    """On one contig; a shared position is enough."""
    return (start <= other_end) & (end >= other_start)


def contains(start: Column, end: Column, inner_start: Column, inner_end: Column) -> Column:
    return (start <= inner_start) & (end >= inner_end)


def is_properly_bounded(start: Column, end: Column, contig_length: Column) -> Column:
    return (start <= end) & (contig_length.isNull() | (end <= contig_length))


def region_around(position: Column, half_width: Column) -> tuple[Column, Column]:
    """``(start, end)``; the start stays at 1 or above."""
    return F.greatest(F.lit(1).cast("long"), position - half_width), position + half_width


def shift(position: Column, by: Column) -> Column:
    return F.greatest(F.lit(1).cast("long"), position + by)


def tile_of(position: Column, left: Column, width: Column, zoom: Column) -> Column:
    """Tile number within a window of ``width`` tiles from ``left``; outside it, the distance in tiles (at least 1) before or behind."""
    return (
        F.when(position < left, -F.greatest(F.lit(1).cast("long"), F.floor((left - position) / zoom)))
        .when(position >= left + width * zoom, width - 1 + F.greatest(F.lit(1).cast("long"), F.floor((position - left - width * zoom) / zoom)))
        .otherwise(F.floor((position - left) / zoom))
        .cast("long")
    )


def tile_range(tile: Column, left: Column, zoom: Column) -> tuple[Column, Column]:
    return left + tile * zoom, left + (tile + 1) * zoom - 1


def clip_to_tiles(start: Column, end: Column, left: Column, right: Column, zoom: Column) -> tuple[Column, Column]:
    """``(first tile, number of tiles)`` of the part inside ``[left, right]``; null where there is none."""
    inside = overlaps(start, end, left, right)
    first = F.floor((F.greatest(start, left) - left) / zoom)
    last = F.floor((F.least(end, right) - left) / zoom)
    return F.when(inside, first).cast("long"), F.when(inside, last - first + 1).cast("long")
