"""Read filters as boolean Columns; combine them with ``&``, ``|`` and ``~``. Reads are parsed ones (``operators.reads.parsed``)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lociframe.functions import reads as fr

def base(position: Column, letter: str) -> Column:
    """Reads with that base at a position, in either case."""
    found = fr.base_at(F.col("ops"), F.col("seq"), position)
    return F.coalesce(F.upper(found) == letter.upper(), F.lit(False))


def softclip(position: Column) -> Column:
    """Reads clipped at a position."""
    return fr.is_softclip_at(F.col("start"), F.col("end"), F.col("leading"), F.col("trailing"), position)


def everything() -> Column:
    return F.lit(True)


def nothing() -> Column:
    return F.lit(False)


def starts_in(low: Column, high: Column) -> Column:
    return F.col("start").between(low, high)


def ends_in(low: Column, high: Column) -> Column:
    return F.col("end").between(low, high)


def overlaps(low: Column, high: Column) -> Column:
    return (F.col("start") <= high) & (F.col("end") >= low)


def reverse() -> Column:
    return F.col("flag").bitwiseAND(16) != 0


def mapq_at_least(n: int) -> Column:
    return F.col("mapq") >= n


def mapq_at_most(n: int) -> Column:
    return F.col("mapq") <= n


def flags_all(mask: int) -> Column:
    return F.col("flag").bitwiseAND(mask) == mask


def flags_any(mask: int) -> Column:
    return F.col("flag").bitwiseAND(mask) != 0


def flags_equal(value: int) -> Column:
    return F.col("flag") == value


def tag(name: str, value: str) -> Column:
    """Reads whose tag has that value; those without the tag fail."""
    return F.coalesce(F.try_element_at("tags", F.lit(name)) == value, F.lit(False))
