"""Per-read expressions over parsed CIGAR operations.

``cigar_ops`` gives ``array<struct<op, len, ref_start, query_start>>``; the other functions work on that array,
so no read needs a shuffle. M D N = X consume the reference, M I S = X the query.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

REFERENCE = ("M", "D", "N", "=", "X")
QUERY = ("M", "I", "S", "=", "X")
ALIGNED = ("M", "=", "X")
OPS_TYPE = "array<struct<op:string,len:int,ref_start:bigint,query_start:int>>"


def cigar_ops(cigar: Column, start: Column) -> Column:
    tokens = F.regexp_extract_all(cigar, F.lit("[0-9]+[MIDNSHP=X]"), F.lit(0))

    def step(a: Column, token: Column) -> Column:
        op, n = F.right(token, F.lit(1)), F.substring(token, F.lit(1), F.length(token) - 1).cast("int")
        made = F.struct(op.alias("op"), n.alias("len"), a.getField("r").alias("ref_start"), a.getField("q").alias("query_start"))
        return F.struct(
            (a.getField("r") + F.when(op.isin(*REFERENCE), n).otherwise(0)).alias("r"),
            (a.getField("q") + F.when(op.isin(*QUERY), n).otherwise(0)).alias("q"),
            F.concat(a.getField("ops"), F.array(made)).alias("ops"),
        )

    begin = F.struct(start.cast("long").alias("r"), F.lit(0).alias("q"), F.array().cast(OPS_TYPE).alias("ops"))
    return F.aggregate(tokens, begin, step, lambda a: a.getField("ops"))


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda a, x: a + x)


def reference_end(ops: Column, start: Column) -> Column:
    span = _sum(F.transform(F.filter(ops, lambda o: o["op"].isin(*REFERENCE)), lambda o: o["len"].cast("long")))
    return start + F.greatest(span - 1, F.lit(0).cast("long"))


def clips_and_span(cigar: Column) -> Column:
    """``lead, span, clipped`` of a CIGAR text: the clip with nothing of reference or query before it, the length on the reference, all clips.

    For the bounds of a read, which most steps need without its operations: two passes over the text instead of an array of structs.
    """
    total = lambda kinds: F.aggregate(F.regexp_extract_all(cigar, F.lit(f"([0-9]+)[{kinds}]"), F.lit(1)), F.lit(0).cast("long"), lambda a, x: a + x.cast("int"))
    # Before the clip may stand what takes nothing, and what is no operation.
    lead = F.regexp_extract(cigar, "^(?:[0-9]+[HP]|0+[MIDNS=X]|[0-9]*[^0-9MIDNSHP=X]|[MIDNSHP=X])*+([0-9]+)S", 1)
    none = F.lit(0).cast("long")
    clipped = cigar.contains(F.lit("S"))
    return F.struct(
        F.when(clipped & (lead != ""), lead.cast("int").cast("long")).otherwise(none).alias("lead"),
        total("MDN=X").alias("span"),
        F.when(clipped, total("S")).otherwise(none).alias("clipped"),
    )


def is_leading(op: Column, start: Column) -> Column:
    """A clip with nothing of the reference or query before it."""
    return (op["query_start"] == 0) & (op["ref_start"] == start)


def leading_clip(ops: Column, start: Column) -> Column:
    return _sum(F.transform(F.filter(ops, lambda o: (o["op"] == "S") & is_leading(o, start)), lambda o: o["len"].cast("long")))


def trailing_clip(ops: Column, start: Column) -> Column:
    return _sum(F.transform(F.filter(ops, lambda o: (o["op"] == "S") & ~is_leading(o, start)), lambda o: o["len"].cast("long")))


def stacking_start(start: Column, leading: Column) -> Column:
    return F.greatest(start - leading, F.lit(1).cast("long"))


def stacking_end(end: Column, trailing: Column) -> Column:
    return end + trailing


def is_pairable(flag: Column) -> Column:
    """Segmented, neither supplementary nor secondary."""
    return (flag.bitwiseAND(1) != 0) & (flag.bitwiseAND(2304) == 0)


def base_at(ops: Column, seq: Column, position: Column) -> Column:
    """The aligned base; null outside, in deletions and skips."""
    o = F.get(F.filter(ops, lambda o: o["op"].isin(*ALIGNED) & position.between(o["ref_start"], o["ref_start"] + o["len"] - 1)), F.lit(0))
    return F.nullif(F.substring(seq, (o["query_start"] + position - o["ref_start"] + 1).cast("int"), F.lit(1)), F.lit(""))


def is_softclip_at(start: Column, end: Column, leading: Column, trailing: Column, position: Column) -> Column:
    return position.between(start - leading, start - 1) | position.between(end + 1, end + trailing)


def is_deletion_at(ops: Column, position: Column) -> Column:
    return F.exists(ops, lambda o: o["op"].isin("D", "N") & position.between(o["ref_start"], o["ref_start"] + o["len"] - 1))


def has_insertion_at(ops: Column, position: Column) -> Column:
    return F.exists(ops, lambda o: (o["op"] == "I") & (o["ref_start"] == position))


def reference_position(ops: Column, start: Column, query: Column) -> Column:
    """Reference position of a 0-based query position; clips extend outside; null in insertions and below 1."""
    o = F.get(F.filter(ops, lambda o: o["op"].isin(*QUERY) & query.between(o["query_start"], o["query_start"] + o["len"] - 1)), F.lit(0))
    inside = o["ref_start"] + query - o["query_start"]
    found = F.when(o["op"] == "I", F.lit(None)).when((o["op"] == "S") & is_leading(o, start), inside - o["len"]).otherwise(inside)
    return F.when(found >= 1, found)


def matches_base(a: Column, b: Column) -> Column:
    """Equal, ignoring case for A, C, G and T only."""
    return (a == b) | ((F.upper(a) == F.upper(b)) & F.upper(a).isin("A", "C", "G", "T"))


def describe_read(qname: Column, flag: Column, mapq: Column, cigar: Column) -> Column:
    text = lambda c, none: F.coalesce(c.cast("string"), F.lit(none))
    return F.concat(text(qname, "<missing>"), F.lit("  Flags="), text(flag, "0"), F.lit("  MAPQ="), text(mapq, "<missing>"), F.lit("  Cigar="), F.coalesce(F.nullif(cigar, F.lit("")), F.lit(".")))


def modification_class(code: Column, probability: Column) -> Column:
    """5mC by probability (179 and 77 are the bounds), 5hmC, 6mA, other."""
    return (
        F.when((code == "m") & (probability >= 179), "5mC high")
        .when((code == "m") & (probability >= 77), "5mC medium")
        .when(code == "m", "5mC low")
        .when(code == "h", "5hmC")
        .when(code == "a", "6mA")
        .otherwise("other")
    )


def strand_of(text: Column) -> Column:
    """``+`` or ``-``; null for anything else."""
    return F.when(text.isin("+", "-"), text)


def reverse_strand(strand: Column) -> Column:
    return F.when(strand == "+", "-").when(strand == "-", "+")
