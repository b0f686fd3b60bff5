"""Reads: parsed columns, segments, pileup, mismatches, base modifications."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociframe.functions import reads as fr
from lociframe.functions.columns import once
from lociframe.operators import tiles
from lociframe.operators.joins import running_count
from lociframe.operators.lanes import base_rank
from lociframe.operators.tables import alike, dealt, kept

CHUNK = 1 << 16


def parsed(reads: DataFrame) -> DataFrame:
    """``reads`` with ``ops, end, leading, trailing, s_start, s_end``; unmapped rows (no start) are left out."""
    cigar = F.coalesce("cigar", F.lit(""))
    # The bounds come from the text alone, so that steps without operations don't make them.
    held = reads.where(F.col("start").isNotNull()).withColumns({"ops": once(fr.cigar_ops(cigar, F.col("start"))), "_held": once(fr.clips_and_span(cigar))})
    spans = held.withColumns(
        {"end": F.col("start") + F.greatest(F.col("_held.span") - 1, F.lit(0).cast("long")), "leading": F.col("_held.lead"), "trailing": F.col("_held.clipped") - F.col("_held.lead")}
    ).drop("_held")
    return spans.withColumns({"s_start": fr.stacking_start(F.col("start"), F.col("leading")), "s_end": fr.stacking_end(F.col("end"), F.col("trailing"))})


def rejects(reads: DataFrame) -> DataFrame:
    """Rows without a start, which no other operator takes."""
    return reads.where(F.col("start").isNull())


def bases(parsed_reads: DataFrame) -> DataFrame:
    """One row per aligned or clipped base: ``read_id, contig, pos, base, op, query``; clips placed left of position 2 are left out."""

    def of(o: Column) -> Column:
        first = F.when((o["op"] == "S") & fr.is_leading(o, F.col("start")), o["ref_start"] - o["len"]).otherwise(o["ref_start"])
        each = lambda k: F.struct((first + k).alias("pos"), o["op"].alias("op"), (o["query_start"] + k).alias("query"), ((o["op"] == "S") & fr.is_leading(o, F.col("start"))).alias("lead"))
        return F.transform(F.sequence(F.lit(0), o["len"] - 1), each)

    taken = F.filter("ops", lambda o: o["op"].isin("S", *fr.ALIGNED) & (o["len"] > 0))
    rows = parsed_reads.select("*", F.inline(F.flatten(F.transform(taken, of))))
    return rows.where(~F.col("lead") | (F.col("pos") >= 2)).withColumn("base", F.substring("seq", F.col("query") + 1, F.lit(1))).drop("lead", "ops")


def _letters(parsed_reads: DataFrame, carried: list[str]) -> DataFrame:
    """``carried, pos, base, clip`` of the rows of ``bases``, with the letters of a block cut at once."""
    lead = lambda o: (o["op"] == "S") & fr.is_leading(o, F.col("start"))
    block = lambda o: F.struct(
        F.when(lead(o), o["ref_start"] - o["len"]).otherwise(o["ref_start"]).alias("first"), o["len"].alias("n"), o["query_start"].alias("query"), (o["op"] == "S").alias("clip"), lead(o).alias("lead")
    )
    taken = F.transform(F.filter("ops", lambda o: o["op"].isin("S", *fr.ALIGNED) & (o["len"] > 0)), block)
    blocks = parsed_reads.select(*carried, "seq", F.inline(taken))
    # A text shorter than its CIGAR gives empty bases, and a missing one null ones.
    part = F.rpad(F.substring("seq", F.col("query") + 1, F.col("n")), F.col("n"), "\0")
    none = F.array_repeat(F.lit(None).cast("string"), F.col("n"))
    each = blocks.select(*carried, "first", "clip", "lead", F.posexplode(F.coalesce(F.split(part, ""), none)).alias("k", "letter"))
    placed = each.select(*carried, (F.col("first") + F.col("k")).alias("pos"), F.when(F.col("letter") == "\0", "").otherwise(F.col("letter")).alias("base"), "clip", "lead")
    return placed.where(~F.col("lead") | (F.col("pos") >= 2)).drop("lead")


def reference_chunks(sequences: DataFrame, size: int = CHUNK, overlap: int = 1 << 12) -> DataFrame:
    """``contig, bases`` as ``contig, chunk_no, chunk_start, bases`` of fixed size, each reaching ``overlap`` bases into the next."""
    n = F.floor((F.length("bases") - 1) / size)
    numbered = sequences.select("contig", F.col("bases").alias("_all"), F.explode(F.sequence(F.lit(0).cast("long"), n)).alias("chunk_no"))
    start = F.col("chunk_no") * size + 1
    return numbered.select("contig", "chunk_no", start.alias("chunk_start"), F.substring("_all", start.cast("int"), F.lit(size + overlap)).alias("bases"))


def pileup(parsed_reads: DataFrame, sequences: DataFrame | None = None, group: list[str] | None = None) -> DataFrame:
    """Counts per contig and position: ``a, t, c, g, n, total, softclip`` and the reference base (N if unknown).

    Reads that agree in place, CIGAR and bases are one with a weight before they are parsed and cut into bases, so on a genome of fixed size
    the bases grow with the unlike reads, not with the depth.
    """
    by = [*(group or []), "contig", "pos"]
    unlike = parsed_reads.groupBy(*(group or []), "contig", "start", "cigar", "seq").agg(F.count(F.lit(1)).alias("_w"))
    rows = _letters(parsed(unlike), [*(group or []), "contig", "_w"])
    base = F.when(F.col("clip"), F.lit(None)).when(F.col("base").isin("A", "T", "C", "G"), F.col("base")).otherwise("N")
    sum_if = lambda c: F.sum(F.when(c, F.col("_w")).otherwise(0))
    counts = rows.withColumn("b", base).groupBy(*by).agg(
        *[sum_if(F.col("b") == x).alias(x.lower()) for x in "ATCGN"], sum_if(F.col("b").isNotNull()).alias("total"), sum_if(F.col("clip")).alias("softclip")
    )
    if sequences is None:
        return counts
    return attach_base(counts, sequences)


def attach_base(sites: DataFrame, sequences: DataFrame, size: int = 256) -> DataFrame:
    """``sites`` (``contig, pos``) with ``ref_base``, through the chunk of each position; chunks are small, as each site reads one."""
    c = reference_chunks(sequences, size, 0).select(F.col("contig").alias("_c"), F.col("chunk_no").alias("_n"), "chunk_start", F.col("bases").alias("chunk_bases"))
    on = (F.col("contig") == F.col("_c")) & (F.floor((F.col("pos") - 1) / size) == F.col("_n"))
    base = F.nullif(F.substring("chunk_bases", (F.col("pos") - F.col("chunk_start") + 1).cast("int"), F.lit(1)), F.lit(""))
    return sites.join(c, on, "left").withColumn("ref_base", F.coalesce(base, F.lit("N"))).drop("_c", "_n", "chunk_start", "chunk_bases")


def merge_pileups(pileups: DataFrame) -> DataFrame:
    """Sums of all counts per contig and position, N included."""
    counts = ["a", "t", "c", "g", "n", "total", "softclip"]
    return pileups.groupBy("contig", "pos").agg(*[F.sum(x).alias(x) for x in counts], F.min("ref_base").alias("ref_base"))


def max_alt_depth() -> Column:
    """The largest count of a base that isn't the reference's; of all four where that is unknown."""
    return F.greatest(*[F.when(F.upper("ref_base") == x, F.lit(0)).otherwise(F.col(x.lower())) for x in "ATCG"])


def alt_split() -> tuple[Column, Column]:
    """``(alt, other)``: the alternative depth counts where it is over 1 % of the total."""
    alt = F.when(max_alt_depth() * 100 > F.col("total"), max_alt_depth()).otherwise(F.lit(0).cast("long"))
    return alt, F.col("total") - alt


def depth_sweep(parsed_reads: DataFrame, size: int = tiles.ROWS) -> DataFrame:
    """``contig, pos, depth``: the depth from each position on at which aligned blocks begin or end."""
    block = F.filter("ops", lambda o: o["op"].isin(*fr.ALIGNED))
    events = parsed_reads.select("contig", F.inline(F.flatten(F.transform(block, lambda o: F.array(F.struct(o["ref_start"].alias("pos"), F.lit(1).alias("d")), F.struct((o["ref_start"] + o["len"]).alias("pos"), F.lit(-1).alias("d")))))))
    # Kept, as the tiles' bounds, their sums and the sweep each read it.
    changes = kept(events.groupBy("contig", "pos").agg(F.sum("d").alias("d")))
    return running_count(changes, "pos", F.col("d"), "depth", size=size).select("contig", "pos", "depth")


def _segments_of() -> Column:
    """The segments of a parsed read, as an array in their order."""
    ops = F.col("ops")

    def carried(j: Column) -> Column:
        # The nearest insertion before, with nothing but insertions, padding and hard clips between.
        before = F.slice(ops, F.lit(1), j)
        last = F.aggregate(before, F.lit(None).cast("int"), lambda a, o: F.when(o["op"] == "I", o["len"]).when(o["op"].isin("P", "H"), a))
        return F.when(j > 0, last)

    def of(o: Column, j: Column) -> Column:
        def row(start: Column, end: Column, kind: str, base: Column, insertion: Column) -> Column:
            return F.struct(start.alias("start"), end.alias("end"), F.lit(kind).alias("kind"), base.alias("base"), insertion.alias("insertion_len"))

        none = F.lit(None).cast("string")
        lead = fr.is_leading(o, F.col("start"))
        first = F.when(lead, o["ref_start"] - o["len"]).otherwise(o["ref_start"])
        clip = F.filter(
            F.transform(F.sequence(F.lit(0), o["len"] - 1), lambda k: row(first + k, first + k, "SoftClip", F.substring("seq", o["query_start"] + k + 1, F.lit(1)), F.when(k == 0, carried(j)))),
            lambda s: ~lead | (s["start"] >= 2),
        )
        block = lambda kind: F.array(row(o["ref_start"], o["ref_start"] + o["len"] - 1, kind, none, carried(j)))
        return F.when(o["op"] == "S", clip).when(o["op"].isin(*fr.ALIGNED), block("Match")).when(o["op"].isin("D", "N"), block("Deletion")).otherwise(F.array().cast("array<struct<start:bigint,end:bigint,kind:string,base:string,insertion_len:int>>"))

    return F.flatten(F.transform(ops, of))


def over_places(reads: DataFrame, places: DataFrame, carried: Sequence[str] = (), size: int = 512, most: int = 1 << 10) -> DataFrame:
    """``contig, p, read_id, start, s_start, s_end, rank`` and ``carried`` of the reads over each place (``contig, p``, each once), clips included; ``rank`` as by ``base_rank``.

    One exchange, of the reads by bins of ``size`` positions; all rows of a place stay in one partition, for what follows there. Reads that agree in
    all but their ids meet places as one, ``most`` of them at a time.
    """
    bins = F.sequence(F.floor(F.col("s_start") / size), F.floor(F.col("s_end") / size))
    like = ["contig", "_bin", "start", "cigar", "seq", *carried]
    binned = dealt(parsed(reads).select(*[c for c in like if c != "_bin"], "read_id", F.explode(bins).alias("_bin")), "contig", "_bin")
    same = alike(binned, like, "read_id", most)
    at = places.select(F.col("contig").alias("_c"), "p", F.floor(F.col("p") / size).alias("_b"))
    met = parsed(same).join(at, (F.col("contig") == F.col("_c")) & (F.col("_bin") == F.col("_b")) & F.col("p").between(F.col("s_start"), F.col("s_end")))
    ops, p = F.col("ops"), F.col("p")
    known = met.withColumn("_base", once(fr.base_at(ops, F.col("seq"), p)))
    ranked = known.withColumn("rank", once(base_rank(F.col("_base"), fr.is_deletion_at(ops, p), fr.has_insertion_at(ops, p))))
    return ranked.select("contig", "p", F.explode("ids").alias("read_id"), "start", "s_start", "s_end", "rank", *carried)


def segments(parsed_reads: DataFrame) -> DataFrame:
    """``read_id, seg_no, start, end, kind, base, insertion_len, arrow``: clipped bases one by one, aligned and deleted blocks.

    An insertion's length goes to the first segment of the next operation that has one; the arrow to the first
    segment of a reverse read and to the last of a forward one.
    """
    has_bases = F.length(F.coalesce("seq", F.lit(""))) > 0
    made = parsed_reads.where(has_bases).select("read_id", "flag", once(_segments_of()).alias("s"))
    arrow = F.when((F.col("flag").bitwiseAND(16) != 0) & (F.col("p") == 0), "Reverse").when((F.col("flag").bitwiseAND(16) == 0) & (F.col("p") == F.size("s") - 1), "Forward")
    return made.select("read_id", "flag", "s", F.posexplode("s").alias("p", "x")).select("read_id", (F.col("p") + 1).alias("seg_no"), "x.*", arrow.alias("arrow"))


def mismatches(parsed_reads: DataFrame, sequences: DataFrame, size: int = CHUNK) -> DataFrame:
    """``read_id, pos, base``: every base of an X block; of an M block those that differ from a known reference base."""
    chunk = lambda pos: F.floor((pos - 1) / size)

    def cut(o: Column) -> Column:
        """The pieces of a block between chunk bounds."""
        last = o["ref_start"] + o["len"] - 1

        def piece(k: Column) -> Column:
            first = F.greatest(o["ref_start"], k * size + 1)
            return F.struct(k.alias("_n"), first.alias("first"), (F.least(last, (k + 1) * size) - first + 1).alias("len"), (o["query_start"] + first - o["ref_start"]).alias("query"))

        return F.transform(F.sequence(chunk(o["ref_start"]), chunk(last)), piece)

    blocks = F.filter("ops", lambda o: (o["op"] == "M") & (o["len"] > 0))
    pieces = parsed_reads.select("read_id", F.col("contig").alias("_c"), "seq", F.inline(F.flatten(F.transform(blocks, cut))))
    pieces = pieces.select("read_id", "_c", "_n", "first", "len", F.substring("seq", (F.col("query") + 1).cast("int"), F.col("len").cast("int")).alias("part"))
    c = reference_chunks(sequences, size, 0)
    joined = pieces.join(c, (F.col("_c") == F.col("contig")) & (F.col("_n") == F.col("chunk_no")))
    # Only the piece's span goes on, not the chunk.
    span = once(F.substring("bases", (F.col("first") - F.col("chunk_start") + 1).cast("int"), F.col("len").cast("int")))
    spans = joined.select("read_id", "first", "len", "part", span.alias("span"))
    # Arrays of letters, as a substring of a long text takes time by its place.
    letters = spans.select("read_id", "first", "len", once(F.split("part", "")).alias("part"), once(F.split("span", "")).alias("span"))
    base = lambda k: F.when(F.col("part").isNotNull(), F.coalesce(F.get("part", k), F.lit("")))
    each = F.transform(F.sequence(F.lit(0), F.col("len").cast("int") - 1), lambda k: F.struct((F.col("first") + k).alias("pos"), base(k).alias("base"), F.nullif(F.get("span", k), F.lit("")).alias("ref")))
    differs = letters.select("read_id", F.inline(each)).where(~fr.matches_base(F.col("base"), F.col("ref"))).select("read_id", "pos", "base")
    changed = parsed_reads.withColumn("ops", F.filter("ops", lambda o: o["op"] == "X"))
    return bases(changed).select("read_id", "pos", "base").unionByName(differs)


def base_modifications(parsed_reads: DataFrame, carried: Sequence[str] = ()) -> DataFrame:
    """``read_id, pos, call_order, code, probability`` and ``carried`` from MM text and ML numbers (``mm``, ``ml``).

    Skips count occurrences of the canonical base, from the read's end on the complement for reverse reads; each
    position and code takes one probability, 255 where there is none left; calls without a reference position
    take theirs and give no row. All of it happens within a read's row.
    """
    reverse = F.col("flag").bitwiseAND(16) != 0
    codes_text = lambda x: F.regexp_extract(x, "^[A-Za-z][+-]([a-z]+|[0-9]+)", 1)
    codes_of = lambda t: F.when(t.rlike("^[0-9]"), F.array(t)).otherwise(F.filter(F.split(t, ""), lambda c: c != ""))
    groups = once(F.filter(F.split("mm", ";"), lambda x: x != ""))
    # The number of probabilities that a group takes, and those that earlier groups of the read have taken.
    taken = once(F.transform(F.col("groups"), lambda x: (F.size(F.split(x, ",")) - 1) * F.size(codes_of(codes_text(x)))))
    strand = F.when(F.col("reverse"), F.translate(F.reverse("seq"), "ACGTacgt", "TGCAtgca")).otherwise(F.col("seq"))
    kept_columns = ["read_id", *carried, "ops", "start", "seq", "ml", "reverse"]
    read = parsed_reads.select(*kept_columns[:-1], reverse.alias("reverse"), groups.alias("groups")).select(*kept_columns, once(F.upper(strand)).alias("strand_seq"), "groups", taken.alias("taken"))
    before = F.aggregate(F.slice("taken", F.lit(1), F.col("g")), F.lit(0), lambda a, n: a + n)
    source = read.select(*kept_columns, "strand_seq", "taken", F.posexplode("groups").alias("g", "text")).select(*kept_columns, "strand_seq", "text", before.alias("before"))
    parts = F.split("text", ",")
    named = source.select(
        *kept_columns,
        "strand_seq",
        "before",
        F.substring("text", 1, 1).alias("canonical"),
        once(codes_of(codes_text(F.col("text")))).alias("codes"),
        once(F.transform(F.slice(parts, F.lit(2), F.size(parts)), lambda x: x.cast("int"))).alias("skips"),
    )
    nth = F.transform("skips", lambda s, i: F.aggregate(F.slice(F.col("skips"), F.lit(1), i + 1), F.lit(0), lambda a, x: a + x + 1) - 1)
    counted = named.select("*", F.posexplode(nth).alias("k", "n"))
    # What stands before the n-th occurrence is as long as its place; the whole text if there is none. N stands for every base.
    head = F.when(F.col("canonical") == "N", F.col("n")).otherwise(F.length(F.call_function("substring_index", F.col("strand_seq"), F.col("canonical"), F.col("n") + 1)))
    q = once(F.when((F.col("n") >= 0) & (head < F.length("strand_seq")), head))
    calls = counted.withColumn("q", q).where("q is not null").select("*", F.posexplode("codes").alias("j", "code"))
    order = (F.col("before") + F.col("k") * F.size("codes") + F.col("j")).cast("int")
    query = F.when(F.col("reverse"), F.length("seq") - 1 - F.col("q")).otherwise(F.col("q"))
    out = calls.select("read_id", *carried, once(fr.reference_position(F.col("ops"), F.col("start"), query)).alias("pos"), order.alias("call_order"), "code", F.coalesce(F.get("ml", order), F.lit(255)).alias("probability"))
    return out.where(F.col("pos").isNotNull())


def modifications_in_segments(parsed_reads: DataFrame) -> DataFrame:
    """Each call of ``base_modifications`` with the ``seg_no`` of the first segment of its read that contains it.

    As ``attach_modifications`` of both, but within a read's row: no segment travels. Read ids are taken to be unique.
    """
    bounds = F.transform(_segments_of(), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    calls = base_modifications(parsed_reads.withColumn("_segs", once(bounds)), ["_segs"])
    holds = F.transform("_segs", lambda s: F.col("pos").between(s["start"], s["end"]))
    numbered = calls.withColumn("seg_no", once(F.array_position(holds, True).cast("int"))).where("seg_no > 0")
    return numbered.select("read_id", "pos", "call_order", "code", "probability", "seg_no")


def best_modifications(calls: DataFrame) -> DataFrame:
    """The call of the highest probability per read and position; the first of equals."""
    w = Window.partitionBy("read_id", "pos").orderBy(F.desc("probability"), "call_order")
    return calls.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def attach_modifications(segs: DataFrame, calls: DataFrame) -> DataFrame:
    """Each call with the first segment of its read that contains it."""
    c = calls.withColumnRenamed("read_id", "_r")
    joined = segs.join(c, (F.col("read_id") == F.col("_r")) & F.col("pos").between(F.col("start"), F.col("end")))
    return joined.groupBy("read_id", "pos", "call_order", "code", "probability").agg(F.min("seg_no").alias("seg_no"))
