"""Gene model: parsing, features, lookups and navigation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociframe.functions.columns import once
from lociframe.operators import tiles
from lociframe.operators.joins import first_over, kth_neighbour, overlap_pairs

# Gene tables in order of preference.
PREFERRED_TABLES = ("ncbiRefSeqSelect", "ncbiRefSeqCurated", "ncbiRefSeq", "ncbiGene", "refGene")

HUMAN = ("hg19", "hg38")  # assemblies whose table is known without a look


def coordinate_list(text: Column) -> Column:
    """``'1,2,'`` as an array of numbers; entries that aren't numbers are left out."""
    return F.array_compact(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: x.try_cast("long")))


def parse_genes(rows: DataFrame) -> DataFrame:
    """0-based rows (``id, name, name2, contig, strand, tx0, tx_end, cds0, cds_end, exon_starts_text, exon_ends_text``) as 1-based genes."""
    return rows.select(
        "id",
        F.coalesce(F.nullif(F.col("name2"), F.lit("")), F.col("name")).alias("name"),
        "contig",
        "strand",
        (F.col("tx0") + 1).alias("tx_start"),
        "tx_end",
        (F.col("cds0") + 1).alias("cds_start"),
        "cds_end",
        F.transform(coordinate_list(F.col("exon_starts_text")), lambda x: x + 1).alias("exon_starts"),
        coordinate_list(F.col("exon_ends_text")).alias("exon_ends"),
    ).withColumn("has_exons", F.size("exon_starts") > 0)


def blocks_to_exons(start0: Column, block_starts: Column, block_sizes: Column) -> tuple[Column, Column]:
    """BED12 blocks as 1-based exon starts and ends; an error where the lists differ in length."""
    begin = F.transform(block_starts, lambda s: start0 + s + 1)
    ends = F.zip_with(block_starts, block_sizes, lambda s, n: start0 + s + n)
    bad = F.raise_error(F.lit("block starts and sizes differ in number"))
    return F.when(F.size(block_starts) != F.size(block_sizes), bad).otherwise(begin), ends


def exons(genes: DataFrame) -> DataFrame:
    """One row per exon: ``id, name, contig, strand, exon_no`` (1, 2, ... by coordinate), ``start, end``."""
    return genes.select("*", F.posexplode(F.arrays_zip("exon_starts", "exon_ends")).alias("p", "x")).select(
        "id", "name", "contig", "strand", "cds_start", "cds_end", (F.col("p") + 1).alias("exon_no"), F.col("x.exon_starts").alias("start"), F.col("x.exon_ends").alias("end")
    )


def exon_spans(genes: DataFrame) -> DataFrame:
    """``id, contig, start, end`` of all exons; an ``id`` is a struct of the gene's ``id`` and ``exon_no``."""
    return exons(genes).select(F.struct("id", "exon_no").alias("id"), "contig", "start", "end")


def features(genes: DataFrame) -> DataFrame:
    """Exon, Intron and NonCDSExon rows: ``id, name, start, end, type, number``.

    Exons are split at the coding bounds; introns lie strictly between exons. Forward numbers count coding exons
    up; reverse numbers count down from the number of all exons, coding or not; introns count up, or down on the
    reverse strand; parts outside the coding range have number 0. A gene without a coding range has no Exon rows.
    """
    s, e = F.col("exon_starts"), F.col("exon_ends")
    cs, ce = F.col("cds_start"), F.col("cds_end")
    n = F.size(s)
    forward = F.col("strand") != "-"

    def row(start: Column, end: Column, kind: str) -> Column:
        return F.struct(start.cast("long").alias("start"), end.cast("long").alias("end"), F.lit(kind).alias("type"))

    def parts(x: Column, i: Column) -> Column:
        y, after = F.get(e, i), F.get(s, i + 1)
        return F.array_compact(
            F.array(
                F.when(cs > ce, row(x, y, "NonCDSExon")),
                F.when((cs <= ce) & (x < cs), row(x, F.least(y, cs - 1), "NonCDSExon")),
                F.when(F.greatest(x, cs) <= F.least(y, ce), row(F.greatest(x, cs), F.least(y, ce), "Exon")),
                F.when((cs <= ce) & (y > ce), row(F.greatest(x, ce + 1), y, "NonCDSExon")),
                F.when(y + 1 < after, row(y + 1, after - 1, "Intron")),
            )
        )

    rows = genes.select("id", "name", forward.alias("forward"), n.alias("n"), once(F.flatten(F.transform(s, parts))).alias("f"))
    flat = rows.select("*", F.posexplode("f").alias("p", "x"))
    of_kind = lambda f, kind: F.size(F.filter(f, lambda x: x["type"] == kind))
    so_far = F.slice(F.col("f"), F.lit(1), F.col("p") + 1)
    number = (
        F.when(F.col("x.type") == "NonCDSExon", 0)
        .when((F.col("x.type") == "Exon") & F.col("forward"), of_kind(so_far, "Exon"))
        .when(F.col("x.type") == "Exon", F.col("n") - of_kind(so_far, "Exon") + 1)
        .when(F.col("forward"), of_kind(so_far, "Intron"))
        .otherwise(of_kind(F.col("f"), "Intron") - of_kind(so_far, "Intron") + 1)
    )
    return flat.select("id", "name", "x.start", "x.end", "x.type", number.cast("int").alias("number"))


def label(name: Column, kind: Column, number: Column) -> Column:
    return F.when(kind == "Exon", F.concat(name, F.lit(":exon"), number.cast("string"))).when(kind == "Intron", F.concat(name, F.lit(":intron"), number.cast("string"))).otherwise(name)


def genes_by_name(names: DataFrame, genes: DataFrame) -> DataFrame:
    """``names`` (``name``) with ``gene_id, contig, position`` of the first gene so named and ``found``; the position is one after the start."""
    first = genes.groupBy(F.col("name").alias("_n")).agg(F.min_by(F.struct("id", "contig", "tx_start"), F.struct("tx_start", "id")).alias("g"))
    return names.join(first, F.col("name") == F.col("_n"), "left").select(names["*"], F.col("g.id").alias("gene_id"), F.col("g.contig").alias("contig"), (F.col("g.tx_start") + 1).alias("position"), F.col("g").isNotNull().alias("found"))


def _spans(genes: DataFrame) -> DataFrame:
    return genes.select("id", "name", "contig", F.col("tx_start").alias("start"), F.col("tx_end").alias("end"))


def genes_overlapping(regions: DataFrame, genes: DataFrame, bin_size: int = 1 << 14) -> DataFrame:
    """Pairs of regions and genes that share a position; gene columns come as ``r_*``."""
    return overlap_pairs(regions, _spans(genes), bin_size)


def genes_inside(regions: DataFrame, genes: DataFrame, bin_size: int = 1 << 14) -> DataFrame:
    """Pairs of regions and the genes whose both ends lie in them; gene columns come as ``r_*``. Genes meet by their start alone."""
    spans = _spans(genes)
    starts = spans.withColumns({"end": F.col("start"), "_stop": F.col("end")})
    inside = overlap_pairs(regions, starts, bin_size).where(F.col("r__stop").between(F.col("start"), F.col("end")))
    return inside.withColumn("r_end", F.col("r__stop")).drop("r__stop")


def gene_covering(loci: DataFrame, genes: DataFrame) -> DataFrame:
    """``locus_id, gene_id`` of at most one gene over each locus, the first by (start, id)."""
    points = loci.select("locus_id", "contig", F.col("position").alias("start"), F.col("position").alias("end"))
    spans = _spans(genes).withColumn("_first", F.col("start"))
    return first_over(points, spans, "_first", "id").select("locus_id", F.col("found.id").alias("gene_id"))


def feature_at(loci: DataFrame, spans: DataFrame, size: int = tiles.ROWS) -> DataFrame:
    """``locus_id, id``: the last feature that starts at or before the locus, if it is also the first that ends at or after it."""
    k = F.lit(1)
    by_start = kth_neighbour(loci, spans, "start", k, after=False, inclusive=True, size=size).select("locus_id", F.col("f_id").alias("a"))
    before_ends = loci.withColumn("position", F.col("position") - 1)
    by_end = kth_neighbour(before_ends, spans, "end", k, after=True, size=size).select("locus_id", F.col("f_id").alias("b"))
    return by_start.join(by_end, "locus_id").select("locus_id", F.when(F.col("a") == F.col("b"), F.col("a")).alias("id"))


def preferred_table(available: DataFrame) -> DataFrame:
    """``genome, table_name`` of the first preferred table of each genome (``genome, table_name``).

    With a column ``assembly``, genomes of the human assemblies have the most preferred table, whichever are listed.
    """
    rank = F.array_position(F.array(*[F.lit(t) for t in PREFERRED_TABLES]), F.col("table_name"))
    human = F.lower("assembly").isin(*HUMAN) if "assembly" in available.columns else F.lit(False)
    named = available.withColumn("_known", F.coalesce(human, F.lit(False)))
    best = named.where("_known or table_name is not null").groupBy("genome").agg(F.bool_or("_known").alias("known"), F.min_by(F.when(rank > 0, F.col("table_name")), F.when(rank > 0, rank)).alias("best"))
    return best.select("genome", F.when(F.col("known"), PREFERRED_TABLES[0]).otherwise(F.col("best")).alias("table_name")).where("table_name is not null")


def track_bounds(spans: DataFrame) -> DataFrame:
    return spans.groupBy("contig").agg(F.min("start").alias("first_start"), F.max("end").alias("last_end"))


# Added to the edge that navigation lands on, by (feature, direction, edge).
OFFSETS = {
    ("gene", "next", "start"): 0, ("gene", "next", "end"): 1, ("gene", "previous", "start"): -1, ("gene", "previous", "end"): -1,
    ("exon", "next", "start"): 1, ("exon", "next", "end"): 1, ("exon", "previous", "start"): -1, ("exon", "previous", "end"): -1,
}


def navigate(loci: DataFrame, genes: DataFrame, feature: str, direction: str, edge: str, k: Column, size: int = tiles.ROWS) -> DataFrame:
    """``locus_id, target``: where moving k features on leads; saturating, and unmoved for k = 0 or without features.

    The next feature is found by its start, the previous one by its end; ``edge`` says where to land on it.
    """
    kth = kth_gene if feature == "gene" else kth_exon
    found = kth(loci, genes, k, after=direction == "next", saturating=True, size=size)
    landed = F.greatest(F.lit(1).cast("long"), F.col(f"f_{edge}") + OFFSETS[feature, direction, edge])
    return found.select("locus_id", F.coalesce(landed, F.col("position")).alias("target"))


def kth_gene(loci: DataFrame, genes: DataFrame, k: Column, after: bool, saturating: bool = False, size: int = tiles.ROWS) -> DataFrame:
    """After: by start over the position; before: by end under it. Gene columns come as ``f_*``."""
    return kth_neighbour(loci, _spans(genes), "start" if after else "end", k, after=after, saturating=saturating, size=size)


def kth_exon(loci: DataFrame, genes: DataFrame, k: Column, after: bool, saturating: bool = False, size: int = tiles.ROWS) -> DataFrame:
    """After: by start over the position; before: by end at or under it. ``f_id`` is a struct of the gene's ``id`` and ``exon_no``."""
    spans = exon_spans(genes)
    return kth_neighbour(loci, spans, "start" if after else "end", k, after=after, inclusive=not after, saturating=saturating, size=size)


def stain(text: Column) -> tuple[Column, Column]:
    """``(stain, percent)`` of a band's stain text."""
    pos = F.regexp_extract(text, "^gpos(.*)$", 1)
    percent = F.when(text.rlike("^gpos"), F.coalesce(pos.try_cast("int"), F.lit(0)))
    kind = (
        F.when(F.coalesce(text, F.lit("")) == "", "unknown")
        .when(text.isin("gneg", "acen", "gvar", "stalk"), text)
        .when(percent.between(0, 100), "gpos")
        .otherwise("other")
    )
    return kind, F.when(kind == "gpos", percent)


def cytobands(rows: DataFrame) -> DataFrame:
    """Rows (``chrom, chromStart, chromEnd, name, gieStain``) as 1-based bands with parsed stains and ``after_centromere``."""
    kind, percent = stain(F.col("gieStain"))
    w = Window.partitionBy("chrom").orderBy("chromStart").rowsBetween(Window.unboundedPreceding, -1)
    return rows.select(
        F.col("chrom").alias("contig"), (F.col("chromStart") + 1).alias("start"), F.col("chromEnd").alias("end"), "name", kind.alias("stain"), percent.alias("stain_pct"),
        F.coalesce(F.max(F.col("gieStain") == "acen").over(w), F.lit(False)).alias("after_centromere"),
    )


def bands_or_default(contigs: DataFrame, bands: DataFrame) -> DataFrame:
    """``name, first_start, last_end, n``: bands of each contig, or one that spans it."""
    b = bands.groupBy(F.col("contig").alias("_c")).agg(F.min("start").alias("s"), F.max("end").alias("e"), F.count(F.lit(1)).alias("n"))
    one = F.lit(1).cast("long")
    return contigs.join(b, F.col("name") == F.col("_c"), "left").select("name", F.coalesce("s", one).alias("first_start"), F.coalesce("e", "length").alias("last_end"), F.coalesce("n", one).alias("n"))
