"""Text formats as DataFrames: VCF, BED, FASTA, table dumps, chromosome sizes, hub manifests, JSON responses.

Each ``*_lines`` function takes a DataFrame with one line (or file) per row in ``value``; the ``read_*`` functions
read paths with Spark's own readers and call them. All coordinates come out 1-based.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Columns of the annotation dumps.
CHROM_INFO = (("chrom", "string"), ("size", "bigint"), ("fileName", "string"))
CHROM_ALIAS = (("alias", "string"), ("chrom", "string"), ("source", "string"))
CYTOBAND = (("chrom", "string"), ("chromStart", "bigint"), ("chromEnd", "bigint"), ("name", "string"), ("gieStain", "string"))
GENE_TABLE = (
    ("bin", "bigint"), ("name", "string"), ("chrom", "string"), ("strand", "string"), ("txStart", "bigint"), ("txEnd", "bigint"), ("cdsStart", "bigint"), ("cdsEnd", "bigint"),
    ("exonCount", "bigint"), ("exonStarts", "string"), ("exonEnds", "string"), ("score", "bigint"), ("name2", "string"), ("cdsStartStat", "string"), ("cdsEndStat", "string"), ("exonFrames", "string"),
)


def _read(spark: SparkSession, path: str) -> DataFrame:
    """Lines of plain or gzipped files with their file and order (``idx``, by file and place, with gaps)."""
    return spark.read.text(path).select("value", F.monotonically_increasing_id().alias("idx"))


def vcf_lines(lines: DataFrame) -> DataFrame:
    """Records of VCF lines, ``#`` lines left out; other columns of ``lines`` are kept. ``end`` is the last reference base; a bad position is null."""
    f = F.split("value", "\t", -1)
    text = lambda i: F.nullif(F.get(f, F.lit(i)), F.lit("."))
    kept = [c for c in lines.columns if c != "value"]
    return lines.where(~F.col("value").startswith("#") & (F.col("value") != "")).select(
        *kept,
        F.get(f, F.lit(0)).alias("contig"),
        F.get(f, F.lit(1)).try_cast("long").alias("start"),
        (F.get(f, F.lit(1)).try_cast("long") + F.length(F.get(f, F.lit(3))) - 1).alias("end"),
        text(2).alias("id"),
        F.get(f, F.lit(3)).alias("ref"),
        F.when(F.get(f, F.lit(4)) == ".", F.array().cast("array<string>")).otherwise(F.split(F.get(f, F.lit(4)), ",")).alias("alt"),
        text(5).try_cast("double").alias("qual"),
        text(6).alias("filter"),
        text(7).alias("info"),
        F.get(f, F.lit(8)).alias("format"),
        F.slice(f, F.lit(10), F.greatest(F.size(f) - 9, F.lit(0))).alias("samples"),
    )


def bed_lines(lines: DataFrame) -> DataFrame:
    """Intervals of BED lines; comments and track lines are left out; a missing end is the start."""
    f = F.split("value", "\t", -1)
    kept = [c for c in lines.columns if c != "value"]
    start = F.get(f, F.lit(1)).cast("long") + 1
    return lines.where(~F.col("value").rlike("^(#|track|browser)") & (F.trim("value") != "")).select(
        *kept, F.get(f, F.lit(0)).alias("contig"), start.alias("start"), F.coalesce(F.get(f, F.lit(2)).try_cast("long"), start).alias("end")
    )


def fasta_records(records: DataFrame) -> DataFrame:
    """``contig, bases`` of rows that hold one FASTA record each (text between ``>`` marks)."""
    head = F.regexp_extract("value", "^>?([^\\s]+)", 1)
    body = F.regexp_replace(F.regexp_replace("value", "^>?[^\\n]*\\n?", ""), "\\s+", "")
    return records.where(F.trim("value") != "").select(head.alias("contig"), body.alias("bases"))


def fai_lines(lines: DataFrame) -> DataFrame:
    """Contigs of FASTA index lines."""
    f = F.split("value", "\t")
    return lines.where("value <> ''").select(F.get(f, F.lit(0)).alias("name"), F.get(f, F.lit(1)).cast("long").alias("length"))


def dump_lines(lines: DataFrame, table: str, columns: Sequence[tuple[str, str]]) -> DataFrame:
    r"""Typed rows of a tab-separated dump; ``\N`` is null.

    A wrong number of columns, or a value that doesn't fit its type, raises an error that names table, column and
    the value. Other columns of ``lines`` are kept.
    """
    line = F.rtrim("value", F.lit("\r\n"))
    f = F.split(line, "\t", -1)
    kept = [c for c in lines.columns if c != "value"]
    wrong = F.raise_error(F.concat(F.lit(f"table {table}: {len(columns)} columns expected in: "), line))
    fields = F.when(F.size(f) != len(columns), wrong.cast("array<string>")).otherwise(f)

    def typed(i: int, name: str, kind: str) -> Column:
        value = F.nullif(F.get(F.col("_f"), F.lit(i)), F.lit("\\N"))
        cast = value.try_cast(kind)
        bad = F.raise_error(F.concat(F.lit(f"table {table}, column {name}: not a {kind}: "), value)).cast(kind)
        return F.when(value.isNotNull() & cast.isNull(), bad).otherwise(cast).alias(name)

    return lines.where(line != "").withColumn("_f", fields).select(*kept, *[typed(i, n, k) for i, (n, k) in enumerate(columns)])


def sizes_lines(lines: DataFrame, basename: str) -> DataFrame:
    """``chrom, size, fileName`` of ``name<tab>size`` lines."""
    f = F.split("value", "\t")
    return lines.where("value <> ''").select(F.get(f, F.lit(0)).alias("chrom"), F.get(f, F.lit(1)).cast("long").alias("size"), F.lit(basename).alias("fileName"))


def hub_manifests(files: DataFrame) -> DataFrame:
    """``path, track, key, url`` of hub manifests (``path, value`` = whole text): each track's data file and the genome's own files, as URLs beside the manifest."""
    stanzas = files.select("path", F.posexplode(F.split(F.regexp_replace("value", "\r", ""), "\n[ \t]*\n")).alias("stanza", "text"))
    field = lambda k: F.nullif(F.trim(F.regexp_extract("text", f"(?m)^[ \t]*{k}[ \t]+(.*)$", 1)), F.lit(""))
    base = F.regexp_replace("path", "[^/]*$", "")
    keys = F.array(
        F.struct(F.lit("bigDataUrl").alias("key"), field("bigDataUrl").alias("file"), field("track").alias("track")),
        *[F.struct(F.lit(k).alias("key"), field(k).alias("file"), F.lit(None).cast("string").alias("track")) for k in ("twoBitPath", "chromSizes", "chromAliasBb")],
    )
    rows = stanzas.select("path", F.explode(keys).alias("k")).where(F.col("k.file").isNotNull() & ((F.col("k.key") != "bigDataUrl") | F.col("k.track").isNotNull()))
    absolute = F.col("k.file").rlike("^[a-z]+://")
    return rows.select("path", "k.track", "k.key", F.when(absolute, F.col("k.file")).otherwise(F.concat(base, F.col("k.file"))).alias("url"))


GENE_JSON = "chrom string, name string, name2 string, strand string, txStart bigint, txEnd bigint, cdsStart bigint, cdsEnd bigint, exonStarts string, exonEnds string, chromStart bigint, chromEnd bigint, thickStart bigint, thickEnd bigint"


def gene_json(responses: DataFrame, track: str) -> DataFrame:
    """0-based gene rows, as ``parse_genes`` takes them, of JSON responses in both shapes: gene predictions, or BED-like without exons."""
    parsed = responses.select(F.explode(F.from_json("value", f"`{track}` array<struct<{', '.join(f'{n}:{k}' for n, k in (x.split() for x in GENE_JSON.split(', ')))}>>")[track]).alias("g"))
    pred = F.col("g.txStart").isNotNull()
    pick = lambda a, b: F.when(pred, F.col(f"g.{a}")).otherwise(F.col(f"g.{b}"))
    return parsed.select(
        F.xxhash64("g").alias("id"), F.col("g.name").alias("name"), F.col("g.name2").alias("name2"), F.col("g.chrom").alias("contig"), F.col("g.strand").alias("strand"),
        pick("txStart", "chromStart").alias("tx0"), pick("txEnd", "chromEnd").alias("tx_end"), pick("cdsStart", "thickStart").alias("cds0"), pick("cdsEnd", "thickEnd").alias("cds_end"),
        F.when(pred, F.col("g.exonStarts")).alias("exon_starts_text"), F.when(pred, F.col("g.exonEnds")).alias("exon_ends_text"),
    )


def chromosome_json(responses: DataFrame) -> DataFrame:
    """``name, length`` of ``{"chromosomes": {name: length}}`` responses."""
    return responses.select(F.explode(F.from_json("value", "chromosomes map<string,bigint>")["chromosomes"]).alias("name", "length"))


def cytoband_json(responses: DataFrame) -> DataFrame:
    """Band rows of JSON responses (``cytoBandIdeo`` arrays); none for an empty array."""
    return responses.select(F.inline(F.from_json("value", "cytoBandIdeo array<struct<chrom:string,chromStart:bigint,chromEnd:bigint,name:string,gieStain:string>>")["cytoBandIdeo"]))


def read_vcf(spark: SparkSession, path: str) -> DataFrame:
    return vcf_lines(_read(spark, path))


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    return bed_lines(_read(spark, path))


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """One row per sequence, split at record marks by the reader; a sequence is one value, so below 2 GB."""
    return fasta_records(spark.read.option("lineSep", "\n>").text(path))


def read_dump(spark: SparkSession, path: str, table: str, columns: Sequence[tuple[str, str]]) -> DataFrame:
    return dump_lines(spark.read.text(path), table, columns)


def read_hubs(spark: SparkSession, path: str) -> DataFrame:
    return hub_manifests(spark.read.option("wholetext", True).text(path).select(F.input_file_name().alias("path"), "value"))


def read_genomes(spark: SparkSession, path: str) -> DataFrame:
    """The genome catalogue: ``genome, name``."""
    return spark.read.csv(path, header=True, quote='"', schema="genome string, name string")


def schema_of(columns: Sequence[tuple[str, str]]) -> T.StructType:
    return T._parse_datatype_string(", ".join(f"`{n}` {k}" for n, k in columns))
