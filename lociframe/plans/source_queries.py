"""Queries on bins and on text sources; the test tables are first turned into lines of each format."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lociframe.functions import filters
from lociframe.operators import bins, genes, lanes, sequence
from lociframe.operators import reads as r
from lociframe.operators.contigs import resolve, with_aliases
from lociframe.operators.joins import first_over, overlapping_ids
from lociframe.operators.tables import kept, shared_dir
from lociframe.plans.adapters import view
from lociframe.plans.layout_queries import READ_LANES, read_lanes
from lociframe.plans.registry import query
from lociframe.sources import annotation, bam, fasta, text


def _pileup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.pileup(r.parsed(view(spark, sf_dir, "reads")), view(spark, sf_dir, "ref_seqs"))


def _n():
    return F.lit(1) + F.col("region_id") % 20


_BINS = """with bins as (select region_id, contig, i as bin, start + i * l // n as bin_start, start + (i + 1) * l // n - 1 as bin_end from (
  select region_id, contig, start, "end" - start + 1 as l, 1 + region_id % 20 as n, unnest(generate_series(0, region_id % 20)) as i from regions))
"""


@query(_BINS + "select region_id, contig, bin, bin_start, bin_end from bins")
def cov_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bins.equal_bins(view(spark, sf_dir, "regions"), _n()).withColumnsRenamed({"start": "bin_start", "end": "bin_end"})


_BINNED = _BINS + """, binned as (select b.region_id, b.bin, coalesce(sum(p.total), 0)::bigint as total from bins b left join pileup p on p.contig = b.contig and p.pos between bin_start and bin_end group by all)
"""


@query(_BINNED + "select region_id, bin, total from binned")
def cov_binned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bins.binned_coverage(view(spark, sf_dir, "regions"), _pileup(spark, sf_dir), _n(), 256)


@query(_BINNED + "select region_id, (ceil(m / pow(10, length(m::varchar) - 2)) * pow(10, length(m::varchar) - 2))::bigint as scale from (select region_id, greatest(10, max(total)) as m from binned group by region_id)")
def cov_depth_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bins.depth_scale(cov_binned(spark, sf_dir))


@query(READ_LANES + "select contig, count(*) as n_reads, cast(max(lane) + 1 as int) as n_lanes from laid group by contig")
def cov_load_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    reads = r.parsed(view(spark, sf_dir, "reads"))
    return bins.load_statistics(reads, read_lanes(spark, sf_dir, "contig"))


def _bam_files(spark: SparkSession, sf_dir: str) -> str:
    """The reads as BAM files with their indexes, in the folder that executors share; the samples of read groups in the headers."""
    folder = f"{shared_dir(spark)}/bam-{uuid.uuid4().hex}"
    contigs = [(r["name"], r["length"] * 8) for r in view(spark, sf_dir, "contigs").orderBy("contig_index").collect()]
    own = F.create_map(F.lit("XI"), F.col("read_id").cast("string"), F.lit("XL"), F.col("line").cast("string"))
    mates = {"mate_contig": F.col("contig"), "mate_start": F.col("start") + F.col("mapq"), "tlen": (F.col("mapq") * 3 - 70).cast("int"), "tags": own}
    bam.write_sorted(view(spark, sf_dir, "reads").withColumns(mates), contigs, folder, {f"RG{i}": f"sample{i % 2}" for i in range(4)})
    return folder


def _own_id() -> Column:
    return F.element_at("tags", "XI").cast("long").alias("read_id")


@query("""select read_id, qname, contig, start, "end" as end_pos, cigar, seq, flag, mapq, read_group, cast(line as string) as line from spans""")
def src_bam_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.format("bam").load(_bam_files(spark, sf_dir))
    return df.select(_own_id(), "qname", "contig", "start", F.col("end").alias("end_pos"), "cigar", "seq", "flag", "mapq", "read_group", F.element_at("tags", "XL").alias("line"))


@query("""select name, length * 8 as length from contigs""")
def src_bam_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.format("bam").option("header", "true").load(_bam_files(spark, sf_dir)).select("name", "length").dropDuplicates(["name"])


@query("""select region_id, s.read_id from regions r join spans s on s.contig = r.contig and s.start <= r."end" and s."end" >= r.start""")
def src_region_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = view(spark, sf_dir, "regions")
    scanned = bam.scan_regions(spark, _bam_files(spark, sf_dir), regions).select("contig", "start", "end", _own_id())
    return overlapping_ids(regions, scanned, "region_id", "read_id", bin_size=512)


@query(
    """select read_id, row_number() over (order by sample, tlen desc, mate_contig, line, read_id) as place from (
      select read_id, concat('sample', cast(right(read_group, 1) as int) % 2) as sample, mapq * 3 - 70 as tlen, contig as mate_contig, cast(line as string) as line from spans)"""
)
def so_source_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sorted by sample, insert size, the mate's contig and a tag, as the files have them."""
    folder = _bam_files(spark, sf_dir)
    reads = spark.read.format("bam").load(folder)
    groups = spark.read.format("bam").option("header", "read_groups").load(folder)
    # Only what orders them, and kept, as the range sort takes its rows twice and would decode the files as often.
    keys = kept(reads.select("file", "read_group", _own_id(), "tlen", "mate_contig", F.map_filter("tags", lambda k, _: k == "XL").alias("tags")))
    sampled = lanes.with_samples(keys, groups)
    order = lanes.sort_columns(["SAMPLE", ("INSERT_SIZE", True), "MATE_CONTIG", "TAG:XL"])
    return lanes.multi_key_places(sampled, [*order, F.col("read_id")]).select("read_id", "place")


@query("""select read_id, read_group = 'RG1' as rg, line = 3 as xl, false as absent, read_group = 'RG1' or line <> 3 as both from spans""")
def fl_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.format("bam").load(_bam_files(spark, sf_dir))
    rg, xl = filters.tag("RG", "RG1"), filters.tag("XL", "3")
    return df.select(_own_id(), rg.alias("rg"), xl.alias("xl"), filters.tag("NM", "0").alias("absent"), (rg | ~xl).alias("both"))


def _lines(df: DataFrame, *columns) -> DataFrame:
    return df.select("idx", F.concat_ws("\t", *columns).alias("value"))


@query("""select idx, contig, pos as start_pos, pos + length(ref) - 1 as end_pos, ref, alt, cast(qual as double) as qual from variants""")
def src_vcf(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = view(spark, sf_dir, "variants")
    bare = F.substring("contig", F.lit(4), F.length("contig"))
    lines = _lines(v, bare, F.col("pos").cast("string"), F.lit("."), "ref", "alt", F.col("qual").cast("string"), F.lit("PASS"), F.lit("."))
    lines = lines.union(spark.sql("select -1L, '##fileformat=VCFv4.1' union all select -2L, '#CHROM\tPOS'"))
    parsed = resolve(text.vcf_lines(lines), with_aliases(view(spark, sf_dir, "contigs"), view(spark, sf_dir, "aliases")))
    return parsed.select("idx", F.col("resolved").alias("contig"), F.col("start").alias("start_pos"), F.col("end").alias("end_pos"), "ref", F.array_join("alt", ",").alias("alt"), "qual")


@query("""select idx, contig, start0 + 1 as start_pos, end0 as end_pos from intervals""")
def src_bed(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = view(spark, sf_dir, "intervals")
    lines = _lines(i, "contig", F.col("start0").cast("string"), F.col("end0").cast("string")).union(spark.sql("select -1L, 'track name=x'"))
    return text.bed_lines(lines).withColumnsRenamed({"start": "start_pos", "end": "end_pos"})


@query("""select contig, bases from ref_seqs""")
def src_fasta(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = F.regexp_replace("bases", "(.{70})", "$1\n")
    return text.fasta_records(view(spark, sf_dir, "ref_seqs").select(F.concat(F.lit(">"), "contig", F.lit(" test\n"), body).alias("value")))


def _fasta_files(spark: SparkSession, sf_dir: str) -> str:
    folder = f"{shared_dir(spark)}/fasta-{uuid.uuid4().hex}"
    fasta.write_indexed(view(spark, sf_dir, "ref_seqs").repartition(3, "contig"), folder, 70)
    return folder


@query("""select region_id, case when r."end" <= 4500 then substring(bases, cast(r.start as int), cast(r."end" - r.start + 1 as int)) end as bases from regions r left join ref_seqs s using (contig)""")
def src_fasta_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions cut out of indexed files, of which only the chunks that regions touch are read."""
    regions = view(spark, sf_dir, "regions")
    return sequence.cut_regions(regions, fasta.region_chunks(spark, _fasta_files(spark, sf_dir), regions, 500), 500)


@query("""select name, length from contigs""")
def src_fasta_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.format("fasta").option("header", "true").load(_fasta_files(spark, sf_dir)).select("name", "length")


@query("""select id as bin, name, contig as chrom, strand, tx0 as txStart, tx_end as txEnd, exon_starts_text as exonStarts, case when id % 7 = 0 then null else name2 end as name2 from genes""")
def src_dump(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = view(spark, sf_dir, "genes")
    s = lambda c: F.col(c).cast("string")
    name2 = F.when(F.col("id") % 7 == 0, "\\N").otherwise(F.col("name2"))
    values = [s("id"), "name", "contig", "strand", s("tx0"), s("tx_end"), s("cds0"), s("cds_end"), F.size(F.split("exon_starts_text", ",")).cast("string"), "exon_starts_text", "exon_ends_text", F.lit("0"), name2, F.lit("cmpl"), F.lit("cmpl"), F.lit("0,")]
    lines = g.select(F.concat(F.concat_ws("\t", *values), F.lit("\r")).alias("value"))
    return text.dump_lines(lines, "refGene", text.GENE_TABLE).select("bin", "name", "chrom", "strand", "txStart", "txEnd", "exonStarts", "name2")


@query("""select name as chrom, length as size, 'x.2bit' as fileName from contigs""")
def src_chrom_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text.sizes_lines(view(spark, sf_dir, "contigs").select(F.concat_ws("\t", "name", F.col("length").cast("string")).alias("value")), "x.2bit")


@query("""select concat('/hub/', name, '/hub.txt') as path, case k when 0 then 'genes' end as track, case k when 0 then 'bigDataUrl' when 1 then 'twoBitPath' else 'chromSizes' end as key,
  concat('/hub/', name, '/', case k when 0 then 'bb/genes.bb' when 1 then concat(name, '.2bit') else concat(name, '.sizes') end) as url from contigs, (select unnest([0, 1, 2]) as k)""")
def src_hub(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.concat(F.lit("hub x\nshortLabel y\n\ngenome g\ntwoBitPath "), "name", F.lit(".2bit\nchromSizes "), "name", F.lit(".sizes\n\ntrack genes\nbigDataUrl bb/genes.bb\ntype bigBed\n\ntrack none\n"))
    return text.hub_manifests(view(spark, sf_dir, "contigs").select(F.concat(F.lit("/hub/"), "name", F.lit("/hub.txt")).alias("path"), value.alias("value")))


@query("""select case when id % 2 = 0 then name2 else name end as name, contig, tx0 + 1 as tx_start, tx_end, case when id % 2 = 0 then exon_starts_text <> '' else false end as has_exons from genes""")
def src_gene_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = view(spark, sf_dir, "genes")
    pred = F.struct("name", "name2", F.col("contig").alias("chrom"), "strand", F.col("tx0").alias("txStart"), F.col("tx_end").alias("txEnd"), F.col("cds0").alias("cdsStart"), F.col("cds_end").alias("cdsEnd"), F.col("exon_starts_text").alias("exonStarts"), F.col("exon_ends_text").alias("exonEnds"))
    bed = F.struct("name", F.col("contig").alias("chrom"), "strand", F.col("tx0").alias("chromStart"), F.col("tx_end").alias("chromEnd"), F.col("cds0").alias("thickStart"), F.col("cds_end").alias("thickEnd"))
    value = F.concat(F.lit('{"refGene": ['), F.when(F.col("id") % 2 == 0, F.to_json(pred)).otherwise(F.to_json(bed)), F.lit("]}"))
    return genes.parse_genes(text.gene_json(g.select(value.alias("value")), "refGene")).select("name", "contig", "tx_start", "tx_end", "has_exons")


@query("""select name, length from contigs""")
def src_chromosome_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.concat(F.lit('{"chromosomes": {"'), "name", F.lit('": '), F.col("length").cast("string"), F.lit("}}"))
    return text.chromosome_json(view(spark, sf_dir, "contigs").select(value.alias("value")))


@query("""select chrom, chromStart + 1 as band_start, chromEnd as band_end, name from cytobands""")
def src_cytoband_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    bands = view(spark, sf_dir, "cytobands")
    value = F.concat(F.lit('{"cytoBandIdeo": ['), F.to_json(F.struct(*bands.columns)), F.lit("]}"))
    parsed = genes.cytobands(text.cytoband_json(bands.select(value.alias("value")).union(spark.sql("select '{\"cytoBandIdeo\": []}'"))))
    return parsed.select(F.col("contig").alias("chrom"), F.col("start").alias("band_start"), F.col("end").alias("band_end"), "name")


_CHROM_INFO = """info as (select name as chrom, case contig_index % 4 when 0 then '/gbdb/a/one.2bit' when 1 then 'two.2bit' when 2 then ' ' end as fileName from contigs)"""


def _chrom_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("contig_index") % 4
    return view(spark, sf_dir, "contigs").select(F.col("name").alias("chrom"), F.when(m == 0, "/gbdb/a/one.2bit").when(m == 1, "two.2bit").when(m == 2, " ").alias("fileName"))


@query(f"with {_CHROM_INFO} select distinct regexp_extract(fileName, '[^/]*$') as file from info where trim(fileName) <> ''")
def src_genome_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotation.genome_files(_chrom_info(spark, sf_dir))


@query(f"with {_CHROM_INFO} select chrom, case when trim(fileName) <> '' then regexp_extract(fileName, '[^/]*$') end as file from info")
def src_contig_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotation.with_file(_chrom_info(spark, sf_dir))


@query("""select n_name as name, r_name as organism from nation join region on n_regionkey = r_regionkey order by r_name, n_name limit 7 offset 5""")
def src_list_assemblies(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("nation", "region"))
    listed = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("name"), F.col("r_name").alias("organism"))
    return annotation.list_assemblies(listed, 7, 5)


@query(
    """select locus_id, path, case locus_id % 7 when 0 then 'alignment' when 1 then 'variant' when 2 then 'interval' when 3 then 'variant' end as kind, case locus_id % 7 when 0 then concat(path, '.bai') when 4 then concat(path, '.crai') when 5 then concat(path, '.fai') end as index,
      locus_id % 7 = 0 as remote, case when locus_id % 7 > 3 then concat('unsupported file type: ', path) end as error
    from (select locus_id, concat(case when locus_id % 7 = 0 then 's3://b/' else '' end, locus_id, case locus_id % 7 when 0 then '.BAM' when 1 then '.vcf' when 2 then '.bed' when 3 then '.vcf.gz' when 4 then '.cram' when 5 then '.fa' else '.txt' end) as path from loci)"""
)
def src_classify_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("locus_id") % 7
    extension = F.element_at(F.array(*[F.lit(x) for x in (".BAM", ".vcf", ".bed", ".vcf.gz", ".cram", ".fa", ".txt")]), (m + 1).cast("int"))
    path = F.concat(F.when(m == 0, "s3://b/").otherwise(""), F.col("locus_id").cast("string"), extension)
    return annotation.classify_paths(view(spark, sf_dir, "loci").select("locus_id", path.alias("path")))


@query(
    """select id, reference, case id % 6 when 0 then 'hg38' when 1 then 'accession' when 2 then 'fasta' when 3 then 'twobit' else 'assembly' end as kind,
      case id % 6 when 0 then 'hg38' when 4 then concat('asm', id % 25) else reference end as assembly
    from (select id, case id % 6 when 0 then 'HG38' when 1 then concat('GCF_', id) when 2 then concat(id, '.fa.gz') when 3 then concat(id, '.2bit') when 4 then concat('Common.Name ', id % 25) else concat('own', id) end as reference from genes)"""
)
def src_classify_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    catalogue = view(spark, sf_dir, "contigs").select(F.concat(F.lit("asm"), F.col("contig_index").cast("string")).alias("genome"), F.concat(F.lit("common-name_"), F.col("contig_index").cast("string")).alias("name"))
    i, m = F.col("id").cast("string"), F.col("id") % 6
    ref = F.when(m == 0, "HG38").when(m == 1, F.concat(F.lit("GCF_"), i)).when(m == 2, F.concat(i, F.lit(".fa.gz"))).when(m == 3, F.concat(i, F.lit(".2bit"))).when(m == 4, F.concat(F.lit("Common.Name "), (F.col("id") % 25).cast("string"))).otherwise(F.concat(F.lit("own"), i))
    return annotation.classify_references(view(spark, sf_dir, "genes").select("id", ref.alias("reference")), catalogue)


@query("""select region_id, min_by(s.read_id, (s.start, s.read_id)) as read_id from regions r left join spans s on s.contig = r.contig and s_start <= r."end" and s_end >= r.start group by region_id""")
def rd_first_overlapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first read in file order over each region, clips counted; null where there is none."""
    reads = r.parsed(view(spark, sf_dir, "reads")).select("contig", F.col("s_start").alias("start"), F.col("s_end").alias("end"), F.col("start").alias("first"), "read_id")
    return first_over(view(spark, sf_dir, "regions"), reads, "first", "read_id").select("region_id", F.col("found.id").alias("read_id"))


@query("""select c_name as name, cast(c_acctbal as double) as balance, cast(c_custkey as bigint) as id from customer""")
def src_mirror(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = lambda: spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_custkey").alias("id"))
    return annotation.mirror_table(read, {"name": "varchar(25)", "balance": "double", "id": "int(10) unsigned"})
