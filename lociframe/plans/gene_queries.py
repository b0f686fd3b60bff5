"""Queries on genes, navigation, cytobands, contigs, intervals, sequence and text formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lociframe.functions import formats
from lociframe.functions import intervals as iv
from lociframe.functions import reads as fr
from lociframe.operators import contigs as ctg
from lociframe.operators import genes as g
from lociframe.operators import sequence as sq
from lociframe.operators.joins import count_overlaps, overlap_join, overlap_pairs
from lociframe.plans.adapters import view
from lociframe.plans.registry import query


def _genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.parse_genes(view(spark, sf_dir, "genes"))


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "loci").select("locus_id", "contig", F.col("position").alias("start"), F.col("position").alias("end"))


# --- intervals


@query("""select idx, end0 - start0 as length, 1000 between start0 + 1 and end0 as covers_1000, (start0 + 1 + end0) // 2 as middle, start0 + 1 <= end0 and end0 <= 3950 as bounded from intervals""")
def int_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, e = F.col("start0") + 1, F.col("end0")
    return view(spark, sf_dir, "intervals").select(
        "idx", iv.length(s, e).alias("length"), iv.covers(s, e, F.lit(1000)).alias("covers_1000"), iv.middle(s, e).alias("middle"), iv.is_properly_bounded(s, e, F.lit(3950)).alias("bounded")
    )


@query("""select idx, start0 + 1 <= 1500 and end0 >= 1400 as overlaps, start0 + 1 <= 1400 and end0 >= 1410 as contains from intervals""")
def int_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, e = F.col("start0") + 1, F.col("end0")
    return view(spark, sf_dir, "intervals").select("idx", iv.overlaps(s, e, F.lit(1400), F.lit(1500)).alias("overlaps"), iv.contains(s, e, F.lit(1400), F.lit(1410)).alias("contains"))


def _intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "intervals").select("idx", "contig", (F.col("start0") + 1).alias("start"), F.col("end0").alias("end"))


@query("""select r.region_id, i.idx from regions r join intervals i on r.contig = i.contig and r.start <= i.end0 and r."end" >= i.start0 + 1""")
def int_overlap_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlap_pairs(view(spark, sf_dir, "regions"), _intervals(spark, sf_dir), bin_size=256).select("region_id", F.col("r_idx").alias("idx"))


@query("""select i.idx, count(*) as n_reads from intervals i join spans s on i.contig = s.contig and s.start <= i.end0 and s."end" >= i.start0 + 1 group by i.idx""")
def int_read_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lociframe.operators import reads as r

    reads = r.parsed(view(spark, sf_dir, "reads")).select("contig", "start", "end")
    return count_overlaps(_intervals(spark, sf_dir), reads, "idx").withColumnRenamed("n", "n_reads")


@query(
    """with twice as (select * from intervals where idx % 40 = 0 union all select * from intervals where idx % 80 = 0)
    select r.region_id, i.idx from regions r left join twice i on r.contig = i.contig and r.start <= i.end0 and r."end" >= i.start0 + 1"""
)
def int_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = _intervals(spark, sf_dir)
    twice = every.where("idx % 40 = 0").unionByName(every.where("idx % 80 = 0"))
    return overlap_join(view(spark, sf_dir, "regions"), twice, bin_size=256, how="left").select("region_id", F.col("r_idx").alias("idx"))


@query("""select locus_id, greatest(1, position - half_width) as region_start, position + half_width as region_end, greatest(1, position - half_width * 3) as padded_start, position + half_width * 3 as padded_end,
  greatest(1, position - 100) as moved_left, position + locus_id % 50 as moved_right from loci""")
def int_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, h = F.col("position"), F.col("half_width")
    (a, b), (c, d) = iv.region_around(p, h), iv.region_around(p, h * 3)
    return view(spark, sf_dir, "loci").select(
        "locus_id", a.alias("region_start"), b.alias("region_end"), c.alias("padded_start"), d.alias("padded_end"), iv.shift(p, F.lit(-100)).alias("moved_left"), iv.shift(p, F.col("locus_id") % 50).alias("moved_right")
    )


_LOCUS_TEXTS = """texts as (select locus_id, contig, position, case locus_id % 6 when 0 then cast(position as string) when 1 then concat(contig, ':', cast(position as string)) when 2 then concat(substring(contig, 4), ':', cast(position as string))
  when 3 then concat('GENE', cast(locus_id as string)) when 4 then concat(contig, ':invalid') else 'a:b:c' end as text from loci)"""


@query(
    f"""with {_LOCUS_TEXTS}
    select locus_id, case locus_id % 6 when 0 then 'position' when 1 then 'locus' when 2 then 'locus' when 3 then case when g.contig is null then 'error' else 'gene' end else 'error' end as kind,
      case locus_id % 6 when 1 then t.contig when 2 then t.contig when 3 then g.contig end as found_contig, case when locus_id % 6 < 3 then t.position when locus_id % 6 = 3 then g.tx0 + 2 end as found_position
    from texts t left join genes g on g.name2 = t.text"""
)
def int_parse_locus(spark: SparkSession, sf_dir: str) -> DataFrame:
    loci = view(spark, sf_dir, "loci")
    p, c = F.col("position").cast("string"), F.col("contig")
    text = (
        F.when(F.col("locus_id") % 6 == 0, p).when(F.col("locus_id") % 6 == 1, F.concat(c, F.lit(":"), p)).when(F.col("locus_id") % 6 == 2, F.concat(F.substring(c, F.lit(4), F.length(c)), F.lit(":"), p))
        .when(F.col("locus_id") % 6 == 3, F.concat(F.lit("GENE"), F.col("locus_id").cast("string"))).when(F.col("locus_id") % 6 == 4, F.concat(c, F.lit(":invalid"))).otherwise("a:b:c")
    )
    names = ctg.with_aliases(view(spark, sf_dir, "contigs"), view(spark, sf_dir, "aliases"))
    out = formats.parse_loci(loci.select("locus_id", text.alias("text")), names, _genes(spark, sf_dir))
    return out.select("locus_id", "kind", F.col("contig").alias("found_contig"), F.col("position").alias("found_position"))


@query("""select region_id, exists (select 1 from intervals i where i.contig = r.contig and i.start0 + 1 <= r.start and i.end0 >= r."end") as complete from regions r""")
def int_extent_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = view(spark, sf_dir, "regions")
    inside = overlap_join(regions, _intervals(spark, sf_dir), bin_size=256).where((F.col("r_start") <= F.col("start")) & (F.col("r_end") >= F.col("end"))).select(F.col("region_id").alias("_id")).distinct()
    return regions.join(inside, F.col("region_id") == F.col("_id"), "left").select("region_id", F.col("_id").isNotNull().alias("complete"))


@query(
    """select locus_id, case when position < 1000 then -greatest(1, (1000 - position) // 8) when position >= 1800 then 99 + greatest(1, (position - 1800) // 8) else (position - 1000) // 8 end as tile, 1000 + (locus_id % 100) * 8 as tile_start, 1007 + (locus_id % 100) * 8 as tile_end from loci"""
)
def int_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, zoom = F.lit(1000).cast("long"), F.lit(8)
    a, b = iv.tile_range(F.col("locus_id") % 100, left, zoom)
    return view(spark, sf_dir, "loci").select("locus_id", iv.tile_of(F.col("position"), left, F.lit(100), zoom).alias("tile"), a.alias("tile_start"), b.alias("tile_end"))


@query(
    """select idx, case when start0 + 1 <= 1799 and end0 >= 1000 then (greatest(start0 + 1, 1000) - 1000) // 8 end as first_tile, case when start0 + 1 <= 1799 and end0 >= 1000 then (least(end0, 1799) - 1000) // 8 - (greatest(start0 + 1, 1000) - 1000) // 8 + 1 end as n_tiles from intervals"""
)
def int_clip(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, n = iv.clip_to_tiles(F.col("start"), F.col("end"), F.lit(1000), F.lit(1799), F.lit(8))
    return _intervals(spark, sf_dir).select("idx", first.alias("first_tile"), n.alias("n_tiles"))


# --- genes


@query("""select g.id, g.name2 as name, contig, strand, tx0 + 1 as tx_start, tx_end, cds0 + 1 as cds_start, cds_end, string_agg(e.start, ',' order by e.i) as exon_starts, string_agg(e."end", ',' order by e.i) as exon_ends, count(*) as n_exons, min(e."end") as first_exon_end
  from genes g join (select id, i, start, "end" from exons) e using (id) group by all""")
def gen_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return _genes(spark, sf_dir).select("id", "name", "contig", "strand", "tx_start", "tx_end", "cds_start", "cds_end", text("exon_starts").alias("exon_starts"), text("exon_ends").alias("exon_ends"), F.size("exon_starts").cast("long").alias("n_exons"), F.get("exon_ends", F.lit(0)).alias("first_exon_end"))


@query("""select p_partkey::bigint as id, concat(p_partkey + 1, ',', p_partkey + 61) as starts, concat(p_partkey + 20 + p_size, ',', p_partkey + 70) as ends from part""")
def gen_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    k = F.col("p_partkey").cast("long")
    starts, ends = g.blocks_to_exons(k, F.array(F.lit(0), F.lit(60)), F.array(F.col("p_size") + 20, F.lit(10)))
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return part.select(k.alias("id"), text(starts).alias("starts"), text(ends).alias("ends"))


_FEATURES = """with ex as (select e.*, g.name2 as name, cds0 + 1 as cs, cds_end as ce, lead(e.start) over (partition by e.id order by e.i) as nxt, count(*) over (partition by e.id) as n from exons e join genes g using (id)),
parts as (
  select id, name, strand, n, i, 1 as o, start as s, "end" as e, 'NonCDSExon' as type from ex where cs > ce
  union all select id, name, strand, n, i, 1, start, least("end", cs - 1), 'NonCDSExon' from ex where cs <= ce and start < cs
  union all select id, name, strand, n, i, 2, greatest(start, cs), least("end", ce), 'Exon' from ex where greatest(start, cs) <= least("end", ce)
  union all select id, name, strand, n, i, 3, greatest(start, ce + 1), "end", 'NonCDSExon' from ex where cs <= ce and "end" > ce
  union all select id, name, strand, n, i, 4, "end" + 1, nxt - 1, 'Intron' from ex where "end" + 1 < nxt),
feats as (
  select *, row_number() over (partition by id, type order by i, o) as k, count(*) over (partition by id, type) as m from parts),
features as (
  select id, name, s, e, type, cast(case when type = 'NonCDSExon' then 0 when strand <> '-' then k when type = 'Exon' then n - k + 1 else m - k + 1 end as int) as number from feats)
"""


@query(_FEATURES + "select id, s as feature_start, e as feature_end, type, number, case type when 'Exon' then concat(name, ':exon', number) when 'Intron' then concat(name, ':intron', number) else name end as label from features")
def gen_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.features(_genes(spark, sf_dir)).select("id", F.col("start").alias("feature_start"), F.col("end").alias("feature_end"), "type", "number", g.label(F.col("name"), F.col("type"), F.col("number")).alias("label"))


@query("""select locus_id, g.id as gene_id, g.contig, g.tx0 + 2 as position, g.id is not null as found from loci l left join genes g on g.name2 = concat('GENE', l.locus_id * 3)""")
def gen_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = view(spark, sf_dir, "loci").select("locus_id", F.concat(F.lit("GENE"), (F.col("locus_id") * 3).cast("string")).alias("name"))
    return g.genes_by_name(names, _genes(spark, sf_dir)).drop("name")


@query("""select region_id, g.id as gene_id from regions r join genes g on r.contig = g.contig and g.tx0 + 1 <= r."end" and g.tx_end >= r.start""")
def gen_overlapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.genes_overlapping(view(spark, sf_dir, "regions"), _genes(spark, sf_dir), 256).select("region_id", F.col("r_id").alias("gene_id"))


@query("""select locus_id, (select id from genes g where g.contig = l.contig and l.position between g.tx0 + 1 and g.tx_end order by g.tx0, id limit 1) as gene_id from loci l""")
def gen_covering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.gene_covering(view(spark, sf_dir, "loci"), _genes(spark, sf_dir))


_AT = """with f as ({spans}), by_start as (select contig, start as k, max_by(id, (start, id)) as id from f group by all), by_end as (select contig, e as k, max_by(id, (start, id)) as id from f group by all)
select locus_id, case when (select id from by_start b where b.contig = l.contig and b.k <= l.position order by k desc limit 1) = (select id from by_end b where b.contig = l.contig and b.k >= l.position order by k limit 1)
  then (select id from by_start b where b.contig = l.contig and b.k <= l.position order by k desc limit 1) end as id from loci l"""
_GENE_SPANS = "select id, contig, tx0 + 1 as start, tx_end as e from genes"
_EXON_SPANS = "select {'gene': id, 'no': i::int} as id, contig, start, \"end\" as e from exons"
_EXON_ID = "id.gene as gene_id, id.no as exon_no"


def _exon_id(id: str) -> list[Column]:
    return [F.col(f"{id}.id").alias("gene_id"), F.col(f"{id}.exon_no").alias("exon_no")]


@query(_AT.format(spans=_GENE_SPANS))
def gen_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.feature_at(view(spark, sf_dir, "loci"), g._spans(_genes(spark, sf_dir)))


@query(f"select locus_id, {_EXON_ID} from ({_AT.format(spans=_EXON_SPANS)})")
def gen_exon_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.feature_at(view(spark, sf_dir, "loci"), g.exon_spans(_genes(spark, sf_dir))).select("locus_id", *_exon_id("id"))


@query("""select region_id, g.id as gene_id from regions r join genes g on r.contig = g.contig and g.tx0 + 1 >= r.start and g.tx_end <= r."end" """)
def gen_inside(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.genes_inside(view(spark, sf_dir, "regions"), _genes(spark, sf_dir), 256).select("region_id", F.col("r_id").alias("gene_id"))


@query("""select n_name as genome, case when n_nationkey % 3 = 0 then 'ncbiRefSeqSelect' when n_nationkey % 3 = 1 then 'ncbiRefSeq' else 'refGene' end as table_name from nation
  union all select 'h' || n_nationkey, case when n_nationkey % 2 = 0 then 'ncbiRefSeqSelect' else 'refGene' end from nation""")
def gen_preferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of genomes; half of the ``h`` ones are of a human assembly, which has a table of its own whatever is there."""
    nation = spark.read.parquet(f"{sf_dir}/nation.parquet")
    k = F.col("n_nationkey") % 3
    tables = F.array_compact(F.array(F.lit("refGene"), F.lit("knownGene"), F.when(k < 2, F.lit("ncbiRefSeq")), F.when(k == 0, F.lit("ncbiRefSeqSelect"))))
    assembly = F.when(F.col("n_nationkey") % 2 == 0, F.when(F.col("n_nationkey") % 4 == 0, "hg19").otherwise("HG38")).otherwise("mm10")
    own = nation.select(F.concat(F.lit("h"), F.col("n_nationkey").cast("string")).alias("genome"), F.lit("refGene").alias("table_name"), assembly.alias("assembly"))
    return g.preferred_table(nation.select(F.col("n_name").alias("genome"), F.explode(tables).alias("table_name"), F.lit("other").alias("assembly")).unionByName(own))


@query("""select contig, min(tx0 + 1) as first_start, max(tx_end) as last_end from genes group by contig""")
def gen_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.track_bounds(g._spans(_genes(spark, sf_dir)))


# --- navigation

_KTH = """with f as ({spans}), u as (select contig, {key} as k, max_by(id, (start, id)) as id, max_by(start, (start, id)) as start, max_by(e, (start, id)) as e from f group by contig, {key}),
ranked as (select locus_id, u.id, row_number() over (partition by locus_id order by k {order}) as r from loci l join u on u.contig = l.contig and u.k {test} l.position),
kth as (select l.locus_id, l.contig, l.position, ranked.id from loci l left join ranked on ranked.locus_id = l.locus_id and r = 1 + l.locus_id % 3),
ends as (select contig, arg_{far}(id, k) as id from u group by contig),
found as (select locus_id, kth.contig, position, {pick} as id from kth left join ends using (contig))
"""


def _kth_sql(exon: bool, after: bool, saturating: bool) -> str:
    return _KTH.format(
        spans=_EXON_SPANS if exon else _GENE_SPANS, key="start" if after else "e", test=">" if after else ("<=" if exon else "<"), order="" if after else "desc",
        far="max" if after else "min", pick="coalesce(kth.id, ends.id)" if saturating else "kth.id",
    )


def _steps():
    return 1 + F.col("locus_id") % 3


def _nav(exon: bool, after: bool, saturating: bool):
    kth = g.kth_exon if exon else g.kth_gene

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return kth(view(spark, sf_dir, "loci"), _genes(spark, sf_dir), _steps(), after, saturating).select("locus_id", *(_exon_id("f_id") if exon else [F.col("f_id").alias("id")]))

    run.__name__ = f"nav_kth_{'exon' if exon else 'gene'}_{'after' if after else 'before'}{'_saturating' if saturating else ''}"
    return query(_kth_sql(exon, after, saturating) + f"select locus_id, {_EXON_ID if exon else 'id'} from found")(run)


for _exon in (False, True):
    for _after in (False, True):
        for _saturating in (False, True):
            _nav(_exon, _after, _saturating)


# What the rules of navigation add to the edge, written here again for the SQL.
_ADDED = {"next_gene_start": 0, "next_gene_end": 1, "previous_gene_start": -1, "previous_gene_end": -1, "next_exon_start": 1, "next_exon_end": 1, "previous_exon_start": -1, "previous_exon_end": -1}


def _move(feature: str, direction: str, edge: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return g.navigate(view(spark, sf_dir, "loci"), _genes(spark, sf_dir), feature, direction, edge, _steps())

    run.__name__ = f"nav_{direction}_{feature}_{edge}"
    column, offset = ("start" if edge == "start" else "e"), _ADDED[f"{direction}_{feature}_{edge}"]
    return query(_kth_sql(feature == "exon", direction == "next", True) + f"select locus_id, coalesce(greatest(1, (select {column} from f where f.id = found.id) + {offset}), position) as target from found")(run)


for _feature, _direction, _edge in g.OFFSETS:
    _move(_feature, _direction, _edge)


# --- cytobands


@query("""select chrom as contig, chromStart + 1 as band_start, chromEnd as band_end, name, case when gieStain like 'gpos%' then 'gpos' else gieStain end as stain, case when gieStain like 'gpos%' then cast(substring(gieStain, 5) as int) end as stain_pct, chromStart > 1500 as after_centromere from cytobands""")
def cyt_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return g.cytobands(view(spark, sf_dir, "cytobands")).withColumnsRenamed({"start": "band_start", "end": "band_end"})


@query("""select c.name, coalesce(min(b.chromStart) + 1, 1) as first_start, coalesce(max(b.chromEnd), any_value(c.length)) as last_end, greatest(count(b.name), 1) as n from contigs c left join cytobands b on b.chrom = c.name and c.contig_index % 2 = 0 group by c.name""")
def cyt_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    contigs = view(spark, sf_dir, "contigs")
    bands = g.cytobands(view(spark, sf_dir, "cytobands")).join(contigs.where("contig_index % 2 = 0").select(F.col("name").alias("contig")), "contig", "left_semi")
    return g.bands_or_default(contigs, bands)


@query("""select locus_id, b.name from loci l join cytobands b on l.contig = b.chrom and l.position between b.chromStart + 1 and b.chromEnd""")
def cyt_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    bands = g.cytobands(view(spark, sf_dir, "cytobands"))
    return overlap_join(_points(spark, sf_dir), bands, bin_size=512).select("locus_id", F.col("r_name").alias("name"))


# --- contigs


@query("""select alias, case when alias in ('X', 'Y') or try_cast(alias as int) is not null then concat('chr', alias) else '' end as generated from aliases union all select name, case when name <> 'chrM' and (name in ('chrX', 'chrY') or try_cast(substring(name, 4) as int) between 1 and 22) then substring(name, 4) else '' end from contigs""")
def ctg_generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = view(spark, sf_dir, "aliases").select("alias").union(view(spark, sf_dir, "contigs").select("name"))
    return names.select("alias", F.array_join(ctg.generated_aliases(F.col("alias")), ",").alias("generated"))


@query("""select name, length, string_agg(alias, ',' order by alias) as aliases from contigs join aliases on chrom = name group by all""")
def ctg_with_aliases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctg.with_aliases(view(spark, sf_dir, "contigs"), view(spark, sf_dir, "aliases")).withColumn("aliases", F.array_join("aliases", ","))


@query("""select locus_id, text, coalesce(c.name, a.chrom) as resolved from (select locus_id, case locus_id % 3 when 0 then contig when 1 then substring(contig, 4) else 'unknown' end as text from loci) l left join contigs c on c.name = text left join aliases a on a.alias = text""")
def ctg_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("locus_id") % 3
    names = view(spark, sf_dir, "loci").select("locus_id", F.when(m == 0, F.col("contig")).when(m == 1, F.substring("contig", F.lit(4), F.length("contig"))).otherwise("unknown").alias("text"))
    return ctg.resolve(names, ctg.with_aliases(view(spark, sf_dir, "contigs"), view(spark, sf_dir, "aliases")), "text")


@query("""select c.name, cast(9000 + contig_index as bigint) as length, concat_ws(',', string_agg(a.alias, ',' order by a.alias)) as aliases, c.name as track_name, (select alias from aliases a2 where a2.chrom = c.name and alias not like 'NC%') as sequence_name, (select alias from aliases a2 where a2.chrom = c.name and alias like 'NC%') as alignment_name
  from contigs c join aliases a on a.chrom = c.name group by all""")
def ctg_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    contigs = view(spark, sf_dir, "contigs")
    aliases = view(spark, sf_dir, "aliases").join(contigs, F.col("chrom") == F.col("name"))
    none = F.array().cast("array<string>")
    track = ctg.with_aliases(contigs, view(spark, sf_dir, "aliases")).select(F.lit(0).alias("source_rank"), "name", "length", "aliases")
    fasta = aliases.where("alias not like 'NC%'").select(F.lit(1), F.col("alias"), F.lit(None).cast("long"), none)
    header = aliases.where("alias like 'NC%'").select(F.lit(2), F.col("alias"), F.col("contig_index") + 9000, none)
    return ctg.merge_sources(track.union(fasta).union(header)).withColumn("aliases", F.array_join("aliases", ","))


@query(
    """with recursive given as (
    select 3 - contig_index % 4 as source_rank, 'n' || contig_index as name, contig_index as length, case when contig_index % 6 < 5 then ['n' || (contig_index + 1), 'z' || contig_index] else ['z' || contig_index] end as aliases from contigs),
  named as (select source_rank, name, unnest([name] || aliases) as any_name from given),
  linked as (select distinct a.name as a, b.name as b from named a join named b using (any_name)),
  reach as (select name as a, name as b from given union select r.a, l.b from reach r join linked l on l.a = r.b),
  labels as (select r.a as name, min_by(g.name, (g.source_rank, g.name)) as canonical from reach r join given g on g.name = r.b group by r.a)
  select canonical as name, max_by(length, source_rank * 1000 + length) as length, array_to_string(list_sort(list_distinct(list_filter(flatten(list(aliases)) || list(g.name), lambda x: x <> canonical))), ',') as aliases
  from given g join labels using (name) group by canonical"""
)
def ctg_merge_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contigs each of which has the next one's name as an alias, in runs of six, from four sources."""
    i = F.col("contig_index")
    name = lambda letter, k: F.concat(F.lit(letter), k.cast("string"))
    aliases = F.when(i % 6 < 5, F.array(name("n", i + 1), name("z", i))).otherwise(F.array(name("z", i)))
    rows = view(spark, sf_dir, "contigs").select((3 - i % 4).cast("int").alias("source_rank"), name("n", i).alias("name"), i.alias("length"), aliases.alias("aliases"))
    return ctg.merge_sources(rows).select("name", "length", F.array_join("aliases", ",").alias("aliases"))


@query("""select name, contig_index, (select name from contigs d where d.contig_index = (c.contig_index + 2) % 25) as neighbour from contigs c""")
def ctg_order_and_neighbour(spark: SparkSession, sf_dir: str) -> DataFrame:
    shuffled = view(spark, sf_dir, "contigs").drop("contig_index")
    numbered = ctg.indexed(shuffled)
    return numbered.select("name", "contig_index").join(ctg.neighbour(numbered, 2), "name")


@query("""select a.name as a, b.name as b from contigs a join contigs b on a.name = b.name""")
def ctg_same(spark: SparkSession, sf_dir: str) -> DataFrame:
    contigs = ctg.with_aliases(view(spark, sf_dir, "contigs"), view(spark, sf_dir, "aliases"))
    every = F.concat(F.array("name"), F.col("aliases"))
    a = contigs.select(F.col("name").alias("a"), every.alias("na"), F.explode(every).alias("any"))
    b = contigs.select(F.col("name").alias("b"), every.alias("nb"), F.explode(every).alias("any"))
    return a.join(b, "any").where(ctg.same_contig(F.col("na"), F.col("nb"))).select("a", "b").distinct()


# --- sequence and text


@query("""select locus_id, nullif(substring(bases, cast(position as int), 1), '') as base from loci l left join ref_seqs s using (contig)""")
def seq_base_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sq.bases_at(view(spark, sf_dir, "loci"), view(spark, sf_dir, "ref_seqs"), 1000).select("locus_id", "base")


@query("""select region_id, case when r."end" <= 4500 then substring(bases, cast(r.start as int), cast(r."end" - r.start + 1 as int)) end as bases from regions r left join ref_seqs s using (contig)""")
def seq_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sq.region_sequences(view(spark, sf_dir, "regions"), view(spark, sf_dir, "ref_seqs"), 1000)


@query("""select region_id, case when region_id % 2 = 0 then coalesce(substring(bases, cast(r.start as int), cast(r."end" - r.start + 1 as int)), '') else '' end as bases from regions r left join ref_seqs s using (contig)""")
def seq_region_or_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    regions = view(spark, sf_dir, "regions").withColumn("contig", F.when(F.col("region_id") % 2 == 0, F.col("contig")).otherwise("unknown"))
    return sq.region_sequences(regions, view(spark, sf_dir, "ref_seqs"), 1000, complete=False)


@query("""select region_id, p as position, concat(p, ': ', substring(bases, cast(p as int), 1)) as text from (select region_id, contig, unnest(generate_series(start, least("end", 4500))) as p from regions) r join ref_seqs s using (contig)""")
def seq_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sq.base_listing(view(spark, sf_dir, "regions"), view(spark, sf_dir, "ref_seqs"), 1000)


@query("""select idx, concat('Variant: ', contig, ':', pos, ' ', ref, '>', alt, ' QUAL=', case when idx % 5 = 0 then '?' else cast(cast(qual as double) as varchar) end) as text, pos + length(ref) - 1 as variant_end from variants""")
def fmt_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = view(spark, sf_dir, "variants")
    qual = F.when(F.col("idx") % 5 != 0, F.col("qual").cast("double"))
    text = formats.describe_variant(F.col("contig"), F.col("pos"), F.col("ref"), F.split("alt", ","), qual)
    return v.select("idx", text.alias("text"), (F.col("pos") + F.length("ref") - 1).alias("variant_end"))


@query("""select idx, concat('BED interval: ', contig, ':', start0 + 1, '-', end0) as text from intervals""")
def fmt_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _intervals(spark, sf_dir).select("idx", formats.describe_interval(F.col("contig"), F.col("start"), F.col("end")).alias("text"))


@query("""select locus_id, n, case when n < 1000 then concat(n, 'bp') when n < 1000000 then concat(n // 1000, 'kb') when n < 1000000000 then concat(n // 1000000, 'Mb') when n < 1000000000000 then concat(n // 1000000000, 'Gb') else concat(n // 1000000000000, 'Tb') end as text
  from (select locus_id, cast(position * case locus_id % 5 when 0 then 1 when 1 then 1000 when 2 then 1000000 when 3 then 1000000000 else 10 end as bigint) as n from loci)""")
def fmt_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = F.col("locus_id") % 5
    n = F.col("position") * F.when(m == 0, 1).when(m == 1, 1000).when(m == 2, 1000000).when(m == 3, 1000000000).otherwise(10)
    return view(spark, sf_dir, "loci").select("locus_id", n.cast("long").alias("n"), formats.short_length(n.cast("long")).alias("text"))


@query("""select id, strand, case strand when '+' then '-' else '+' end as reversed, null::varchar as invalid from genes""")
def fmt_strands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "genes").select("id", fr.strand_of(F.col("strand")).alias("strand"), fr.reverse_strand(F.col("strand")).alias("reversed"), fr.strand_of(F.lit("?")).alias("invalid"))
