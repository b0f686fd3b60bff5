"""Queries on reads, segments and pileups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociframe.functions import reads as fr
from lociframe.operators import reads as r
from lociframe.plans.adapters import view
from lociframe.plans.registry import query


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.parsed(view(spark, sf_dir, "reads"))


def _pileup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.pileup(_parsed(spark, sf_dir), view(spark, sf_dir, "ref_seqs"))


@query(
    """select contig, pos, total, greatest(case when ref_base = 'A' then 0 else a end, case when ref_base = 'T' then 0 else t end, case when ref_base = 'C' then 0 else c end, case when ref_base = 'G' then 0 else g end) as max_alt
    from pileup where total >= 5 and 100 * greatest(case when ref_base = 'A' then 0 else a end, case when ref_base = 'T' then 0 else t end, case when ref_base = 'C' then 0 else c end, case when ref_base = 'G' then 0 else g end) > total"""
)
def flagship_alt_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pileup(spark, sf_dir).withColumn("max_alt", r.max_alt_depth())
    return p.where((F.col("total") >= 5) & (F.col("max_alt") * 100 > F.col("total"))).select("contig", "pos", "total", "max_alt")


@query("""select read_id, string_agg(concat(op, ':', len, ':', ref_start, ':', query_start), ',' order by i) as ops from ops group by read_id""")
def rd_cigar_ops(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.transform("ops", lambda o: F.concat_ws(":", o["op"], o["len"], o["ref_start"], o["query_start"]))
    return _parsed(spark, sf_dir).select("read_id", F.array_join(text, ",").alias("ops"))


@query("""select read_id, "end" as read_end, lead as leading, trail as trailing, s_start, s_end, flag & 1 <> 0 and flag & 2304 = 0 as pairable, s_start <= 2000 and s_end >= 1000 as in_window from spans""")
def rd_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    window = (F.col("s_start") <= 2000) & (F.col("s_end") >= 1000)
    return _parsed(spark, sf_dir).select("read_id", F.col("end").alias("read_end"), "leading", "trailing", "s_start", "s_end", fr.is_pairable(F.col("flag")).alias("pairable"), window.alias("in_window"))


@query(
    """with sites as (select *, start - 6 + read_id % 65 as p from spans)
    select a.read_id, p, (select any_value(b.base) from bases b where b.read_id = a.read_id and b.pos = p and not b.clip) as base,
      (p between start - lead and start - 1) or (p between "end" + 1 and "end" + trail) as softclip,
      exists (select 1 from ops o where o.read_id = a.read_id and o.op in ('D', 'N') and p between o.ref_start and o.ref_start + o.len - 1) as deletion,
      exists (select 1 from ops o where o.read_id = a.read_id and o.op = 'I' and o.ref_start = p) as insertion from sites a"""
)
def rd_at_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("start") - 6 + F.col("read_id") % 65
    return _parsed(spark, sf_dir).select(
        "read_id",
        p.alias("p"),
        fr.base_at(F.col("ops"), F.col("seq"), p).alias("base"),
        fr.is_softclip_at(F.col("start"), F.col("end"), F.col("leading"), F.col("trailing"), p).alias("softclip"),
        fr.is_deletion_at(F.col("ops"), p).alias("deletion"),
        fr.has_insertion_at(F.col("ops"), p).alias("insertion"),
    )


@query(
    """with q as (select read_id, start, read_id % 50 as q from reads)
    select q.read_id, q.q as query_pos, case when p >= 1 then p end as ref_pos from q left join (
      select read_id, query_start, len, case when op = 'I' then null when op = 'S' and query_start = 0 and ref_start = start then ref_start - query_start - len else ref_start - query_start end as base from ops where op in ('M', 'I', 'S', '=', 'X')) o
      on q.read_id = o.read_id and q.q between query_start and query_start + len - 1, lateral (select base + q.q as p)"""
)
def rd_query_to_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("read_id") % 50
    return _parsed(spark, sf_dir).select("read_id", q.alias("query_pos"), fr.reference_position(F.col("ops"), F.col("start"), q).alias("ref_pos"))


@query("""select read_id, concat(qname, '  Flags=', flag, '  MAPQ=', mapq, '  Cigar=', cigar) as text from reads""")
def rd_describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "reads").select("read_id", fr.describe_read(F.col("qname"), F.col("flag"), F.col("mapq"), F.col("cigar")).alias("text"))


@query("""select read_id, left(seq, 1) as a, lower(substring(seq, 2, 1)) as b, (left(seq, 1) = lower(substring(seq, 2, 1))) or (upper(left(seq, 1)) = upper(substring(seq, 2, 1)) and upper(left(seq, 1)) in ('A', 'C', 'G', 'T')) as same from reads""")
def rd_matches_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.left("seq", F.lit(1)), F.lower(F.substring("seq", 2, 1))
    return view(spark, sf_dir, "reads").select("read_id", a.alias("a"), b.alias("b"), fr.matches_base(a, b).alias("same"))


@query("""select read_id, seg_no, start as seg_start, "end" as seg_end, kind, base, insertion_len, arrow from segments""")
def seg_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.segments(_parsed(spark, sf_dir)).withColumnsRenamed({"start": "seg_start", "end": "seg_end"})


@query(
    """select b.read_id, b.pos, b.base from bases b join ref_seqs s using (contig) where (b.op = 'X') or (b.op = 'M' and b.pos between 1 and 4500
      and not (b.base = substring(s.bases, cast(b.pos as int), 1) or (upper(b.base) = upper(substring(s.bases, cast(b.pos as int), 1)) and upper(b.base) in ('A', 'C', 'G', 'T'))))"""
)
def seg_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.mismatches(_parsed(spark, sf_dir), view(spark, sf_dir, "ref_seqs"))


def _modified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.parsed(view(spark, sf_dir, "mods").withColumn("ml", F.array(F.lit(200), F.lit(80))))


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.base_modifications(_modified(spark, sf_dir))


# The calls that each text asks for, one by one: the canonical base, which of its occurrences from 0 on, the call's order and code.
_MODS = """with asked(mm, canonical, nth, call_order, code) as (values
  ('C+m,0,1;', 'C', 0, 0, 'm'), ('C+m,0,1;', 'C', 2, 1, 'm'), ('C+mh,1;', 'C', 1, 0, 'm'), ('C+mh,1;', 'C', 1, 1, 'h'),
  ('C+h,0;A+a,2,0;', 'C', 0, 0, 'h'), ('C+h,0;A+a,2,0;', 'A', 2, 1, 'a'), ('C+h,0;A+a,2,0;', 'A', 3, 2, 'a')),
letters as (select read_id, q, flag & 16 <> 0 as reverse, mm, case when flag & 16 <> 0 then translate(substring(seq, cast(q + 1 as int), 1), 'ACGT', 'TGCA') else substring(seq, cast(q + 1 as int), 1) end as letter
  from (select *, unnest(generate_series(0, length(seq) - 1)) as q from mods)),
occ as (select *, row_number() over (partition by read_id, letter order by case when reverse then -q else q end) - 1 as n from letters),
placed as (
  select c.read_id, c.mm, c.letter, c.n, case when o.op = 'S' and o.query_start = 0 and o.ref_start = o.start then o.ref_start - o.len + c.q else o.ref_start + c.q - o.query_start end as pos
  from occ c join ops o on o.read_id = c.read_id and o.op in ('M', '=', 'X', 'S') and c.q between o.query_start and o.query_start + o.len - 1),
calls as (
  select read_id, pos, call_order, code, case call_order when 0 then 200 when 1 then 80 else 255 end as probability
  from placed p join asked a on a.mm = p.mm and a.canonical = p.letter and a.nth = p.n where pos >= 1)
"""


@query(_MODS + "select * from calls")
def seg_base_modifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _calls(spark, sf_dir)


@query(
    _MODS
    + """select read_id, pos, code, probability, case when code = 'm' and probability >= 179 then '5mC high' when code = 'm' and probability >= 77 then '5mC medium' when code = 'm' then '5mC low' when code = 'h' then '5hmC' when code = 'a' then '6mA' else 'other' end as class
    from (select *, row_number() over (partition by read_id, pos order by probability desc, call_order) as r from calls) where r = 1"""
)
def seg_best_modification(spark: SparkSession, sf_dir: str) -> DataFrame:
    best = r.best_modifications(_calls(spark, sf_dir))
    return best.select("read_id", "pos", "code", "probability", fr.modification_class(F.col("code"), F.col("probability")).alias("class"))


@query(_MODS + """select c.read_id, pos, call_order, code, probability, min(seg_no) as seg_no from calls c join segments s on s.read_id = c.read_id and c.pos between s.start and s."end" group by all""")
def seg_attach_modifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.modifications_in_segments(_modified(spark, sf_dir))


@query("select contig, pos, a, t, c, g, n, total, softclip, ref_base from pileup")
def cov_pileup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pileup(spark, sf_dir)


@query(
    """with e as (select contig, ref_start as pos, 1 as d from ops join reads using (read_id) where op in ('M', '=', 'X') union all select contig, ref_start + len, -1 from ops join reads using (read_id) where op in ('M', '=', 'X'))
    select contig, pos, cast(sum(sum(d)) over (partition by contig order by pos) as bigint) as depth from e group by contig, pos"""
)
def cov_depth_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.depth_sweep(_parsed(spark, sf_dir))


@query("""select l.locus_id, coalesce(total, 0) as total, coalesce(softclip, 0) as softclip from loci l left join pileup p on l.contig = p.contig and l.position = p.pos""")
def cov_at_loci(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pileup(spark, sf_dir).select(F.col("contig").alias("_c"), "pos", "total", "softclip")
    joined = view(spark, sf_dir, "loci").join(p, (F.col("contig") == F.col("_c")) & (F.col("position") == F.col("pos")), "left")
    return joined.select("locus_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "softclip")])


@query("select contig, pos, a, t, c, g, n, total, softclip, ref_base from pileup")
def cov_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_group = r.pileup(_parsed(spark, sf_dir), view(spark, sf_dir, "ref_seqs"), group=["read_group"])
    return r.merge_pileups(by_group)


@query(
    """select r.region_id, concat('A:', coalesce(sum(a), 0), ', T:', coalesce(sum(t), 0), ', C:', coalesce(sum(c), 0), ', G:', coalesce(sum(g), 0), ', N:', coalesce(sum(n), 0), ', total:', coalesce(sum(total), 0)) as text
    from regions r left join pileup p on r.contig = p.contig and p.pos between r.start and r."end" group by r.region_id"""
)
def cov_region_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lociframe.operators.joins import overlap_join

    p = _pileup(spark, sf_dir).withColumns({"start": F.col("pos"), "end": F.col("pos")})
    regions = view(spark, sf_dir, "regions")
    hits = overlap_join(regions, p, bin_size=256, levels=1).groupBy("region_id").agg(*[F.sum(f"r_{x}").alias(x) for x in ("a", "t", "c", "g", "n", "total")])
    full = regions.select("region_id").join(hits, "region_id", "left")
    n = lambda x: F.coalesce(x, F.lit(0)).cast("string")
    text = F.concat(F.lit("A:"), n("a"), F.lit(", T:"), n("t"), F.lit(", C:"), n("c"), F.lit(", G:"), n("g"), F.lit(", N:"), n("n"), F.lit(", total:"), n("total"))
    return full.select("region_id", text.alias("text"))


@query(
    """select contig, pos, m as max_alt, case when m * 100 > total then m else 0 end as alt, total - case when m * 100 > total then m else 0 end as other
    from (select *, greatest(case when ref_base = 'A' then 0 else a end, case when ref_base = 'T' then 0 else t end, case when ref_base = 'C' then 0 else c end, case when ref_base = 'G' then 0 else g end) as m from pileup)"""
)
def cov_alt_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    alt, other = r.alt_split()
    return _pileup(spark, sf_dir).select("contig", "pos", r.max_alt_depth().alias("max_alt"), alt.alias("alt"), other.alias("other"))
