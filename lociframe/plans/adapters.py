"""Genomic views over the test tables, in SQL that Spark and DuckDB both read.

Each view is one SELECT over tables and earlier views; ``view`` gives it as a DataFrame, ``with_views`` as the
WITH clause of an oracle.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("nation", "lineitem", "part", "orders", "events", "customer")
PATTERN = "ACGTTGCAGACGGTCATTGACCAGTACATGCATTG"  # repeated, it makes the reference sequences


def _contig(i: str) -> str:
    return f"case when {i} < 22 then concat('chr', cast({i} + 1 as string)) when {i} = 22 then 'chrX' when {i} = 23 then 'chrY' else 'chrM' end"


VIEWS = {
    "contigs": f"""select cast(n_nationkey as bigint) as contig_index, {_contig('n_nationkey')} as name, cast(4500 as bigint) as length from nation""",
    "reads": f"""select (((cast(l_orderkey as bigint) * 8 + l_linenumber) * 100000 + l_partkey) * 10000 + l_suppkey) * 64 + cast(l_quantity as bigint) as read_id,
      concat('r', cast(l_orderkey as string)) as qname, {_contig('(l_orderkey % 25)')} as contig,
      cast(1 + (l_orderkey * 131 + l_linenumber * 17 + l_partkey % 40) % 4000 as bigint) as start,
      case l_linenumber when 1 then '50M' when 2 then '5S45M' when 3 then '20M3D30M' when 4 then '20M4I26M' when 5 then '40M10S' when 6 then '15M100N20=5X10M' else '3H4S20M2I10M1P14M' end as cigar,
      substring(repeat('ACGTTGCANACGGTCATTGACCAGTNCATG', 3), cast(1 + l_partkey % 30 as int), 50) as seq,
      cast(1 + (case when l_returnflag = 'R' then 16 else 0 end) + (case when l_linestatus = 'F' then 64 else 128 end) + (case when l_linenumber = 7 then 2048 else 0 end) + (case when l_quantity = 50 then 256 else 0 end) as int) as flag,
      cast(l_quantity as int) as mapq, concat('RG', cast(l_suppkey % 4 as string)) as read_group, cast(l_linenumber as int) as line
      from lineitem""",
    "ref_seqs": f"""select {_contig('n_nationkey')} as contig, substring(repeat('{PATTERN}', 132), cast(1 + (1 + n_nationkey) % 35 as int), 4500) as bases from nation""",
    "genes": f"""select cast(p_partkey as bigint) as id, concat('NM_', cast(p_partkey as string)) as name, concat('GENE', cast(p_partkey as string)) as name2, {_contig('(p_partkey % 25)')} as contig,
      case when p_size % 2 = 0 then '+' else '-' end as strand,
      cast((p_partkey * 211) % 3800 as bigint) as tx0, cast((p_partkey * 211) % 3800 + 60 * (p_size % 3) + 30 as bigint) as tx_end,
      cast((p_partkey * 211) % 3800 + p_size % 20 as bigint) as cds0, cast((p_partkey * 211) % 3800 + 60 * (p_size % 3) + 30 - p_size % 7 as bigint) as cds_end,
      concat(cast((p_partkey * 211) % 3800 as string), ',', case when p_size % 3 > 0 then concat(cast((p_partkey * 211) % 3800 + 60 as string), ',') else '' end, case when p_size % 3 > 1 then concat(cast((p_partkey * 211) % 3800 + 120 as string), ',') else '' end) as exon_starts_text,
      concat(cast((p_partkey * 211) % 3800 + 30 as string), ',', case when p_size % 3 > 0 then concat(cast((p_partkey * 211) % 3800 + 90 as string), ',') else '' end, case when p_size % 3 > 1 then concat(cast((p_partkey * 211) % 3800 + 150 as string), ',') else '' end) as exon_ends_text
      from part""",
    "variants": f"""select cast(o_orderkey as bigint) as idx, {_contig('(o_orderkey % 25)')} as contig, cast(1 + (o_custkey * 97) % 4000 as bigint) as pos,
      case o_orderstatus when 'P' then 'A' when 'O' then 'CT' else 'G' end as ref, case when o_orderkey % 3 = 0 then 'T,C' else 'C' end as alt, cast(o_totalprice as decimal(18, 2)) as qual from orders""",
    "intervals": f"""select cast(event_id as bigint) as idx, {_contig('(user_id % 25)')} as contig, cast((event_id * 29) % 3900 as bigint) as start0, cast((event_id * 29) % 3900 + 10 + event_id % 90 as bigint) as end0 from events""",
    "loci": f"""select cast(c_custkey as bigint) as locus_id, {_contig('(c_custkey % 25)')} as contig, cast(1 + (c_custkey * 53) % 4000 as bigint) as position, cast(20 + c_custkey % 180 as bigint) as half_width from customer""",
    "regions": """select locus_id as region_id, contig, greatest(1, position - half_width) as start, position + half_width as "end" from loci""",
    "aliases": f"""select case when n_nationkey < 22 then cast(n_nationkey + 1 as string) when n_nationkey = 22 then 'X' when n_nationkey = 23 then 'Y' else 'M' end as alias, {_contig('n_nationkey')} as chrom from nation
      union all select concat('NC_', cast(n_nationkey as string)) as alias, {_contig('n_nationkey')} as chrom from nation""",
    "cytobands": "\nunion all\n".join(
        f"select {_contig('n_nationkey')} as chrom, cast({500 * b} as bigint) as chromStart, cast({500 * (b + 1)} as bigint) as chromEnd, 'b{b}' as name, '{s}' as gieStain from nation"
        for b, s in enumerate(("gneg", "gpos25", "gpos50", "acen", "acen", "gpos75", "gvar", "stalk", "gpos100"))
    ),
    "mods": """select *, case cast(mapq as bigint) % 3 when 0 then 'C+m,0,1;' when 1 then 'C+mh,1;' else 'C+h,0;A+a,2,0;' end as mm from reads""",
}


def _needs(sql: str) -> list[str]:
    return [v for v in VIEWS if re.search(rf"\b(from|join)\s+{v}\b", sql)]


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sql = VIEWS[name]
    parts = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if re.search(rf"\bfrom {t}\b", sql)}
    parts |= {v: view(spark, sf_dir, v) for v in _needs(sql)}
    for part in parts:
        sql = re.sub(rf"\bfrom {part}\b", f"from {{{part}}}", sql)
    return spark.sql(sql.replace('"end"', "`end`"), **parts)


# Further views of oracles only: parsed CIGARs, and one row per aligned or clipped base.
ORACLE_VIEWS = {
    "tokens": "select read_id, start, unnest(regexp_extract_all(cigar, '[0-9]+[MIDNSHP=X]')) as token, generate_subscripts(regexp_extract_all(cigar, '[0-9]+[MIDNSHP=X]'), 1) as i from reads",
    "ops0": "select read_id, start, i, right(token, 1) as op, cast(left(token, length(token) - 1) as bigint) as len from tokens",
    "ops": """select *, start + coalesce(sum(case when op in ('M', 'D', 'N', '=', 'X') then len else 0 end) over w, 0)::bigint as ref_start,
      coalesce(sum(case when op in ('M', 'I', 'S', '=', 'X') then len else 0 end) over w, 0)::bigint as query_start
      from ops0 window w as (partition by read_id order by i rows between unbounded preceding and 1 preceding)""",
    "spans": """select r.*, b.lead, b.trail, r.start + greatest(b.span - 1, 0) as "end", greatest(r.start - b.lead, 1) as s_start, r.start + greatest(b.span - 1, 0) + b.trail as s_end
      from reads r join (select read_id,
        sum(case when op in ('M', 'D', 'N', '=', 'X') then len else 0 end)::bigint as span,
        sum(case when op = 'S' and query_start = 0 and ref_start = start then len else 0 end)::bigint as lead,
        sum(case when op = 'S' and not (query_start = 0 and ref_start = start) then len else 0 end)::bigint as trail from ops group by read_id) b using (read_id)""",
    "bases": """select o.read_id, r.contig, o.op, case when o.op = 'S' and o.query_start = 0 and o.ref_start = o.start then o.ref_start - o.len + k else o.ref_start + k end as pos,
      substring(r.seq, cast(o.query_start + k + 1 as int), 1) as base, o.op = 'S' as clip, o.op = 'S' and o.query_start = 0 and o.ref_start = o.start as is_lead
      from (select *, unnest(generate_series(0, len - 1)) as k from ops where op in ('M', '=', 'X', 'S')) o join reads r using (read_id)""",
    "pileup0": """select contig, pos, count(*) filter (where not clip and base = 'A') as a, count(*) filter (where not clip and base = 'T') as t, count(*) filter (where not clip and base = 'C') as c,
      count(*) filter (where not clip and base = 'G') as g, count(*) filter (where not clip and base not in ('A', 'T', 'C', 'G')) as n, count(*) filter (where not clip) as total, count(*) filter (where clip) as softclip
      from bases where not (is_lead and pos < 2) group by contig, pos""",
    "pileup": """select p.*, coalesce(nullif(substring(s.bases, cast(pos as int), 1), ''), 'N') as ref_base from pileup0 p left join ref_seqs s on p.contig = s.contig and p.pos between 1 and 4500""",
    "exons": """select id, contig, strand, i, cast(s as bigint) + 1 as start, cast(e as bigint) as "end" from (
      select id, contig, strand, unnest(string_split(rtrim(exon_starts_text, ','), ',')) as s, unnest(string_split(rtrim(exon_ends_text, ','), ',')) as e, generate_subscripts(string_split(rtrim(exon_starts_text, ','), ','), 1) as i from genes)""",
    "segments0": """select o.*, r.contig, r.seq, r.flag, (select p.len from ops p where p.read_id = o.read_id and p.i < o.i and p.op = 'I'
        and not exists (select 1 from ops m where m.read_id = o.read_id and m.i > p.i and m.i < o.i and m.op not in ('I', 'P', 'H')) order by p.i desc limit 1) as carried
      from ops o join reads r using (read_id) where o.op not in ('I', 'H', 'P')""",
    "segments1": """select read_id, i, 0 as k, ref_start as start, ref_start + len - 1 as "end", case when op in ('D', 'N') then 'Deletion' else 'Match' end as kind, null as base, carried as insertion_len, flag from segments0 where op <> 'S'
      union all select read_id, i, k, p as start, p as "end", 'SoftClip' as kind, substring(seq, cast(query_start + k + 1 as int), 1) as base, case when k = 0 then carried end as insertion_len, flag
      from (select *, case when query_start = 0 and ref_start = start then ref_start - len + k else ref_start + k end as p from (select *, unnest(generate_series(0, len - 1)) as k from segments0 where op = 'S'))
      where not (query_start = 0 and ref_start = start and p < 2)""",
    "segments": """select read_id, cast(row_number() over (partition by read_id order by i, k) as int) as seg_no, start, "end", kind, base, cast(insertion_len as int) as insertion_len,
      case when flag & 16 <> 0 and row_number() over (partition by read_id order by i, k) = 1 then 'Reverse' when flag & 16 = 0 and row_number() over (partition by read_id order by i desc, k desc) = 1 then 'Forward' end as arrow from segments1""",
}


def with_views(sql: str) -> str:
    """``sql`` behind the WITH clause of all views that it uses."""
    every = VIEWS | ORACLE_VIEWS
    wanted: list[str] = []

    def add(text: str) -> None:
        for v in every:
            if v not in wanted and re.search(rf"\b(from|join)\s+{v}\b", text, re.IGNORECASE):
                add(every[v])
                if v not in wanted:
                    wanted.append(v)

    add(sql)
    sql = sql.strip()
    views = ",\n".join(f"{v} as ({every[v]})" for v in wanted)
    for start in ("with recursive ", "with "):
        if sql.startswith(start):
            return f"{start}{views},\n{sql.removeprefix(start)}" if views else sql
    return f"with {views}\n{sql}" if views else sql
