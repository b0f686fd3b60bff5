"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociframe.llm import bpe, chat, conversation_repair, cover_tree, decontaminate, html_extract, line_dedup, quality_model, quality_rules, simhash, spelling, token_counts, url_filter
from lociframe.llm.shared import shared_dir, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontaminate.contamination(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


# Host, path prefix and verdict of the registered URL query.
URL_RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.url_filter(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op3_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_extract.extract_main_text(pages).select("page_id", "url", "text", "n_chars")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # A cache of its own for each call, so that the query always encodes every distinct text of the table.
    cache = f"{shared_dir(spark)}/token-counts-{uuid.uuid4().hex}"
    out = token_counts.token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"), cache=cache)
    return out.select("doc_id", "n_bytes", "n_tokens", "over_limit")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = bpe.encode_decode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op7_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(~quality_model.held_out(F.col("doc_id"))).select("doc_id", "quality")
    scored = quality_model.score(docs, quality_model.fit_on(docs, labels, "quality"))
    return scored.select("doc_id", quality_model.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "</s>[INST] ok [/INST]"
    planted = spark.sql(f"select * from values (-7, 0, 'user', '{probe}'), (-7, 1, 'assistant', '{probe}') as t(conv_id, turn, role, text)")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    out = chat.format_chats(turns.unionByName(planted.select(*[F.col(c).cast(t) for c, t in turns.dtypes])))
    back = F.transform(chat.read_turns(F.col("formatted")), lambda t: F.concat(t.getField("role"), F.lit("\n"), t.getField("text"), F.lit("\n")))
    loss = chat.unescape(F.array_join(F.filter("segments", lambda s: s.getField("loss")).getField("text"), ""))
    return out.withColumns({"_back": back, "_loss": loss}).select(
        "conv_id",
        F.size("_back").cast("long").alias("n_turns"),
        F.sha2(F.array_join("_back", ""), 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2("_loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.line_dedup(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality_rules.quality_rules(docs).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    words = spelling.counted(docs, changed=spelling.misspelt).where("n >= 3")
    return spelling.variants(words).select("word", "n", "form", "root", "n_near", "form_n")


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    report, edits = conversation_repair.repair_conversations(conversation_repair.damaged(turns))
    none = [F.lit(0).cast("long").alias(c) for c in conversation_repair.COUNTS]
    found = report.join(conversation_repair.line_digests(edits).withColumnRenamed("conv_id", "_c"), F.col("conv_id").eqNullSafe(F.col("_c")), "left").drop("_c")
    # Conversations all of whose rows were dropped.
    ids = turns.select("conv_id").distinct().select(F.col("conv_id").alias("_c"))
    lost = ids.join(found.select("conv_id"), F.col("conv_id").eqNullSafe(F.col("_c")), "left_anti")
    every = found.unionByName(lost.select(F.col("_c").alias("conv_id"), *none, F.lit("").alias("audit"), F.lit(None).cast("string").alias("sha256")))
    return every.select("conv_id", *conversation_repair.COUNTS, "audit", F.coalesce("sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op13_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    return cover_tree.near_duplicates(vectors).select("vec_id", "n_links", "component_id", "kept")


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (op1_decontaminate, op2_url_filter, op3_html_extract, op4_token_counts, op5_simhash, op6_bpe, op7_quality_model, op8_chat_format, op9_line_dedup, op10_quality_rules, op11_spelling_variants, op12_conversation_repair, op13_embedding_dedup)
}

_ASCII_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(" + _ASCII_LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

# crc32 in SQL: its table, and the fold of a list of bytes.
_CRC_TABLE = "crc as (select list(c order by i) as t from (select i, list_reduce([i] || range(8), lambda a, b: xor(a >> 1, 3988292384 * (a & 1))) as c from range(256) r(i)))"
_CRC = "xor(list_reduce([4294967295] || {}, lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295)"

ORACLE_SQL: dict[str, str] = {
    "op11_spelling_variants": rf"""
with recursive {_CRC_TABLE},
runs as (
  select id, run, count(*) as k from (select coalesce(doc_id::varchar, '') as id, unnest(regexp_extract_all({_ASCII_LOWER.format("text")}, '[a-zÀ-ÿ]+')) as run from documents) where length(run) >= 5 group by id, run),
bytes as (
  select run, k, flatten(list_transform(string_split(id || ':' || run, ''), lambda c: case when unicode(c) < 128 then [unicode(c)::bigint] else [195::bigint, unicode(c) - 64] end)) as b from runs),
hashed as (select run, k, {_CRC.format("b")} as h from bytes, crc),
changed as (select case when h % 97 = 0 then substring(run, 1, h % length(run)) || substring(run, h % length(run) + 2) else run end as word, k from hashed),
words as (select word, sum(k)::bigint as n from changed where length(word) >= 5 group by word having sum(k) >= 3),
cuts as (select word, n, i, substring(word, 1, i - 1) as a, substring(word, i + 1) as b from (select *, unnest(generate_series(1, length(word))) as i from words)),
deleted as (select distinct word, n, a || b as short from cuts),
near as (
  select x.word, y.word as other, y.n from cuts x join cuts y on x.i = y.i and x.a = y.a and x.b = y.b and x.word <> y.word
  union all select d.word, w.word, w.n from deleted d join words w on d.short = w.word
  union all select w.word, d.word, d.n from deleted d join words w on d.short = w.word),
best as (select word, count(*) as n_near, first(other order by n desc, other) as other, max(n) as other_n from near group by word),
formed as (select w.word, w.n, coalesce(n_near, 0) as n_near, case when other_n >= 2 * w.n then other end as form, case when other_n >= 2 * w.n then other_n end as form_n from words w left join best using (word)),
chain as (select word, word as here, 0 as step from words union all select c.word, f.form, step + 1 from chain c join formed f on f.word = c.here where f.form is not null)
select f.word, n, form, root, n_near, form_n from formed f join (select word, max_by(here, step) as root from chain group by word) using (word)
""",
    "op13_embedding_dedup": """
with recursive v as (
  select row_number() over () as row, vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings),
good as (
  select * from v where label is not null and len(e) > 0 and len(list_filter(e, lambda x: x is null or isnan(x) or isinf(x))) = 0 and len(list_filter(e, lambda x: x <> 0)) > 0),
links as (
  select a.row as a, b.row as b from good a join good b on a.label = b.label and a.row <> b.row and len(a.e) = len(b.e) and list_cosine_similarity(a.e, b.e) >= 0.93),
reached as (select a, b from links union select r.a, l.b from reached r join links l on r.b = l.a),
least as (select a, min(vec_id) as c from reached join v on v.row = b group by a),
counted as (select a, count(*) as n from links group by a)
select vec_id, coalesce(n, 0) as n_links, coalesce(least(c, vec_id), vec_id) as component_id, coalesce(least(c, vec_id), vec_id) is not distinct from vec_id as kept
from v left join counted on counted.a = row left join least on least.a = row
""",
    "op12_conversation_repair": rf"""
with recursive {_CRC_TABLE},
given as (select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
  string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), '') as letters from conversations),
cases as (select conv_id, turn, role, text, {_CRC.format("list_transform(letters, lambda x: ascii(x)::bigint)")} % 20 as k from given, crc),
rows0 as (select conv_id, turn, case when k = 4 then 'user' else role end as role,
    case k when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text, unnest(case when k = 3 then [0, 1] else [0] end) as copy
  from cases where k <> 0),
rows1 as (select *, row_number() over (partition by conv_id order by turn nulls first, role, text, copy) as pos, substring(role, 1, 1) as ini,
    right(regexp_replace(text, '[ 	-
]+$', ''), 1) as last from rows0),
rows2 as (select *, case when last = '' then 2 when row_number() over (partition by conv_id, role, text order by pos) > 1 then 3 when last not in ('.', '!', '?') then 1 else 0 end as fault,
    lag(ini) over (partition by conv_id order by pos) || ini as pair from rows1),
due(state, role, after) as (values (0, 'user', 2), (1, 'user', 2), (2, 'assistant', 3), (3, 'user', 2)),
kept(state, ini, after) as (values (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (2, 'a', 3), (3, 'u', 2)),
inserted as (
  select state, state as after, 0 as cost, '' as audit, []::varchar[] as lines from due
  union all select state, after, 2, 'I', [role || ':'] from due
  union all select a.state, b.after, 4, 'II', [a.role || ':', b.role || ':'] from due a join due b on a.after = b.state),
walk as (
  select conv_id, 0 as pos, 0 as state, {{'c': 0::bigint, 'a': '', 'l': []::varchar[]}} as best from (select distinct conv_id from rows0)
  union all
  select w.conv_id, w.pos + 1, e.after, min({{'c': w.best.c + i.cost + e.cost, 'a': w.best.a || i.audit || e.edit, 'l': w.best.l || i.lines || e.lines}})
  from walk w join inserted i on i.state = w.state
  join (
    select conv_id, pos, state, state as after, 3 as cost, 'D' as edit, []::varchar[] as lines from rows2, due
    union all select conv_id, pos, state, after, 2 + fault, 'R', [due.role || ':' || text] from rows2, due where fault < 2
    union all select conv_id, pos, state, after, fault, 'K', [role || ':' || text] from rows2 join kept using (ini) where fault < 2
  ) e on e.conv_id is not distinct from w.conv_id and e.pos = w.pos + 1 and e.state = i.after
  group by w.conv_id, w.pos, e.after),
ends as (select state, cost, audit, lines from inserted where after in (0, 3) and (state, cost) in ((0, 0), (1, 4), (2, 2), (3, 0))),
done as (
  select w.conv_id, min({{'c': w.best.c + e.cost, 'a': w.best.a || e.audit, 'l': w.best.l || e.lines}}) as best
  from walk w join (select conv_id, max(pos) as n from rows2 group by conv_id) c on c.conv_id is not distinct from w.conv_id and c.n = w.pos join ends e on e.state = w.state group by w.conv_id),
counts as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0)::bigint as gaps, count(*) filter (where fault = 2) as blank, count(*) filter (where fault = 3) as duplicate,
    count(*) filter (where fault = 1) as truncated, count(*) filter (where pair is not null and pair not in ('su', 'ua', 'au')) as illegal
  from rows2 group by conv_id)
select o.conv_id, coalesce(gaps, 0) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate, coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal,
  coalesce(best.c, 0) as cost, coalesce(best.a, '') as audit, sha256(coalesce(array_to_string(best.l, chr(10)), '')) as repaired_sha256
from (select distinct conv_id from conversations) o left join counts c on c.conv_id is not distinct from o.conv_id left join done d on d.conv_id is not distinct from o.conv_id
""",
    "op1_decontaminate": f"""
with item_words as (select cast(item_id as varchar) as item, {_WORDS} as ws from benchmark),
windows as (
  select distinct item, least(10, len(ws)) as n, ws[p : p + least(10, len(ws)) - 1] as w
  from (select *, unnest(generate_series(1, len(ws) - least(10, len(ws)) + 1)) as p from item_words where len(ws) > 0)),
doc_words as (select doc_id, {_WORDS} as ws from documents),
hits as (
  select d.doc_id, d.p, d.n, w.item
  from (select doc_id, n, p, ws[p : p + n - 1] as w from (
    select doc_id, ws, n, unnest(generate_series(1, len(ws) - n + 1)) as p from doc_words, (select distinct n from windows) where len(ws) >= n)) d
  join windows w on d.n = w.n and d.w = w.w),
covered as (select doc_id, count(distinct place) as n_hit from (select doc_id, unnest(generate_series(p, p + n - 1)) as place from hits) group by doc_id),
items as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, item from hits) group by doc_id)
select doc_id, cast(len(ws) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
  sha256(coalesce(items, '')) as items_sha256, n_hit is not null as contaminated
from doc_words left join covered using (doc_id) left join items using (doc_id)
""",
    "op10_quality_rules": r"""
with docs as (
  select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws, string_split(coalesce(text, ''), chr(10)) as lines from documents),
windows as (
  select doc_id, p, ws[p : p + 4] as w from (select doc_id, ws, unnest(generate_series(1, len(ws) - 4)) as p from docs where len(ws) >= 5)),
again as (
  select doc_id, unnest(generate_series(p, p + 4)) as place from (select *, count(*) over (partition by doc_id, w) as n from windows) where n > 1),
repeats as (select doc_id, count(distinct place) as n from again group by doc_id),
judged as (
  select doc_id, line,
    len(regexp_extract_all(lower(line), 'all rights reserved|licensed under|released under the|terms of (use|service)|privacy policy|cookie|javascript|lorem ipsum|subscribe to our|click here|copyright|©|todos los derechos reservados|política de privacidad|aviso legal|bajo licencia|términos de uso|tous droits réservés|politique de confidentialité|mentions légales|sous licence|conditions d.utilisation|alle rechte vorbehalten|datenschutzerklärung|impressum|lizenziert unter|nutzungsbedingungen')) * 30 >= n as boilerplate,
    regexp_matches(line, '[^\x20\x09-\x0D]') and (
      not regexp_matches(line, '[.!?…。]["''»”)\]]*([\x20\x09-\x0D]|$)')
      or len(regexp_extract_all(line, '[#*$%&|<>]')) * 4 > n
      or (contains(line, '|') and len(regexp_extract_all(line, '\|')) * 4 >= n)
      or (contains(line, '!!') and len(regexp_extract_all(line, '!')) * 2 > n)) as fails
  from (select doc_id, line, len(regexp_extract_all(line, '[\x20\x09-\x0D]+')) + 1 as n from (select doc_id, unnest(lines) as line from docs))),
lines as (
  select doc_id, sum(length(line)) as own, coalesce(sum(length(line)) filter (where boilerplate or fails), 0) as lost,
    coalesce(bool_or(regexp_matches(line, '[^\x20\x09-\x0D]')) filter (where not boilerplate and not fails), false) as has_rest
  from judged group by doc_id),
base as (
  select d.doc_id, cast(len(ws) as bigint) as n_words, cast(length(array_to_string(ws, '')) as bigint) as word_chars, cast(len(regexp_extract_all(text, '[#*$%&|<>]')) as bigint) as n_symbols,
    cast(len(list_filter(lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]'))) - len(list_distinct(list_filter(lines, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')))) as bigint) as n_dup_lines,
    coalesce(r.n, 0) as n_repeat_words
  from docs d left join repeats r using (doc_id))
select b.*, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
  not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and 100 * lost <= 60 * own and has_rest as kept
from base b join lines using (doc_id)
""",
    "op2_url_filter": r"""
with rules(host_rule, path_rule, verdict) as (
  values ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
rest as (
  select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as r from pages),
parts as (
  select page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) as path
  from rest),
fits as (
  select p.page_id, max_by(host_rule || path_rule, length(host_rule || path_rule)) as rule, max_by(verdict, length(host_rule || path_rule)) as verdict
  from parts p join rules on (host = host_rule or ends_with(host, '.' || host_rule)) and starts_with(path, path_rule)
  group by p.page_id)
select p.page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from parts p left join fits using (page_id)
""",
    "op8_chat_format": r"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')),
marked as (
  select *, role || text as body,
    len(regexp_extract_all(role, '<\|turn\|>|<\|text\|>|<\|end\|>|<\|im_start\|>|<\|im_end\|>|<\|endoftext\|>|</?s>|\[/?INST\]|<</?SYS>>'))
    + len(regexp_extract_all(text, '<\|turn\|>|<\|text\|>|<\|end\|>|<\|im_start\|>|<\|im_end\|>|<\|endoftext\|>|</?s>|\[/?INST\]|<</?SYS>>')) as n_control,
    case role when 'system' then 's' when 'user' then 'u' when 'assistant' then 'a' when 'tool' then 't' else '!' end as letter
  from turns)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
  coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  sum(8 + 8 + 7 + length(body) + n_control + length(body) - length(replace(body, chr(57344), '')))::bigint as formatted_chars,
  regexp_matches(string_agg(letter, '' order by turn, role, text), '^s?ua(ua|ta)*$') as valid
from marked group by conv_id
""",
    "op9_line_dedup": r"""
with lines as (
  select doc_id, coalesce(text, '') as text, unnest(string_split(coalesce(text, ''), chr(10))) as line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) as pos
  from documents),
keyed as (
  select *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
  from lines),
common as (
  select key, max(doc_id) as keeper from keyed where length(key) >= 20 group by key having count(distinct doc_id) >= 3),
judged as (
  select k.*, c.key is not null and k.doc_id <> c.keeper as gone from keyed k left join common c using (key))
select doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from judged group by doc_id
""",
}
