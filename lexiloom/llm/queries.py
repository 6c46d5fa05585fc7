"""The registered queries of this subpackage and their DuckDB counterparts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import audit, exact, extract, jaccard, langid, mixing, pieces, prefixes, quality, substring, suffix_tree, toxicity, warc

SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.round_trip(table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = """
with r as (
  select page_id, coalesce(html, '') as html from pages
), n as (
  select page_id, strlen(html)::bigint as payload_bytes, sha256(html) as payload_digest,
         row_number() over (partition by sha256(html) order by page_id nulls last) as k,
         first_value(page_id) over (partition by sha256(html) order by page_id nulls last) as first_id
  from r
)
select page_id, payload_bytes, payload_digest,
       case when payload_bytes >= 100 and k > 1 then 'revisit' else 'response' end as record_type,
       case when payload_bytes >= 100 and k > 1 then first_id end as refers_to
from n
"""


def op2_rlz_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring.remove(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


OP2_SQL = rf"""
with d as (
  select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') as ws from documents
), w as (
  select r, doc_id, i, md5(array_to_string(list_slice(ws, i, i + 49), ' ')) as g from d, unnest(range(1, len(ws) - 48)) as u(i)
), f as (
  select r, i, doc_id > min(doc_id) over (partition by g) as again from w
), p as (
  select r, list(distinct i + k) as gone from f, unnest(range(0, 50)) as v(k) where again group by r
)
select doc_id, len(ws)::bigint as n_words, coalesce(len(gone), 0)::bigint as n_removed,
       sha256(array_to_string(case when gone is null then ws else list_filter(ws, lambda x, i: not list_contains(gone, i)) end, ' ')) as kept_sha256
from d left join p on d.r = p.r
"""


def op3_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judged(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP3_SQL = rf"""
with d as (
  select row_number() over () as r, doc_id, coalesce(text, '') as text,
         regexp_extract_all(coalesce(text, ''), '{WORD}') as ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{WORD}')) as ls
  from documents
), g as (
  select r, i, list_slice(ws, i, i + 2) as g from d, unnest(range(1, len(ws) - 1)) as u(i)
), f as (
  select r, i, count(*) over (partition by r, g) as n from g
), p as (
  select r, count(distinct i + k)::bigint as n_repeat_words from f, unnest([0, 1, 2]) as v(k) where n > 1 group by r
), c as (
  select d.r, doc_id, text, len(ws)::bigint as n_words,
         length(regexp_replace(text, '{SPACE}', '', 'g'))::bigint as word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
         (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, len(ls) as n_lines,
         coalesce(n_repeat_words, 0)::bigint as n_repeat_words
  from d left join p on d.r = p.r
), b as (
  select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from c
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed
       and not 2 * (length(text) - length(regexp_replace(text, '[A-ZÀ-ÖØ-Þ]', '', 'g'))) > word_chars
       and not 4 * (length(text) - length(regexp_replace(text, '[0-9]', '', 'g'))) > word_chars
       and not 10 * (length(text) - length(regexp_replace(text, '[!?]', '', 'g'))) > 3 * n_words
       and not 10 * n_symbols > n_words
       and not 100 * n_dup_lines > 30 * n_lines
       and not word_chars < 2 * n_words
       and not word_chars > 15 * n_words as kept
from b
"""


def op4_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return mixing.replicate(docs).select("doc_id", "source", "copy", "n_copies", "text")


OP4_SQL = """
with s as (
  select source, sum(greatest(coalesce(length(text), 1), 1))::double as chars from documents group by source
), w as (
  select source, chars, pow(chars, 0.7) as weight from s
), r as (
  select source, round(weight / (select sum(weight) from w) * 1.0 * (select sum(chars) from w) / chars, 9) as rate from w
), k as (
  select source, rate, i, case when i = 0 then -exp(ln(rate)) else ln(rate) - ln(i::double) end as step
  from r, unnest(range(0, ceil(rate + 12 * sqrt(rate))::bigint + 41)) as u(i) where rate > 0
), p as (
  select source, i, exp(sum(step) over (partition by source order by i)) as p from k
), q as (
  select source, i, sum(p) over (partition by source order by i) as cdf from p
), d as (
  select doc_id, source, text,
         ('0x' || substr(md5('11|' || coalesce(doc_id::varchar, 'null')), 1, 13))::bigint::double / pow(16.0, 13) as u
  from documents
), n as (
  select doc_id, source, text, (select count(*) from q where q.source is not distinct from d.source and q.cdf <= d.u)::bigint as n_copies from d
)
select doc_id, source, copy::bigint as copy, n_copies, text from n, unnest(range(1, n_copies + 1)) as u(copy)
"""


def op5_patricia_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact.groups(table(spark, sf_dir, "documents"), carry=["doc_id"])
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP5_SQL = rf"""
with n as (
  select doc_id, length(coalesce(text, '')) as points, regexp_replace(coalesce(text, ''), '{SPACE}', '', 'g') as norm from documents
), g as (
  select *, first_value(doc_id) over z as keep_id, first_value(points) over z as keep_points, count(*) over (partition by norm) as group_size
  from n window z as (partition by norm order by points desc, doc_id nulls last)
)
select doc_id, keep_id, group_size::bigint as group_size,
       doc_id is not distinct from keep_id and points = keep_points as kept, sha256(norm) as text_sha256
from g
"""

def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = langid.identified(table(spark, sf_dir, "documents"))
    rest = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4))
    return out.select("doc_id", F.coalesce(rest == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.joined(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "n_links")


OP7_SQL = rf"""
with recursive d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') as ws from documents
), s as (
  select distinct doc_id, md5(array_to_string(list_slice(ws, i, i + 4), ' ')) as g
  from d, unnest(range(1, greatest(len(ws) - 3, 2))) as u(i) where len(ws) > 0
), n as (
  select doc_id, count(*) as n from s group by doc_id
), p as (
  select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2
), l as (
  select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 80 * (x.n + y.n - c)
), e as (
  select a, b from l union all select b, a from l
), r(doc_id, reached) as (
  select doc_id, doc_id from documents union select r.doc_id, e.b from r join e on e.a = r.reached
), m as (
  select doc_id, min(reached) as component_id from r group by doc_id
)
select d.doc_id, coalesce(n.n, 0)::bigint as n_shingles, m.component_id, coalesce(k.n_links, 0)::bigint as n_links
from d left join n using (doc_id) join m using (doc_id) left join (select a as doc_id, count(*) as n_links from e group by a) k using (doc_id)
"""


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pieces.encoded(table(spark, sf_dir, "documents"))
    digest = F.sha2(F.concat_ws(" ", F.col("ids").cast("array<string>")).cast("binary"), 256)
    return out.select("doc_id", "n_tokens", digest.alias("ids_sha256"), "round_trip")


def op10_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_tree.scores(table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefixes.trie(table(spark, sf_dir, "conversations"))


#: CRC-32 of a decimal id, bit by bit.
_CRC = """xor(4294967295::bigint, list_reduce(list_concat([4294967295::bigint], list_transform(string_split(c::varchar, ''), lambda x: ascii(x)::bigint)),
  lambda a, b: xor(a >> 8, list_reduce(list_concat([xor(a, b) & 255], [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]),
    lambda p, q: case when p & 1 = 1 then xor(3988292384::bigint, p >> 1) else p >> 1 end))))"""

OP11_SQL = f"""
with t as (
  select conv_id as c, coalesce(role, '') as role, coalesce(text, '') as text,
         row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), md5(coalesce(text, ''))) as pos
  from conversations where conv_id is not null
), s as (
  select c, c - c % 100 as g, max(pos) as n, {_CRC} % 6 as h from t group by c
), r as (
  select s.c, t.pos as d, role, text from s join t on t.c = s.g where t.pos <= s.h
  union all
  select s.c, t.pos - s.h + least(s.h, coalesce(z.n, 0)), role, text
  from s join t on t.c = s.c left join s z on z.c = s.g where t.pos > s.h
), p as (
  select c, d, text, md5(string_agg(md5(role) || md5(text), '') over (partition by c order by d)) as k from r
  union all select c, 0, '', '' from s
), q as (
  select *, lag(k) over (partition by c order by d) as up, max(d) over (partition by c) as len from p
), n as (
  select d, k, any_value(up) as up, count(*) as n_convs, min(c) as conv_id, max(length(text)) as points,
         sha256(coalesce(string_agg(c::varchar, ',' order by c) filter (where d = len), '')) as ends_sha256
  from q group by d, k
), m as (
  select n.*, coalesce(ch.n_children, 0) as n_children, x.conv_id as parent_conv_id
  from n left join (select d - 1 as d, up as k, count(*) as n_children from n where d > 0 group by 1, 2) ch on ch.d = n.d and ch.k = n.k
  left join n x on x.d = n.d - 1 and x.k = n.up
), b as (
  select q.d, q.k, sum((m.n_children = 0)::bigint) as n_leaves, sum((m.n_convs - 1) * m.points) as saved_tokens
  from m join q on q.c = m.conv_id and q.d <= m.d group by q.d, q.k
)
select m.conv_id, m.d::bigint as depth, m.parent_conv_id, m.n_convs, m.n_children, b.n_leaves::bigint as n_leaves, b.saved_tokens::bigint as saved_tokens, m.ends_sha256
from m join b on b.d = m.d and b.k = m.k
"""


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.interactions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP12_SQL = rf"""
with d as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '{WORD}') as ws,
         min(doc_id) over (partition by coalesce(text, '')) as first_id
  from documents
), l as (
  select doc_id, bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic from labels group by doc_id
), x as (
  select part, coalesce(good, false) as good, coalesce(toxic, false) as toxic,
         (len(ws) < 50)::int + 2 * (100 * len(list_distinct(ws)) < 65 * len(ws))::int
         + 4 * (100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 5 * length(text))::int
         + 8 * regexp_matches(text, '[#$%&*|]')::int + 16 * coalesce(d.doc_id > first_id, false)::int as mask
  from d left join l using (doc_id)
), c as (
  select part, mask, count(*) as n, count(*) filter (where good) as good, count(*) filter (where toxic) as toxic from x group by part, mask
), f as (
  select unnest(['A', 'B', 'C', 'D', 'E']) as f, unnest([1, 2, 4, 8, 16]) as bit
), o as (
  select a.f || b.f || c.f || d.f || e.f as filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] as bits
  from f a, f b, f c, f d, f e
  where a.bit + b.bit + c.bit + d.bit + e.bit = 31 and len(list_distinct([a.bit, b.bit, c.bit, d.bit, e.bit])) = 5
), s as (
  select filter_order, step, bits[step] as bit, coalesce(list_sum(bits[1:step - 1]), 0)::int as before from o, unnest([1, 2, 3, 4, 5]) as u(step)
)
select part, filter_order, step,
       coalesce(sum(n) filter (where mask & before = 0 and mask & bit = 0), 0)::bigint as kept,
       coalesce(sum(n) filter (where mask & before = 0 and mask & bit > 0), 0)::bigint as removed,
       coalesce(sum(n) filter (where mask & before > 0 and mask & bit > 0), 0)::bigint as redundant,
       coalesce(sum(n) filter (where mask = bit), 0)::bigint as unique_fails,
       coalesce(sum(good) filter (where mask & before = 0 and mask & bit > 0), 0)::bigint as good_lost,
       coalesce(sum(toxic) filter (where mask & before = 0 and mask & bit > 0), 0)::bigint as toxic_lost,
       coalesce(sum(n * 120 // greatest(bit_count(mask), 1)) filter (where mask & bit > 0), 0)::bigint as shapley
from c, s group by part, filter_order, step
"""


def op13_line_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.extracted(table(spark, sf_dir, "pages"))


Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {f.__name__: f for f in (op1_warc_revisits, op2_rlz_substrings, op3_quality_cascade, op4_poisson_mixing, op5_patricia_dedup, op6_language_id, op7_jaccard_join, op8_toxicity, op9_sentencepiece, op10_suffix_tree, op11_prefix_trie, op12_filter_audit, op13_line_blocks)}
ORACLES: dict[str, str] = {"op1_warc_revisits": OP1_SQL, "op2_rlz_substrings": OP2_SQL, "op3_quality_cascade": OP3_SQL, "op4_poisson_mixing": OP4_SQL, "op5_patricia_dedup": OP5_SQL, "op7_jaccard_join": OP7_SQL, "op11_prefix_trie": OP11_SQL, "op12_filter_audit": OP12_SQL}
