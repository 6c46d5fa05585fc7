"""Registered queries over channels, events, generators, transliterations, conversations and pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import stage
from ..functions import fixed, words
from ..operators import battery as battery_
from ..operators import generators, layout, lexical, nulls, pairs, signals
from ..sources import plain, tables, transliteration
from ..streaming import counts
from . import glyph  # noqa: F401  profiles are composed of its SQL too
from .base import ORACLES, TOK, VOC, mutual, query, r, sql
from .text import _CV_CLASS, _CV_GRAMMAR, _ROLE_RF, _cv, _tv_round, _z

docs = tables.documents

# ---- binary channels: which of two letters a writer chose ----

_BITS = """
gl as (select corpus, page, pos, i, w[i] as g, case when i = 1 then '<s>' else w[i - 1] end as prev from tok, unnest(range(1, length(w) + 1)) as u(i)),
ch as (
  select corpus, page, pos, i, prev, case when g in ('c', 's') then 'c/s' else 'k/t' end as channel, (g in ('s', 't'))::int as bit from gl where g in ('c', 's', 'k', 't')
)"""


def bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(corpus, page, pos, gi, prev, channel, bit) of two letter choices in documents."""
    each = docs(spark, sf_dir).select("corpus", "page", "pos", F.split("w", "").alias("gs"))
    each = each.select("corpus", "page", "pos", F.posexplode("gs").alias("gi", "g"), "gs").withColumn("prev", F.coalesce(F.get("gs", F.col("gi") - 1), F.lit("<s>"))).drop("gs")
    each = each.where(F.col("g").isin("c", "s", "k", "t"))
    return each.select("corpus", "page", "pos", "gi", "prev", F.when(F.col("g").isin("c", "s"), "c/s").otherwise("k/t").alias("channel"), F.col("g").isin("s", "t").cast("int").alias("bit"))


def _hb(p: str) -> str:
    return f"(case when {p} <= 0 or {p} >= 1 then 0 else -({p} * log2({p}) + (1 - {p}) * log2(1 - {p})) end)"


@query(sql(_BITS, "a as (select channel, count(*) as n, avg(bit) as p from ch group by channel)", select=f"select channel, n, {r('p')} as p, {r('n * ' + _hb('p'))} as capacity_bits from a"))
def channel_capacity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.capacity(bits(spark, sf_dir))


@query(sql(_BITS, "p as (select channel, page, count(*) as m, sum(bit) as ones from ch group by all)", "q as (select *, (sum(ones) over (partition by channel))::double / sum(m) over (partition by channel) as p from p)", "s as (select channel, count(*) as n_pages, sum(pow(ones - m * p, 2) / nullif(m * p * (1 - p), 0)) as chi, count(*) - 1 as df from q where m >= 10 group by channel)", select=f"select channel, n_pages, {r('chi / nullif(df, 0)')} as vif, {r('(chi - df) / sqrt(2 * nullif(df, 0))')} as z from s"))
def channel_vif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.overdispersion(bits(spark, sf_dir))


@query(sql(_BITS, "s as (select channel, bit, lag(bit) over (partition by channel, page order by pos, i) as pb, avg(bit) over (partition by channel) as p from ch)", "q as (select channel, count(*) as n, avg((bit = pb)::int) as same, any_value(p * p + (1 - p) * (1 - p)) as e from s where pb is not null group by channel)", select=f"select channel, n, {r('same')} as same, {r('e')} as expected, {r('(same - e) / nullif(sqrt(e * (1 - e) / n), 0)')} as z from q"))
def channel_stickiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.stickiness(bits(spark, sf_dir), ("pos", "gi"))


@query(sql(_BITS, "g as (select channel, corpus, prev, count(*) as m, sum(bit)::double as ones from ch group by all)", "o as (select *, sum(ones) over (partition by channel) / sum(m) over (partition by channel) as p from g)", f"h as (select channel, m, case when m < 5 then {_hb('p')} else {_hb('(ones / m)')} end as h from o)", select=f"select channel, sum(m)::bigint as n, {r('sum(m * h) / sum(m)')} as h from h group by channel"))
def channel_cond_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.conditional_entropy(bits(spark, sf_dir), ("corpus", "prev"))


@query(sql(_BITS, "b as (select *, coalesce(lag(bit) over (partition by channel, page order by pos, i), -1) as pb from ch)", "g as (select channel, corpus, prev, pb, count(*) as m, sum(bit)::double as ones from b group by all)", "o as (select *, sum(ones) over (partition by channel) / sum(m) over (partition by channel) as p from g)", f"h as (select channel, m, case when m < 5 then {_hb('p')} else {_hb('(ones / m)')} end as h from o)", select=f"select channel, sum(m)::bigint as n, {r('sum(m * h) / sum(m)')} as h from h group by channel"))
def channel_memory_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entropy given the writer's language, the letter before and the choice before."""
    before = F.lag("bit").over(Window.partitionBy("channel", "page").orderBy("pos", "gi"))
    return signals.conditional_entropy(bits(spark, sf_dir).withColumn("prev_bit", F.coalesce(before, F.lit(-1))), ("corpus", "prev", "prev_bit"))


# ---- events and conversations as sequences ----


@query("with e as (select user_id, event_type as a, lead(event_type) over (partition by user_id order by ts, event_id) as b from events), p as (select 'events' as corpus, a, b, count(*) as c from e where b is not null group by all), " + mutual("p", "corpus") + f" select corpus, n_pairs, {r('mi')} as mi from mi_")
def events_transition_mi(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.event_types(spark, sf_dir)
    p = pairs.pairs(e, F.col("w"), F.col("w")).groupBy("corpus", "a", "b").agg(F.count("*").alias("c"))
    return pairs.mutual_information(p)


@query(f"with e as (select user_id, event_type as a, lead(event_type) over (partition by user_id order by ts, event_id) as b from events) select 'events' as corpus, {r('avg((a = b)::int)')} as rate from e where b is not null")
def events_repeat_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs.repeat_rate(tables.event_types(spark, sf_dir))


@query(f"with t as (select role as corpus, unnest(regexp_extract_all(lower(text), '[a-z]+')) as w from conversations), v as (select corpus, w, count(*) as cnt from t group by all) select corpus, sum(cnt)::bigint as n_tokens, count(*) as n_types, {r('avg((cnt = 1)::int)')} as hapax_share from v group by corpus")
def conversation_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.counts(tables.conversations(spark, sf_dir)).select("corpus", "n_tokens", "n_types", "hapax_share")


@query(r"with t as (select page_id, regexp_replace(regexp_replace(html, '<(script|style)[^>]*>.*?</(script|style)>', ' ', 'gis'), '<[^>]*>', ' ', 'gs') as x from pages), w as (select unnest(regexp_extract_all(lower(x), '[a-z]+')) as w from t) select w, count(*) as cnt from w group by w order by cnt desc, w limit 25")
def page_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.top_overall(tables.pages(spark, sf_dir), 25)


# ---- events as a stream ----


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as a stream of files, a few in each batch."""
    kinds = tables.table(spark, sf_dir, "events").schema
    return spark.readStream.schema(kinds).option("maxFilesPerTrigger", 8).parquet(f"{sf_dir}/events*.parquet")


@query("select epoch_us(time_bucket(interval '1 hour', ts))::bigint as started, event_type as key, count(*) as n from events group by all")
def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = counts.drained(spark, counts.windowed(event_stream(spark, sf_dir), F.col("event_type")), "complete")
    return out.select(F.unix_micros("start").alias("started"), "key", "n")


@query("with g as (select user_id, ts, lag(ts) over (partition by user_id order by ts) as p from events) select user_id::varchar as key, epoch_us(ts)::bigint as started from g where p is null or ts - p > interval '6 hours'")
def event_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return counts.drained(spark, counts.starts(event_stream(spark, sf_dir), "user_id"))


# ---- generators ----

_PLACES = "pl as materialized (select corpus, page::varchar as page, line_idx::int as line_idx, word_idx::int as word_idx, line_len::int as line_len, pos::int as pos, w, case when line_idx = 0 then 'pf-' else 'ot-' end || case when word_idx = 0 then 'first' when word_idx = line_len - 1 then 'last' else 'mid' end as bucket from tok)"


@query(
    sql(
        _PLACES,
        "ids as materialized (select corpus, bucket, row_number() over (order by corpus, bucket) as b, count(*) as n from pl group by corpus, bucket)",
        "nb as materialized (select ids.b * 1000000000000 + row_number() over (partition by ids.b order by page, pos) - 1 as k, w from pl join ids using (corpus, bucket))",
        "dr as materialized (select pl.* exclude (w), ids.b * 1000000000000 + ('0x' || substr(md5(concat_ws('|', 1, page, pos)), 1, 12))::bigint % ids.n as k from pl join ids using (corpus, bucket))",
        select="select dr.corpus, dr.page, dr.line_idx, dr.word_idx, dr.line_len, dr.pos, nb.w from dr join nb using (k)",
    )
)
def gen_iid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generators.iid(docs(spark, sf_dir), whole=True).select("corpus", "page", "line_idx", "word_idx", "line_len", "pos", "w")


_FR = "select row_number() over (order by page::varchar, pos) - 1 as gpos, {} as w from tok where corpus = 'fr'"


@query(
    sql(
        _PLACES,
        "g as (select *, row_number() over (partition by corpus order by page, pos) - 1 as gpos from pl)",
        f"s as materialized ({_FR.format("array_to_string(list_sort(string_split(w, '')), '')")})",
        "a as (select g.*, g.gpos % k.n as at from g, (select count(*) as n from s) k)",
        select="select a.corpus, a.page, a.line_idx, a.word_idx, a.line_len, a.pos, s.w from a join s on s.gpos = a.at",
    )
)
def gen_alphagram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generators.alphagrams(tables.placed(spark, sf_dir, as_text=True), _french(spark, sf_dir)).select(_GEN)


_GEN = ["corpus", "page", "line_idx", "word_idx", "line_len", "pos", "w"]


def _french(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The running text that fills all corpora: (page, pos, gpos, w)."""
    return tables.placed(spark, sf_dir, as_text=True).where("corpus = 'fr'").select("page", "pos", "gpos", "w")


def _letter_counts(voc: DataFrame) -> DataFrame:
    """(letter, cnt) of the running text, by its types."""
    each = voc.where("corpus = 'fr'").select("cnt", F.explode(F.split("w", "")).alias("letter"))
    return each.groupBy("letter").agg(F.sum("cnt").alias("cnt"))


@query(
    sql(
        _PLACES, VOC,
        "g as (select *, row_number() over (partition by corpus order by page, pos) - 1 as gpos from pl)",
        "s as materialized (select letter, row_number() over (order by page, pos, i) - 1 as gpos from (select page::varchar as page, pos, unnest(range(1, length(w) + 1)) as i, unnest(string_split(w, '')) as letter from tok where corpus = 'fr'))",
        "f as (select letter, count(*) as c from s group by letter)",
        "m as (select letter, c, greatest(1, round_even(c / sum(c) over () * 1500, 0)::int) as many from f)",
        "b as (select letter, many, sum(many) over (order by c desc, letter) - many as start from m)",
        "v as (select corpus, w, row_number() over (partition by corpus order by cnt desc, w) - 1 as k0, count(*) over (partition by corpus) as types from voc)",
        "h as (select corpus, letter, greatest(0, k0 - start)::bigint as k, w from v, b where (k0 >= start and k0 < start + many) or (start >= types and k0 = 0))",
        "n as (select corpus, letter, count(*) as n from h group by all)",
        "a as (select g.*, g.gpos % k.n as at from g, (select count(*) as n from s) k)",
        "p as (select a.*, s.letter, ('0x' || substr(md5(concat_ws('|', 4, page, pos)), 1, 12))::bigint as draw from a join s on s.gpos = a.at)",
        select="select p.corpus, p.page, p.line_idx, p.word_idx, p.line_len, p.pos, h.w from p join n using (corpus, letter) join h on h.corpus = p.corpus and h.letter = p.letter and h.k = p.draw % n.n",
    )
)
def gen_cipher(spark: SparkSession, sf_dir: str) -> DataFrame:
    voc = stage.written(lexical.vocab(docs(spark, sf_dir)), "types")
    homophones = stage.written(generators.homophones(voc, _letter_counts(voc)), "homophones")
    letters = tables.letters(spark, sf_dir, "fr").select("gpos", "letter")
    return generators.cipher(tables.placed(spark, sf_dir, as_text=True), letters, homophones).select(_GEN)


def _way(old: str, new: str) -> str:
    return f"when regexp_matches(w, '{old}') then regexp_replace(w, '{old}', '\\1{new}')"


_FORMS = ", ".join(f"case {' '.join(_way(*way) for way in ways)} end" for ways in generators.KINDS)
_STEM = "case " + " ".join(f"when suffix(w, '{e}') and length(w) > {len(e)} then left(w, length(w) - {len(e)})" for e in fixed.ENDINGS) + " end"


@query(sql(VOC, f"f as (select corpus, w, list_filter([{_FORMS}, {', '.join(f'st || {chr(39)}{e}{chr(39)}' for e in fixed.ENDINGS)}], lambda x: x is not null) as forms from (select *, {_STEM} as st from voc))", "e as (select corpus, unnest(forms) as form, w from f)", select="select e.corpus, e.w, count(*) as n_forms, count(v.w) as n_attested from e left join voc v on v.corpus = e.corpus and v.w = form group by e.corpus, e.w"))
def slip_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many forms one slip can make of each word, and how many of them are words too."""
    voc = lexical.vocab(docs(spark, sf_dir)).select("corpus", "w")
    each = voc.select("corpus", "w", F.explode(generators.forms(F.col("w"))).alias("form"))
    known = voc.select(F.col("corpus").alias("corpus_"), F.col("w").alias("known"))
    both = each.join(known, (F.col("corpus") == F.col("corpus_")) & (F.col("form") == F.col("known")), "left")
    return both.groupBy("corpus", "w").agg(F.count("*").alias("n_forms"), F.count("known").alias("n_attested"))


@query()
def gen_copyist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generators.copyist(docs(spark, sf_dir), whole=True)


@query()
def gen_copyist_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generators.copyist(docs(spark, sf_dir), generators.FLOW, seed=6, whole=True)


@query()
def gen_copyist_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generators.copyist(docs(spark, sf_dir), generators.MEMORY, seed=8, whole=True)


_WALK = (
    _PLACES, VOC,
    "g as (select *, row_number() over (partition by corpus order by page, pos) - 1 as gpos from pl)",
    f"q as (select corpus, cnt, unnest([0, 1, 2]) as k, unnest([regexp_extract(w, '{fixed.PARTS}', 1), regexp_extract(w, '{fixed.PARTS}', 2), regexp_extract(w, '{fixed.PARTS}', 3)]) as part from voc where regexp_matches(w, '{fixed.PARTS}'))",
    "tb as (select corpus, k, part, row_number() over (partition by corpus, k order by sum(cnt) desc, part) - 1 as i from q group by corpus, k, part having sum(cnt) >= 3)",
    "ls as (select c.corpus, c.k, coalesce(max(i), 0) as last from (select distinct corpus, unnest([0, 1, 2]) as k from voc) c left join tb on tb.corpus = c.corpus and tb.k = c.k group by all)",
    "dr as (select g.corpus, g.gpos, ls.k, ls.last, md5(concat_ws('|', 3, page, pos, ls.k)) as m from g join ls using (corpus))",
    f"st as (select corpus, gpos, k, last, ('0x' || m[1:8])::bigint < {int(generators.ANEW * 16**8)} as anew, least(floor(ln((('0x' || m[9:20])::bigint + 1) / pow(16.0, 12)) / ln({generators.ONWARD})), last)::bigint as chosen, [-1, 0, 0, 1][('0x' || m[21:21])::int % 4 + 1]::bigint as drift from dr)",
    "sg as (select *, sum(anew::int) over (partition by corpus, k order by gpos) as seg from st)",
    "ps as (select corpus, gpos, k, last, list_concat([0::bigint], list(case when anew then chosen else drift end) over (partition by corpus, k, seg order by gpos)) as moves from sg)",
    "wk as (select corpus, gpos, k, list_reduce(moves, lambda a, b: least(greatest(a + b, 0), last)) as at from ps)",
    "wd as (select wk.corpus, gpos, string_agg(coalesce(part, ''), '' order by wk.k) as w from wk left join tb on tb.corpus = wk.corpus and tb.k = wk.k and tb.i = wk.at group by all)",
)


@query(sql(*_WALK, select="select corpus, g.page, g.line_idx, g.word_idx, g.line_len, g.pos, case when wd.w = '' then 'ol' else wd.w end as w from g join wd using (corpus, gpos)"))
def gen_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generators.table_words(docs(spark, sf_dir), whole=True).select(_GEN)


@query()
def solver(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = signals.word_trigrams(docs(spark, sf_dir))
    model = signals.trigram_model(t.where("corpus = 'en'").select("tri", "c"))
    shifted = t.where("corpus = 'fr'").select(F.translate("tri", "abcdefghijklmnopqrstuvwxyz", "bcdefghijklmnopqrstuvwxyza").alias("tri"), "c")
    return generators.solve(spark, shifted, model, " abcdefghijklmnopqrstuvwxyz")


# ---- battery ----


def _metric(name: str, column: str, metric: str, by: str = "corpus") -> str:
    return f"select {by}, '{metric}' as metric, {column}::double as value from ({ORACLES[name]})"


_BATTERY = [
    ("token_counts", "n_types", "types"), ("token_counts", "hapax_share", "hapax"), ("token_counts", "top1_share", "top1"), ("zipf_slope", "zipf_slope", "zipf"),
    ("mi_excess", "excess", "mi_excess"), ("repeat_ratio", "ratio", "repeat_ratio"), ("selfsim_ratio", "ratio", "selfsim_ratio"),
    ("positional_z", "z_start", "pos_z_start"), ("positional_z", "z_end", "pos_z_end"), ("char_h2", "h2", "h2"), ("slot_coverage", "token_share", "grammar"),
]
_PROFILE = [
    *_BATTERY[:-1], ("heaps_beta", "heaps_beta", "heaps"), ("burstiness_summary", "median_cv", "median_cv"), ("monotone_share", "share", "monotone"),
    ("cross_boundary_mi", "mi", "boundary_mi"), ("ngram_repeats_3", "events", "grams_3"), ("ngram_repeats_4", "events", "grams_4"),
]
_UNION = " union all "
_SECTIONS = _UNION.join(_metric(*m) for m in _BATTERY).replace("lang as corpus, source as section", "lang || '|' || source as corpus, source as section")
_GRAMMAR = f"select corpus, 'grammar' as metric, {r('sum(case when fits then n_tokens else 0 end) / sum(n_tokens)')} as value from ({ORACLES['class_strings']}) group by corpus"
_TOP_CV = f"select corpus, 'top_cv' as metric, median_cv::double as value from ({ORACLES['burstiness_summary'].replace('having count(*) >= 15', 'having count(*) > 100')})"


@query(_UNION.join(_metric(*m) for m in _BATTERY))
def battery(spark: SparkSession, sf_dir: str) -> DataFrame:
    return battery_.metrics(docs(spark, sf_dir).drop("section"), fits=_cv().rlike(_CV_GRAMMAR), whole=True)


@query(f"with {TOK}, big as (select corpus, section from tok group by all having count(*) >= 2000) select big.corpus, section, metric, value from big join ({_SECTIONS}) m on m.corpus = big.corpus || '|' || section")
def battery_by_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = docs(spark, sf_dir)
    big = t.groupBy("corpus", "section").agg(F.count("*").alias("n")).where("n >= 2000").select("corpus", "section")
    big = stage.written(big, "sections")
    small = big.limit(pairs.BROADCAST_ROWS + 1).count() <= pairs.BROADCAST_ROWS
    each = t.join(F.broadcast(big) if small else big, ["corpus", "section"], "left_semi")
    return battery_.metrics(each, ("corpus", "section"), fits=_cv().rlike(_CV_GRAMMAR), whole=small)


@query(f"with m as ({_UNION.join([*(_metric(*m) for m in _PROFILE), _GRAMMAR, _TOP_CV])}) select metric, " + ", ".join(f"max(case when corpus = '{c}' then value end) as {c}" for c in ("de", "en", "es", "fr")) + " from m group by metric")
def corpus_profile_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = tables.placed(spark, sf_dir).drop("section")
    return battery_.pivot(battery_.profile(t, whole=True), values=["de", "en", "es", "fr"])


@query()
def generator_showdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = docs(spark, sf_dir).drop("section")
    french = t.where("corpus = 'fr'").withColumn("page", F.col("page").cast("string"))
    return battery_.showdown(t, fits=_cv().rlike(_CV_GRAMMAR), text=french, whole=True)


# ---- transliteration source: documents written as files of that form, then read ----


def written(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as transliteration files (file, text): two pages a document, their lines as loci.

    Lines take turns with what the format has: notes, alternate readings, uncertain spaces and
    words, ligature braces, fillers, lines continued on the next, comments, paragraph marks, labels.
    """
    lines = F.filter(F.transform(F.split("text", "\n"), lambda line: words.latin_words(line)), lambda ws: F.size(ws) > 0)
    doc = F.col("doc_id").cast("string")
    sides = [(0, "r", F.lit(0)), (10, "v", F.lit(3))]

    def header(side: str, shift: Column) -> Column:
        code = F.substring(F.lit("HAZBCPST"), ((F.col("doc_id") + shift) % 8 + 1).cast("int"), F.lit(1))
        lang = F.when((F.col("doc_id") + shift) % 2 == 0, "A").otherwise("B")
        hand = F.when(F.col("doc_id") % 4 > 0, F.concat(F.lit(" $H="), (F.col("doc_id") % 3 + 1).cast("string"))).otherwise("")
        return F.concat(F.lit("<f"), doc, F.lit(f"{side}>      <! $Q=A $I="), code, F.lit(" $L="), lang, hand, F.lit(">\n# a comment\n"))

    def locus(ws: Column, k: Column) -> Column:
        first, rest = F.get(ws, 0), F.when(F.size(ws) > 1, F.concat(F.lit("."), F.array_join(F.slice(ws, 2, 1 << 30), "."))).otherwise("")
        plain = F.when((k % 11 == 10) & (F.size(ws) > 1), F.concat(first, F.lit(".") , F.lit("/\n/"), F.array_join(F.slice(ws, 2, 1 << 30), "."))).otherwise(F.array_join(ws, "."))
        text = F.when(k % 6 == 1, F.concat(first, F.lit("<!a note>"), rest)).when(k % 6 == 2, F.concat(F.lit("["), first, F.lit(":xx]"), rest)).when(k % 6 == 3, F.array_join(ws, ","))
        text = text.when(k % 6 == 4, F.concat(first, F.lit("?x"), rest)).when(k % 6 == 5, F.concat(F.lit("{"), first, F.lit("}'"), rest, F.lit("-%="))).otherwise(plain)
        label = k % 7 == 6
        body = F.when(label, F.array_join(F.slice(ws, 1, 2), ".")).otherwise(F.concat(F.when(k % 5 == 0, "<%>").otherwise(""), text))
        kind = F.when(label, "@Lz").when((k == 0) | (k == 10), "@P0").when(k % 13 == 12, "=Pt").otherwise("+P0")
        side = F.when(k < 10, "r").otherwise("v")
        top = F.lit("")
        for at, name, shift in sides:
            top = F.when(k == at, header(name, shift)).otherwise(top)
        return F.concat(top, F.lit("<f"), doc, side, F.lit("."), (k + 1).cast("string"), F.lit(","), kind, F.lit(">      "), body)

    docs_ = tables.spread(tables.table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return docs_.select(doc.alias("file"), F.concat(F.lit("#=IVTFF Eva- 2.0\n"), F.array_join(F.transform(lines, locus), "\n")).alias("text"))


def loci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transliteration.parse(written(spark, sf_dir))


_WRITTEN = (
    "k as (select page as d, row_number() over (partition by page order by line_idx) - 1 as k, ws from lines_ where len(ws) > 0)",
    "pg as (select *, 'f' || d || case when k < 10 then 'r' else 'v' end as pn, k % 7 = 6 as label, d + case when k < 10 then 0 else 3 end as dd from k)",
    "lc as (select *, case when label then '@Lz' when k in (0, 10) then '@P0' when k % 13 = 12 then '=Pt' else '+P0' end as ltype, "
    "case when label then ws[1:2] when k % 6 = 4 then list_concat([ws[1] || '?x'], ws[2:]) else ws end as cs, "
    "case when label then ws[1:2] when k % 6 = 4 then ws[2:] else ws end as kept, "
    "substr('HAZBCPST', (dd % 8 + 1)::int, 1) as code, case when dd % 2 = 0 then 'A' else 'B' end as lang, case when d % 4 > 0 then (d % 3 + 1)::varchar else '?' end as hand from pg)",
    "sn as (select *, map {" + ", ".join(f"'{k}': '{v}'" for k, v in fixed.SECTIONS.items()) + "}[code] as section from lc)",
    "ru as (select *, (k % 5 = 0 or row_number() over (partition by d, pn order by k) = 1)::int as opens from sn where not label)",
    "rn as (select *, greatest(sum(opens) over (partition by d, pn order by k), 1) - 1 as par_idx from ru where len(kept) > 0)",
    "wl as (select *, row_number() over (partition by d, pn, par_idx order by k) - 1 as line_idx from rn)",
)


@query(sql(*_WRITTEN, select="select pn as page, (k + 1)::varchar as num, ltype, array_to_string(cs, '.') as clean, len(kept) as n_words from lc"))
def ivtff_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = words.clean(F.col("text"))
    return loci(spark, sf_dir).select("page", "num", "ltype", c.alias("clean"), F.size(words.words(c)).cast("long").alias("n_words"))


@query(sql(*_WRITTEN, select="select pn as page, section, lang, hand, par_idx::bigint as par_idx, line_idx::bigint as line_idx, len(kept) as n_words from wl"))
def running_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = transliteration.running_lines(loci(spark, sf_dir), whole=True)
    number = lambda c: F.col(c).cast("long").alias(c)
    return lines.select("page", "section", "lang", "hand", number("par_idx"), number("line_idx"), F.size("ws").cast("long").alias("n_words"))


@query(sql(*_WRITTEN, select="select pn as page, section, 'z' as subtype, unnest(kept) as w from sn where label"))
def label_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transliteration.labels(loci(spark, sf_dir))


@query(sql(*_WRITTEN, select="select section, case when ltype = '=Pt' then 'title' when k % 5 = 0 then 'par-first' else 'body' end as kind, count(*) as n_lines, sum(len(kept))::bigint as n_words from sn where not label and len(kept) > 0 group by all"))
def line_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = transliteration.kind_lines(loci(spark, sf_dir))
    return lines.groupBy("section", "kind").agg(F.count("*").alias("n_lines"), F.sum(F.size("ws")).alias("n_words"))


@query(sql(*_WRITTEN, "tk as (select pn as page, hand, par_idx::bigint as par_idx, line_idx::bigint as line_idx, len(kept) as line_len, k, unnest(kept) as w, unnest(range(0, len(kept))) as word_idx from wl)", select="select page, hand, par_idx, line_idx, word_idx, line_len, row_number() over (partition by page order by k, word_idx) - 1 as pos, w from tk"))
def transliterated_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    toks = transliteration.tokens(transliteration.running_lines(loci(spark, sf_dir), whole=True))
    number = [F.col(c).cast("long").alias(c) for c in ("par_idx", "line_idx", "word_idx", "line_len", "pos")]
    return toks.select("page", "hand", *number, "w")


@query(sql(*_WRITTEN, "jn as (select section, list_concat(case when k % 6 = 3 then [array_to_string(kept, '')] else kept end, []) as ws from wl)", select="select section, count(*) as n_lines, sum(len(ws))::bigint as n_words from jn group by all"))
def joined_commas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running text where uncertain spaces join words instead of parting them. S18, P3, A48."""
    lines = transliteration.running_lines(loci(spark, sf_dir), "", whole=True)
    return lines.groupBy("section").agg(F.count("*").alias("n_lines"), F.sum(F.size("ws")).alias("n_words"))


_LABELLED = (
    *_WRITTEN, "lb as (select pn as page, section, unnest(kept) as w from sn where label)", "tx as (select unnest(kept) as w from wl)",
    "lv as (select w, count(*) as c, count(distinct page) as pages from lb group by w)", "tv as (select w, count(*) as c from tx group by w)",
)


@query(sql(
    *_LABELLED,
    "st as (select 'labels' as kind, w, c from lv union all select 'text', w, c from tv)",
    "ag as (select kind, sum(c)::bigint as n_tokens, count(*) as n_types, avg((c = 1)::int) as hapax_share, sum(case when c > 1 then c else 0 end) / sum(c) as repeat_share, "
    + ", ".join(f"sum(case when {c} then c else 0 end) / sum(c) as {n}" for n, c in (("starts_q", "w like 'q%'"), ("starts_o", "w like 'o%'"), ("starts_d", "w like 'd%'"), ("starts_y", "w like 'y%'"), ("starts_bench", "w like 'ch%' or w like 'sh%'")))
    + ", sum(c * length(w)) / sum(c) as mean_length from st group by kind)",
    select="select kind, n_tokens, n_types, " + ", ".join(f"{r(c)} as {c}" for c in ("hapax_share", "repeat_share", "starts_q", "starts_o", "starts_d", "starts_y", "starts_bench", "mean_length"))
    + ", case when kind = 'labels' then (select count(*) from lv where w not in (select w from tv)) else 0 end as n_novel, case when kind = 'labels' then (select count(*) from lv where pages > 1) else 0 end as n_on_pages from ag",
))
def label_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Are labels like names? Their words beside those of the running text. A49, A51."""
    all_loci = loci(spark, sf_dir)
    lab = transliteration.labels(all_loci).select(F.lit("labels").alias("kind"), "page", "w")
    text = transliteration.tokens(transliteration.running_lines(all_loci, whole=True)).select(F.lit("text").alias("kind"), "page", "w")
    voc = lab.unionByName(text).groupBy("kind", "w").agg(F.count("*").alias("cnt"), F.countDistinct("page").alias("pages"))
    w, n = F.col("w"), F.sum("cnt")
    share = lambda hit: F.sum(F.when(hit, F.col("cnt")).otherwise(0)) / n
    out = voc.groupBy("kind").agg(
        n.alias("n_tokens"), F.count("*").alias("n_types"), F.avg((F.col("cnt") == 1).cast("double")).alias("hapax_share"), share(F.col("cnt") > 1).alias("repeat_share"),
        *[share(w.startswith(c)).alias(f"starts_{c}") for c in "qody"], share(w.startswith("ch") | w.startswith("sh")).alias("starts_bench"), (F.sum(F.col("cnt") * F.length(w)) / n).alias("mean_length"),
    )
    own = voc.where("kind = 'labels'")
    novel = own.join(voc.where("kind = 'text'").select("w", F.lit(1).alias("known")), "w", "left").groupBy("kind").agg(F.sum(F.col("known").isNull().cast("long")).alias("n_novel"), F.sum((F.col("pages") > 1).cast("long")).alias("n_on_pages"))
    return out.join(novel, "kind", "left").select(*out.columns, F.coalesce("n_novel", F.lit(0)).alias("n_novel"), F.coalesce("n_on_pages", F.lit(0)).alias("n_on_pages"))


@query(sql(
    *_WRITTEN, "tx as (select unnest(kept) as w from wl)",
    "jn as (select unnest(case when k % 6 = 3 then [array_to_string(kept, '')] else kept end) as w from wl)",
    f"nw as (select w, count(*) as c, regexp_matches({_CV_CLASS}, '{_CV_GRAMMAR}') as fits from jn where w not in (select w from tx) group by w)",
    select=f"select count(*) as n_types, sum(c)::bigint as n_tokens, {r('sum(case when fits then c else 0 end) / sum(c)')} as conforming from nw",
))
def comma_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that exist only where uncertain spaces join: do they fit the grammar? A48, J3."""
    all_loci = loci(spark, sf_dir)
    text, joined = (transliteration.running_lines(all_loci, comma, whole=True).select(F.explode("ws").alias("w")).groupBy("w").agg(F.count("*").alias("c")) for comma in (".", ""))
    new = joined.join(text.select("w"), "w", "left_anti").withColumn("fits", _cv().rlike(_CV_GRAMMAR))
    return new.agg(F.count("*").alias("n_types"), F.sum("c").alias("n_tokens"), (F.sum(F.when(F.col("fits"), F.col("c")).otherwise(0)) / F.sum("c")).alias("conforming"))


_PARAGRAPHS = (
    *_WRITTEN,
    "t0 as (select lang as corpus, pn as page, par_idx, k, len(kept) as line_len, unnest(kept) as w, unnest(range(0, len(kept))) as word_idx from wl)",
    "tp as (select *, row_number() over (partition by page order by k, word_idx) - 1 as pos from t0)",
    "rr as (select * from tp, unnest(range(0, 11)) as u(round))",
    "sl as (select * exclude (w), row_number() over (partition by round, page, par_idx order by pos) as slot from rr)",
    "dw as (select round, page, par_idx, w, row_number() over (partition by round, page, par_idx order by case when round > 0 then md5(concat_ws('|', round, page, pos)) else '' end, pos) as slot from rr)",
    "rf as (select sl.*, dw.w from sl join dw on sl.round = dw.round and sl.page = dw.page and sl.par_idx = dw.par_idx and sl.slot = dw.slot)",
)


@query(sql(*_PARAGRAPHS, _ROLE_RF, _tv_round("left(w, 1)", "first", "last", "s"), _tv_round("right(w, 1)", "last", "first", "e"), _z("s", "tv", "zs"), _z("e", "tv", "ze"), select=f"select zs.corpus, {r('zs.x')} as tv_start, {r('zs.z')} as z_start, {r('ze.x')} as tv_end, {r('ze.z')} as z_end from zs join ze on zs.corpus = ze.corpus"))
def positional_z_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words permuted inside their paragraphs, which the transliteration marks. A33, N2."""
    toks = transliteration.tokens(transliteration.running_lines(loci(spark, sf_dir), whole=True))
    toks = toks.select(F.col("lang").alias("corpus"), "page", "par_idx", "pos", "word_idx", "line_len", "w")
    return layout.positional_z(toks, 10, within=("corpus", "page", "par_idx"), whole=True)


# ---- plain-text sources over documents as files ----


@query(r"with d as (select doc_id, string_split(text, chr(10)) as ls from documents), w as (select doc_id, regexp_extract_all(lower(ls[i]), '[a-z]+') as ws from d, unnest(range(1, len(ls) + 1)) as u(i)), k as (select doc_id, list_filter(ws, lambda x: regexp_matches(x, '^[aeiouhkmnprtwg]+$')) as ok, len(ws) as n from w where len(ws) >= 4) select doc_id, sum(len(ok))::bigint as n_legal from k where len(ok) >= 0.5 * n group by doc_id")
def legal_line_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = tables.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), "text")
    out = plain.legal_lines(files, "legal", share=0.5, macrons=False)
    return out.groupBy(F.col("file").alias("doc_id")).agg(F.count("*").alias("n_legal"))


@query(sql(VOC, "o as (select corpus, floor(gpos / 170)::bigint as page_seq, count(*) as n, count(distinct w) as types from (select corpus, w, row_number() over (partition by corpus order by page, pos) - 1 as gpos from tok) group by all)", select="select corpus, page_seq, n, types from o"))
def pseudo_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pseudo_pages(tables.placed(spark, sf_dir))


def _pseudo_pages(toks: DataFrame) -> DataFrame:
    flat = lexical.global_positions(toks).select("corpus", "gpos", "w")
    return plain.paginate(flat).groupBy("corpus", F.col("page_seq").cast("long").alias("page_seq")).agg(F.count("*").alias("n"), F.countDistinct("w").alias("types"))


@query(ORACLES["pseudo_pages"])
def pseudo_pages_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An earlier name of ``pseudo_pages``, which has every corpus now."""
    return _pseudo_pages(tables.placed(spark, sf_dir))


@query(sql("g as (select *, md5(concat_ws('|', page, pos)) as k from tok)", "s as (select *, row_number() over (partition by corpus order by k) as i from g)", select="select corpus, w, count(*) as n from s where i <= 500 group by all"))
def downsample_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nulls.first_by_md5(docs(spark, sf_dir), 500, ("corpus",), ("page", "pos")).groupBy("corpus", "w").agg(F.count("*").alias("n"))
