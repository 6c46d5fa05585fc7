"""Registered queries over glyphs: the words of ``documents`` read as transliterated ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed, glyphs, words
from ..operators import grammar, lexical, nulls, pairs, signals
from ..sources import tables, transliteration
from .base import VOC, mutual, query, r, sql

docs = tables.documents

#: Words with their counts, glyphs, normalised glyphs and class strings in DuckDB.
_CLASS = " ".join(f"when '{g}' then '{c}'" for g, c in fixed.CLASSES.items())
_NORMAL = "case when g[1] = 'e' then 'E' when g[1] = 'i' then 'I' || case when ltrim(g, 'i') = '' then '-' else ltrim(g, 'i') end else g end"
GLYPHS = (
    f"gl as (select corpus, w, cnt, regexp_extract_all(w, '{fixed.GLYPH}') as gs from voc), "
    f"ng as (select *, list_transform(gs, lambda g: {_NORMAL}) as ns from gl), "
    f"cl as (select *, case when len(list_filter(ns, lambda g: case g {_CLASS} end is null)) = 0 "
    f"then coalesce(array_to_string(list_transform(ns, lambda g: case g {_CLASS} end), ''), '') end as cls from ng)"
)


def voc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.vocab(docs(spark, sf_dir))


def counted(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.sum("cnt").alias("n_tokens"), F.count("*").alias("n_types"))


_COUNTED = "sum(cnt)::bigint as n_tokens, count(*) as n_types"


@query(sql(VOC, GLYPHS, "e as (select corpus, cnt, unnest(gs) as g, unnest(ns) as normal from ng)", select=f"select corpus, g, normal, {_COUNTED} from e group by all"))
def glyph_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P4, P5."""
    pair = F.arrays_zip(glyphs.glyphs(F.col("w")).alias("g"), glyphs.normal_glyphs(F.col("w")).alias("normal"))
    return counted(voc(spark, sf_dir).select("corpus", "cnt", F.inline(pair)), "corpus", "g", "normal")


@query(sql(VOC, GLYPHS, select=f"select corpus, cls, coalesce(regexp_matches(cls, '{fixed.GRAMMAR_2}'), false) as fits, {_COUNTED} from cl group by all"))
def class_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P6, P7, P10."""
    w = F.col("w")
    return counted(voc(spark, sf_dir).select("corpus", "cnt", glyphs.class_string(w).alias("cls"), glyphs.conforms(w).alias("fits")), "corpus", "cls", "fits")


def only_group(pattern: str, i: int) -> str:
    """The pattern with its ``i``-th group alone captured: DuckDB numbers groups up to nine."""
    out, seen = [], 0
    for k, ch in enumerate(pattern):
        captures = ch == "(" and pattern[k + 1 : k + 3] != "?:"
        seen += captures
        out.append("(?:" if captures and seen != i else ch)
    return "".join(out)


def _slot_sql(pattern: str, n: int) -> str:
    cells = ", ".join(f"regexp_extract(cls, '{only_group(pattern, i)}', 1)" for i in range(1, n + 1))
    return sql(
        VOC, GLYPHS, f"s as (select corpus, cnt, [{cells}] as f from cl where regexp_matches(cls, '{pattern}'))",
        select=f"select corpus, i::int as slot, f[i + 1] as filler, {_COUNTED} from s, unnest(range(0, {n})) as u(i) group by all",
    )


def _slots(spark: SparkSession, sf_dir: str, pattern: str, n: int) -> DataFrame:
    cls = voc(spark, sf_dir).select("corpus", "cnt", glyphs.class_string(F.col("w")).alias("cls")).where(F.col("cls").rlike(pattern))
    return counted(cls.select("corpus", "cnt", F.posexplode(glyphs.slots(F.col("cls"), pattern, n)).alias("slot", "filler")), "corpus", "slot", "filler")


@query(_slot_sql(fixed.SLOTS_11, 11))
def slot_fillers_11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P8."""
    return _slots(spark, sf_dir, fixed.SLOTS_11, 11)


@query(
    _slot_sql(fixed.SLOTS_8, 8).replace("select corpus, i::int as slot,", f"select corpus, [{', '.join(repr(x) for x in fixed.SLOT_NAMES_8)}][i + 1] as slot,")
)
def slot_fillers_8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P9."""
    names = F.array(*[F.lit(x) for x in fixed.SLOT_NAMES_8])
    return _slots(spark, sf_dir, fixed.SLOTS_8, 8).withColumn("slot", F.get(names, F.col("slot")))


def _shares(spark: SparkSession, sf_dir: str, features: dict[str, Column]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(k).alias("feature"), F.coalesce(v, F.lit(False)).alias("hit")) for k, v in features.items()])
    each = voc(spark, sf_dir).select("corpus", "cnt", F.inline(cells))
    return each.groupBy("corpus", "feature").agg(F.sum(F.when(F.col("hit"), F.col("cnt")).otherwise(0)).alias("hits"), F.sum("cnt").alias("n"))


def _in(x: str, names: tuple[str, ...]) -> str:
    return f"{x} in ({', '.join(repr(n) for n in names)})"


_PF = f"len(list_filter(gs, lambda g: {_in('g', fixed.PF)})) > 0"
_FEATURES = {
    "starts-q": "gs[1] = 'q'", "starts-o": "gs[1] = 'o'", "starts-d": "gs[1] = 'd'", "starts-y": "gs[1] = 'y'", "starts-s/sh": "gs[1] in ('s', 'sh')",
    "starts-gallows": _in("gs[1]", fixed.GALLOWS_ALL), "has-p/f": _PF, "ends-m": "ns[-1] in ('Im', 'm')", "ends-in": "ns[-1] = 'In'", "ends-y": "ns[-1] = 'y'",
}
_SHORT = {"ends-m": "w like '%m'", "starts-y": "w like 'y%'", "starts-q": "w like 'q%'", "starts-gallows": _in("gs[1]", fixed.GALLOWS_ALL)}


def _share_sql(features: dict[str, str]) -> str:
    parts = " union all ".join(f"select corpus, '{k}' as feature, cnt, ({c}) as hit from ng" for k, c in features.items())
    return sql(VOC, GLYPHS, f"f as ({parts})", select="select corpus, feature, sum(case when hit then cnt else 0 end)::bigint as hits, sum(cnt)::bigint as n from f group by all")


@query(_share_sql(_FEATURES))
def glyph_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P11, P13."""
    return _shares(spark, sf_dir, glyphs.features(F.col("w")))


@query(_share_sql(_SHORT))
def short_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P12."""
    return _shares(spark, sf_dir, glyphs.short_features(F.col("w")))


@query(
    sql(
        VOC, GLYPHS,
        f"k as (select corpus, cnt, case when {_PF} then 'pf' when ns[1] = 'q' then 'q-' when {_in('ns[1]', fixed.GALLOWS_KT)} then 'gallows-' when ns[1] in ('ch', 'sh') then 'ch/sh-' "
        "when ns[1] in ('o', 'a') then 'o/a-' when ns[1] = 'y' then 'y-' when ns[1] in ('d', 's', 'l', 'r') then 'dslr-' else 'other' end as cls from ng)",
        select=f"select corpus, cls, {_COUNTED} from k group by all",
    )
)
def word_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P14."""
    return counted(voc(spark, sf_dir).select("corpus", "cnt", glyphs.word_class(F.col("w")).alias("cls")), "corpus", "cls")


@query(sql(VOC, select=f"select corpus, regexp_extract(w, '{fixed.PARTS}', 1) as pre, regexp_extract(w, '{fixed.PARTS}', 2) as core, regexp_extract(w, '{fixed.PARTS}', 3) as tail, {_COUNTED} from voc group by all"))
def word_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P23."""
    return counted(voc(spark, sf_dir).select("corpus", "cnt", F.inline(F.array(words.parts(F.col("w"))))), "corpus", "pre", "core", "tail")


@query(
    r"with t as (select lang as corpus, unnest(regexp_extract_all(strip_accents(lower(coalesce(text, ''))), '[a-z]+')) as w from documents) "
    "select corpus, count(*) as n_tokens, count(distinct w) as n_types from t group by corpus"
)
def folded_accents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P24."""
    each = tables.table(spark, sf_dir, "documents").select(F.col("lang").alias("corpus"), F.explode(words.latin_words(words.fold_accents(F.lower("text")))).alias("w"))
    return each.groupBy("corpus").agg(F.count("*").alias("n_tokens"), F.countDistinct("w").alias("n_types"))


_RULES = [(f"p>{to}", f"replace(w, 'p', '{to}')") for to in ("t", "te", "tch", "tk", "d")] + [("pf>tk", "translate(w, 'pf', 'tk')")]


@query(
    sql(
        VOC, "x as (" + " union all ".join(f"select corpus, w, cnt, '{k}' as rule, {e} as image from voc" for k, e in _RULES) + ")",
        select="select x.corpus, rule, count(*) as n_types, sum(x.cnt)::bigint as n_tokens, count(voc.w) as n_attested from x left join voc on voc.corpus = x.corpus and voc.w = image where image <> x.w group by all",
    )
)
def ligature_rewrites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P17."""
    v = voc(spark, sf_dir)
    forms = F.array(*[F.struct(F.lit(k).alias("rule"), c.alias("image")) for k, c in glyphs.rewrites(F.col("w")).items()])
    each = v.select("corpus", "w", "cnt", F.inline(forms)).where("image <> w")
    known = v.select("corpus", F.col("w").alias("image"), F.lit(1).alias("known"))
    return each.join(known, ["corpus", "image"], "left").groupBy("corpus", "rule").agg(F.count("*").alias("n_types"), F.sum("cnt").alias("n_tokens"), F.count("known").alias("n_attested"))


@query(
    sql(
        VOC, GLYPHS,
        "f as (select corpus, cnt, array_to_string(list_transform(gs, lambda g: case when g in ('ch', 'sh', 'cth') then case when length(g) = 3 then '_B_' else '_' end else g end), '') as frame "
        "from gl where len(list_filter(gs, lambda g: g in ('ch', 'sh', 'cth'))) = 1)",
        select=f"select corpus, frame, {_COUNTED} from f group by all",
    )
)
def glyph_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P18."""
    each = voc(spark, sf_dir).select("corpus", "cnt", glyphs.frame(F.col("w"), ("ch", "sh", "cth")).alias("frame")).where("frame is not null")
    return counted(each, "corpus", "frame")


@query(sql(VOC, GLYPHS, select=f"select corpus, array_to_string(gs[1:-2], '') as stem, gs[-1] as final, {_COUNTED} from gl group by all"))
def glyph_stems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P19."""
    return counted(voc(spark, sf_dir).select("corpus", "cnt", F.inline(F.array(glyphs.stem(F.col("w"))))), "corpus", "stem", "final")


@query(
    sql(
        VOC, GLYPHS, "h as (select corpus, len(gs)::int as len, sum(cnt)::bigint as n from gl group by all)", "s as (select *, n / sum(n) over (partition by corpus) as share from h)",
        select="select corpus, len, n, repeat('#', round(100 * share)::int) as bar, format('{:.1f}%', 100 * share) as percent from s",
    )
)
def glyph_length_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P21, P28, K2."""
    h = voc(spark, sf_dir).groupBy("corpus", glyphs.length(F.col("w")).alias("len")).agg(F.sum("cnt").alias("n"))
    h = h.join(h.groupBy("corpus").agg(F.sum("n").alias("all_n")), "corpus").withColumn("share", F.col("n") / F.col("all_n"))
    return h.select("corpus", "len", "n", words.bar(100 * F.col("share")).alias("bar"), words.percent(F.col("share")).alias("percent"))


@query(
    sql(
        VOC,
        "s as (select tok.corpus, tok.w, tok.word_idx = 0 and tok.w like 'y%' and length(tok.w) > 2 and v.w is not null as strips from tok left join voc v on v.corpus = tok.corpus and v.w = tok.w[2:])",
        select="select corpus, sum(strips::int)::bigint as n_stripped, count(distinct case when strips then w[2:] else w end) as n_types from s group by corpus",
    )
)
def stripped_initial_y(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P16."""
    known = voc(spark, sf_dir).select("corpus", F.col("w").alias("rest"), F.lit(True).alias("known"))
    each = docs(spark, sf_dir).withColumn("rest", F.expr("substring(w, 2)")).join(known, ["corpus", "rest"], "left")
    out = words.strip_initial_y(F.col("w"), F.col("word_idx") == 0, F.coalesce("known", F.lit(False)))
    each = each.withColumn("out", out)
    return each.groupBy("corpus").agg(F.sum((F.col("out") != F.col("w")).cast("long")).alias("n_stripped"), F.countDistinct("out").alias("n_types"))


@query(
    sql(
        VOC, GLYPHS, "s as (select tok.corpus, list_append(ns, '.') as ns from tok join ng on ng.corpus = tok.corpus and ng.w = tok.w)",
        select="select corpus, i::int as gi, ns[i + 1] as g, count(*) as n from s, unnest(range(0, len(ns))) as u(i) group by all",
    )
)
def glyph_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S21."""
    return transliteration.glyph_stream(docs(spark, sf_dir)).groupBy("corpus", "gi", "g").agg(F.count("*").alias("n"))


@query(
    sql(
        VOC, GLYPHS,
        "e as (select tok.corpus, line_idx = 0 as head, gs[i] as g, case when i = 1 then '<s>' else gs[i - 1] end as prev from tok join gl on gl.corpus = tok.corpus and gl.w = tok.w, unnest(range(1, len(gs) + 1)) as u(i))",
        "b as (select corpus, prev, 'ch/sh' as channel, (g = 'sh')::int as bit from e where g in ('ch', 'sh') union all select corpus, prev, 'k/t', (g = 't')::int from e where g in ('k', 't') "
        "union all select corpus, prev, 'pf-vs-tk@par1', (g in ('p', 'f'))::int from e where head and g in ('t', 'k', 'p', 'f') "
        "union all select corpus, prev, 'i-run(1vs2+)', (length(g) > 2)::int from e where regexp_matches(g, '^i+[nrlm]$'))",
        select=f"select corpus, channel, prev, count(*) as n, {r('avg(bit)')} as share from b group by all",
    )
)
def scribe_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S22."""
    each = docs(spark, sf_dir).select("corpus", "page", "pos", "w", (F.col("line_idx") == 0).alias("head"), glyphs.glyphs(F.col("w")).alias("gs"))
    bits = transliteration.channel_bits(each, F.col("head"))
    return bits.groupBy("corpus", "channel", "prev").agg(F.count("*").alias("n"), F.avg(F.col("bit").cast("double")).alias("share"))


@query(sql(VOC, GLYPHS, select=f"select corpus, count(distinct cls) as n_templates, count(distinct case when regexp_matches(cls, '{fixed.GRAMMAR_2}') then cls end) as n_fitting from cl group by corpus"))
def template_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A29."""
    return grammar.template_counts(docs(spark, sf_dir), glyphs.class_string(F.col("w")))


@query(
    sql(
        VOC, "e as (select corpus, log2(sum(cnt)) - sum(cnt * log2(cnt)) / sum(cnt) as h from voc group by corpus)",
        "c as (select corpus, unnest(string_split(w, '')) as ch, cnt from voc)", "n as (select corpus, ch, sum(cnt) as n from c group by all)",
        "b as (select corpus, log2(sum(n)) - sum(n * log2(n)) / sum(n) as bits from n group by corpus)",
        select=f"select corpus, {r('0.3 * h / bits')} as letters from e join b using (corpus)",
    )
)
def letters_per_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A31."""
    v = voc(spark, sf_dir)
    h = lexical.entropy_of(v, ("corpus",)).select("corpus", "h")
    each = v.select("corpus", "cnt", F.explode(F.split("w", "")).alias("ch")).groupBy("corpus", "ch").agg(F.sum("cnt").alias("cnt"))
    bits = lexical.entropy_of(each, ("corpus",)).select("corpus", F.col("h").alias("bits"))
    return h.join(bits, "corpus").select("corpus", signals.letters_per_word(F.col("h"), F.col("bits")).alias("letters"))


_ROUNDS = "rd as (select *, i::int as round from tok, unnest(range(0, 4)) as u(i))"
_PERMUTED = (
    "pm as (select corpus, page, round, w, row_number() over (partition by corpus, page, round order by case when round > 0 then md5(concat_ws('|', round, page, pos)) else '' end, pos) as p from rd)"
)


def _boundary_sql(first: str, rounds: int = 3) -> str:
    return sql(
        _ROUNDS.replace("range(0, 4)", f"range(0, {rounds + 1})"), _PERMUTED,
        f"ab as (select corpus, round, right(w, 1) as a, lead({first}) over (partition by corpus, page, round order by p) as b from pm)",
        "pr as (select corpus, round, a, b, count(*) as c from ab where b is not null group by all)", mutual("pr", "corpus, round"),
        select=f"select corpus, {r('max(case when round = 0 then mi end)')} as real, {r('avg(case when round > 0 then mi end)')} as null_mean, "
        f"{r('max(case when round = 0 then mi end) - avg(case when round > 0 then mi end)')} as excess from mi_ group by corpus",
    )


def _boundary(spark: SparkSession, sf_dir: str, qo: bool, rounds: int = 3) -> DataFrame:
    return pairs.excess(pairs.page_boundary_mi(docs(spark, sf_dir), rounds, qo=qo, whole=True), "mi").select("corpus", "real", "null_mean", "excess")


@query(_boundary_sql("left(w, 1)"))
def boundary_excess(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A9: information across the word boundary beyond that of shuffled words."""
    return _boundary(spark, sf_dir, False)


@query(_boundary_sql("case when w like 'qo%' then 'qo' else left(w, 1) end", 5))
def boundary_excess_qo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A8."""
    return _boundary(spark, sf_dir, True, 5)


@query(sql(
    VOC, GLYPHS,
    "ds as (select g, chr((33 + row_number() over (order by g))::int) as c from (select distinct unnest(gs) as g from gl))",
    "cd as (select w, string_agg(c, '' order by i) as code from (select w, unnest(gs) as g, unnest(range(1, len(gs) + 1)) as i from (select distinct w, gs from gl)) join ds using (g) group by w)",
    "tc as (select tok.corpus, page, pos, code as w from tok join cd on cd.w = tok.w)",
    "q as (select corpus, w, pos, list_distinct(list(w) over (partition by corpus, page order by pos rows between 20 preceding and 1 preceding)) as ws from tc)",
    select=f"select corpus, {r('avg(list_contains(ws, w)::int)')} as exact, {r('avg((len(list_filter(ws, lambda v: levenshtein(v, w) <= 1)) > 0)::int)')} as within_1 from q where pos > 0 group by corpus",
))
def selfsim_glyph_edit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P26, A15: edits of whole glyphs."""
    return pairs.selfsim_edit(docs(spark, sf_dir), symbols=fixed.GLYPH, whole=True)


_PF = "len(list_filter(gs, lambda g: g in ('p', 'f', 'cph', 'cfh')))"
_TK = "len(list_filter(gs, lambda g: g in ('k', 't', 'ckh', 'cth')))"


@query(sql(
    VOC, GLYPHS, f"k as (select corpus, w, cnt, case when {_PF} > 0 then 'p/f' when {_TK} > 0 then 't/k' else 'other' end as cls from gl)",
    "x as (select * from k union all select corpus, w, cnt, 'all' from k)",
    select=f"select corpus, cls, {_COUNTED}, {r('avg((cnt = 1)::int)')} as hapax_share from x group by all",
))
def gallows_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A43: hapaxes of words with p or f, of those with t or k, and of all."""
    tk = F.arrays_overlap(glyphs.glyphs(F.col("w")), F.array(*[F.lit(x) for x in fixed.GALLOWS_KT]))
    own = F.when(glyphs.has_pf(F.col("w")), "p/f").when(tk, "t/k").otherwise("other")
    each = voc(spark, sf_dir).select("corpus", "cnt", F.explode(F.array(own, F.lit("all"))).alias("cls"))
    return each.groupBy("corpus", "cls").agg(F.sum("cnt").alias("n_tokens"), F.count("*").alias("n_types"), F.avg((F.col("cnt") == 1).cast("double")).alias("hapax_share"))


@query(sql(
    VOC, GLYPHS, "k as (select corpus, cnt, list_position(list_transform(gs, lambda g: g in ('p', 'f', 'cph', 'cfh')), true) as i from gl)",
    select=f"select corpus, case when i = 1 then 'initial' when i = 2 then 'after 1 glyph' else 'deeper' end as place, {_COUNTED} from k where i > 0 group by all",
))
def gallows_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A43: where in the word its first p or f stands."""
    at = F.array_position(F.transform(glyphs.glyphs(F.col("w")), lambda g: g.isin(*fixed.PF)), True)
    place = F.when(F.col("at") == 1, "initial").when(F.col("at") == 2, "after 1 glyph").otherwise("deeper")
    return counted(voc(spark, sf_dir).withColumn("at", at).where("at > 0").withColumn("place", place), "corpus", "place")


@query(sql(
    VOC, GLYPHS, f"k as (select corpus, w, cnt, row_number() over (partition by corpus order by cnt desc, w) as rank from gl where {_PF} > 0)",
    select="select k.corpus, k.w, k.cnt, replace(replace(k.w, 'p', 't'), 'f', 'k') as twin, coalesce(v.cnt, 0)::bigint as twin_cnt from k left join voc v on v.corpus = k.corpus and v.w = replace(replace(k.w, 'p', 't'), 'f', 'k') where rank <= 10",
))
def gallows_twins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A43: the most frequent words with p or f, and the words with t and k in their place."""
    v = voc(spark, sf_dir)
    top = lexical.ranked(v.where(glyphs.has_pf(F.col("w")))).where("rank <= 10").withColumn("twin", F.translate("w", "pf", "tk"))
    known = v.select("corpus", F.col("w").alias("twin"), F.col("cnt").alias("twin_cnt"))
    return top.join(known, ["corpus", "twin"], "left").select("corpus", "w", "cnt", "twin", F.coalesce("twin_cnt", F.lit(0)).alias("twin_cnt"))
