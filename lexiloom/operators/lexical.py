"""Vocabulary, entropy and lexical laws. A1-A5, A17-A22, A62.

Functions take a token table and grouping columns ``by``; word-local metrics start from the
vocabulary with counts, never from tokens, so a frequent word is one weighted row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BY = ("corpus",)


def vocab(toks: DataFrame, by: tuple[str, ...] = BY) -> DataFrame:
    """(by, w, cnt); a vocabulary with counts stands for its tokens."""
    if "cnt" in toks.columns:
        return toks.groupBy(*by, "w").agg(F.sum("cnt").alias("cnt"))
    return toks.groupBy(*by, "w").agg(F.count("*").alias("cnt"))


def ranked(voc: DataFrame, by: tuple[str, ...] = BY) -> DataFrame:
    """Adds rank by falling count, ties by word."""
    return voc.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("cnt"), "w")))


def top(toks: DataFrame, k: int, by: tuple[str, ...] = BY) -> DataFrame:
    """The ``k`` most frequent words of each group. Plans as a window group limit."""
    return ranked(vocab(toks, by), by).where(F.col("rank") <= k)


def top_overall(toks: DataFrame, k: int) -> DataFrame:
    """The ``k`` most frequent words: plans as TakeOrderedAndProject."""
    return toks.groupBy("w").agg(F.count("*").alias("cnt")).orderBy(F.desc("cnt"), "w").limit(k)


def counts(toks: DataFrame, by: tuple[str, ...] = BY) -> DataFrame:
    """Tokens, types, hapax share of types and share of the most frequent word. A1-A3."""
    n = F.sum("cnt")
    return vocab(toks, by).groupBy(*by).agg(
        n.alias("n_tokens"), F.count("*").alias("n_types"), F.avg((F.col("cnt") == 1).cast("double")).alias("hapax_share"), (F.max("cnt") / n).alias("top1_share"),
        (F.count("*") / n).alias("ttr"),
    )


def entropy_of(counts: DataFrame, by: tuple[str, ...], n: str = "cnt") -> DataFrame:
    """Entropy in bits of counts, plain and with the Miller-Madow correction. A4, A4b.

    One aggregate: -sum(c/N log c/N) = log N - sum(c log c)/N.
    """
    total, c = F.sum(n), F.col(n).cast("double")
    h = F.log2(total) - F.sum(c * F.log2(c)) / total
    return counts.groupBy(*by).agg(total.alias("n"), F.count("*").alias("m"), h.alias("h"), (h + (F.count("*") - 1) / (2 * total * F.ln(F.lit(2.0)))).alias("h_mm"))


def word_entropy(toks: DataFrame, by: tuple[str, ...] = BY) -> DataFrame:
    return entropy_of(vocab(toks, by), by)


def entropy_given(toks: DataFrame, given: str, by: tuple[str, ...] = BY) -> DataFrame:
    """Word entropy given a column: sections weighted by size. A4c."""
    each = entropy_of(vocab(toks, (*by, given)), (*by, given))
    return each.groupBy(*by).agg((F.sum(F.col("n") * F.col("h_mm")) / F.sum("n")).alias("h_given"))


def edges(toks: DataFrame, by: tuple[str, ...] = BY, order: tuple[str, ...] = ("page", "pos")) -> DataFrame:
    """First and last word of each group in corpus order, by partial aggregates."""
    at = F.struct(*order, "w")
    return toks.groupBy(*by).agg(F.min(at)["w"].alias("first_w"), F.max(at)["w"].alias("last_w"))


def char_bigrams(toks: DataFrame, by: tuple[str, ...] = BY, order: tuple[str, ...] = ("page", "pos"), voc: DataFrame | None = None) -> DataFrame:
    """(by, a, b, cnt) of characters of the words joined by dots.

    Counted on the vocabulary: bigrams of ``.w.`` weighted by count, less the two that the
    joined text lacks at its ends. No global order is needed.
    """
    dotted = F.concat(F.lit("."), F.col("w"), F.lit("."))
    pairs = F.transform(F.sequence(F.lit(1), F.length(dotted) - 1), lambda i: F.struct(F.substring(dotted, i, F.lit(1)).alias("a"), F.substring(dotted, i + 1, F.lit(1)).alias("b")))
    inner = vocab(toks if voc is None else voc, by).select(*by, "cnt", F.explode(pairs).alias("p")).select(*by, "p.a", "p.b", "cnt")
    e = edges(toks, by, order)
    less = e.select(*by, F.inline(F.array(
        F.struct(F.lit(".").alias("a"), F.substring("first_w", 1, 1).alias("b")), F.struct(F.substring("last_w", -1, 1).alias("a"), F.lit(".").alias("b"))
    )), F.lit(-1).cast("long").alias("cnt"))
    return inner.unionByName(less.select(*by, "a", "b", "cnt")).groupBy(*by, "a", "b").agg(F.sum("cnt").alias("cnt")).where("cnt > 0")


def char_h1(toks: DataFrame, by: tuple[str, ...] = BY) -> DataFrame:
    """Entropy of single characters of the dot-joined text. A4."""
    each = vocab(toks, by).select(*by, "cnt", F.explode(F.split(F.concat("w", F.lit(".")), "")).alias("c")).where("c <> ''")
    # one dot less than words: the joined text has none behind its last word
    n = each.groupBy(*by, "c").agg(F.sum("cnt").alias("cnt")).withColumn("cnt", F.when(F.col("c") == ".", F.col("cnt") - 1).otherwise(F.col("cnt"))).where("cnt > 0")
    return entropy_of(n, by).select(*by, F.col("h").alias("h1"))


def char_h2(toks: DataFrame, by: tuple[str, ...] = BY, order: tuple[str, ...] = ("page", "pos"), voc: DataFrame | None = None) -> DataFrame:
    """Entropy of a character given the one before. A5."""
    c = F.col("cnt").cast("double")
    firsts = char_bigrams(toks, by, order, voc).groupBy(*by, "a").agg(F.sum("cnt").alias("n"), F.sum(c * F.log2(c)).alias("s"))
    n = F.col("n").cast("double")
    return firsts.groupBy(*by).agg(((F.sum(n * F.log2(n)) - F.sum("s")) / F.sum("n")).alias("h2"))


def normalisation(toks: DataFrame, by: tuple[str, ...] = BY) -> DataFrame:
    """The text as it is and normalised (m as ir, a line's first y off where the rest is a word):
    (by, form, n_types, hapax_share, h_words, h2, n_merged). A42, P15, P16.

    ``n_merged`` counts types that the normalised text doesn't have any more. What becomes of a word
    depends on the word and on whether it opens a line, so types with that mark stand for tokens;
    only the tokens of each group's first and last page are read again, for the text's ends.
    """
    from .. import stage
    from ..functions import words

    page = F.col("page")
    marked = toks.withColumn("opens_", F.col("word_idx") == 0)
    voc = marked.groupBy(*by, "w", "opens_").agg(F.count("*").alias("cnt"), F.min(page).alias("low_"), F.max(page).alias("high_"))
    voc = stage.written(voc, "types")
    limits = voc.groupBy(*by).agg(F.min("low_").alias("low_"), F.max("high_").alias("high_"))
    limits = limits.select(*by, F.explode(F.array("low_", "high_")).alias("page")).distinct().withColumnsRenamed({c: f"{c}_r" for c in (*by, "page")})
    here = F.lit(True)
    for c in (*by, "page"):
        here &= F.col(c).eqNullSafe(F.col(f"{c}_r"))
    outer = marked.join(F.broadcast(limits), here, "left_semi").select(*by, "page", "pos", "w", "opens_", F.lit(0).cast("long").alias("cnt"))
    slim = (*by, "page", "pos", "w", "opens_", "cnt")
    each = voc.select(*by, F.lit(None).cast(toks.schema["page"].dataType).alias("page"), F.lit(None).cast(toks.schema["pos"].dataType).alias("pos"), "w", "opens_", "cnt").unionByName(outer)
    known = voc.select(*by, F.col("w").alias("rest"), F.lit(True).alias("known")).distinct()
    each = each.withColumn("rest", F.expr("substring(w, 2)")).join(known, [*by, "rest"], "left")
    stripped = words.strip_initial_y(F.col("w"), F.col("opens_"), F.coalesce("known", F.lit(False)))
    forms = F.array(F.struct(F.lit("raw").alias("form"), F.col("w")), F.struct(F.lit("normalised").alias("form"), words.m_to_ir(stripped).alias("w")))
    both = stage.written(each.select(*[c for c in slim if c not in ("w", "opens_")], F.inline(forms)), "forms")
    keys = (*by, "form")
    voc = vocab(both.where("cnt > 0"), keys)
    types = counts(voc, keys).select(*keys, "n_types", "hapax_share")
    entropy = entropy_of(voc, keys).select(*keys, F.col("h").alias("h_words"))
    lost = voc.where("form = 'raw'").join(voc.where("form = 'normalised'").select(*by, "w"), [*by, "w"], "left_anti").groupBy(*by).agg(F.count("*").alias("lost")).withColumn("form", F.lit("normalised"))
    out = joined_by(joined_by(types, entropy, keys), char_h2(both.where("cnt = 0"), keys, voc=voc), keys)
    return out.join(lost, list(keys), "left").select(*keys, "n_types", "hapax_share", "h_words", "h2", F.coalesce("lost", F.lit(0)).alias("n_merged"))


def zipf(toks: DataFrame, by: tuple[str, ...] = BY, k: int = 1000) -> DataFrame:
    """Slope of log count on log rank over the ``k`` most frequent words. A17."""
    return top(toks, k, by).groupBy(*by).agg(F.regr_slope(F.ln(F.col("cnt").cast("double")), F.ln(F.col("rank").cast("double"))).alias("zipf_slope"))


#: Ranges of pages that running sums are split into.
RANGES = 200


def page_starts(sizes: DataFrame, by: tuple[str, ...] = BY) -> DataFrame:
    """(by, page, range_, start): the sum of ``n`` over the group's lesser pages, of (by, page, n).

    Two levels, so no task sums up all pages: pages are dealt to ranges between :data:`RANGES`
    of them that have the least hashes, sums go over ranges and over the pages in each.
    """
    lot = Window.partitionBy(*by).orderBy(F.xxhash64("page"), "page")
    chosen = sizes.select(*by, "page", F.row_number().over(lot).alias("k_")).where(F.col("k_") <= RANGES)
    cuts = chosen.groupBy(*by).agg(F.sort_array(F.collect_list("page")).alias("cuts_"))
    each = joined_by(sizes.select(*by, "page", "n"), cuts, by)
    each = each.withColumn("range_", F.size(F.filter("cuts_", lambda c: c <= F.col("page")))).drop("cuts_")
    before = lambda *k, order: F.coalesce(F.sum("n").over(Window.partitionBy(*k).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = each.groupBy(*by, "range_").agg(F.sum("n").alias("n")).select(*by, "range_", before(*by, order="range_").alias("lower_"))
    inside = each.withColumn("inside_", before(*by, "range_", order="page"))
    return joined_by(inside, ranges, (*by, "range_")).select(*by, "page", "range_", (F.col("lower_") + F.col("inside_")).alias("start"))


def joined_by(left: DataFrame, right: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Join on columns that may be null; adaptive execution broadcasts a side that turns out small."""
    renamed = right.withColumnsRenamed({c: f"{c}_r" for c in by})
    condition = F.lit(True)
    for c in by:
        condition &= F.col(c).eqNullSafe(F.col(f"{c}_r"))
    return left.join(renamed, condition).drop(*[f"{c}_r" for c in by])


def global_positions(toks: DataFrame, by: tuple[str, ...] = BY) -> DataFrame:
    """Adds gpos: pages before plus position. Running sums are over pages, not words, in two levels.

    Tokens that were placed before their pages came apart (``tables.placed``) have it already.
    """
    if "gpos" in toks.columns:
        return toks
    starts = page_starts(toks.groupBy(*by, "page").agg(F.count("*").alias("n")), by)
    return toks.join(starts.select(*by, "page", F.col("start").alias("start_")), [*by, "page"]).withColumn("gpos", F.col("start_") + F.col("pos")).drop("start_")


def numbered(toks: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Adds i: the row's number in its group, by page and position; counted per page first."""
    starts = page_starts(toks.groupBy(*by, "page").agg(F.count("*").alias("n")), by)
    rank = F.row_number().over(Window.partitionBy(*by, "page").orderBy("pos")) - 1
    return toks.withColumn("rank_", rank).join(starts.select(*by, "page", "start"), [*by, "page"]).withColumn("i", F.col("start") + F.col("rank_")).drop("rank_", "start")


def heaps(toks: DataFrame, by: tuple[str, ...] = BY, least: int = 256) -> DataFrame:
    """Slope of log vocabulary on log length at powers of two from ``least``. A18.

    First occurrences are counted into the power of two that first covers them, so one small
    table of powers is summed up.
    """
    g = global_positions(toks, by)
    size = g.groupBy(*by).agg(F.count("*").alias("total"))
    first = g.groupBy(*by, "w").agg(F.min("gpos").alias("g"))
    k = F.greatest(F.ceil(F.log2((F.col("g") + 1).cast("double"))), F.lit(0)).cast("int")
    found = first.withColumn("k", k).groupBy(*by, "k").agg(F.count("*").alias("n"))
    powers = size.select(*by, "total", F.explode(F.sequence(F.lit(0), F.floor(F.log2(F.col("total").cast("double"))).cast("int"))).alias("k"))
    grown = powers.join(found, [*by, "k"], "left").withColumn("v", F.sum(F.coalesce("n", F.lit(0))).over(Window.partitionBy(*by).orderBy("k")))
    points = grown.where(F.pow(F.lit(2.0), "k") >= least)
    return points.groupBy(*by).agg(F.regr_slope(F.ln(F.col("v").cast("double")), F.ln(F.pow(F.lit(2.0), "k"))).alias("heaps_beta"))


#: Bits of a position that the levels of :func:`gaps` leave out: the most words between two of a level's rows.
LEVELS = (14, 28)


def gaps(placed: DataFrame, by: tuple[str, ...] = BY, cells: bool = False) -> DataFrame:
    """(by, w, n, first, last, squares) of (by, w, gpos): the squares of the gaps between occurrences, summed.

    Gaps are summed inside ranges of positions, then between them, then between ranges of ranges,
    so a frequent word is never one task's window. With ``cells`` the first ranges are the rows' ``cell_``.
    """
    each = placed.select(*by, *(["cell_"] if cells else []), "w", F.col("gpos").alias("first"), F.col("gpos").alias("last"), F.lit(1).cast("long").alias("n"), F.lit(0.0).alias("squares"))
    for k, bits in enumerate((*LEVELS, None)):
        level = by if bits is None else (*by, "cell_")
        each = each if bits is None or cells and k == 0 else each.withColumn("cell_", F.shiftright("first", bits))
        gap = (F.col("first") - F.lag("last").over(Window.partitionBy(*level, "w").orderBy("first"))).cast("double")
        each = each.withColumn("gap", F.coalesce(gap, F.lit(0.0))).groupBy(*level, "w").agg(
            F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"), F.sum(F.col("squares") + F.col("gap") * F.col("gap")).alias("squares")
        )
    return each


def variation(placed: DataFrame, by: tuple[str, ...] = BY, least: int = 15, cells: bool = False) -> DataFrame:
    """(by, w, n, cv) of (by, w, gpos): deviation over mean of the gaps. A19."""
    return _cv(gaps(placed, by, cells), (*by, "w"), least).select(*by, "w", "n", "cv")


def _cv(summed: DataFrame, keys: tuple[str, ...], least: int) -> DataFrame:
    between = F.nullif((F.col("n") - 1).cast("double"), F.lit(0.0))
    mean = (F.col("last") - F.col("first")) / between
    variance = F.greatest(F.col("squares") / between - mean * mean, F.lit(0.0))
    return summed.where(F.col("n") >= least).select(*keys, "n", (F.sqrt(variance) / mean).alias("cv"))


def burstiness(toks: DataFrame, by: tuple[str, ...] = BY, least: int = 15) -> DataFrame:
    """(by, w, n, cv): deviation over mean of the gaps between occurrences. A19."""
    return variation(global_positions(toks, by), by, least)


def burstiness_summary(cv: DataFrame, by: tuple[str, ...] = BY) -> DataFrame:
    """Upper median and share over 1.3 of the words' variation. A20."""
    from .. import stage
    from . import order

    cv = stage.written(cv, "variation")
    median = order.upper_median(cv, by, "cv").select(*by, F.col("value").alias("median_cv"))
    counted = cv.groupBy(*by).agg(F.count("*").alias("n_words"), F.avg((F.col("cv") > 1.3).cast("double")).alias("share_over_1_3"))
    return joined_by(counted, median, by).select(*by, "n_words", "median_cv", "share_over_1_3")


def shuffled_medians(toks: DataFrame, rounds: int = 10, by: tuple[str, ...] = BY, least: int = 15, whole: bool = False) -> DataFrame:
    """The upper median of A20 beside its mean, least and greatest over corpora shuffled as a whole. A20, N5.

    Words with ``least`` occurrences are numbered; of the others only places count. ``whole`` as for
    :func:`.tallies.tallied`.
    """
    from .. import stage
    from . import bursts, order, scan

    keys = (*by, "round")
    voc = stage.written(vocab(toks, by), "vocabulary")
    sizes = {tuple(r)[:-1]: r[-1] for r in voc.groupBy(*by).agg(F.sum("cnt").alias("n")).collect()}
    ids = voc.where(F.col("cnt") >= least).select(*by, "w", (F.row_number().over(Window.partitionBy(*by).orderBy("w")) - 1).alias("id"))
    ids = stage.written(ids, "numbers")
    small = ids.limit(bursts.NUMBERED + 1).count() <= bursts.NUMBERED
    placed = scan.joined_by_left(global_positions(toks, by).select(*by, "page", "pos", "w", "gpos"), F.broadcast(ids) if small else ids, (*by, "w"))
    each = bursts.gaps(placed.drop("w"), sizes, rounds, by, whole and small)
    medians = order.upper_median(_cv(each, keys, least).select(*keys, "cv"), keys, "cv")
    null = F.when(F.col("round") > 0, F.col("value"))
    return medians.groupBy(*by).agg(F.max(F.when(F.col("round") == 0, F.col("value"))).alias("median_cv"), F.avg(null).alias("null_mean"), F.min(null).alias("null_least"), F.max(null).alias("null_most"))


def burstiness_bands(cv: DataFrame, by: tuple[str, ...] = BY) -> DataFrame:
    """The same by frequency band."""
    band = F.when(F.col("n") <= 30, "15-30").when(F.col("n") <= 100, "31-100").otherwise("100+")
    return burstiness_summary(cv.withColumn("band", band), (*by, "band"))


def length_histogram(toks: DataFrame, by: tuple[str, ...] = BY) -> DataFrame:
    """Tokens by word length. A21."""
    return vocab(toks, by).groupBy(*by, F.length("w").alias("len")).agg(F.sum("cnt").alias("n"))


def coincidence(toks: DataFrame, by: tuple[str, ...] = BY) -> DataFrame:
    """Index of coincidence and the sum of squared shares of words. A62."""
    c, n = F.col("cnt").cast("double"), F.sum("cnt").cast("double")
    return vocab(toks, by).groupBy(*by).agg((F.sum(c * (c - 1)) / (n * (n - 1))).alias("ic"), (F.sum(c * c) / (n * n)).alias("sum_p2"))
