"""Position in line and paragraph. A32-A35, A43-A47, A66, A67."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import nulls, tallies

BY = ("corpus",)


def role() -> Column:
    """first, last or mid in the line; a one-word line is first only."""
    return F.when(F.col("word_idx") == 0, "first").when(F.col("word_idx") == F.col("line_len") - 1, "last").otherwise("mid")


def tv_distance(counts: DataFrame, key: str, side: Column, by: tuple[str, ...] = BY, n: str = "c") -> DataFrame:
    """Total variation of two distributions over ``key``; ``side`` is true, false or null. A32, J6.

    One aggregate by key with conditional sums, instead of a full outer join.
    """
    each = counts.withColumn("side", side).where("side is not null").groupBy(*by, key).agg(F.sum(F.when(F.col("side"), F.col(n)).otherwise(0)).alias("l"), F.sum(F.when(~F.col("side"), F.col(n)).otherwise(0)).alias("r"))
    w = Window.partitionBy(*by)
    share = each.withColumns({"ls": F.sum("l").over(w).cast("double"), "rs": F.sum("r").over(w).cast("double")})
    return share.groupBy(*by).agg((F.sum(F.abs(F.col("l") / F.col("ls") - F.col("r") / F.col("rs"))) / 2).alias("tv"))


def _edge_tv(toks: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """(by, side, tv) of line starts (first characters) and line ends (last ones), counted in one pass."""
    ends = F.array(
        F.struct(F.lit("start").alias("side_of"), F.substring("w", 1, 1).alias("c1"), F.when(role() != "last", role() == "first").alias("at_edge")),
        F.struct(F.lit("end").alias("side_of"), F.substring("w", -1, 1).alias("c1"), F.when(role() != "first", role() == "last").alias("at_edge")),
    )
    counts = toks.select(*by, F.inline(ends)).groupBy(*by, "side_of", "c1", "at_edge").agg(F.count("*").alias("c"))
    return tv_distance(counts, "c1", F.col("at_edge"), (*by, "side_of"))


def _wide(rows: DataFrame, by: tuple[str, ...], names: dict[str, str]) -> DataFrame:
    """start and end side by side: columns ``{new}_start`` and ``{new}_end`` of each named column."""
    cells = [F.max(F.when(F.col("side_of") == k, F.col(c))).alias(f"{new}_{k}") for c, new in names.items() for k in ("start", "end")]
    return rows.groupBy(*by).agg(*cells)


def positional_tv(toks: DataFrame, by: tuple[str, ...] = BY) -> DataFrame:
    """How line starts and line ends differ from mid-line: first and last characters. A32."""
    return _wide(_edge_tv(toks, by), by, {"tv": "tv"})


def edges_kept() -> dict[str, Column]:
    """Whether a place is at its line's start or in its middle (null: at its end), and the same of ends."""
    return {"start": F.when(role() != "last", role() == "first"), "end": F.when(role() != "first", role() == "last")}


def edges_moved() -> dict[str, Column]:
    return {"first": F.substring("w", 1, 1), "last": F.substring("w", -1, 1)}


def edge_tallies(n: int) -> list[tallies.Tally]:
    return [tallies.Tally("start", "slot", "start", "first", n), tallies.Tally("end", "slot", "end", "last", n)]


def edge_counts(counted: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """(by, round, side_of, tv) of the counts of :func:`edge_tallies`."""
    keys = (*by, "round", "side_of")
    each = counted.where("kind in ('start', 'end')").select(*by, "round", F.col("kind").alias("side_of"), F.col("b").alias("c1"), (F.col("a") == "true").alias("at_edge"), "c")
    return tv_distance(each, "c1", F.col("at_edge"), keys)


def positional_z(toks: DataFrame, n: int = 10, by: tuple[str, ...] = BY, within: tuple[str, ...] = ("corpus", "page"), whole: bool = False) -> DataFrame:
    """The same against permutations that keep the layout; ``whole`` as for :func:`.tallies.tallied`. A33."""
    counted = nulls.refilled(toks, n, within, count=lambda n: tallies.tallied(toks, by, within, edges_kept(), edges_moved(), edge_tallies(n), whole))
    return edge_z(edge_counts(counted, by), by)


def edge_z(each: DataFrame, by: tuple[str, ...] = BY) -> DataFrame:
    """z of the distances (by, round, side_of, tv), start and end side by side."""
    from .pairs import excess

    return _wide(excess(each, "tv", (*by, "side_of")), by, {"real": "tv", "z": "z"}).select(*by, "tv_start", "z_start", "tv_end", "z_end")


def feature_rates(toks: DataFrame, features: dict[str, Column], slot: Column, by: tuple[str, ...] = BY) -> DataFrame:
    """Share of words with each feature, by slot: (by, slot, feature, n, rate). A34."""
    bits = F.array(*[F.struct(F.lit(k).alias("feature"), F.coalesce(v, F.lit(False)).cast("double").alias("hit")) for k, v in features.items()])
    each = toks.withColumn("slot", slot).where("slot is not null").select(*by, "slot", F.inline(bits))
    return each.groupBy(*by, "slot", "feature").agg(F.count("*").alias("n"), F.avg("hit").alias("rate"))


def feature_z(toks: DataFrame, features: dict[str, Column], slot: Column, n: int = 20, by: tuple[str, ...] = BY, within: tuple[str, ...] = ("corpus", "page"), least: float | None = None, whole: bool = False) -> DataFrame:
    """Rates against layout-keeping permutations; ``least`` filters by absolute z. A34, F7.

    Features are of words, slots of places; ``whole`` as for :func:`.tallies.tallied`.
    """
    from .pairs import excess

    marks = F.concat(*[F.when(v, "1").otherwise("0") for v in features.values()])
    counted = nulls.refilled(toks, n, within, count=lambda n: tallies.tallied(toks, by, within, {"slot": slot}, {"marks": marks}, [tallies.Tally("slot", "slot", "slot", "marks", n)], whole))
    hits = F.array(*[F.struct(F.lit(k).alias("feature"), (F.substring("b", i + 1, 1) == "1").alias("hit")) for i, k in enumerate(features)])
    each = counted.select(*by, "round", F.col("a").alias("slot"), "c", F.inline(hits))
    each = each.groupBy(*by, "round", "slot", "feature").agg(F.sum("c").alias("n"), (F.sum(F.when(F.col("hit"), F.col("c")).otherwise(0)) / F.sum("c").cast("double")).alias("rate"))
    out = excess(each, "rate", (*by, "slot", "feature"))
    return out if least is None else out.where(F.abs("z") >= least)


def length_by_role(toks: DataFrame, length: Column, by: tuple[str, ...] = BY) -> DataFrame:
    """Mean word length by line position. A35."""
    return toks.groupBy(*by, role().alias("role")).agg(F.avg(length).alias("mean_length"), F.count("*").alias("n"))


def bin_shares(toks: DataFrame, cls: Column, bins: int = 5, least: int = 6, by: tuple[str, ...] = BY) -> DataFrame:
    """Class shares by relative position in lines of ``least`` words or more. A47."""
    b = F.least(F.lit(bins - 1), F.floor(F.col("word_idx").cast("double") / F.col("line_len") * bins)).cast("int")
    each = toks.where(F.col("line_len") >= least).groupBy(*by, b.alias("bin"), cls.alias("cls")).agg(F.count("*").alias("n"))
    return each.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*by, "bin")))


def lines(toks: DataFrame) -> DataFrame:
    """(corpus, page, line_idx, ws) with words in order. S19."""
    ws = F.transform(F.array_sort(F.collect_list(F.struct("word_idx", "w"))), lambda s: s["w"])
    return toks.groupBy("corpus", "page", "line_idx").agg(ws.alias("ws"))


def pearson(x: Column, y: Column) -> Column:
    """Correlation, null where a side doesn't vary."""
    return F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0))


def corr_last_vs_rest(line_rows: DataFrame, by: tuple[str, ...] = BY, at: int = -1, least_words: int = 4, least_rows: int = 30) -> DataFrame:
    """Correlation of a word's length with the rest of its line, within lines of equal word counts. A66.

    Groups under ``least_rows`` are skipped but stay in the total that weights are shares of.
    ``at`` is the word's place: -1 for the last, 0-based otherwise (null: the middle one).
    """
    return _weighted_corr(_line_lengths(line_rows, at, least_words), by, least_rows)


def _line_lengths(line_rows: DataFrame, at: int | None, least_words: int) -> DataFrame:
    """The lines with x, the length of the word at a place, and y, that of the other words."""
    n = F.size("ws")
    total = F.aggregate("ws", F.lit(0), lambda a, w: a + F.length(w))
    x = F.length(F.element_at("ws", -1)) if at == -1 else F.length(F.get("ws", F.floor(n / 2).cast("int") if at is None else F.lit(at)))
    return line_rows.where(n >= least_words).withColumns({"n_words": n, "x": x.cast("double"), "y": (total - x).cast("double")}).drop("ws")


def _weighted_corr(each: DataFrame, by: tuple[str, ...], least_rows: int) -> DataFrame:
    group = each.groupBy(*by, "n_words").agg(F.count("*").alias("n"), F.coalesce(pearson(F.col("x"), F.col("y")), F.lit(0.0)).alias("r"))
    group = group.withColumn("all_n", F.sum("n").over(Window.partitionBy(*by)))
    return group.where(F.col("n") >= least_rows).groupBy(*by).agg(F.sum(F.col("r") * F.col("n") / F.col("all_n")).alias("r"))


def corr_z(line_rows: DataFrame, rounds: int = 10, by: tuple[str, ...] = BY, least_words: int = 4, least_rows: int = 30) -> DataFrame:
    """The last word's correlation against rounds that deal last words anew among lines of equal
    word counts, and the middle word's as a control: (by, r_last, null_mean, z, r_mid). A66, N7.

    Lines and last words are numbered by md5 in two orders, densely in each group, and meet on
    the number: groups may be as large as a corpus.
    """
    from .lexical import joined_by
    from .order import dense
    from .pairs import excess

    group = (*by, "n_words")
    each = _line_lengths(line_rows, -1, least_words)
    slots = dense(each.select(*group, "page", "line_idx", "y"), group, nulls.key(F.lit(0), "page", "line_idx"), ("page", "line_idx"))
    drawn = dense(nulls.rounds(each.select(*group, "page", "line_idx", "x"), rounds, False), (*group, "round"), nulls.key("round", "page", "line_idx"), ("page", "line_idx"))
    dealt = nulls.rounds(slots.select(*group, "i", "y"), rounds, False).join(drawn.select(*group, "round", "i", "x"), [*group, "round", "i"])
    real = each.select(*group, F.lit(0).alias("round"), "x", "y")
    rates = _weighted_corr(real.unionByName(dealt.select(*group, "round", "x", "y")), (*by, "round"), least_rows)
    mid = corr_last_vs_rest(line_rows, by, None, least_words, least_rows).select(*by, F.col("r").alias("r_mid"))
    return joined_by(excess(rates, "r", by), mid, by).select(*by, F.col("real").alias("r_last"), "null_mean", "z", "r_mid")


def tercile_rates(line_rows: DataFrame, hit: Column, by: tuple[str, ...] = BY, least: int = 30) -> DataFrame:
    """Rate of a line feature by fullness tercile among lines of equal word counts; the last tercile takes what is left over. A67."""
    n, size = F.size("ws"), F.aggregate("ws", F.lit(0), lambda a, w: a + F.length(w))
    each = line_rows.select(*by, "page", "line_idx", n.alias("n_words"), size.alias("size"), hit.cast("double").alias("hit"))
    # a size between the cuts of its group needs no ranks; only the two that a cut goes through do
    sizes = each.groupBy(*by, "n_words", "size").agg(F.count("*").alias("c"), F.sum("hit").alias("hits"))
    group = Window.partitionBy(*by, "n_words")
    sizes = sizes.withColumns({"before": F.sum("c").over(group.orderBy("size")) - F.col("c"), "n": F.sum("c").over(group)}).where(F.col("n") >= least)
    of = lambda place: F.least(F.lit(2), F.floor(place / F.floor(F.col("n") / 3))).cast("int")
    sizes = sizes.withColumns({"low": of(F.col("before")), "high": of(F.col("before") + F.col("c") - 1)})
    whole = sizes.where("low = high").select(*by, F.col("low").alias("tercile"), F.col("c").alias("n"), "hits")
    rank = F.row_number().over(Window.partitionBy(*by, "n_words", "size").orderBy("page", "line_idx"))
    torn = each.join(sizes.where("low < high").select(*by, "n_words", "size", "before", "n"), [*by, "n_words", "size"]).withColumn("place", F.col("before") + rank - 1)
    torn = torn.select(*by, of(F.col("place")).alias("tercile"), F.lit(1).cast("long").alias("n"), F.col("hit").alias("hits"))
    return whole.unionByName(torn).groupBy(*by, "tercile").agg(F.sum("n").alias("n"), (F.sum("hits") / F.sum("n")).alias("rate"))


def share_by(toks: DataFrame, hit: Column, by: tuple[str, ...]) -> DataFrame:
    """Share of words with a property by any columns. A43, A44, A49."""
    return toks.groupBy(*by).agg(F.count("*").alias("n"), F.avg(hit.cast("double")).alias("share"))


def cross_line_sharing(toks: DataFrame, by: tuple[str, ...] = BY) -> DataFrame:
    """Share of a corpus's words that another line of it has too. A45, J13.

    Counting distinct lines per word decides it: no loop over pairs of lines.
    """
    per = toks.groupBy(*by, "w").agg(F.count("*").alias("n"), F.countDistinct("page", "line_idx").alias("n_lines"))
    return per.groupBy(*by).agg(F.sum("n").alias("n_tokens"), (F.sum(F.when(F.col("n_lines") >= 2, F.col("n")).otherwise(0)) / F.sum("n")).alias("shared"))


def sampled_sharing(line_rows: DataFrame, kind: Column, rounds: int = 30, by: tuple[str, ...] = BY) -> DataFrame:
    """Mean and deviation, over rounds, of the share of words that another line of the same kind has,
    in samples of as many lines of each kind as the rarest kind has. A45, N8.

    Samples are the lines with the least hashes. Lines are hashed where they are, in numpy: counts of
    hash ranges tell the range that a sample's end falls into, that range's hashes tell the last one, and
    then a line's words are counted for the rounds that take it. Only counts move. A kind that is taken whole
    is the same in every round and counted once.
    """
    from .. import stage
    from . import sampled
    from .lexical import joined_by

    group = (*by, "kind")
    lines_ = stage.written(line_rows.withColumn("kind", kind).where("kind is not null").select(*group, "page", "line_idx", "ws"), "lines")
    counts = stage.written(lines_.groupBy(*group).agg(F.count("*").alias("n")), "counts")
    sizes = counts.groupBy(*by).agg(F.min("n").alias("least_"))
    known = joined_by(counts, sizes, by).select(*group, "n", "least_").collect()  # a row a group
    per = sampled.words(lines_, group, [tuple(r)[:-2] for r in known], [(r.n, r.least_) for r in known], rounds)
    shares = per.groupBy("group_", "round").agg((F.sum(F.when(F.col("n_lines") >= 2, F.col("n")).otherwise(0)) / F.sum("n").cast("double")).alias("shared"))
    out = shares.groupBy("group_").agg(F.avg("shared").alias("shared"), F.stddev_pop("shared").alias("deviation"))
    numbers = counts.sparkSession.createDataFrame([(*tuple(r)[:-2], k, r.least_) for k, r in enumerate(known)], ", ".join([*[f"`{c}` {counts.schema[c].dataType.simpleString()}" for c in group], "group_ int, least_ long"]))
    return numbers.join(out, "group_").select(*by, "kind", F.col("least_").alias("n_lines"), "shared", "deviation")


def cohesion(toks: DataFrame, by: tuple[str, ...] = BY, least_body: int = 0) -> DataFrame:
    """Share of words of a page's first line that its other lines have, and that a partner page's have. A46, A50, J12.

    ``least_body`` words a page needs in its other lines to take part, as itself or as a partner. F8.
    """
    if least_body:
        long = toks.where("line_idx > 0").groupBy(*by, "page").agg(F.count("*").alias("n")).where(F.col("n") >= least_body)
        toks = toks.join(long.select(*by, "page"), [*by, "page"], "left_semi")
    first = toks.where("line_idx = 0").select(*by, "page", "w")
    body = toks.where("line_idx > 0").select(*by, "page", "w").distinct()
    partner = nulls.partner(toks.select(by[0], "page"), by[0], "page")
    both = first.join(partner, [by[0], "page"])
    own = both.join(body.withColumn("own", F.lit(1.0)), [*by, "page", "w"], "left")
    other = own.join(body.select(*by, F.col("page").alias("partner"), "w", F.lit(1.0).alias("other")), [*by, "partner", "w"], "left")
    return other.groupBy(*by).agg(F.count("*").alias("n"), F.avg(F.coalesce("own", F.lit(0.0))).alias("own_page"), F.avg(F.coalesce("other", F.lit(0.0))).alias("other_page"))
