"""Binary channels and cryptanalytic statistics. A31, A58-A65."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.words import binary_entropy

BY = ("channel",)


def capacity(bits: DataFrame, by: tuple[str, ...] = BY) -> DataFrame:
    """Events, rate of ones and capacity n H(p) of binary channels (by, bit). A58."""
    p = F.avg(F.col("bit").cast("double"))
    return bits.groupBy(*by).agg(F.count("*").alias("n"), p.alias("p")).withColumn("capacity_bits", F.col("n") * binary_entropy(F.col("p")))


def overdispersion(bits: DataFrame, by: tuple[str, ...] = BY, least: int = 10) -> DataFrame:
    """Variance inflation of page counts over binomial, and its z. A59."""
    pages = bits.groupBy(*by, "page").agg(F.count("*").alias("m"), F.sum("bit").alias("ones"))
    w = Window.partitionBy(*by)
    p = F.sum("ones").over(w) / F.sum("m").over(w)
    each = pages.withColumn("p", p).where(F.col("m") >= least)
    var = F.col("m") * F.col("p") * (1 - F.col("p"))
    chi = F.sum(F.pow(F.col("ones") - F.col("m") * F.col("p"), F.lit(2.0)) / F.nullif(var, F.lit(0.0)))
    df = F.count("*") - 1
    return each.groupBy(*by).agg(F.count("*").alias("n_pages"), (chi / F.nullif(df, F.lit(0))).alias("vif"), ((chi - df) / F.sqrt(2 * F.nullif(df, F.lit(0)))).alias("z"))


def stickiness(bits: DataFrame, order: tuple[str, ...], by: tuple[str, ...] = BY) -> DataFrame:
    """Chance that a bit equals the one before in its page, against independence. A60."""
    prev = F.lag("bit").over(Window.partitionBy(*by, "page").orderBy(*order))
    each = bits.withColumn("prev_bit", prev).groupBy(*by).agg(
        F.count("prev_bit").alias("n"), F.avg(F.col("bit").cast("double")).alias("p"), F.avg((F.col("bit") == F.col("prev_bit")).cast("double")).alias("same")
    )
    each = each.where("n > 0").withColumn("expected", F.col("p") * F.col("p") + (1 - F.col("p")) * (1 - F.col("p")))
    spread = F.sqrt(F.col("expected") * (1 - F.col("expected")) / F.col("n"))
    return each.select(*by, "n", "same", "expected", ((F.col("same") - F.col("expected")) / F.nullif(spread, F.lit(0.0))).alias("z"))


def conditional_entropy(bits: DataFrame, given: tuple[str, ...], by: tuple[str, ...] = BY, least: int = 5) -> DataFrame:
    """Entropy of a bit given columns; groups under ``least`` events count with the overall entropy. A61."""
    each = bits.groupBy(*by, *given).agg(F.count("*").alias("m"), F.sum("bit").alias("ones"))
    w = Window.partitionBy(*by)
    overall = binary_entropy(F.sum("ones").over(w) / F.sum("m").over(w))
    h = F.when(F.col("m") < least, F.col("overall")).otherwise(binary_entropy(F.col("ones") / F.col("m")))
    return each.withColumn("overall", overall).groupBy(*by).agg(F.sum("m").alias("n"), (F.sum(F.col("m") * h) / F.sum("m")).alias("h"))


def kappa(curve: DataFrame, tail: int = 10, by: tuple[str, ...] = ("corpus",)) -> DataFrame:
    """First lag, plateau and highest coincidence rate beyond lag ``tail`` of a lag curve. A63."""
    far = F.when(F.col("lag") > tail, F.col("rate"))
    return curve.groupBy(*by).agg(F.max(F.when(F.col("lag") == 1, F.col("rate"))).alias("kappa_1"), F.avg(far).alias("plateau"), F.max(far).alias("highest"))


def trigram_model(chars: DataFrame, by: tuple[str, ...] = (), smooth: float = 0.5) -> DataFrame:
    """log2 of smoothed trigram shares: (by, tri, logp). A65. ``chars`` has (by, tri, c)."""
    total = F.sum("c").over(Window.partitionBy(*by)) if by else F.sum("c").over(Window.partitionBy(F.lit(1)))
    return chars.select(*by, "tri", F.log2((F.col("c") + smooth) / total.cast("double")).alias("logp"))


def score_trigrams(counts: DataFrame, model: DataFrame, floor: float, by: tuple[str, ...]) -> DataFrame:
    """Bits per trigram of counted trigrams under a model; unseen ones get the floor. A65, R4."""
    j = counts.join(model, "tri", "left")
    return j.groupBy(*by).agg(F.sum("c").alias("n"), (-F.sum(F.col("c") * F.coalesce("logp", F.lit(floor))) / F.sum("c")).alias("bits_per_char"))


def word_trigrams(toks: DataFrame, by: tuple[str, ...] = ("corpus",)) -> DataFrame:
    """Character trigrams of the words between blanks, counted on the vocabulary: (by, tri, c)."""
    from .lexical import vocab

    padded = F.concat(F.lit(" "), F.col("w"), F.lit(" "))
    each = F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3)))
    return vocab(toks, by).where("length(w) > 0").select(*by, "cnt", F.explode(each).alias("tri")).groupBy(*by, "tri").agg(F.sum("cnt").alias("c"))


def letters_per_word(h_word: Column, bits_per_letter: Column, share: float = 0.3) -> Column:
    """Letters that a word's free capacity could carry, at a usable share. A31."""
    return share * h_word / bits_per_letter
