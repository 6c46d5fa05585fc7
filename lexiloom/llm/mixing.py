"""Mixing sources to target weights by Poisson replication, in DataFrame functions only.

Each source gets a mean repetition rate: target share of the output's characters, divided by
the source's own characters. A document's number of copies is the Poisson quantile of a
uniform that is a hash of seed and id, so it doesn't depend on partitioning, retries or
order. Copies are then shuffled globally by a hash key.

Defined cases. A null source is a source of its own. A null id hashes as the word ``null``;
repeated ids get equal counts, whatever their texts (so ties and repeated rows are drawn
alike). Null or empty text counts as one character, so no source has size zero; a very long
text is a row like any other. Sources without a weight aren't drawn. Empty table: no rows.
Extra columns are carried along, whatever their names; the new ones, ``copy`` and
``n_copies``, replace columns of these names. The counts don't depend on the partitioning,
the order of the output does.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import scratch

#: Rates are broadcast up to so many bytes of quantile tables, checked; beyond, a shuffle join.
BROADCAST_BYTES = 32 << 20
HASH_DIGITS = 13


def uniform(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) of 52 bits of the md5 of seed and keys."""
    text = F.concat_ws("|", F.lit(str(seed)), *[F.coalesce(k.cast("string"), F.lit("null")) for k in keys])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, HASH_DIGITS), 16, 10).cast("double") / F.lit(float(16**HASH_DIGITS))


def source_sizes(docs: DataFrame) -> DataFrame:
    """Characters of each source; a partial aggregate goes before the shuffle."""
    size = F.greatest(F.coalesce(F.length(F.col("text").cast("string")), F.lit(1)), F.lit(1)).cast("long")
    return docs.groupBy(F.col("source").cast("string").alias("mix_source")).agg(F.sum(size).alias("chars"))


def tempered(sizes: DataFrame, exponent: float) -> DataFrame:
    """Target weights proportional to a power of each source's size: (mix_source, weight)."""
    return sizes.select("mix_source", F.pow(F.col("chars").cast("double"), F.lit(exponent)).alias("weight"))


def rates(sizes: DataFrame, weights: DataFrame, epochs: float = 1.0) -> DataFrame:
    """Mean repetitions per source for an output of ``epochs`` times the input's characters."""
    joined = sizes.join(weights.withColumnRenamed("mix_source", "w_source"), F.col("mix_source").eqNullSafe(F.col("w_source"))).where("weight > 0")
    all_weight = joined.agg(F.sum("weight")).first()[0] or 1.0
    all_chars = float(sizes.agg(F.sum("chars")).first()[0] or 0)
    rate = F.col("weight") / F.lit(all_weight) * F.lit(float(epochs)) * F.lit(all_chars) / F.col("chars").cast("double")
    return joined.select("mix_source", F.round(rate, 9).alias("rate")).where("rate > 0")


def quantiles(rate: DataFrame) -> DataFrame:
    """(mix_source, rate, least, cdf): cumulative Poisson probabilities of each source, from the count
    ``least`` on, far enough for any 52-bit uniform.

    Counts twelve deviations below a large mean have less than 2**-60 together and are left
    out, so a table is as long as the distribution is wide, not as its mean.
    """
    wide = 12 * F.sqrt("rate")
    least = F.when(F.col("rate") > 400, F.floor(F.col("rate") - wide)).otherwise(0).cast("int")
    top = (F.ceil(F.col("rate") + wide) + 40).cast("int")
    bounds = rate.withColumns({"least": least, "top": top})
    terms = bounds.select("mix_source", "rate", "least", F.explode(F.sequence("least", "top")).alias("k"))
    # the first term of a table that begins late comes from Stirling's series
    k, log_rate = F.col("k").cast("double"), F.ln("rate")
    stirling = k * F.ln(k) - k + F.ln(2 * F.lit(math.pi) * k) / 2 + 1 / (12 * k) - 1 / (360 * k * k * k)
    first = F.when(F.col("k") == 0, -F.exp(log_rate)).otherwise(-F.exp(log_rate) + k * log_rate - stirling)
    step = F.when(F.col("k") == F.col("least"), first).otherwise(log_rate - F.ln(k))
    own = Window.partitionBy("mix_source").orderBy("k")  # as many rows as the table is long
    p = terms.withColumn("p", F.exp(F.sum(step).over(own)))
    cdf = p.withColumn("total", F.sum("p").over(own))
    return cdf.groupBy("mix_source", "rate", "least").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "total"))), lambda s: s["total"]).alias("cdf"))


def drawn_count(u: Column) -> Column:
    """How many of ``cdf`` are at most ``u``, by halving, from ``least`` on."""
    size = F.size("cdf")
    bits = F.sequence(F.floor(F.log2(size.cast("double"))).cast("int"), F.lit(0), F.lit(-1))
    # the greatest n with cdf[n - 1] <= u, its bits from the highest on
    found = F.aggregate(bits, F.lit(0), lambda n, b: _further(n, n + F.pow(F.lit(2), b).cast("int"), u, size))
    return (F.col("least") + found).cast("long")


def _further(n: Column, m: Column, u: Column, size: Column) -> Column:
    return F.when((m > 0) & (m <= size) & (F.get("cdf", m - 1) <= u), m).otherwise(n)


def replicate(docs: DataFrame, weights: DataFrame | None = None, exponent: float = 0.7, epochs: float = 1.0, seed: int = 11) -> DataFrame:
    """Rows of ``docs`` repeated by their Poisson counts, in a global random order."""
    sizes = scratch.keep(source_sizes(docs), "source-sizes")
    table = scratch.keep(quantiles(rates(sizes, tempered(sizes, exponent) if weights is None else weights, epochs)), "rates")
    bound = table.agg(F.sum(F.size("cdf") * 8 + F.octet_length(F.coalesce("mix_source", F.lit(""))) + 64)).first()[0] or 0
    side = F.broadcast(table) if bound <= BROADCAST_BYTES else table
    # other columns go along under names that nothing here has
    carried = [c for c in docs.columns if c not in ("copy", "n_copies")]
    names = [f"mix_c{i}" for i in range(len(carried))]
    drawn = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(carried, names)], F.col("doc_id").alias("mix_id"), F.col("source").cast("string").alias("mix_own"), F.monotonically_increasing_id().alias("mix_place"))
    drawn = drawn.join(side.select("mix_source", "least", "cdf"), F.col("mix_own").eqNullSafe(F.col("mix_source")))
    u = uniform(seed, F.col("mix_id"))
    drawn = drawn.withColumn("mix_u", u).withColumn("n_copies", drawn_count(F.col("mix_u"))).drop("cdf", "least", "mix_u", "mix_source", "mix_own").where("n_copies > 0")
    copies = drawn.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_copies"))))
    return shuffled(copies, seed).select(*[F.col(n).alias(c) for c, n in zip(carried, names)], "n_copies", "copy")


def shuffled(df: DataFrame, seed: int) -> DataFrame:
    """A global shuffle: a hash key of seed, id, copy and place in the input deals rows to tasks and orders them there.

    A hash of a random key is as even as a range of it and needs no sampling pass. The place
    keeps rows without an id, or with the same one, from meeting in one task; it is the one that
    the row was read at, so a task that runs again deals its rows as before.
    """
    key = F.xxhash64(F.lit(seed), F.col("mix_id"), F.col("copy"), F.col("mix_place"))
    return df.withColumn("mix_key", key).repartition("mix_key").sortWithinPartitions("mix_key").drop("mix_key", "mix_id", "mix_place")
