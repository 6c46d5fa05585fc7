"""Left joins of rows with one fact a key, where a key may hold any share of the rows.

Keys that hold more than one in ``SHARE`` of all rows number fewer than ``SHARE``: their facts
are broadcast, which bounds the broadcast whatever the data. All other facts are joined by
shuffle, whose largest key is then a small share; rows of the broadcast keys are dealt by
their own hash instead of their key, so no task holds a hot key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scratch

SHARE = 4096


def attach(rows: DataFrame, facts: DataFrame, on: list[str], weight: str, deal: list[str]) -> DataFrame:
    """``rows`` with the other columns of ``facts`` (null where a key has none).

    ``facts`` has one row a key and, in ``weight``, at most how many rows have the key; ``deal``
    names columns of ``rows`` that tell the rows of a hot key apart. Null keys match nothing
    and are dealt like hot ones.
    """
    facts = scratch.keep(facts, "facts")
    names = [c for c in facts.columns if c not in on and c != weight]
    total = facts.agg(F.sum(weight)).first()[0] or 0
    key = [F.col(c).alias(f"k{i}_") for i, c in enumerate(on)]
    known = [F.col(c) for c in names]
    hot = facts.where(F.col(weight) > total // SHARE).select(*key, F.struct(*known).alias("hot_"))
    cold = facts.where(F.col(weight) <= total // SHARE).select(*key, F.lit(0).alias("salt_k_"), F.struct(*known).alias("cold_"))
    same = None
    for i, c in enumerate(on):
        one = F.col(c) == F.col(f"k{i}_")
        same = one if same is None else same & one
    keys = [f"k{i}_" for i in range(len(on))]
    away = F.col("hot_").isNotNull()
    for c in on:
        away = away | F.col(c).isNull()
    dealt = F.when(away, 1 + F.pmod(F.xxhash64(*deal), F.lit(SHARE))).otherwise(0).cast("int")
    first = rows.join(F.broadcast(hot), same, "left").drop(*keys).withColumn("salt_", dealt)
    both = first.join(cold.hint("merge"), same & (F.col("salt_") == F.col("salt_k_")), "left").drop(*keys, "salt_k_", "salt_")
    either = F.coalesce("hot_", "cold_")
    return both.withColumns({c: either[c] for c in names}).drop("hot_", "cold_")
