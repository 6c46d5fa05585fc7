"""Walks between two walls over a whole corpus, as an associative scan.

A step moves a place by ``move`` and keeps it between ``low`` and ``high``; a step to a fixed
place has both walls there. Steps compose into steps of the same form, so a walk of any length
is a prefix of compositions: inside blocks of ``BLOCK`` steps, over the blocks' compositions
in blocks of their own, and so on, until one block is left. No task sees more than a block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 128
#: Walls before the first step: farther than any walk.
FAR = 1 << 60


def step(move: Column, low: Column, high: Column) -> Column:
    return F.struct(*[c.cast("long").alias(n) for c, n in ((move, "move"), (low, "low"), (high, "high"))])


def _kept(x: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(x, low), high)


def then(first: Column, second: Column) -> Column:
    """The step that two steps make one after the other."""
    walls = [_kept(first[w] + second["move"], second["low"], second["high"]) for w in ("low", "high")]
    return step(first["move"] + second["move"], *walls)


def _compose(steps: Column, many: int) -> Column:
    """The composition of an array of cells, each with ``many`` steps side by side."""
    none = F.array(*[step(F.lit(0), F.lit(-FAR), F.lit(FAR))] * many)
    return F.aggregate(steps, none, lambda acc, cell: F.zip_with(acc, cell["steps"], then))


def walked(rows: DataFrame, by: tuple[str, ...], many: int, carry: tuple[str, ...] = (), last: int | None = None) -> DataFrame:
    """(by, i, carry, at): the ``many`` places after each row's ``steps``, from 0 before the first.

    ``rows`` has (by, i, carry, steps), ``i`` numbering each group's rows from 0 without gaps.
    """
    if last is None:
        last = rows.agg(F.max("i")).first()[0]
    cell = F.struct("i", "steps", *carry)
    blocks = rows.groupBy(*by, F.floor(F.col("i") / F.lit(BLOCK)).cast("long").alias("block_")).agg(F.sort_array(F.collect_list(cell)).alias("cells_"))
    start = F.array(*[F.lit(0).cast("long")] * many)
    if last is not None and last >= BLOCK:
        whole = blocks.select(*by, F.col("block_").alias("i"), _compose(F.col("cells_"), many).alias("steps"))
        after = walked(whole, by, many, (), last // BLOCK)
        before = after.select(*by, (F.col("i") + 1).alias("block_"), F.col("at").alias("from_"))
        blocks = joined_by_left(blocks, before, (*by, "block_")).withColumn("from_", F.coalesce("from_", start))
    else:
        blocks = blocks.withColumn("from_", start)
    move = lambda at, steps: F.zip_with(at, steps, lambda x, s: _kept(x + s["move"], s["low"], s["high"]))
    walk = F.aggregate("cells_", F.struct(F.col("from_").alias("at"), F.array().cast("array<array<bigint>>").alias("all")), lambda acc, c: _next(acc, move(acc["at"], c["steps"])), lambda acc: acc["all"])
    each = blocks.select(*by, "cells_", walk.alias("walk_"))
    return each.select(*by, F.posexplode("cells_").alias("k_", "c_"), "walk_").select(*by, "c_.i", *[F.col(f"c_.{c}").alias(c) for c in carry], F.get("walk_", F.col("k_")).alias("at"))


def _next(acc: Column, at: Column) -> Column:
    return F.struct(at.alias("at"), F.concat(acc["all"], F.array(at)).alias("all"))


def joined_by_left(left: DataFrame, right: DataFrame, by: tuple[str, ...]) -> DataFrame:
    """Left join on columns that may be null."""
    renamed = right.withColumnsRenamed({c: f"{c}_r" for c in by})
    condition = F.lit(True)
    for c in by:
        condition &= F.col(c).eqNullSafe(F.col(f"{c}_r"))
    return left.join(renamed, condition, "left").drop(*[f"{c}_r" for c in by])
