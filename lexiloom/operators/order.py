"""Exact order statistics and permutations of whole corpora, without a task that holds one.

A value of a given rank is found by counting into ranges and going on with the one range that
holds the rank. Dense numbers in the order of a hash come from counts per range of hashes, then
from the rows' order inside their range; ranges of a hash are even, whatever the data.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import stage
from .lexical import joined_by

#: Ranges that a round of :func:`at_rank` counts into.
RANGES = 4096
#: Ranges of hashes, of all groups, whose first numbers are broadcast.
MOST_CELLS = 500_000


def at_rank(values: DataFrame, by: tuple[str, ...], x: str, rank: Callable[[Column], Column]) -> DataFrame:
    """(by, n, value): of each group's ``n`` values of ``x`` in ascending order the one numbered ``rank(n)``, from 0.

    Nulls and NaN don't count. A round keeps one range a group; the least and the greatest value
    of a range never meet in one again, so rounds end, usually after two or three.
    """
    kept = stage.written(values.where(F.col(x).isNotNull() & ~F.isnan(x)).select(*by, F.col(x).cast("double").alias("x_")), "values")
    first = kept.groupBy(*by).agg(F.count("*").alias("n"), F.min("x_").alias("low_"), F.max("x_").alias("high_"))
    state = stage.written(first.withColumn("rank_", rank(F.col("n")).cast("long")), "ranges")
    used = [kept, state]
    found = state.where("low_ = high_")
    while (left := state.where("low_ < high_")).limit(1).count():
        inside = joined_by(kept, left, by).where("x_ between low_ and high_")
        share = (F.col("x_") / 2 - F.col("low_") / 2) / (F.col("high_") / 2 - F.col("low_") / 2)
        ranges = inside.groupBy(*by, "n", "rank_", F.least(F.floor(share * RANGES), F.lit(RANGES - 1)).alias("range_")).agg(F.count("*").alias("c_"), F.min("x_").alias("low_"), F.max("x_").alias("high_"))
        ranges = ranges.withColumn("before_", F.sum("c_").over(Window.partitionBy(*by).orderBy("range_")) - F.col("c_"))
        ranges = ranges.where("before_ <= rank_ and rank_ < before_ + c_")
        state = stage.written(ranges.select(*by, "n", "low_", "high_", (F.col("rank_") - F.col("before_")).alias("rank_")), "ranges")
        used.append(state)
        found = found.unionByName(state.where("low_ = high_"))
    out = stage.written(found.select(*by, "n", F.col("low_").alias("value")), "found")
    stage.done(*used)
    return out


def upper_median(values: DataFrame, by: tuple[str, ...], x: str) -> DataFrame:
    """(by, n, value): the element at n // 2 of each group's sorted values."""
    return at_rank(values, by, x, lambda n: F.floor(n / 2))


def _cells(rows: DataFrame, within: tuple[str, ...], key: Column) -> tuple[DataFrame, DataFrame]:
    """The rows with their key's range, and how many rows of the group the lesser ranges have."""
    cut = rows.withColumn("key_", key).withColumn("cell_", F.substring("key_", 1, 3))
    sizes = cut.groupBy(*within, "cell_").agg(F.count("*").alias("n_"))
    before = F.sum("n_").over(Window.partitionBy(*within).orderBy("cell_")) - F.col("n_")  # 4,096 cells at most
    return cut, sizes.select(*within, "cell_", before.alias("before_"), "n_")


def cuts(rows: DataFrame, within: tuple[str, ...], key: Column, size: Column) -> DataFrame:
    """(within, size_, edge_, before_): the range of ``key`` that the ``size``-th row of each group
    falls into, and how many rows lesser ranges have; no row for a group of fewer rows."""
    sizes = rows.withColumn("cell_", F.substring(key, 1, 3)).groupBy(*within, "cell_").agg(F.count("*").alias("n_"), F.max(size).alias("size_"))
    before = F.sum("n_").over(Window.partitionBy(*within).orderBy("cell_")) - F.col("n_")  # 4,096 cells at most
    each = sizes.withColumn("before_", before).where("before_ < size_ and before_ + n_ >= size_")
    return each.select(*within, "size_", F.col("cell_").alias("edge_"), "before_")


def least(rows: DataFrame, within: tuple[str, ...], key: Column, ties: tuple[str, ...], size: Column) -> DataFrame:
    """The ``size`` rows of each group with the least ``key``, a hash in hex, then ``ties``.

    Ranges before the one that holds the last of them are taken whole; that one alone is ranked.
    Groups have a row each in the table of those ranges, so the rows themselves don't move for it.
    """
    from .scan import joined_by_left

    edges = stage.written(cuts(rows, within, key, size), "cuts")
    cut = rows.withColumns({"key_": key, "cell_": F.substring(key, 1, 3)})
    small = edges.limit(100_001).count() <= 100_000
    each = joined_by_left(cut, F.broadcast(edges) if small else edges, within)
    whole = each.where(F.col("edge_").isNull() | (F.col("cell_") < F.col("edge_")))
    inside = F.row_number().over(Window.partitionBy(*within).orderBy("key_", *ties))
    torn = each.where(F.col("cell_") == F.col("edge_")).withColumn("inside_", inside).where("before_ + inside_ <= size_").drop("inside_")
    return whole.unionByName(torn).drop("key_", "cell_", "before_", "edge_", "size_")


def dense(rows: DataFrame, within: tuple[str, ...], key: Column, ties: tuple[str, ...], name: str = "i", cell: bool = False) -> DataFrame:
    """Adds each row's number from 0 in its group in the order of ``key``, a hash in hex, then ``ties``.

    Rows move once, to their range of hashes; the ranges' first numbers are broadcast where they are
    few. ``cell`` keeps the range as ``cell_``: its rows have numbers without a gap, in one task.
    """
    cut, starts = _cells(rows, within, key)
    starts = stage.written(starts.select(*within, "cell_", "before_"), "cells")
    small = starts.limit(MOST_CELLS + 1).count() <= MOST_CELLS
    inside = F.row_number().over(Window.partitionBy(*within, "cell_").orderBy("key_", *ties)) - 1
    numbered = cut.withColumn("key_", F.unhex("key_")).withColumn("inside_", inside).drop("key_")
    each = joined_by(numbered, F.broadcast(starts) if small else starts, (*within, "cell_"))
    return each.withColumn(name, F.col("before_") + F.col("inside_")).drop("before_", "inside_", *([] if cell else ["cell_"]))
