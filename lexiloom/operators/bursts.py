"""Gaps between a word's occurrences in corpora shuffled as a whole. A20, N5.

Tasks read pages and send each round's md5 numbers to cells, ranges of md5 of about :data:`CELL` tokens, with the
words' numbers, as packed bytes. A cell orders its tokens and sums up the gaps of each word inside; only
sums, first and last places of words are left to be joined across cells.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import stage
from ..functions import arrays
from . import chunks, tallies
from .lexical import joined_by

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Tokens of a cell, about, and words of all groups whose numbers are broadcast.
CELL, NUMBERED = 1 << 20, 500_000
#: Tokens, counted once a round, that are on their way to cells at a time.
MOVED = 1 << 28


def _cuts(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by several columns, and where its runs of equal rows begin and end."""
    order = np.lexsort(parts[::-1])
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([x[order][1:] != x[order][:-1] for x in parts])
    first = np.flatnonzero(new)
    return order, first, np.append(first[1:], len(order))


def gaps(placed: DataFrame, sizes: dict[tuple, int], rounds: int, by: tuple[str, ...], whole: bool) -> DataFrame:
    """(by, round, id, n, first, last, squares): the squares of the gaps of each word summed, round 0 in the real order.

    ``placed`` has (by, page, pos, gpos, id), id null for words that aren't asked for; ``sizes`` are
    the groups' tokens. Rounds go some at a time, so that a pass moves about :data:`MOVED` tokens and
    its shuffle is gone before the next. ``whole`` as for :func:`.tallies.tallied`.
    """
    n_by = len(by)
    bits = {g: max(0, (n // CELL).bit_length()) for g, n in sizes.items()}
    if not whole:
        placed = placed.repartition(*by, "page").sortWithinPartitions(*by, "page", "pos")
    names = [f"g{i}_" for i in range(n_by)]
    rows = placed.select(*[F.col(c).alias(n) for c, n in zip(by, names)], F.col("page").cast("string").alias("page"), F.col("pos").cast("long").alias("pos"), F.col("gpos").cast("long").alias("gpos"), F.coalesce(F.col("id").cast("int"), F.lit(-1)).alias("id"))
    rows = stage.written(rows, "places")
    kinds = ", ".join(f"{n} {placed.schema[c].dataType.simpleString()}" for c, n in zip(by, names))

    def send(source: Iterator[pa.RecordBatch], some: range) -> Iterator[pa.RecordBatch]:
        for table, starts in chunks.pages_of(source, (*names, "page")):
            group = tallies.joint([np.zeros(table.num_rows, np.int64), *[tallies.codes(table[n], "encode")[0] for n in names]])
            first = np.unique(group, return_index=True)[1]
            known = [tuple(x) for x in zip(*(table[n].take(pa.array(first)).to_pylist() for n in names))]
            b = np.array([bits[g] for g in known], np.uint64)[group]
            ids, gpos = table["id"].to_numpy().astype(np.int32), table["gpos"].to_numpy()
            keys = arrays.Keys(table["page"].take(pa.array(np.flatnonzero(starts))).to_pylist(), np.cumsum(starts) - 1, table["pos"].to_numpy())
            for r in some:
                if r:
                    high, low = keys.of(r)
                    up = np.uint64(64) - b  # numpy doesn't shift by 64
                    cell = np.where(b > 0, high >> np.minimum(up, np.uint64(63)), np.uint64(0)).astype(np.int64)
                    key = np.where(b > 0, high << b | low >> np.minimum(up, np.uint64(63)), high)
                    kept = np.arange(len(ids))
                else:
                    kept = np.flatnonzero(ids >= 0)
                    cell, key = gpos // CELL, (gpos % CELL).astype(np.uint64)
                order, start, end = _cuts([group[kept], cell[kept]])
                order = kept[order]
                own = [known[g] for g in group[order[start]].tolist()]
                out = {n: pa.array([g[i] for g in own], table.schema.field(n).type) for i, n in enumerate(names)}
                out |= {"round": pa.array(np.full(len(start), r, np.int32)), "cell": pa.array(cell[order[start]])}
                out |= {n: pa.array([x[order[s:e]].tobytes() for s, e in zip(start.tolist(), end.tolist())], pa.binary()) for n, x in (("keys", key), ("ids", ids))}
                yield pa.RecordBatch.from_pydict(out)

    def sum_up(table: pa.Table) -> pa.Table:
        key = np.frombuffer(b"".join(table["keys"].to_pylist()), np.uint64)
        ids = np.frombuffer(b"".join(table["ids"].to_pylist()), np.int32)
        order = np.argsort(key, kind="stable")
        ids = ids[order]
        at = np.arange(len(ids)) if table["round"][0].as_py() else key[order].astype(np.int64)
        own = np.flatnonzero(ids >= 0)
        own = own[np.argsort(ids[own], kind="stable")]
        ids, at, size = ids[own], at[own], len(ids)
        start = np.flatnonzero(np.append(True, ids[1:] != ids[:-1])) if len(ids) else np.zeros(0, np.int64)
        gap = np.diff(at, prepend=0).astype(np.float64)
        gap[start] = 0
        end = np.append(start[1:], len(ids))[: len(start)]
        n = len(start) + 1  # the last row has the cell's size
        out = {c: table[c].slice(0, 1).combine_chunks().take(pa.array(np.zeros(n, np.int64))) for c in (*names, "round", "cell")}
        put = lambda x, last: pa.array(np.append(x, last))
        squares = np.add.reduceat(gap * gap, start) if len(start) else np.zeros(0)
        return pa.table(out | {"id": put(ids[start], np.int32(-1)), "n": put(end - start, size), "first": put(at[start], 0), "last": put(at[end - 1] if len(start) else at[start], 0), "squares": put(squares, 0.0)})

    many = max(1, MOVED // max(1, sum(sizes.values())))
    passes = []
    for lo in range(0, rounds + 1, many):
        some = range(lo, min(lo + many, rounds + 1))
        sent = rows.mapInArrow(lambda source, some=some: send(source, some), f"{kinds}, round int, cell bigint, keys binary, ids binary")
        summed = sent.groupBy(*names, "round", "cell").applyInArrow(sum_up, f"{kinds}, round int, cell bigint, id int, n bigint, first bigint, last bigint, squares double")
        passes.append(stage.written(summed.withColumnsRenamed(dict(zip(names, by))), "gaps"))
    stage.done(rows)
    cells = reduce(DataFrame.unionByName, passes)
    keys_ = (*by, "round")
    before = F.sum("n").over(Window.partitionBy(*keys_).orderBy("cell")) - F.col("n")
    starts = cells.where("id = -1").select(*keys_, "cell", F.when(F.col("round") > 0, before).otherwise(F.col("cell") * CELL).alias("before_"))
    each = joined_by(cells.where("id >= 0"), starts, (*keys_, "cell")).withColumns({c: F.col(c) + F.col("before_") for c in ("first", "last")})
    gap = (F.col("first") - F.lag("last").over(Window.partitionBy(*keys_, "id").orderBy("cell"))).cast("double")
    return each.withColumn("gap", F.coalesce(gap, F.lit(0.0))).groupBy(*keys_, "id").agg(
        F.sum("n").alias("n"), F.min("first").alias("first"), F.max("last").alias("last"), F.sum(F.col("squares") + F.col("gap") * F.col("gap")).alias("squares")
    )
