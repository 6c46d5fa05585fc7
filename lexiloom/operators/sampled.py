"""Words of samples of lines, many samples at once, counted where the lines are. A45, N8."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays
from . import tallies

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Lines of a chunk, and bits of a hash that tell its range.
CHUNK, BITS = 1 << 16, 12


def _chunks(source: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, size = [], 0
    for batch in source:
        held.append(batch)
        size += batch.num_rows
        if size >= CHUNK:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if size:
        yield pa.Table.from_batches(held)


def words(lines: DataFrame, by: tuple[str, ...], groups: list[tuple], sizes: list[tuple[int, int]], rounds: int) -> DataFrame:
    """(group_, round, w, n, n_lines): tokens and lines of each word in the samples of each round.

    ``groups`` are the values of ``by``, ``sizes`` their lines and those of a sample. A group of which
    every line is taken has one round, 0.
    """
    numbers = {g: k for k, g in enumerate(groups)}
    torn = np.array([n > m for n, m in sizes], bool)
    names = [f"g{i}_" for i in range(len(by))]
    rows = lines.select(*[F.col(c).alias(n) for c, n in zip(by, names)], F.col("page").cast("string").alias("page"), F.col("line_idx").cast("long").alias("line_idx"), "ws")

    def read(table: pa.Table) -> tuple[np.ndarray, arrays.Keys]:
        """Each line's group, and its hashes."""
        own = tallies.joint([np.zeros(table.num_rows, np.int64), *[tallies.codes(table[n], "encode")[0] for n in names]])
        first = np.unique(own, return_index=True)[1]
        known = [numbers[tuple(x)] for x in zip(*(table[n].take(pa.array(first)).to_pylist() for n in names))]
        page, pages = tallies.codes(table["page"], "encode")
        return np.array(known, np.int64)[own], arrays.Keys(pages.to_pylist(), page, table["line_idx"].to_numpy())

    def taken(table: pa.Table) -> pa.Table:
        """The lines of groups that aren't taken whole."""
        group, _ = read(table)
        return table.filter(pa.array(torn[group]))

    def ranges(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(groups), rounds, 1 << BITS), np.int64)
        for table in _chunks(source):
            if (table := taken(table)).num_rows:
                group, keys = read(table)
                for r in range(1, rounds + 1):
                    np.add.at(total[:, r - 1], (group, (keys.of(r)[0] >> np.uint64(64 - BITS)).astype(np.int64)), 1)
        g, r, cell = np.nonzero(total)
        yield pa.RecordBatch.from_pydict({"group_": pa.array(g.astype(np.int32)), "round": pa.array((r + 1).astype(np.int32)), "cell": pa.array(cell.astype(np.int32)), "n": pa.array(total[g, r, cell])})

    slim = rows.drop("ws")
    cells = slim.mapInArrow(ranges, "group_ int, round int, cell int, n bigint").groupBy("group_", "round", "cell").agg(F.sum("n").alias("n"))
    cells = cells.withColumn("before", F.sum("n").over(Window.partitionBy("group_", "round").orderBy("cell")) - F.col("n"))
    least = F.element_at(F.array(*[F.lit(m).cast("long") for _, m in sizes]), F.col("group_") + 1)
    edges = {(r.group_, r.round): (r.cell, r.before) for r in cells.where((F.col("before") < least) & (F.col("before") + F.col("n") >= least)).collect()}  # a row a round of each group

    def at(values: dict, k: int, r: int, kind: type) -> np.ndarray:
        return np.array([values.get((g, r), (0, 0))[k] for g in range(len(groups))], kind)

    def near(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _chunks(source):
            if (table := taken(table)).num_rows:
                group, keys = read(table)
                for r in range(1, rounds + 1):
                    high, low = keys.of(r)
                    here = np.flatnonzero((high >> np.uint64(64 - BITS)).astype(np.int64) == at(edges, 0, r, np.int64)[group])
                    key = np.stack([high[here], low[here]], 1).astype(">u8")
                    yield pa.RecordBatch.from_pydict({"group_": pa.array(group[here].astype(np.int32)), "round": pa.array(np.full(len(here), r, np.int32)), "key": pa.array([x.tobytes() for x in key], pa.binary())})

    found = slim.mapInArrow(near, "group_ int, round int, key binary")
    rank = F.row_number().over(Window.partitionBy("group_", "round").orderBy("key"))
    starts = lines.sparkSession.createDataFrame([(g, r, sizes[g][1] - before) for (g, r), (_, before) in edges.items()], "group_ int, round int, left_ long") if edges else None
    lasts: dict = {}
    if starts is not None:
        ended = found.withColumn("rank_", rank).join(F.broadcast(starts), ["group_", "round"]).where("rank_ = left_")
        lasts = {(r.group_, r.round): tuple(int.from_bytes(bytes(r.key)[i : i + 8], "big") for i in (0, 8)) for r in ended.collect()}

    def count(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _chunks(source):
            group, keys = read(table)
            lists = table["ws"].combine_chunks()
            lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
            line = np.repeat(np.arange(len(group)), np.diff(np.asarray(lists.offsets)))
            code, values = tallies.codes(pa.chunked_array([lists.flatten()]))
            key, n = np.unique(line * max(1, len(values)) + code, return_counts=True)  # a line's words once each
            line, code = key // max(1, len(values)), key % max(1, len(values))
            for r in range(rounds + 1):
                if r:
                    high, low = keys.of(r)
                    last = [at(lasts, k, r, np.uint64)[group] for k in (0, 1)]
                    chosen = torn[group] & ((high < last[0]) | (high == last[0]) & (low <= last[1]))
                else:
                    chosen = ~torn[group]
                some = np.flatnonzero(chosen[line])
                known, back = np.unique(group[line[some]] * max(1, len(values)) + code[some], return_inverse=True)
                yield pa.RecordBatch.from_pydict({
                    "group_": pa.array((known // max(1, len(values))).astype(np.int32)), "round": pa.array(np.full(len(known), r, np.int32)), "w": values.cast(pa.string()).take(pa.array(known % max(1, len(values)))),
                    "n": pa.array(np.bincount(back, n[some], len(known)).astype(np.int64)), "n_lines": pa.array(np.bincount(back, minlength=len(known)).astype(np.int64)),
                })

    counted = rows.mapInArrow(count, "group_ int, round int, w string, n bigint, n_lines bigint")
    return counted.groupBy("group_", "round", "w").agg(F.sum("n").alias("n"), F.sum("n_lines").alias("n_lines"))
