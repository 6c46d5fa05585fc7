"""What five text filters remove, alone and behind one another in each of their 120 orders.

Filters, over the whole text (null is empty; words are maximal runs of ``[^\\x20\\x09-\\x0D]``):
A under 50 words; B ``100 * distinct words < 65 * words``; C ``100 * capitals A-Z > 5 * code
points``; D holds any of ``#$%&*|``; E identical to the text of a smaller doc_id in the table.

Method: Arrow-buffer scanning. A task reads a batch's UTF-8 buffer as one numpy array; byte
classes and their prefix sums, cut at the rows' offsets, count capitals, symbols, code points
and words. Distinct words come from the documents' sorted word hashes; neighbours with equal
hashes are compared byte by byte, and a document where a hash lies is counted by its words
instead. Only (doc_id, part, digest, mask) leaves that stage. E needs the least doc_id of each
digest, labels one row a doc_id; both are joined so that no hot digest or id meets in one task.
Masks are then counted by part (32 numbers each), from which all orders follow.

Defined cases: null or empty texts have no words, so A holds and B, C and D don't; a null
doc_id is neither smaller nor larger than another, so E never holds for it, and it has no
labels; repeated rows count one each (the same doc_id isn't smaller than itself); a doc_id
with several labels is good or toxic if any of them says so; a null source is the part ''
together with empty ones; an empty table has no parts and so no rows. Other columns are not
read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import hot, kernels, scratch

LEAST_WORDS = 50
LEAST_DISTINCT = 65  # percent of words
MOST_CAPITALS = 5  # percent of code points
SYMBOLS = b"#$%&*|"
ORDERS = ["".join(p) for p in permutations("ABCDE")]

_CAPITAL = np.zeros(256, bool)
_CAPITAL[65:91] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True
_POINT = np.ones(256, bool)  # bytes that begin a character
_POINT[0x80:0xC0] = False


def per_row(marked: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """How many bytes of each row are marked, by prefix sums."""
    total = np.zeros(len(marked) + 1, np.int64)
    np.cumsum(marked, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def differing(data: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the ``length`` bytes from ``a`` differ from those from ``b``, for each pair."""
    ends = np.cumsum(length)
    if not len(ends) or not ends[-1]:
        return np.zeros(len(a), bool)
    begin = ends - length
    place = np.arange(ends[-1], dtype=np.int64)
    wrong = data[place + np.repeat(a - begin, length)] != data[place + np.repeat(b - begin, length)]
    return np.add.reduceat(wrong, begin) > 0


def distinct_words(words: kernels.Words, hashes: np.ndarray) -> np.ndarray:
    """The number of different words of each row: sorted hashes, neighbours verified."""
    rows = kernels.row_of(words.first)
    n = len(words.first) - 1
    if not len(rows):
        return np.zeros(n, np.int64)
    order = np.lexsort((hashes, rows))
    h, r, start = hashes[order], rows[order], words.start[order]
    length = words.end[order] - start
    again = np.flatnonzero((h[1:] == h[:-1]) & (r[1:] == r[:-1]))
    out = words.counts() - np.bincount(r[again], minlength=n)
    lying = length[again] != length[again + 1]
    fits = again[~lying]
    lying[~lying] = differing(words.data, start[fits], start[fits + 1], length[fits])
    for row in np.unique(r[again[lying]]).tolist():
        of = range(int(words.first[row]), int(words.first[row + 1]))
        out[row] = len({words.data[words.start[i] : words.end[i]].tobytes() for i in of})
    return out


def failures(data: np.ndarray, offsets: np.ndarray, hashes=kernels.Words.hashes) -> np.ndarray:
    """The mask of filters A to D (bits 0 to 3) that each row fails."""
    words = kernels.Words(data, offsets)
    n_words = words.counts()
    mask = (n_words < LEAST_WORDS).astype(np.int32)
    mask |= (100 * distinct_words(words, hashes(words)) < LEAST_DISTINCT * n_words).astype(np.int32) << 1
    mask |= (100 * per_row(_CAPITAL[data], offsets) > MOST_CAPITALS * per_row(_POINT[data], offsets)).astype(np.int32) << 2
    return mask | (per_row(_SYMBOL[data], offsets) > 0).astype(np.int32) << 3


def _scan(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, data, offsets in kernels.batches(source, "text"):
        mask = pa.array(failures(data, offsets), pa.int32())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), batch.column("same"), mask], names=["doc_id", "part", "same", "mask"])


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, part, mask, good, toxic) of every row of ``docs`` (doc_id, source, text)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    part = F.coalesce(F.col("source").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), part.alias("part"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("same"), text.alias("text"))
    rows = scratch.keep(scratch.arrow(rows, _scan, "doc_id long, part string, same binary, mask int"), "audit-masks")
    first = rows.groupBy("same").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = hot.attach(rows, first, ["same"], "n", ["doc_id", "part"])
    rows = rows.withColumn("mask", F.col("mask").bitwiseOR(F.when(F.col("doc_id") > F.col("first"), 16).otherwise(0))).drop("first")
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic")).where("good or toxic")
    marked = marked.groupBy("doc_id").agg(F.coalesce(F.bool_or("good"), F.lit(False)).alias("good"), F.coalesce(F.bool_or("toxic"), F.lit(False)).alias("toxic"))
    marked = marked.join(rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")), "doc_id")
    rows = hot.attach(rows, marked, ["doc_id"], "n", ["same", "part"])
    return rows.select("doc_id", "part", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def interactions(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step; see the module and the columns' names."""
    cells = masks(docs, labels).groupBy("part", "mask").agg(F.count(F.lit(1)).alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # at most 32 each
    steps = parts.select("part", "cells", F.explode(F.lit(ORDERS)).alias("filter_order"))
    steps = steps.select("*", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("step"))
    letters = F.transform(F.split("filter_order", ""), lambda c: F.element_at(F.lit([1, 2, 4, 8, 16]), F.ascii(c) - 64))
    steps = steps.withColumn("bits", letters).withColumn("bit", F.element_at("bits", F.col("step")))
    steps = steps.withColumn("before", F.aggregate(F.slice("bits", F.lit(1), F.col("step") - 1), F.lit(0), lambda a, b: a + b))

    def total(where, value=lambda c: c["n"]):
        return F.aggregate(F.filter("cells", where), F.lit(0).cast("long"), lambda a, c: a + value(c))

    fails = lambda c: c["mask"].bitwiseAND(F.col("bit")) > 0
    reaches = lambda c: c["mask"].bitwiseAND(F.col("before")) == 0
    return steps.select(
        "part",
        "filter_order",
        "step",
        total(lambda c: reaches(c) & ~fails(c)).alias("kept"),
        total(lambda c: reaches(c) & fails(c)).alias("removed"),
        total(lambda c: ~reaches(c) & fails(c)).alias("redundant"),
        total(lambda c: c["mask"] == F.col("bit")).alias("unique_fails"),
        total(lambda c: reaches(c) & fails(c), lambda c: c["good"]).alias("good_lost"),
        total(lambda c: reaches(c) & fails(c), lambda c: c["toxic"]).alias("toxic_lost"),
        # a filter that shares its document with k - 1 others comes first of them in 120 / k orders
        total(fails, lambda c: c["n"] * F.floor(F.lit(120) / F.bit_count(c["mask"]))).alias("shapley"),
    )
