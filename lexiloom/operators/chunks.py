"""Whole pages packed in chunks, and words of a corpus fetched by their number.

A chunk is a row: its pages' layout and words as packed numbers and bytes. What draws words from
all over a corpus sends numbers to cells of it, a few bytes each, and gets words back in the same
order, so neither places nor their columns move for a draw. A cell holds about :data:`CELL` words
at most, whatever the corpus.
"""

from __future__ import annotations

import sys
import zlib
from bisect import bisect_right
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext, cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import stage
from ..functions import arrays

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Tokens of a chunk, but for longer pages; words of a cell, at most and at least.
CHUNK, CELL, LEAST = 1 << 17, 1 << 19, 1 << 14
#: Candidates for cuts between cells in the width of a cell.
FINE = 8

PLACES = ("line_idx", "word_idx", "line_len", "pos")
SCHEMA = "chunk string, corpus array<string>, page array<string>, size array<int>, line_idx binary, word_idx binary, line_len binary, pos binary, kind binary, data binary, lengths binary"
ANSWERS = "chunk string, at binary, data binary, lengths binary"


def ints(x: bytes) -> np.ndarray:
    return np.frombuffer(x, np.int32)


def texts(data: bytes, lengths: np.ndarray) -> pa.Array:
    """The words of packed bytes."""
    offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    return pa.LargeStringArray.from_buffers(len(lengths), pa.py_buffer(offsets), pa.py_buffer(data))


def packed_words(words: pa.Array) -> tuple[bytes, bytes]:
    """Words as (bytes, their lengths in bytes)."""
    words = words.cast(pa.large_string())
    offsets = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int64)
    data = words.buffers()[2]
    return bytes(data[int(offsets[0]) : int(offsets[-1])]) if data is not None else b"", np.diff(offsets).astype(np.int32).tobytes()


#: A Parquet reader holds a row group's rows at once: so much of a table of chunks.
GROUP_BYTES = 8 << 20


def pressed(x: bytes) -> bytes:
    """Bytes of a chunk's column, compressed: rows stay small in readers, batches and shuffles."""
    return zlib.compress(x, 1)


def steps(x: np.ndarray) -> bytes:
    """Layout numbers by their steps, compressed."""
    return pressed(np.diff(x.astype(np.int32), prepend=np.int32(0)).tobytes())


class Chunk:
    """A row of :func:`packed`."""

    def __init__(self, row: dict):
        self.name, self.corpora, self.pages = row["chunk"], row["corpus"], row["page"]
        self.sizes = np.array(row["size"], np.int64)
        self.columns = {c: np.cumsum(ints(zlib.decompress(row[c])), dtype=np.int32) for c in PLACES}
        self.kind = np.frombuffer(zlib.decompress(row["kind"]), np.uint8)
        self.page = np.repeat(np.arange(len(self.sizes)), self.sizes)
        self.row = row

    def words(self) -> pa.Array:
        return texts(zlib.decompress(self.row["data"]), ints(zlib.decompress(self.row["lengths"])))

    def numbers(self, head: object) -> np.ndarray:
        """The first 12 hex digits of the md5 of ``head|page|pos``, as numbers."""
        return (arrays.Keys(self.pages, self.page, self.columns["pos"]).of(head)[0] >> np.uint64(16)).astype(np.int64)

    def filled(self, **columns: pa.Array) -> dict[str, pa.Array]:
        """The places' columns beside others."""
        at = pa.array(self.page)
        out = {"corpus": pa.array(self.corpora, pa.string()).take(at), "page": pa.array(self.pages, pa.string()).take(at)}
        return out | {c: pa.array(x) for c, x in self.columns.items()} | columns


def pages_of(source: Iterator[pa.RecordBatch], run: tuple[str, ...]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """About :data:`CHUNK` rows at a time of rows that come page by page, never a part of a page, and where its pages start."""

    def starts(table: pa.Table) -> np.ndarray:
        out = np.zeros(table.num_rows, bool)
        out[:1] = True
        for c in run:
            x = table[c].combine_chunks()
            x = np.asarray((x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x).dictionary_encode().indices.fill_null(-1))
            out[1:] |= x[1:] != x[:-1]
        return out

    held, size, most = [], 0, CHUNK
    for batch in source:
        held.append(batch)
        size += batch.num_rows
        if size < most:
            continue
        table = pa.Table.from_batches(held)
        first = starts(table)
        cut = int(np.flatnonzero(first)[-1])
        if not cut:
            held, most = table.combine_chunks().to_batches(), 2 * size
            continue
        yield table.slice(0, cut), first[:cut]
        held, size, most = table.slice(cut).to_batches(), size - cut, CHUNK
    if size:
        table = pa.Table.from_batches(held)
        yield table, starts(table)


def packed(toks: DataFrame, kind: Column, whole: bool = False) -> DataFrame:
    """Chunks of whole pages in order, written as a table; ``kind`` is a number under 256 of each place.

    ``whole`` as for :func:`.tallies.tallied`. Pages without a corpus aren't drawn for and are left out.
    """
    if not whole:
        toks = toks.repartition("corpus", "page").sortWithinPartitions("corpus", "page", "pos")
    places = [F.col(c).cast("int").alias(c) for c in PLACES]
    rows = toks.where("corpus is not null").select("corpus", F.col("page").cast("string").alias("page"), *places, kind.cast("int").alias("kind"), "w")

    def chunk(table: pa.Table, starts: np.ndarray, name: str) -> pa.RecordBatch:
        first = np.flatnonzero(starts)
        heads = table.take(pa.array(first))
        data, lengths = packed_words(pa.concat_arrays([c.cast(pa.large_string()) for c in table["w"].chunks]))
        one = {"chunk": name, "corpus": heads["corpus"].to_pylist(), "page": heads["page"].to_pylist(), "size": np.diff(np.append(first, table.num_rows)).tolist()}
        one |= {c: steps(table[c].to_numpy()) for c in PLACES} | {"kind": pressed(table["kind"].to_numpy().astype(np.uint8).tobytes()), "data": pressed(data), "lengths": pressed(lengths)}
        kinds = {"chunk": pa.string(), "corpus": pa.list_(pa.string()), "page": pa.list_(pa.string()), "size": pa.list_(pa.int32())}
        return pa.RecordBatch.from_pydict({c: pa.array([v], kinds.get(c, pa.binary())) for c, v in one.items()})

    def pack(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for n, (table, first) in enumerate(pages_of(source, ("corpus", "page"))):
            yield chunk(table, first, f"{TaskContext.get().partitionId()}-{n}")

    return stage.written(rows.mapInArrow(pack, SCHEMA), "chunks", **{"parquet.block.size": GROUP_BYTES, "parquet.block.size.row.check.min": 4, "parquet.page.size.row.check.min": 4})


def each(chunks: DataFrame, f: Callable[[Chunk], Iterator[dict]], schema: str) -> DataFrame:
    """Rows that ``f`` makes of each chunk, as dicts of columns."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for i in range(batch.num_rows):
                for columns in f(Chunk(batch.slice(i, 1).to_pylist()[0])):
                    yield pa.RecordBatch.from_pydict(columns)

    return chunks.mapInArrow(run, schema)


RUNS = "key string, page string, n int, data binary, lengths binary"


def runs(chunks: DataFrame, key: Callable[[str, int], str]) -> DataFrame:
    """(key, page, n, data, lengths): each page's words of each kind in order, by the key of corpus and kind."""

    def cut(c: Chunk) -> Iterator[dict]:
        group = c.page * 256 + c.kind
        order = np.argsort(group, kind="stable")
        known, first = np.unique(group[order], return_index=True)
        words = c.words().take(pa.array(order))
        last = np.append(first[1:], len(order))
        rows = [packed_words(words.slice(int(a), int(b - a))) for a, b in zip(first, last)]
        keys = [key(c.corpora[g // 256], g % 256) for g in known.tolist()]
        yield {
            "key": pa.array(keys, pa.string()), "page": pa.array([c.pages[g // 256] for g in known.tolist()], pa.string()), "n": pa.array((last - first).astype(np.int32)),
            "data": pa.array([r[0] for r in rows], pa.binary()), "lengths": pa.array([r[1] for r in rows], pa.binary()),
        }

    return each(chunks, cut, RUNS)


class Cells:
    """Where the words of each key are: cuts between its pages, the cells' first numbers and ids."""

    def __init__(self, cuts: dict[str, list[str]], sizes: dict[str, dict[int, int]], most: int):
        self.cuts, self.starts, self.first, self.total, n = {}, {}, {}, {}, 0
        for key, own in sizes.items():
            kept, starts, at, open_ = [], [0], 0, 0
            for i in range(max(own) + 1):
                if i and open_ and open_ + own.get(i, 0) > most:
                    kept.append(cuts[key][i - 1])
                    starts.append(at)
                    open_ = 0
                open_ += own.get(i, 0)
                at += own.get(i, 0)
            self.cuts[key], self.starts[key], self.first[key], self.total[key] = kept, np.array(starts), n, at
            n += len(starts)

    def of(self, key: str, page: str) -> int:
        return self.first[key] + bisect_right(self.cuts[key], page)


def dealt(source: DataFrame) -> Cells:
    """Cells of :func:`runs`. Pages are candidates for cuts by a hash, the likelier the more words
    they have; only candidates and their ranges' sizes come to the driver, some per :data:`CELL` words."""
    sizes = stage.written(source.select("key", "page", "n"), "sizes")
    n = sizes.agg(F.sum("n")).first()[0] or 0
    most = max(LEAST, min(CELL, n // 256))
    lot = F.pmod(F.xxhash64("page", "key"), F.lit(1 << 30)) / float(1 << 30)
    cuts: dict[str, list[str]] = {}
    for r in sizes.where(lot < F.col("n") * (FINE / most)).select("key", "page").distinct().collect():
        cuts.setdefault(r.key, []).append(r.page)
    for own in cuts.values():
        own.sort()

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = [bisect_right(cuts.get(k, []), p) for k, p in zip(b["key"].to_pylist(), b["page"].to_pylist())]
            yield pa.RecordBatch.from_pydict({"key": b["key"], "at": pa.array(at, pa.int32()), "n": b["n"]})

    found: dict[str, dict[int, int]] = {}
    for r in sizes.mapInArrow(ranges, "key string, at int, n int").groupBy("key", "at").agg(F.sum("n").alias("n")).collect():
        found.setdefault(r.key, {})[r.at] = r.n
    stage.done(sizes)
    return Cells(cuts, found, most)


def fetched(chunks: DataFrame, source: DataFrame, asked: Callable[[Chunk, Cells], tuple[list[str], np.ndarray, np.ndarray]], write: Callable[[Chunk, pa.Array], Iterator[dict]], schema: str) -> DataFrame:
    """What ``write`` makes of each chunk and the words it asked for.

    ``asked`` gives (keys, which, number): of the key numbered ``which`` the word of that number,
    by page and place; ``write`` gets the words in that order.
    """
    cells = dealt(source)
    shared = source.sparkSession.sparkContext.broadcast(cells)

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for b in batches:
            cell = [known.of(k, p) for k, p in zip(b["key"].to_pylist(), b["page"].to_pylist())]
            yield pa.RecordBatch.from_pydict({"cell": pa.array(cell, pa.int64()), **{c: b[c] for c in ("page", "data", "lengths")}})

    def requests(c: Chunk) -> Iterator[dict]:
        known = shared.value
        keys, which, number = asked(c, known)
        cell, inside = np.empty(len(number), np.int64), np.empty(len(number), np.int32)
        for k, key in enumerate(keys):
            mine = np.flatnonzero(which == k)
            at = np.searchsorted(known.starts[key], number[mine], side="right") - 1
            cell[mine], inside[mine] = known.first[key] + at, number[mine] - known.starts[key][at]
        order = np.argsort(cell, kind="stable")
        ids, first = np.unique(cell[order], return_index=True)
        last = np.append(first[1:], len(order))
        steps = lambda x: np.diff(x, prepend=0).astype(np.int32).tobytes()
        yield {
            "cell": pa.array(ids), "chunk": pa.array([c.name] * len(ids), pa.string()),
            "at": pa.array([steps(order[a:b]) for a, b in zip(first, last)], pa.binary()), "inside": pa.array([inside[order[a:b]].tobytes() for a, b in zip(first, last)], pa.binary()),
        }

    def answer(have: pa.Table, want: pa.Table) -> pa.Table:
        n = want.num_rows
        if n:
            page, data, lengths = (have[c].to_pylist() for c in ("page", "data", "lengths"))
            order = sorted(range(len(page)), key=page.__getitem__)
            text = texts(b"".join(data[i] for i in order), np.concatenate([ints(lengths[i]) for i in order]))
            inside = want["inside"].to_pylist()
            got = text.take(pa.array(np.concatenate([ints(x) for x in inside])))
            last = np.cumsum([len(x) // 4 for x in inside]).tolist()
            parts = [packed_words(got.slice(a, b - a)) for a, b in zip([0, *last], last)]
        return pa.table({
            "chunk": want["chunk"], "at": want["at"],
            "data": pa.array([p[0] for p in parts] if n else [], pa.binary()), "lengths": pa.array([p[1] for p in parts] if n else [], pa.binary()),
        })

    have = source.mapInArrow(words, "cell long, page string, data binary, lengths binary")
    want = each(chunks, requests, "cell long, chunk string, at binary, inside binary")
    answers = have.groupBy("cell").cogroup(want.groupBy("cell")).applyInArrow(answer, ANSWERS)

    def assemble(left: pa.Table, right: pa.Table) -> pa.Table:
        at = [np.cumsum(ints(x)) for x in right["at"].to_pylist()]
        text = texts(b"".join(right["data"].to_pylist()), np.concatenate([ints(x) for x in right["lengths"].to_pylist()]))
        back = np.empty(len(text), np.int64)
        back[np.concatenate(at)] = np.arange(len(text))
        (row,) = left.to_pylist()
        return pa.concat_tables([pa.table(x) for x in write(Chunk(row), text.take(pa.array(back)))])

    return chunks.drop("data", "lengths").groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(assemble, schema)
