"""Substring dedup by relative Lempel-Ziv parsing against indexed reference blocks.

A window is ``width`` consecutive words. The reference of a document is the text of all
documents with smaller ids. It is indexed by anchors, which are chosen by content so that each
window of any document holds one: of the ``seed``-word sequences inside a window, the one with
the least hash. Anchors deal the index to reference blocks, and a document meets every block
that holds a window of it, through the anchors that it shares with the block, and no other.

In its block each anchor occurrence is a fragment: the words that all windows with that anchor
cover. A fragment that a smaller id has as a whole is one factor; equal fragments are known by
two 64-bit hashes, the anchor's and the fragment's. Where an anchor has several different
fragments, the words of each (of its smallest id) are sent to the block and parsed greedily:
a suffix array over the words of the block's fragments, ranked by doubling, gives each place
its longest match in a smaller id, which is the common prefix with the nearest suffix of a
smaller id on either side. From the left end a factor is the longest match, or one word where
there is none. Factors of ``width`` words or more are duplicate spans; the windows that lie
across the boundaries of factors are checked by the longest match at their first word. Words
are compared as words here: a block numbers its distinct words.

An anchor with more than :data:`ANCHOR_FRAGMENTS` different fragments isn't parsed in one
block. All windows of its fragments are dealt by anchor and window hash instead and looked up,
so no task holds an unbounded group, and no window is left out.

Defined cases. Null text: no words. Null ids: such rows neither lose words nor are a
reference. Repeated ids are one document for the comparison of ids and separate rows in the
result; repeated rows are parsed once and all lose the same words. Ties (a word sequence found
twice in one document): a document is never its own reference. A very long text is handled
alone, whole. Empty table: no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels, scratch

WIDTH = 50
SEED = 25
#: Words that one suffix array is built over, at least one anchor's.
BLOCK_WORDS = 1 << 19
#: Anchors with more different fragments are dealt by window.
ANCHOR_FRAGMENTS = 500
#: Tasks that such an anchor's fragments are dealt to.
PIECES = 64
_FRAGMENT = "kind int, rk long, doc_id long, anchor long, cls long, starts array<int>, n int"
_SPAN = "rk long, doc_id long, starts array<int>, n int"


def least_positions(g: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` values, the position of its least one, the leftmost of equals."""
    n = len(g) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    at, size = np.arange(len(g)), 1

    def joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return np.where(g[right] < g[left], right, left)

    while size * 2 <= width:
        at = joined(at[: len(at) - size], at[size:])
        size *= 2
    return joined(at[:n], at[width - size : width - size + n])


def fragments_of(h: np.ndarray, first: np.ndarray, width: int, seed: int) -> tuple[np.ndarray, ...]:
    """Fragments of all rows: (row, anchor hash, class hash, first word in the row, windows)."""
    empty = (np.zeros(0, np.int64),) * 5
    if len(h) < width:
        return empty
    g = kernels.grams(h, seed)
    at = least_positions(g, width - seed + 1)
    row = kernels.row_of(first)
    starts = np.flatnonzero(row[: len(h) - width + 1] == row[width - 1 :])
    if not len(starts):
        return empty
    at = at[starts]
    new = np.concatenate(([True], (at[1:] != at[:-1]) | (starts[1:] != starts[:-1] + 1) | (row[starts[1:]] != row[starts[:-1]])))
    head = np.flatnonzero(new)
    lo, n = starts[head], np.diff(np.append(head, len(starts)))
    anchor = at[head]
    power, inverse = kernels._powers(len(h) + 1)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * power[: len(h)], out=total[1:])
    end = lo + n - 1 + width
    cls = kernels.mix((total[end] - total[lo]) * inverse[lo] + (end - lo).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + (anchor - lo).astype(np.uint64))
    return row[lo], g[anchor].view(np.int64), cls.view(np.int64), lo - first[row[lo]], n


def fragments(width: int, seed: int):
    """Map: fragments of each text; one row for all places of a class in a text, since all share its fate.

    Of one class in a slice of rows only the smallest id has to meet the index (``kind`` 1);
    the others are whole factors already (``kind`` 0), so a class with a third of all rows
    sends few of them.
    """

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in kernels.batches(source, "text"):
            words = kernels.Words(data, at)
            row, anchor, cls, lo, n = fragments_of(words.hashes(), words.first, width, seed)
            if not len(row):
                continue
            order = np.lexsort((lo, n, cls, anchor, row))
            row, anchor, cls, lo, n = (x[order] for x in (row, anchor, cls, lo, n))
            head = np.flatnonzero(_heads(row, anchor, cls, n))
            starts = pa.ListArray.from_arrays(pa.array(np.append(head, len(row)).astype(np.int32)), pa.array(lo.astype(np.int32)))
            row, anchor, cls, n = row[head], anchor[head], cls[head], n[head]
            doc = rows.column("doc_id").to_numpy(zero_copy_only=False)[row]
            order = np.lexsort((doc, cls, anchor))
            lead = np.maximum.accumulate(np.where(_heads(anchor[order], cls[order]), np.arange(len(order)), 0))
            meets = np.empty(len(order), np.int32)
            meets[order] = doc[order] == doc[order[lead]]
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(meets), rows.column("rk").take(take), pa.array(doc), pa.array(anchor), pa.array(cls), starts, pa.array(n.astype(np.int32))],
                names=["kind", "rk", "doc_id", "anchor", "cls", "starts", "n"],
            )

    return run


def _heads(*keys: np.ndarray) -> np.ndarray:
    """Where a new group starts, in rows ordered by the keys."""
    new = np.ones(len(keys[0]), dtype=bool)
    new[1:] = False
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def parse_block(width: int):
    """One block of the index, ordered by anchor, class, id and row, read as a stream; rows of
    kind 0 are factors already and come first.

    kind 0: a fragment of a class that a smaller id has: one whole factor. kind 1: a
    fragment of the smallest id of its class whose anchor has other classes too, so its
    words have to be parsed. State across batches: the current anchor, class and row, and
    the reference rows of the anchor's first class until a second class is seen.
    """

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple | None = None  # anchor, class, first id, whether the anchor has several classes, row
        held: list[pa.RecordBatch] = []
        for batch in source:
            known = batch.column("kind").to_numpy(zero_copy_only=False) == 0
            if known.any():  # only passing through
                yield _found(0, batch, known, width - 1)
                batch = batch.filter(pa.array(~known))
            if not batch.num_rows:
                continue
            doc, anchor, cls, rk = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "anchor", "cls", "rk"))
            new_class = _heads(anchor, cls)
            new_anchor = _heads(anchor)
            once = _heads(anchor, cls, rk)
            if last is not None and last[0] == anchor[0]:
                new_anchor[0] = False
                new_class[0] = last[1] != cls[0]
                once[0] = (last[1], last[4]) != (cls[0], rk[0])
            head = np.maximum.accumulate(np.where(new_class, np.arange(len(doc)), -1))
            first = np.where(head >= 0, doc[np.maximum(head, 0)], last[2] if last else 0)
            # an anchor has several classes if a class starts in it that isn't its first
            group = np.cumsum(new_anchor)
            several = np.bincount(group, weights=new_class & ~new_anchor, minlength=group[-1] + 1) > 0
            if last is not None and last[3]:
                several[0] = True
            own = doc == first
            yield _found(0, batch, ~own & once, width - 1)
            if held and several[0]:
                yield from held
                held = []
            if group[-1] > 0:  # another anchor began: the one before had a single class
                held = []
            yield _found(1, batch, own & once & several[group], 0)
            tail = (group == group[-1]) & own & once & ~several[group]
            if tail.any():
                held.append(_found(1, batch, tail, 0))
            last = anchor[-1], cls[-1], first[-1], bool(several[group[-1]]), rk[-1]

    return run


def _found(kind: int, batch: pa.RecordBatch, which: np.ndarray, more: int) -> pa.RecordBatch:
    mask = pa.array(which)
    rk, doc, anchor, starts, n = (batch.column(c).filter(mask) for c in ("rk", "doc_id", "anchor", "starts", "n"))
    columns = [pa.array(np.full(len(rk), kind, np.int32)), rk, doc, anchor, starts, pa.array(n.to_numpy(zero_copy_only=False) + np.int32(more))]
    return pa.RecordBatch.from_arrays(columns, names=["kind", "rk", "doc_id", "anchor", "starts", "n"])


def cut(width: int):
    """The words of the asked fragments of each text, joined by single spaces."""
    kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.int32(), pa.binary()]
    names = ["anchor", "large", "rk", "doc_id", "starts", "n", "words"]

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in kernels.batches(source, "text"):
            words, raw, out = kernels.Words(data, at), data.tobytes(), []
            for i, (rk, doc, asked) in enumerate(zip(*(rows.column(c).to_pylist() for c in ("rk", "doc_id", "asked")))):
                first = int(words.first[i])
                for f in asked:
                    lo = first + f["starts"][0]
                    part = raw[words.start[lo] : words.end[lo + f["n"] + width - 2]]
                    out.append((f["anchor"], f["large"], rk, doc, f["starts"], f["n"], b" ".join(part.split())))
                if len(out) > 5000:
                    yield batch_of(out)
                    out = []
            if out:
                yield batch_of(out)

    return run


def suffix_ranks(w: np.ndarray, longest: int) -> list[np.ndarray]:
    """``out[j][i]``: the rank of the ``2**j`` numbers from place ``i`` on, among all places.

    Places beyond the end count as less than any number.
    """
    out = [np.unique(w, return_inverse=True)[1].astype(np.int64) + 1]
    h = 1
    while h < longest:
        rank = out[-1]
        after = np.zeros_like(rank)
        after[:-h] = rank[h:]
        out.append(np.unique(rank * (len(w) + 1) + after, return_inverse=True)[1] + 1)
        h *= 2
    return out


def nearest_less(v: np.ndarray) -> np.ndarray:
    """For each place the nearest one before it with a lesser value, or -1."""
    out = np.arange(-1, len(v) - 1)
    open_ = np.flatnonzero((out >= 0) & (v[out] >= v))
    while len(open_):  # what lies between a place and its candidate is no less, so jumps are safe
        out[open_] = out[out[open_]]
        at = out[open_]
        open_ = open_[(at >= 0) & (v[at] >= v[open_])]
    return out


def common_prefix(ranks: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many numbers the suffixes at ``a`` and ``b`` share from their starts on."""
    a, b, total = a.copy(), b.copy(), np.zeros(len(a), np.int64)
    last = len(ranks[0]) - 1
    for j in range(len(ranks) - 1, -1, -1):
        fits = np.maximum(a, b) + (1 << j) <= last + 1
        same = np.flatnonzero(fits & (ranks[j][np.minimum(a, last)] == ranks[j][np.minimum(b, last)]))
        for x in (a, b, total):
            x[same] += 1 << j
    return total


def longest_matches(w: np.ndarray, first: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word of the fragments (numbers ``w``, starts ``first``) the length of its longest
    match in a fragment of a smaller id, and where one is (-1: none).

    In suffix order the longest match of a place is at the nearest suffix of a smaller id
    before or after it.
    """
    size = np.diff(first)
    fragment = np.repeat(np.arange(len(size)), size)
    # a number of its own ends each fragment, so no match runs into the next
    at = np.arange(len(w)) + fragment
    text = np.empty(len(w) + len(size), np.int64)
    text[at] = w
    stop = first[1:] + np.arange(len(size))
    text[stop] = -1 - np.arange(len(size))
    owner = np.empty(len(text), np.int64)
    owner[at], owner[stop] = doc[fragment], np.iinfo(np.int64).max
    ranks = suffix_ranks(text, int(size.max()) + 1)
    order = np.argsort(ranks[-1], kind="stable")
    value = owner[order]
    before = nearest_less(value)
    after = len(value) - 1 - nearest_less(value[::-1])[::-1]
    place = np.empty(len(text), np.int64)
    place[order] = np.arange(len(order))
    best, source = np.zeros(len(w), np.int64), np.full(len(w), -1)
    for near in (before, after):
        j = near[place[at]]
        some = np.flatnonzero((j >= 0) & (j < len(order)))
        there = order[j[some]]
        got = common_prefix(ranks, at[some], there)
        longer = got > best[some]
        best[some[longer]], source[some[longer]] = got[longer], there[longer]
    back = np.full(len(text), -1)
    back[at] = np.arange(len(w))
    return best, np.where(source >= 0, back[source], -1)


def factors(length: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The greedy parse of each fragment: (first word, words) of its factors; a word without a
    match is a factor of one."""
    at, parts = first[:-1][np.diff(first) > 0], []
    end = first[1:][np.diff(first) > 0]
    while len(at):
        n = np.maximum(length[at], 1)
        parts.append((at, n))
        more = at + n < end
        at, end = (at + n)[more], end[more]
    return tuple(np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 2


def spans_of(length: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Duplicate spans (first word, words): the long factors, and the windows across the
    boundaries of factors whose longest match has them whole."""
    start, n = factors(length, first)
    long = n >= width
    inside = np.zeros(len(length) + 1, np.int64)  # windows inside a long factor
    np.add.at(inside, start[long], 1)
    np.add.at(inside, start[long] + n[long] - width + 1, -1)
    across = np.flatnonzero((np.cumsum(inside)[:-1] == 0) & (length >= width))
    return np.concatenate((start[long], across)), np.concatenate((n[long], np.full(len(across), width)))


def numbered(words: kernels.Words) -> np.ndarray:
    """Each word's number among the distinct ones, compared by bytes."""
    lengths = words.end - words.start
    edge = np.concatenate(([0], np.cumsum(lengths)))
    solid = words.data[np.arange(edge[-1]) + np.repeat(words.start - edge[:-1], lengths)]
    column = pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(edge.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(solid))])
    return column.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)


def parse_fragments(width: int, block_words: int):
    """Fragments ordered by anchor -> kind 0: spans of whole blocks parsed one after another, and
    windows of ``large`` anchors that a smaller id among the same rows has; kind 1: their other
    windows (hash in ``key``), to be looked up."""

    def parsed(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        data, at = kernels.buffer(rows["words"])
        words = kernels.Words(data, at)
        length, _ = longest_matches(numbered(words), words.first, rows["doc_id"].to_numpy())
        start, n = spans_of(length, words.first, width)
        if len(start):
            row = np.searchsorted(words.first, start, "right") - 1
            yield _moved(rows, row, start - words.first[row], n, 0, None)

    def windows(rows: pa.Table) -> pa.RecordBatch:
        data, at = kernels.buffer(rows["words"])
        words = kernels.Words(data, at)
        g = kernels.grams(words.hashes(), width)
        n = rows["n"].to_numpy().astype(np.int64)
        row = np.repeat(np.arange(len(n)), n)
        k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        key, anchor, doc = g[words.first[row] + k].view(np.int64), rows["anchor"].to_numpy()[row], rows["doc_id"].to_numpy()[row]
        # of one window in these rows only the smallest id has to meet the others
        order = np.lexsort((doc, key, anchor))
        lead = np.maximum.accumulate(np.where(_heads(anchor[order], key[order]), np.arange(len(order)), 0))
        meets = np.empty(len(order), np.int32)
        meets[order] = doc[order] == doc[order[lead]]
        return _moved(rows, row, k, np.full(len(row), width), meets, key)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for batch in source:
            if not batch.num_rows:
                continue
            large = batch.column("large")
            if pa.compute.any(large).as_py():
                yield windows(pa.Table.from_batches([batch.filter(large)]))
                batch = batch.filter(pa.compute.invert(large))
                if not batch.num_rows:
                    continue
            key, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("anchor", "n"))
            total = size + np.cumsum(n.astype(np.int64) + width - 1)
            done = 0
            for at in np.flatnonzero(_heads(key)).tolist():  # a block ends where an anchor starts
                before = size if at == 0 else int(total[at - 1])
                if before >= block_words and (at or key[0] != last):
                    yield from parsed(pa.Table.from_batches([*held, batch.slice(done, at - done)]))
                    held, size, done, total = [], 0, at, total - before
            held.append(batch.slice(done))
            size, last = int(total[-1]), key[-1]
        if held:
            yield from parsed(pa.Table.from_batches(held))

    return run


def _moved(rows: pa.Table, row: np.ndarray, offset: np.ndarray, n: np.ndarray, kind: int | np.ndarray, key: np.ndarray | None) -> pa.RecordBatch:
    """Spans at ``offset`` in the fragments ``row``, at all places that each fragment has in its text."""
    lists = rows["starts"].combine_chunks()
    edge = lists.offsets.to_numpy().astype(np.int64)
    flat = lists.values.to_numpy(zero_copy_only=False).astype(np.int64)
    length = np.diff(edge)[row]
    ends = np.cumsum(length)
    total = int(ends[-1]) if len(ends) else 0
    place = np.arange(total) - np.repeat(ends - length, length) + np.repeat(edge[:-1][row], length)
    moved = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)).astype(np.int32)), pa.array((flat[place] + np.repeat(offset, length)).astype(np.int32)))
    take = pa.array(row)
    columns = [rows[c].combine_chunks().take(take) for c in ("anchor", "rk", "doc_id")]
    keys = pa.nulls(len(row), pa.int64()) if key is None else pa.array(key)
    return pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(np.int32(kind), len(row)).astype(np.int32)), keys, *columns, moved, pa.array(n.astype(np.int32))], names=["kind", "key", "anchor", "rk", "doc_id", "starts", "n"])


def _unpack(structs: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(all starts, where each struct's starts begin and the last end, n) of structs (starts, n)."""
    lists = structs.field("starts")
    edge = lists.offsets.to_numpy().astype(np.int64)
    return lists.values.to_numpy(zero_copy_only=False).astype(np.int64), edge, structs.field("n").to_numpy(zero_copy_only=False).astype(np.int64)


def look_up(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows ordered by anchor, hash and id: those that a smaller id has become spans."""
    last: tuple | None = None
    for batch in source:
        if not batch.num_rows:
            continue
        anchor, key, doc = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("anchor", "key", "doc_id"))
        new = _heads(anchor, key)
        if last is not None and last[:2] == (anchor[0], key[0]):
            new[0] = False
        head = np.maximum.accumulate(np.where(new, np.arange(len(doc)), -1))
        first = np.where(head >= 0, doc[np.maximum(head, 0)], last[2] if last else 0)
        hit = pa.array(doc != first)
        yield pa.RecordBatch.from_arrays([batch.column(c).filter(hit) for c in ("rk", "doc_id", "starts", "n")], names=["rk", "doc_id", "starts", "n"])
        last = anchor[-1], key[-1], first[-1]


def keyed(docs: DataFrame) -> DataFrame:
    """(rk, doc_id, text): rk stands for id and text, so repeated ids stay apart."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc = F.col("doc_id").cast("long")
    return docs.select(F.xxhash64(doc, text).alias("rk"), doc.alias("doc_id"), text.alias("text"))


def spans(docs: DataFrame, width: int = WIDTH, seed: int = SEED, block_words: int = BLOCK_WORDS, anchor_fragments: int = ANCHOR_FRAGMENTS) -> DataFrame:
    """Duplicate spans (rk, doc_id, starts, n), in words: each start begins one of ``n``; they may overlap."""
    known = keyed(docs).where("doc_id is not null")
    index = scratch.arrow(known, fragments(width, seed), _FRAGMENT)
    dealt = F.when(F.col("kind") == 0, F.col("rk")).otherwise(F.col("anchor"))
    block = index.repartition(dealt).sortWithinPartitions("kind", "anchor", "cls", "doc_id", "rk")
    told = scratch.keep(scratch.arrow(block, parse_block(width), "kind int, rk long, doc_id long, anchor long, starts array<int>, n int"), "rlz-classes")
    several = told.where("kind = 1").select("rk", "anchor", "starts", "n")
    many = scratch.keep(several.groupBy("anchor").count().where(F.col("count") > anchor_fragments).select("anchor", F.lit(True).alias("large")), "rlz-large")
    several = several.join(many, "anchor", "left").withColumn("large", F.coalesce("large", F.lit(False)))
    asked = several.groupBy("rk").agg(F.collect_list(F.struct("anchor", "large", "starts", "n")).alias("asked"))
    met = known.join(asked.hint("merge"), "rk").select("rk", "doc_id", "text", "asked")
    words = scratch.arrow(met, cut(width), "anchor long, large boolean, rk long, doc_id long, starts array<int>, n int, words binary")
    piece = F.when(F.col("large"), F.pmod("rk", F.lit(PIECES)))
    dealt = words.repartition(F.col("anchor"), piece).sortWithinPartitions("anchor", "doc_id")
    parsed = scratch.keep(scratch.arrow(dealt, parse_fragments(width, block_words), "kind int, key long, anchor long, " + _SPAN), "rlz-parsed")
    large = parsed.where("kind = 1").repartition("anchor", "key").sortWithinPartitions("anchor", "key", "doc_id")
    out = told.where("kind = 0").select("rk", "doc_id", "starts", "n").unionByName(parsed.where("kind = 0").select("rk", "doc_id", "starts", "n"))
    return out.unionByName(scratch.arrow(large.select("anchor", "key", "rk", "doc_id", "starts", "n"), look_up, _SPAN))


def _kept(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_text", pa.string())])
    for rows, data, at in kernels.batches(source, "text"):
        raw = data.tobytes()
        ids, found = rows.column("doc_id").to_pylist(), rows.column("found")
        start, edge, n = _unpack(found.flatten())
        n = np.repeat(n, np.diff(edge))
        start = start[edge[0] : edge[-1]] if len(edge) else start
        offsets = found.offsets.to_numpy()
        offsets = (edge - edge[0])[offsets - offsets[0]]
        out = []
        for i, doc in enumerate(ids):
            words = raw[at[i] : at[i + 1]].split()
            removed = 0
            if (lo := offsets[i]) < (hi := offsets[i + 1]):
                edge = np.bincount(start[lo:hi], minlength=len(words) + 1)[: len(words) + 1] - np.bincount(start[lo:hi] + n[lo:hi], minlength=len(words) + 1)[: len(words) + 1]
                keep = np.flatnonzero(np.cumsum(edge)[: len(words)] == 0)
                removed = len(words) - len(keep)
                out.append((doc, len(words), removed, b" ".join([words[j] for j in keep.tolist()])))
            else:
                out.append((doc, len(words), 0, b" ".join(words)))
        columns = list(zip(*out))
        text = pa.array(columns[3], pa.binary()).cast(pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns[:3], schema)] + [text], schema=schema)


def remove(docs: DataFrame, width: int = WIDTH, seed: int = SEED, block_words: int = BLOCK_WORDS, anchor_fragments: int = ANCHOR_FRAGMENTS) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text of every row."""
    found = spans(docs, width, seed, block_words, anchor_fragments).select("rk", "starts", "n").groupBy("rk").agg(F.collect_list(F.struct("starts", "n")).alias("found"))
    none = F.array().cast("array<struct<starts:array<int>,n:int>>")
    met = keyed(docs).join(found.hint("merge"), "rk", "left").select("doc_id", "text", F.coalesce("found", none).alias("found"))
    return scratch.arrow(met, _kept, "doc_id long, n_words long, n_removed long, kept_text string")
