"""N-gram Jaccard join by T-occurrence search.

A document's set has its distinct ``width``-word shingles, lower-cased; two link when 100 *
intersection >= ``percent`` * union. Documents with equal sets form a class and are handled
once. Two linked sets share at least ``k`` shingles among the first
``n - ceil(percent * n / 100) + k`` of each, in any fixed order of all shingles. The order
is by a fixed-size count sketch of the whole corpus, rare first, so frequent shingles (shared
lines, licences) are in those prefixes only where documents consist of them. Classes that
don't share ``k`` of their prefix's shingles with others, counted exactly, are linked with
nothing. The one-shingle prefixes of those that are left deal them: all classes with one
prefix shingle meet in the group of its least class.

In a group, inverted lists are searched per set with DivideSkip: short lists are merged by
counting, the longest ones are only probed by binary search for what the merge brought up, and
sets that reach the required overlap are retained. Every set is searched, and each link counts
once: in the group of the least class that stands for a prefix shingle of both sets. Only links
that join components go out, beside the number of links of each class. Groups over
:data:`GROUP_SHINGLES` are split into pairs of blocks, so no task holds an unbounded group.

Defined cases. Null or blank text: an empty set, linked with nothing, its own component.
Fewer words than ``width``: the whole sequence is the only shingle. A null id takes part;
it is a component's id only if all ids are null. Repeated rows: equal sets, one class. Ties in
the order of shingles go by hash. A very long text is one set, whole, read alone. Empty table:
no rows. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import components, kernels, scratch

WIDTH = 5
PERCENT = 80
SKETCH_BITS = 22
GROUP_SHINGLES = 500_000
#: Percent of a set's shingles that have to be shared inside its longer prefix.
SHARED_PERCENT = 10
#: Classes that met others are broadcast up to so many bytes, checked; beyond, a shuffle join.
BROADCAST_BYTES = 32 << 20


def sets_of(data: np.ndarray, at: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    words = kernels.Words(data, at, lower=True)
    h = words.hashes()
    g = kernels.grams(h, width)
    first = words.first
    for i in range(len(first) - 1):
        lo, hi = int(first[i]), int(first[i + 1])
        if hi - lo >= width:
            yield np.unique(g[lo : hi - width + 1])
        elif hi > lo:
            yield kernels.grams(h[lo:hi], hi - lo)
        else:
            yield g[:0]


def class_of(s: np.ndarray) -> int:
    """A 64-bit identity of a set; two sums keep structured sets apart."""
    if not len(s):
        return 0
    a, b = int(kernels.mix(s).sum(dtype=np.uint64)), int(kernels.mix(s ^ np.uint64(0xA5A5A5A5DEADBEEF)).sum(dtype=np.uint64))
    both = np.array([a ^ ((b << 23 | b >> 41) & 0xFFFFFFFFFFFFFFFF) ^ len(s)], dtype=np.uint64)
    return int(kernels.mix(both).view(np.int64)[0])


_BLOCK = 1 << 16


def describe(width: int, bits: int):
    """Per row (doc_id, n, cls); per task the sketch of shingle counts, as packed blocks of counters."""
    schema = pa.schema([("doc_id", pa.int64()), ("rk", pa.int64()), ("n", pa.int64()), ("cls", pa.int64()), ("block", pa.int32()), ("counters", pa.binary())])

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, mask = np.zeros(1 << bits, dtype=np.uint32), np.uint64((1 << bits) - 1)
        for rows, data, at in kernels.batches(source, "text"):
            sizes, classes, slots = [], [], []
            for s in sets_of(data, at, width):
                sizes.append(len(s))
                classes.append(class_of(s))
                slots.append(s & mask)
            np.add.at(counts, np.concatenate(slots).astype(np.int64), 1)
            none = pa.nulls(len(sizes), pa.int32())
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("rk"), pa.array(sizes, pa.int64()), pa.array(classes, pa.int64()), none, pa.nulls(len(sizes), pa.binary())], schema=schema)
        if counts.any():
            parts = [zlib.compress(counts[i : i + _BLOCK].astype(np.int64).tobytes(), 1) for i in range(0, len(counts), _BLOCK)]
            none = pa.nulls(len(parts), pa.int64())
            yield pa.RecordBatch.from_arrays([none, none, none, none, pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], schema=schema)

    return run


def _added(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums packed counter blocks by number inside one task."""
    total: dict[int, np.ndarray] = {}
    for batch in source:
        for k, b in zip(batch.column("block").to_pylist(), batch.column("counters")):
            part = np.frombuffer(zlib.decompress(b.as_buffer()), dtype=np.int64)
            total[k] = total[k] + part if k in total else part
    if total:
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([zlib.compress(v.tobytes(), 1) for v in total.values()], pa.binary())], names=["block", "counters"])


def sketch(blocks: DataFrame, bits: int) -> np.ndarray:
    """The corpus sketch: fixed size, whatever the corpus. Counts are for ordering only."""
    summed = scratch.arrow(blocks.repartition(F.col("block")), _added, "block int, counters binary")
    out = np.zeros(1 << bits, dtype=np.uint32)
    for block, counters in summed.toLocalIterator():
        part = np.frombuffer(zlib.decompress(counters), dtype=np.int64)
        out[block * _BLOCK : block * _BLOCK + len(part)] = np.minimum(part, 0xFFFFFFFF)
    return out


def least_shared(n: int, shared_percent: int) -> int:
    """``k``: how many prefix shingles two linked sets share at least, as the set of ``n`` sees it."""
    return max(1, shared_percent * n // 100)


def prefix_of(s: np.ndarray, counts: np.ndarray, percent: int, k: int) -> np.ndarray:
    """The first ``n - ceil(percent * n / 100) + k`` shingles, rare ones first, then by hash."""
    p = len(s) - -(-percent * len(s) // 100) + k
    if p >= len(s):
        return s
    rank = counts[(s & np.uint64(len(counts) - 1)).astype(np.int64)]
    border = np.partition(rank, p - 1)[p - 1]
    sure = np.flatnonzero(rank < border)
    return s[np.concatenate((sure, np.flatnonzero(rank == border)[: p - len(sure)]))]


def _postings(tokens: list[np.ndarray], sizes: list[int], classes: list[int]) -> pa.RecordBatch:
    lengths = [len(t) for t in tokens]
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate(tokens).view(np.int64)), pa.array(np.repeat(np.array(sizes, np.int64), lengths)), pa.array(np.repeat(np.array(classes, np.int64), lengths))],
        names=["token", "n", "cls"],
    )


_POSTINGS = "token long, n long, cls long"


def prefixes(width: int, percent: int, order, shared_percent: int):
    """(token, n, cls) of the longer prefix of each text's set."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, at in kernels.batches(source, "text"):
            sets = [s for s in sets_of(data, at, width) if len(s)]
            if sets:
                yield _postings([prefix_of(s, order.value, percent, least_shared(len(s), shared_percent)) for s in sets], [len(s) for s in sets], [class_of(s) for s in sets])

    return run


def prefixes_of_sets(percent: int, order):
    """The same for stored sets."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            if batch.num_rows:
                sets = [x.values.to_numpy(zero_copy_only=False).view(np.uint64) for x in batch.column("shingles")]
                yield _postings([prefix_of(s, order.value, percent, 1) for s in sets], batch.column("n").to_pylist(), batch.column("member").to_pylist())

    return run


def _grouped_by_token(source: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows ordered by (token, n, cls) -> per batch (cls, the token's least class, whether that is another).

    Of equal rows the first counts.
    """
    last: tuple | None = None
    row: tuple | None = None
    for batch in source:
        if not batch.num_rows:
            continue
        token, _, cls = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        once = np.ones(len(token), bool)
        once[1:] = (token[1:] != token[:-1]) | (cls[1:] != cls[:-1])
        once[0] = row != (token[0], cls[0])
        row = token[-1], cls[-1]
        token, cls = token[once], cls[once]
        if not len(token):
            continue
        new = np.ones(len(token), bool)
        new[1:] = token[1:] != token[:-1]
        if last is not None and last[0] == token[0]:
            new[0] = False
        head = np.maximum.accumulate(np.where(new, np.arange(len(token)), -1))
        pivot = np.where(head >= 0, cls[np.maximum(head, 0)], last[1] if last else 0)
        last = token[-1], pivot[-1]
        yield cls, pivot, pivot != cls


def shared_counts(buckets: int):
    """How many of its tokens each class shares with another; rows are ordered by (token, n, cls).

    Goes out as a few rows per task: for each bucket of classes, their numbers side by side.
    """

    def packed(parts: list[np.ndarray]) -> pa.RecordBatch:
        cls, n = np.unique(np.concatenate(parts), return_counts=True)
        bucket = (kernels.mix(cls.view(np.uint64)) % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        offsets = np.searchsorted(bucket[order], np.arange(buckets + 1)).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x[order])) for x in (cls, n.astype(np.int64))]
        return pa.RecordBatch.from_arrays([pa.array(np.arange(buckets, dtype=np.int32)), *lists], names=["bucket", "cls", "shared"]).filter(pa.array(np.diff(offsets) > 0))

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held, before = [], 0, False
        for cls, pivot, other in _grouped_by_token(source):
            # a token's least class has company as soon as its second row comes
            follows = np.concatenate(([before], other[:-1]))
            parts += [cls[other], pivot[other & ~follows]]
            before = bool(other[-1])
            held += len(cls)
            if held > 2_000_000:
                yield packed(parts)
                parts, held = [], 0
        if parts:
            yield packed(parts)

    return run


def summed_counts(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cls, shared) of whole buckets of classes."""
    keys, sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in source:
        if not batch.num_rows:
            continue
        cls, n = (np.concatenate((x, batch.column(c).flatten().to_numpy(zero_copy_only=False))) for x, c in ((keys, "cls"), (sums, "shared")))
        order = np.argsort(cls, kind="stable")
        cls, n = cls[order], n[order]
        first = np.flatnonzero(np.concatenate(([True], cls[1:] != cls[:-1])))
        keys, sums = cls[first], np.add.reduceat(n, first)
    yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sums)], names=["cls", "shared"])


def meet(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows ordered by (token, n, cls) -> (pivot, member) of each token with several classes."""
    for cls, pivot, other in _grouped_by_token(source):
        if other.any():
            pair = np.unique(np.stack((pivot[other], cls[other]), axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1])], names=["pivot", "member"])


def divide_skip(lists: list[np.ndarray], least: int, mu: float = 0.01) -> dict[int, int]:
    """Members found in at least ``least`` of the sorted lists, with the number of lists."""
    who, total = _found_often(lists, least, mu)
    return dict(zip(who.tolist(), total.tolist()))


def _found_often(lists: list[np.ndarray], least: int, mu: float = 0.01) -> tuple[np.ndarray, np.ndarray]:
    """The same as arrays.

    The longest lists are left out of the merge and probed by binary search for members that
    the short ones bring up often enough; where those are most of a list, it is merged too.
    """
    lists = sorted(lists, key=len)
    if not lists or len(lists) < least:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    longest = len(lists[-1])
    long = min(len(lists) - 1, least - 1, int(least / (mu * math.log2(longest + 1) + 1)))
    short, rest = lists[: len(lists) - long], lists[len(lists) - long :]
    who, total = _merged(short)
    often = total >= least - long
    who, total = who[often], total[often]
    if len(who) and rest:
        if len(who) * math.log2(longest + 1) > longest:
            more, times = _merged(rest)
            at = np.minimum(np.searchsorted(more, who), len(more) - 1)
            total = total + np.where(more[at] == who, times[at], 0)
        else:
            for x in rest:
                at = np.minimum(np.searchsorted(x, who), len(x) - 1)
                total += x[at] == who
    keep = total >= least
    return who[keep], total[keep]


def _merged(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The members of the lists and how many lists have each."""
    each = np.concatenate(lists)
    if not len(each) or int(each.max()) > 4 * len(each):
        return np.unique(each, return_counts=True)
    total = np.bincount(each)
    who = np.flatnonzero(total)
    return who, total[who]


def all_links(sets: list[np.ndarray], percent: int = PERCENT, split: int | None = None, skip: Callable[[int], np.ndarray] | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """Every link once, as (i, the later sets linked with it).

    With ``split``, only links between the sets before it and the others. ``skip(i)`` tells
    which sets' links with ``i`` aren't wanted.
    """
    m = len(sets)
    sizes = np.array([len(s) for s in sets])
    tokens = np.concatenate(sets)
    order = np.argsort(tokens, kind="stable")
    tokens, member = tokens[order], np.repeat(np.arange(m, dtype=np.int32), sizes)[order]
    head = np.flatnonzero(np.concatenate(([True], tokens[1:] != tokens[:-1])))
    lengths = np.diff(np.append(head, len(tokens)))
    # per shingle of a set: where the later members of its list start and end
    start, stop = np.empty(len(tokens), np.int32), np.empty(len(tokens), np.int32)
    start[order] = np.arange(1, len(tokens) + 1) if split is None else np.repeat(head + np.add.reduceat(member < split, head, dtype=np.int64), lengths)
    stop[order] = np.repeat(head + lengths, lengths)
    at = np.concatenate(([0], np.cumsum(sizes)))
    for q in range(m if split is None else split):
        wanted = None if skip is None else ~skip(q)
        if wanted is not None and not wanted[q + 1 if split is None else split :].any():
            continue
        lo, hi, n = start[at[q] : at[q + 1]], stop[at[q] : at[q + 1]], int(sizes[q])
        some = hi > lo
        j, inter = _found_often([member[x:y] for x, y in zip(lo[some].tolist(), hi[some].tolist())], -(-percent * n // 100))
        ok = 100 * inter >= percent * (n + sizes[j] - inter)
        if wanted is not None:
            ok &= wanted[j]
        if ok.any():
            yield q, j[ok]


class Forest:
    """Components of sets; says which links join two of them."""

    def __init__(self, m: int):
        self.label = np.arange(m)
        self.members: dict[int, list[int]] = {}

    def joining(self, q: int, js: np.ndarray) -> list[tuple[int, int]]:
        labels, first = np.unique(self.label[js], return_index=True)
        out = []
        for b, i in zip(labels.tolist(), first.tolist()):
            a = int(self.label[q])
            if a != b:
                out.append((q, int(js[i])))
                some, others = self.members.pop(a, [a]), self.members.pop(b, [b])
                a, some, others = (a, some, others) if len(some) >= len(others) else (b, others, some)
                self.label[others] = a
                self.members[a] = some + others
        return out


def linked(sets: list[np.ndarray], percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links (i, j) that connect the sets as all their links do, at most one less than sets."""
    forest = Forest(len(sets))
    return [x for q, js in all_links(sets, percent) for x in forest.joining(q, js)]


def met_before(pivots: list[np.ndarray], pivot: int) -> Callable[[int], np.ndarray] | None:
    """For a set's number, which sets share a lesser pivot with it: those links count there."""
    lesser = [p[p < pivot] for p in pivots]
    at = np.concatenate(([0], np.cumsum([len(p) for p in lesser])))
    if not at[-1]:
        return None
    names, flat = np.unique(np.concatenate(lesser), return_inverse=True)

    def skip(q: int) -> np.ndarray:
        mark = np.zeros(len(names), bool)
        mark[flat[at[q] : at[q + 1]]] = True
        hits = np.concatenate(([0], np.cumsum(mark[flat])))
        return hits[at[1:]] > hits[at[:-1]]

    return skip


def _flat_sets(width: int):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, data, at in kernels.batches(source, "text"):
            sets = list(sets_of(data, at, width))
            yield pa.RecordBatch.from_arrays(
                [pa.array([class_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))],
                names=["member", "n", "shingles"],
            )

    return run


def search(percent: int):
    """Rows ordered by (pivot, i, j): each run is a group, or a block of it with another.

    Links that join components go out as class pairs (a, b); all links are counted, each in
    the group of the least pivot that both classes have: (a, the rows linked with it).
    """

    def emit(key: tuple | None, group: list[tuple]) -> Iterator[tuple]:
        if len(group) < 2:
            return
        pivot, i, j = key
        group = sorted(group, key=lambda x: x[1] == j) if i < j else group
        ids, blocks, rows, pivots, sets = zip(*group)
        split = blocks.index(j) if i < j and j in blocks else None
        if i < j and not split:  # one block only: its own cell has it
            return
        rows, counts, forest = np.array(rows), np.zeros(len(ids), np.int64), Forest(len(ids))
        for q, js in all_links(list(sets), percent, split, met_before(list(pivots), pivot)):
            counts[q] += rows[js].sum()
            counts[js] += rows[q]
            yield from ((ids[a], ids[b], None) for a, b in forest.joining(q, js))
        yield from ((ids[k], None, int(counts[k])) for k in np.flatnonzero(counts))

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group, out = None, [], []
        for batch in source:
            names = [batch.column(c).to_pylist() for c in ("pivot", "i", "j", "member", "mine", "rows")]
            lists = [(batch.column(c).offsets.to_numpy(), batch.column(c).values.to_numpy(zero_copy_only=False)) for c in ("pivots", "shingles")]
            for r, (pivot, i, j, member, mine, rows) in enumerate(zip(*names)):
                if (pivot, i, j) != key:
                    out += emit(key, group)
                    key, group = (pivot, i, j), []
                pivots, shingles = (flat[at[r] : at[r + 1]].copy() for at, flat in lists)
                group.append((member, mine, rows, pivots, shingles.view(np.uint64)))
            if len(out) > 10_000:
                yield _links(out)
                out = []
        out += emit(key, group)
        if out:
            yield _links(out)

    return run


def _links(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], names=["a", "b", "n"])


def _by_token(postings: DataFrame) -> DataFrame:
    return postings.repartition(F.col("token")).sortWithinPartitions("token", "n", "cls")


def _texts(slim: DataFrame, classes: DataFrame) -> DataFrame:
    """The texts of one document of each class; a checked size decides how they are fetched."""
    side = classes.select("rk")
    side = F.broadcast(side) if classes.count() * 16 <= BROADCAST_BYTES else side.hint("merge")
    return slim.join(side, "rk", "left_semi").select("text")


def joined(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT, group_shingles: int = GROUP_SHINGLES) -> DataFrame:
    """(doc_id, rk, n_shingles, component_id, n_links) of every row; rk stands for id and text.

    ``n_links`` is the number of other rows that the row links with; rows with equal sets link.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc = F.col("doc_id").cast("long")
    slim = docs.select(F.xxhash64(doc, text).alias("rk"), doc.alias("doc_id"), text.alias("text"))
    told = scratch.keep(scratch.arrow(slim, describe(width, SKETCH_BITS), "doc_id long, rk long, n long, cls long, block int, counters binary"), "shingle-classes")
    rows = told.where("block is null").select("doc_id", "rk", "n", "cls")
    order = spark.sparkContext.broadcast(sketch(told.where("block is not null").select("block", "counters"), SKETCH_BITS))
    classes = scratch.keep(rows.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("least_id"), F.min("rk").alias("rk"), F.first("n").alias("n"), F.count("*").alias("rows")), "classes")

    tokens = scratch.arrow(slim.select("text"), prefixes(width, percent, order, SHARED_PERCENT), _POSTINGS)
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = scratch.arrow(_by_token(tokens), shared_counts(buckets), "bucket int, cls array<long>, shared array<long>")
    counts = scratch.arrow(counts.repartition(F.col("bucket")), summed_counts, "cls long, shared long")
    least_shared_ = F.greatest(F.lit(1), F.floor(F.col("n") * SHARED_PERCENT / 100))
    left = scratch.keep(classes.join(counts, "cls").where(F.col("shared") >= least_shared_).select("cls", "rk", "n", "rows"), "left")

    sets = scratch.arrow(_texts(slim, left), _flat_sets(width), "member long, n long, shingles array<long>")
    sets = scratch.keep(sets.dropDuplicates(["member"]).join(left.select(F.col("cls").alias("member"), "rows"), "member"), "sets")
    own = scratch.arrow(sets, prefixes_of_sets(percent, order), _POSTINGS)
    pairs = scratch.keep(scratch.arrow(_by_token(own), meet, "pivot long, member long").distinct(), "met")
    members = pairs.unionByName(pairs.select("pivot", F.col("pivot").alias("member")).distinct())
    sized = members.join(sets.select("member", "n"), "member")
    large = scratch.keep(sized.groupBy("pivot").agg(F.ceil(F.sum("n") / group_shingles).cast("int").alias("blocks")).where("blocks > 1"), "large-groups")
    split = members.join(large, "pivot", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    mine = F.pmod(F.xxhash64("member"), F.col("blocks")).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, F.col("mine")).alias("i"), F.greatest(k, F.col("mine")).alias("j")))
    split = split.withColumn("mine", mine).select("pivot", "member", "mine", F.inline(cells))
    met = members.groupBy("member").agg(F.collect_list("pivot").alias("pivots"))
    grouped = split.join(sets.select("member", "rows", "shingles").join(met, "member"), "member").select("pivot", "i", "j", "member", "mine", "rows", "pivots", "shingles")
    found = scratch.arrow(grouped.repartition("pivot", "i", "j").sortWithinPartitions("pivot", "i", "j"), search(percent), "a long, b long, n long")
    found = scratch.keep(found, "links")
    roots = components.label(found.where("b is not null").select("a", "b"))
    links = found.where("b is null").groupBy(F.col("a").alias("cls")).agg(F.sum("n").alias("others"))

    known = classes.join(roots.select(F.col("node").alias("cls"), "root"), "cls", "left").join(links, "cls", "left")
    known = known.select("cls", "least_id", F.coalesce("root", "cls").alias("root"), (F.col("rows") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    known = scratch.keep(known, "class-roots")
    least = scratch.keep(known.groupBy("root").agg(F.min("least_id").alias("component_id")), "component-ids")
    named = scratch.keep(known.join(least, "root").select("cls", "component_id", "n_links"), "class-components")
    out = rows.where("n > 0").join(named, "cls").select("doc_id", "rk", F.col("n").alias("n_shingles"), "component_id", "n_links")
    return out.unionByName(rows.where("n = 0").select("doc_id", "rk", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links")))
