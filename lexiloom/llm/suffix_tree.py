"""Language-model scoring with a probabilistic suffix tree over words.

Symbols are lower-cased words and the end of a text; contexts are the last one to ``depth``
words. The root is the add-one unigram. A context is a candidate if it occurs at least
:data:`LEAST` times in the training texts, whatever their number, so the tree grows with the
corpus. It is retained if its next-symbol distribution diverges from the root's: the sum over
its occurrences of the log ratio of the two, each occurrence left out of its own estimate,
reaches ``cutoff`` nats. Its distribution is smoothed towards the root,
``(c + kappa * root) / (n + kappa)``, and each symbol is scored in the state of its longest
retained suffix. The model is the same whatever the size of the corpus.

Texts are written in chunks of rows. For each length, a chunk sends its distinct (context, next
symbol, count) to the partition of the context's hash, which holds all of that context, decides
and answers the chunk with the occurrences in retained contexts; a pair with a third of all
tokens is one entry a chunk. Chunks then meet their answers and score their texts. Inside a
partition contexts are known by 40 bits of their hash.

A context that occurs more than ``part`` times (or 2**-16 of the training tokens, if that is
more) is dealt out by its next symbol, so no partition holds all of it. Such contexts are known
beforehand: their occurrences are those of their last word in the context one shorter. Each part
answers with its pairs and the whole context's occurrences and notes its share of the gain; the
shares' sum decides, and scorers leave out the answers of contexts that it doesn't retain. Of
the tree only these contexts, at most 2**16 of a length, are collected and broadcast.

Words with at least 1/:data:`BROADCAST` of all training tokens are broadcast with their counts
(at most so many, by counting). The counts of each text's other words are joined to it by a
shuffle before contexts are counted; entries carry them with the word's whole hash.

Two options make other models, neither is used unless given. With ``most_words`` words with less
than ``1/most_words`` of all training tokens share the probability of their class evenly with
unseen words. With ``piece`` a context with more occurrences by its words' counts is told apart
by a hash class of the two words before it, as many classes as pieces: states of the same kind,
a fraction of a word longer, each whole in a partition.

Defined cases. Null text is empty: one end token. A null id trains and isn't held out.
Repeated rows train and are scored one by one; repeated ids are separate rows. No training
rows: every count is zero, no context is retained. Words are compared, so ties don't arise; a
very long text is a slice of its own, whole. Empty table: no rows. Extra columns are ignored,
whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels, scratch

DEPTH = 3
LEAST = 2
CUTOFF = 4.0
KAPPA = 8.0
#: Contexts that occur more often are dealt out by their next symbol. Results don't depend on it.
PART = 1 << 18
#: At most so many words are broadcast; the others' counts are joined. Results don't depend on it.
BROADCAST = 1 << 22
#: Rows of a chunk, as a power of two.
CHUNK_BITS = 10
#: Low bits of an entry that hold the next symbol; the others hold the context.
SYMBOL_BITS = 24
#: A counting task sends on what it has beyond so many words.
_WORDS = 1_500_000
#: Bytes of text handled at once.
_SLICE = 1 << 20
_END_WORD = np.uint64(0x5D1E_AD00_0000_0001)
_START = np.uint64(0x0B57_A127_0000_0003)
#: Words before a text that hash classes of older words read.
_PADS = 2


def merged(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and the sums of their numbers."""
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, int)
    return keys[first], np.add.reduceat(n, first) if len(first) else n


def tokens(words: kernels.Words) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes with one end per row, and where each row starts."""
    rows = len(words.first) - 1
    return np.insert(words.hashes(), words.first[1:], _END_WORD), words.first + np.arange(rows + 1)


def count(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of words (by hash), in parts of bounded size."""
    parts, held = [], 0

    def flushed() -> pa.RecordBatch:
        key, n = merged(*(np.concatenate(x) for x in zip(*parts)))
        return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(n)], names=["key", "n"])

    for _, data, at in kernels.batches(source, "text", _SLICE):
        parts.append(np.unique(tokens(kernels.Words(data, at, lower=True))[0], return_counts=True))
        held += len(parts[-1][0])
        if held > _WORDS:
            parts = [merged(*(np.concatenate(x) for x in zip(*parts)))]
            held = len(parts[0][0])
            if held > _WORDS // 2:
                yield flushed()
                parts, held = [], 0
    if parts:
        yield flushed()


@dataclass
class Root:
    """The unigram: ``keys`` of frequent words in order with their counts, totals of all words.

    Words are numbered from the most frequent one on. Of the other words ``own``, with
    ``own_n`` occurrences and at least ``floor`` each, have a probability of their own.
    """

    keys: np.ndarray
    n: np.ndarray
    total: int
    distinct: int
    floor: int = 1 << 62
    own: int = 0
    own_n: int = 0

    def __post_init__(self):
        order = np.argsort(-self.n, kind="stable")
        self.rank = np.empty(len(order), np.int64)
        self.rank[order] = np.arange(len(order))
        self.n = self.n[order]
        self.whole = self.total + self.distinct + 1
        rare = self.distinct - len(self.keys) - self.own
        left = self.total - int(self.n.sum()) - self.own_n + rare + 1
        #: Probability of each frequent word and, last, of any without its own.
        self.p = np.append((self.n + 1) / self.whole, left / self.whole / (rare + 1))

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of words, of :data:`SYMBOL_BITS` bits; others have part of their hash, in the upper half."""
        half = SYMBOL_BITS - 1
        other = (hashes >> np.uint64(64 - half)).astype(np.int64) | 1 << half
        if not len(self.keys):
            return other
        at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
        return np.where(self.keys[at] == hashes, self.rank[at], other)

    def share(self, numbers: np.ndarray, times: np.ndarray | None = None) -> np.ndarray:
        """Probabilities by number and, for words that aren't frequent, training counts."""
        p = self.p[np.minimum(numbers, len(self.keys))]
        return p if times is None else np.where(times >= self.floor, (times + 1) / self.whole, p)

    def counts(self, numbers: np.ndarray) -> np.ndarray:
        """Training counts by number, zero for words that aren't frequent."""
        return np.append(self.n, 0)[np.minimum(numbers, len(self.keys))]


def dealt(code: np.ndarray, symbol: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """(partition, key) of contexts with next symbols.

    Partitions are ranges of the hash. Its upper bits, which they share, make room in the key.
    """
    bucket = ((code >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    low = np.uint64((1 << SYMBOL_BITS) - 1)
    return bucket.astype(np.int64), (code << np.uint64(buckets.bit_length() - 1)) & ~low | symbol.astype(np.uint64)


def others(numbers: np.ndarray) -> np.ndarray:
    """Which numbers are of words that aren't frequent."""
    return (numbers & (1 << SYMBOL_BITS - 1)) != 0


@dataclass
class Heavy:
    """Contexts of one length that are dealt out by their next symbol.

    ``ids`` are in order: the place of the context without its last word among those of its
    length, then the last word's number; ``n`` are the occurrences, a part has about ``part``.
    """

    ids: np.ndarray
    n: np.ndarray
    part: int

    def __post_init__(self):
        self.parts = (-(-self.n // self.part)).astype(np.uint64)
        self.dropped = np.zeros(len(self.ids), bool)

    def find(self, ids: np.ndarray) -> np.ndarray:
        """Places of contexts, -1 for others."""
        return found(self.ids, ids)

    def codes(self, at: np.ndarray, part: np.ndarray) -> np.ndarray:
        return kernels.mix(kernels.mix(at.astype(np.uint64) + np.uint64(1)) + part)

    def dealt(self, at: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """Codes of the parts of contexts that hold next words."""
        return self.codes(at, kernels.mix(hashes) % self.parts[at])

    def held(self, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Partitions of all parts, in order, their keys there and their contexts' places."""
        at = np.repeat(np.arange(len(self.ids)), self.parts.astype(np.int64))
        first = np.cumsum(self.parts) - self.parts
        code = self.codes(at, np.arange(len(at), dtype=np.uint64) - first.astype(np.uint64)[at])
        bucket, key = dealt(code, np.zeros(len(at), np.uint64), buckets)
        order = np.lexsort((key, bucket))
        return bucket[order], key[order] >> np.uint64(SYMBOL_BITS), at[order]


def found(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of ``wanted`` in ordered ``keys``, -1 where absent."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


def packed(x: np.ndarray) -> bytes:
    """Byte planes of numbers, compressed where that makes them shorter."""
    raw = np.ascontiguousarray(x).view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()
    small = pa.compress(raw, "zstd", asbytes=True) if len(raw) > 64 else raw
    return small if len(small) < len(raw) else raw


def unpacked(data: bytes, n: int, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    raw = data if len(data) == n * size else pa.decompress(data, n * size, "zstd", asbytes=True)
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, n).T).view(kind).ravel()


class Sequences:
    """Tokens of some rows with their contexts of each length.

    ``known`` are lists of (hash, training count) of the rows' words that aren't frequent.
    """

    def __init__(self, data: np.ndarray, at: np.ndarray, known: pa.Array, root: Root, depth: int, piece: int | None, heavy: list[Heavy]):
        words = kernels.Words(data, at, lower=True)
        hashes, self.first = tokens(words)
        rows = len(self.first) - 1
        self.row = np.repeat(np.arange(rows), np.diff(self.first))
        self.place = np.arange(len(hashes)) - self.first[:-1][self.row]
        keys, back = np.unique(hashes, return_inverse=True)
        numbers = root.numbers(keys)
        known_key, known_n = (x.to_numpy(zero_copy_only=False) for x in known.flatten().flatten())
        known_key, once = np.unique(known_key.view(np.uint64), return_index=True)
        told = found(known_key, keys)
        times = np.append(known_n[once], 0)[told]
        self.number, self.hashes = numbers[back], hashes
        #: Training counts of words that aren't frequent, then of all.
        self.times, self.count = times[back], (times + root.counts(numbers))[back]
        pads = _PADS + depth
        self.padded = np.full(len(hashes) + rows * pads, _START, np.uint64)
        self.at = np.arange(len(hashes)) + (self.row + 1) * pads
        self.padded[self.at] = hashes
        self.piece, self.levels, self.heavies = piece, heavy, []

    def heavy(self, k: int) -> np.ndarray:
        """For each token the place of the ``k`` words before it among heavy contexts, or -1."""
        for level in self.levels[len(self.heavies) : k]:
            out = np.full(len(self.number), -1)
            which = np.flatnonzero(self.place > len(self.heavies))
            last = self.number[which - 1]
            if self.heavies:
                shorter = self.heavies[-1][which - 1]
                which, last, shorter = which[shorter >= 0], last[shorter >= 0], shorter[shorter >= 0]
                last = shorter << SYMBOL_BITS | last
            out[which] = level.find(last)
            self.heavies.append(out)
        return self.heavies[k - 1]

    def contexts(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(tokens with ``k`` words before them in their text, their contexts' hashes)."""
        which = np.flatnonzero(self.place >= k)
        start = self.at[which] - k
        code = kernels.grams(self.padded, k)[start]
        if self.piece is not None:
            most = self.count[which - k]
            for i in range(1, k):
                most = np.minimum(most, self.count[which - k + i])
            split = np.flatnonzero(most > self.piece)
            if len(split):
                older = kernels.grams(self.padded, _PADS)[start[split] - _PADS]
                classes = (-(-most[split] // self.piece)).astype(np.uint64)
                code[split] = kernels.mix(code[split] + np.uint64(1) + older % classes)
        elif len(self.levels[k - 1].ids):
            at = self.heavy(k)[which]
            heavy = np.flatnonzero(at >= 0)
            code[heavy] = self.levels[k - 1].dealt(at[heavy], self.hashes[which[heavy]])
        return which, code

    def pairs(self, k: int, buckets: int) -> tuple[np.ndarray, ...]:
        """Distinct (context, next symbol) in the order of partition and key: (tokens with a
        context, the number of each one's pair, partitions, keys, a token of each)."""
        which, code = self.contexts(k)
        number = self.number[which]
        bucket, key = dealt(code, number, buckets)
        order = np.argsort(key)
        order = order[np.argsort(bucket[order].astype(np.uint16 if buckets <= 1 << 16 else np.int64), kind="stable")]
        bucket, key = bucket[order], key[order]
        new = np.concatenate(([True], (key[1:] != key[:-1]) | (bucket[1:] != bucket[:-1])))[: len(key)]
        far = np.flatnonzero(others(number)[order])
        if len(far):  # these have part of their hash in the key; the whole tells them apart
            mine = order[far]
            hashes = self.hashes[which[mine]]
            again = np.lexsort((hashes, key[far], bucket[far]))
            order[far], hashes = mine[again], hashes[again]
            new[far[1:]] |= hashes[1:] != hashes[:-1]
        which = which[order]
        return which, np.cumsum(new) - 1, bucket[new], key[new], which[new]


def chunks(source: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of rows of one chunk each."""
    for rows, data, at in kernels.batches(source, column, _SLICE):
        chunk = rows.column("chunk").to_numpy()
        edge = np.flatnonzero(np.concatenate(([True], chunk[1:] != chunk[:-1], [True])))
        for i, j in zip(edge[:-1].tolist(), edge[1:].tolist()):
            yield rows.slice(i, j - i), data[at[i] : at[j]], at[i : j + 1] - at[i]


_ENTRIES = "bucket int, chunk long, low long, high long, size int, keys binary, counts binary, others int, hashes binary, times binary"


def entries(root, heavy, k: int, depth: int, piece: int | None, buckets: int):
    """Per slice (rows ``low`` to ``high``) and partition of contexts: distinct pairs of context
    and next symbol with their training counts, and of symbols that aren't frequent words the
    hashes and training counts."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in chunks(source):
            s = Sequences(data, at, rows.column("known"), root.value, depth, piece, heavy.value)
            which, pair, bucket, key, one = s.pairs(k, buckets)
            if not len(which):
                continue
            trains = rows.column("trains").to_numpy(zero_copy_only=False)[s.row[which]]
            n = np.bincount(pair, weights=trains, minlength=len(key)).astype(np.int32)
            edge = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1], [True])))
            far = np.flatnonzero(others(s.number[one]))
            hashes, times = s.hashes[one[far]], s.times[one[far]]
            far = np.searchsorted(far, edge)
            cut, far_cut = (list(zip(x[:-1].tolist(), x[1:].tolist())) for x in (edge, far))
            ids = rows.column("row")
            same = [pa.array(np.full(len(cut), x, np.int64)) for x in (rows.column("chunk")[0].as_py(), ids[0].as_py(), ids[-1].as_py())]
            parts = [pa.array([packed(x[i:j]) for i, j in where], pa.binary()) for x, where in ((key, cut), (n, cut), (hashes, far_cut), (times, far_cut))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket[edge[:-1]].astype(np.int32)), *same, pa.array(np.diff(edge).astype(np.int32)), *parts[:2], pa.array(np.diff(far).astype(np.int32)), *parts[2:]],
                names=[x.split()[0] for x in _ENTRIES.split(", ")],
            )

    return run


@dataclass
class Parts:
    """Parts of heavy contexts in one partition: keys in order and places of their contexts.

    What :func:`retained` notes of them: ``gains`` (place, share of the gain) and ``pairs`` that
    are heavy contexts of the next length (id, occurrences).
    """

    keys: np.ndarray
    at: np.ndarray
    level: Heavy

    def __post_init__(self):
        self.gains: list[tuple[int, float]] = []
        self.pairs: list[tuple[int, int]] = []


def retained(
    key: np.ndarray, n: np.ndarray, root: Root, cutoff: float, kappa: float, hashes: np.ndarray | None = None, times: np.ndarray | None = None, parts: Parts | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of entries in the order of their keys: (which are in retained contexts or in parts of
    heavy ones, the occurrences of their pairs, of their contexts).

    ``hashes`` and ``times`` are, where the next symbol isn't a frequent word, its hash, in
    order inside a key, and training count, and 0 elsewhere."""
    context = key >> np.uint64(SYMBOL_BITS)
    first = np.flatnonzero(np.concatenate(([True], context[1:] != context[:-1])))
    new = key[1:] != key[:-1]
    if hashes is not None:
        new |= hashes[1:] != hashes[:-1]
    pair = np.flatnonzero(np.concatenate(([True], new)))
    c = np.add.reduceat(n, pair, dtype=np.int64)
    start = np.searchsorted(pair, first)
    total = np.add.reduceat(c, start)
    # where no pair occurs twice each occurrence lowers the gain
    some = (total >= LEAST) & ((np.maximum.reduceat(c, start) > 1) | (cutoff <= 0))
    heavy = np.zeros(len(first), bool)
    if parts is not None and len(parts.keys):
        at = found(parts.keys, context[first])
        heavy = at >= 0
        at = parts.at[at]
        some |= heavy
        total[heavy] = parts.level.n[at[heavy]]
    in_some = np.repeat(some, np.diff(np.append(start, len(pair))))
    mine = np.repeat(np.arange(len(first)), np.diff(np.append(start, len(pair))))[in_some]
    c, t = c[in_some], total[mine]
    one = pair[in_some]
    number = (key[one] & np.uint64((1 << SYMBOL_BITS) - 1)).astype(np.int64)
    share = root.share(number, None if times is None else times[one])
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(c > 0, c * np.log((c - 1 + kappa * share) / (t - 1 + kappa) / share), 0.0)
    gain = np.bincount(mine, weights=gain, minlength=len(first))
    if heavy.any():
        parts.gains += zip(at[heavy].tolist(), gain[heavy].tolist())
        more = np.flatnonzero(heavy[mine] & (c > parts.level.part) & ~others(number))
        parts.pairs += zip((at[mine[more]] << SYMBOL_BITS | number[more]).tolist(), c[more].tolist())
    kept = ((gain >= cutoff) | heavy)[mine]
    times_in = np.diff(np.append(pair, len(key)))[in_some][kept]
    at = np.repeat(one[kept], times_in) + np.arange(times_in.sum()) - np.repeat(np.cumsum(times_in) - times_in, times_in)
    return at, np.repeat(c[kept], times_in), np.repeat(t[kept], times_in)


_ANSWERS = "chunk long, k int, bucket int, low long, high long, size int, some int, wide boolean, marks binary, pairs binary, contexts binary, gain double"


def answers(root, heavy, k: int, cutoff: float, kappa: float, buckets: int):
    """Partitions of contexts: decides which are retained and answers each slice's entries:
    a mark for each, and the occurrences of pair and context of the marked ones.

    Rows without a chunk are notes on heavy contexts: places (``low``) with shares of the gain,
    and those of the next length (``low``, ``high``: id, occurrences)."""
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), *[pa.binary()] * 3, pa.float64()]
    names = [x.split()[0] for x in _ANSWERS.split(", ")]

    def answered(bucket: int, blocks: list[tuple], parts: Parts) -> Iterator[pa.RecordBatch]:
        where = [b[:4] for b in blocks]
        size = np.array([b[3] for b in blocks])
        key = np.concatenate([unpacked(b[4], b[3], np.uint64) for b in blocks])
        n = np.concatenate([unpacked(b[5], b[3], np.int32) for b in blocks])
        far_hash = np.concatenate([unpacked(b[7], b[6], np.uint64) for b in blocks])
        far_times = np.concatenate([unpacked(b[8], b[6], np.int64) for b in blocks])
        blocks.clear()
        order = np.argsort(key)
        hashes = times = None
        if len(far_hash):
            far = np.flatnonzero(others(key.view(np.int64)))
            at = np.flatnonzero(others(key.view(np.int64)[order]))
            again = np.lexsort((far_hash, key[far]))
            order[at] = far[again]
            hashes, times = np.zeros(len(key), np.uint64), np.zeros(len(key), np.int64)
            hashes[at], times[at] = far_hash[again], far_times[again]
        at, c, t = retained(key[order], n[order], root.value, cutoff, kappa, hashes, times, parts)
        del key, n, hashes, times, far_hash, far_times
        place = order[at]
        order = np.argsort(place)
        place, c, t = place[order], c[order], t[order]
        wide = bool(len(t)) and int(t.max()) >= 1 << 31
        if not wide:
            c, t = c.astype(np.int32), t.astype(np.int32)
        edge = np.concatenate(([0], np.cumsum(size)))
        cut = np.searchsorted(place, edge)
        rows = [(None, k, bucket, at, None, None, None, None, None, None, None, gain) for at, gain in parts.gains]
        rows += [(None, k, bucket, at, n, None, None, None, None, None, None, None) for at, n in parts.pairs]
        for b in np.flatnonzero(np.diff(cut)).tolist():
            lo, hi = cut[b], cut[b + 1]
            marks = np.zeros(size[b], bool)
            marks[place[lo:hi] - edge[b]] = True
            chunk, low, high, _ = where[b]
            rows.append((chunk, k, bucket, low, high, int(size[b]), int(hi - lo), wide, packed(np.packbits(marks)), packed(c[lo:hi]), packed(t[lo:hi]), None))
            if len(rows) >= 1000:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows), kinds)], names=names)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = heavy.value[k - 1]
        held, keys, places = level.held(buckets)

        def parts(bucket: int) -> Parts:
            i, j = np.searchsorted(held, [bucket, bucket + 1])
            return Parts(keys[i:j], places[i:j], level)

        last, blocks = None, []
        for batch in source:
            for bucket, *block in zip(*(batch.column(x).to_pylist() for x in ("bucket", "chunk", "low", "high", "size", "keys", "counts", "others", "hashes", "times"))):
                if bucket != last and blocks:
                    yield from answered(last, blocks, parts(last))
                last = bucket
                blocks.append(tuple(block))
        if blocks:
            yield from answered(last, blocks, parts(last))

    return run


def asks(root):
    """Rows' distinct words that aren't frequent, by hash."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, at in kernels.batches(source, "text", _SLICE):
            hashes, first = tokens(kernels.Words(data, at, lower=True))
            keys, back = np.unique(hashes, return_inverse=True)
            which = np.flatnonzero(others(root.value.numbers(keys))[back])
            row = np.searchsorted(first, which, "right") - 1
            both = np.unique(row * len(keys) + back[which])
            line = rows.column("line").to_numpy()[both // len(keys)]
            yield pa.RecordBatch.from_arrays([pa.array(line), pa.array(keys[both % len(keys)].view(np.int64))], names=["line", "key"])

    return run


_SCORED = "doc_id long, held_out boolean, n_tokens long, n_known long, known_log double, score double"


def scorer(root, heavy, depth: int, kappa: float, piece: int | None, buckets: int):
    """Rows ordered by chunk: first the answers (``k`` not null), then the texts that they serve, by row."""
    names = [x.split()[0] for x in _SCORED.split(", ")]

    def told_log(s: Sequences, share: np.ndarray, log: np.ndarray, told: list[tuple]) -> None:
        """Puts the log probabilities of one length's answers in their tokens' places."""
        k = told[0][0]
        which, pair, bucket, _, _ = s.pairs(k, buckets)
        start = np.searchsorted(bucket, [x[1] for x in told])
        c, t = np.zeros(len(bucket), np.int64), np.zeros(len(bucket), np.int64)
        for lo, (_, _, _, _, size, some, wide, marks, pairs, contexts) in zip(start.tolist(), told):
            at = lo + np.flatnonzero(np.unpackbits(unpacked(marks, -(-size // 8), np.uint8), count=size))
            kind = np.int64 if wide else np.int32
            c[at], t[at] = unpacked(pairs, some, kind), unpacked(contexts, some, kind)
        hit = t[pair] > 0
        dropped = s.levels[k - 1].dropped
        if dropped.any():
            hit &= ~np.append(dropped, False)[s.heavy(k)[which]]
        which, pair = which[hit], pair[hit]
        log[which] = np.log((c[pair] + kappa * share[which]) / (t[pair] + kappa))

    def scored(rows: pa.RecordBatch, data: np.ndarray, at: np.ndarray, told: dict[int, list[tuple]]) -> pa.RecordBatch:
        s = Sequences(data, at, rows.column("known"), root.value, depth, piece, heavy.value)
        share = root.value.share(s.number, s.times)
        log = np.log(share)
        for k in sorted(told):  # a longer context replaces a shorter one
            told_log(s, share, log, told[k])
        sums = [np.add.reduceat(x, s.first[:-1]) for x in ((s.count > 0).astype(np.int64), np.log10(s.count + 1.0), log / math.log(10))]
        return pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("held_out"), pa.array(np.diff(s.first)), *map(pa.array, sums)], names=names)

    def chunk_scores(texts: list[pa.RecordBatch], told: dict[tuple, dict]) -> Iterator[pa.RecordBatch]:
        """Slices as they were counted: each answer names its first and last row."""
        table = pa.Table.from_batches(texts).combine_chunks()
        ids = table["row"].to_numpy()
        last = 0
        for low, high in [*sorted(told), (None, None)]:
            i, j = (len(ids), len(ids)) if low is None else (int(np.searchsorted(ids, low)), int(np.searchsorted(ids, high, "right")))
            for lo, hi, answer in ((last, i, {}), (i, j, told.get((low, high), {}))):
                for part in table.slice(lo, hi - lo).to_batches():
                    yield scored(part, *kernels.buffer(part.column("text")), answer)
            last = max(last, j)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, texts, told = None, [], {}
        for batch in source:
            ids, text = batch.column("chunk").to_numpy(), batch.column("k").is_null().to_numpy(zero_copy_only=False)
            edge = np.flatnonzero(np.concatenate(([True], (ids[1:] != ids[:-1]) | (text[1:] != text[:-1]), [True]))) if len(ids) else np.zeros(1, int)
            for i, j in zip(edge[:-1].tolist(), edge[1:].tolist()):
                if ids[i] != chunk:
                    if texts:
                        yield from chunk_scores(texts, told)
                    chunk, texts, told = ids[i], [], {}
                part = batch.slice(i, j - i)
                if text[i]:
                    texts.append(part.select(["row", "text", "known", "doc_id", "held_out"]))
                    continue
                for x in zip(*(part.column(c).to_pylist() for c in ("k", "bucket", "low", "high", "size", "some", "wide", "marks", "pairs", "contexts"))):
                    told.setdefault(x[2:4], {}).setdefault(x[0], []).append(x)
        if texts:
            yield from chunk_scores(texts, told)

    return run


def scores(
    docs: DataFrame, depth: int = DEPTH, cutoff: float = CUTOFF, kappa: float = KAPPA, most_words: int | None = None, piece: int | None = None, part: int = PART, broadcast: int = BROADCAST
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    ``part`` and ``broadcast`` say how the work is dealt out and leave the results as they are.
    """
    spark = docs.sparkSession
    doc = F.col("doc_id").cast("long")
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2, F.lit(False))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = docs.select(doc.alias("doc_id"), held.alias("held_out"), text.alias("text")).withColumn("line", F.monotonically_increasing_id())
    lines = scratch.keep(lines, "pst-texts")

    counts = scratch.arrow(lines.where(~F.col("held_out")).select("text"), count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    words = scratch.keep(counts, "pst-words")
    total, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    floor = 1 if most_words is None else max(1, math.ceil(total / most_words))
    least = max(floor, math.ceil(total / broadcast))
    frequent = words.where(F.col("n") >= least).select("key", "n").toArrow()
    keys, n = frequent["key"].to_numpy().view(np.uint64), frequent["n"].to_numpy()
    order = np.argsort(keys)
    own, own_n = words.where((F.col("n") >= floor) & (F.col("n") < least)).agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    root = spark.sparkContext.broadcast(Root(keys[order], n[order], total, distinct, floor, own, own_n))

    if least > 1:
        asked = scratch.arrow(lines.select("line", "text"), asks(root), "line long, key long")
        told = asked.join(words.where(F.col("n") < least), "key").groupBy("line").agg(F.collect_list(F.struct("key", "n")).alias("known"))
        rows = scratch.keep(lines.join(told, "line", "left").drop("line").withColumn("row", F.monotonically_increasing_id()), "pst-rows")
        scratch.release(lines)
        scratch.tidy(spark)
    else:
        rows = lines.withColumnRenamed("line", "row").withColumn("known", F.lit(None).cast("array<struct<key:bigint,n:bigint>>"))
    rows = rows.withColumns({"chunk": F.shiftright("row", CHUNK_BITS), "trains": ~F.col("held_out")})

    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    part = max(part, total >> 16)
    most = np.sort(n)[::-1]
    most = most[: int((most > part).sum()) if piece is None else 0]
    levels = [Heavy(np.arange(len(most)), most, part)]
    shape = [x.split() for x in _ANSWERS.split(", ")]
    none = lambda kind, name: F.lit(None).cast(kind).alias(name)
    texts = ["row", "text", "known", "doc_id", "held_out"]
    served = rows.select("chunk", *[none(kind, name) for name, kind in shape[1:]], *texts)
    for k in range(1, depth + 1):
        heavy = spark.sparkContext.broadcast(levels)
        sent = scratch.arrow(rows.select("chunk", "row", "trains", "text", "known"), entries(root, heavy, k, depth, piece, buckets), _ENTRIES)
        sent = sent.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket")
        told = scratch.keep(scratch.arrow(sent, answers(root, heavy, k, cutoff, kappa, buckets), _ANSWERS), f"pst-answers-{k}")
        scratch.tidy(spark)
        levels = [*levels, noted(told, levels[-1], cutoff)]
        served = served.unionByName(told.where(F.col("chunk").isNotNull()).select("*", *[none(rows.schema[x].dataType, x) for x in texts]))
    heavy = spark.sparkContext.broadcast(levels)
    met = served.repartition("chunk").sortWithinPartitions("chunk", F.col("k").isNull(), "row")
    scored = scratch.keep(scratch.arrow(met, scorer(root, heavy, depth, kappa, piece, buckets), _SCORED), "pst-scored")
    whole = math.log10(total + distinct + 1)
    return scored.select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("known_log") - F.col("n_tokens") * F.lit(whole)).alias("base_score"),
        "score",
    )


def noted(told: DataFrame, level: Heavy, cutoff: float) -> Heavy:
    """Marks heavy contexts that aren't retained; returns those of the next length."""
    if not len(level.ids):
        return Heavy(np.zeros(0, np.int64), np.zeros(0, np.int64), level.part)
    notes = told.where(F.col("chunk").isNull()).select("low", "high", "gain").toArrow()
    low, gain = notes["low"].to_numpy(), notes["gain"].to_numpy()
    shares: dict[int, list[float]] = {}
    for at, x in zip(low.tolist(), gain.tolist()):
        if not math.isnan(x):
            shares.setdefault(at, []).append(x)
    for at, x in shares.items():
        level.dropped[at] = math.fsum(x) < cutoff
    longer = np.isnan(gain)
    ids, n = low[longer], notes["high"].to_numpy()[longer].astype(np.int64)
    order = np.argsort(ids)
    return Heavy(ids[order], n[order], level.part)
