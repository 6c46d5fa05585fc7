"""Exact dedup by Patricia tries.

Texts are compared as the full UTF-8 bytes left after deleting ``[\\x20\\x09-\\x0D]``. Each
map task inserts its texts into local tries first, so a text with a third of all rows leaves
one row per task. Length-and-content-hash partitions then merge those rows in owner tries;
a terminal node stores the winner (most code points of the original, then smallest id) and
the number of rows. A trie over its memory bound follows the edges that hold more than half of
it, so a prefix that all strings share is passed in one step, and spills the largest subtree
below to a file; later strings that reach that node go straight there. Each spill file is then
a trie of its own, one after another.

Defined cases. Null text counts as empty. A null id comes after every other id. All texts
without a word are equal to each other. Repeated rows count one each; of those that carry
the winner's id and length, every one is marked kept, since nothing tells them apart (the
pipeline's stage keeps one). Ties go to the smallest id. A very long text is one string,
whole, and may exceed the bound by itself. Extra columns are carried along; those named like
a new one are replaced. Empty table: no rows.
"""

from __future__ import annotations

import hashlib
import os
import pickle
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels, scratch

TRIE_BYTES = 32 << 20
_NODE_BYTES = 400


def common(a: bytes, b: bytes, start: int) -> int:
    """The length of the common prefix of ``a`` and ``b[start:]``, by halving."""
    most = min(len(a), len(b) - start)
    if a[:most] == b[start : start + most]:
        return most
    low, high = 0, most  # a[:low] agrees, a[:high] doesn't
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[start + low : start + mid]:
            low = mid
        else:
            high = mid
    return low


class Spill:
    """Strings of one subtree in a file, appended in pieces."""

    def __init__(self, folder: str):
        fd, self.name = tempfile.mkstemp(dir=folder)
        os.close(fd)
        self.rows: list[tuple[bytes, tuple]] = []
        self.held = 0
        self.below: list[Spill] = []  # subtrees that were in files before

    def add(self, text: bytes, owner: tuple) -> None:
        self.rows.append((text, owner))
        self.held += len(text) + 64
        if self.held > 1 << 18:
            self.flush()

    def flush(self) -> None:
        with open(self.name, "ab") as f:
            pickle.dump(self.rows, f)
        self.rows, self.held = [], 0

    def read(self) -> Iterator[tuple[bytes, tuple]]:
        """All strings; the files are gone after that."""
        left = [self]
        while left:
            part = left.pop()
            part.flush()
            with open(part.name, "rb") as f:
                while True:
                    try:
                        yield from pickle.load(f)
                    except EOFError:
                        break
            os.remove(part.name)
            left += part.below


class Node:
    __slots__ = ("label", "kids", "owner", "spill")

    def __init__(self, label: bytes, owner: tuple | None = None):
        self.label, self.kids, self.owner, self.spill = label, {}, owner, None


def merge(a: tuple | None, b: tuple) -> tuple:
    """Owners are (-code points, id is null, id, rows): the smaller of the first three wins, rows add up."""
    return b if a is None else (*min(a[:3], b[:3]), a[3] + b[3])


class Trie:
    """A compressed radix trie of byte strings with owners at terminal nodes."""

    def __init__(self, most: int = TRIE_BYTES, folder: str | None = None):
        self.root, self.held, self.most, self.folder = Node(b""), 0, most, folder
        self.spills: list[Spill] = []

    def add(self, text: bytes, owner: tuple) -> None:
        self._insert(text, owner)
        if self.held > self.most and self.folder is not None:
            self._spill()

    def _insert(self, text: bytes, owner: tuple) -> None:
        node, at = self.root, 0
        while True:
            if node.spill is not None:
                node.spill.add(text, owner)
                return
            if at == len(text):
                self.held += 64 if node.owner is None else 0
                node.owner = merge(node.owner, owner)
                return
            kid = node.kids.get(text[at])
            if kid is None:
                node.kids[text[at]] = Node(text[at:], owner)
                self.held += len(text) - at + _NODE_BYTES
                return
            same = common(kid.label, text, at)
            if same < len(kid.label):  # the edge forks
                fork = Node(kid.label[:same])
                kid.label = kid.label[same:]
                fork.kids[kid.label[0]] = kid
                node.kids[text[at]] = kid = fork
                self.held += _NODE_BYTES
            node, at = kid, at + same

    def _spill(self) -> None:
        """Moves the largest subtree below the heavy path to a file."""
        node, prefix, whole = self.root, b"", self.held
        while True:
            sizes = {k: self._size(kid) for k, kid in node.kids.items() if kid.spill is None}
            if not sizes:
                self.most = max(self.most, 2 * self.held)  # one string holds it all
                return
            heaviest = max(sizes, key=sizes.__getitem__)
            kid = node.kids[heaviest]
            if 2 * sizes[heaviest] <= whole or not any(x.spill is None for x in kid.kids.values()):
                break
            node, prefix = kid, prefix + kid.label
        if sizes[heaviest] * 1024 < whole:
            self.most = max(self.most, 2 * self.held)  # what is left are paths to spilled subtrees
            return
        spill = Spill(self.folder)
        for text, owner in self._walk(kid, prefix):
            spill.add(text, owner)
        stack = [kid]
        while stack:
            x = stack.pop()
            stack += x.kids.values()
            if x.spill is not None:
                spill.below.append(x.spill)
        self.spills = [x for x in self.spills if x not in spill.below] + [spill]
        kid.kids, kid.owner, kid.spill = {}, None, spill
        self.held = max(0, self.held - sizes[heaviest] + len(kid.label) + _NODE_BYTES)

    @staticmethod
    def _size(node: Node) -> int:
        total, stack = 0, [node]
        while stack:
            node = stack.pop()
            total += len(node.label) + _NODE_BYTES
            stack += node.kids.values()
        return total

    @staticmethod
    def _walk(node: Node, prefix: bytes) -> Iterator[tuple[bytes, tuple]]:
        stack = [(node, prefix)]
        while stack:
            node, prefix = stack.pop()
            text = prefix + node.label
            if node.owner is not None:
                yield text, node.owner
            stack += [(kid, text) for kid in node.kids.values() if kid.spill is None]

    def items(self) -> Iterator[tuple[bytes, tuple]]:
        """(text, owner) of every terminal node, spilled subtrees last."""
        yield from self._walk(self.root, b"")
        self.root, left = Node(b""), self.spills
        while left:
            below = Trie(self.most, self.folder)
            for text, owner in left.pop().read():
                below.add(text, owner)
            yield from self._walk(below.root, b"")
            left += below.spills


def _codepoints(data, at) -> list[int]:
    import numpy as np

    heads = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    return (heads[at[1:]] - heads[at[:-1]]).tolist()


_OUT = pa.schema([("n_bytes", pa.int64()), ("bucket", pa.int64()), ("norm", pa.binary()), ("points", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64())])
_OUT_SQL = "n_bytes long, bucket long, norm binary, points long, doc_id long, n long"


def _emit(items: Iterator[tuple[bytes, tuple]], most: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    rows, held = [], 0
    for text, (points, late, doc, n) in items:
        bucket = int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little", signed=True)
        rows.append((len(text), bucket, text, -points, None if late else doc, n))
        held += len(text) + 64
        if held > most:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _OUT)], schema=_OUT)
            rows, held = [], 0
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _OUT)], schema=_OUT)


def local_tries(most: int = TRIE_BYTES):
    """Map side: texts of one task through tries that are emptied when full."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(1 << 62)
        for rows, data, at in kernels.batches(source, "text"):
            points = _codepoints(data, at)
            raw = data.tobytes()
            ids = rows.column("doc_id").to_pylist()
            for i, (doc, n) in enumerate(zip(ids, points)):
                trie.add(raw[at[i] : at[i + 1]].translate(None, kernels.SPACE), (-n, doc is None, doc or 0, 1))
                if trie.held > most:
                    yield from _emit(trie.items())
                    trie = Trie(1 << 62)
        yield from _emit(trie.items())

    return run


def owner_tries(most: int = TRIE_BYTES):
    """Reduce side: one task's length-and-hash partition; spills by subtree."""
    schema = pa.schema([("text_sha256", pa.string()), ("keep_points", pa.int64()), ("keep_id", pa.int64()), ("group_size", pa.int64())])

    def merged(source: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
        trie = Trie(most, folder)
        for batch in source:
            for text, points, doc, n in zip(*(batch.column(c) for c in ("norm", "points", "doc_id", "n"))):
                trie.add(text.as_py(), (-points.as_py(), not doc.is_valid, doc.as_py() or 0, n.as_py()))
        rows = []
        for text, (points, late, doc, n) in trie.items():
            rows.append((hashlib.sha256(text).hexdigest(), -points, None if late else doc, n))
            if len(rows) == 20_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the executor's own scratch space, as Spark's spills; gone with the task
        local = os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0]
        with tempfile.TemporaryDirectory(prefix="trie-", dir=local or None) as folder:
            yield from merged(source, folder)

    return run


def owners(docs: DataFrame, most: int = TRIE_BYTES) -> DataFrame:
    """One row per distinct text: text_sha256, keep_points, keep_id, group_size."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    local = scratch.arrow(slim, local_tries(most), _OUT_SQL)
    dealt = local.repartition(F.col("n_bytes"), F.col("bucket"))
    return scratch.arrow(dealt, owner_tries(most), "text_sha256 string, keep_points long, keep_id long, group_size long")


def normalised(text: str = "text") -> Column:
    """The text without ``[\\x20\\x09-\\x0D]``."""
    out = F.coalesce(F.col(text).cast("string"), F.lit(""))
    for byte in kernels.SPACE:
        out = F.replace(out, F.lit(chr(byte)))
    return out


def groups(docs: DataFrame, carry: list[str] | None = None, most: int = TRIE_BYTES) -> DataFrame:
    """All rows of ``docs`` with keep_id, group_size, kept and text_sha256.

    ``carry`` names the columns that go along (all, unless given); columns with the new names
    are replaced. The owner table is written first and only texts with several rows are
    joined, on the digest, so the join's sides are plain shuffles and a hot digest can be
    split; the join is the same at every size.
    """
    several = scratch.keep(owners(docs, most).where("group_size > 1"), "owners")
    new = ("keep_id", "group_size", "kept", "text_sha256")
    carried = [c for c in (docs.columns if carry is None else carry) if c not in new]
    rows = docs.select(
        *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carried)],
        F.col("doc_id").cast("long").alias("own_id"),
        F.length(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("points"),
        F.sha2(normalised().cast("binary"), 256).alias("text_sha256"),
    )
    several = several.hint("merge")
    joined = rows.join(several, "text_sha256", "left")
    alone = F.col("group_size").isNull()
    return joined.select(
        *[F.col(f"c{i}").alias(c) for i, c in enumerate(carried)],
        F.when(alone, F.col("own_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce(F.col("group_size"), F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("own_id").eqNullSafe(F.col("keep_id")) & (F.col("points") == F.col("keep_points")))).alias("kept"),
        "text_sha256",
    )
