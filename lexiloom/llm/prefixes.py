"""A prefix trie of conversations with subtree sums by heavy-path decomposition.

Conversations are rebuilt first: the first ``h`` turns of conversation ``c - c % 100``, then
the own turns after the first ``h``, where ``h`` is the CRC-32 of the decimal id modulo 6.
A node is a different sequence of first ``d`` rebuilt turns (role, text).

Method. A turn's number in its conversation comes from a table sorted by ranges, so that a
conversation of any length spreads over partitions. Only 64-bit hashes of turns travel: a
prefix is the exclusive or of hashes of (number, turn), taken twice with different seeds, so
prefixes add up in blocks of ``BLOCK`` turns. A node's largest child is the one with the most
members (of equals, the one with the smallest member). All other children are light and have at most half
of their parent's members, so a way from the root meets at most log2(conversations) light
nodes. A running maximum along one conversation of each leaf names, for each node, the light node (or
root) that begins its path and how many light nodes lie above. Round by round, from the paths
with most light nodes above, path arrays (again in blocks) are summed from their ends, and
the sum of each path's first node is added to that node's parent.

Defined cases: turns without a conv_id belong to no conversation and are left out; null turns
come first; turns of the same number go by role, then by the text's MD5; a null role or text
is empty; repeated rows are turns each; negative ids follow the sign of ``%``; other columns
are not read, whatever their names; an empty table has no nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import hot, scratch

SHARED = 100  # conversations a group that shares the beginning of its first
MOST_SHARED = 6  # shared turns are fewer than this
BLOCK = 1024  # turns of a conversation, or nodes of a path, that are summed at once
RUN = 4096  # ids that travel together to their digest
KEY = ["depth", "k1", "k2"]
EMPTY = hashlib.sha256(b"").hexdigest()


def numbered(turns: DataFrame) -> DataFrame:
    """(c, pos, t1, t2, points): each turn's number in its conversation, hashes and length."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = turns.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("c"),
        F.col("turn").cast("long").alias("turn"),
        role.alias("role"),
        F.md5(text.cast("binary")).alias("m"),
        F.xxhash64(F.lit(1), role, text).alias("t1"),
        F.xxhash64(F.lit(2), F.length(text), role, text).alias("t2"),
        F.length(text).cast("long").alias("points"),
    )
    order = ["c", "turn", "role", "m"]
    # equal rows are interchangeable; their number in the input only spreads them over ranges
    dealt = rows.withColumn("n_", F.monotonically_increasing_id()).repartitionByRange(*order, "n_").sortWithinPartitions(*order)
    dealt = scratch.keep(dealt.withColumn("p", F.spark_partition_id()).drop("n_"), "turns")
    inside = F.row_number().over(Window.partitionBy("c", "p").orderBy("turn", "role", "m"))
    # a conversation in several ranges begins or ends at a range's end: at most two a range
    parts = dealt.groupBy("c", "p").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("c").orderBy("p").rowsBetween(Window.unboundedPreceding, -1))
    offsets = parts.withColumn("before", before).where("before > 0").select("c", "p", "before")
    out = dealt.withColumn("pos", inside).join(F.broadcast(offsets), ["c", "p"], "left")
    return out.select("c", (F.col("pos") + F.coalesce("before", F.lit(0))).alias("pos"), "t1", "t2", "points")


def blocks(n) -> F.Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), F.floor(n / F.lit(BLOCK)).cast("long")))


def summed(rows: DataFrame, by: list[str], blk: str, order: str, sums: dict[str, F.Column], last: bool = False) -> DataFrame:
    """Running aggregates of ``rows`` in the order of (blk, order) for each key ``by``: inside
    blocks first, then over the blocks of keys that have several; ``last`` runs from the end.

    ``sums`` names aggregate functions of columns: exclusive ors, maxima or sums.
    """
    way = (lambda c: F.col(c).desc()) if last else F.col
    inside = Window.partitionBy(*by, blk).orderBy(way(order)).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumns({f"{n}_in": f(c).over(inside) for n, (f, c, _) in sums.items()})
    whole = rows.groupBy(*by, blk).agg(*[f(c).alias(n) for n, (f, c, _) in sums.items()])
    earlier = Window.partitionBy(*by).orderBy(way(blk)).rowsBetween(Window.unboundedPreceding, -1)
    carried = whole.select(*by, blk, F.count(F.lit(1)).over(earlier).alias("blocks_"), *[f(F.col(n)).over(earlier).alias(f"{n}_up") for n, (f, _, _) in sums.items()])
    out = out.join(carried.where("blocks_ > 0").drop("blocks_"), [*by, blk], "left")
    named = {n: both(F.col(f"{n}_in"), F.col(f"{n}_up")) for n, (_, _, both) in sums.items()}
    return out.withColumns(named).drop(*[f"{n}{end}" for n in sums for end in ("_in", "_up")])


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rebuilt conversations: (c, length) and the turns (c, depth, k1, k2, up1, up2, points, ends)."""
    own = scratch.keep(numbered(turns), "numbered")
    h = F.pmod(F.crc32(F.col("c").cast("string").cast("binary")), F.lit(MOST_SHARED))
    sizes = own.groupBy("c").agg(F.max("pos").alias("n")).withColumn("h", h).withColumn("g", F.col("c") - F.col("c") % SHARED)
    sizes = scratch.keep(sizes, "sizes")
    shared = sizes.select(F.col("c").alias("g"), F.least("n", F.lit(MOST_SHARED - 1)).alias("has"))
    taken = F.least("h", F.coalesce("has", F.lit(0))).cast("long")
    convs = sizes.join(shared, "g", "left").withColumn("taken", taken)
    convs = convs.withColumn("length", F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0)))
    convs = scratch.keep(convs.select("c", "g", "n", "h", "taken", "length"), "conversations")
    first = own.where(F.col("pos") < MOST_SHARED).withColumnRenamed("c", "g")
    begun = convs.where("taken > 0").join(first, "g").where("pos <= taken").select("c", F.lit(0).cast("long").alias("blk"), F.col("pos").alias("depth"), "length", "t1", "t2", "points")
    # a conversation's row once a block of its turns: the join's keys are as fine as blocks
    each = convs.where("n > h").select(F.col("c").alias("cc"), "h", "taken", "length", blocks(F.col("n")).alias("bb"))
    blk = F.floor(F.col("pos") / F.lit(BLOCK)).cast("long")
    rest = own.withColumn("blk", blk).join(each.hint("merge"), (F.col("c") == F.col("cc")) & (F.col("blk") == F.col("bb"))).where("pos > h")
    rest = rest.select("c", "blk", (F.col("pos") - F.col("h") + F.col("taken")).alias("depth"), "length", "t1", "t2", "points")
    rows = begun.unionByName(rest)
    rows = rows.select("c", "blk", "depth", "points", (F.col("depth") == F.col("length")).alias("ends"), F.xxhash64(F.lit(1), "depth", "t1", "t2").alias("z1"), F.xxhash64(F.lit(2), "depth", "t2", "t1").alias("z2"))
    either = lambda a, b: a.bitwiseXOR(F.coalesce(b, F.lit(0)))
    rows = summed(rows, ["c"], "blk", "depth", {"k1": (F.bit_xor, F.col("z1"), either), "k2": (F.bit_xor, F.col("z2"), either)})
    rows = rows.select("c", "depth", "k1", "k2", F.col("k1").bitwiseXOR(F.col("z1")).alias("up1"), F.col("k2").bitwiseXOR(F.col("z2")).alias("up2"), "points", "ends")
    root = convs.select("c", F.lit(0).cast("long").alias("depth"), *[F.lit(0).cast("long").alias(k) for k in ("k1", "k2", "up1", "up2", "points")], (F.col("length") == 0).alias("ends"))
    return convs.select("c", "length"), scratch.keep(rows.unionByName(root), "prefixes")


def _joined(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, depth, c) in order, to rows (node, depth, first, ids) of at most RUN ids."""
    at, ids = None, []

    def run():
        return pa.RecordBatch.from_pydict({"node": [at[0]], "depth": [at[1]], "first": [ids[0]], "ids": [",".join(map(str, ids))]}, pa.schema({"node": pa.int64(), "depth": pa.int64(), "first": pa.int64(), "ids": pa.string()}))

    done: list[pa.RecordBatch] = []
    for batch in source:
        for node, depth, c in zip(*(batch.column(k).to_pylist() for k in ("node", "depth", "c"))):
            if (node, depth) != at or len(ids) == RUN:
                if ids:
                    done.append(run())
                at, ids = (node, depth), []
            ids.append(c)
        if done:
            yield from pa.Table.from_batches(done).combine_chunks().to_batches()
            done = []
    if ids:
        yield run()


def _digested(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (node, depth, first, ids) in order, to one row (node, depth, sha) a node."""
    at, sha = None, None
    for batch in source:
        out: list[tuple] = []
        for node, depth, ids in zip(*(batch.column(k).to_pylist() for k in ("node", "depth", "ids"))):
            if (node, depth) == at:
                sha.update(b",")
            else:
                if at is not None:
                    out.append((*at, sha.hexdigest()))
                at, sha = (node, depth), hashlib.sha256()
            sha.update(ids.encode())
        if out:
            yield _rows(out)
    if at is not None:
        yield _rows([(*at, sha.hexdigest())])


def _rows(found: list[tuple]) -> pa.RecordBatch:
    node, depth, sha = zip(*found)
    return pa.RecordBatch.from_arrays([pa.array(node, pa.int64()), pa.array(depth, pa.int64()), pa.array(sha, pa.string())], names=["node", "depth", "sha"])


def digests(ends: DataFrame) -> DataFrame:
    """(node, depth, sha): the digest of each node's conversations (node, depth, c) in ascending order.

    SHA-256 is one chain, so one task reads a node's ids, but as runs of ``RUN`` ids in text
    that were sorted and joined by range.
    """
    ordered = ends.repartitionByRange("node", "depth", "c").sortWithinPartitions("node", "depth", "c")
    runs = scratch.arrow(ordered, _joined, "node long, depth long, first long, ids string")
    runs = runs.repartition("node", "depth").sortWithinPartitions("node", "depth", "first")
    return scratch.arrow(runs, _digested, "node long, depth long, sha string")


def trie(turns: DataFrame) -> DataFrame:
    """One row per node of the trie of ``turns`` (conv_id, turn, role, text)."""
    convs, rows = rebuilt(turns)
    nodes = rows.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_convs"), F.min("c").alias("conv_id"), F.max("points").alias("points"), F.max("up1").alias("up1"), F.max("up2").alias("up2"))
    nodes = scratch.keep(nodes, "nodes")
    up = [(F.col("depth") - 1).alias("depth"), F.col("up1").alias("k1"), F.col("up2").alias("k2")]
    largest = F.max(F.struct("n_convs", (-F.col("conv_id")).alias("first")))
    families = nodes.where("depth > 0").select(*up, "n_convs", "conv_id").groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_children"), largest.alias("heavy"))
    families = families.join(nodes.select(*KEY, "conv_id"), KEY)
    families = scratch.keep(families.select(*KEY, "n_children", F.col("conv_id").alias("parent_conv_id"), (-F.col("heavy.first")).alias("heavy")), "families")
    nodes = nodes.join(families.select(*KEY, "n_children"), KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    of = families.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("up1"), F.col("k2").alias("up2"), "parent_conv_id", "heavy", F.col("n_children").alias("weight"))
    nodes = hot.attach(nodes, of, ["depth", "up1", "up2"], "weight", ["conv_id"])
    # the root counts as light, so that every path begins at a light node
    nodes = scratch.keep(nodes.withColumn("light", ~F.col("conv_id").eqNullSafe(F.col("heavy"))).drop("heavy"), "nodes")

    # each way from the root to a leaf or last turn once: by the smallest conversation that ends there
    ended = nodes.select(*KEY, F.col("conv_id").alias("node"), "light", F.col("n_convs").alias("weight"))
    along = hot.attach(rows.select("c", *KEY, "ends"), ended, KEY, "weight", ["c"])
    along = scratch.keep(along.select("c", "depth", "node", "light", "ends"), "along")
    ends = along.where("ends").select("node", "depth", "c")
    ways = along.where((F.col("node") == F.col("c")) & F.col("ends")).select(F.col("c").alias("cc"), blocks(F.col("depth")).alias("bb"))
    blk = F.floor(F.col("depth") / F.lit(BLOCK)).cast("long")
    ways = along.withColumn("blk", blk).join(ways.hint("merge"), (F.col("c") == F.col("cc")) & (F.col("blk") == F.col("bb")))
    head = F.when(F.col("light"), F.struct("depth", "node"))
    plus = lambda a, b: a + F.coalesce(b, F.lit(0))
    found = {"head": (F.max, head, lambda a, b: F.coalesce(a, b)), "level": (F.sum, F.col("light").cast("long"), plus)}
    ways = summed(ways.select("c", "blk", "depth", "node", "light"), ["c"], "blk", "depth", found)
    paths = ways.where("node = c").select(F.col("c").alias("conv_id"), "depth", F.col("head.node").alias("path"), F.col("head.depth").alias("path_depth"), "level")
    nodes = nodes.join(paths, ["conv_id", "depth"])
    leaf = F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long")
    nodes = nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "path", "path_depth", "level", "light", leaf.alias("leaf"), ((F.col("n_convs") - 1) * F.col("points")).alias("saved"))
    nodes = scratch.keep(nodes, "paths", partition_by=("level",))
    sums = subtrees(nodes)
    shas = scratch.keep(digests(ends), "digests").withColumnRenamed("node", "conv_id")
    out = sums.join(shas, ["conv_id", "depth"], "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("sha", F.lit(EMPTY)).alias("ends_sha256"))


def subtrees(nodes: DataFrame) -> DataFrame:
    """The nodes with n_leaves and saved_tokens of their subtrees, in a round per level of paths."""
    levels = sorted((r.level for r in nodes.select("level").distinct().collect()), reverse=True)  # at most log2(conversations) + 1
    plus = lambda a, b: a + F.coalesce(b, F.lit(0))
    done: list[DataFrame] = []
    light: DataFrame | None = None
    for level in levels:
        rows = nodes.where(F.col("level") == level)
        if light is not None:
            rows = rows.join(light, ["conv_id", "depth"], "left")
            rows = rows.withColumns({c: F.col(c) + F.coalesce(f"light_{c}", F.lit(0)) for c in ("leaf", "saved")}).drop("light_leaf", "light_saved")
        rows = rows.withColumn("blk", F.floor((F.col("depth") - F.col("path_depth")) / F.lit(BLOCK)).cast("long"))
        rows = summed(rows, ["path", "path_depth"], "blk", "depth", {"n_leaves": (F.sum, F.col("leaf"), plus), "saved_tokens": (F.sum, F.col("saved"), plus)}, last=True)
        rows = scratch.keep(rows.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "light", "n_leaves", "saved_tokens"), f"level-{level}")
        done.append(rows)
        up = rows.where("light and depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth"))
        light = scratch.keep(up.agg(F.sum("n_leaves").alias("light_leaf"), F.sum("saved_tokens").alias("light_saved")), f"light-{level}")
    out = done[0] if done else nodes.withColumns({"n_leaves": F.col("leaf"), "saved_tokens": F.col("saved")}).select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "light", "n_leaves", "saved_tokens")
    for rows in done[1:]:
        out = out.unionByName(rows)
    return out
