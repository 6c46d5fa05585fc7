"""Repeated phrases across pages. A56, A57."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays
from . import chunks

cloudpickle.register_pickle_by_value(sys.modules[__name__])

BY = ("corpus",)


def ngrams(toks: DataFrame, n: int, scope: tuple[str, ...] = ("corpus", "page")) -> DataFrame:
    """Tokens with ``gram``, their ``n``-word phrase. W3."""
    z = Window.partitionBy(*scope).orderBy("pos")
    words = [F.col("w")] + [F.lead("w", k).over(z) for k in range(1, n)]
    return toks.withColumns({f"g{k}": c for k, c in enumerate(words)}).where(f"g{n - 1} is not null").withColumn("gram", F.concat_ws(" ", *[f"g{k}" for k in range(n)])).drop(*[f"g{k}" for k in range(n)])


def grams(toks: DataFrame, n: int, carry: tuple[str, ...] = BY, whole: bool = False) -> DataFrame:
    """(carry, gram): the phrases of :func:`ngrams`, formed where pages are read; ``whole`` as for :func:`.tallies.tallied`."""
    run = ("corpus", "page")
    if not whole:
        toks = toks.repartition(*run).sortWithinPartitions(*run, "pos")

    def formed(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, first in chunks.pages_of(source, run):
            page, size = np.cumsum(first), table.num_rows - n + 1
            if size < 1:
                continue
            w = table["w"].combine_chunks()
            inside = pa.array(page[n - 1 :] == page[:size])
            gram = pc.binary_join_element_wise(*[w.slice(k, size) for k in range(n)], " ")
            yield from pa.table({**{c: table[c].slice(0, size) for c in carry}, "gram": gram}).filter(inside).to_batches()

    kinds = ", ".join(f"`{c}` {toks.schema[c].dataType.simpleString()}" for c in carry)
    return toks.select(*dict.fromkeys((*carry, *run, "w"))).mapInArrow(formed, f"{kinds}, gram string")


def repeats(toks: DataFrame, n: int, by: tuple[str, ...] = BY, least_gap: int = 0) -> DataFrame:
    """Phrases' occurrences on pages later than their first: (by, gram, n, events). A56, W7.

    Counts per (gram, page) go first, so a frequent phrase is a few rows.
    """
    each = ngrams(toks, n).groupBy(*by, "gram", "page").agg(F.count("*").alias("c"))
    first = each.groupBy(*by, "gram").agg(F.sum("c").alias("n"), F.min(F.struct("page", "c")).alias("f"), F.count("*").alias("n_pages"))
    return first.select(*by, "gram", "n", "n_pages", (F.col("n") - F.col("f.c")).alias("events"))


def summary(toks: DataFrame, n: int, by: tuple[str, ...] = BY) -> DataFrame:
    """Repeat events and distinct repeated phrases."""
    r = repeats(toks, n, by)
    return r.groupBy(*by).agg(F.sum("events").alias("events"), F.sum((F.col("events") > 0).cast("long")).alias("n_repeated"), F.count("*").alias("n_grams"))


def autopsy(toks: DataFrame, n: int = 3, by: tuple[str, ...] = BY) -> DataFrame:
    """What repeat events consist of: all words in the top 20, in the top 100, or some rare one. A57."""
    from .lexical import top, vocab

    voc = vocab(toks, by).select(*by, F.col("w").alias("part"), "cnt")
    ranks = voc.join(top(toks, 100, by).select(*by, F.col("w").alias("part"), "rank"), [*by, "part"], "left").withColumn("rank", F.coalesce("rank", F.lit(101)))
    r = repeats(toks, n, by).where("events > 0")
    parts = r.select(*by, "gram", "events", F.explode(F.split("gram", " ")).alias("part")).join(ranks, [*by, "part"])
    each = parts.groupBy(*by, "gram").agg(F.first("events").alias("events"), F.max("rank").alias("worst"), F.min("cnt").alias("rarest"))
    total = F.sum("events")
    return each.groupBy(*by).agg(
        total.alias("events"), (F.sum(F.when(F.col("worst") <= 20, F.col("events")).otherwise(0)) / total).alias("top20"),
        (F.sum(F.when(F.col("worst") <= 100, F.col("events")).otherwise(0)) / total).alias("top100"), (F.sum(F.when(F.col("rarest") <= 5, F.col("events")).otherwise(0)) / total).alias("rare"),
    )


#: Phrases of a group that one task counts, about.
GROUP = 1 << 20


def counted(toks: DataFrame, n: int, rounds: int = 0, by: tuple[str, ...] = BY, of: str | None = None, whole: bool = False) -> DataFrame:
    """(by, round, of_, events, n_own, n_repeated, n_often, n_grams): phrases of the real order (round 0) and of
    words permuted inside their pages; ``of`` tells events and distinct phrases (``n_own``) apart by a
    column of their page (the others stand with one of its values).

    Phrases are formed and permuted where pages are read, and go to tasks by their hash (96 bits) as
    packed numbers, once a page. ``whole`` as for :func:`.tallies.tallied`.
    """
    run = tuple(dict.fromkeys((*by, "page")))
    if not whole:
        toks = toks.repartition(*run).sortWithinPartitions(*run, "pos")
    hashes = [F.xxhash64(F.lit(k), "w").alias(f"h{k}_") for k in (1, 2)]
    own = (F.col(of) if of else F.lit(None)).cast("string").alias("of_")
    rows = toks.select(*by, "page", own, F.col("page").cast("string").alias("page_"), F.col("pos").cast("long").alias("pos_"), *hashes)
    kinds = {c: toks.schema[c].dataType.simpleString() for c in run}
    most = max(1, -(-toks.count() // GROUP))
    names = list(by)

    def mixed(columns: list[np.ndarray]) -> np.ndarray:
        out = np.zeros(len(columns[0]), np.uint64)
        for x in columns:
            out = (out ^ x) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        return out ^ out >> np.uint64(32)

    def sent(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, first in chunks.pages_of(source, run):
            page = np.cumsum(first) - 1
            heads = table.take(pa.array(np.flatnonzero(first)))
            whose = list(zip(*(heads[c].to_pylist() for c in names))) if names else [()] * len(heads)
            known = list(dict.fromkeys(whose))
            group = np.array([known.index(g) for g in whose], np.int64)
            keys = arrays.Keys(heads["page_"].to_pylist(), page, table["pos_"].to_numpy())
            words = [table[f"h{k}_"].to_numpy().view(np.uint64) for k in (1, 2)]
            inside = np.flatnonzero(page[n - 1 :] == page[: len(page) - n + 1]) if len(page) >= n else np.zeros(0, np.int64)
            if not len(inside):
                continue
            at = page[inside]
            for r in range(rounds + 1):
                order = keys.order(page, r) if r else slice(None)
                h1, h2 = (mixed([w[order][inside + k] for k in range(n)]) for w in words)
                h2 = (h2 >> np.uint64(32)).astype(np.uint32)
                bucket = (h1 >> np.uint64(33)).astype(np.int64) % most
                by_ = np.lexsort((h2, h1, at, bucket, group[at]))
                h1, h2, where, to = h1[by_], h2[by_], at[by_], group[at][by_] * most + bucket[by_]
                new = np.ones(len(h1), bool)
                new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1]) | (where[1:] != where[:-1])
                kept = np.flatnonzero(new)
                c = np.diff(np.append(kept, len(h1))).astype(np.int32)
                h1, h2, where, to = h1[kept], h2[kept], where[kept], to[kept]
                ids, lo = np.unique(to, return_index=True)
                parts = list(zip(lo.tolist(), [*lo[1:].tolist(), len(to)]))
                pages = [np.unique(where[a:b], return_inverse=True) for a, b in parts]
                cells = {"round": pa.array([r] * len(ids), pa.int32()), "bucket": pa.array((ids % most).astype(np.int32))}
                for i, c_ in enumerate(names):
                    cells[f"b{i}_"] = pa.array([known[g][i] for g in (ids // most).tolist()], table.schema.field(c_).type)
                blobs = lambda f: pa.array([f(a, b) for a, b in parts], pa.binary())
                cells |= {"h1": blobs(lambda a, b: h1[a:b].tobytes()), "h2": blobs(lambda a, b: h2[a:b].tobytes()), "c": blobs(lambda a, b: c[a:b].tobytes())}
                cells["at"] = pa.array([back.astype(np.int32).tobytes() for _, back in pages], pa.binary())
                for name in ("page", "of_"):
                    column = heads[name].combine_chunks()
                    cells[f"{name}s"] = pa.array([column.take(pa.array(p)).to_pylist() for p, _ in pages], pa.list_(column.type))
                yield pa.RecordBatch.from_pydict(cells)

    def count(group: pa.Table) -> pa.Table:
        blob = lambda c, kind: np.concatenate([np.frombuffer(x, kind) for x in group[c].to_pylist()])
        h1, h2, c = blob("h1", np.uint64), blob("h2", np.uint32), blob("c", np.int32).astype(np.int64)
        pages, ofs = group["pages"].combine_chunks(), pa.concat_arrays([x.flatten() for x in group["of_s"].chunks])
        shift = np.cumsum([0, *(len(p) for p in pages.to_pylist())])
        at = np.concatenate([np.frombuffer(x, np.int32) + s for x, s in zip(group["at"].to_pylist(), shift)])
        rank = pc.rank(pages.flatten(), tiebreaker="dense", null_placement="at_start").to_numpy()[at]
        order = np.lexsort((rank, h2, h1))
        h1, h2, rank, c, at = h1[order], h2[order], rank[order], c[order], at[order]
        new = np.ones(len(h1), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        gram = np.cumsum(new) - 1
        later = np.where(rank > rank[np.flatnonzero(new)][gram], c, 0)
        events = np.bincount(gram, later).astype(np.int64)
        codes = ofs.dictionary_encode(null_encoding="encode")
        by_of = np.bincount(np.asarray(codes.indices)[at], later, len(codes.dictionary)).astype(np.int64)
        m = len(by_of)
        own = np.bincount(np.unique(gram * m + np.asarray(codes.indices)[at]) % m, minlength=m)
        once = lambda x: pa.array([int(x), *[0] * (m - 1)], pa.int64())
        out = {f"b{i}_": pa.array([group[f"b{i}_"][0].as_py()] * m, group.schema.field(f"b{i}_").type) for i in range(len(names))}
        out |= {"round": pa.array([group["round"][0].as_py()] * m, pa.int32()), "of_": codes.dictionary.cast(pa.string()), "events": pa.array(by_of), "n_own": pa.array(own.astype(np.int64))}
        return pa.table(out | {"n_repeated": once((events > 0).sum()), "n_often": once((events > 1).sum()), "n_grams": once(len(events))})

    groups = [f"b{i}_" for i in range(len(by))]
    typed = "".join(f"{g} {kinds[c]}, " for g, c in zip(groups, by))
    packed = rows.mapInArrow(sent, f"round int, bucket int, {typed}h1 binary, h2 binary, c binary, at binary, pages array<{kinds['page']}>, of_s array<string>")
    totals = ("events", "n_own", "n_repeated", "n_often", "n_grams")
    each = packed.groupBy(*groups, "round", "bucket").applyInArrow(count, f"{typed}round int, of_ string, " + ", ".join(f"{c} bigint" for c in totals))
    return each.groupBy(*groups, "round", "of_").agg(*[F.sum(c).alias(c) for c in totals]).withColumnsRenamed(dict(zip(groups, by)))


def events_of(toks: DataFrame, n: int, rounds: int, by: tuple[str, ...] = BY, whole: bool = False) -> DataFrame:
    """Repeat events of each round: (by, round, events); round 0 is the real order. A57."""
    return counted(toks, n, rounds, by, None, whole).select(*by, "round", F.col("events").cast("double").alias("events"))


def null_ratio(toks: DataFrame, n: int = 3, rounds: int = 5, by: tuple[str, ...] = BY, whole: bool = False) -> DataFrame:
    """Repeat events against words shuffled inside their pages, and how often phrases repeat:
    (by, events, null_mean, ratio, n_repeated, n_often), often being three times or more. A57."""
    from .. import stage
    from .lexical import joined_by
    from .pairs import excess

    each = stage.written(counted(toks, n, rounds, by, None, whole), "phrases")
    null = excess(each.withColumn("events", F.col("events").cast("double")), "events", by)
    r = each.where("round = 0").select(*by, "n_repeated", "n_often")
    return joined_by(null, r, by).select(*by, F.col("real").cast("long").alias("events"), "null_mean", "ratio", "n_repeated", "n_often")


def by_section(toks: DataFrame, n: int = 3, by: tuple[str, ...] = BY, whole: bool = False) -> DataFrame:
    """Repeat events a thousand words, by the section of the later page: (by, section, events, n_words, rate). A57."""
    later = counted(toks, n, 0, by, "section", whole).select(*by, F.col("of_").alias("section"), "events")
    size = toks.groupBy(*by, "section").agg(F.count("*").alias("n_words"))
    both = size.join(later.withColumnsRenamed({c: f"{c}_" for c in (*by, "section")}), [F.col(c).eqNullSafe(F.col(f"{c}_")) for c in (*by, "section")], "left")
    events = F.coalesce("events", F.lit(0))
    return both.select(*by, "section", events.alias("events"), "n_words", (1000 * events / F.col("n_words")).alias("rate"))
