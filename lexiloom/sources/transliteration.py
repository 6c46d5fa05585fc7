"""Page-and-locus transliteration files as tables. S1-S5, S14-S23.

A file is one row of text, so the sequential parts of the format (a page header holds for the
loci after it, a slash continues a line) are arrays inside the row; files are parsed in parallel.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed, glyphs, words
from ..operators.chunks import pages_of
from ..operators.tallies import codes, joint

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def read(spark: SparkSession, path: str, charset: str = "ISO-8859-1") -> DataFrame:
    """Lines of transliteration files: (file, n, line)."""
    files = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.decode("content", charset).alias("text"))
    return lines(files)


def lines(files: DataFrame) -> DataFrame:
    """(file, n, line) of files (file, text)."""
    return files.select("file", F.posexplode(F.split("text", r"\r?\n")).alias("n", "line"))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is made once, however often it is used, in lambdas too."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _variables(line: Column) -> Column:
    """The variables of a page header; of equal ones the last holds."""
    head = F.regexp_extract(line, fixed.PAGE_HEADER, 2)
    zipped = F.arrays_zip(F.regexp_extract_all(head, F.lit(fixed.PAGE_VARIABLE), F.lit(1)).alias("k"), F.regexp_extract_all(head, F.lit(fixed.PAGE_VARIABLE), F.lit(2)).alias("v"))
    later = lambda pairs, p: F.exists(pairs, lambda q: (q["k"] == p["k"]) & (F.array_position(pairs, q) > F.array_position(pairs, p)))
    return _let(zipped, lambda pairs: F.map_from_entries(F.filter(pairs, lambda p: ~later(pairs, p))))


def parse(raw: DataFrame) -> DataFrame:
    """Loci: (file, locus_seq, page, page_seq, num, ltype, text, page_vars), in order. S1, S2, S3.

    ``raw`` has whole files (file, text), which are parsed in their rows, so nothing moves and a
    task holds a file at a time; lines (file, n, line) are gathered to files first.
    """
    if "text" in raw.columns:
        files = raw.select("file", F.split("text", r"\r?\n").alias("lines"))
    else:
        files = raw.groupBy("file").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "line"))), lambda x: x["line"]).alias("lines"))
    kept = F.filter("lines", lambda x: ~x.startswith("#") & (F.trim(x) != ""))
    marked = F.transform(kept, lambda x, i: F.struct(i.alias("i"), x.alias("line"), x.rlike(fixed.LOCUS).alias("is_locus"), x.rlike(fixed.PAGE_HEADER).alias("is_header")))

    def found(rows: Column, heads: Column, starts: Column) -> Column:
        def locus(at: Column, k: Column) -> Column:
            end = F.coalesce(F.get(starts, k + 1), F.size(rows))
            body = F.filter(F.slice(rows, at + 1, end - at), lambda r: ~r["is_header"])
            return _let(body, lambda own: F.when(F.size(own) > 0, cells(own, k)))

        def cells(own: Column, k: Column) -> Column:
            first = F.get(own, F.lit(0))
            part = lambda i: F.when(first["is_locus"], F.regexp_extract(first["line"], fixed.LOCUS, i))
            text = lambda r: F.when(r["is_locus"], F.regexp_extract(r["line"], fixed.LOCUS, 4)).otherwise(F.trim(r["line"]))
            bare = lambda r: F.regexp_replace(F.regexp_replace(F.trim(text(r)), "/$", ""), "^/", "")
            # the variables of the first line that has a header before it
            headed = F.get(F.filter(own, lambda r: r["i"] > F.get(heads, F.lit(0))["i"]), F.lit(0))["i"]
            before = F.filter(heads, lambda h: h["i"] < headed)
            return F.struct(
                (k + 1).cast("long").alias("locus_seq"), part(1).alias("page"), F.size(F.filter(heads, lambda h: h["i"] < first["i"])).cast("long").alias("page_seq"),
                part(2).alias("num"), part(3).alias("ltype"), F.array_join(F.transform(own, bare), "").alias("text"), F.get(before, F.size(before) - 1)["vars"].alias("page_vars"),
            )

        return F.array_compact(F.transform(starts, locus))

    heads = lambda rows: F.transform(F.filter(rows, lambda r: r["is_header"]), lambda r: F.struct(r["i"].alias("i"), _variables(r["line"]).alias("vars")))
    starts = lambda rows: F.transform(F.filter(rows, lambda r: r["is_locus"]), lambda r: r["i"])
    loci = _let(marked, lambda rows: _let(heads(rows), lambda h: _let(starts(rows), lambda s: found(rows, h, s))))
    return files.select("file", F.inline(loci))


def section(loci: DataFrame, unknown: Column | None = None) -> DataFrame:
    """Adds section (raw code where unknown, unless told otherwise), lang and hand."""
    code = F.element_at("page_vars", "I")
    table = F.create_map(*[F.lit(x) for p in fixed.SECTIONS.items() for x in p])
    return loci.withColumns({
        "section": F.coalesce(F.element_at(table, code), code if unknown is None else unknown),
        "lang": F.element_at("page_vars", "L"),
        "hand": F.coalesce(F.element_at("page_vars", "H"), F.lit("?")),
    })


def kind(which: str) -> Column:
    """P for running text, L for labels. F1."""
    return F.substring("ltype", 2, 1) == which


def running_lines(loci: DataFrame, comma: str = ".", whole: bool = False) -> DataFrame:
    """Running-text lines with words: a paragraph opens at its mark or on a page's first line. S4, S16-S19.

    The mark counts before lines without surviving words are left out, so such a line loses
    its break. ``start`` is the number of the line's first word in its page. ``whole`` says that a
    file's loci are next to each other in their task and in order, as :func:`parse` gives them of
    whole files; without it they are shuffled.
    """
    if not whole:
        loci = loci.repartition("file").sortWithinPartitions("file", "locus_seq")
    opens = F.contains("text", F.lit("<%>"))
    marked = section(loci).where(kind("P")).withColumns({"opens": opens, "ws": words.words(words.clean(F.col("text"), comma))}).drop("text", "page_vars")
    columns = [f"`{f.name}` {f.dataType.simpleString()}" for f in marked.schema]
    return marked.mapInArrow(_numbered, ", ".join([*columns, "par_idx bigint", "line_idx int", "start int"]))


def _numbered(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines with words and their paragraph, line and first word, by runs of whole files."""
    for table, _ in pages_of(source, ("file",)):
        page = joint([codes(table[c], "encode")[0] for c in ("file", "page")])
        order = np.argsort(page, kind="stable")
        top = np.diff(page[order], prepend=-1) != 0
        size = pc.list_value_length(table["ws"]).to_numpy()[order].astype(np.int64)
        opens = pc.fill_null(table["opens"], False).to_numpy()[order] | top
        kept = np.flatnonzero(size > 0)
        order, size, opens, page = order[kept], size[kept], opens[kept].astype(np.int64), page[order][kept]
        n = len(order)
        if not n:
            continue
        first = np.flatnonzero(np.diff(page, prepend=-1) != 0)
        own = np.repeat(first, np.diff(np.append(first, n)))
        before = np.cumsum(opens) - opens
        par = np.maximum(before + opens - before[own], 1) - 1
        start = np.cumsum(size) - size
        breaks = np.flatnonzero((np.arange(n) == own) | (np.diff(par, prepend=-1) != 0))
        line = np.arange(n) - np.repeat(breaks, np.diff(np.append(breaks, n)))
        back = np.argsort(order)
        numbers = {"par_idx": par, "line_idx": line.astype(np.int32), "start": (start - start[own]).astype(np.int32)}
        out = table.take(pa.array(order[back]))
        out = out.set_column(out.schema.get_field_index("opens"), "opens", pa.array(opens[back] > 0))
        for name, x in numbers.items():
            out = out.append_column(name, pa.array(x[back]))
        yield from out.to_batches()


def kind_lines(loci: DataFrame) -> DataFrame:
    """Lines with kind title, par-first or body; only the mark opens a paragraph. S14."""
    title = F.substring("ltype", 3, 1) == "t"
    out = section(loci, F.lit("?")).where(kind("P")).withColumn("ws", words.words(words.clean(F.col("text"))))
    return out.where(F.size("ws") > 0).withColumn("kind", F.when(title, "title").when(F.contains("text", F.lit("<%>")), "par-first").otherwise("body"))


def tokens(running: DataFrame) -> DataFrame:
    """The token table: (corpus, section, lang, hand, page, par_idx, line_idx, word_idx, line_len, pos, w). S5, S20."""
    each = running.select(F.col("file").alias("corpus"), "section", "lang", "hand", "page", "locus_seq", "par_idx", "line_idx", F.size("ws").alias("line_len"), "start", F.posexplode("ws").alias("word_idx", "w"))
    return each.withColumn("pos", F.col("start") + F.col("word_idx")).drop("start")


def labels(loci: DataFrame) -> DataFrame:
    """Label words: (page, section, subtype, w). S15."""
    found = section(loci, F.lit("?")).where(kind("L"))
    return found.select("page", "section", F.substring("ltype", 3, 1).alias("subtype"), F.explode(words.words(words.clean(F.col("text")))).alias("w"))


def glyph_stream(toks: DataFrame) -> DataFrame:
    """Normalised glyphs with a dot behind each word, in order: (corpus, page, pos, gi, g). S21."""
    return toks.select("corpus", "page", "pos", F.posexplode(F.concat(glyphs.normal_glyphs(F.col("w")), F.array(F.lit(".")))).alias("gi", "g"))


def channels(loci: DataFrame) -> DataFrame:
    """Four binary choices a scribe makes: (channel, page, hand, locus_seq, word_idx, gi, prev, bit). S22."""
    each = section(loci).where(kind("P")).select("page", "hand", "locus_seq", F.contains("text", F.lit("<%>")).alias("first"), F.posexplode(words.words(words.clean(F.col("text")))).alias("word_idx", "w"))
    return channel_bits(each.withColumn("gs", glyphs.glyphs(F.col("w"))), F.col("first"))


def channel_bits(ws: DataFrame, first: Column) -> DataFrame:
    """The channels of rows with a glyph array ``gs``; other columns but w and gs go along."""
    g, prev = F.col("g"), F.coalesce(F.get("gs", F.col("gi") - 1), F.lit("<s>"))
    run = g.rlike("^i+[nrlm]$")
    bit = lambda name, on, when: F.when(when, F.struct(F.lit(name).alias("channel"), on.cast("int").alias("bit")))
    found = F.array_compact(F.array(
        bit("ch/sh", g == "sh", g.isin("ch", "sh")),
        bit("k/t", g == "t", g.isin("k", "t")),
        bit("pf-vs-tk@par1", g.isin("p", "f"), first & g.isin("t", "k", "p", "f")),
        bit("i-run(1vs2+)", F.length(g) > 2, run),
    ))
    rest = [c for c in ws.columns if c not in ("w", "gs")]
    each = ws.select(*rest, "gs", F.posexplode("gs").alias("gi", "g")).withColumn("prev", prev)
    return each.select(*rest, "gi", "prev", F.inline(found))


def skeleton(toks: DataFrame) -> DataFrame:
    """Tokens with their layout bucket and dense number in it, for generators. S23."""
    from ..operators.layout import role
    from ..operators.lexical import numbered

    return numbered(toks.withColumn("bucket", role()), ("corpus", "bucket")).withColumnRenamed("i", "bucket_idx")
