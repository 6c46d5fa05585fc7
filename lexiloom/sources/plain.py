"""Plain-text corpora for comparison: marked-up books, filtered lines, source code. S6-S13, S25."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed, words


def read(spark: SparkSession, path: str) -> DataFrame:
    """(file, text) of whole text files; a glob gives several."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.col("value").alias("text"))


def body(text: Column, guarded: bool = True) -> Column:
    """The text between a book's start and end marks. S6, S8.

    Unguarded, a missing mark leaves what a search that fails with -1 leaves: nothing without a
    start, all but the last character without an end. Guarded, a text without both is whole.
    """
    a, b = F.locate("*** START", text), F.locate("*** END", text)
    inner = F.substring(text, a, F.greatest(b - a, F.lit(0)))
    if guarded:
        return F.when((a > 0) & (b > a), inner).otherwise(text)
    return F.when((a > 0) & (b > 0), inner).otherwise("")


def corpus(files: DataFrame, name: str, ws: Column, limit: int | None = None) -> DataFrame:
    """(corpus, file, gpos, w): the words of files in file order, up to ``limit``.

    Global positions are file offsets, summed in two levels, plus positions; words come apart last.
    """
    from ..operators.lexical import page_starts

    each = files.select("file", ws.alias("ws"))
    # a column instead of a constant: joins on a constant would become products
    own = F.when(F.col("file").isNotNull(), name).alias("corpus")
    sizes = each.groupBy(own, F.col("file").alias("page")).agg(F.sum(F.size("ws").cast("long")).alias("n")).where("n > 0")
    offsets = page_starts(sizes).select(F.col("page").alias("file"), "start")
    out = each.join(offsets, "file").select("file", "start", F.posexplode("ws").alias("i", "w")).select(F.lit(name).alias("corpus"), "file", (F.col("start") + F.col("i")).alias("gpos"), "w")
    return out if limit is None else out.where(F.col("gpos") < limit)


def book(files: DataFrame, name: str = "book", limit: int | None = 38_000, guarded: bool = False) -> DataFrame:
    """S6, S12, S25 (letters only)."""
    return corpus(files, name, words.latin_words(body(F.col("text"), guarded)), limit)


def noted(files: DataFrame, name: str = "latin") -> DataFrame:
    """A book without bracketed notes. S9."""
    return corpus(files, name, words.latin_words(F.regexp_replace(body(F.col("text")), r"\[[^\]]*\]", " ")))


def code(files: DataFrame, name: str = "code") -> DataFrame:
    """Identifiers and keywords of source files. S12."""
    return corpus(files, name, words.latin_words(F.col("text")))


def legal_lines(files: DataFrame, name: str, letters: str = fixed.POLYNESIAN_LETTERS, share: float = 0.9, least: int = 4, macrons: bool = True) -> DataFrame:
    """Legal words of lines that consist of them: at least ``least`` words, ``share`` of them legal. S10, S11, F10."""
    text = body(F.col("text"))
    text = words.fold_macrons(text) if macrons else text
    legal = lambda ws: F.filter(ws, lambda w: w.rlike(f"^[{letters}]+$"))
    lines = F.transform(F.split(text, r"\r?\n"), lambda line: words.latin_words(line))
    kept = F.filter(lines, lambda ws: (F.size(ws) >= least) & (F.size(legal(ws)) >= F.lit(share) * F.size(ws)))
    return corpus(files, name, F.flatten(F.transform(kept, legal)))


def folded(files: DataFrame, name: str = "folded", stops: tuple[str, ...] = fixed.ENGLISH_STOPS, most: int = 1) -> DataFrame:
    """Accent-folded words of lines with at most ``most`` stop words. S13."""
    lines = F.transform(F.split("text", r"\r?\n"), lambda s: F.regexp_extract_all(F.lower(s), F.lit("[a-zß-öø-ÿā-ſ]+"), F.lit(0)))
    kept = F.filter(lines, lambda ws: (F.size(F.filter(ws, lambda w: w.isin(*stops))) <= most))
    flat = F.transform(F.flatten(kept), words.fold_accents)
    return corpus(files, name, F.filter(flat, lambda w: w.rlike(r"^\p{L}+$")))


def paginate(flat: DataFrame, size: int = 170) -> DataFrame:
    """Pseudo-pages of ``size`` words: page_seq and pos from gpos. S7."""
    return flat.withColumns({"page_seq": F.floor(F.col("gpos") / size), "pos": F.col("gpos") % size})
