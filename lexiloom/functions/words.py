"""Word-level expressions. Everything is a Column, so Catalyst sees through it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def clean(text: Column, comma: str = ".") -> Column:
    """A transliterated line without markup, words separated by dots. P1, P3.

    ``comma`` is what an uncertain space becomes: a dot, or nothing to join the halves.
    """
    t = F.regexp_replace(text, fixed.INLINE_COMMENT, "")
    t = F.regexp_replace(t, fixed.ALTERNATE, "$1")
    t = F.regexp_replace(t, fixed.MARKUP, "")
    t = F.regexp_replace(t, fixed.HIGH_ASCII, "?")
    t = F.translate(t, "{}'", "")
    t = F.replace(t, F.lit(","), F.lit(comma))
    t = F.regexp_replace(t, fixed.DROPPED, "")
    return F.regexp_replace(F.regexp_replace(t, r"\.+", "."), r"^\.|\.$", "")


def words(cleaned: Column, drop_uncertain: bool = True) -> Column:
    """The words of a cleaned line; uncertain ones (with ``?``) dropped. P2, F2."""
    keep = (lambda w: (w != "") & ~F.contains(w, F.lit("?"))) if drop_uncertain else (lambda w: w != "")
    return F.filter(F.split(cleaned, r"\."), keep)


def latin_words(text: Column, pattern: str = "[a-z]+") -> Column:
    """Lower-case letter runs of plain text."""
    return F.regexp_extract_all(F.lower(text), F.lit(pattern), F.lit(0))


def fold_marks(text: Column) -> Column:
    """Letters of any script without their combining marks: decomposed, marks taken out. P24, S13.

    Decomposition isn't among the built-in functions, so this one is an Arrow batch function; plain
    ASCII batches pass through as they are.
    """

    @F.arrow_udf("string")
    def unmarked(texts):
        import unicodedata

        import pyarrow as pa
        import pyarrow.compute as pc

        if pc.all(pc.string_is_ascii(texts)).as_py() is not False:
            return texts
        plain = ("".join(c for c in unicodedata.normalize("NFD", t) if not unicodedata.category(c).startswith("M")) if t is not None and not t.isascii() else t for t in texts.to_pylist())
        return pa.array(list(plain), pa.string())

    return unmarked(text)


def fold_accents(text: Column) -> Column:
    """Latin letters without their diacritics. P24."""
    return F.translate(text, fixed.ACCENTED, fixed.BASE)


def fold_macrons(text: Column) -> Column:
    return F.translate(text, *fixed.MACRONS)


def m_to_ir(w: Column) -> Column:
    """Final-m notation undone: m is r after i, else ir. P15."""
    return F.replace(F.replace(w, F.lit("im"), F.lit("ir")), F.lit("m"), F.lit("ir"))


def strip_initial_y(w: Column, line_initial: Column, attested: Column) -> Column:
    """A line-initial y taken off where the rest is attested. P16."""
    return F.when(line_initial & w.startswith("y") & (F.length(w) > 2) & attested, F.substring(w, 2, 1 << 20)).otherwise(w)


def alphagram(w: Column) -> Column:
    """Letters in order. P22."""
    return F.array_join(F.array_sort(F.split(w, "")), "")


def parts(w: Column) -> Column:
    """Prefix, core and tail as a struct; empty strings where the word doesn't fit. P23."""
    return F.struct(*[F.regexp_extract(w, fixed.PARTS, i).alias(n) for i, n in enumerate(("pre", "core", "tail"), 1)])


def binary_entropy(p: Column) -> Column:
    """Bits of a coin with head probability ``p``. P25."""
    return F.when((p <= 0) | (p >= 1), F.lit(0.0)).otherwise(-(p * F.log2(p) + (1 - p) * F.log2(1 - p)))


def edit_distance(a: Column, b: Column, cap: int = 3) -> Column:
    """Levenshtein distance, ``cap`` for anything farther. P26."""
    d = F.levenshtein(a, b, cap - 1)
    return F.when(d < 0, F.lit(cap)).otherwise(d)


def bar(x: Column) -> Column:
    """A text histogram bar. K2."""
    return F.repeat(F.lit("#"), F.round(x).cast("int"))


def percent(x: Column, digits: int = 1) -> Column:
    return F.format_string(f"%.{digits}f%%", 100 * x)
