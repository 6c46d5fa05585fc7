"""Glyph-level expressions of transliterated words."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


def glyphs(w: Column) -> Column:
    """Glyph array: benched letters and runs are one glyph each. P4."""
    return F.regexp_extract_all(w, F.lit(fixed.GLYPH), F.lit(0))


def normal(g: Column) -> Column:
    """An e-run is E; an i-run is I and its final letter, or a dash. P5."""
    end = F.regexp_replace(g, "^i+", "")
    return F.when(g.startswith("e"), "E").when(g.startswith("i"), F.concat(F.lit("I"), F.when(end == "", "-").otherwise(end))).otherwise(g)


def normal_glyphs(w: Column) -> Column:
    return F.transform(glyphs(w), normal)


def _class_map(extra: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for pair in {**fixed.CLASSES, **extra}.items() for x in pair])


def class_string(w: Column, extra: dict[str, str] | None = None, rare: str | None = None) -> Column:
    """Glyph classes joined; ``rare`` (null by default) for a word with an unknown glyph. P6, P10."""
    table = _class_map(extra or {})
    known = F.forall(normal_glyphs(w), lambda g: F.map_contains_key(table, g))
    return F.when(known, F.array_join(F.transform(normal_glyphs(w), lambda g: F.element_at(table, g)), "")).otherwise(F.lit(rare))


def conforms(w: Column, grammar: str = fixed.GRAMMAR_2) -> Column:
    """Whether a word's class string fits the grammar; false for unknown glyphs. P7."""
    return F.coalesce(class_string(w).rlike(grammar), F.lit(False))


def slots(classes: Column, pattern: str = fixed.SLOTS_11, n: int = 11) -> Column:
    """Slot fillers of a class string as an array of ``n``. P8, P9."""
    return F.array(*[F.regexp_extract(classes, pattern, i) for i in range(1, n + 1)])


def features(w: Column) -> dict[str, Column]:
    """Ten yes/no features of a word. P11."""
    g = glyphs(w)
    first, last = F.get(g, 0), normal(F.element_at(g, -1))
    return {
        "starts-q": first == "q", "starts-o": first == "o", "starts-d": first == "d", "starts-y": first == "y",
        "starts-s/sh": first.isin("s", "sh"), "starts-gallows": first.isin(*fixed.GALLOWS_ALL), "has-p/f": has_pf(w),
        "ends-m": last.isin("Im", "m"), "ends-in": last == "In", "ends-y": last == "y",
    }


def short_features(w: Column) -> dict[str, Column]:
    """Four features that survive normalisation. P12."""
    return {"ends-m": w.endswith("m"), "starts-y": w.startswith("y"), "starts-q": w.startswith("q"), "starts-gallows": F.get(glyphs(w), 0).isin(*fixed.GALLOWS_ALL)}


def has_pf(w: Column) -> Column:
    """P13."""
    return F.arrays_overlap(glyphs(w), F.array(*[F.lit(x) for x in fixed.PF]))


def word_class(w: Column) -> Column:
    """One of eight classes, by precedence. P14."""
    g = F.get(normal_glyphs(w), 0)
    return (
        F.when(has_pf(w), "pf").when(g == "q", "q-").when(g.isin(*fixed.GALLOWS_KT), "gallows-").when(g.isin("ch", "sh"), "ch/sh-")
        .when(g.isin("o", "a"), "o/a-").when(g == "y", "y-").when(g.isin("d", "s", "l", "r"), "dslr-").otherwise("other")
    )


def rewrites(w: Column) -> dict[str, Column]:
    """Ligature readings to test for attestation. P17."""
    out = {f"p>{to}": F.replace(w, F.lit("p"), F.lit(to)) for to in ("t", "te", "tch", "tk", "d")}
    return out | {"pf>tk": F.translate(w, "pf", "tk")}


def frame(w: Column, targets: tuple[str, ...]) -> Column:
    """The word with its single target glyph blanked; null unless there is exactly one. P18."""
    g = glyphs(w)
    hit = F.array(*[F.lit(t) for t in targets])
    one = F.size(F.filter(g, lambda x: F.array_contains(hit, x))) == 1
    blank = lambda x: F.when(F.array_contains(hit, x), F.when(F.length(x) == 3, "_B_").otherwise("_")).otherwise(x)
    return F.when(one, F.array_join(F.transform(g, blank), ""))


def stem(w: Column) -> Column:
    """All glyphs but the last, and the last. P19."""
    g = glyphs(w)
    return F.struct(F.array_join(F.slice(g, 1, F.greatest(F.size(g) - 1, F.lit(0))), "").alias("stem"), F.element_at(g, -1).alias("final"))


def length(w: Column) -> Column:
    """Glyphs in a word. P21."""
    return F.size(glyphs(w))


def first_cut(w: Column, fits: Callable[[Column], Column] = conforms) -> Column:
    """Where a word first splits into two fitting halves of two letters or more; null if nowhere. P27."""
    cuts = F.when(F.length(w) >= 4, F.sequence(F.lit(2), F.length(w) - 2)).otherwise(F.array().cast("array<int>"))
    return F.get(F.filter(cuts, lambda i: fits(F.substring(w, F.lit(1), i)) & fits(F.substring(w, i + 1, F.length(w)))), 0)


def monotone(w: Column, rank: Column) -> Column:
    """Whether glyph ranks never fall; null if fewer than two are ranked. A24.

    ``rank`` maps glyphs to ranks.
    """
    r = F.filter(F.transform(glyphs(w), lambda g: F.element_at(rank, normal(g))), lambda x: x.isNotNull())
    return F.when(F.size(r) >= 2, F.array_sort(r) == r)
