"""Constants of the transliteration, its word grammar and the control corpora."""

# ruff: noqa: E501
# ---- Fixed values: they have to equal the published ones for right results. ----

PAGE_HEADER = r"^<(f\S+?)>\s*(?:<!\s*(.*?)>)?\s*$"
LOCUS = r"^<(f\S+?)\.(\S+?),(\S+?)>\s*(.*)$"
PAGE_VARIABLE = r"\$(\w)=(\S+)"
INLINE_COMMENT = r"<![^>]*>"
ALTERNATE = r"\[([^:\]]*):[^\]]*\]"
MARKUP = r"<[^>]*>"
HIGH_ASCII = r"@\d+;"
DROPPED = r"[!%=\-~\s]"
SECTIONS = {"H": "herbal", "A": "astro", "Z": "zodiac", "B": "biological", "C": "cosmological", "P": "pharmaceutical", "S": "stars/recipes", "T": "text-only"}

GLYPH = "cth|ckh|cph|cfh|ch|sh|e+|i+[nrlm]?|."
CLASSES = {
    "q": "Q", "o": "O", "y": "Y", "a": "A", "ch": "C", "sh": "C",
    "cth": "G", "ckh": "G", "cph": "G", "cfh": "G", "k": "K", "t": "K", "p": "K", "f": "K",
    "E": "E", "d": "D", "l": "L", "r": "R", "s": "S", "n": "N", "m": "M",
    "In": "J", "Ir": "J", "Il": "J", "Im": "J", "I-": "J",
}
GRAMMAR_1 = r"^Q?[OY]?[DSLR]?(?:[CG]K?|K[CG]?)?E?(?:[CG]K?|K[CG]?)?E?[DSLR]?[OA]?(?:J|[LRMNDS])?Y?$"
GRAMMAR_2 = r"^Q?[OY]?[DSLR]?(?:[CG]K?|K[CG]?)?E?(?:[CG]K?|K[CG]?)?E?(?:[DSLR]?[OA]?(?:J|[LRMNDS])?Y?){0,2}$"
SLOTS_11 = r"^(Q?)([OY]?)([DSLR]?)((?:[CG]K?|K[CG]?)?)(E?)((?:[CG]K?|K[CG]?)?)(E?)([DSLR]?)([OA]?)((?:J|[LRMNDS])?)(Y?)$"
SLOTS_8 = r"^(Q?)([OY]?)([DSLR]?)((?:[CG]K?|K[CG]?)?)(E?)((?:[CG]K?|K[CG]?)?)(E?)((?:[DSLR]?[OA]?(?:J|[LRMNDS])?Y?){0,2})$"
SLOT_NAMES_8 = ("q", "o/y", "d/s/l/r", "bench+gallows", "e-run", "bench/gallows 2", "e-run 2", "tail")
PARTS = r"^(q?[oy]?[dslr]?)((?:c[tkpf]h|ch|sh)?[ktpf]?e*(?:c[tkpf]h|ch|sh)?[ktpf]?e*)((?:[dslr]?[oa]?(?:i+[nrlm]?|[lrmnds])?y?){0,2})$"
ENDINGS = ("y", "dy", "in", "iin", "ar", "al", "or", "ol", "ain", "aiin", "ey", "eey", "am", "ir")

GALLOWS_ALL = ("k", "t", "p", "f", "cth", "ckh", "cph", "cfh")
GALLOWS_KT = ("k", "t", "cth", "ckh")
PF = ("p", "f", "cph", "cfh")
CONSONANTS = "nlrsm"

POLYNESIAN_LETTERS = "aeiouhkmnprtwg"
ENGLISH_STOPS = ("the", "of", "and", "to", "is", "that", "with", "for", "revision", "translation", "notes")
MACRONS = ("āēīōū", "aeiou")
# ---- End of fixed values. ----

#: Accented Latin letters and their base letters, derived from Unicode decomposition.
def _folds() -> tuple[str, str]:
    import unicodedata

    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in range(0xC0, 0x180)]
    kept = [(a, b) for a, b in pairs if a != b and b.isascii()]
    return "".join(a for a, _ in kept), "".join(b for _, b in kept)


ACCENTED, BASE = _folds()
