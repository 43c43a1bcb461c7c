"""Accents and typographic signs in ASCII, as Column expressions.

The tables follow from the Unicode decompositions by rule; they are built once, when a
plan is made, and applied in the JVM.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ColumnOrName, _c

#: Characters without a decomposition and their ASCII spelling.
ASCII = {"ß": "ss", "æ": "ae", "Æ": "AE", "ø": "o", "Ø": "O", "ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "þ": "th", "Þ": "Th", "œ": "oe", "Œ": "OE", "‘": "'", "’": "'", "“": '"', "”": '"', "„": '"', "–": "-", "—": "--", "−": "-", "…": "...", "€": "EUR", "£": "PS", "«": '"', "»": '"'}
#: Code points whose decompositions are taken: European letters, signs, forms of presentation.
RANGES = ((0xA0, 0x600), (0x1E00, 0x2000), (0x2000, 0x2190), (0xFB00, 0xFB07), (0xFF01, 0xFF5F))


def plain(c: str) -> str:
    """One character: decomposed, without its marks."""
    t = unicodedata.normalize("NFKD", ASCII.get(c) or c)
    return "".join(x for x in t if not unicodedata.combining(x))


_TABLE = {c: p for lo, hi in RANGES for c in map(chr, range(lo, hi)) if (p := plain(c)) != c and not unicodedata.combining(c)}
SINGLE = {c: p for c, p in _TABLE.items() if len(p) == 1}
MULTIPLE = {c: p for c, p in _TABLE.items() if len(p) != 1}
#: Characters that text read as Latin-1 instead of UTF-8 shows, and what was meant.
GARBLED = {c.encode().decode("cp1252"): c for c in [*map(chr, range(0xA1, 0x180)), *"–—‘’“”„•…€™"] if not set(c.encode()) & {0x81, 0x8D, 0x8F, 0x90, 0x9D}}


def _replaced(text: Column, table: dict[str, str]) -> Column:
    pairs = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in table.items()])
    return F.aggregate(pairs, text, lambda t, x: F.replace(t, x["a"], x["b"]))


def fix_garbled(text: ColumnOrName) -> Column:
    """UTF-8 that was read as Windows-1252, put right sequence by sequence; a text
    without a lead character is not touched.  The part of the repair that has a table;
    spans and other encodings need a model."""
    t = _c(text)
    return F.when(t.rlike("[ÂÃÄÅâ][\\x{80}-\\x{FF}\\x{0152}-\\x{02DC}\\x{2013}-\\x{2122}]"), _replaced(t, GARBLED)).otherwise(t)


def plain_ascii(text: ColumnOrName) -> Column:
    """Letters without accents, typographic signs in ASCII, wide and joined forms as
    plain letters; scripts without such forms stay.  Null stays null."""
    t = _c(text)
    many = F.when(t.rlike("[" + "".join(MULTIPLE).replace("\\", "").replace("]", "").replace("^", "") + "]"), _replaced(t, MULTIPLE)).otherwise(t)
    single = F.translate(many, "".join(SINGLE), "".join(SINGLE.values()))
    return F.when(t.rlike(r"[^\x00-\x7F]"), F.regexp_replace(single, r"\p{M}", "")).otherwise(t)
