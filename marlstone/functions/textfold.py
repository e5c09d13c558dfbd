"""Folding of styled, full-width and invisible characters to ASCII as one native ``translate``."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code points that show nothing.
INVISIBLE = "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180e\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2060\u2061\u2062\u2063\u2064\u2066\u2067\u2068\u2069\ufeff"

# Spaces other than U+0020 that stand for it.
SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"

# Letters of other scripts drawn like a Latin letter.
LOOKALIKES = {
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O",
    "Р": "P", "Ѕ": "S", "Т": "T", "Х": "X", "У": "Y", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W",
    "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p",
    "ԛ": "q", "ѕ": "s", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y", "ѡ": "w", "к": "k", "м": "m", "т": "t", "н": "h", "в": "b",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "α": "a", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "χ": "x", "γ": "y", "η": "n", "τ": "t",
    "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꭱ": "R", "Ꮪ": "S", "Ꭲ": "T", "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z",
    "ꓮ": "A", "ꓐ": "B", "ꓚ": "C", "ꓓ": "D", "ꓰ": "E", "ꓝ": "F", "ꓖ": "G", "ꓧ": "H", "ꓙ": "J", "ꓗ": "K", "ꓡ": "L", "ꓟ": "M", "ꓠ": "N", "ꓳ": "O", "ꓑ": "P", "ꓣ": "R", "ꓢ": "S", "ꓔ": "T", "ꓴ": "U", "ꓦ": "V", "ꓪ": "W", "ꓫ": "X", "ꓬ": "Y", "ꓜ": "Z",
    "ı": "i", "ɑ": "a", "ɡ": "g", "ｌ": "l", "ⅼ": "l", "ꓲ": "I", "ո": "n", "օ": "o", "ս": "u", "հ": "h", "ց": "g", "ԍ": "g",
}


def _small_capitals() -> dict[str, str]:
    """Small capitals, by their names in the Unicode data."""
    prefix, out = "LATIN LETTER SMALL CAPITAL ", {}
    for cp in (*range(0x250, 0x2B0), *range(0x1D00, 0x1D80), *range(0xA730, 0xA800)):
        name = unicodedata.name(chr(cp), "")
        if name.startswith(prefix) and len(name) == len(prefix) + 1:
            out[chr(cp)] = name[-1].lower()
    return out


LOOKALIKES |= _small_capitals()


@cache
def compat_ascii() -> dict[str, str]:
    """Each code point whose compatibility form is one printable ASCII character; made by rule from the Unicode data."""
    out = {}
    for cp in range(0x80, 0x20000):
        ch = chr(cp)
        if 0xD800 <= cp < 0xE000 or not unicodedata.decomposition(ch):
            continue
        to = unicodedata.normalize("NFKC", ch)
        if len(to) == 1 and " " < to < "\x7f":
            out[ch] = to
    return out


@cache
def ascii_tables(lookalikes: bool = True) -> tuple[str, str]:
    pairs = dict(compat_ascii())
    pairs |= dict.fromkeys(SPACES, " ")
    if lookalikes:
        pairs |= LOOKALIKES
    return "".join(pairs) + INVISIBLE, "".join(pairs.values())


def ascii_fold(col: Column, lookalikes: bool = True) -> Column:
    """``col`` with such characters replaced; null stays null, plain ASCII is not touched at all."""
    source, target = ascii_tables(lookalikes)
    return F.when(col.rlike(r"[^\x00-\x7f]"), F.translate(col, source, target)).otherwise(col)

