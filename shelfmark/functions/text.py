"""Columns for text: printable ASCII, comparison keys, variants and titles."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Marks with a set ASCII form.
SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"
DASHES = "‐‑‒–—―−﹘﹣－"
SINGLE_QUOTES = "‘’‚‛′‵`´＇"
DOUBLE_QUOTES = "“”„‟″‶＂"
LIGATURES = {"…": "...", "ß": "ss", "ẞ": "SS", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE", "þ": "th", "Þ": "Th"}
LETTERS = {"ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ð": "d", "Ð": "D", "ł": "l", "Ł": "L", "ı": "i", "İ": "I"}


def _accents() -> tuple[str, str]:
    """Latin letters that decompose into an ASCII letter and marks."""
    pairs = [(chr(c), unicodedata.normalize("NFKD", chr(c))[0]) for c in [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)] if chr(c) not in LIGATURES and chr(c) not in LETTERS]
    pairs = [(a, b) for a, b in pairs if b.isascii() and b.isalpha()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_FROM, _TO = _accents()
_FROM = SPACES + DASHES + SINGLE_QUOTES + DOUBLE_QUOTES + "".join(LETTERS) + _FROM
_TO = " " * len(SPACES) + "-" * len(DASHES) + "'" * len(SINGLE_QUOTES) + '"' * len(DOUBLE_QUOTES) + "".join(LETTERS.values()) + _TO


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def compact(c: Column) -> Column:
    """White space runs become one space; none at the ends."""
    return F.trim(F.regexp_replace(c, "\\s+", " "))


def ascii_text(c: Column, fallback: Column | None = None) -> Column:
    """Printable ASCII form of a text; blank results give the fallback."""
    for mark, plain in LIGATURES.items():
        c = F.replace(c, F.lit(mark), F.lit(plain))
    c = compact(F.regexp_replace(F.regexp_replace(F.translate(c, _FROM, _TO), "[\\r\\n\\t\\f\\x0B]", " "), "[^\\x20-\\x7E]", ""))
    return c if fallback is None else F.coalesce(F.nullif(c, F.lit("")), fallback)


def compare_key(c: Column, kind: str = "compare") -> Column:
    """Comparison keys: compare, lookup (leading article off), place (accents off), letters, ascii_letters."""
    low = F.lower(c)
    if kind == "letters":
        return F.regexp_replace(low, "[^\\p{L}]", "")
    if kind == "ascii_letters":
        return F.regexp_replace(low, "[^a-z]", "")
    if kind == "place":
        low = F.lower(ascii_text(c))
    else:
        low = F.replace(low, F.lit("&"), F.lit(" and "))
        if kind == "lookup":
            low = F.regexp_replace(low, "^the\\s+", "")
    return F.trim(F.regexp_replace(low, "[^a-z0-9]+", " "))


def without_article(c: Column) -> Column:
    return compact(F.regexp_replace(F.regexp_replace(compact(c), "(?i)^the ", ""), "(?i),? the$", ""))


def padded(c: Column) -> Column:
    """Key with a space on both sides, for containment at word borders."""
    return F.concat(F.lit(" "), compare_key(c), F.lit(" "))


_STAMP = "[0-9]{1,2}(?::[0-9]{2}){1,2}"
#: What may stand before a title, in any order: separators, a duration, its place in the list, an encore mark.
_LEADS = ("[ :.;/-]", f"[\\[(]?{_STAMP}[\\])]?\\s", "(?:[0-9]{1,3} )?of [0-9]{1,3} ", "(?:e|enc|encore) ?: ")
#: What may stand after it: separators, a duration with a remark, a tape flip, footnote marks, month and day.
_TAILS = ("[ :.;/-]", f" ?[\\[(]?{_STAMP}[\\])]?(?: \\([^)]{{1,80}}\\))?", " tape flip", "(?<=[a-z0-9)]) ?[*†‡]+", "(?<=[a-z)]) [0-9]{1,2}[-_.][0-9]{1,2}")
_TITLE = f"(?i)^(?:{'|'.join(_LEADS)})*(.*?)(?:{'|'.join(_TAILS)})*$"


def clean_title(c: Column) -> Column:
    """The title itself out of a list line: what `_LEADS` and `_TAILS` describe goes; without letter or digit it is empty."""
    inner = compact(F.regexp_extract(compact(c), _TITLE, 1))
    return F.when(inner.rlike("[A-Za-z0-9]"), inner).otherwise("")


def usable_title(c: Column) -> Column:
    """False for empty titles and names that only number a track."""
    return (c != "") & ~c.rlike("(?i)^(unknown|untitled|(audio )?track|title|song)[ ._-]*[0-9]*$") & ~c.rlike("^[0-9]+$")
