"""Character normalisation and white space, as Column functions (JVM only).  Null in, null out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that PDF extraction produces and what they stand for (one for one, so offsets hold).
TO_NEWLINE = "\r\f\v\u2028\u2029"
TO_SPACE = "\u00a0\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000\u200b\u200c\u200d\u2060\ufeff\u00ad\u2022\ufffd"
TO_OTHER = {"\u2013": "-", "\u2014": "-", "\u2212": "-", "\u201c": '"', "\u201d": '"', "\u2018": "'", "\u2019": "'", "\u00b7": ".", "\u2026": "."}

FROM = TO_NEWLINE + TO_SPACE + "".join(TO_OTHER)
TO = "\n" * len(TO_NEWLINE) + " " * len(TO_SPACE) + "".join(TO_OTHER.values())

#: White space as Python's str.strip sees it, for use inside a (?U) character class.
WS = r"\s\x1c-\x1f"
# The same characters one by one, for trimming without a regex, and as ranges, which match without (?U) and faster.
WS_CHARS = "\t\n\v\f\r\x1c\x1d\x1e\x1f \x85\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
WS_RANGES = r"\t-\r\x1c-\x20\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def let(value: Column, use) -> Column:
    """use(value), with value evaluated once however often use refers to it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def normalize_pdf_text(text: Column) -> Column:
    """Map look-alikes to plain characters, one for one."""
    return F.translate(text, FROM, TO)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(WS_CHARS))


def lstrip(text: Column) -> Column:
    return F.ltrim(text, F.lit(WS_CHARS))


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(WS_CHARS))


def collapse(text: Column) -> Column:
    """Strip, and each run of white space to one space."""
    return F.regexp_replace(strip(text), f"[{WS_RANGES}]+", " ")


def detection_text(text: Column) -> Column:
    """Normalised text without footnote marks, for line predicates."""
    return F.regexp_replace(normalize_pdf_text(text), "[*†‡•]+", "")


def find(text: Column, part: Column) -> Column:
    """0-based place of the first occurrence; -1 if absent."""
    return F.instr(text, part) - 1


def slice_text(text: Column, start: Column, end: Column) -> Column:
    """Characters [start, end), 0-based."""
    return F.substr(text, (start + 1).cast("int"), F.greatest(end - start, F.lit(0)).cast("int"))
