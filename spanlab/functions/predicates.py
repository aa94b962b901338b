"""Line and candidate predicates and cleaning, as Column functions (JVM only).  Null text counts as empty."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .chars import WS, collapse, detection_text, let, lstrip, rstrip, strip

# Whole-line section names.
SECTIONS = ["publications", "refereed journal articles", "book chapters", "conference presentations", "invited talks", "presentations", "books",
            "chapters", "manuscripts", "works in progress", "technical reports", "reports", "awards", "grants", "teaching", "service"]
# Whole-line names of sections that hold no references.
OTHER_SECTIONS = ["research funding", "current support", "completed support", "scientific review and service", "professional service",
                  "editorial service", "editorial board", "memberships", "media", "media coverage", "awards", "honors", "teaching", "courses taught",
                  "clinical experience", "practicum", "service", "associate editor", "consulting editor", "editorial board member",
                  "search committee", "committee member", "submission reviewer", "session chair", "volunteer"]
# Words that mark a candidate as no reference.
NO_REFERENCE = ["award", "scholarship", "grant awardee", "recipient", "committee", "panelist", "reviewer", "editor", "editorial board", "member",
                "volunteer", "course director", "practicum", "supervisor", "search committee", "submission reviewer", "session chair",
                "faculty search committee", "promotion & tenure", "current support", "pi or mpi"]
# Words of journals, of books and of meetings.
JOURNAL = ["journal", "review", "press", "quarterly", "science", "psychology", "management", "image", "development", "parenting", "neuroscience",
           "work", "stress", "behavior"]
BOOK = r"\b(in\s+[A-Z]|eds?\.)\b|\bhandbook\b|\boxford\b|\bcambridge\b|emerald publishing|volume\b"
MEETING = ["paper presented", "poster presented", "poster presentation", "symposium", "panel discussion", "annual meeting", "conference", "congress",
           "convention"]
# Patterns of dates, names, pages and lines.
YEAR, YEAR_MONTH = r"\((19|20)\d{2}[a-z]?\)", r"\((19|20)\d{2},\s*[A-Za-z]+\)"
SURNAME = r"^[A-Z][A-Za-z'`\-]+,"
PAGE_LINE = r"[A-Z][A-Za-z'`\-]+\s*\|\s*(?:CV|Vita|Curriculum Vitae)\s*\d+"
MEETING_LINE = r"[A-Z][A-Z’'&\-]{1,20}\s+\d{4}"

#: Line ends of Python's str.splitlines.
NL = r"\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029"


def _has(text: Column, pattern: str, fold: bool = False) -> Column:
    return F.rlike(text, F.lit(("(?iU)" if fold else "(?U)") + pattern))


def splitlines(text: Column) -> Column:
    """Lines with their ends: array<string>; a carriage return and line feed end one line."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"[^{NL}]*(?:\r\n|[{NL}])|[^{NL}]+"), F.lit(0))


def _shown(line: Column) -> Column:
    return strip(detection_text(F.coalesce(line, F.lit(""))))


def _header(s: Column) -> Column:
    names = "|".join(SECTIONS + OTHER_SECTIONS)
    capital = (F.upper(s) == s) & _has(s, "[A-Z]")
    titled = s.endswith(":") & ~_has(s, r"\((19|20)\d{2}") & ~_has(s, r"\b[A-Z]\.")
    # no name holds a comma, most other lines do
    return (s != "") & ((~s.contains(",") & _has(s, rf"^(?:{names})[{WS}]*:?[{WS}]*\z", True)) | ((F.length(s) <= 80) & (capital | titled)))


def strip_number(line: Column) -> Column:
    return F.regexp_replace(line, rf"(?U)^[{WS}]*\d+[.)][{WS}]*", "")


def _numbered(s: Column) -> Column:
    return _has(s, rf"^[{WS}]*\d+[.)][{WS}]+") & _has(strip_number(s), SURNAME)


def _start(s: Column) -> Column:
    def general(bare: Column) -> Column:
        dated = _has(F.substring(bare, 1, 220), f"{YEAR}|{YEAR_MONTH}")
        return dated & (_has(bare, rf"{SURNAME}\s*(?:[A-Z]\.\s*)+") | (_has(bare, SURNAME) & _has(F.substring(bare, 1, 160), r"\b[A-Z]\.")))

    return (s != "") & ~_header(s) & (_numbered(s) | let(strip_number(s), general))


def is_header(line: Column) -> Column:
    return let(_shown(line), _header)


def is_numbered_start(line: Column) -> Column:
    return let(_shown(line), lambda s: (s != "") & ~_header(s) & _numbered(s))


def is_reference_start(line: Column) -> Column:
    return let(_shown(line), _start)


def line_kind(line: Column) -> Column:
    """'header', 'numbered', 'general' or null: the first that holds."""
    return let(_shown(line), lambda s: F.when(_header(s), "header").when((s != "") & _numbered(s), "numbered").when(_start(s), "general"))


def _cut_lines(text: Column, stop, keep_after: bool) -> Column:
    """text from (keep_after) or up to the first line that stop() accepts; all of it if none does."""
    def cut(x: Column) -> Column:
        part = F.slice(x["lines"], F.greatest(x["at"], F.lit(1)), F.size(x["lines"])) if keep_after else F.slice(x["lines"], F.lit(1), F.greatest(x["at"] - 1, F.lit(0)))
        return F.when(x["at"] > 0, F.array_join(part, "")).otherwise(x["text"])

    def found(x: Column) -> Column:
        at = F.array_position(F.transform(x["lines"], lambda line: stop(strip(line))), F.lit(True)).cast("int")
        return let(F.struct(x["text"].alias("text"), x["lines"].alias("lines"), at.alias("at")), cut)

    return let(text, lambda t: let(F.struct(t.alias("text"), splitlines(t).alias("lines")), found))


def trim_leading(text: Column) -> Column:
    """From the first line that starts a reference."""
    return lstrip(_cut_lines(text, is_reference_start, True))


def trim_trailing(text: Column) -> Column:
    """Up to the first header, page or meeting line; then such an ending inside the last line."""
    def stop(x: Column) -> Column:
        return let(x, lambda y: _stops(y))

    cut = rstrip(_cut_lines(text, stop, False))
    cut = rstrip(F.regexp_replace(cut, rf"(?iU)\n?\s*{PAGE_LINE}\s*\z", ""))
    return rstrip(F.regexp_replace(cut, rf"(?iU)\n?\s*{MEETING_LINE}\s*\z", ""))


def _stops(x: Column) -> Column:
    """A header, page or meeting line."""
    return is_header(x) | _has(x, rf"^\s*{PAGE_LINE}\s*\z", True) | _has(x, rf"^\s*{MEETING_LINE}\s*\z")


def clean_candidate(text: Column) -> Column:
    return strip(trim_trailing(trim_leading(text)))


def is_obvious_other(text: Column) -> Column:
    return _has(collapse(F.coalesce(text, F.lit(""))), rf"\b({'|'.join(NO_REFERENCE)})\b", True)


def apa_score(text: Column) -> Column:
    """How many of date, initials, place of publication and author separators a candidate shows: 0 to 4."""
    return let(collapse(F.regexp_replace(strip(F.coalesce(text, F.lit(""))), "[*†‡•]+", "")), _signs)


def _signs(s: Column) -> Column:
    signs = [
        _has(s, f"{YEAR}|{YEAR_MONTH}"),
        _has(s, r"\b[A-Za-z]\."),
        _has(s, r"\b\d{1,4}\s*[-–]\s*\d{1,4}\b") | _has(s, r"doi\.org/|https?://|doi:\s*10\.", True) | _has(s, rf"\b({'|'.join(JOURNAL)})\b", True)
        | _has(s, BOOK, True) | _has(s, rf"\b({'|'.join(MEETING)})\b", True),
        s.contains(",") | s.contains("&") | F.lower(s).contains(" and "),
    ]
    return sum((x.cast("int") for x in signs), F.lit(0))


def apa_like(other: Column, score: Column) -> Column:
    """is_apa() of a text from its is_obvious_other() and apa_score(); a blank text has score 0."""
    return ~other & (score >= 3)


def is_apa(text: Column) -> Column:
    return let(strip(F.coalesce(text, F.lit(""))), lambda s: (s != "") & apa_like(is_obvious_other(s), apa_score(s)))


# What a link looks like.
URL = r"(?iU)(?:https?://|www\.)\S+"


def drop_links(text: Column) -> Column:
    """text without links and what they leave behind: empty brackets, spaces before punctuation, double spaces, edges of , and ;."""
    out = text
    for pattern, to in ((URL, ""), (r"(?U)\(\s*\)", ""), (r"(?U)\[\s*\]", ""), (r"(?U)\s+([,.;:])", "$1"), (r"(?U)\s{2,}", " "), (r"\A[ ,;]+|[ ,;]+\z", "")):
        out = F.regexp_replace(out, pattern, to)
    return strip(F.when(F.rlike(text, F.lit(URL)), out).otherwise(text))
