"""DuckDB SQL for the catalog's queries, formulated apart from the Spark plans.

RE2 has no lookaround and ASCII-only classes, so classes are spelled out.
"""

from __future__ import annotations

from .functions import chars, predicates, shapes

WS = r"\s\x0b\x1c-\x1f\x{85}\p{Z}"


def q(text: str) -> str:
    """A SQL literal; control characters by chr()."""
    out = "'" + text.replace("'", "''") + "'"
    for c in sorted({c for c in text if ord(c) < 32 or 0x7F <= ord(c) < 0xB0 or 0x2000 <= ord(c) < 0x2070 or ord(c) in (0x3000, 0xFEFF, 0xFFFD)}):
        out = out.replace(c, f"'||chr({ord(c)})||'")
    return "(" + out + ")"


def norm(x: str) -> str:
    return f"translate({x}, {q(chars.FROM)}, {q(chars.TO)})"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def lstrip(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS}]+', '')"


def rstrip(x: str) -> str:
    return f"regexp_replace({x}, '[{WS}]+$', '')"


def collapse(x: str) -> str:
    return f"regexp_replace({strip(x)}, '[{WS}]+', ' ', 'g')"


def detection(x: str) -> str:
    return strip(f"regexp_replace({norm(x)}, '[*†‡•]+', '', 'g')")


def header(s: str) -> str:
    """s: detection text."""
    names = "|".join(predicates.SECTIONS + predicates.OTHER_SECTIONS)
    return rf"""({s} <> '' AND (regexp_full_match(lower({s}), '({names})[{WS}]*:?') OR (length({s}) <= 80 AND (
        (upper({s}) = {s} AND regexp_matches({s}, '[A-Z]')) OR (ends_with({s}, ':') AND NOT regexp_matches({s}, '\((19|20)\d\d') AND NOT regexp_matches({s}, '\b[A-Z]\.'))))))"""


def bare(s: str) -> str:
    return rf"regexp_replace({s}, '^\d+[.)][{WS}]*', '')"


def numbered(s: str) -> str:
    return rf"(regexp_matches({s}, '^\d+[.)][{WS}]+') AND regexp_matches({bare(s)}, '^[A-Z][A-Za-z''`-]+,') AND NOT {header(s)})"


def general(s: str) -> str:
    b = bare(s)
    return rf"""({s} <> '' AND NOT {header(s)} AND ({numbered(s)} OR (regexp_matches(substr({b}, 1, 220), '\((19|20)\d\d[a-z]?\)|\((19|20)\d\d,\s*[A-Za-z]+\)')
        AND regexp_matches({b}, '^[A-Z][A-Za-z''`-]+,') AND (regexp_matches({b}, '^[A-Z][A-Za-z''`-]+,\s*[A-Z]\.') OR regexp_matches(substr({b}, 1, 160), '\b[A-Z]\.')))))"""


def other(x: str) -> str:
    return rf"regexp_matches({collapse(x)}, '(?i)\b({'|'.join(predicates.NO_REFERENCE)})\b')"


def apa(x: str) -> str:
    s = collapse(f"regexp_replace({strip(x)}, '[*†‡•]+', '', 'g')")
    return rf"""((regexp_matches({s}, '\((19|20)\d\d([a-z]?|,\s*[A-Za-z]+)\)'))::INT + (regexp_matches({s}, '\b[A-Za-z]\.'))::INT
        + (regexp_matches({s}, '\b\d{{1,4}}\s*[-–]\s*\d{{1,4}}\b') OR regexp_matches({s}, '(?i)doi\.org/|https?://|doi:\s*10\.')
           OR regexp_matches({s}, '(?i)\b({'|'.join(predicates.JOURNAL + predicates.MEETING)})\b|\b(in\s+[A-Z]|eds?\.)\b|\bhandbook\b|\boxford\b|\bcambridge\b|emerald publishing|volume\b'))::INT
        + (contains({s}, ',') OR contains({s}, '&') OR contains(lower({s}), ' and '))::INT)"""


LINE = r"[^\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]*(\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}])|[^\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]+"


def lines_cte(source: str, name: str = "lines") -> str:
    """doc_id, pos, line, start from a table doc_id, text."""
    return f"""{name}_a AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{LINE}') AS a FROM {source}),
{name}_b AS (SELECT doc_id, unnest(a) AS line, unnest(range(len(a))) AS pos FROM {name}_a),
{name} AS (SELECT doc_id, pos, line, coalesce(sum(length(line)) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM {name}_b)"""


_W, _N = rf"[{WS}]", r"[^\s\x0b\x1c-\x1f\x{85}\p{Z}]"
_E = r"[^\s\x0b\x1c-\x1f\x{85}\p{Z}.,;]"
_SP = "".join("\\" + c for c in shapes.PUNCT)


def _or(cls: str) -> str:
    return cls


SHAPES = "|".join([
    rf"(?i:https?://(?:dx\.)?doi\.org/10\.\d{{4,9}}/(?:{_N}*{_E})?|doi:{_W}*10\.\d{{4,9}}/(?:{_N}*{_E})?)", rf"\b10\.\d{{4,9}}/(?:{_N}*{_E})?",
    rf"(?i:https?://(?:{_N}*{_E})?)", rf"(?i:www\.{_N}*{_E})", r"\((?:19|20)\d\d[a-z]?\)", r"\b\d+\(\d+\)\b", rf"\b\d{{1,4}}{_W}*-{_W}*\d{{1,4}}\b",
    rf"(?:[A-Za-z]\.{_W}*){{1,4}}", rf"(?i:\bet{_W}+al\.)", rf"{_W}+", r"[A-Za-z]+[0-9][A-Za-z0-9]*|[0-9]+[A-Za-z][A-Za-z0-9]*", "[A-Za-z]+", r"\p{Nd}+",
    *("\\" + c + "+" for c in shapes.PUNCT), rf"[{shapes.ODD_DIGITS}][\p{{Nd}}{shapes.ODD_DIGITS}]*", r"\p{L}+", rf"\p{{C}}[{WS}\p{{C}}]*",
    r"[^\p{L}\p{N}\p{M}\p{Z}\p{C}\p{S}" + _SP + "]+", r"[^\p{L}\p{N}\p{M}\p{Z}\p{C}\p{P}" + _SP + "]+", r"[^\p{L}\p{P}\p{S}\p{Z}\p{C}\p{Nd}" + shapes.ODD_DIGITS + "]+"]).replace("'", "''")


def token(p: str) -> str:
    """Name of a piece."""
    punct = " ".join(f"WHEN starts_with({p}, {q(c)}) THEN '{n}'" for c, n in shapes.PUNCT_NAME.items())
    return rf"""CASE WHEN regexp_matches({p}, '^(?i:https?://(?:dx\.)?doi\.org/10\.\d{{4,9}}/|doi:|10\.\d{{4,9}}/)') THEN 'APA_DOI'
 WHEN regexp_matches({p}, '^(?i:https?://|www\.)') THEN 'APA_URL'
 WHEN regexp_full_match({p}, '\((?:19|20)\d\d[a-z]?\)') THEN 'APA_YEAR_PAREN' WHEN regexp_full_match({p}, '\d+\(\d+\)') THEN 'APA_VOL_ISSUE'
 WHEN regexp_full_match({p}, '\d{{1,4}}{_W}*-{_W}*\d{{1,4}}') THEN 'APA_PAGE_RANGE' WHEN regexp_full_match({p}, '([A-Za-z]\.{_W}*)+') THEN 'APA_INITIALS'
 WHEN regexp_full_match({p}, '(?i:et{_W}+al\.)') THEN 'APA_ETAL' WHEN regexp_matches({p}, '^{_W}') THEN 'SPACE'
 WHEN regexp_full_match({p}, '[A-Za-z]+') THEN CASE WHEN length({p}) = 1 THEN 'ALPHA_1' WHEN length({p}) < 5 THEN 'ALPHA_2_4' WHEN length({p}) < 10 THEN 'ALPHA_5_9' ELSE 'ALPHA_10P' END
 WHEN regexp_full_match({p}, '\p{{Nd}}+') THEN CASE WHEN length({p}) = 1 THEN 'DIGIT_1' WHEN length({p}) < 4 THEN 'DIGIT_2_3' ELSE 'DIGIT_4P' END
 WHEN regexp_full_match({p}, '[A-Za-z0-9]+') THEN CASE WHEN length({p}) < 5 THEN 'ALNUM_2_4' ELSE 'ALNUM_5P' END
 {punct} ELSE {char(f"substr({p}, 1, 1)")} END"""


def char(c: str) -> str:
    names = " ".join(f"WHEN {c} = {q(x)} THEN '{n}'" for x, n in shapes.PUNCT_NAME.items())
    return rf"""CASE {names} WHEN regexp_matches({c}, '^[{WS}]') THEN 'SPACE' WHEN regexp_matches({c}, '^[\p{{Nd}}{shapes.ODD_DIGITS}]') THEN 'DIGIT_1'
 WHEN regexp_matches({c}, '^\p{{L}}') THEN 'ALPHA_1' WHEN regexp_matches({c}, '^\p{{C}}') THEN 'SPACE' WHEN regexp_matches({c}, '^\p{{P}}') THEN 'OTHER_PUNCT'
 WHEN regexp_matches({c}, '^\p{{S}}') THEN 'OTHER_SYMBOL' ELSE '[UNK]' END"""


def unit(seed, key: str, slot: str) -> str:
    """slot: SQL text expression."""
    return f"(('0x' || substr(md5('{seed}:' || ({key})::VARCHAR || ':' || {slot}), 1, 8))::BIGINT / 4294967296.0)"


def pick(seed, key: str, slot: str, n: str) -> str:
    return f"floor({unit(seed, key, slot)} * ({n}))::BIGINT"


WORD = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
