"""Shape tokens: text as a sequence over 53 names, by one alternation regex in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chars import normalize_pdf_text

# Token names in id order.
VOCAB = (
    "[PAD] [UNK] [CLS] [SEP] [MASK] "
    "APA_DOI APA_URL APA_YEAR_PAREN APA_VOL_ISSUE APA_PAGE_RANGE APA_INITIALS APA_ETAL "
    "ALPHA_1 ALPHA_2_4 ALPHA_5_9 ALPHA_10P DIGIT_1 DIGIT_2_3 DIGIT_4P ALNUM_2_4 ALNUM_5P "
    "SPACE PERIOD COMMA COLON SEMICOLON DASH UNDERSCORE SLASH BACKSLASH PIPE PLUS STAR QUESTION EXCLAMATION AT HASH DOLLAR "
    "PERCENT AMPERSAND EQUALS QUOTE APOSTROPHE LPAREN RPAREN LBRACKET RBRACKET LBRACE RBRACE LANGLE RANGLE OTHER_PUNCT OTHER_SYMBOL"
).split()
# The characters of the names PERIOD to RANGLE, in order.
PUNCT = r""".,:;-_/\|+*?!@#$%&="'()[]{}<>"""
PUNCT_NAME = dict(zip(PUNCT, VOCAB[VOCAB.index("PERIOD"):]))
# Digits that are not decimal digits.
ODD_DIGITS = "²³¹⁰⁴-⁹₀-₉①-⑨⑴-⑼⒈-⒐⓪⓵-⓽⓿❶-❾➀-➈➊-➒"

_W, _N = r"[\s\x1c-\x1f]", r"[^\s\x1c-\x1f]"
_BODY = rf"(?={_N})(?:{_N}*[^\s\x1c-\x1f.,;])?"
_SPECIAL = "".join("\\" + c for c in PUNCT)
_RULES = [
    rf"(?i:https?://(?:dx\.)?doi\.org/10\.\d{{4,9}}/{_BODY})",
    rf"(?i:doi:{_W}*10\.\d{{4,9}}/{_BODY})",
    rf"\b10\.\d{{4,9}}/{_BODY}",
    rf"(?i:https?://{_BODY})",
    rf"(?i:www(?=\.{_N})(?:\.{_N}*[^\s\x1c-\x1f.,;])?)",
    r"\((?:19|20)\d{2}[a-z]?\)",
    r"\b\d+\(\d+\)\b",
    rf"\b\d{{1,4}}{_W}*-{_W}*\d{{1,4}}\b",
    rf"(?:[A-Za-z]\.{_W}*){{1,4}}",
    rf"(?i:\bet{_W}+al\.)",
    rf"{_W}+",
    r"(?=[A-Za-z0-9]*[A-Za-z])(?=[A-Za-z0-9]*\d)[A-Za-z0-9]+",
    r"[A-Za-z]+",
    r"\d+",
    *("\\" + c + "+" for c in PUNCT),
    rf"[{ODD_DIGITS}][\d{ODD_DIGITS}]*",
    r"\p{L}+",
    r"\p{C}[\s\x1c-\x1f\p{C}]*",
    rf"[\p{{P}}&&[^{_SPECIAL}]]+",
    rf"[\p{{S}}&&[^{_SPECIAL}]]+",
    rf"[\p{{M}}\p{{N}}&&[^\d{ODD_DIGITS}]]+",
    r"[\s\S]",
]
# What most pieces are, tried first: words that no other rule can begin at or reach, white space, single marks.
_PLAIN = [r"(?![eE][tT][^A-Za-z])[A-Za-z][A-Za-z]++(?![0-9.:\u017f])", r" (?![\s\x1c-\x1f])", r"[,;](?![,;])", r"\.(?!\.)", rf"{_W}+"]
PATTERN = "(?U)" + "|".join(_PLAIN + _RULES)


def alpha_bucket(n: Column) -> Column:
    return F.when(n <= 1, "ALPHA_1").when(n <= 4, "ALPHA_2_4").when(n <= 9, "ALPHA_5_9").otherwise("ALPHA_10P")


def digit_bucket(n: Column) -> Column:
    return F.when(n <= 1, "DIGIT_1").when(n <= 3, "DIGIT_2_3").otherwise("DIGIT_4P")


def alnum_bucket(n: Column) -> Column:
    return F.when(n <= 4, "ALNUM_2_4").otherwise("ALNUM_5P")


def char_class(ch: Column) -> Column:
    """Token of a single character."""
    c = normalize_pdf_text(ch)
    names = F.create_map(*[F.lit(x) for pair in PUNCT_NAME.items() for x in pair])
    return (F.when(c.isNull(), None).when(F.try_element_at(names, c).isNotNull(), F.try_element_at(names, c))
            .when(F.rlike(c, F.lit(rf"(?U)^{_W}$")), "SPACE")
            .when(F.rlike(c, F.lit(rf"(?U)^[\d{ODD_DIGITS}]$")), "DIGIT_1")
            .when(F.rlike(c, F.lit(r"^\p{L}$")), "ALPHA_1")
            .when(F.rlike(c, F.lit(r"^\p{C}$")), "SPACE")
            .when(F.rlike(c, F.lit(r"^\p{P}$")), "OTHER_PUNCT")
            .when(F.rlike(c, F.lit(r"^\p{S}$")), "OTHER_SYMBOL")
            .otherwise("[UNK]"))


def pieces(text: Column) -> Column:
    """Pieces of the normalised text that tile it, in order: array<string>.  Null or empty text: empty array."""
    return F.regexp_extract_all(normalize_pdf_text(F.coalesce(text, F.lit(""))), F.lit(PATTERN), F.lit(0))


CUT_URL = "www."


def marked_pieces(text: Column) -> Column:
    """pieces(), but a ``www`` that stands alone before a longer piece that begins with a dot is written ``www.``.

    So a piece alone tells its token (no piece is ``www.`` otherwise), and equal pieces can be classified once.
    """
    def mark(p: Column) -> Column:
        return F.transform(p, lambda x, i: F.when((F.lower(x) == "www") & F.coalesce(F.get(p, i + 1).startswith(".") & (F.length(F.get(p, i + 1)) > 1), F.lit(False)),
                                                  F.lit(CUT_URL)).otherwise(x))

    p = pieces(text)
    return F.when(F.coalesce(F.rlike(text, F.lit(r"(?i)www\.")), F.lit(False)), F.element_at(F.transform(F.array(p), mark), 1)).otherwise(p)


def piece_length(piece: Column) -> Column:
    """Characters of the text that a marked piece stands for."""
    return F.when(piece == CUT_URL, 3).otherwise(F.length(piece))


def is_year(piece: Column) -> Column:
    """Whether a piece is a year in brackets."""
    return piece.startswith("(") & F.rlike(piece, F.lit(r"(?U)^\((?:19|20)\d{2}[a-z]?\)$"))


def token_of(piece: Column) -> Column:
    """Name of a marked piece."""
    first, n = F.substring(piece, 1, 1), F.length(piece)
    names = F.create_map(*[F.lit(x) for pair in PUNCT_NAME.items() for x in pair])
    low = F.lower(piece)

    def is_(pattern: str) -> Column:
        return F.rlike(piece, F.lit("(?U)" + pattern))

    url = low.startswith("www.") | low.startswith("http://") | low.startswith("https://")
    word = is_(r"^[A-Za-z0-9]+$")
    digit, letter = is_(r"\d"), is_(r"[A-Za-z]")
    plain = (F.when(word & digit & letter, alnum_bucket(n)).when(word & letter, alpha_bucket(n)).when(is_(r"^\d+$"), digit_bucket(n))
             .when(F.try_element_at(names, first).isNotNull(), F.try_element_at(names, first)).otherwise(char_class(first)))
    marked = (F.when(is_(r"^(?i:https?://(?:dx\.)?doi\.org/10\.\d{4,9}/|doi:|10\.\d{4,9}/)"), "APA_DOI").when(url, "APA_URL")
              .when(is_(r"^\((?:19|20)\d{2}[a-z]?\)$"), "APA_YEAR_PAREN")
              .when(is_(r"^\d+\(\d+\)$"), "APA_VOL_ISSUE")
              .when(is_(rf"^\d{{1,4}}{_W}*-{_W}*\d{{1,4}}$"), "APA_PAGE_RANGE")
              .when(is_(rf"^(?:[A-Za-z]\.{_W}*){{1,4}}$"), "APA_INITIALS")
              .when(is_(rf"^(?i:et{_W}+al\.)$"), "APA_ETAL")
              .when(is_(rf"^{_W}"), "SPACE"))
    # plain words, numbers, years and single marks, most of all pieces, need few tests
    quick = (F.when(piece == " ", "SPACE").when(F.rlike(piece, F.lit("^[A-Za-z]+$")), alpha_bucket(n)).when(n == 1, F.try_element_at(names, piece))
             .when(F.rlike(piece, F.lit("^[0-9]+$")), digit_bucket(n)).when(is_year(piece), "APA_YEAR_PAREN"))
    return F.coalesce(quick, marked, plain)


def tokens(text: Column) -> Column:
    """Shape token names of a text: array<string>."""
    return F.transform(marked_pieces(text), token_of)


def histogram(docs: DataFrame, *by: str) -> DataFrame:
    """docs (text, by...) -> by..., token, n: pieces are counted first, so each distinct one is classified once."""
    pieces_of = docs.select(*by, F.explode(marked_pieces(F.col("text"))).alias("piece")).groupBy(*by, "piece").agg(F.count("*").alias("n"))
    return pieces_of.select(*by, token_of(F.col("piece")).alias("token"), "n").groupBy(*by, "token").agg(F.sum("n").alias("n"))


def encode(names: Column, max_length: int = 512) -> Column:
    """Token ids, unknown names as 1, cut off at max_length: array<int>."""
    ids = F.create_map(*[F.lit(x) for pair in ((t, i) for i, t in enumerate(VOCAB)) for x in pair])
    return F.transform(F.slice(names, 1, max_length), lambda t: F.coalesce(F.try_element_at(ids, t), F.lit(1)))


def encode_example(names: Column, labels: Column, max_length: int = 512) -> Column:
    """struct<input_ids, attention_mask, labels>: ids as encode() makes them, and labels cut off with them."""
    ids = encode(names, max_length)
    return F.struct(ids.alias("input_ids"), F.transform(ids, lambda _: F.lit(1)).alias("attention_mask"), F.slice(labels, 1, max_length).alias("labels"))
