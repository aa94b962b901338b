"""Word tokens, the sentence archive, and word-level labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.chars import collapse, let

# Fixed value: words, or single characters that are neither word nor white space.
WORD = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
# Label ids.
LABELS = {"O": 0, "B-REF": 1, "I-REF": 2, "E-REF": 3}


def word_tokens(text: Column) -> Column:
    """array<string>; null text: empty array."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("(?U)" + WORD), F.lit(0))


def archive(docs: DataFrame, low: int = 8, high: int = 40) -> DataFrame:
    """doc_id, pos, line: sentences of low to high word tokens, joined by single spaces."""
    sentences = docs.select("doc_id", F.posexplode(F.split(collapse(F.col("text")), r"(?U)(?<=[.!?])\s+", -1)).alias("pos", "s"))
    words = sentences.select("doc_id", "pos", word_tokens(F.col("s")).alias("w"))
    return words.where(F.size("w").between(low, high)).select("doc_id", "pos", F.array_join("w", " ").alias("line"))


def bioe(words: Column) -> Column:
    """Tags of one inserted reference: B, I..., E (a single word: B)."""
    tag = lambda i, last: F.when(i == 0, LABELS["B-REF"]).when(i == last, LABELS["E-REF"]).otherwise(LABELS["I-REF"])
    return let(words, lambda w: let(F.size(w) - 1, lambda last: F.transform(w, lambda _, i: tag(i, last))))


def align_subwords(word_ids: Column, tags: Column) -> Column:
    """Label of each subword: its word's tag at the word's first subword, else -100 (word_ids: null for special tokens)."""
    def label(x: Column, word: Column, i: Column) -> Column:
        before = F.when(i > 0, F.try_element_at(x["ids"], i))
        return F.when(word.isNull() | F.coalesce(word == before, F.lit(False)), -100).otherwise(F.try_element_at(x["tags"], word + 1))

    return let(F.struct(word_ids.alias("ids"), tags.alias("tags")), lambda x: F.transform(x["ids"], lambda word, i: label(x, word, i)))
