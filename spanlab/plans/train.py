"""Training plan: synthetic and supervised examples to a token scorer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.chars import slice_text
from ..functions.shapes import token_of
from ..operators import arrays, scoring, synth


def labelled(examples: DataFrame) -> DataFrame:
    """(key, text, spans) -> tokens with labels, keyed by doc_id.  Spans are clamped to the text, sorted and merged where they overlap or touch."""
    rows = _labels(examples, "start", "end", "span_idx", "label").select(F.col("key").alias("doc_id"), F.posexplode(F.arrays_zip("pieces", "l.start", "l.end", "l.span_idx", "l.label")).alias("pos", "x"))
    return rows.select("doc_id", "pos", token_of(F.col("x.pieces")).alias("token"), "x.start", "x.end", "x.span_idx", "x.label")


def _labels(examples: DataFrame, *want: str) -> DataFrame:
    """examples plus pieces, lens and l, what is wanted as arrays.labelled() makes it; pieces and lens that are there stay."""
    rows = examples if "lens" in examples.columns else arrays.tokenized(examples)
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return rows.withColumn("l", arrays.labelled(F.col("lens"), F.coalesce(arrays.clamped(F.col("spans"), F.length("text").cast("bigint")), none), *want))


def example_rows(examples: DataFrame) -> DataFrame:
    """(key, text, spans) -> key, raw_text, abstract_tokens, labels, insert_start, insert_end, inserted_value, insert_spans.

    insert_start and insert_end are token places, -1 without a span; inserted_value joins the texts of the merged
    spans with ' ||| '.  An empty text has no tokens.
    """
    value = F.array_join(F.transform("l.spans", lambda x: slice_text(F.col("text"), x["start"], x["end"])), " ||| ")
    return _labels(examples, "spans", "label", "first", "last").select(
        "key", F.col("text").alias("raw_text"), F.transform("pieces", token_of).alias("abstract_tokens"), F.col("l.label").alias("labels"), F.col("l.first").alias("insert_start"),
        F.when(F.col("l.last") >= 0, F.col("l.last") + 1).otherwise(-1).alias("insert_end"), value.alias("inserted_value"), F.col("l.spans").alias("insert_spans"))


def train_words(examples: DataFrame, seed: int = 42, held: float = 0.1, reach: int = 3) -> tuple[scoring.MLScorer, dict[str, float]]:
    """(key, tokens, ner_tags) -> a scorer of words with p_o, p_b, p_i, p_e, and accuracy and loss on the held-out examples.

    A word is seen by its shape and those of its neighbours.
    """
    rows = synth.split(examples, "key", seed, held).select("key", "is_train", F.posexplode(F.arrays_zip("tokens", "ner_tags")).alias("pos", "x"))
    words = rows.select(F.col("key").alias("doc_id"), "is_train", "pos", token_of(F.col("x.tokens")).alias("token"), F.col("x.ner_tags").alias("label"))
    scorer = scoring.MLScorer(reach, names=("p_o", "p_b", "p_i", "p_e")).fit(words.where("is_train").drop("is_train"))
    return scorer, scoring.evaluate(scorer, words.where("not is_train").drop("is_train"))


def train(lines: DataFrame, targets: DataFrame, n: int, seed: int = 42, supervised: DataFrame | None = None, repeat: int = 1, reach: int = 3) -> scoring.MLScorer:
    """A scorer fitted on n synthetic examples and, if given, supervised ones (key, text, spans) each ``repeat`` times."""
    rows = labelled(synth.synthetic_set(lines, targets, n, seed))
    if supervised is not None:
        extra = synth.repeat(labelled(supervised), repeat)
        rows = rows.unionByName(extra.withColumn("doc_id", -(F.col("doc_id") * repeat + F.col("copy"))).drop("copy"))
    return scoring.MLScorer(reach).fit(rows)
