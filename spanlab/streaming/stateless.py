"""Stateless operators over streams: each works row by row, so no watermark is needed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import clean_candidate, is_apa
from ..functions.shapes import encode, tokens


def encode_stream(docs: DataFrame, max_length: int = 512) -> DataFrame:
    """(doc_id, text) stream -> doc_id, input_ids."""
    return docs.select("doc_id", encode(tokens(F.col("text")), max_length).alias("input_ids"))


def screen_stream(candidates: DataFrame) -> DataFrame:
    """(doc_id, value) stream -> cleaned APA-like candidates."""
    return candidates.withColumn("value", clean_candidate(F.col("value"))).where(is_apa(F.col("value")))
