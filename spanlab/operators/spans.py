"""Span algebra: merging, projection on tokens, decoding, overlap and dedupe.

Spans are rows (doc_id, start, end) with 0-based half-open offsets in code
points.  Everything is keyed by doc_id; documents never meet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.chars import collapse
from ..functions.shapes import marked_pieces, piece_length, token_of
from . import arrays

# Label ids.
O, B_INS, I_INS = 0, 1, 2  # noqa: E741


def merge_overlapping(spans: DataFrame) -> DataFrame:
    """(doc_id, start, end, text_len) -> doc_id, idx, start, end: clamped, sorted; overlapping and touching spans joined."""
    clamp = lambda c: F.greatest(F.lit(0), F.least(F.col(c), F.col("text_len"))).cast("bigint")
    rows = spans.select("doc_id", clamp("start").alias("start"), clamp("end").alias("end")).where("end > start")
    order = W.partitionBy("doc_id").orderBy("start", "end")
    far = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
    rows = rows.withColumn("new", F.when(F.col("start") <= far, 0).otherwise(1))
    island = F.sum("new").over(order.rowsBetween(W.unboundedPreceding, 0))
    return rows.withColumn("idx", (island - 1).cast("int")).groupBy("doc_id", "idx").agg(F.min("start").alias("start"), F.max("end").alias("end"))


def token_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id, pos, token, start, end: shape tokens that tile the text."""
    rows = docs.select("doc_id", F.posexplode(marked_pieces(F.col("text"))).alias("pos", "piece"))
    rows = rows.select("doc_id", "pos", token_of(F.col("piece")).alias("token"), piece_length(F.col("piece")).alias("n"))
    end = F.sum("n").over(W.partitionBy("doc_id").orderBy("pos").rowsBetween(W.unboundedPreceding, 0))
    return rows.select("doc_id", "pos", "token", (end - F.col("n")).alias("start"), end.alias("end"))


def project(tokens: DataFrame, spans: DataFrame) -> DataFrame:
    """tokens (doc_id, pos, token, start, end) and spans (doc_id, idx, start, end) -> tokens plus span_idx and label.

    spans of a document are disjoint and in order of idx (merge_overlapping makes them so).  A token belongs to
    the first span that it overlaps: the first that ends after the token's start, if it begins before its end.
    One sort of tokens and spans together finds it; nothing is joined.
    """
    ends = spans.select("doc_id", F.lit(None).cast("int").alias("pos"), F.lit(None).cast("string").alias("token"), F.lit(None).cast("bigint").alias("start"), F.lit(None).cast("bigint").alias("end"),
                        F.struct("idx", F.col("start").cast("bigint").alias("s")).alias("span"), F.col("end").cast("bigint").alias("at"))
    rows = tokens.select("doc_id", "pos", "token", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"),
                         F.lit(None).cast(ends.schema["span"].dataType).alias("span"), F.col("start").cast("bigint").alias("at")).unionByName(ends)
    back = W.partitionBy("doc_id").orderBy(F.col("at").desc(), F.col("span").isNotNull()).rowsBetween(W.unboundedPreceding, 0)
    near = rows.withColumn("near", F.last("span", ignorenulls=True).over(back)).where("span is null")
    rows = near.select("doc_id", "pos", "token", "start", "end", F.when(F.col("near.s") < F.col("end"), F.col("near.idx")).alias("span_idx"))
    before = F.lag("span_idx").over(W.partitionBy("doc_id").orderBy("pos"))
    label = F.when(F.col("span_idx").isNull(), O).when(before.isNull() | (before != F.col("span_idx")), B_INS).otherwise(I_INS)
    return rows.withColumn("label", label)


def decode(labelled: DataFrame) -> DataFrame:
    """(doc_id, pos, start, end, label) -> doc_id, first_pos, start, end: a B opens, I continues, all else closes; a stray I is nothing."""
    order = W.partitionBy("doc_id").orderBy("pos").rowsBetween(W.unboundedPreceding, 0)
    opens = F.sum((F.col("label") == B_INS).cast("int")).over(order)
    breaks = F.sum((F.coalesce(F.col("label"), F.lit(O)) == O).cast("int")).over(order)
    rows = labelled.select("doc_id", "pos", "start", "end", "label", opens.alias("opens"), breaks.alias("breaks"))
    own = F.min("breaks").over(W.partitionBy("doc_id", "opens"))
    held = rows.withColumn("own", own).where("opens > 0 and breaks = own and label <> 0")
    return held.groupBy("doc_id", "opens").agg(F.min("pos").alias("first_pos"), F.min("start").alias("start"), F.max("end").alias("end")).drop("opens")


def summarise(labelled: DataFrame) -> DataFrame:
    """doc_id, n_tokens, insert_start, insert_end (token places; -1 if there is no span)."""
    positive = F.col("label") > 0
    return labelled.groupBy("doc_id").agg(
        F.count("*").alias("n_tokens"), F.coalesce(F.min(F.when(positive, F.col("pos"))), F.lit(-1)).alias("insert_start"),
        F.coalesce(F.max(F.when(positive, F.col("pos"))) + 1, F.lit(-1)).alias("insert_end"))


def summarise_arrays(labelled: DataFrame) -> DataFrame:
    """summarise() of rows (doc_id, lens, l), l as arrays.labelled() makes it; documents without tokens go."""
    rows = labelled.select("doc_id", F.size("lens").cast("bigint").alias("n_tokens"), F.col("l.first").alias("insert_start"), (F.col("l.last") + F.when(F.col("l.last") >= 0, 1).otherwise(0)).alias("insert_end"))
    return rows.where("n_tokens > 0")


def overlap_ratio(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Intersection over the shorter length."""
    both = F.greatest(F.lit(0), F.least(a_end, b_end) - F.greatest(a_start, b_start))
    short = F.least(F.greatest(F.lit(1), a_end - a_start), F.greatest(F.lit(1), b_end - b_start))
    return F.when(both == 0, F.lit(0.0)).otherwise(both / short)


def merge_adjacent(spans: DataFrame, docs: DataFrame, max_gap: int = 2) -> DataFrame:
    """spans (doc_id, start, end) and docs (doc_id, text) -> doc_id, start, end, value.

    Joined: a gap of at most max_gap white space or ASCII punctuation characters without a blank line.
    The end is that of the last span, even if it lies inside the one before.
    """
    # a join that Spark doesn't broadcast, whatever it takes the texts' size for
    own = spans.groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("s")).hint("merge").join(docs.select("doc_id", "text").hint("merge"), "doc_id")
    return own.select("doc_id", F.explode(arrays.adjacent(F.col("text"), F.col("s"), max_gap)).alias("x")).select("doc_id", "x.*")


def drop_repeats(blocks: DataFrame) -> DataFrame:
    """One row of each (doc_id, start, end)."""
    return blocks.dropDuplicates(["doc_id", "start", "end"])


def longest(blocks: DataFrame) -> DataFrame:
    """The longest block of each document; the first wins ties."""
    order = W.partitionBy("doc_id").orderBy((F.col("start") - F.col("end")).asc(), "start", "end")
    return blocks.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def dedupe(blocks: DataFrame, least: float = 0.8) -> DataFrame:
    """doc_id, start, end, value: an ordered fold over each document's blocks.

    A block whose collapsed text is kept already goes; one that overlaps a kept
    block by ``least`` of the shorter replaces it if longer, else goes.
    """
    item = F.struct(F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"), "value", collapse(F.col("value")).alias("norm"))
    rows = blocks.where(collapse(F.col("value")) != "").groupBy("doc_id").agg(F.collect_list(item).alias("items"))

    return rows.select("doc_id", F.explode(arrays.deduped(F.col("items"), least)).alias("b")).select("doc_id", "b.*")
