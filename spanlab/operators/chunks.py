"""Overlapping token windows over long documents, widened to whole lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import arrays


def model_tokens(positions: int | None = None, tokenizer_max: int | None = None, default: int = 512) -> int:
    """Tokens that a model takes: the least of its positions and its tokenizer's limit, as far as these are known.

    Limits below 1 and tokenizer limits of 100,000 and more stand for unknown.
    """
    known = [n for n, below in ((positions, None), (tokenizer_max, 100_000)) if isinstance(n, int) and n > 0 and (below is None or n < below)]
    return min(known, default=default)


def limits(model_tokens: int = 512, size: int | None = None, overlap: int = 128) -> tuple[int, int]:
    """Window size and stride; raises ValueError for arguments that make no window."""
    safe = max(64, model_tokens - 64)
    size = safe if size is None else min(size, safe)
    if size <= 0:
        raise ValueError("the window must hold a token")
    if overlap < 0:
        raise ValueError("the overlap can't be negative")
    if overlap >= size:
        raise ValueError("the overlap must be smaller than the window")
    return size, size - overlap


def plan(counts: DataFrame, size: int, stride: int) -> DataFrame:
    """(doc_id, n_tokens) -> doc_id, chunk, first, last (tokens [first, last)); the last window is the first that reaches the end."""
    n = F.col("n_tokens")
    windows = F.when(n <= size, 1).otherwise(F.ceil((n - size) / stride) + 1).cast("int")
    rows = counts.where("n_tokens > 0").select("doc_id", "n_tokens", F.explode(F.sequence(F.lit(0), windows - 1)).alias("chunk"))
    first = F.col("chunk") * stride
    return rows.select("doc_id", "chunk", first.cast("bigint").alias("first"), F.least(first + size, F.col("n_tokens")).cast("bigint").alias("last"))


def windows(docs: DataFrame, size: int, stride: int) -> DataFrame:
    """docs (doc_id, text) -> doc_id, chunk, start, end, text: plan() and widen() of each document's tokens, beside its text."""
    rows = arrays.tokenized(docs).select("doc_id", F.explode(arrays.widened(F.col("text"), F.col("lens"), size, stride)).alias("x"))
    return rows.select("doc_id", "x.*")


def widen(chunks: DataFrame, tokens: DataFrame, docs: DataFrame) -> DataFrame:
    """chunks of plan(), token_spans() and docs -> doc_id, chunk, start, end, text: windows widened to line ends; one window: the whole text."""
    # hints: no side is broadcast, whatever Spark takes its size for
    many = chunks.groupBy("doc_id").agg(F.max("chunk").alias("_m")).hint("merge")
    t = tokens.select("doc_id", F.col("pos").cast("bigint").alias("pos"), "start", "end")
    got = chunks.join(t.select("doc_id", F.col("pos").alias("first"), F.col("start").alias("s")).hint("merge"), ["doc_id", "first"]).join(
        t.select("doc_id", (F.col("pos") + 1).alias("last"), F.col("end").alias("e")).hint("merge"), ["doc_id", "last"])
    # a document's windows as one array beside its text, so the text moves once
    per = got.groupBy("doc_id").agg(F.collect_list(F.struct("chunk", "s", "e")).alias("w")).join(many, "doc_id").join(docs.select("doc_id", "text").hint("merge"), "doc_id")

    def lines(x: Column) -> Column:
        head = F.substr("text", F.lit(1), x["s"].cast("int"))
        start = F.when(F.col("_m") == 0, 0).otherwise(F.length(head) - F.length(F.substring_index(head, "\n", -1)))
        tail = F.substr("text", x["e"].cast("int") + 1, F.length("text"))
        nl = F.instr(tail, F.lit("\n"))
        end = F.when((F.col("_m") == 0) | (nl == 0), F.length("text")).otherwise(x["e"] + nl - 1)
        return F.struct(x["chunk"].alias("chunk"), start.cast("bigint").alias("start"), end.cast("bigint").alias("end"))

    def sliced(x: Column) -> Column:
        return F.struct(x["chunk"].alias("chunk"), x["start"].alias("start"), x["end"].alias("end"),
                        F.substr("text", (x["start"] + 1).cast("int"), (x["end"] - x["start"]).cast("int")).alias("text"))

    return per.select("doc_id", F.explode(F.transform(F.transform("w", lines), sliced)).alias("x")).select("doc_id", "x.*")
