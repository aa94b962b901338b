"""Splitting documents (doc_id, text) into lines, paragraphs and bibliography candidates with exact offsets.

Running offsets are window sums by document, linear in its lines; the shuffle
carries each line once.  Null texts give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import WindowSpec
from pyspark.sql import functions as F

from ..functions.chars import WS, lstrip, rstrip, strip
from ..functions.predicates import line_kind, splitlines
from . import arrays


def _before() -> WindowSpec:
    return W.partitionBy("doc_id").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)


def _trimmed(blocks: DataFrame) -> DataFrame:
    """(doc_id, start, raw) -> (doc_id, start, end, value) without white space at the edges; blank ones go."""
    left = F.length("raw") - F.length(lstrip(F.col("raw")))
    value = strip(F.col("raw"))
    return blocks.select("doc_id", (F.col("start") + left).cast("bigint").alias("start"), value.alias("value")).where("value <> ''").select(
        "doc_id", "start", (F.col("start") + F.length("value")).cast("bigint").alias("end"), "value")


def lines(docs: DataFrame) -> DataFrame:
    """doc_id, pos, line (with its end), start."""
    rows = docs.select("doc_id", F.posexplode(splitlines(F.col("text"))).alias("pos", "line"))
    return rows.withColumn("start", F.coalesce(F.sum(F.length("line")).over(_before()), F.lit(0)))


def paragraphs(docs: DataFrame) -> DataFrame:
    """Blocks between blank lines."""
    gap = rf"(?U)\n[{WS}]*\n+"
    both = F.arrays_zip(F.split("text", gap, -1).alias("raw"), F.regexp_extract_all("text", F.lit(gap), F.lit(0)).alias("gap"))
    rows = docs.where("text is not null").select("doc_id", F.posexplode(both).alias("pos", "x")).select("doc_id", "pos", "x.raw", "x.gap")
    width = F.length("raw") + F.coalesce(F.length("gap"), F.lit(0))
    return _trimmed(rows.withColumn("start", F.coalesce(F.sum(width).over(_before()), F.lit(0))))


def with_blocks(docs: DataFrame) -> DataFrame:
    """docs (text, ...) plus blocks, the bibliography's: array<struct<start,end,value>>."""
    rows = arrays.once(docs, "_lines", splitlines(F.col("text")))
    rows = arrays.once(rows, "_kinds", F.transform("_lines", line_kind))
    return rows.withColumn("blocks", arrays.references(F.col("text"), F.transform("_lines", F.length), F.col("_kinds"))).drop("_lines", "_kinds")


def bibliography(docs: DataFrame) -> DataFrame:
    """Candidate references: from a start line to the next start, header or end.

    A header is never a start; if a document has numbered starts, the others don't count.
    """
    return with_blocks(docs.select("doc_id", "text")).select("doc_id", F.explode("blocks").alias("b")).select("doc_id", "b.*")


def long_lines(docs: DataFrame, least: int = 20, most: int = 10_000) -> DataFrame:
    """The first ``most`` stripped lines of at least ``least`` characters, in order of doc_id and place."""
    rows = docs.select("doc_id", F.posexplode(splitlines(F.col("text"))).alias("pos", "line")).select("doc_id", "pos", strip(F.col("line")).alias("line"))
    return rows.where(F.length("line") >= least).orderBy("doc_id", "pos").limit(most)
