"""Steps on arrays of a document's row: the plan brings nothing together again, and results are those of the operators on rows."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from spanlab import catalog
from spanlab.functions import chars
from spanlab.operators import arrays, spans, synth

DATA = Path("/root/testdata/sf0.001")
ONE_SHUFFLE = ["encoded_examples", "example_rows", "label_summary", "inserted_values", "merged_spans", "overlap_ratios", "projected_labels", "decoded_spans",
               "chunk_lines", "bibliography_candidates", "cleaned_candidates", "supervised_examples", "adjacent_spans", "predicted_boundaries"]
TWO_SHUFFLES = ["deduped_blocks", "extracted_blocks", "extracted_large"]


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
@pytest.mark.parametrize("name", ONE_SHUFFLE)
def test_one_shuffle(spark, name):
    """CVs are put together once; no join (which Spark could broadcast, taking its size for that of the orders), no window over rows of tokens."""
    plan = catalog.QUERIES[name](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan and "Window" not in plan


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
@pytest.mark.parametrize("name", TWO_SHUFFLES)
def test_two_shuffles(spark, name):
    """The second deals out what is found, to drop repeats."""
    plan = catalog.QUERIES[name](spark, str(DATA))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2 and "Join" not in plan and "Window" not in plan


def test_labels_as_on_rows(spark):
    """Overlapping, touching, empty and outer spans; empty and null texts; several documents in a batch."""
    rows = [(1, "alpha beta (1999) x", [(0, 3), (2, 7), (7, 9), (-5, 1), (16, 99)]), (2, "", [(0, 4)]), (3, None, [(0, 4)]), (4, "no span", []), (5, "aé (2001). www..x", [(1, 1), (3, 9), (11, 30)]), (6, "a b", [(0, 3)])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, raw array<struct<start:bigint,end:bigint>>").coalesce(1)
    marks = docs.select("doc_id", F.length("text").alias("text_len"), F.explode("raw").alias("s")).select("doc_id", "s.start", "s.end", "text_len").where("text_len is not null")
    merged, tokens = spans.merge_overlapping(marks), spans.token_spans(docs)
    old = spans.project(tokens, merged)
    own = arrays.tokenized(docs).withColumn("l", arrays.labelled(F.col("lens"), arrays.clamped(F.col("raw"), F.length("text").cast("bigint")), *arrays.LABELLED))
    got = own.select("doc_id", F.posexplode(F.arrays_zip("l.start", "l.end", "l.span_idx", "l.label")).alias("pos", "x")).select("doc_id", "pos", "x.*")
    key = lambda df, *c: sorted(tuple(-1 if v is None else v for v in r) for r in df.select(*c).collect())
    assert key(got, "doc_id", "pos", "start", "end", "span_idx", "label") == key(old, "doc_id", "pos", "start", "end", "span_idx", "label")
    assert key(own.where("text is not null").select("doc_id", F.posexplode("l.spans").alias("idx", "m")).select("doc_id", "idx", "m.*"), "doc_id", "idx", "start", "end") == key(merged, "doc_id", "idx", "start", "end")
    assert key(own.select("doc_id", F.explode(arrays.decoded(F.col("lens"), F.col("l.label"))).alias("d")).select("doc_id", "d.*"), "doc_id", "first_pos", "start", "end") == key(spans.decode(old), "doc_id", "first_pos", "start", "end")
    assert key(spans.summarise_arrays(own), "doc_id", "n_tokens", "insert_start", "insert_end") == key(spans.summarise(old), "doc_id", "n_tokens", "insert_start", "insert_end")


def test_decoded_odd_labels(spark):
    """A stray continuation is nothing, a null label closes, and nothing runs on into the next row."""
    rows = [(1, [2, 1, 2, 0, 2, 1]), (2, [2, 2, 1]), (3, []), (4, [1, None, 2, 1, 1])]
    df = spark.createDataFrame(rows, "i int, label array<int>").coalesce(1).withColumn("lens", F.transform("label", lambda _: F.lit(2)))
    got = {r.i: [(x.first_pos, x.start, x.end) for x in r.d] for r in df.select("i", arrays.decoded(F.col("lens"), F.col("label")).alias("d")).collect()}
    assert got == {1: [(1, 2, 6), (5, 10, 12)], 2: [(2, 4, 6)], 3: [], 4: [(0, 0, 2), (3, 6, 8), (4, 8, 10)]}


def test_numbered_in_ranges(spark):
    """Rows are numbered in order of all columns, equal ones side by side, and no task sorts the whole list."""
    rows = [(i * 7919 % 300, f"t{i % 5}") for i in range(300)] + [(5, "same")] * 40 + [(None, "none")]
    df = spark.createDataFrame(rows, "k int, text string").repartition(3)
    got = synth.numbered(df)
    want = [t for _, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))]
    assert [tuple(r) for r in got.orderBy("tid").collect()] == list(enumerate(want)) and "SinglePartition" not in got._jdf.queryExecution().toString()
    assert synth.numbered(df.where("k > 1000")).count() == 0


def test_white_space_sets(spark):
    """Trimming and collapsing know the characters of (?U)\\s and \\x1c-\\x1f, and no others."""
    every = [chr(c) for c in range(1, 0x3100) if not 0xD800 <= c < 0xE000]
    df = spark.createDataFrame([(i, f"{c}a{c}b{c}") for i, c in enumerate(every)], "i int, t string")
    t = F.col("t")
    got = {r.i: tuple(r)[1:] for r in df.select("i", chars.strip(t), chars.lstrip(t), chars.rstrip(t), chars.collapse(t), F.rlike(F.substring(t, 1, 1), F.lit(rf"(?U)\A[{chars.WS}]\z"))).collect()}
    for i, c in enumerate(every):
        assert got[i] == (f"a{c}b", f"a{c}b{c}", f"{c}a{c}b", "a b", True) if c.isspace() else (*[f"{c}a{c}b{c}"] * 4, False)
