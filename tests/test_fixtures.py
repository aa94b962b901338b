"""Operators against expectations written by hand."""

import pytest
from pyspark.sql import functions as F

from spanlab.functions import chars, predicates, shapes
from spanlab.operators import chunks, lines, spans, synth, words
from spanlab.plans import extract
from spanlab.sources import readers


def values(spark, rows, f):
    return [r[1] for r in spark.createDataFrame(list(enumerate(rows)), "i int, x string").select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


TOKENS = {
    "": [],
    "Smith, J. A. (2019).": [("ALPHA_5_9", 0, 5), ("COMMA", 5, 6), ("SPACE", 6, 7), ("APA_INITIALS", 7, 13), ("APA_YEAR_PAREN", 13, 19), ("PERIOD", 19, 20)],
    "12(3), 45": [("DIGIT_2_3", 0, 2), ("LPAREN", 2, 3), ("DIGIT_1", 3, 4), ("RPAREN", 4, 5), ("COMMA", 5, 6), ("SPACE", 6, 7), ("DIGIT_2_3", 7, 9)],
    "12(3)x": [("APA_VOL_ISSUE", 0, 5), ("ALPHA_1", 5, 6)],
    "123–145": [("APA_PAGE_RANGE", 0, 7)],
    "12345-6": [("DIGIT_4P", 0, 5), ("DASH", 5, 6), ("DIGIT_1", 6, 7)],
    "see https://doi.org/10.1037/a0012345.": [("ALPHA_2_4", 0, 3), ("SPACE", 3, 4), ("APA_DOI", 4, 36), ("PERIOD", 36, 37)],
    "10.1234/abc": [("APA_DOI", 0, 11)],
    "www...": [("APA_URL", 0, 3), ("PERIOD", 3, 6)],
    "www at": [("ALPHA_2_4", 0, 3), ("SPACE", 3, 4), ("ALPHA_2_4", 4, 6)],
    "et al.": [("APA_ETAL", 0, 6)],
    "a.b.c.": [("APA_INITIALS", 0, 6)],
    "(2019, May)": [("LPAREN", 0, 1), ("DIGIT_4P", 1, 5), ("COMMA", 5, 6), ("SPACE", 6, 7), ("ALPHA_2_4", 7, 10), ("RPAREN", 10, 11)],
    "Gärtner": [("ALPHA_1", 0, 1), ("ALPHA_1", 1, 7)],
    "x²": [("ALPHA_1", 0, 1), ("DIGIT_1", 1, 2)],
    "½": [("[UNK]", 0, 1)],
    "…": [("PERIOD", 0, 1)],
    "...": [("PERIOD", 0, 3)],
}


def test_shape_tokens(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TOKENS)], "doc_id bigint, text string")
    got = {i: [] for i in range(len(TOKENS))}
    for r in spans.token_spans(docs).orderBy("doc_id", "pos").collect():
        got[r.doc_id].append((r.token, r.start, r.end))
    assert list(got.values()) == list(TOKENS.values())


def test_vocabulary_has_53_names():
    assert len(shapes.VOCAB) == 53 and shapes.VOCAB[21] == "SPACE" and shapes.VOCAB[52] == "OTHER_SYMBOL"


LINES = {
    "Publications:": (True, False, False), "SMITH, J. (2019).": (True, False, False), "2019": (False, False, False), "Selected works:": (True, False, False),
    "36. Skadberg, R. M., Title": (False, True, True), "70)Wang, Z., Title": (False, False, False), "Smith, J. (2019). Title": (False, False, True),
    "Smith, J. (2019, May). Title": (False, False, True), "van der Berg, J. (2019). Title": (False, False, False),
}


def test_line_predicates(spark):
    for k, f in enumerate((predicates.is_header, predicates.is_numbered_start, predicates.is_reference_start)):
        assert values(spark, LINES, f) == [x[k] for x in LINES.values()]


def test_cleaning_and_apa(spark):
    assert values(spark, ["Smith, J. (2019). Paper presented at SIOP, Boston 2019", "AWARDS\nx"], predicates.clean_candidate) == ["Smith, J. (2019). Paper presented at SIOP,", ""]
    assert values(spark, ["Smith, J. A. (2019). Stress at work. Journal of X, 12(3), 45-67.", "Outstanding Reviewer Award, Smith, J. (2019). Journal of X", "", None],
                  predicates.is_apa) == [True, False, False, False]


def span_rows(spark, rows, **extra):
    return spark.createDataFrame([(1, a, b) for a, b in rows], "doc_id bigint, start bigint, end bigint").withColumns({k: F.lit(v) for k, v in extra.items()})


def test_merge_overlapping(spark):
    got = spans.merge_overlapping(span_rows(spark, [(5, 10), (10, 12), (20, 20), (-3, 2), (95, 200)], text_len=100)).orderBy("idx").collect()
    assert [(r.start, r.end) for r in got] == [(0, 2), (5, 12), (95, 100)]


@pytest.mark.parametrize("text,want", [("ab, cd", [(0, 6)]), ("ab\n\ncd", [(0, 2), (4, 6)])])
def test_merge_adjacent(spark, text, want):
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    got = spans.merge_adjacent(span_rows(spark, [(0, 2), (4, 6)]), docs).orderBy("start").collect()
    assert [(r.start, r.end) for r in got] == want and all(r.value == text[r.start:r.end] for r in got)


def test_overlap_ratio(spark):
    rows = spark.createDataFrame([(0, 10, 5, 15), (0, 10, 2, 4), (0, 5, 5, 9)], "a int, b int, c int, d int")
    assert [r[0] for r in rows.select(spans.overlap_ratio(*[F.col(c) for c in "abcd"])).collect()] == [0.5, 1.0, 0.0]


def test_dedupe_and_again(spark):
    rows = spark.createDataFrame([(1, 0, 10, "a b"), (1, 1, 12, "a  b c"), (1, 20, 30, "q"), (1, 40, 50, "q"), (1, 60, 70, " ")], "doc_id bigint, start bigint, end bigint, value string")
    once = spans.dedupe(rows)
    want = [(1, 12, "a  b c"), (20, 30, "q")]
    assert [(r.start, r.end, r.value) for r in once.orderBy("start").collect()] == want
    assert [(r.start, r.end, r.value) for r in spans.dedupe(once).orderBy("start").collect()] == want


def test_decode(spark):
    rows = spark.createDataFrame([(1, i, i * 2, i * 2 + 1, x) for i, x in enumerate([0, 1, 2, 0, 2, 1, 1])], "doc_id bigint, pos int, start bigint, end bigint, label int")
    assert [(r.first_pos, r.start, r.end) for r in spans.decode(rows).orderBy("first_pos").collect()] == [(1, 2, 5), (5, 10, 11), (6, 12, 13)]


def test_word_labels(spark):
    df = spark.range(1)
    tags = lambda n: df.select(words.bioe(F.array(*[F.lit("w")] * n))).first()[0]
    assert (tags(1), tags(2), tags(4)) == ([1], [1, 3], [1, 2, 2, 3])
    ids = F.array(*[F.lit(x).cast("int") for x in (None, 0, 0, 1, None)])
    assert df.select(ids.alias("i"), F.array(F.lit(1), F.lit(3)).alias("t")).select(words.align_subwords(F.col("i"), F.col("t"))).first()[0] == [-100, 1, -100, 3, -100]


def test_chunks(spark):
    size, stride = chunks.limits()
    got = chunks.plan(spark.createDataFrame([(1, 1000), (2, 0)], "doc_id bigint, n_tokens bigint"), size, stride).orderBy("chunk").collect()
    assert [(r.first, r.last) for r in got] == [(0, 448), (320, 768), (640, 1000)]
    for bad in ({"overlap": 500}, {"overlap": -1}, {"size": 0}):
        with pytest.raises(ValueError):
            chunks.limits(**bad)


def test_split_rounds_half_to_even(spark):
    got = synth.split(spark.range(10), "id", 42)
    assert got.where("is_train").count() == 8 and got.count() == 10


def test_supervised_json(spark):
    raw = spark.createDataFrame([('[{"text":"","passage":"abc"},{"text":"ab","boundaries":null,"spans":[[0,1]]},{"passage":"xyz","spans":[[0,1],{"start":1,"end":2},[3]]},7]',), ("no json",), (None,)], "json string")
    got = readers.normalise(readers.items(raw)).collect()
    assert sorted((r.text, [(s.start, s.end) for s in r.spans]) for r in got) == [("ab", []), ("xyz", [(0, 1), (1, 2)])]


def test_perturb_keeps_empty_and_repeats(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["", None, "Smith, J. (2019). Title"] * 5)], "i int, x string")
    run = lambda: [r[0] for r in df.select(synth.perturb(F.col("x"), 3, F.col("i"))).collect()]
    a = run()
    assert a == run() and a[0] == "" and a[1] is None and any(x != "Smith, J. (2019). Title" for x in a[2::3])


def test_bibliography_and_paragraphs(spark):
    text = "intro\nPublications:\n1. Smith, J. (2019). A\n more\nSmith, J. (2019). B\n2) Wang, Z., C\nAWARDS\nx\n"
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None)], "doc_id bigint, text string")
    got = lines.bibliography(docs).orderBy("start").collect()
    assert [r.value for r in got] == ["1. Smith, J. (2019). A\n more\nSmith, J. (2019). B", "2) Wang, Z., C"]
    assert all(text[r.start:r.end] == r.value for r in got)
    two = " a \n \n\n b\n\n"
    got = lines.paragraphs(spark.createDataFrame([(1, two)], "doc_id bigint, text string")).orderBy("start").collect()
    assert [(r.value, two[r.start:r.end]) for r in got] == [("a", "a"), ("b", "b")]


def test_one_window_equals_no_window(spark):
    text = "Publications:\n1. Smith, J. A. (2019). Stress at work. Journal of X, 12(3), 45-67.\n2. Wang, Z. (2018). Sleep. Review, 1(2), 3-9.\n"
    docs = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    key = lambda d: sorted((r.start, r.end, r.value) for r in d.collect())
    small = key(extract.extract(docs))
    assert len(small) == 2 and key(extract.extract_large(docs)) == small


def test_strip_knows_python_white_space(spark):
    odd = "\x1c  a b \x85　"
    assert values(spark, [odd], chars.strip) == [odd.strip()]


def test_streaming_encode(spark, tmp_path):
    from spanlab.streaming.stateless import encode_stream

    spark.createDataFrame([(1, "a 1")], "doc_id bigint, text string").write.parquet(str(tmp_path / "in"))
    out = encode_stream(spark.readStream.schema("doc_id bigint, text string").parquet(str(tmp_path / "in")))
    run = out.writeStream.format("memory").queryName("encoded").option("checkpointLocation", str(tmp_path / "c")).start()
    run.processAllAvailable()
    run.stop()
    assert spark.table("encoded").collect()[0].input_ids == [12, 21, 16]
