"""Trainers, external scorers, supervised sets and limits."""

import json

import pytest
from pyspark.sql import functions as F

from spanlab.operators import chunks, scoring, spans, synth
from spanlab.plans import extract, train
from spanlab.sources import readers


def test_model_tokens():
    assert chunks.model_tokens() == 512 and chunks.model_tokens(1024) == 1024 and chunks.model_tokens(1024, 300) == 300
    assert chunks.model_tokens(0, 10**30) == 512 and chunks.model_tokens(-1, 77, 9) == 77


def test_labelled_merges_spans(spark):
    """Overlapping and touching spans are one, and spans end with the text."""
    rows = [(1, "alpha beta gamma", [(0, 5), (3, 7), (7, 10)]), (2, "one two", [(4, 99), (-5, 3)]), (3, "none", []), (4, "", [(0, 1)])]
    df = spark.createDataFrame(rows, "key bigint, text string, spans array<struct<start:bigint,end:bigint>>")
    got = {r.doc_id: r.l for r in train.labelled(df).groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "label"))), lambda x: x["label"]).alias("l")).collect()}
    assert got == {1: [1, 2, 2, 0, 0], 2: [1, 0, 1], 3: [0]}
    full = {r.key: r for r in train.example_rows(df).collect()}
    assert [(full[k].insert_start, full[k].insert_end, full[k].inserted_value) for k in (1, 2, 3, 4)] == [(0, 3, "alpha beta"), (0, 3, "one ||| two"), (-1, -1, ""), (-1, -1, "")]
    assert full[1].abstract_tokens == ["ALPHA_5_9", "SPACE", "ALPHA_2_4", "SPACE", "ALPHA_5_9"] and full[4].labels == []


def test_external_scorer(spark):
    docs = spark.createDataFrame([(1, "see (2001) now"), (2, "plain"), (3, ""), (4, "a (1999) " * 5)], "doc_id bigint, text string")

    def make():
        import numpy as np

        def predict(ids):
            ids = np.asarray(ids)
            hit = (ids == 7).astype(np.float32)  # the id of a year in brackets
            return np.stack([1 - hit, hit, np.zeros_like(hit)], 2).reshape(len(ids), -1)

        return predict

    found = extract.boundaries(docs, scoring.BatchScorer(make, limit=8), limit=100).collect()
    assert sorted((r.doc_id, r.start, r.end, r.value) for r in found) == [(1, 4, 10, "(2001)"), (4, 2, 8, "(1999)"), (4, 11, 17, "(1999)")]


def test_word_trainer(spark):
    rows = [(i, ["Read", "the", "Smith", ",", "2001", "now", "or", "later"], [0, 0, 1, 2, 3, 0, 0, 0]) for i in range(40)]
    rows += [(100 + i, ["Some", "plain", "words", "here"], [0, 0, 0, 0]) for i in range(20)]
    scorer, facts = train.train_words(spark.createDataFrame(rows, "key bigint, tokens array<string>, ner_tags array<int>"))
    assert facts["accuracy"] > 0.95 and facts["loss"] < 0.3
    df = spark.createDataFrame([(1, 0, "ALPHA_2_4"), (1, 1, "DIGIT_4P")], "doc_id bigint, pos int, token string")
    assert all(r.p_o + r.p_b + r.p_i + r.p_e == pytest.approx(1) for r in scorer.transform(df).collect())


def test_supervised_sets(spark, tmp_path):
    item = lambda i: {"text": f"text {i}", "spans": [[0, 4]]}
    (tmp_path / "a.json").write_text(json.dumps([item(i) for i in range(100)]))
    (tmp_path / "b.json").write_text(json.dumps({"train": [item(200)], "eval": [item(201), {"no": 1}]}))
    rows = readers.read_supervised(spark, str(tmp_path)).collect()
    part = {r.text: r.is_train for r in rows}
    assert len(rows) == 102 and part["text 200"] and not part["text 201"] and sum(part.values()) == 86
    df = spark.createDataFrame([(r.key, r.text, [(s.start, s.end) for s in r.spans]) for r in rows[:5]], "key string, text string, spans array<struct<start:bigint,end:bigint>>")
    assert train.example_rows(df).where("insert_start = 0").count() == 5


def test_shuffled(spark):
    run = lambda seed: [r.id for r in synth.shuffled(spark.range(50).repartition(3), "id", seed).collect()]
    assert run(1) == run(1) != run(2) and sorted(run(1)) == list(range(50))
