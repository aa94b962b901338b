"""Every registered query of the subpackage and every pipeline stage, over a folder of small tables with odd rows."""

import collections
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from test_operators import SCHEMA, RANKS, corpus, kneser_ney, removed, shingle_groups

import __spark_entry__
import corpus_pipeline
from spanlab.llm import media, quality, queries

TOP = (1 << 63) - 1


def rows_of():
    """The corpus with unique ids, then odd rows: no id, an id with two texts, equal rows, a text with U+FFFD, shared passages in several bytes a character."""
    rows = [(i, t, lang, source, len(t) if t is not None else None) for i, (_, t, lang, source, _) in enumerate(corpus(40, 3))]
    passage = " ".join(f"größe{i} naïve" for i in range(12))
    more = [(500, f"é{passage}ü one end", "de", "s1"), (501, f"ß{passage}ö another �", "de", "s0"), (502, "ok � here", "en", "s0"),
            (None, rows[10][1], None, None), (None, rows[10][1], None, None), (None, None, None, None),
            (503, "first text of this id, quite unlike the other", "en", "s1"), (503, "completely different words under the same number", "en", "s1"),
            (504, "equal rows stay equal rows", "en", "s0"), (504, "equal rows stay equal rows", "en", "s0")]
    return rows + [(*r, len(r[1]) if r[1] is not None else None) for r in more]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    rng = random.Random(4)
    docs = rows_of()
    write = lambda df, name: df.write.parquet(f"{at}/{name}.parquet")
    write(spark.createDataFrame(docs, SCHEMA).repartition(3), "documents")
    marks = [(i, int(rng.random() < 0.7), int(rng.random() < 0.2)) for i in range(0, 30)] + [(None, 1, 0), (31, None, 1), (2, 0, 0)]
    write(spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int"), "labels")
    vec = np.random.default_rng(2).standard_normal((30, 8))
    vec[20:25] = vec[:5] * 2
    write(spark.createDataFrame([*[(i, v.tolist()) for i, v in enumerate(vec)], (90, None), (91, [0.0] * 8)], "vec_id bigint, embedding array<float>"), "embeddings")
    talk = [(c, t, ("user", "assistant")[t % 2], rng.choice(["hi", r"a </s> b <\/s>", "[INST]", "", None])) for c in range(8) for t in range(c % 4 + 1)]
    write(spark.createDataFrame([*talk, (3, 1, "assistant", "twice"), (3, 1, "assistant", "twice")], "conv_id bigint, turn bigint, role string, text string"), "conversations")
    return str(at)


def got(query, spark, folder):
    return __spark_entry__.queries()[query](spark, folder).collect()


def key(x):
    return (x is None, str(x))


def test_all_are_registered():
    names = __spark_entry__.queries()
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 11)}
    assert set(queries.QUERIES) | {"pipeline"} <= set(names) and [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_copies", "repeats", "mix", "tokens"]


def test_op1(spark, folder):
    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
    want = []
    for i, t, *_ in rows_of():
        ids = enc.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, got("op1_bpe", spark, folder)), key=str) == sorted(want, key=str)


def test_op2(spark, folder):
    want = [(None if i == TOP else i, *x) for i, *x in removed([(TOP if i is None else i, (t or "").encode()) for i, t, *_ in rows_of()])]
    assert sorted((tuple(r)[:5] for r in got("op2_suffix", spark, folder)), key=str) == sorted(want, key=str)


def test_op3(spark, folder):
    want = sorted(kneser_ney([(TOP if i is None else i, t) for i, t, *_ in rows_of()]))
    rows = sorted((TOP if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got("op3_lm", spark, folder))
    assert [r[:5] for r in rows] == [w[:5] for w in want]
    assert [r[5:] for r in rows] == [pytest.approx(w[5:], rel=1e-9) for w in want]


def test_op4(spark, folder):
    rows = got("op4_mix", spark, folder)
    assert len(rows) == len(rows_of())
    by = collections.defaultdict(list)
    for r in rows:
        by[r.source].append(r)
        assert 0 <= r.taken <= 3 * r.size
    for own in by.values():
        assert own[0].source_size == sum(r.size for r in own) and abs(sum(r.taken for r in own) - own[0].target) <= max(r.size for r in own)


def test_op5(spark, folder):
    want = []
    for i, t, *_ in rows_of():
        data = (t or "").encode()
        payload = data + b" " * (-len(data) % 192 if data else 192)
        png = media.to_png(payload)
        want.append((i, len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(png), hashlib.sha256(png).hexdigest(), media.feature(payload)))
    assert sorted((tuple(r)[:8] for r in got("op5_media", spark, folder)), key=str) == sorted(want, key=str)


def groups_by_row(rows):
    """(doc_id, shingles, least doc_id of the group) of each row, and its group number, rows being documents of their own."""
    found = shingle_groups([(n, t) for n, (_, t) in enumerate(rows)])
    least = {}
    for n, _, g in found:
        if rows[n][0] is not None:
            least[g] = min(least.get(g, TOP), rows[n][0])
    return [(rows[n][0], s, least.get(g, rows[n][0])) for n, s, g in found], [g for _, _, g in found]


def test_op6(spark, folder):
    want, _ = groups_by_row([r[:2] for r in rows_of()])
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got("op6_jaccard", spark, folder)), key=str) == sorted(want, key=str)


def test_op7(spark, folder):
    rows = got("op7_quality", spark, folder)
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    line = min((r.key for r in rows if r.kept), default=0)
    assert len(rows) == docs.count() and all(r.kept == (r.key >= line) for r in rows)
    kept = sorted((tuple(r) for r in quality.resample(docs, labels).collect()), key=str)
    assert collections.Counter(r[0] for r in kept) == collections.Counter(r.doc_id for r in rows if r.kept)
    assert not collections.Counter(kept) - collections.Counter(rows_of())


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, folder, name):
    import duckdb

    con = duckdb.connect()
    for t in ("embeddings", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    want = con.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    rows = __spark_entry__.queries()[name](spark, folder).select(*columns).collect()
    assert sorted(map(tuple, rows), key=str) == sorted(want.fetchall(), key=str)


def test_op10(spark, folder):
    rows = got("op10_language", spark, folder)
    known = {r[2] for r in rows_of() if r[1] is not None and r[2] is not None and r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5}
    assert len(rows) == len(rows_of())
    texts = collections.Counter((r[0], r[1] is None or not any(c.isalpha() for c in r[1])) for r in rows_of())
    assert collections.Counter((r.doc_id, r.lang_pred == "und") for r in rows) == texts
    assert all(0 <= r.score <= 1 and r.lang_pred in known | {"und"} for r in rows)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


def test_stages(spark, folder):
    """Each stage on what the one before kept, against brute force, and the whole run."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    first = corpus_pipeline.keep_quality(spark, docs, folder)
    assert first.columns == docs.columns and first.schema == docs.schema

    second = corpus_pipeline.drop_near_copies(spark, docs, folder)
    rows = [tuple(r) for r in docs.collect()]
    _, group = groups_by_row([r[:2] for r in rows])
    best = {}
    for r, g in zip(rows, group):
        best[g] = min([best.get(g, r), r], key=lambda r: (r[0] is None, r[0] or 0))
    # of rows that tie for the least id of a group, either may stay
    assert sorted((tuple(r)[:2] for r in second.collect()), key=str) == sorted((r[:2] for r in best.values()), key=str)

    third = corpus_pipeline.cut_repeats(spark, docs, folder)
    assert third.columns == docs.columns and third.count() == docs.count()
    kept = {}
    data = [((TOP if r[0] is None else r[0]), (r[1] or "").encode()) for r in rows]
    seen = {}
    for i, t in data:
        for a in range(len(t) - 49):
            seen[t[a:a + 50]] = min(seen.get(t[a:a + 50], TOP), i)
    want = []
    for (i, t), r in zip(data, rows):
        gone = np.zeros(len(t) + 1, bool)
        for a in range(len(t) - 49):
            if seen[t[a:a + 50]] < i:
                gone[a:a + 50] = True
        at = 0
        text = ""
        for c in t.decode():  # a character stays if all of its bytes do
            n = len(c.encode())
            text += "" if gone[at:at + n].any() else c
            at += n
        want.append((r[0], None if r[1] is None else text, *r[2:4], None if r[1] is None else len(text)))
    assert sorted(map(tuple, third.collect()), key=str) == sorted(want, key=str)
    assert any(r[1] != w[1] and "�" in (w[1] or "") for r, w in zip(rows, want)) and any(w[1] == "ok � here" for w in want)

    fourth = corpus_pipeline.mix_sources(spark, docs, folder)
    assert fourth.columns == docs.columns and max(collections.Counter(map(tuple, fourth.collect())).values()) <= 6
    assert not {tuple(r) for r in fourth.collect()} - set(rows)

    whole = corpus_pipeline.run(spark, folder)
    assert {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(whole.columns) and 0 < whole.count() <= 3 * len(rows)


def test_stages_of_nothing(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where(F.lit(False))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0
