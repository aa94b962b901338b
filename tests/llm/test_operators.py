"""The ten operators against brute force, round trips and held-out accuracy, with odd rows in every table."""

import collections
import hashlib
import itertools
import math
import random
import re
import tracemalloc
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from spanlab.llm import bpe, chat, embed, graph, jaccard, language, media, mixing, ngram, quality, shared, suffix

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
WORD = r"[^\x20\x09-\x0D]+"


def corpus(n=60, seed=1):
    """Prose with copies, near copies, shared passages, nulls, empty, short and very long texts, and repeated rows."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choice("abcdefgéß") for _ in range(rng.randint(1, 8))) for _ in range(300)]
    say = lambda k: " ".join(rng.choice(vocab) for _ in range(k))
    shared = say(40)
    texts = [say(rng.randint(1, 120)) for _ in range(n)]
    for i in range(5, n, 6):
        texts[i] = texts[i - 5]
    for i in range(4, n, 7):
        w = texts[i - 3].split(" ")
        w[len(w) // 2] = "changed"
        texts[i] = " ".join(w)
    for i in range(2, n, 9):
        texts[i] += "\n" + shared
    texts[0], texts[1], texts[2], texts[3] = None, "", " \t\n", "One"
    texts.append(say(20_000))
    texts.append("a" * 3000)
    rows = [(i * 3 % 101, t, ["en", "de", None][i % 3], ["s1", None, "é", "s0"][i % 4], None) for i, t in enumerate(texts)]
    return rows + [rows[10], (None, texts[10], None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    # an extra column whose name clashes with results
    return spark.createDataFrame(corpus(), SCHEMA).withColumn("n_tokens", F.lit("x")).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


RANKS = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def test_bpe_is_tiktoken(docs, nothing):
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
    out = bpe.encode(docs, RANKS, public_tokenizers.PATTERN, block_bytes=2000)
    got = bpe.decode(out, RANKS).collect()
    assert len(got) == docs.count()
    for r in got:
        text = r.text or ""
        assert r.ids == enc.encode_ordinary(text) and bytes(r.decoded) == text.encode()
        assert (r.n_tokens, r.ids_sha256) == (len(r.ids), hashlib.sha256(np.array(r.ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.encode(nothing, RANKS, public_tokenizers.PATTERN).count() == 0


def test_bpe_odd_texts():
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})
    tool = bpe.Codec(RANKS, public_tokenizers.PATTERN)
    rng = random.Random(3)
    texts = ["aaaaaaaaaaaaaaa", "日本語 😀😀", "x\x1cy \x1d z\x85\xa0\xa0w ½ ²³ ª ×÷", "ǅ ʰ ̀", "    \n\n\t x", "it's we'll I'd"]
    texts += ["".join(rng.choice("ab 'é\nɿʀß1²") for _ in range(200)) for _ in range(100)]
    split = [tool.split(t) for t in texts]
    words = sorted(tool.unknown(split))
    known = {w: np.array(ids, "<u4").tobytes() for w, ids in zip(words, tool.merge([w.encode() for w in words]))}
    for t, ids in zip(texts, tool.encode(split, known)):
        assert np.frombuffer(ids, "<u4").tolist() == enc.encode_ordinary(t) and tool.decode(ids) == t.encode()


def test_bpe_memory():
    """A block's words are strings for one text at a time: of 40 texts, no more than a few are held."""
    tool = bpe.Codec(RANKS, public_tokenizers.PATTERN)
    rng = random.Random(4)
    text = " ".join("".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 5))) for _ in range(5000))

    def most(run):
        tracemalloc.start()
        try:
            out = run()
            return tracemalloc.get_traced_memory()[1], out
        finally:
            tracemalloc.stop()

    one = most(lambda: tool.split(text))[0]
    assert most(lambda: tool.unknown(tool.split(text) for _ in range(40)))[0] < 4 * one
    new = {}
    size, half = most(lambda: [tool.halfway(tool.split(text), new) for _ in range(40)])
    assert size < 16 * one and new.keys() == tool.unknown([tool.split(text)])
    ids = {w: np.array(x, "<u4").tobytes() for w, x in zip(new, tool.merge([w.encode() for w in new]))}
    assert {tool.decode(tool.finish(h, ids)) for h in half} == {text.encode()}


def test_workers_give_memory_back(spark):
    """What a task had is not kept by its worker, and the next one gets small batches."""
    def fill(batches):
        for batch in batches:
            parts = [bytes(1000) for _ in range(300_000)]
            kept = parts[::3000]
            del parts
            yield batch
            del kept

    def held(batches):
        for batch in batches:
            rss = int(open("/proc/self/statm").read().split()[1]) >> 8
            yield media.pa.RecordBatch.from_pydict({"mb": media.pa.array([rss], media.pa.int64())})

    def rest():
        return max(r.mb for r in spark.range(64).repartition(8).mapInArrow(held, "mb bigint").collect())

    before = rest()
    spark.range(64).repartition(8).mapInArrow(shared.tidy(fill), "id bigint").count()
    assert rest() < before + 150
    with shared.small_batches(spark):
        rows = spark.range(64).coalesce(1).select(F.expr("cast(repeat('x', 1 << 20) as binary)").alias("x"))
        sizes = rows.mapInArrow(lambda bs: (media.pa.RecordBatch.from_pydict({"n": media.pa.array([b.num_rows], media.pa.int64())}) for b in bs), "n bigint").collect()
    assert max(r.n for r in sizes) <= 2 * shared.BATCH_BYTES >> 20 and sum(r.n for r in sizes) == 64


def test_two_stage_sort():
    rng = random.Random(5)
    for _ in range(150):
        w, letters = rng.choice([17, 20, 50]), rng.choice([b"ab", b"a", b"abc", bytes(range(256))])
        base = bytes(rng.choice(letters) for _ in range(rng.choice([60, 300])))
        pieces = [base[a:a + w + rng.randint(0, 40)] if rng.random() < 0.7 else bytes(rng.choice(letters) for _ in range(w + rng.randint(0, 30)))
                  for a in (rng.randint(0, len(base) - w) for _ in range(rng.randint(1, 12)))]
        ids = np.array([rng.randint(0, 6) for _ in pieces])
        first: dict[bytes, int] = {}
        for p, d in zip(pieces, ids):
            for i in range(len(p) - w + 1):
                first[p[i:i + w]] = min(first.get(p[i:i + w], 99), d)
        want = [[first[p[i:i + w]] < d for i in range(len(p) - w + 1)] for p, d in zip(pieces, ids)]
        assert [x.tolist() for x in suffix.earlier(pieces, ids, w)] == want


def test_suffix_rounds():
    """A bucket that is worked on in parts and rounds answers as one sort of it does."""
    rng = random.Random(6)
    for _ in range(40):
        base = bytes(rng.choice(b"abc") for _ in range(200))
        sent = []
        for _ in range(rng.randint(1, 5)):
            pieces = [base[a:a + 50 + rng.randint(0, 40)] for a in (rng.randint(0, 150) for _ in range(rng.randint(1, 9)))]
            sub = np.sort([rng.choice([3, 3, 255]) for _ in pieces])
            sent.append((pieces, np.array([rng.randint(0, 6) for _ in pieces]), sub))
        want: dict[int, dict[bytes, int]] = collections.defaultdict(dict)
        windows = lambda p: [p[i:i + 50] for i in range(len(p) - 49)]
        for pieces, ids, sub in sent:
            for p, d, s in zip(pieces, ids, sub):
                for x in windows(p):
                    want[s][x] = min(want[s].get(x, 99), d)
        got = suffix.answers([(suffix.B.pack_array(np.array([[len(p) for p in ps], ids, sub], np.int64)), suffix.B.squeeze(b"".join(ps))) for ps, ids, sub in sent], limit=rng.choice([1, 64, 300]))
        for (pieces, ids, sub), bits in zip(sent, got):
            flat = [want[s][x] < d for p, d, s in zip(pieces, ids, sub) for x in windows(p)]
            assert np.unpackbits(suffix.B.unpack_array(bits, np.uint8))[:len(flat)].astype(bool).tolist() == flat


def test_suffix_memory():
    """What a sort takes beside the pieces doesn't grow with the number of pieces around one hash."""
    rng = np.random.default_rng(7)
    pieces = [x.tobytes() for x in rng.integers(97, 123, (1 << 18, 84), np.uint8)]
    tracemalloc.start()
    try:
        hits = suffix.earlier(pieces, np.arange(len(pieces)))
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert not any(h.any() for h in hits) and most < 20 * 84 * len(pieces)


def test_suffix_buckets(spark, docs):
    """One partition of many blocks gets as many buckets as blocks, and small batches; the session's setting stays."""
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    before, seen, real = spark.conf.get(setting), [], suffix.B.labels
    with pytest.MonkeyPatch.context() as m:
        m.setattr(suffix.B, "labels", lambda parts: seen.append((parts, spark.conf.get(setting))) or real(parts))
        suffix.mark(docs.coalesce(1), block_bytes=1024)
    size = sum(len((r.text or "").encode()) + 16 for r in docs.collect())
    assert max(n for n, _ in seen) > size / 8192 > 4 and spark.conf.get(setting) == before


def removed(rows, w=50):
    """doc_id and text -> result rows of operator 2, by a dictionary of strings."""
    first = {}
    for i, t in rows:
        for a in range(len(t) - w + 1):
            first[t[a:a + w]] = min(first.get(t[a:a + w], math.inf), i)
    for i, t in rows:
        gone = np.zeros(len(t), bool)
        for a in range(len(t) - w + 1):
            if first[t[a:a + w]] < i:
                gone[a:a + w] = True
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        yield i, len(t), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()


def test_suffix_dedup(docs, nothing):
    rows = [(r.doc_id if r.doc_id is not None else 1 << 62, (r.text or "").encode()) for r in docs.collect()]
    want = sorted((-1 if i == 1 << 62 else i, *x) for i, *x in removed(rows))
    for size in (8 << 20, 4096):
        got = suffix.mark(docs, block_bytes=size)
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got.collect()) == want
    assert sum(x[2] for x in want) > 1000
    assert suffix.mark(nothing).count() == 0


def tokens_of(text):
    return [*re.findall(WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), "</s>"]


def kneser_ney(rows):
    """Scores by plain counting."""
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    uni, big = collections.Counter(), collections.Counter()
    for i, t in rows:
        if not held(i):
            w = tokens_of(t)
            uni.update(w)
            big.update(zip(["<s>", *w], w))
    n, v = sum(uni.values()), len(uni)

    def cuts(counts):
        n1, n2, n3, n4 = (sum(c == k for c in counts) for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 else 0
        raw = [k - (k + 1) * y * b / a if a else 0 for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
        return [0, *(min(max(d, 0 if n1 == 0 else 0.1), k) for k, d in zip((1, 2, 3), raw))]

    before = collections.Counter(w for _, w in big)
    c1, c2 = cuts(before.values()), cuts(big.values())
    types = sum(before.values())
    spare = sum(c1[min(c, 3)] for c in before.values())
    total, rest = collections.Counter(), collections.Counter()
    for (h, _), c in big.items():
        total[h] += c
        rest[h] += c2[min(c, 3)]
    for i, t in rows:
        w = tokens_of(t)
        score = base = 0.0
        for h, x in zip(["<s>", *w], w):
            p = (max(before[x] - c1[min(before[x], 3)], 0) + spare / (v + 1)) / types
            if total[h]:
                c = big[h, x]
                p = (max(c - c2[min(c, 3)], 0) + rest[h] * p) / total[h]
            score += math.log10(p)
            base += math.log10((uni[x] + 1) / (n + v + 1))
        yield i, held(i), len(w), sum(uni[x] > 0 for x in w), n, base, score


def test_language_model(docs, nothing):
    top = (1 << 63) - 1
    rows = [(top if r.doc_id is None else r.doc_id, r.text) for r in docs.collect()]
    want = sorted(kneser_ney(rows))
    got = sorted((top if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in ngram.score(docs, block_bytes=4096).collect())
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9)
    assert ngram.score(nothing).count() == 0


def test_model_probabilities_sum_to_one(spark):
    """All texts over the known words and an unknown one have probability 1 together; those of over 5 words as a geometric rest."""
    train = [(i, t) for i, t in enumerate(["a b a c", "b a", "c c a b", "a a", "b"] * 4)]
    ids = (i for i in itertools.count(1000) if zlib.crc32(str(i).encode()) % 7 == 2)
    rows = [(next(ids), " ".join(w), k) for k in range(6) for w in itertools.product(["a", "b", "c", "unseen"], repeat=k)]
    got = {r.doc_id: r.score for r in ngram.score(spark.createDataFrame(train + [r[:2] for r in rows], "doc_id bigint, text string")).collect()}
    mass = [sum(10 ** got[i] for i, _, n in rows if n == k) for k in range(6)]
    rate = mass[5] / mass[4]
    assert sum(mass) < 1 and sum(mass) + mass[5] * rate / (1 - rate) == pytest.approx(1, abs=1e-2)


def test_mixing(spark, docs, nothing):
    rows = mixing.plan(mixing.sizes(docs)).collect()
    assert len(rows) == docs.count()
    again = mixing.plan(mixing.sizes(docs.repartition(7))).collect()
    key = lambda r: (str(r.doc_id), str(r.source), r.size, r.h, r.copies)
    assert sorted(map(key, rows)) == sorted(map(key, again))
    by = collections.defaultdict(list)
    for r in rows:
        assert 0 <= r.copies <= 3
        by[r.source].append(r)
    total = sum(r.size for r in rows)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(by, key=lambda s: (s is None, (s or "").encode())))}
    size = {s: sum(r.size for r in by[s]) for s in by}
    target, full = {}, set()
    while True:
        rest, w = total - sum(3 * size[s] for s in full), sum(weight[s] for s in by if s not in full)
        target = {s: 3 * size[s] if s in full else rest * weight[s] / w for s in by}
        new = {s for s in by if target[s] > 3 * size[s]} - full
        if not new:
            break
        full |= new
    for s, own in by.items():
        assert own[0].target == pytest.approx(target[s])
        assert abs(sum(r.copies * r.size for r in own) - target[s]) <= max(r.size for r in own)
    assert mixing.plan(mixing.sizes(nothing)).count() == 0
    assert mixing.mix(docs).columns == docs.columns and mixing.mix(docs).count() == sum(r.copies for r in rows)


def test_mixing_odd_rows(spark):
    """Equal rows are spread over cells, and columns of docs may have any name."""
    same = spark.createDataFrame([(1, "a b c", "s")] * 2000 + [(None, "d e", None)] * 50 + [(2, "f " * 500, "t")], "doc_id bigint, text string, source string")
    rows = mixing.plan(mixing.sizes(same))
    assert rows.count() == 2051 and rows.select("doc_id", "h", "r").distinct().count() == 2051
    clash = same.select("*", *[F.lit(7).alias(c) for c in ("copies", "size", "h", "r", "_h", "_id", "_n", "target", "a.b")])
    out = mixing.mix(clash)
    assert out.columns == clash.columns and out.where("copies <> 7").isEmpty()
    assert out.count() == rows.agg(F.sum("copies")).first()[0]


def test_media(spark, docs, nothing):
    got = media.resolve(media.parse(media.page_of(docs), "doc_id", "html"), media.store(docs)).collect()
    want = sorted(hashlib.sha256(media.pad((r.text or "").encode())).hexdigest() for r in docs.collect())
    assert sorted(r["items"][1].media.payload_sha256 for r in got) == want
    for r in got:
        assert [(i.position, i.kind, i.text, i.caption) for i in r["items"]] == [
            (0, "text", f"Document {r.doc_id}", None), (1, "media", None, f"text of document {r.doc_id}"), (2, "text", "end", None)]
        assert r["items"][0].media is None
    assert media.resolve(media.parse(media.page_of(nothing), "doc_id", "html"), media.store(nothing)).count() == 0


def test_media_batches(spark):
    """Texts don't go to Python to be put on pages, and media go there a few megabytes at a time."""
    docs = spark.range(24).select(F.col("id").alias("doc_id"), F.concat(F.col("id").cast("string"), F.expr("repeat('x', 1 << 20)")).alias("text")).coalesce(1)
    assert "Python" not in (plan := media.page_of(docs)._jdf.queryExecution().toString()) and "MapInArrow" not in plan
    seen = spark.sparkContext.accumulator(0)

    def sized(run):
        def wrapped(batches):
            def look():
                for b in batches:
                    seen.add(1)
                    yield b
            yield from run(look())
        return wrapped

    with pytest.MonkeyPatch.context() as m:
        m.setattr(media.shared, "tidy", sized)
        pages = media.resolve(media.parse(media.page_of(docs), "doc_id", "html"), media.store(docs)).collect()
    assert seen.value > 6 and len(pages) == 24 and all(r["items"][1].media.n_bytes > 1 << 20 for r in pages)


def test_media_interleaved(spark):
    """Several media between texts, the same one twice, one unresolved, pages with one id or none, and pages without items."""
    mark = {t: hashlib.sha256(t.encode()).hexdigest() for t in ("one", "two", "gone")}
    img = lambda t: f'<img src="sha256:{mark[t]}" alt="{t}!">'
    html = f"a{img('two')}b{img('one')}{img('gone')}<p>c</p>{img('two')}"
    pages = spark.createDataFrame([(1, html), (1, "x" + img("one")), (None, img("two")), (4, None), (5, ""), (6, html)], "page_id long, html string")
    found = media.resolve(media.parse(pages, "page_id", "html"), media.store(spark.createDataFrame([("one",), ("two",), ("two",)], "text string"))).collect()
    flat = [(r.page_id, [i.text or (i.caption, i.media and i.media.n_bytes, i.media and i.media.payload_sha256) for i in r["items"]]) for r in found]
    one, two = (tuple([t + "!", 3, hashlib.sha256(media.pad(t.encode())).hexdigest()]) for t in ("one", "two"))
    whole = ["a", two, "b", one, ("gone!", None, None), "c", two]
    assert sorted(flat, key=str) == sorted([(1, whole), (1, ["x", one]), (None, [two]), (4, []), (5, []), (6, whole)], key=str)
    assert all([i.position for i in r["items"]] == list(range(len(r["items"]))) for r in found)


def test_media_of_raw_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = media.parse(pages, "page_id", "html").collect()
    want = {r.page_id: media.sequence(r.html) for r in pages.collect()}
    assert len(got) == pages.count() and sum(len(r["items"]) for r in got) > 0
    assert all([i.asDict() for i in r["items"]] == want[r.page_id] for r in got)


def test_media_sequence():
    html = '<p>a &amp; b</p><script>no</script><figure><img src="sha256:11"><img src="sha256:22" alt="x"><figcaption>two <b>things</b></figcaption></figure>tail<img src="z" alt="own">'
    got = [(x["position"], x["kind"], x["text"] or x["digest"], x["caption"]) for x in media.sequence(html)]
    assert got == [(0, "text", "a & b", None), (1, "media", "11", "two things"), (2, "media", "22", "two things"), (3, "text", "tail", None), (4, "media", "z", "own")]
    assert media.sequence(None) == [] == media.sequence("")
    for data in (b"", b"x", b"x" * 192, bytes(range(256)) * 9):
        assert media.from_png(media.to_png(media.pad(data))) == media.pad(data)


def shingle_groups(rows):
    sets = {}
    for i, t in rows:
        w = tokens_of(t)[:-1]
        sets[i] = set(zip(*[w[k:] for k in range(5)])) if len(w) >= 5 else ({tuple(w)} if w else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted((i, len(s), find(i)) for i, s in sets.items())


def test_jaccard(spark, docs, nothing):
    flat = spark.createDataFrame([(i, r[1]) for i, r in enumerate(corpus())], "doc_id bigint, text string")
    want = shingle_groups([(r.doc_id, r.text) for r in flat.collect()])
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.group(flat, block_bytes=4096).collect())
    assert got == want and sum(i != c for i, _, c in want) >= 10
    assert jaccard.group(docs).count() == docs.count() and jaccard.group(nothing).count() == 0


def test_quality_catches_bad_texts(spark, nothing):
    rng = random.Random(2)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(500)]
    rows, labels = [], []
    for i in range(600):
        w = [rng.choice(vocab) for _ in range(80)]
        bad = i % 4 == 0
        if bad:
            for k in rng.sample(range(80), 5):
                w[k] = rng.choice(["idiotic", "scummy", "vileness"])
        rows.append((i, " ".join(w)))
        if i % 3:
            labels.append((i, 1, int(bad)))
    rows += [(None, None), (601, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    marks = spark.createDataFrame([*labels, (None, 1, 0), (7777, None, None)], "doc_id bigint, quality int, toxic int")
    got = {r.doc_id: r.kept for r in quality.classify(docs, marks).collect()}
    assert len(got) == 602
    held = [i for i in range(600) if i % 3 == 0]
    assert np.mean([got[i] for i in held if i % 4 == 0]) < 0.1 and np.mean([got[i] for i in held if i % 4]) > 0.9
    assert quality.resample(docs, marks).count() == sum(got.values())
    assert quality.classify(docs, marks.limit(0)).where("kept").count() == 602
    assert quality.classify(nothing, marks).count() == 0


@pytest.mark.parametrize("n", [2000, 6000])
def test_quality_adds_up_rare_words(spark, n):
    """Bad words of each language are compounds that stand in a few documents each; English ones are frequent."""
    rng = random.Random(n)
    vocab = {lang: ["".join(rng.choice(abc) for _ in range(4)) for _ in range(400)] for lang, abc in (("en", "abcdefgh"), ("de", "mnopqrst"))}
    ends = ["".join(rng.choice("mnopqrst") for _ in range(3)) for _ in range(n // 100)]
    rows, labels, kind = [], [], {}
    for i in range(n):
        lang, bad = "de" if i % 5 == 0 else "en", rng.random() < 0.15
        w = [rng.choice(vocab[lang]) for _ in range(80)]
        for k in rng.sample(range(80), 6) if bad else []:
            w[k] = rng.choice(["idiotic", "scummy"]) if lang == "en" else "schimpf" + rng.choice(ends)
        rows.append((i, " ".join(w)))
        kind[i] = (lang, bad)
        if rng.random() < 0.4:
            labels.append((i, 1, int(bad)))
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = {r.doc_id: r.kept for r in quality.classify(docs, marks).collect()}
    named = {i for i, _, _ in labels}
    for lang in ("en", "de"):
        share = lambda bad, labelled: np.mean([got[i] for i, k in kind.items() if k == (lang, bad) and (i in named) == labelled])
        assert share(True, True) < 0.1 and share(True, False) < 0.1
        assert share(False, False) > 0.9 and abs(share(False, True) - share(False, False)) < 0.05
    assert sorted(r.doc_id for r in quality.resample(docs, marks).select("doc_id").collect()) == sorted(i for i, k in got.items() if k)


def test_quality_samples_by_both_signs(spark):
    raw = np.array([400.0, 400, 400, 400, 9, 0] + [0] * 10)
    got = quality.ratios(np.array([130.0, 0, 260, 133, 1, 0] + [0] * 10), raw)
    assert got[0, 1] < -4 and got[0, 2] > 0.4 and -0.1 < got[0, 4] < 0 and got[0, 5] == 0 and (got[1] <= got[0]).all()
    noise = spark.range(20_000).withColumnRenamed("id", "doc_id").select(quality._noise(7).alias("key")).toPandas()["key"]
    assert abs(noise.mean() - 0.5772) < 0.05 and abs(noise.std() - math.pi / 6**0.5) < 0.05  # standard Gumbel


def test_quality_ratios_by_hand(spark):
    """Every log ratio from plain dictionaries of grams: all texts counted, the text itself left out."""
    rng = random.Random(9)
    vocab = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(60)]
    rows = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(1, 30)))) for i in range(120)] + [(200, None), (201, ""), (None, "abc def"), (5, "abc def")]
    labels = [(i, i % 3 != 0, int(i % 5 == 0)) for i in range(0, 120, 2)]
    good = {i for i, q, t in labels if q and not t}
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    got = sorted(((r.doc_id if r.doc_id is not None else -1, round(r.log_ratio, 4)) for r in quality.classify(
        docs, spark.createDataFrame([(i, int(q), t) for i, q, t in labels], "doc_id bigint, quality int, toxic int"), block_bytes=1024).collect()))
    of = [next((g.tolist() for _, g, _ in quality.grams([(t or "").encode()])), []) for _, t in rows]
    raw, target = collections.Counter(), collections.Counter()
    for (i, _), gs in zip(rows, of):
        raw.update(gs)
        target.update(gs if i in good else [])
    dense = [np.zeros(1 << quality.BITS), np.zeros(1 << quality.BITS)]
    for c, d in zip((target, raw), dense):
        d[list(c)] = list(c.values())
    model = quality.ratios(*dense)
    want = sorted((-1 if i is None else i, round(float(sum(model[int(i in good), g] for g in gs)), 4)) for (i, _), gs in zip(rows, of))
    assert [a for a, _ in got] == [a for a, _ in want] and [b for _, b in got] == pytest.approx([b for _, b in want], abs=2e-4)


def test_top_is_exact(spark):
    rng = random.Random(1)
    keys = [rng.gauss(0, 1) ** 3 for _ in range(5000)] + [0.25] * 500
    df = spark.createDataFrame([(k,) for k in keys], "key double")
    for share in (0.001, 0.1, 0.5, 0.9, 1.0):
        line = quality.top(df, share)
        assert line == (sorted(keys, reverse=True)[round(share * len(keys)) - 1] if share < 1 else -math.inf)


def test_embeddings(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((1500, 32))
    near = base[:200] + rng.standard_normal((200, 32)) * 0.12
    x = np.concatenate([base, near, near[:50] * 3, base[:40]]).astype(np.float32)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    odd = [(9000, None), (9001, [0.0] * 32), (9002, [float("nan")] * 32), (9003, [1.0, None] * 16), (9004, []), (9005, [1.0]), (None, x[0].tolist()), (3, x[3].tolist())]
    df = spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<float>").withColumn("n_links", F.lit("x"))
    got = {(r.vec_id, i): r for i, r in enumerate(embed.dedup(df).collect())}
    assert len(got) == len(rows) + len(odd)
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    hit = u @ u.T >= 0.95
    np.fill_diagonal(hit, False)
    extra = {0: 1, 3: 1}
    want = hit.sum(1) + np.array([sum(extra[k] for k in extra if hit[i, k] or i == k) for i in range(len(x))])
    n = {i: r.n_links for (i, _), r in got.items()}
    found = sum(min(n[i], want[i]) for i in range(len(x)))
    assert found >= 0.97 * want.sum() and all(n[i] <= want[i] for i in range(len(x)))
    assert all(n[i] == 0 for i in range(9000, 9006))
    assert embed.dedup(df.limit(0)).count() == 0


def test_embeddings_in_slices(spark):
    """Groups of near copies in heavy cells: links counted once each, one group each, rows linear in the vectors; other number types."""
    rng = np.random.default_rng(5)
    centre = rng.standard_normal((3, 16))
    x = np.concatenate([rng.standard_normal((300, 16)), *[c + rng.standard_normal((300, 16)) * 0.1 for c in centre]])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = (u @ u.T >= 0.95) & ~np.eye(len(x), dtype=bool)
    want = [min(i, *np.flatnonzero(hit[i]), i) for i in range(len(x))]
    for _ in range(20):
        want = [min([want[i], *[want[j] for j in np.flatnonzero(hit[i])]]) for i in range(len(x))]
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "id bigint, v array<double>, m bigint").repartition(4)
    whole = embed.MultiIndex(u, len(x), 0.95, 1.0)
    for heavy in (7, embed.HEAVY):
        got = embed.links(df, 16, index=whole, heavy=heavy)
        n = {r.id: r.n for r in got.groupBy("id").agg(F.sum("n").alias("n")).collect()}
        assert [n.get(i, 0) for i in range(len(x))] == hit.sum(1).tolist()
    assert embed.links(df, 16, index=whole).count() <= len(x) * (whole.k ** 2 + 1) < hit.sum() / 2
    out = sorted((r.vec_id, r.component_id, r.n_links) for r in embed.dedup(df.select(F.col("id").alias("vec_id"), F.col("v").cast("array<decimal(20,16)>").alias("embedding")), recall=1.0, heavy=50).collect())
    assert [c for _, c, _ in out] == want and [n for _, _, n in out] == hit.sum(1).tolist()


def test_chat_tree(spark):
    rows = [(1, None, 0.0, "user", "hi </s>"), (2, 1, 0.2, "assistant", "worse"), (3, 1, 0.9, "assistant", "better [/INST]"), (4, 3, 0.5, "user", None), (5, 4, 0.1, "assistant", r"<\/s> [\\INST] </s"),
            (6, None, 1.0, None, ""), (7, 99, 1.0, "user", "orphan")]
    df = spark.createDataFrame(rows, "node bigint, parent bigint, score double, role string, text string")
    one = {r.leaf: r for r in chat.format_paths(df, chat.paths(df)).select("leaf", "formatted", chat.read_back(F.col("formatted")).alias("t"), chat.loss_mask(F.col("formatted")).alias("m")).collect()}
    assert set(one) == {5, 6, 7}
    assert [(t.role, t.text) for t in one[5].t] == [("user", "hi </s>"), ("assistant", "better [/INST]"), ("user", ""), ("assistant", r"<\/s> [\\INST] </s")]
    assert [t.text for t in one[6].t] == [""] and len(one[5].m) == 2
    assert {r.leaf for r in chat.paths(df, 2).select("leaf").collect()} == {2, 5, 6, 7}
    assert chat.format_paths(df.limit(0), chat.paths(df.limit(0))).count() == 0


def test_chat_cycles(spark):
    """Nodes on a cycle and below it are left out; the others are not touched by them."""
    edges = [(1, 2), (2, 1), (3, 1), (4, 3), (5, 5), (10, None), (11, 10), (12, 11), (13, 10)]
    df = spark.createDataFrame([(n, p, float(n), "user", str(n)) for n, p in edges], "node bigint, parent bigint, score double, role string, text string").withColumn("up", F.lit(1))
    assert sorted((r.leaf, r.node, r.depth) for r in chat.paths(df).collect()) == [(13, 10, 0), (13, 13, 1)]
    assert sorted((r.leaf, r.node, r.depth) for r in chat.paths(df, 2).collect()) == [(12, 10, 0), (12, 11, 1), (12, 12, 2), (13, 10, 0), (13, 13, 1)]


def test_chat_long_chain(spark):
    n = 300
    df = spark.range(n).select(F.col("id").alias("node"), F.when(F.col("id") > 0, F.col("id") - 1).alias("parent"), F.lit(0.0).alias("score"), F.lit("user").alias("role"), F.col("id").cast("string").alias("text"))
    got = chat.format_paths(df, chat.paths(df)).select(chat.read_back(F.col("formatted")).alias("t")).collect()
    assert len(got) == 1 and [t.text for t in got[0].t] == [str(i) for i in range(n)]


def test_language(spark, nothing):
    rng = random.Random(6)
    make = {"en": ["the", "ing", "tion", "and", "th", "er"], "de": ["ung", "sch", "der", "heit", "ein", "pf"], "es": ["ción", "los", "ado", "que", "rr", "ñ"]}
    say = lambda k, n: " ".join("".join(rng.choice(make[k]) for _ in range(rng.randint(1, 3))) for _ in range(n))
    rows = [(i, say(k, 40), k) for i in range(100) for k in make]
    langs, model = language.fit(spark.createDataFrame([*rows, (1, None, "en"), (2, "x", None)], "doc_id bigint, text string, lang string"))
    assert langs == ["de", "en", "es"]
    ask = [(i, say(k, 30), k) for i in range(60) for k in make] + [(900, None, "und"), (901, "", "und"), (902, "12 !!", "und"), (903, say("en", 60) + " " + say("de", 20), "en")]
    got = language.predict(spark.createDataFrame(ask, "doc_id bigint, text string, want string").withColumn("score", F.lit("x")), langs, model).collect()
    assert np.mean([r.lang_pred == r.want for r in got]) > 0.98 and all(0 <= r.score <= 1 for r in got)
    mixed = next(r for r in got if r.doc_id == 903)
    assert mixed.n_langs == 2 and 0.6 < mixed.score < 0.9
    none, empty = language.fit(nothing)
    assert none == [] and language.predict(spark.createDataFrame([(1, "abc")], "doc_id bigint, text string"), none, empty).first().lang_pred == "und"


def test_components(spark):
    rng = random.Random(8)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(i, i + 1) for i in range(400, 460)] + [(500, 500), (7, None)]
    root = {i: i for i in range(600)}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        if b is not None:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    touched = {i for a, b in edges if b is not None and a != b for i in (a, b)}
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: find(i) for i in touched}
    assert graph.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
    assert pd.Series(got).notna().all()
