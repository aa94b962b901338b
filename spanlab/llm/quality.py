"""Quality classifier by importance resampling (operator 7).

Two generative models of hashed word n-grams, of the target (labelled good)
texts and of all raw texts, give each document log p_target - log p_raw.
Gumbel noise is added and the highest keys are kept.  How many are kept
follows from the ratio that best parts the labelled good from the other rows.

The ratio of a gram is its posterior mean, so rare grams count for little each
but add up; a text's own occurrence is left out, so labels don't favour it.

Texts are written once as blocks; labels meet the blocks' document ids, never
texts, and tasks send each other only packed slices of the two count vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from . import shared
from .npwords import _FOLD, U64, mix, pack, slices, span_hashes

BITS = 20
#: Log ratios that a gram may have besides 0; those above 0 end below that of a gram that only the target has.
LOW, HIGH = (-10.0, -8.0, -6.0, -5.0, -4.0, -3.0, -2.0), (0.5, 0.8)
#: Share of grams with a low ratio beforehand, and a tenth of it with a high one: words and beginnings, bigrams (far more, and copied together).
PRIOR, PRIOR_BIGRAM = 5e-4, 1e-6
#: Lengths in bytes of the beginnings of longer words that count as grams: compounds share them.
BEGINNINGS = (4, 5, 6, 7, 8)
_KIND = np.zeros(256, np.uint8)
_KIND[0x21:0x7F] = 2
_KIND[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = 1


def grams(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each slice of texts: its first text, then the distinct gram buckets of its texts and each one's text number.

    Grams are words and punctuation runs, beginnings of words, bigrams, and one
    symbol for how much of a text repeats its own bigrams (in tenths).
    """
    for a, b in slices(texts):
        buf, starts = pack(texts[a:b])
        kind = _KIND[buf]
        edge = np.flatnonzero(kind[1:] != kind[:-1]) + 1
        lo = np.concatenate([[0], edge])
        hi = np.concatenate([edge, [len(buf)]])
        keep = kind[lo] > 0
        lo, hi = lo[keep], hi[keep]
        folded = _FOLD[buf]
        h = span_hashes(folded, lo, hi)
        at = np.searchsorted(lo, starts)
        own = np.repeat(np.arange(b - a), np.diff(at))
        prev = np.concatenate([np.zeros(1, U64), h[:-1]])[: len(h)]
        prev[at[:-1][at[:-1] < len(h)]] = U64(1)
        quarter = 1 << (BITS - 2)  # words in the first quarter of the buckets, bigrams in the second, beginnings in the others
        shift = U64(66 - BITS)
        single = (own << BITS) | (h >> shift).astype(np.int64)
        double = np.unique((own << BITS) | quarter | (mix(prev * U64(3) + h) >> shift).astype(np.int64))
        begun = []
        for c in BEGINNINGS:
            longer = hi - lo > c
            begun.append((own[longer] << BITS) | 2 * quarter | (mix(span_hashes(folded, lo[longer], lo[longer] + c) + U64(c)) >> (shift - U64(1))).astype(np.int64))
        n = np.diff(at)
        repeated = 1 - np.bincount(double >> BITS, minlength=b - a) / np.maximum(n, 1)
        tenth = mix((np.floor(repeated * 10) + 77).astype(U64)) >> shift
        single = np.unique(np.concatenate([single, ((np.arange(b - a) << BITS) | tenth.astype(np.int64))[n > 0]]))
        key = np.concatenate([single, double, np.unique(np.concatenate(begun))])
        yield a, key & ((1 << BITS) - 1), a + (key >> BITS)


SLICES = 64
#: Tasks' counts of a slice are added by this many tasks first.
SALTS = 16
_COUNTS = "slice int, salt int, n bigint, t bigint, counts binary"


def _packed(total: np.ndarray, texts: np.ndarray, salt: int) -> Iterator[pa.RecordBatch]:
    """Slices of the (2, 2**BITS) counts that hold any; the first also tells how many texts there were, of the target and in all."""
    width = total.shape[1] // SLICES
    for k in range(SLICES):
        own = np.ascontiguousarray(total[:, k * width:(k + 1) * width])
        if k == 0 or own.any():
            yield pa.RecordBatch.from_pydict({"slice": pa.array([k], pa.int32()), "salt": pa.array([salt], pa.int32()), "n": pa.array([int(texts[1]) if k == 0 else 0]),
                                              "t": pa.array([int(texts[0]) if k == 0 else 0]), "counts": pa.array([B.pack_array(own)], pa.binary())})


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, seen = np.zeros((2, 1 << BITS), np.int64), np.zeros(2, np.int64)
    for row in B.rows(batches):
        _, texts = B.unpack_block(row)
        good = _flags(row, len(texts))[0]
        seen += [good.sum(), len(good)]
        for _, g, own in grams(texts):
            total[1] += np.bincount(g, minlength=1 << BITS)
            total[0] += np.bincount(g[good[own]], minlength=1 << BITS)
    yield from _packed(total, seen, TaskContext.get().partitionId() % SALTS)


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per slice of the partition: at most the whole model is held."""
    sums: dict[int, list] = {}
    for row in B.rows(batches):
        counts = B.unpack_array(row["counts"], np.int64)
        if row["slice"] in sums:
            own = sums[row["slice"]]
            own[0] += row["n"]
            own[1] += row["t"]
            own[2] += counts
        else:
            sums[row["slice"]] = [row["n"], row["t"], counts.copy()]
    for k, (n, t, counts) in sums.items():
        yield pa.RecordBatch.from_pydict({"slice": pa.array([k], pa.int32()), "salt": pa.array([0], pa.int32()), "n": pa.array([n]), "t": pa.array([t]), "counts": pa.array([B.pack_array(counts)], pa.binary())})


def _flags(row: dict, n: int) -> np.ndarray:
    """Masks of a block's rows: of the target; labelled but not of the target."""
    out = np.zeros((2, n), bool)
    for x in row["told"] or []:
        out[0 if x["good"] else 1, x["row"]] = True
    return out


def marked(store: B.Blocks, labels: DataFrame) -> DataFrame:
    """The blocks, each told which of its rows are labelled: good if any label of the doc_id is quality 1 and not toxic.

    Rows without a label, with a null doc_id or whose labels have no quality are not told.
    """
    good = F.coalesce((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0), F.lit(False))
    one = labels.where("doc_id is not null and quality is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max(good).alias("good"))
    return store.told(store.rows().where("doc_id is not null").join(one, "doc_id"), "good")


def fit(blocks: DataFrame) -> np.ndarray:
    """Log ratio of each n-gram bucket, target against raw, over all rows of marked().

    A gram counts once per text.  The model has 2 x 2**BITS numbers whatever the input, for texts outside and of
    the target; without target texts all are 0.
    """
    some = blocks.select("ids", "lens", "text", "told").mapInArrow(shared.tidy(_count), _COUNTS).repartition(SLICES, "slice", "salt").mapInArrow(shared.tidy(_add), _COUNTS)
    with shared.small_batches(blocks.sparkSession):
        rows = some.repartition(SLICES, "slice").mapInArrow(shared.tidy(_add), _COUNTS).collect()  # SLICES packed rows
    if not sum(r["t"] for r in rows):
        return np.zeros((2, 1 << BITS), np.float32)
    counts = np.zeros((2, SLICES, (1 << BITS) // SLICES))
    for r in rows:
        counts[:, r["slice"]] = B.unpack_array(bytes(r["counts"]), np.int64).reshape(2, -1)
    return ratios(*counts.reshape(2, -1))


def ratios(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """Posterior mean of each bucket's log ratio to the common ratio (that of the median occurrence), with one text left out.

    Row 0 leaves out a text outside the target, row 1 one of the target; row 1 is never above row 0.
    """
    seen = np.flatnonzero(raw)
    own = target[seen] / raw[seen]
    order = np.argsort(own)
    base = own[order][np.searchsorted(np.cumsum(raw[seen][order]), raw.sum() / 2)]
    base = min(max(base, 1e-9), 1 - 1e-9)
    high = np.minimum(HIGH, -np.log(base) * np.array([0.4, 0.7]))
    grid = np.concatenate([LOW, [0.0], high])
    out = np.zeros((2, len(raw)), np.float32)
    quarter = len(raw) // 4
    for lo in range(0, len(seen), 1 << 16):
        at = seen[lo : lo + (1 << 16)]
        low = np.where((at >= quarter) & (at < 2 * quarter), PRIOR_BIGRAM, PRIOR)[:, None]
        prior = np.log(np.concatenate([np.repeat(low / len(LOW), len(LOW), 1), 1 - 1.1 * low, np.repeat(low / 10 / len(HIGH), len(HIGH), 1)], 1))
        n = raw[at] - 1
        for k, t in enumerate((np.minimum(target[at], n), np.maximum(target[at] - 1, 0))):
            fits = prior + t[:, None] * (np.log(base) + grid) + (n - t)[:, None] * np.log1p(-base * np.exp(grid))
            fits = np.exp(fits - fits.max(1, keepdims=True))
            out[k, at] = fits @ grid / fits.sum(1)
    return out


def log_ratios(texts: list[bytes], target: np.ndarray, model: np.ndarray) -> np.ndarray:
    """Sum of the log ratios of each text's grams; target: which texts are of the target.  Empty texts: 0."""
    out = np.zeros(len(texts))
    for _, g, own in grams(texts):
        out += np.bincount(own, weights=model[target[own].astype(np.int64), g], minlength=len(texts))
    return out


def _noise(seed: int) -> Column:
    unit = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 11) + 0.5) / F.lit(float(1 << 53))
    return -F.log(-F.log(unit))


def score(blocks: DataFrame, model: np.ndarray, seed: int = 7) -> DataFrame:
    """block, row, doc_id, good (null: no label), log_ratio, and key = log_ratio + standard Gumbel noise (from seed and doc_id)."""
    shipped = blocks.sparkSession.sparkContext.broadcast(model)  # 2 x 2**BITS numbers

    def run(batches):
        for row in B.rows(batches):
            ids, texts = B.unpack_block(row)
            good, bad = _flags(row, len(texts))
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(ids), row["block"])), pa.array(np.arange(len(ids)), pa.int32()), pa.array(ids, mask=ids == B.NO_ID),
                pa.array(good, mask=~(good | bad)), pa.array(log_ratios(texts, good, shipped.value))], ["block", "row", "doc_id", "good", "log_ratio"])

    got = blocks.select("block", "ids", "lens", "text", "told").mapInArrow(shared.tidy(run), "block bigint, row int, doc_id bigint, good boolean, log_ratio double")
    return got.withColumn("key", F.col("log_ratio") + _noise(seed))


def top(keyed: DataFrame, share: float, key: str = "key") -> float:
    """The key at and above which round(share * rows) rows lie (ties stay together): exact, by repeated histograms of 4096 bins."""
    n, lo, hi = keyed.agg(F.count(key), F.min(key), F.max(key)).first()
    want = round(share * n)
    if not n or want >= n:
        return float("-inf")
    if want <= 0:
        return float("inf")
    for _ in range(12):
        width = (hi - lo) / 4096
        if width <= 0 or lo + width == lo:
            return lo
        inside = keyed.where((F.col(key) >= lo) & (F.col(key) <= hi))
        bins = sorted(inside.groupBy(F.least(F.floor((F.col(key) - lo) / width), F.lit(4095)).alias("b")).agg(
            F.count("*").alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi")).collect(), reverse=True)
        for b, c, b_lo, b_hi in bins:
            if want <= c:
                lo, hi = b_lo, b_hi
                break
            want -= c
        if lo == hi or want == 0:
            return lo
    return lo


def _share(scored: DataFrame) -> float:
    """Share of documents to keep: those above the ratio that parts labelled target rows from the others best.

    Histograms of 4096 bins; without both kinds of labelled rows all are kept.
    """
    step = F.ceil(F.greatest(F.least("log_ratio", F.lit(64.0)), F.lit(-64.0)) * 32).cast("int")  # 0 is a bin of its own
    rows = scored.groupBy(step.alias("bin"), "good").count().collect()  # three kinds of row in at most 4097 bins
    good, bad, every = (sum(r["count"] for r in rows if test(r["good"])) for test in (lambda g: g is True, lambda g: g is False, lambda g: True))
    if not good or not bad:
        return 1.0
    best, line = 0.0, -(1 << 30)
    kept_good, kept_bad = 0, 0
    for b in sorted({r["bin"] for r in rows}, reverse=True):
        kept_good += sum(r["count"] for r in rows if r["bin"] == b and r["good"] is True)
        kept_bad += sum(r["count"] for r in rows if r["bin"] == b and r["good"] is False)
        gain = kept_good / good - kept_bad / bad
        if gain > best:
            best, line = gain, b
    return sum(r["count"] for r in rows if r["bin"] >= line) / every


def _cut(store: B.Blocks, labels: DataFrame, seed: int) -> tuple[DataFrame, float]:
    """score() of all rows, written, and the least key to keep."""
    blocks = marked(store, labels)
    scored = shared.put(score(blocks, fit(blocks), seed), "quality")
    return scored, top(scored, _share(scored))


def classify(docs: DataFrame, labels: DataFrame, text: str = "text", seed: int = 7, block_bytes: int = B.BLOCK_BYTES) -> DataFrame:
    """doc_id, log_ratio, key and kept of each row of docs; other columns are ignored.

    Target: rows whose doc_id is labelled quality 1 and not toxic.  How many
    are kept follows from the labelled rows; without labels of both kinds all
    are.  Null, empty and symbol-free texts have ratio 0.  A null doc_id has no
    label and comes back null.  Repeated rows are scored alike.  An empty table
    gives none.
    """
    with B.Blocks(docs.select("doc_id", text), block_bytes, text=text) as store:
        scored, line = _cut(store, labels, seed)
    return scored.select("doc_id", "log_ratio", "key", (F.col("key") >= line).alias("kept"))


def resample(docs: DataFrame, labels: DataFrame, text: str = "text", seed: int = 7, block_bytes: int = B.BLOCK_BYTES) -> DataFrame:
    """Rows of docs that ``classify`` keeps, columns unchanged; blocks are told which of their rows stay."""
    with B.Blocks(docs, block_bytes, rest=True, text=text) as store:
        scored, line = _cut(store, labels, seed)
        kept = shared.put(store.emit(scored.where(F.col("key") >= line).select("block", "row")), "kept")
    shared.drop(scored)
    return kept
