"""LM scoring (operator 3): interpolated modified Kneser-Ney bigram model.

Counting and scoring share three rounds of questions between blocks of texts
and hash buckets.  Words get dense ids; a bigram is the exact pair of ids.
Each bucket keeps its part of the model as sorted arrays in a memory-mapped
scratch file that lives as long as its task, and answers from it.  Nothing of
the model but a dozen sums reaches the driver.
"""

from __future__ import annotations

import tempfile
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from . import shared
from .npwords import U64, words

START, END = U64(0x51A7_0000_0000_0001), U64(0x51A7_0000_0000_0002)
NO_ID = B.NO_ID


def held_out(ids: np.ndarray) -> np.ndarray:
    """crc32 of the id as text, modulo 7, is 2."""
    return np.array([zlib.crc32(str(i).encode()) % 7 == 2 for i in ids.tolist()], bool)


class Shard:
    """Sorted uint64 keys with a matrix of numbers each, memory-mapped from an unnamed scratch file."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.file = tempfile.TemporaryFile()
        self.file.write(keys.tobytes())
        self.file.write(np.ascontiguousarray(values).tobytes())
        self.file.flush()
        n = len(keys)
        self.keys = np.memmap(self.file, U64, "r", 0, (n,)) if n else keys
        self.values = np.memmap(self.file, values.dtype, "r", 8 * n, values.shape) if n else values

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Values of sorted keys that are all present."""
        return self.values[np.searchsorted(self.keys, keys)]


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all texts, START first and END last in each, and the first token of each text (one more at the end)."""
    h, at = words(texts)
    n = np.diff(at) + 2
    first = np.concatenate([[0], np.cumsum(n)])
    out = np.empty(first[-1], U64)
    out[first[:-1]], out[first[1:] - 1] = START, END
    inner = np.ones(len(out), bool)
    inner[first[:-1]] = inner[first[1:] - 1] = False
    out[inner] = h
    return out, first


def _sum(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    u, inverse = np.unique(keys, return_inverse=True)
    return u, np.bincount(inverse, weights=weights, minlength=len(u))


def discounts(n: np.ndarray) -> np.ndarray:
    """Discounts for counts 0, 1, 2 and 3 or more, from how many have count 1, 2, 3, 4."""
    n1, n2, n3, n4 = (float(x) for x in n)
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    raw = [k - (k + 1) * y * b / a if a else 0.0 for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return np.array([0.0, *(min(max(d, 0.0 if n1 == 0 else 0.1), k) for k, d in zip((1, 2, 3), raw))])


def _tally(c: np.ndarray) -> np.ndarray:
    return np.bincount(np.minimum(c, 5).astype(np.int64), minlength=6)[1:5]


def score(docs: DataFrame, held: Callable[[np.ndarray], np.ndarray] = held_out, block_bytes: int = B.BLOCK_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs.

    Learns from rows that ``held`` leaves.  Null texts count as empty: one end
    token.  A null doc_id is tested as the largest bigint and comes back null.
    Repeated rows count as often as they stand there.  Without training rows
    all words are equally (un)likely.  Other columns of docs are ignored.
    """
    store = B.Blocks(docs.select("doc_id", "text"), block_bytes)
    parts = store.parts

    def trained(ids, first):
        return np.repeat(~held(ids), np.diff(first))

    # round 1: words -> dense id and training count
    def ask_words(row):
        ids, texts = B.unpack_block(row)
        t, first = tokens(texts)
        count = trained(ids, first)
        count[first[:-1]] = False
        u, c = _sum(t, count)
        return u, c.astype("<u8").view(np.uint8).reshape(-1, 8)

    def tell_words(bucket, kinds, ks, vs):
        u, place = B.merged(ks)
        c = np.bincount(np.concatenate(place), weights=np.concatenate([v.view("<u8").ravel() for v in vs]), minlength=len(u))
        own = Shard(u, np.stack([np.arange(len(u)) * parts + bucket, c.astype(np.int64)], 1).astype("<u8"))
        return [own.find(k).view(np.uint8).reshape(-1, 16) for k in ks], None, [c.sum(), (c > 0).sum()]

    got1 = shared.put(B.ask(store.df, parts, ask_words, tell_words), "words")
    n_all, n_types = B.total(got1) if store.df.head(1) else (0.0, 0.0)
    with_words = store.df.join(B.by_block(got1, "words"), "block", "left")

    def numbered(row):
        ids, texts = B.unpack_block(row)
        t, first = tokens(texts)
        u, place = np.unique(t, return_inverse=True)
        told = B.answered(u, row["words"], parts, 16).view("<u8").reshape(-1, 2)
        return ids, first, told, place

    def pairs(number, first):
        """(context << 32 | word) for every token but START, and where each text's begin."""
        inner = np.ones(len(number), bool)
        inner[first[:-1]] = False
        w = number[inner]
        h = number[:-1][inner[1:]]
        return h << U64(32) | w

    # round 2: bigrams -> training count; their sums per context and per word go on to round 3
    def ask_pairs(row):
        ids, first, told, place = numbered(row)
        key = pairs(told[place, 0], first)
        u, c = _sum(key, np.repeat(~held(ids), np.diff(first) - 1))
        return u, c.astype("<u4").view(np.uint8).reshape(-1, 4)

    def tell_pairs(bucket, kinds, ks, vs):
        u, place = B.merged(ks)
        c = np.bincount(np.concatenate(place), weights=np.concatenate([v.view("<u4").ravel() for v in vs]), minlength=len(u))
        own = Shard(u, c.astype("<u4"))
        seen = c > 0
        u, c = u[seen], c[seen]
        context, i = np.unique(u >> U64(32), return_inverse=True)
        word, j = np.unique(u & U64(0xFFFF_FFFF), return_inverse=True)
        ids = np.union1d(context, word)
        sums = np.zeros((len(ids), 5), np.int64)
        at = np.searchsorted(ids, context)
        sums[at, 0] = np.bincount(i, weights=c, minlength=len(context))
        for k, mask in ((1, c == 1), (2, c == 2), (3, c >= 3)):
            sums[at, k] = np.bincount(i, weights=mask, minlength=len(context))
        sums[np.searchsorted(ids, word), 4] = np.bincount(j, minlength=len(word))
        answers = [own.find(k).view(np.uint8).reshape(-1, 4) for k in ks]
        return answers, (ids, sums.astype("<u8").view(np.uint8).reshape(-1, 40)), _tally(c)

    got2 = shared.put(B.ask(with_words, parts, ask_pairs, tell_pairs), "pairs")
    cut2 = discounts(B.total(got2)) if n_all else np.zeros(4)

    # round 3: word ids -> context total, contexts' words with count 1, 2, 3+, and distinct contexts before the word
    def ask_sums(row):
        _, _, told, _ = numbered(row)
        return np.sort(told[:, 0]), np.zeros((len(told), 1), np.uint8)

    def tell_sums(bucket, kinds, ks, vs):
        data = [(k, v.view("<u8").reshape(-1, 5)) for kind, k, v in zip(kinds, ks, vs) if kind == B.TOLD]
        asked = [k for kind, k in zip(kinds, ks) if kind == B.ASKED]
        u, place = B.merged(ks)
        sums = np.zeros((len(u), 5), np.int64)
        for (k, v), at in zip(data, [p for kind, p in zip(kinds, place) if kind == B.TOLD]):
            sums[at] += v.astype(np.int64)
        own = Shard(u, sums.astype("<u8"))
        before = sums[:, 4]
        return [own.find(k).view(np.uint8).reshape(-1, 40) for k in asked], None, [*_tally(before), before.sum(), (before == 1).sum(), (before == 2).sum(), (before > 2).sum()]

    told = got2.where(F.col("kind") == B.TOLD)
    got3 = shared.put(B.ask(with_words, parts, ask_sums, tell_sums, told), "sums")
    sums = B.total(got3)
    cut1 = discounts(sums[:4]) if n_all else np.zeros(4)
    types, m = (float(sums[4]), sums[5:8]) if n_all else (0.0, np.zeros(3))

    def finish(batches):
        for row in B.rows(batches):
            ids, first, about, place = numbered(row)
            number = about[:, 0]
            order = np.argsort(number)
            facts = np.empty((len(number), 5), np.int64)
            facts[order] = B.answered(number[order], row["sums"], parts, 40).view("<u8").reshape(-1, 5)
            key = pairs(number[place], first)
            u, at = np.unique(key, return_inverse=True)
            c2 = B.answered(u, row["pairs"], parts, 4).view("<u4").ravel()[at].astype(np.int64)
            inner = np.ones(len(place), bool)
            inner[first[:-1]] = False
            w, h = place[inner], place[:-1][inner[1:]]
            flat = 1.0 / (n_types + 1)
            before = facts[:, 4]
            low = (np.maximum(before - cut1[np.minimum(before, 3)], 0) + (cut1[1:] @ m) * flat) / types if types else np.full(len(before), flat)
            seen = facts[:, 0]
            rest = facts[:, 1:4] @ cut2[1:]
            p = low[w]
            known = seen[h] > 0
            p = np.where(known, (np.maximum(c2 - cut2[np.minimum(c2, 3)], 0) + rest[h] * p) / np.maximum(seen[h], 1), p)
            count = about[:, 1].astype(np.int64)[w]
            basic = np.log10((count + 1) / (n_all + n_types + 1))
            doc = np.repeat(np.arange(len(ids)), np.diff(first) - 1)
            n = len(ids)
            yield pa.RecordBatch.from_pydict({
                "doc_id": pa.array([None if i == NO_ID else i for i in ids.tolist()], pa.int64()),
                "held_out": pa.array(held(ids)),
                "n_tokens": pa.array(np.diff(first) - 1),
                "n_known": pa.array(np.bincount(doc, weights=count > 0, minlength=n).astype(np.int64)),
                "train_tokens": pa.array(np.full(n, int(n_all), np.int64)),
                "base_score": pa.array(np.bincount(doc, weights=basic, minlength=n)),
                "score": pa.array(np.bincount(doc, weights=np.log10(p), minlength=n)),
            })

    ready = with_words.join(B.by_block(got2, "pairs"), "block", "left").join(B.by_block(got3, "sums"), "block", "left")
    done = shared.put(ready.mapInArrow(finish, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"), "scores")
    store.close()
    for x in (got1, got2, got3):
        shared.drop(x)
    return done
