"""Language identification as a mixture (operator 10).

Each language has a model of hashed byte trigrams.  Every word of a text gets
one likelihood per language; expectation-maximisation estimates the text's
language proportions, for the best language alone, the best two, and so on,
and the set with the best likelihood less a penalty per language is kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .npwords import _FOLD, _SPACE, U64, mix, pack, slices, word_bounds

BITS = 15
ROUNDS = 8
MOST_LANGS = 200  # languages of a model: it is sent to all workers whole, 128 KB each
_LETTER = regex.compile(r"\p{L}")


def trigrams(buf: np.ndarray) -> np.ndarray:
    """Bucket of the three bytes that start at each place but the last two."""
    folded = _FOLD[buf]
    folded = np.where(_SPACE[folded], np.uint8(32), folded).astype(np.uint32)
    code = folded[:-2] << 16 | folded[1:-1] << 8 | folded[2:]
    return (code * np.uint32(2654435761)) >> np.uint32(32 - BITS)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch.column(1).to_pylist()
        texts = [t or b"" for t in batch.column(0).to_pylist()]
        for a, b in slices(texts):
            by: dict[str, list[bytes]] = {}
            for t, lang in zip(texts[a:b], langs[a:b]):
                by.setdefault(lang, []).append(t)
            for lang, own in by.items():
                buf = np.frombuffer(b" " + b" ".join(own) + b"  ", np.uint8)
                total[lang] = total.get(lang, 0) + np.bincount(trigrams(buf), minlength=1 << BITS)
    for lang, counts in total.items():
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(at)), "g": pa.array(at, pa.int32()), "n": pa.array(counts[at], pa.int64())})


def fit(docs: DataFrame, text: str = "text", lang: str = "lang") -> tuple[list[str], np.ndarray]:
    """Languages in order, and log probabilities (language, bucket) from all rows with text and lang.

    The model has 2**BITS numbers per language.  No such row: no language.
    Over MOST_LANGS labels are no language labels: that raises ValueError
    before anything is gathered.
    """
    known = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).cast("binary"), F.col(lang).cast("string"))
    if known.select(lang).distinct().limit(MOST_LANGS + 1).count() > MOST_LANGS:
        raise ValueError(f"more than {MOST_LANGS} different labels in {lang}")
    got = known.mapInArrow(_count, "lang string, g int, n bigint").groupBy("lang", "g").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(got["lang"].unique())
    counts = np.full((len(langs), 1 << BITS), 0.5)
    place = {x: i for i, x in enumerate(langs)}
    if langs:
        np.add.at(counts, (got["lang"].map(place).to_numpy(int), got["g"].to_numpy(int)), got["n"].to_numpy(float))
    return langs, np.log(counts / counts.sum(1, keepdims=True)).astype(np.float32)


def _mixture(like: np.ndarray, own: np.ndarray, n_docs: int, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """EM within each document's allowed languages: proportions and log likelihood (without the words' scale)."""
    theta = allowed / allowed.sum(1, keepdims=True)
    n = np.maximum(np.bincount(own, minlength=n_docs), 1)[:, None]
    for _ in range(ROUNDS):
        joint = like * theta[own]
        joint /= joint.sum(1, keepdims=True)
        theta = np.stack([np.bincount(own, weights=joint[:, k], minlength=n_docs) for k in range(like.shape[1])], 1) / n
    return theta, np.bincount(own, weights=np.log((like * theta[own]).sum(1) + 1e-30), minlength=n_docs)


def identify(texts: list[bytes], langs: list[str], model: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best language index, its proportion, and the number of languages kept, for each text."""
    n_lang = len(langs)
    best, share, kept = np.zeros(len(texts), np.int64), np.zeros(len(texts)), np.zeros(len(texts), np.int64)
    for a, b in slices(texts):
        buf, starts = pack(texts[a:b])
        buf = np.concatenate([buf[-1:], buf, np.full(2, 32, np.uint8)])
        lo, hi = word_bounds(buf)
        own = np.searchsorted(starts + 1, lo, side="right") - 1
        d = b - a
        if not len(lo):
            share[a:b], kept[a:b] = 1 / n_lang, 0
            continue
        g = trigrams(buf)
        like = np.empty((len(lo), n_lang))
        for k in range(n_lang):
            run = np.concatenate([[0.0], np.cumsum(model[k][g], dtype=np.float64)])
            like[:, k] = run[hi] - run[lo - 1]
        top = like.max(1)
        like = np.exp(np.maximum(like - top[:, None], -60))
        alone = np.stack([np.bincount(own, weights=np.log(like[:, k]), minlength=d) for k in range(n_lang)], 1)
        words = np.bincount(own, minlength=d)
        full, _ = _mixture(like, own, d, np.ones((d, n_lang)))
        order = np.argsort(-full, 1, kind="stable")
        theta = np.zeros((d, n_lang))
        one = alone.argmax(1)
        theta[np.arange(d), one] = 1
        value = alone.max(1)
        size = np.ones(d, np.int64)
        rank = np.argsort(order, 1)
        for m in range(2, n_lang + 1):
            new, like_m = _mixture(like, own, d, (rank < m).astype(float))
            like_m = like_m - (m - 1) * np.log(np.maximum(words, 2))
            better = like_m > value
            theta[better], value[better], size[better] = new[better], like_m[better], m
        best[a:b], share[a:b], kept[a:b] = theta.argmax(1), theta.max(1), size
    return best, share, kept


def predict(docs: DataFrame, langs: list[str], model: np.ndarray, text: str = "text") -> DataFrame:
    """docs plus lang_pred, score and n_langs.  Null texts and texts without a letter (or no language learned): und, 0, 0.

    Columns of docs that clash with the new ones are replaced (text may be one of them).  Repeated rows are
    predicted alike; an empty table gives none.
    """
    made = ["lang_pred", "score", "n_langs"]
    shipped = docs.sparkSession.sparkContext.broadcast((langs, model))  # 2**BITS numbers per language

    @F.pandas_udf("lang_pred string, score double, n_langs int")
    def run(column: pd.Series) -> pd.DataFrame:
        names, table = shipped.value
        known = np.array([isinstance(t, str) and _LETTER.search(t) is not None and len(names) > 0 for t in column], bool)
        out = pd.DataFrame({"lang_pred": ["und"] * len(column), "score": 0.0, "n_langs": 0})
        if known.any():
            best, share, kept = identify([t.encode() for t, ok in zip(column, known) if ok], names, table)
            out.loc[known, "lang_pred"] = [names[i] for i in best]
            out.loc[known, "score"] = np.clip(share, 0, 1)
            out.loc[known, "n_langs"] = kept
        return out

    keep = [F.col(f"`{c}`") for c in docs.columns if c not in made]
    return docs.select(*keep, run(F.col(f"`{text}`")).alias("_language")).select(*keep, *[F.col(f"_language.{c}") for c in made])
