"""Embedding near-dedup by an inverted multi-index (operator 8).

Two codebooks, one for each half of the unit vectors, form a grid of cells.
Every vector lies in the cell of its nearest codewords and, as a query, visits
cells in order of a lower bound of its distance to them (distance to the
bisecting planes, added over the halves) until the target recall; found pairs
are compared exactly.  Equal vectors are one class throughout.  Pairs don't leave
the task that finds them: a cell gives each vector's number of links and one
vector that it hangs together with, so output is linear in what was sent.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from . import shared
from .graph import components
from .npwords import U64, mix

SAMPLE = 20_000  # vectors that the codebooks are fitted on; all vectors are indexed
CELL = 256  # vectors aimed at in a cell
MOST_WORDS = 4096  # codewords of a half at most: the grid grows up to 4 billion vectors, the broadcast to 2 x 4096 half vectors
HEAVY = 8192  # a cell with more vectors is cut into slices of about so many
CLOSE = 1e-9  # cosines this near to the threshold are computed again, pair by pair


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        near = (x @ c.T * 2 - (c * c).sum(1)).argmax(1)
        n = np.bincount(near, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


class MultiIndex:
    """Codebooks of both halves and the radius that reaches the target recall."""

    def __init__(self, sample: np.ndarray, n: int, cosine: float, recall: float, seed: int = 11):
        rng = np.random.default_rng(seed)
        self.half = sample.shape[1] // 2
        k = int(min(max(1, (n / CELL) ** 0.5), MOST_WORDS, len(sample)))
        self.words = [_kmeans(h, k, rng) for h in (sample[:, :self.half], sample[:, self.half:])]
        self.k = k
        # partners at exactly the threshold in random directions: how far away do their cells look?
        x = sample[rng.integers(0, len(sample), 4000)]
        side = rng.standard_normal(x.shape)
        side -= (side * x).sum(1, keepdims=True) * x
        side /= np.maximum(np.linalg.norm(side, axis=1, keepdims=True), 1e-30)
        y = cosine * x + (1 - cosine * cosine) ** 0.5 * side
        far, near = self.bounds(x), [self.nearest(y, i) for i in (0, 1)]
        rows = np.arange(len(x))
        reach = np.quantile(far[0][rows, near[0]] + far[1][rows, near[1]], recall) if recall < 1 else np.inf
        self.radius = min(float(reach), 2 - 2 * cosine) + 1e-9  # beyond the second no partner can lie

    def part(self, x: np.ndarray, i: int) -> np.ndarray:
        return x[:, self.half:] if i else x[:, :self.half]

    def distances(self, x: np.ndarray, i: int) -> np.ndarray:
        h, c = self.part(x, i), self.words[i]
        return np.maximum((h * h).sum(1)[:, None] - 2 * h @ c.T + (c * c).sum(1), 0)

    def nearest(self, x: np.ndarray, i: int) -> np.ndarray:
        return self.distances(x, i).argmin(1)

    def bounds(self, x: np.ndarray) -> list[np.ndarray]:
        """Squared lower bound of the distance of each vector's half to the region of each codeword."""
        out = []
        for i in (0, 1):
            d, c = self.distances(x, i), self.words[i]
            a = d.argmin(1)
            norm = (c * c).sum(1)
            gap = np.sqrt(np.maximum(norm[a][:, None] - 2 * c[a] @ c.T + norm, 1e-30))
            out.append(((d - d[np.arange(len(x)), a][:, None]) / (2 * gap)) ** 2)
        return out

    def visits(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(vector, cell) of all visited cells: the sequence of sums of two sorted bounds, cut at the radius."""
        first, second = self.bounds(x)
        rank = np.argsort(second, 1)
        ordered = np.take_along_axis(second, rank, 1)
        v, a = np.nonzero(first <= self.radius)
        room = self.radius - first[v, a]
        n = (ordered[v] <= room[:, None]).sum(1)
        who = np.repeat(np.arange(len(v)), n)
        step = np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n)
        return v[who], a[who] * self.k + rank[v[who], step]


_ELEMENTS = {"array<float>": "array<float>"}  # all other numbers are compared as doubles


def _unit(flat: np.ndarray) -> np.ndarray:
    x = flat.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class _Slice:
    """The vectors of one cell, or of one slice of a heavy cell, and the queries that visit it."""

    def __init__(self, base: list[dict], kind, dim: int, cosine: float):
        self.kind, self.dim, self.cosine = kind, dim, cosine
        self.ids, self.x, self.m = self.load(base)
        n = len(self.ids)
        self.group = np.arange(n)
        self.count = np.zeros(n)
        self.joins: list[np.ndarray] = []
        lens = np.concatenate([np.frombuffer(r["lens"], np.int32) for r in base])
        self.seer, self.seen = np.repeat(np.arange(n), lens), np.concatenate([np.frombuffer(r["cells"], np.int64) for r in base])

    def load(self, got: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        read = lambda name, kind: np.concatenate([np.frombuffer(r[name], kind) for r in got])
        return read("ids", np.int64), _unit(read("vecs", self.kind).reshape(-1, self.dim)), read("m", np.int64)

    def meet(self, asking: list[dict]) -> Iterator[pa.RecordBatch]:
        ids, q, m = self.load(asking)
        homes, own = np.unique(np.concatenate([np.frombuffer(r["cells"], np.int64) for r in asking]), return_inverse=True)
        # does a vector of the slice visit the home of a query?  Then it finds the pair itself, too
        back = np.zeros((len(self.ids), len(homes)), bool)
        at = np.minimum(np.searchsorted(homes, self.seen), len(homes) - 1)
        hit = homes[at] == self.seen
        back[self.seer[hit], at[hit]] = True
        step = max(16, 2_000_000 // len(self.ids))
        for lo in range(0, len(ids), step):
            part = q[lo:lo + step]
            cos = part @ self.x.T
            i, j = np.nonzero(cos >= self.cosine - CLOSE)
            sure = cos[i, j] >= self.cosine + CLOSE
            sure[~sure] = (part[i[~sure]] * self.x[j[~sure]]).sum(1) >= self.cosine
            sure &= ids[lo + i] != self.ids[j]
            i, j = i[sure], j[sure]
            if not len(i):
                continue
            who, first = np.unique(i, return_index=True)  # nonzero goes row by row, so a query's first partner is j[first]
            n = np.bincount(i, weights=self.m[j])[who]
            self.count += np.bincount(j, weights=np.where(back[j, own[lo + i]], 0, m[lo + i]), minlength=len(self.ids))
            lead = np.repeat(j[first], np.diff(np.append(first, len(i))))
            self.joins.append(np.unique(lead * len(self.ids) + j))
            if sum(map(len, self.joins)) > 1_000_000:
                self.close()
            yield _rows(ids[lo + who], self.ids[j[first]], n)

    def close(self) -> None:
        """Take the collected joins into the groups: the smallest label wins, until nothing changes."""
        if self.joins:
            a, b = np.divmod(np.unique(np.concatenate(self.joins)), len(self.ids))
            self.joins = []
            while (self.group[a] != self.group[b]).any():
                low = np.minimum(self.group[a], self.group[b])
                for end in (self.group[a], self.group[b]):
                    np.minimum.at(self.group, end, low)
                self.group = self.group[self.group]

    def finish(self) -> pa.RecordBatch:
        self.close()
        while (self.group[self.group] != self.group).any():
            self.group = self.group[self.group]
        keep = (self.count > 0) | (self.group != np.arange(len(self.ids)))
        return _rows(self.ids[keep], self.ids[self.group[keep]], self.count[keep])


def _rows(ids: np.ndarray, to: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(to), pa.array(n.astype(np.int64))], ["id", "to", "n"])


MESSAGE = "label int, cell bigint, slice int, kind int, ids binary, vecs binary, m binary, lens binary, cells binary"


def links(vectors: DataFrame, dim: int, cosine: float = 0.95, recall: float = 0.97, index: MultiIndex | None = None, heavy: int = HEAVY) -> DataFrame:
    """vectors (id bigint, v array of dim finite floats or doubles, not all 0; m bigint, how many each stands for) -> id, to, n.

    The sum of n over an id is the number of vectors that it links with (those it stands for itself apart); the rows
    with another id in ``to`` join the same groups as all links do.  No vector has more rows than cells it visits,
    plus one.  recall: of one side's visits; a pair is found if either side visits the other, and counts once.
    """
    spark = vectors.sparkSession
    if index is None:
        sample = vectors.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toPandas()["v"]
        if not len(sample):
            return spark.createDataFrame([], "id bigint, to bigint, n bigint")
        index = MultiIndex(_unit(np.stack(sample.to_numpy())), vectors.count(), cosine, recall)
    parts = shared.tasks(vectors)
    label = B.labels(parts)
    shipped = spark.sparkContext.broadcast(index)  # at most MOST_WORDS codewords a half
    kind = {"float": np.float32, "double": np.float64}[vectors.schema["v"].dataType.elementType.simpleString()]

    def batches_of(batches, at):
        for batch in batches:
            raw = batch.column(at).flatten().to_numpy().reshape(-1, dim)
            step = max(64, 2048 * 256 // shipped.value.k)
            for lo in range(0, len(raw), step):
                yield batch.slice(lo, step), raw[lo:lo + step]

    def home_of(x):
        index = shipped.value
        return index.nearest(x, 0) * index.k + index.nearest(x, 1)

    def count(batches):
        for _, raw in batches_of(batches, 0):
            yield pa.RecordBatch.from_arrays([pa.array(home_of(_unit(raw)), pa.int64())], ["cell"])

    # at most one heavy cell for every ``heavy`` vectors
    big = vectors.select("v").mapInArrow(count, "cell bigint").groupBy("cell").count().where(F.col("count") > heavy).collect()
    slices = spark.sparkContext.broadcast({r["cell"]: -(-r["count"] // heavy) for r in big})

    def send(batches):
        index, cut_of = shipped.value, slices.value
        for batch, raw in batches_of(batches, 1):
            ids, m = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            x = _unit(raw)
            home = home_of(x)
            who, cell = index.visits(x)
            per = np.bincount(who, minlength=len(x))
            by_vector = np.argsort(who, kind="stable")
            sights = np.split(cell[by_vector], np.cumsum(per)[:-1])
            n_slices = {int(c): cut_of[int(c)] for c in np.unique(cell) if int(c) in cut_of}
            out = []

            def message(what, w, c, s):
                cells = np.concatenate([sights[i] for i in w]) if what == 0 else home[w]
                lens = per[w].astype(np.int32) if what == 0 else np.zeros(0, np.int32)
                out.append({"label": label[int(mix(np.array([c * 1_000_003 + s], U64))[0] % U64(parts))], "cell": c, "slice": s, "kind": what, "ids": ids[w].tobytes(),
                            "vecs": raw[w].tobytes(), "m": m[w].tobytes(), "lens": lens.tobytes(), "cells": cells.astype(np.int64).tobytes()})

            for what, w, c in ((0, np.arange(len(x)), home), (1, who, cell)):
                order = np.argsort(c, kind="stable")
                w, c = w[order], c[order]
                cut = np.concatenate([[0], np.flatnonzero(c[1:] != c[:-1]) + 1, [len(c)]])
                for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
                    if a == b:
                        continue
                    n = n_slices.get(int(c[a]), 1)
                    own = mix(ids[w[a:b]].view(U64)) % U64(n) if n > 1 else np.zeros(b - a, U64)
                    for s in range(n):
                        some = w[a:b] if what else w[a:b][own == s]
                        if len(some):
                            message(what, some, int(c[a]), s)
            for lo in range(0, len(out), 512):
                yield pa.RecordBatch.from_pylist(out[lo:lo + 512], schema=sent_schema)

    sent_schema = pa.schema([("label", pa.int32()), ("cell", pa.int64()), ("slice", pa.int32()), ("kind", pa.int32()), *[(n, pa.binary()) for n in ("ids", "vecs", "m", "lens", "cells")]])

    def meet(batches):
        """Rows come by cell, slice and kind: vectors before queries, so that queries needn't be kept."""
        key, base, asking, size, own = None, [], [], 0, None
        for row in chain(B.rows(batches), [None]):
            now = row and (row["cell"], row["slice"])
            if asking and (now != key or size >= 1024):
                if base and own is None:
                    own = _Slice(base, kind, dim, cosine)
                if own is not None:
                    yield from own.meet(asking)
                asking, size = [], 0
            if now != key:
                if own is not None:
                    yield own.finish()
                key, base, own = now, [], None
            if row is not None and row["kind"] == 0:
                base.append(row)
            elif row is not None:
                asking.append(row)
                size += len(row["ids"]) // 8

    sent = vectors.select("id", "v", F.col("m").cast("bigint")).mapInArrow(send, MESSAGE)
    return sent.repartition(parts, "label").sortWithinPartitions("cell", "slice", "kind").mapInArrow(meet, "id bigint, to bigint, n bigint")


def dedup(vectors: DataFrame, cosine: float = 0.95, recall: float = 0.97, heavy: int = HEAVY) -> DataFrame:
    """vectors (vec_id, embedding) -> vec_id, n_links, component_id, kept.

    Null, empty or zero vectors and those with null or non-finite parts link
    with nothing; neither do vectors of different lengths.  Equal vectors link
    with each other, and each counts.  A null vec_id counts as the largest
    bigint and comes back null, kept false.  Other columns are ignored.
    A cell of more than ``heavy`` different vectors is compared in slices, by
    several tasks.
    """
    top = (1 << 63) - 1
    base = vectors.select(F.coalesce(F.col("vec_id").cast("bigint"), F.lit(top)).alias("vec_id"), F.col("embedding").cast(_ELEMENTS.get(vectors.schema["embedding"].dataType.simpleString(), "array<double>")).alias("v"))
    sound = F.coalesce(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0), F.lit(False))
    base = shared.put(base.select("vec_id", F.when(sound, F.col("v")).alias("v")), "vectors")
    classes = shared.put(base.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("id"), F.count("*").alias("m")), "classes")
    found = None
    for (dim,) in sorted(classes.select(F.size("v")).distinct().collect()):
        own = links(classes.where(F.size("v") == dim), dim, cosine, recall, heavy=heavy)
        found = own if found is None else found.unionByName(own)
    if found is None:
        found = base.sparkSession.createDataFrame([], "id bigint, to bigint, n bigint")
    found = shared.put(found, "links")
    group = components(found.select(F.col("id").alias("a"), F.col("to").alias("b")))
    count = found.groupBy("id").agg(F.sum("n").alias("others"))
    about = classes.join(count, "id", "left").join(group, "id", "left").select(
        "v", (F.coalesce("others", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    out = base.join(about, "v", "left").select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.select(F.when(F.col("vec_id") != top, F.col("vec_id")).alias("vec_id"), "n_links", "component_id",
                      ((F.col("vec_id") == F.col("component_id")) & (F.col("vec_id") != top)).alias("kept"))
