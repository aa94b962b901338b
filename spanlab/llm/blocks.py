"""Blocks of documents, and the question-and-answer exchange between blocks and hash buckets.

A block is one row: up to about 8 MB of consecutive texts, compressed.  Blocks
live in a bucketed table of the shared folder, so that several passes over the
texts, each joined with answers, never shuffle the texts.

``ask`` sends each block's sorted distinct 64-bit keys, cut by key hash into
buckets, to one task per bucket; the bucket answers each block's keys in their
order.  Keys are distinct within a block, so a key held by a third of all
documents reaches its bucket once per block at most.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared
from .npwords import U64, mix

BLOCK_BYTES = 8 << 20
BLOCK_SCHEMA = "block bigint, first bigint, ids binary, lens binary, text binary"
NO_ID = (1 << 63) - 1  # stands for a null doc_id inside a block, never in a result


def squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(data)


def expand(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted uint64 keys: differences, byte planes, compressed."""
    step = np.diff(keys, prepend=U64(0))
    return squeeze(np.ascontiguousarray(step.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack_keys(data: bytes) -> np.ndarray:
    planes = np.frombuffer(expand(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(U64).ravel(), dtype=U64)


def pack_array(a: np.ndarray) -> bytes:
    return squeeze(np.ascontiguousarray(a).tobytes())


def unpack_array(data: bytes, dtype) -> np.ndarray:
    return np.frombuffer(expand(data), dtype)


_M = 0xFFFFFFFF


def _rotl(x: int, r: int) -> int:
    return (x << r | x >> (32 - r)) & _M


def spark_hash(value: int, width: int) -> int:
    """Spark's hash() of one int (width 4) or bigint (width 8), seed 42."""
    h = 42
    for (word,) in struct.iter_unpack("<I", value.to_bytes(width, "little", signed=True)):
        h ^= _rotl(word * 0xCC9E2D51 & _M, 15) * 0x1B873593 & _M
        h = (_rotl(h, 13) * 5 + 0xE6546B64) & _M
    h ^= width
    h = (h ^ h >> 16) * 0x85EBCA6B & _M
    h = (h ^ h >> 13) * 0xC2B2AE35 & _M
    h ^= h >> 16
    return h - (h >> 31 << 32)


def labels(parts: int) -> list[int]:
    """labels[i]: an int that repartition(parts, label) sends to partition i, so buckets never share a task by chance."""
    found: dict[int, int] = {}
    value = 0
    while len(found) < parts:
        found.setdefault(spark_hash(value, 4) % parts, value)
        value += 1
    return [found[i] for i in range(parts)]


#: A row's number: partition, block of the partition, row of the block.
_PART_SHIFT, _MADE_SHIFT = 41, 22


def _cutter(parts: int, block_bytes: int, rest: bool) -> Callable:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        made, number = 0, pid << 32
        ids: list[int] = []
        texts: list[bytes] = []
        slices: list[pa.RecordBatch] = []
        size = 0

        def row() -> pa.RecordBatch:
            nonlocal made, number
            while spark_hash(number, 8) % parts != (pid + made) % parts:
                number += 1
            out = {
                "block": pa.array([number], pa.int64()),
                "first": pa.array([pid << _PART_SHIFT | made << _MADE_SHIFT], pa.int64()),
                "ids": pa.array([np.array(ids, np.int64).tobytes()], pa.binary()),
                "lens": pa.array([np.array([len(t) for t in texts], np.int64).tobytes()], pa.binary()),
                "text": pa.array([squeeze(b"".join(texts))], pa.binary()),
            }
            if rest:
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, slices[0].schema) as to:
                    for x in slices:
                        to.write_batch(x)
                out["rest"] = pa.array([squeeze(sink.getvalue().to_pybytes())], pa.binary())
            made, number = made + 1, number + 1
            return pa.RecordBatch.from_pydict(out)

        for batch in batches:
            others = batch.select(batch.schema.names[2:])
            lo = 0
            for k, (i, t) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                ids.append(i)
                texts.append(t or b"")
                size += len(texts[-1]) + 16
                if size >= block_bytes:
                    slices.append(others.slice(lo, k + 1 - lo))
                    yield row()
                    ids, texts, slices, size, lo = [], [], [], 0, k + 1
            if lo < batch.num_rows:
                slices.append(others.slice(lo))
        if ids:
            yield row()

    return cut


class Blocks:
    """Texts of a table in blocks; ``df`` has one row per block.  A context manager: the table goes at its end.

    Rows are known by block and place (``rows``), so results find back to them without a join on ids, which may
    be null or repeated.  With ``rest`` the blocks hold all columns of docs, and ``emit`` gives rows back.
    """

    def __init__(self, docs: DataFrame, block_bytes: int = BLOCK_BYTES, rest: bool = False, text: str = "text", key: str | None = "doc_id"):
        """docs: key (null: NO_ID; None: rows have no numbers) and a text column (null: empty)."""
        spark = docs.sparkSession
        self.spark, self.parts, self.docs, self.text = spark, shared.tasks(docs), docs, text
        self.name = f"spanlab_blocks_{uuid.uuid4().hex}"
        self.path = f"{shared.folder(spark)}/{self.name}"
        others = [c for c in docs.columns if c != text] if rest else []
        flat = docs.select((F.coalesce(F.col(key).cast("bigint"), F.lit(NO_ID)) if key else F.lit(NO_ID)).alias("_i"), F.col(text).cast("binary").alias("_t"),
                           *[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(others)], *[F.col(text).isNull().alias("_null")] * rest)
        try:
            with shared.small_batches(spark):
                (flat.mapInArrow(shared.tidy(_cutter(self.parts, block_bytes, rest)), BLOCK_SCHEMA + ", rest binary" * rest)
                 .write.bucketBy(self.parts, "block").option("path", self.path).option("compression", "none").saveAsTable(self.name))
        except BaseException:
            self.close()
            raise
        self.df = spark.table(self.name)

    def __enter__(self) -> Blocks:
        return self

    def __exit__(self, *_) -> None:
        self.close()

    def close(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        shared.delete(self.spark, self.path)

    def rows(self) -> DataFrame:
        """block, row, uid (unique), doc_id (null where docs have none) of each row; reads no texts."""
        def run(batches):
            for r in rows(batches):
                ids = np.frombuffer(r["ids"], np.int64)
                place = np.arange(len(ids))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), r["block"])), pa.array(place, pa.int32()), pa.array(place + r["first"]),
                                                  pa.array(ids, mask=ids == NO_ID)], ["block", "row", "uid", "doc_id"])

        return self.df.select("block", "first", "ids").mapInArrow(run, "block bigint, row int, uid bigint, doc_id bigint")

    def told(self, facts: DataFrame, *names: str) -> DataFrame:
        """df plus ``told``: an array of (row, names) for each block, from rows (block, row, names); blocks without any have null."""
        per = facts.groupBy("block").agg(F.collect_list(F.struct("row", *names)).alias("told"))
        return self.df.join(per, "block", "left")

    def emit(self, kept: DataFrame) -> DataFrame:
        """The rows of docs that kept (block, row) names, with all their columns."""
        columns, text, schema = self.docs.columns, self.text, self.docs.schema

        def run(batches):
            for r in rows(batches):
                if r["told"]:
                    texts = unpack_block(r)[1]
                    yield restore(r, texts, sorted(x["row"] for x in r["told"]), columns, text)

        return self.told(kept).mapInArrow(shared.tidy(run), schema)


def restore(r: dict, texts: list[bytes], keep: list[int], columns: list[str], text: str) -> pa.RecordBatch:
    """Rows of a block with all columns of the table it was made of, and these texts."""
    table = pa.ipc.open_stream(expand(r["rest"])).read_all().take(keep).combine_chunks()
    null = table.column("_null").to_pylist()
    column = pa.array([None if n else texts[i] for i, n in zip(keep, null)], pa.binary()).view(pa.string())
    others = iter(table.columns)
    made = [column if c == text else next(others) for c in columns]
    made = [c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c for c in made]
    return pa.RecordBatch.from_arrays([c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in made], columns)


def unpack_block(row: dict) -> tuple[np.ndarray, list[bytes]]:
    """doc_ids and texts of a block row."""
    ids = np.frombuffer(row["ids"], np.int64)
    ends = np.cumsum(np.frombuffer(row["lens"], np.int64)).tolist()
    data = expand(row["text"])
    return ids, [data[a:b] for a, b in zip([0, *ends], ends)]


def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows of Arrow batches as dicts, one at a time."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield {n: batch.column(k)[i].as_py() for k, n in enumerate(batch.schema.names)}


def bucket_order(keys: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of sorted keys by (bucket, key), and the bounds of each bucket in it."""
    kind = np.uint16 if parts <= 1 << 16 else np.int64  # 16-bit numbers are sorted by radix
    bucket = (mix(keys ^ U64(0x5A5A_1234_9E37_79B9)) % U64(parts)).astype(kind)
    order = np.argsort(bucket, kind="stable")
    return order, np.concatenate([[0], np.cumsum(np.bincount(bucket, minlength=parts))])


MESSAGE = "kind int, label int, bucket int, block bigint, k binary, v binary"
ASKED, TOLD, TOTAL = 0, 1, 2  # kinds of message: a block's keys or the answers to them; data for buckets; sums over a bucket


def messages(k: np.ndarray, v: np.ndarray, parts: int, label: list[int], kind: int, block: int) -> pa.RecordBatch:
    """Sorted distinct keys and their bytes, one row for each bucket that gets some."""
    order, at = bucket_order(k, parts)
    k, v = k[order], v[order]
    full = [i for i in range(parts) if at[i] < at[i + 1]]
    return pa.RecordBatch.from_pydict({
        "kind": pa.array([kind] * len(full), pa.int32()),
        "label": pa.array([label[i] for i in full], pa.int32()),
        "bucket": pa.array(full, pa.int32()),
        "block": pa.array([block] * len(full), pa.int64()),
        "k": pa.array([pack_keys(k[at[i]:at[i + 1]]) for i in full], pa.binary()),
        "v": pa.array([pack_array(v[at[i]:at[i + 1]]) for i in full], pa.binary()),
    })


def one(kind: int, label: int, bucket: int, block: int, k: bytes, v: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"kind": pa.array([kind], pa.int32()), "label": pa.array([label], pa.int32()), "bucket": pa.array([bucket], pa.int32()),
                                       "block": pa.array([block], pa.int64()), "k": pa.array([k], pa.binary()), "v": pa.array([v], pa.binary())})


def ask(blocks: DataFrame, parts: int, keys: Callable, answer: Callable, told: DataFrame | None = None) -> DataFrame:
    """One round of questions.

    keys(block row) -> (sorted distinct uint64 keys, uint8 matrix with a row of bytes for each key)
    answer(bucket, kinds, list of keys arrays, list of byte matrices) -> (list of byte matrices, one row for
    each key of each ASKED message in order; data for later rounds as (keys, bytes) or None; array of sums or None)
    told: messages of kind TOLD from an earlier round, which meet the questions in their buckets.
    """
    label = labels(parts)

    def send(batches):
        for row in rows(batches):
            yield messages(*keys(row), parts, label, ASKED, row["block"])

    def reply(batches):
        got = list(rows(batches))
        if not got:
            return
        ks = [unpack_keys(r["k"]) for r in got]
        vs = [unpack_array(r["v"], np.uint8).reshape(len(k), -1) for r, k in zip(got, ks)]
        head = [(r["kind"], r["bucket"], r["block"]) for r in got]
        del got
        out, data, sums = answer(head[0][1], [h[0] for h in head], ks, vs)
        asked = [h for h in head if h[0] == ASKED]
        for (_, bucket, block), a in zip(asked, out):
            yield one(ASKED, 0, bucket, block, b"", pack_array(a))
        if data is not None and len(data[0]):
            yield messages(*data, parts, label, TOLD, -1)
        if sums is not None:
            yield one(TOTAL, 0, head[0][1], -1, b"", np.asarray(sums, np.float64).tobytes())

    sent = blocks.mapInArrow(shared.tidy(send), MESSAGE)
    if told is not None:
        sent = sent.unionByName(told)
    return sent.repartition(parts, "label").mapInArrow(shared.tidy(reply), MESSAGE)


def by_block(replies: DataFrame, name: str) -> DataFrame:
    """(block, name): each block's answers, ordered by bucket."""
    return replies.where(F.col("kind") == ASKED).groupBy("block").agg(
        F.array_sort(F.collect_list(F.struct("bucket", F.col("v").alias("a")))).alias(name))


def total(replies: DataFrame) -> np.ndarray:
    """Sum of what the buckets summed (one short row per bucket)."""
    got = replies.where(F.col("kind") == TOTAL).select("v").collect()
    return sum((np.frombuffer(r["v"], np.float64) for r in got), np.zeros(0) if not got else 0)


def merged(ks: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Sorted distinct keys of all messages, and the place of each message's keys among them."""
    u = np.sort(np.concatenate(ks))  # a sort of numbers is many times as fast as one of places
    if len(u):
        u = u[np.concatenate([[True], u[1:] != u[:-1]])]
    return u, [np.searchsorted(u, k) for k in ks]


def answered(keys: np.ndarray, answers: list[dict] | None, parts: int, width: int) -> np.ndarray:
    """The byte matrix of answers, a row for each of the block's sorted keys."""
    out = np.zeros((len(keys), width), np.uint8)
    if answers:
        order, _ = bucket_order(keys, parts)
        out[order] = np.concatenate([unpack_array(x["a"], np.uint8) for x in answers]).reshape(-1, width)
    return out
