"""Media columns: interleaved sequences of text and media (operator 5).

HTML parsing gives each page an array of items in order: text, or a reference
to media by digest with its caption.  A digest join resolves the payloads; only
page number and position travel with a reference, and what was found goes back
into the item at that position, so order and captions stay aligned whatever the
join does.  Media are binary PNG files, 8-bit grey.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared

WIDTH = 192
_SIGN = b"\x89PNG\r\n\x1a\n"
ITEMS = "array<struct<position:int,kind:string,text:string,digest:string,caption:string>>"
_ITEMS = pa.list_(pa.struct([("position", pa.int32()), *[(name, pa.string()) for name in ("kind", "text", "digest", "caption")]]))


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def pad(data: bytes) -> bytes:
    """data with spaces up to a positive multiple of WIDTH."""
    return data + b" " * ((-len(data)) % WIDTH or WIDTH * (not data))


def to_png(payload: bytes) -> bytes:
    """8-bit grey PNG, WIDTH samples a row, no filter; lossless and the same for equal payloads."""
    rows = np.zeros((len(payload) // WIDTH, WIDTH + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _SIGN + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 4)) + _chunk(b"IEND", b"")


def from_png(data: bytes) -> bytes:
    """Samples of a PNG of to_png's kind (8-bit grey, unfiltered rows); checks every chunk's CRC."""
    if data[:8] != _SIGN:
        raise ValueError("not a PNG file")
    at, width, packed = 8, 0, []
    while at < len(data):
        (n,), kind = struct.unpack_from(">I", data, at), data[at + 4:at + 8]
        body = data[at + 8:at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", data, at + 8 + n)[0]:
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            width, _, depth, colour = struct.unpack_from(">IIBB", body)
            if (depth, colour) != (8, 0):
                raise ValueError("not 8-bit grey")
        elif kind == b"IDAT":
            packed.append(body)
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(-1, width + 1)
    if rows[:, 0].any():
        raise ValueError("filtered rows are not supported")
    return rows[:, 1:].tobytes()


def feature(payload: bytes) -> str:
    """Mean, deviation and number of distinct samples, and the mean change between neighbours."""
    x = np.frombuffer(payload, np.uint8)
    counts = np.bincount(x, minlength=256)
    levels = np.arange(256)
    mean = float(counts @ levels) / len(x)
    spread = max(float(counts @ (levels * levels)) / len(x) - mean * mean, 0.0) ** 0.5
    step = float(np.abs(np.diff(x.astype(np.int16))).mean())
    return f"mean={mean:.4f};sd={spread:.4f};levels={int((counts > 0).sum())};step={step:.4f}"


class _Sequence(HTMLParser):
    """Text runs and media references in document order; script and style are skipped; figcaption belongs to its figure."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.items: list[dict] = []
        self.run: list[str] = []
        self.skip = 0
        self.figure: list[int] = []
        self.caption: list[str] | None = None

    def flush(self) -> None:
        text = " ".join("".join(self.run).split())
        self.run = []
        if text:
            self.items.append({"kind": "text", "text": text, "digest": None, "caption": None})

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style"):
            self.skip += 1
        elif tag == "figure":
            self.flush()
            self.figure.append(len(self.items))
        elif tag == "figcaption":
            self.caption = []
        elif tag in ("img", "audio", "video", "source"):
            src = dict(attrs).get("src") or ""
            self.flush()
            self.items.append({"kind": "media", "text": None, "digest": src.removeprefix("sha256:"), "caption": dict(attrs).get("alt")})
        elif tag in ("p", "div", "br", "li", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "tr", "table", "ul", "ol", "nav"):
            self.flush()

    def handle_endtag(self, tag):
        if tag in ("script", "style"):
            self.skip = max(0, self.skip - 1)
        elif tag == "figcaption" and self.caption is not None:
            text = " ".join("".join(self.caption).split())
            for item in self.items[self.figure[-1] if self.figure else len(self.items):]:
                if item["kind"] == "media":
                    item["caption"] = text
            self.caption = None
        elif tag == "figure":
            self.flush()
            if self.figure:
                self.figure.pop()
        elif tag in ("p", "div", "li", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "tr", "table", "ul", "ol", "nav"):
            self.flush()

    def handle_data(self, data):
        if not self.skip:
            (self.run if self.caption is None else self.caption).append(data)


def sequence(html: str | None) -> list[dict]:
    """Ordered items of a page; a caption that follows its media inside a figure is attached to it.  Null or empty: none."""
    parser = _Sequence()
    parser.feed(html or "")
    parser.close()
    parser.flush()
    return [item | {"position": i} for i, item in enumerate(parser.items)]


def parse(pages: DataFrame, key: str, html: str) -> DataFrame:
    """pages -> page, key, items: one row per page, with its ordered items as an array of structs.

    ``page`` numbers the rows, so null and repeated keys do no harm.  Null or
    empty html has no items.  The rows are written to the shared folder, as a
    number must not change when a task runs again.
    """
    kind = pages.select(F.col(key).alias("key")).schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 41
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                items = [sequence(h) for h in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([pa.array(range(number, number + len(items)), pa.int64()), part.column(0), pa.array(items, _ITEMS)], ["page", "key", "items"])
                number += len(items)

    made = pages.select(F.col(key).alias("key"), F.col(html).alias("html")).mapInArrow(shared.tidy(run), f"page bigint, key {kind}, items {ITEMS}")
    return shared.put(made, "pages").withColumnRenamed("key", key)


def store(docs: DataFrame, text: str = "text") -> DataFrame:
    """Texts as media: digest (SHA-256 of the UTF-8 bytes; null: empty), n_bytes (of the text), media (PNG bytes of the padded text).

    A task repeats few texts; ``resolve`` makes one row per digest of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            out = {"digest": [], "n_bytes": [], "media": []}
            for data in batch.column(0).to_pylist():
                data = data or b""
                mark = hashlib.sha256(data).digest()
                if mark in seen:
                    continue
                if len(seen) > 1_000_000:
                    seen.clear()
                seen.add(mark)
                out["digest"].append(mark.hex())
                out["n_bytes"].append(len(data))
                out["media"].append(to_png(pad(data)))
                if sum(map(len, out["media"][-64:])) > 16 << 20 or len(out["media"]) >= 256:
                    yield _batch(out)
                    out = {"digest": [], "n_bytes": [], "media": []}
            if out["digest"]:
                yield _batch(out)

    return docs.select(F.col(text).cast("binary")).mapInArrow(shared.tidy(run), "digest string, n_bytes bigint, media binary")


def _batch(out: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"digest": pa.array(out["digest"]), "n_bytes": pa.array(out["n_bytes"], pa.int64()), "media": pa.array(out["media"], pa.binary())})


FACTS = "digest string, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"


def examine(media: DataFrame) -> DataFrame:
    """digest, n_bytes, media -> facts of each media; all but n_bytes from the samples read back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = []
            for digest, n, data in zip(*batch.columns):
                data = data.as_py()
                payload = from_png(data)
                got.append((digest.as_py(), n.as_py(), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), feature(payload)))
            if got:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*got)], [c.split(" ")[0] for c in FACTS.split(", ")])

    return media.select("digest", "n_bytes", "media").mapInArrow(shared.tidy(run), FACTS)


def page_of(docs: DataFrame, text: str = "text") -> DataFrame:
    """A page for each document that shows its text as a figure between two lines: doc_id, html.  Texts stay in the JVM."""
    i = F.col("doc_id").cast("bigint")
    name, mark = F.coalesce(i.cast("string"), F.lit("None")), F.sha2(F.coalesce(F.col(text).cast("binary"), F.lit(b"")), 256)
    return docs.select(i.alias("doc_id"), F.concat(
        F.lit("<article><h1>Document "), name, F.lit('</h1><figure><img src="sha256:'), mark, F.lit('"><figcaption>text of document '), name,
        F.lit("</figcaption></figure><p>end</p></article>")).alias("html"))


def resolve(pages: DataFrame, media: DataFrame) -> DataFrame:
    """parse()'s pages with a field ``media`` in each item: the facts of its media; null for texts and unresolved references.

    Facts are written to the shared folder, so media reach Python in small batches.
    """
    one = media.groupBy("digest").agg(F.first(F.struct("n_bytes", "media")).alias("_m")).select("digest", "_m.*")
    facts = shared.put(examine(one), "facts")
    asked = pages.select("page", F.explode(F.filter("items", lambda i: i["kind"] == "media")).alias("_i")).select("page", "_i.position", "_i.digest")
    found = asked.join(facts, "digest").groupBy("page").agg(F.map_from_entries(F.collect_list(F.struct("position", F.struct(*facts.columns[1:])))).alias("_found"))
    return pages.join(found, "page", "left").withColumn(
        "items", F.transform("items", lambda i: i.withField("media", F.col("_found")[i["position"]]))).drop("_found")
