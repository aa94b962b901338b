"""Byte-level BPE by corpus-level merge replay (operator 1).

Texts are written once as blocks.  Each block sends its distinct words that are
no token themselves to hash buckets, so that a word of the corpus is replayed
once, whatever the number of texts that hold it.  A bucket merges its distinct
words together: an inverted index maps each mergeable token pair to the word
positions that hold it, merges are applied in rank order, and a merge touches
only the two neighbours of each position.  The ids go back to the blocks.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from . import shared
from .npwords import slices

#: Bytes of distinct words of a bucket that are merged together; bounds a replay's memory.
REPLAY_BYTES = 1 << 20


def load_ranks(path: str) -> dict[bytes, int]:
    """A tiktoken vocabulary file: base64 token and rank per line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


_BIT = 32  # a pair of ids is one integer: left << _BIT | right


class Replay:
    """Merges for a vocabulary; ``words`` encodes many distinct byte strings at once."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.byte = [ranks[bytes([i])] for i in range(256)]
        get = ranks.get
        self.pair: dict[int, int] = {}  # every pair of tokens that merges, and the rank of what it makes
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = get(token[:cut]), get(token[cut:])
                if a is not None and b is not None:
                    self.pair[a << _BIT | b] = rank

    def words(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word: the same as merging each word's lowest-ranked, leftmost pair until none is left."""
        ranks, byte, pair = self.ranks, self.byte, self.pair.get
        out: list = [None] * len(words)
        ids: list[int] = []
        bounds: list[tuple[int, int, int]] = []
        where: dict[int, list[int]] = {}  # the inverted index: token pair -> positions of its left part
        makers: dict[int, list[int]] = {}  # rank -> pairs of the index that make it
        heap: list[int] = []
        push = heapq.heappush

        def note(key: int, rank: int, at: int) -> None:
            if key in where:
                where[key].append(at)
                return
            where[key] = [at]
            if rank in makers:
                makers[rank].append(key)
            else:
                makers[rank] = [key]
                push(heap, rank)

        for n, w in enumerate(words):
            whole = ranks.get(w)
            if whole is not None:
                out[n] = [whole]
                continue
            at = len(ids)
            row = [byte[x] for x in w]
            ids += row
            ids.append(-1)  # ends the word: merges with nothing
            bounds.append((n, at, len(ids) - 1))
            for at, (a, b) in enumerate(zip(row, row[1:]), at):
                key = a << _BIT | b
                r = pair(key)
                if r is not None:
                    note(key, r, at)
        left = list(range(-1, len(ids) - 1))
        right = list(range(1, len(ids) + 1))
        while heap:
            r = heapq.heappop(heap)
            spots = sorted(p for key in makers.pop(r) for p in where.pop(key))
            stop = -1  # up to here the word waits: a lower merge has just appeared in it
            later: list[int] = []
            for p in spots:
                a = ids[p]
                if a < 0:
                    continue
                q = right[p]
                b = ids[q]
                if b < 0 or pair(a << _BIT | b) != r:
                    continue
                if p < stop:
                    later.append(p)
                    continue
                s = right[q]
                ids[p], ids[q] = r, -2
                right[p] = s
                left[s] = p
                c = ids[s]
                lower = False
                if c >= 0:
                    key = r << _BIT | c
                    x = pair(key)
                    if x is not None:
                        note(key, x, p)
                        lower = x < r
                o = left[p]
                if o >= 0 and ids[o] >= 0:
                    key = ids[o] << _BIT | r
                    x = pair(key)
                    if x is not None:
                        note(key, x, o)
                        lower = lower or x < r
                if lower:
                    stop = s
                    while ids[stop] != -1:
                        stop = right[stop]
            for p in later:
                note(ids[p] << _BIT | ids[right[p]], r, p)
        for n, a, b in bounds:
            out[n] = [x for x in ids[a:b] if x >= 0]
        return out


#: Letters, numbers and white space among code points below 0x280, where a text's UTF-8 has no byte above 0xC9.
_LOW = {r"\p{L}": "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u027f", r"\p{N}": "0-9\xb2\xb3\xb9\xbc-\xbe", r"\s": "\t-\r \x85\xa0"}


def low_pattern(pattern: str) -> str | None:
    """The same pattern for code points below 0x280, with explicit ranges; None if it holds other classes."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        for name, chars in _LOW.items():
            if pattern.startswith(name, i):
                out.append(chars if inside else f"[{chars}]")
                i += len(name)
                break
        else:
            c = pattern[i]
            if pattern.startswith(r"\S", i) and not inside:
                out.append(f"[^{_LOW[chr(92) + 's']}]")
                i += 2
                continue
            if c == "\\":
                return None
            inside = c == "[" or inside and c != "]"
            out.append(c)
            i += 1
    return "".join(out)


def _is_text(token: bytes) -> bool:
    try:
        return bool(token.decode())
    except UnicodeDecodeError:
        return False


class Codec:
    """Splits texts, merges words that are no tokens, encodes by words whose ids are known, and decodes ids."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.replay, self.find = Replay(ranks), regex.compile(pattern).findall
        low = low_pattern(pattern)
        self.find_low = re.compile(low).findall if low else None
        self.whole = {t.decode(): r.to_bytes(4, "little") for t, r in ranks.items() if _is_text(t)}
        tokens = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            tokens[r] = t
        self.size = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.blob = np.frombuffer(b"".join(tokens), np.uint8)

    def split(self, text: str) -> list[str]:
        if self.find_low and (not text or np.frombuffer(text.encode(), np.uint8).max() < 0xCA):
            return self.find_low(text)
        return self.find(text)

    def unknown(self, split: Iterable[list[str]]) -> set[str]:
        """Distinct words of split texts that are no token."""
        out: set[str] = set()
        for words in split:  # one text's words at a time
            out.update(words)
        return out - self.whole.keys()

    def halfway(self, words: list[str], new: dict[str, str]) -> list[bytes | str]:
        """A split text with ids in place of tokens; other words stay, as one object each, the keys of new."""
        get, same = self.whole.get, new.setdefault
        return [get(w) or same(w, w) for w in words]

    def merge(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word; about REPLAY_BYTES of words are replayed together."""
        return [ids for a, b in slices(words, REPLAY_BYTES) for ids in self.replay.words(words[a:b])]

    def encode(self, split: Iterable[list[str]], ids: dict[str, bytes]) -> Iterator[bytes]:
        """Ids of each split text as little-endian unsigned 32-bit integers, from those of its words that are no token."""
        new: dict[str, str] = {}
        return (self.finish(self.halfway(words, new), ids) for words in split)

    def finish(self, half: list[bytes | str], ids: dict[str, bytes]) -> bytes:
        """Ids of a text that is halfway, from those of its other words."""
        return b"".join([x if x.__class__ is bytes else ids[x] for x in half])

    def decode(self, ids: bytes) -> bytes:
        i = np.frombuffer(ids, "<u4")
        n = self.size[i]
        return self.blob[np.repeat(self.start[i] - np.cumsum(n) + n, n) + np.arange(n.sum())].tobytes()


_codecs: dict[tuple[int, str], Codec] = {}


def codec(ranks: dict[bytes, int], pattern: str) -> Codec:
    """The worker's codec, kept between tasks."""
    key = (hash(frozenset(ranks.items())), pattern)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(ranks, pattern)
    return _codecs[key]


def _by_bucket(words: Iterable[str], parts: int) -> list[list[bytes]]:
    """Sorted UTF-8 words of each hash bucket."""
    out: list[list[bytes]] = [[] for _ in range(parts)]
    for w in sorted(w.encode() for w in words):
        out[zlib.crc32(w) % parts].append(w)
    return out


def _pack_words(words: list[bytes]) -> tuple[bytes, bytes]:
    return B.pack_array(np.array([len(w) for w in words], "<u4")), B.squeeze(b"".join(words))


def _unpack_words(lens: bytes, data: bytes) -> list[bytes]:
    ends = np.cumsum(B.unpack_array(lens, "<u4"), dtype=np.int64).tolist()
    data = B.expand(data)
    return [data[a:b] for a, b in zip([0, *ends], ends)]


def _merged(store: B.Blocks, tool: Callable[[], Codec]) -> DataFrame:
    """Messages from buckets to blocks: of each word that a block asked about the number of ids, then all ids."""
    parts = store.parts
    label = B.labels(parts)

    def send(batches):
        codec = tool()
        for row in B.rows(batches):
            words = codec.unknown(codec.split(t.decode()) for t in B.unpack_block(row)[1])
            for bucket, some in enumerate(_by_bucket(words, parts)):
                if some:
                    yield B.one(B.ASKED, label[bucket], bucket, row["block"], *_pack_words(some))

    def reply(batches):
        got = [(r["bucket"], r["block"], _unpack_words(r["k"], r["v"])) for r in B.rows(batches)]
        words = sorted(set().union(*(w for _, _, w in got)))
        known = {w: np.array(ids, "<u4") for w, ids in zip(words, tool().merge(words))}
        for bucket, block, asked in got:
            ids = [known[w] for w in asked]
            yield B.one(B.ASKED, 0, bucket, block, b"", B.pack_array(np.concatenate([np.array([len(x) for x in ids], "<u4"), *ids])))

    return store.df.mapInArrow(shared.tidy(send), B.MESSAGE).repartition(parts, "label").mapInArrow(shared.tidy(reply), B.MESSAGE)


def _known(words: list[list[bytes]], answers: list[dict] | None) -> dict[str, bytes]:
    """Ids of a block's words by bucket, from the buckets' answers."""
    out = {}
    for a in answers or []:
        asked = words[a["bucket"]]
        got = B.unpack_array(a["a"], "<u4")
        ends = (4 * np.cumsum(got[:len(asked)], dtype=np.int64)).tolist()
        data = got[len(asked):].tobytes()
        out |= {w.decode(): data[x:y] for w, x, y in zip(asked, [0, *ends], ends)}
    return out


def encode(docs: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", keep_ids: bool = True, keep_text: bool = True,
           block_bytes: int = B.BLOCK_BYTES) -> DataFrame:
    """docs plus n_tokens, ids (array<int>, only if keep_ids), ids_sha256, decoded_sha256; without text unless keep_text.

    Null text counts as empty: no ids, digests of nothing; it stays null.
    Columns of docs that clash with the new ones are replaced.  Rows are
    known by block and place, so repeated rows, null ids or none, and empty
    tables need no care; a text of any length is encoded whole.  The result
    is written to the shared folder.
    """
    made = ["n_tokens", "ids", "ids_sha256", "decoded_sha256"]
    docs = docs.drop(*[c for c in docs.columns if c in made and c != text])
    shipped = docs.sparkSession.sparkContext.broadcast(ranks)  # a vocabulary: fixed size

    def tool() -> Codec:
        return codec(shipped.value, pattern)

    columns = docs.columns
    with B.Blocks(docs, block_bytes, rest=True, text=text, key=None) as store:
        parts = store.parts
        got = shared.put(_merged(store, tool), "merges")

        def finish(batches):
            codec = tool()
            for row in B.rows(batches):
                raw = B.unpack_block(row)[1]
                new: dict[str, str] = {}
                half = [codec.halfway(codec.split(t.decode()), new) for t in raw]  # a text's words are strings one text at a time
                known = _known(_by_bucket(new, parts), row["merges"])
                out: dict[str, list] = {name: [] for name in made}
                for x in (codec.finish(h, known) for h in half):
                    out["n_tokens"].append(len(x) // 4)
                    out["ids"].append(np.frombuffer(x, "<i4") if keep_ids else None)
                    out["ids_sha256"].append(hashlib.sha256(x).hexdigest())
                    out["decoded_sha256"].append(hashlib.sha256(codec.decode(x)).hexdigest())
                kinds = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32())}
                old = B.restore(row, raw, list(range(len(raw))), columns, text)
                cells = {name: old.column(i) for i, name in enumerate(columns) if keep_text or name != text}
                cells |= {name: pa.array(out[name], kinds.get(name, pa.string())) for name in made if keep_ids or name != "ids"}
                yield pa.RecordBatch.from_arrays(list(cells.values()), list(cells))

        schema = "struct<" + ",".join([f"`{f.name}`:{f.dataType.simpleString()}" for f in docs.schema if keep_text or f.name != text]
                                      + ["n_tokens:bigint"] + ["ids:array<int>"] * keep_ids + ["ids_sha256:string", "decoded_sha256:string"]) + ">"
        done = shared.put(store.df.join(B.by_block(got, "merges"), "block", "left").mapInArrow(shared.tidy(finish), schema), "tokens")
        shared.drop(got)
    return done


def decode(encoded: DataFrame, ranks: dict[bytes, int], ids: str = "ids") -> DataFrame:
    """encoded plus decoded (binary), from an array<int> column; null ids: null."""
    shipped = encoded.sparkSession.sparkContext.broadcast(ranks)

    @F.pandas_udf("binary")
    def run(column):
        tool = codec(shipped.value, "")
        return column.map(lambda x: None if x is None else tool.decode(np.asarray(x, "<u4").tobytes()))

    return encoded.withColumn("decoded", run(ids))
