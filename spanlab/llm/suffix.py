"""Suffix-array dedup (operator 2): bytes covered by a 50-byte string that an earlier document also has.

Every 50-byte string belongs to the bucket of its least 16-byte hash, so equal
strings meet.  A first round of questions finds the least hashes that stand in
two documents; only stretches of text around those travel.  Each bucket sorts
the suffixes of its stretches in two stages: suffixes smaller than their
successors are sorted directly, the others are induced by scanning the
character buckets.  Adjacent common prefixes of 50 bytes then show, for each
string, the smallest document that has it.  The number of buckets follows the
number of blocks, and a bucket sorts a few megabytes at a time.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from . import shared
from .npwords import U64, mix, pack, slices

WINDOW, GRAM = 50, 16
NO_ID = B.NO_ID  # a null doc_id: after all others
#: Bytes of stretches that are sorted together, whatever a bucket holds; and the parts of a bucket by least hash.
SORT_BYTES, SUBS = 4 << 20, 256
_STEP = 1 << 14  # places that become Python numbers together


def least_hashes(buf: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Least hash of the GRAM-byte strings within each window of bytes."""
    n = len(buf)
    if n < window:
        return np.zeros(0, U64)
    word = np.ndarray((n - 7,), "<u8", buf.tobytes(), strides=(1,))
    h = mix(word[: n - 15] * U64(0x9E37_79B9_7F4A_7C15) ^ mix(word[8:] + U64(0x1234_5678_9ABC_DEF1)))
    need, have = window - GRAM + 1, 1
    while have * 2 <= need:
        h = np.minimum(h[:-have], h[have:])
        have *= 2
    return np.minimum(h[: n - window + 1], h[need - have: need - have + n - window + 1]) if have < need else h


def stretches(texts: list[bytes], window: int = WINDOW):
    """Runs of neighbouring windows with one least hash: text number, first window, number of windows, hash."""
    out = []
    for a, b in slices(texts):
        buf, starts = pack(texts[a:b])
        low = least_hashes(buf, window)
        if not len(low):
            continue
        own = np.repeat(np.arange(b - a), np.diff(starts))[: len(low)]
        ok = np.arange(len(low)) + window < starts[own + 1]
        edge = np.flatnonzero((low[1:] != low[:-1]) | (own[1:] != own[:-1]) | (ok[1:] != ok[:-1])) + 1
        first = np.concatenate([[0], edge])
        size = np.diff(np.concatenate([first, [len(low)]]))
        keep = ok[first]
        first, size = first[keep], size[keep]
        out.append((own[first] + a, first - starts[own[first]], size, low[first]))
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, U64)
    return tuple(np.concatenate(c) for c in zip(*out))


def _words(text: np.ndarray, at: np.ndarray, k: int, depth: int) -> np.ndarray:
    """Bytes 8k to 8k+7 from each place, big-endian, cut off at depth.  text needs depth + 8 bytes of padding."""
    view = np.ndarray((len(text) - 7,), ">u8", text, strides=(1,))
    w = view[at + 8 * k].astype(U64)
    over = 8 * (k + 1) - depth
    return w >> U64(8 * over) if over > 0 else w


def _direct(text: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Places ordered by their first depth bytes: by 8 bytes, then ties by the next 8, and so on."""
    key = _words(text, at, 0, depth)
    order = np.argsort(key, kind="stable")
    at, key = at[order], key[order]
    new = np.concatenate([[True], key[1:] != key[:-1]]) if len(at) else np.zeros(0, bool)
    for k in range(1, -(-depth // 8)):
        group = np.cumsum(new)
        tied = ~new
        tied[:-1] |= ~new[1:]
        spot = np.flatnonzero(tied)
        if not len(spot):
            break
        key = _words(text, at[spot], k, depth)
        order = np.lexsort((key, group[spot]))
        at[spot] = at[spot][order]
        key, own = key[order], group[spot]
        fresh = np.concatenate([[True], (key[1:] != key[:-1]) | (own[1:] != own[:-1])])
        new[spot] |= fresh
    return at


def two_stage(text: np.ndarray, valid: np.ndarray, depth: int = WINDOW) -> np.ndarray:
    """Valid places of text ordered by their first depth bytes (ties in any order).

    text: uint8, padded with depth + 8 bytes; valid: mask over text.
    """
    n = len(text)
    up = np.zeros(n, bool)  # suffix smaller than its successor
    up[:-1] = text[1:] > text[:-1]
    same = np.flatnonzero(text[1:] == text[:-1])
    if len(same):  # inside a run of one byte: as at the run's end
        last = np.append(np.flatnonzero(np.diff(same) > 1), len(same) - 1)
        up[same] = np.repeat(up[same[last] + 1], np.diff(np.concatenate([[-1], last])))
    member = valid.copy()
    front = np.flatnonzero(valid[:-1] & ~valid[1:])
    for _ in range(depth):  # successors that the induction needs, up to one that is sorted directly
        front = front[~up[front]] + 1
        front = front[(front < n) & ~member[np.minimum(front, n - 1)]]
        if not len(front):
            break
        member[front] = True
    up[front] = True
    if valid[-1]:
        up[-1] = True
    safe = n - depth - 8
    direct = np.flatnonzero(member & up)
    tail = direct[direct >= safe]
    head = _direct(text, direct[direct < safe], depth)
    induced = member & ~up
    bound = np.searchsorted(text[head], np.arange(257))
    queue: list[list[np.ndarray]] = [[] for _ in range(256)]
    for t in tail:  # only padding: places that no valid suffix depends on
        queue[text[t]].append(np.array([t]))
    out = []
    for c in range(256):
        wave = np.concatenate(queue[c]) if queue[c] else np.zeros(0, np.int64)
        mine = [wave]
        while len(wave):
            wave = wave[wave > 0] - 1
            wave = wave[induced[wave] & (text[wave] == c)]
            mine.append(wave)
        mine.append(head[bound[c]:bound[c + 1]])
        bucket = np.concatenate(mine)
        queue[c] = []
        if not len(bucket):
            continue
        out.append(bucket)
        before = bucket[bucket > 0] - 1
        before = before[induced[before] & (text[before] > c)]
        if len(before):
            char = text[before]
            order = np.argsort(char, kind="stable")
            before, char = before[order], char[order]
            cut = np.flatnonzero(char[1:] != char[:-1]) + 1
            for piece in np.split(before, cut):
                queue[text[piece[0]]].append(piece)
    found = np.concatenate(out) if out else np.zeros(0, np.int64)
    return found[valid[found]]


def _classes(text: np.ndarray, count: int, window: int) -> np.ndarray:
    """A number under count (256 at most) for each place of text, the same for equal windows.  text needs window + 8 bytes of padding."""
    out = np.zeros(len(text), np.uint8)
    n = len(text) - window - 8
    for a in range(0, n, 1 << 18):
        at = np.arange(a, min(a + (1 << 18), n))
        h = np.zeros(len(at), U64)
        for k in range(-(-window // 8)):
            h = mix(h ^ _words(text, at, k, window))
        out[at] = h % U64(count)
    return out


def earlier(pieces: list[bytes], docs: np.ndarray, window: int = WINDOW, limit: int = SORT_BYTES) -> list[np.ndarray]:
    """For each piece, for each of its windows: does the string also stand in a piece of a smaller document?

    Over limit bytes of distinct pieces, windows are dealt by content to rounds that sort about limit places each.
    """
    first: dict[bytes, int] = {}
    same = np.fromiter((first.setdefault(p, len(first)) for p in pieces), np.int64, len(pieces))
    least = np.full(len(first), NO_ID)
    np.minimum.at(least, same, docs)
    whole = list(first)
    text = np.frombuffer(b"".join(whole) + bytes(window + 8), np.uint8)
    size = np.array([len(p) for p in whole], np.int64)
    start = np.cumsum(size) - size
    valid = np.zeros(len(text), bool)
    valid[: size.sum()] = True
    for k in range(1, window):
        valid[start + size - k] = False
    rounds = min(-(-int(size.sum()) // limit), 256)
    kind = _classes(text, rounds, window) if rounds > 1 else None
    hit = np.zeros(len(text), bool)
    for i in range(rounds):
        order = two_stage(text, valid if kind is None else valid & (kind == i), window)
        alike = np.ones(max(len(order) - 1, 0), bool)  # adjacent common prefix of window bytes
        for k in range(-(-window // 8)):
            spot = np.flatnonzero(alike)
            alike[spot] = _words(text, order[spot], k, window) == _words(text, order[spot + 1], k, window)
        head = np.concatenate([[0], np.flatnonzero(~alike) + 1]) if len(order) else np.zeros(0, np.int64)
        doc = least[np.searchsorted(start, order, "right") - 1] if rounds > 1 else np.repeat(least, size)[order]
        low = np.minimum.reduceat(doc, head) if len(order) else doc
        hit[order] = np.repeat(low, np.diff(np.concatenate([head, [len(order)]]))) < doc
    out = []
    for p, s, d in zip(pieces, same, docs):
        n = len(p) - window + 1
        out.append(np.ones(n, bool) if d > least[s] else hit[start[s]: start[s] + n])
    return out


def _ask_keys(window):
    def keys(row):
        ids, texts = B.unpack_block(row)
        own, _, _, low = stretches(texts, window)
        doc = ids[own]
        order = np.lexsort((doc, low))
        low, doc = low[order], doc[order]
        new = np.concatenate([[True], low[1:] != low[:-1]]) if len(low) else np.zeros(0, bool)
        head = np.flatnonzero(new)
        u = low[head]
        last = np.concatenate([head[1:], [len(low)]]) - 1 if len(low) else head
        return u, (doc[head] != doc[last]).astype(np.uint8)[:, None]

    return keys


def _shared_keys(bucket, kinds, ks, vs):
    u, place = B.merged(ks)
    n = np.bincount(np.concatenate(place), minlength=len(u)) + np.bincount(np.concatenate(place), weights=np.concatenate(vs)[:, 0], minlength=len(u))
    both = (n >= 2).astype(np.uint8)
    return [both[p][:, None] for p in place], None, None


def answers(messages: list[tuple[bytes, bytes]], window: int = WINDOW, limit: int = SORT_BYTES) -> list[bytes]:
    """For each message of a bucket (pieces by ascending sub-bucket), which windows of its pieces are ``earlier``.

    Equal windows are in one sub-bucket; neighbouring ones of about limit bytes together are worked on at a time.
    """
    heads, data, ends = [], [], []
    for k, v in messages:
        heads.append(B.unpack_array(k, np.int64).reshape(3, -1))
        data.append(B.expand(v))
        ends.append(np.cumsum(heads[-1][0]))
    held = np.zeros(SUBS)
    for size, _, sub in heads:
        held += np.bincount(sub, weights=size, minlength=SUBS)
    cuts, some = [0], 0
    for i, n in enumerate(held.tolist()):
        if some and some + n > limit:
            cuts.append(i)
            some = 0
        some += n
    at = [np.searchsorted(h[2], [*cuts, SUBS]).tolist() for h in heads]
    out: list[list[np.ndarray]] = [[] for _ in heads]
    for i in range(len(cuts)):
        pieces, who, counts = [], [], []
        for h, d, e, spot in zip(heads, data, ends, at):
            a, b = spot[i], spot[i + 1]
            stop = e[a:b].tolist()
            pieces += [d[x:y] for x, y in zip([int(e[a - 1]) if a else 0, *stop], stop)]
            who.append(h[1, a:b])
            counts.append(b - a)
        if not pieces:
            continue
        hits = earlier(pieces, np.concatenate(who), window, limit)
        done = 0
        for n, o in zip(counts, out):
            if n:
                o.append(np.concatenate(hits[done:done + n]))
            done += n
    return [B.pack_array(np.packbits(np.concatenate(o))) for o in out]


class _Plan:
    """The stretches of a block that travel: one of each content, its bucket, and who else has it."""

    def __init__(self, row: dict, parts: int, fine: int, window: int):
        self.ids, self.texts = B.unpack_block(row)
        own, at, size, low = stretches(self.texts, window)
        u, place = np.unique(low, return_inverse=True)
        keep = B.answered(u, row["common"], parts, 1)[place, 0] > 0
        own, at, size, low = own[keep], at[keep], size[keep], low[keep]
        order = np.argsort(self.ids[own], kind="stable")
        self.own, self.at, self.size = own[order], at[order], size[order]
        seen: dict[bytes, int] = {}
        texts = self.texts
        self.same = np.zeros(len(order), np.int64)
        for a in range(0, len(order), _STEP):
            part = slice(a, a + _STEP)
            pieces = [texts[o][x: x + n] for o, x, n in zip(self.own[part].tolist(), self.at[part].tolist(), (self.size[part] + window - 1).tolist())]
            self.same[part] = [seen.setdefault(p, len(seen)) for p in pieces]
        _, first = np.unique(self.same, return_index=True)
        self.pieces = list(seen)
        self.docs = self.ids[self.own[first]]
        drawn = mix(low[order][first] ^ U64(0x1357_9BDF))
        bucket = (drawn % U64(fine)).astype(np.int64)
        self.sub = (drawn // U64(fine) % U64(SUBS)).astype(np.int64)
        self.order = np.argsort(bucket * SUBS + self.sub, kind="stable")
        self.bound = np.searchsorted(bucket[self.order], np.arange(fine + 1))


def whole_characters(text: bytes, edge: np.ndarray) -> np.ndarray:
    """Spans (start, end, start, end, ...) of UTF-8 text, widened to whole characters; those that meet are joined."""
    out: list[int] = []
    for a, b in zip(edge[0::2].tolist(), edge[1::2].tolist()):
        while 0 < a < len(text) and text[a] & 0xC0 == 0x80:
            a -= 1
        while b < len(text) and text[b] & 0xC0 == 0x80:
            b += 1
        if out and a <= out[-1]:
            out[-1] = max(b, out[-1])
        else:
            out += [a, b]
    return np.array(out, np.int64)


def without(text: bytes, edge: np.ndarray) -> bytes:
    """text without these spans."""
    cut = edge.tolist()
    return b"".join(text[a:b] for a, b in zip([0, *cut[1::2]], [*cut[0::2], len(text)]))


def _covered(store: B.Blocks, window: int, made, schema) -> DataFrame:
    """made(block row, ids, texts, spans of each text) -> record batch, for each block; written."""
    blocks = store.df.count()
    parts, fine = max(store.parts, blocks // 2), max(store.parts, blocks)  # a bucket's share doesn't grow with the input
    label = B.labels(fine)
    common = shared.put(B.by_block(B.ask(store.df, parts, _ask_keys(window), _shared_keys), "common"), "common")

    def send(batches):
        for row in B.rows(batches):
            p = _Plan(row, parts, fine, window)
            for i in range(fine):
                mine = p.order[p.bound[i]:p.bound[i + 1]]
                if len(mine):
                    got = [p.pieces[j] for j in mine.tolist()]
                    head = np.array([[len(x) for x in got], p.docs[mine], p.sub[mine]], np.int64)
                    yield B.one(B.ASKED, label[i], i, row["block"], B.pack_array(head), B.squeeze(b"".join(got)))

    def reply(batches):
        got = list(B.rows(batches))
        if not got:
            return
        for r, hits in zip(got, answers([(r.pop("k"), r.pop("v")) for r in got], window)):
            yield B.one(B.ASKED, 0, r["bucket"], r["block"], b"", hits)

    joined = store.df.join(common, "block", "left")
    asked = joined.select("block", "ids", "lens", "text", "common")
    hits = B.by_block(asked.mapInArrow(shared.tidy(send), B.MESSAGE).repartition(fine, "label").mapInArrow(shared.tidy(reply), B.MESSAGE), "hits")

    def finish(batches):
        for row in B.rows(batches):
            p = _Plan(row, parts, fine, window)
            windows = np.array([len(x) - window + 1 for x in p.pieces], np.int64)
            by_piece: list = [None] * len(p.pieces)
            for x in row["hits"] or []:
                mine = p.order[p.bound[x["bucket"]]:p.bound[x["bucket"] + 1]]
                bits = np.unpackbits(B.unpack_array(x["a"], np.uint8)).astype(bool)
                at = 0
                for j in mine.tolist():
                    by_piece[j] = bits[at: at + windows[j]]
                    at += windows[j]
            ends = np.cumsum([len(t) + 1 for t in p.texts])
            first = np.concatenate([[0], ends])[p.own] + p.at
            later = p.ids[p.own] > p.docs[p.same] if len(p.same) else np.zeros(0, bool)
            up, down = np.zeros((2, ends[-1] + 1), bool)  # a window is in one stretch: at most one starts, and one ends, at a place
            up[first[later]] = True
            down[(first + p.size + window - 1)[later]] = True
            rest = np.flatnonzero(~later)
            for lo in range(0, len(rest), _STEP):
                part = rest[lo:lo + _STEP]
                for a, s in zip(first[part].tolist(), p.same[part].tolist()):
                    spot = np.flatnonzero(by_piece[s]) + a
                    up[spot] = True
                    down[spot + window] = True
            del by_piece
            spans = []
            for a, b in zip([0, *ends[:-1].tolist()], ends.tolist()):
                gone = np.cumsum(up[a:b].astype(np.int8) - down[a:b], dtype=np.int32)[:-1] > 0
                spans.append(np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))))
            yield made(row, p.ids, p.texts, spans)

    done = shared.put(joined.join(hits, "block", "left").mapInArrow(shared.tidy(finish), schema), "kept")
    shared.drop(common)
    return done


def mark(docs: DataFrame, window: int = WINDOW, keep_text: bool = False, block_bytes: int = B.BLOCK_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and spans, kept binary if keep_text) of each row of docs.

    Null texts count as empty.  A null doc_id counts as larger than all others
    and comes back null; rows with one doc_id are one document: they don't
    remove each other's strings.  Texts under the window lose nothing.  Other
    columns of docs are ignored.  An empty table gives none.
    """
    def made(row, ids, texts, spans):
        kept = [without(t, e) if len(e) else t for t, e in zip(texts, spans)]
        columns = [pa.array(ids, mask=ids == NO_ID), pa.array([len(t) for t in texts], pa.int64()), pa.array([len(t) - len(k) for t, k in zip(texts, kept)], pa.int64()),
                   pa.array([len(e) // 2 for e in spans], pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept])]
        if keep_text:
            columns += [pa.array([e.tolist() for e in spans], pa.list_(pa.int64())), pa.array(kept, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"][:len(columns)])

    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string" + ", spans array<bigint>, kept binary" * keep_text
    with B.Blocks(docs.select("doc_id", "text"), block_bytes) as store:
        return _covered(store, window, made, schema)


def cut(docs: DataFrame, window: int = WINDOW, block_bytes: int = B.BLOCK_BYTES) -> DataFrame:
    """docs with what ``mark`` finds cut out of their texts, together with characters that would be cut in half; other columns unchanged.

    Rows stay as many; a null text stays null, and a text that loses nothing is the same to the byte.
    """
    columns = docs.columns

    def made(row, ids, texts, spans):
        kept = [without(t, whole_characters(t, e)) if len(e) else t for t, e in zip(texts, spans)]
        return B.restore(row, kept, list(range(len(kept))), columns, "text")

    with B.Blocks(docs, block_bytes, rest=True) as store:
        return _covered(store, window, made, docs.schema)
