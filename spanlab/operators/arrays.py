"""A document's tokens and spans as arrays of its row, worked on in numpy over Arrow batches.

Rows of tokens would have to be sorted and brought together by document for every step; arrays stay beside
their text.  All kernels are linear in tokens and spans (but for sorting spans).  Offsets are 0-based code points.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.shapes import marked_pieces, piece_length

# kernels travel with the plan: workers need not find this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Arrow forms of what kernels give back.
SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
# Fixed value: a document's own stretch of keys (document, place), beyond any place.
SHIFT = 40


def _lists(a: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Items of all rows one after another, and where each row's begin; null: none."""
    n = pc.fill_null(pc.list_value_length(a), 0).to_numpy(zero_copy_only=False)
    return a.flatten(), np.concatenate([[0], np.cumsum(n, dtype=np.int64)])


def _ints(a: pa.Array) -> np.ndarray:
    return a.to_numpy(zero_copy_only=False).astype(np.int64)


def _rows(off: np.ndarray) -> np.ndarray:
    return np.repeat(np.arange(len(off) - 1), np.diff(off))


def _lists_of(values: pa.Array, row: np.ndarray, n: int) -> pa.ListArray:
    """Lists of values by row number, which only grows."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]), pa.int32()), values)


def _structs(**columns) -> pa.StructArray:
    return pa.StructArray.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], list(columns))


def _token_places(lens: pa.Array) -> tuple[np.ndarray, ...]:
    """Row, place in the row, start and end of each token, and where each row's tokens begin."""
    flat, off = _lists(lens)
    n, row = _ints(flat), _rows(off)
    end = np.cumsum(n)
    base = np.concatenate([[0], end])[off[:-1]]
    end = end - base[row]
    return row, np.arange(len(row)) - off[row], end - n, end, off


def _span_places(spans: pa.Array) -> tuple[np.ndarray, ...]:
    """Row, start and end of each span, sorted."""
    flat, off = _lists(spans)
    row, s, e = _rows(off), _ints(flat.field("start")), _ints(flat.field("end"))
    order = np.lexsort((e, s, row))
    return row[order], s[order], e[order]


def _merged(spans: pa.Array) -> tuple[np.ndarray, ...]:
    """Row, start and end of what overlapping and touching spans become."""
    row, s, e = _span_places(spans)
    if not len(s):
        return row, s, e
    far = np.maximum.accumulate((row << SHIFT) + e)
    at = np.flatnonzero(np.concatenate([[True], (row[1:] << SHIFT) + s[1:] > far[:-1]]))
    return row[at], s[at], np.maximum.reduceat(e, at)


def _udf(kernel, kind: str):
    """As nondeterministic, so that no filter or lambda that follows computes it again."""
    return F.arrow_udf(kernel, kind).asNondeterministic()


# ---- columns -----------------------------------------------------------------------------------


def tokenized(docs: DataFrame) -> DataFrame:
    """docs (text, ...) plus pieces (marked) and lens (characters of each).

    A generator's output is computed once; and a kernel's arguments must not hold nested lambdas, which Spark can't take out of a plan.
    """
    return docs.select("*", F.explode(F.array(marked_pieces(F.col("text")))).alias("pieces")).withColumn("lens", F.transform("pieces", piece_length))


def clamped(spans: Column, text_len: Column) -> Column:
    """Spans cut to the text; those that hold nothing go."""
    clamp = lambda x: F.greatest(F.lit(0), F.least(x, text_len)).cast("bigint")
    own = F.transform(spans, lambda x: F.struct(clamp(x["start"]).alias("start"), clamp(x["end"]).alias("end")))
    return F.filter(own, lambda x: x["end"] > x["start"])


def places(lens: Column, at: Column) -> Column:
    """array<struct<pos,start,end>> of the tokens numbered ``at`` (ascending)."""
    def kernel(lens: pa.Array, at: pa.Array) -> pa.Array:
        _, pos, start, end, off = _token_places(lens)
        flat, own = _lists(at)
        row = _rows(own)
        k = off[row] + _ints(flat)
        return _lists_of(_structs(pos=pos[k].astype(np.int32), start=start[k], end=end[k]), row, len(at))

    return _udf(kernel, "array<struct<pos:int,start:bigint,end:bigint>>")(lens, at)


def merged(spans: Column) -> Column:
    """array<struct<start,end>>: clamped spans sorted; overlapping and touching ones joined."""
    def kernel(spans: pa.Array) -> pa.Array:
        row, s, e = _merged(spans)
        return _lists_of(_structs(start=s, end=e), row, len(spans))

    return _udf(kernel, "array<struct<start:bigint,end:bigint>>")(spans)


# Types of what labelled() can give.
LABELLED = {"start": "array<bigint>", "end": "array<bigint>", "spans": "array<struct<start:bigint,end:bigint>>", "span_idx": "array<int>", "label": "array<int>", "first": "int", "last": "int"}


def labelled(lens: Column, spans: Column, *want: str) -> Column:
    """struct of what is wanted: start, end, span_idx (null: none) and label of each token, spans (merged), first and last labelled token (-1: none).

    A token belongs to the first span that it overlaps.
    """
    def kernel(lens: pa.Array, spans: pa.Array) -> pa.Array:
        row, pos, start, end, off = _token_places(lens)
        own, s, e = _merged(spans)
        n = len(lens)
        first = np.concatenate([[0], np.cumsum(np.bincount(own, minlength=n))])
        j = np.searchsorted((own << SHIFT) + e, (row << SHIFT) + start, side="right")
        if len(s):
            k = np.minimum(j, len(s) - 1)
            hit = (j < len(s)) & (own[k] == row) & (s[k] < end)
        else:
            hit = np.zeros(len(row), bool)
        idx = np.where(hit, j - first[row], -1)
        same = np.concatenate([[False], (idx[1:] == idx[:-1]) & (row[1:] == row[:-1])])[:len(idx)]
        label = np.where(hit, np.where(same, 2, 1), 0).astype(np.int32)
        at = np.flatnonzero(hit)
        low, high = np.full(n, -1, np.int32), np.full(n, -1, np.int32)
        high[row[at]] = pos[at]
        low[row[at[::-1]]] = pos[at[::-1]]
        lists = lambda v: pa.ListArray.from_arrays(pa.array(off, pa.int32()), v)
        make = {"start": lambda: lists(pa.array(start)), "end": lambda: lists(pa.array(end)), "spans": lambda: _lists_of(_structs(start=s, end=e), own, n),
                "span_idx": lambda: lists(pa.array(idx.astype(np.int32), mask=~hit)), "label": lambda: lists(pa.array(label)), "first": lambda: low, "last": lambda: high}
        return _structs(**{w: make[w]() for w in want})

    return _udf(kernel, f"struct<{','.join(f'{w}:{LABELLED[w]}' for w in want)}>")(lens, spans)


def decoded(lens: Column, labels: Column) -> Column:
    """array<struct<first_pos,start,end>>: a label 1 opens, 0 closes, all else continues; what nothing opened is nothing.

    There are as many labels as lens, or fewer: tokens without one are closed.
    """
    def kernel(lens: pa.Array, labels: pa.Array) -> pa.Array:
        _, pos, start, end, off = _token_places(lens)
        flat, own = _lists(labels)
        row = _rows(own)
        k = off[row] + np.arange(len(row)) - own[row]
        label = _ints(pc.fill_null(flat, 0))
        i = np.arange(len(row))
        opened = np.maximum.accumulate(np.where(label == 1, i, -1)) if len(i) else i
        closed = np.maximum.accumulate(np.where(label == 0, i, -1)) if len(i) else i
        held = np.flatnonzero((label != 0) & (opened >= own[row]) & (closed < opened))
        begins = np.flatnonzero(label[held] == 1)
        b = held[begins]
        stop = np.maximum.reduceat(end[k[held]], begins) if len(b) else b
        return _lists_of(_structs(first_pos=pos[k[b]].astype(np.int32), start=start[k[b]], end=stop.astype(np.int64)), row[b], len(lens))

    return _udf(kernel, "array<struct<first_pos:int,start:bigint,end:bigint>>")(lens, labels)


def near_pairs(spans: Column, reach: int) -> Column:
    """array<struct<a_start,a_end,b_start,b_end>>: pairs of different clamped spans, b after a, b's start less than reach after a's."""
    def kernel(spans: pa.Array) -> pa.Array:
        row, s, e = _span_places(spans)
        new = np.concatenate([[True], (row[1:] != row[:-1]) | (s[1:] != s[:-1]) | (e[1:] != e[:-1])])[:len(s)]
        row, s, e = row[new], s[new], e[new]
        key = (row << SHIFT) + s
        n = np.maximum(np.searchsorted(key, key + reach, side="left") - np.arange(len(s)) - 1, 0)
        a = np.repeat(np.arange(len(s)), n)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
        return _lists_of(_structs(a_start=s[a], a_end=e[a], b_start=s[b], b_end=e[b]), row[a], len(spans))

    return _udf(kernel, "array<struct<a_start:bigint,a_end:bigint,b_start:bigint,b_end:bigint>>")(spans)


def adjacent(text: Column, spans: Column, max_gap: int = 2) -> Column:
    """array<struct<start,end,value>>: spans (any order) joined over gaps of at most max_gap white space or ASCII punctuation characters without a blank line.

    The end is that of the last span, even if it lies inside the one before.
    """
    def kernel(text: pa.Array, spans: pa.Array) -> pa.Array:
        texts = [t or "" for t in text.to_pylist()]
        whole = "".join(texts)
        codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        size = np.array([len(t) for t in texts], np.int64)
        base = np.cumsum(size) - size
        plain = np.array([chr(c).isspace() or 33 <= c <= 47 or 58 <= c <= 64 or 91 <= c <= 96 or 123 <= c <= 126 for c in range(0x3001)])
        bad = np.concatenate([[0], np.cumsum(~plain[np.minimum(codes, 0x3000)] | (codes > 0x3000))])
        breaks = np.concatenate([[0], np.cumsum(codes == 10)])
        row, s, e = _span_places(spans)
        a = base[row[1:]] + np.minimum(np.minimum(e[:-1], s[1:]), size[row[1:]])
        z = base[row[1:]] + np.minimum(s[1:], size[row[1:]])
        joined = (row[1:] == row[:-1]) & (s[1:] <= e[:-1] + max_gap) & (bad[z] == bad[a])
        for i in np.flatnonzero(joined & (breaks[z] - breaks[a] > 1)):
            joined[i] = not re.search("\n[^\\S\x1c-\x1f]*\n", whole[a[i]:z[i]])
        at = np.flatnonzero(np.concatenate([[True], ~joined])[:len(s)])
        start, stop, row = s[at], e[np.concatenate([at[1:], [len(s)]]) - 1] if len(at) else at, row[at]
        values = [texts[r][x:y] for r, x, y in zip(row.tolist(), start.tolist(), stop.tolist())]
        return _lists_of(_structs(start=start, end=stop.astype(np.int64), value=pa.array(values, pa.string())), row, len(spans))

    return _udf(kernel, "array<struct<start:bigint,end:bigint,value:string>>")(text, spans)


def widened(text: Column, lens: Column, size: int, stride: int) -> Column:
    """array<struct<chunk,start,end,text>>: windows of size tokens every stride, widened to line ends; one window: the whole text."""
    def windows(t: str, ends: np.ndarray, starts: np.ndarray) -> Iterator[tuple]:
        n = len(ends)
        if 0 < n <= size:
            yield 0, 0, len(t)
        elif n:
            for k in range(-(-(n - size) // stride) + 1):
                a, e = int(starts[k * stride]), int(ends[min(k * stride + size, n) - 1])
                z = t.find("\n", e)
                yield k, t.rfind("\n", 0, a) + 1, len(t) if z < 0 else z

    def kernel(text: pa.Array, lens: pa.Array) -> pa.Array:
        _, _, start, end, off = _token_places(lens)
        got = [(i, *w, t[w[1]:w[2]]) for i, t in enumerate(text.to_pylist()) if t is not None for w in windows(t, end[off[i]:off[i + 1]], start[off[i]:off[i + 1]])]
        row, chunk, a, z, part = zip(*got) if got else [()] * 5
        return _lists_of(_structs(chunk=pa.array(chunk, pa.int32()), start=pa.array(a, pa.int64()), end=pa.array(z, pa.int64()), text=pa.array(part, pa.string())), np.array(row, np.int64), len(lens))

    return _udf(kernel, "array<struct<chunk:int,start:bigint,end:bigint,text:string>>")(text, lens)


def once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """rows plus value, computed once however often and wherever it is used."""
    return rows.select("*", F.explode(F.array(value)).alias(name))


# Fixed value: gaps between paragraphs.
GAP = re.compile(r"\n\s*\n+")


def _block(text: str, a: int, z: int) -> tuple | None:
    """A piece of text without white space at its edges; None if blank."""
    raw = text[a:z]
    left = raw.lstrip()
    return (a + len(raw) - len(left), left.rstrip()) if left else None


def _blocks_of(texts: list, parts) -> pa.Array:
    """parts(row, text): ranges of the text."""
    got = [(i, *b) for i, t in enumerate(texts) if t is not None for a, z in parts(i, t) if (b := _block(t, a, z))]
    row, start, value = zip(*got) if got else [()] * 3
    start = np.array(start, np.int64)
    return _lists_of(_structs(start=start, end=start + np.array([len(v) for v in value], np.int64), value=pa.array(value, pa.string())), np.array(row, np.int64), len(texts))


BLOCKS = "array<struct<start:bigint,end:bigint,value:string>>"


def paragraphs(text: Column) -> Column:
    """Blocks between blank lines."""
    def parts(_: int, t: str) -> Iterator[tuple[int, int]]:
        a = 0
        for m in GAP.finditer(t):
            yield a, m.start()
            a = m.end()
        yield a, len(t)

    def kernel(text: pa.Array) -> pa.Array:
        return _blocks_of(text.to_pylist(), parts)

    return _udf(kernel, BLOCKS)(text)


def references(text: Column, sizes: Column, kinds: Column) -> Column:
    """Blocks from a start line to the next start, header or end; sizes and kinds (line_kind()) are those of the text's lines."""
    def kernel(text: pa.Array, sizes: pa.Array, kinds: pa.Array) -> pa.Array:
        n, k = sizes.to_pylist(), kinds.to_pylist()

        def parts(i: int, _: str) -> Iterator[tuple[int, int]]:
            begins, at, a = "numbered" if "numbered" in k[i] else "general", 0, -1
            for kind, size in zip(k[i], n[i]):
                if kind == begins or kind == "header":
                    if a >= 0:
                        yield a, at
                    a = at if kind == begins else -1
                at += size
            if a >= 0:
                yield a, at

        return _blocks_of(text.to_pylist(), parts)

    return _udf(kernel, BLOCKS)(text, sizes, kinds)


def deduped(items: Column, least: float) -> Column:
    """Ordered fold over array<struct<start,end,value,norm>> in order of all fields: see spans.dedupe()."""
    def fold(items: list) -> list:
        kept, norms, live = [], {}, []
        for x in sorted(items, key=lambda x: (x["start"], x["end"], x["value"].encode(), x["norm"].encode())):
            if norms.get(x["norm"]):
                continue
            if least > 0:  # what ends before this start meets nothing that follows either
                live = [k for k in live if kept[k]["end"] > x["start"]]
            size = x["end"] - x["start"]
            for k in live:
                y = kept[k]
                both = max(0, min(y["end"], x["end"]) - max(y["start"], x["start"]))
                if (both / min(max(1, y["end"] - y["start"]), max(1, size)) if both else 0.0) >= least:
                    if size > y["end"] - y["start"]:
                        norms[y["norm"]] -= 1
                        kept[k], norms[x["norm"]] = x, norms.get(x["norm"], 0) + 1
                    break
            else:
                live.append(len(kept))
                kept.append(x)
                norms[x["norm"]] = norms.get(x["norm"], 0) + 1
        return kept

    def kernel(items: pa.Array) -> pa.Array:
        got = [(i, x["start"], x["end"], x["value"]) for i, row in enumerate(items.to_pylist()) for x in fold(row or [])]
        row, start, end, value = zip(*got) if got else [()] * 4
        return _lists_of(_structs(start=pa.array(start, pa.int64()), end=pa.array(end, pa.int64()), value=pa.array(value, pa.string())), np.array(row, np.int64), len(items))

    return _udf(kernel, BLOCKS)(items)
