"""Vectorised word scanning over packed UTF-8 buffers.

A batch of texts is one byte buffer plus offsets.  Words are maximal runs of
bytes other than space and 0x09-0x0D; those bytes never occur inside a
multi-byte UTF-8 sequence, so the byte view and the character view agree.
Word identity is a 64-bit polynomial hash over a fixed random byte table,
finished with an invertible mixer.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
_SEED = 0x5EED_2B1D
_TABLE = np.random.default_rng(_SEED).integers(1, 2**63, 256, dtype=np.uint64) | U64(1)
_BASE = 0x9E37_79B9_7F4A_7C15
_INV = pow(_BASE, -1, 2**64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[0x41:0x5B] += 32

_pow_up = np.ones(1, U64)
_pow_down = np.ones(1, U64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i < n, grown by doubling."""
    global _pow_up, _pow_down
    while len(_pow_up) < n:
        k = len(_pow_up)
        _pow_up = np.concatenate([_pow_up, _pow_up * U64(pow(_BASE, k, 2**64))])
        _pow_down = np.concatenate([_pow_down, _pow_down * U64(pow(_INV, k, 2**64))])
    return _pow_up[:n], _pow_down[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Invertible 64-bit finaliser (xor-shift and odd multipliers)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58_476D_1CE4_E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D0_49BB_1331_11EB)
    return x ^ (x >> U64(31))


def pack(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """One buffer with a line feed after each text, and the start of each text."""
    buf = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
    lens = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
    starts = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(lens, out=starts[1:])
    return buf, starts


def slices(texts: list[bytes], limit: int = 1 << 20):
    """Index ranges of consecutive texts of about ``limit`` bytes together."""
    lo = size = 0
    for i, t in enumerate(texts):
        size += len(t) + 1
        if size >= limit:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def word_bounds(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end offsets of the words of a buffer that ends with a space byte."""
    space = _SPACE[buf]
    edge = np.flatnonzero(space[1:] != space[:-1]) + 1
    if len(buf) and not space[0]:
        edge = np.concatenate([[0], edge])
    return edge[0::2], edge[1::2]


def span_hashes(buf: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Mixed hash of each byte span [lo, hi)."""
    up, down = _powers(len(buf) + 1)
    acc = np.zeros(len(buf) + 1, U64)
    np.cumsum(_TABLE[buf] * up[: len(buf)], out=acc[1:])
    return mix((acc[hi] - acc[lo]) * down[lo])


def words(texts: list[bytes], fold: bool = True):
    """Word hashes of all texts, and for each text the index of its first word (one more entry at the end)."""
    out, counts = [], np.zeros(len(texts) + 1, np.int64)
    for a, b in slices(texts):
        buf, starts = pack(texts[a:b])
        if fold:
            buf = _FOLD[buf]
        lo, hi = word_bounds(buf)
        out.append(span_hashes(buf, lo, hi))
        counts[a + 1 : b + 1] = np.diff(np.searchsorted(lo, starts))
    return (np.concatenate(out) if out else np.zeros(0, U64)), np.cumsum(counts)


def chain(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n neighbours in h; run i starts at i."""
    acc = h[: len(h) - n + 1].copy() if len(h) >= n else np.zeros(0, U64)
    for k in range(1, n):
        acc = mix(acc * U64(_BASE) + h[k : len(h) - n + 1 + k])
    return acc
