"""Reproducible randomness: a number in [0, 1) from (seed, key, slot), equal on any engine that has md5."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def unit(seed: int | str, key: Column, slot: Column | str) -> Column:
    """First 32 bits of md5('seed:key:slot') as a fraction."""
    slot = F.lit(slot) if isinstance(slot, str) else slot
    text = F.concat_ws(":", F.lit(str(seed)), key.cast("string"), slot.cast("string"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0


def pick(seed: int | str, key: Column, slot: Column | str, n: Column | int) -> Column:
    """Whole number in [0, n)."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.floor(unit(seed, key, slot) * n).cast("bigint")


def between(seed: int | str, key: Column, slot: Column | str, low: int, high: int) -> Column:
    """Whole number in [low, high]."""
    return pick(seed, key, slot, high - low + 1) + low
