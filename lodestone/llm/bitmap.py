"""Bitmaps of hashes with a fixed size: filters that let some more through, never less."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Their size does not depend on the data.
BITMAP = 1 << 26
SHIFT = 65 - BITMAP.bit_length()


def bitmap(hashes: DataFrame, column: str) -> np.ndarray:
    """A bitmap of the hashes' high bits: BITMAP bits, 8 MB, whatever their number."""
    at = F.shiftrightunsigned(F.col(column), SHIFT) + 1  # a bucket holds 32,768 values, the first is 1
    rows = hashes.select(F.bitmap_bucket_number(at).alias("number"), F.bitmap_bit_position(at).alias("position"))
    out = np.zeros(BITMAP // 8, dtype=np.uint8)
    for number, bits in rows.groupBy("number").agg(F.bitmap_construct_agg("position")).collect():
        out[(number - 1) * 4096 : number * 4096] = np.frombuffer(bits, dtype=np.uint8)
    return out


def local_bitmap(h: np.ndarray) -> np.ndarray:
    """A bitmap of hashes that are at hand, as ``bitmap`` makes it."""
    at = h >> np.uint64(SHIFT)
    out = np.zeros(BITMAP // 8, dtype=np.uint8)
    np.bitwise_or.at(out, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
    return out


def in_bitmap(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = (h >> np.uint64(SHIFT)).astype(np.int64)
    return (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
