"""MurmurHash3, 32 and 128 bits, and the float form of a 32-bit hash; vectorised over a column."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

# The multipliers, rotations and additions of the published hash.
C32 = (0xCC9E2D51, 0x1B873593, 0xE6546B64, 0x85EBCA6B, 0xC2B2AE35)
C64 = (0x87C37B91114253D5, 0x4CF5AD432745937F, 0x52DCE729, 0x38495AB5, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)
_M32, _M64 = 0xFFFFFFFF, 0xFFFFFFFFFFFFFFFF


def murmur3_32(data: bytes, seed: int = 0) -> int:
    rot = lambda v, n: ((v << n) | (v >> (32 - n))) & _M32
    h = seed
    full = len(data) & ~3
    for (k,) in np.frombuffer(data[:full], "<u4").reshape(-1, 1).tolist():
        h ^= rot(k * C32[0] & _M32, 15) * C32[1] & _M32
        h = (rot(h, 13) * 5 + C32[2]) & _M32
    if len(data) > full:
        k = int.from_bytes(data[full:], "little")
        h ^= rot(k * C32[0] & _M32, 15) * C32[1] & _M32
    h ^= len(data)
    for shift, m in ((16, C32[3]), (13, C32[4])):
        h = (h ^ h >> shift) * m & _M32
    return h ^ h >> 16


def murmur3_128(data: bytes, seed: int = 0) -> tuple[int, int]:
    rot = lambda v, n: ((v << n) | (v >> (64 - n))) & _M64
    scramble = lambda k, a, n, b: rot(k * a & _M64, n) * b & _M64
    h1 = h2 = seed
    full = len(data) & ~15
    words = np.frombuffer(data[:full], "<u8").tolist()
    for k1, k2 in zip(words[::2], words[1::2], strict=True):
        h1 = ((rot(h1 ^ scramble(k1, C64[0], 31, C64[1]), 27) + h2) * 5 + C64[2]) & _M64
        h2 = ((rot(h2 ^ scramble(k2, C64[1], 33, C64[0]), 31) + h1) * 5 + C64[3]) & _M64
    rest = data[full:]
    if len(rest) > 8:
        h2 ^= scramble(int.from_bytes(rest[8:], "little"), C64[1], 33, C64[0])
    if rest:
        h1 ^= scramble(int.from_bytes(rest[:8], "little"), C64[0], 31, C64[1])

    def final(h: int) -> int:
        h = (h ^ h >> 33) * C64[4] & _M64
        h = (h ^ h >> 33) * C64[5] & _M64
        return h ^ h >> 33

    h1, h2 = h1 ^ len(data), h2 ^ len(data)
    h1 = (h1 + h2) & _M64
    h2 = (h2 + h1) & _M64
    h1, h2 = final(h1), final(h2)
    h1 = (h1 + h2) & _M64
    return h1, (h2 + h1) & _M64


@F.pandas_udf(LongType())
def murmur32(text: pd.Series) -> pd.Series:
    """Unsigned 32-bit hash of the UTF-8 bytes, seed 0; null stays null."""
    return pd.Series([None if t is None else murmur3_32(t.encode()) for t in text], dtype="Int64")


@F.pandas_udf(LongType())
def murmur64(text: pd.Series) -> pd.Series:
    """The first 64 bits of the 128-bit hash, as a signed number of the same bits."""
    return pd.Series([None if t is None else int(np.uint64(murmur3_128(t.encode())[0]).astype(np.int64)) for t in text], dtype="Int64")


def float_safe(h: Column) -> Column:
    """A 32-bit hash with bit 23 flipped where its exponent as a float would be all zeros or ones."""
    e = F.shiftright(h, 23).bitwiseAND(F.lit(255))
    return F.when(e.isin(0, 255), h.bitwiseXOR(F.lit(1 << 23))).otherwise(h)


def as_float(h: Column) -> Column:
    """The float32 that the bits of h are, by arithmetic."""
    e = F.shiftright(h, 23).bitwiseAND(F.lit(255))
    m = h.bitwiseAND(F.lit((1 << 23) - 1)).cast("double")
    sign = F.when(F.shiftright(h, 31) > 0, -1.0).otherwise(1.0)
    value = F.when(e == 0, m * 2.0**-149).otherwise((1 + m / (1 << 23)) * F.pow(F.lit(2.0), (e - 127).cast("double")))
    return sign * value
