"""Arithmetic of windows, levels, tiles and chunks, as column expressions.

Integer boxes have inclusive corners; regions of the chunk catalogue are half-open.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Lines of a chunk by compression (0 none, 1 rle, 2 zips, 3 zip, 4 piz, 5 pxr24, 6 b44, 7 b44a, 8 dwaa, 9 dwab, 10 and 11 j2k of 256 and 32 lines).
LINES_PER_CHUNK = {0: 1, 1: 1, 2: 1, 3: 16, 4: 32, 5: 16, 6: 32, 7: 32, 8: 32, 9: 256, 10: 256, 11: 32}
LOSSY = (5, 6, 7, 8, 9)


def _bits(n: Column) -> Column:
    return F.length(F.bin(n.cast("bigint")))


def level_count(n: Column, up: Column) -> Column:
    """Levels until a size of one; 0 for an empty one. Rounding up: halves are ceilings."""
    return F.when(n <= 0, 0).when(n == 1, 1).when(up, _bits(n - 1) + 1).otherwise(_bits(n))


def level_size(n: Column, level: Column, up: Column) -> Column:
    """Size at a level: iterated halving is one shift, rounded up by adding 2^level - 1 first."""
    unit = F.call_function("shiftleft", F.lit(1).cast("bigint"), level.cast("int"))
    wide = n.cast("bigint")
    return F.greatest(F.lit(1).cast("bigint"), F.when(up, F.call_function("shiftright", wide + unit - 1, level.cast("int"))).otherwise(F.call_function("shiftright", wide, level.cast("int"))))


def tiles(n: Column, tile: Column) -> Column:
    """Tiles along one axis."""
    return F.when(tile == 0, 0).otherwise(F.floor((n + tile - 1) / tile)).cast("bigint")


def lines_per_chunk(compression: Column) -> Column:
    out = F.lit(1)
    for code, lines in LINES_PER_CHUNK.items():
        if lines > 1:
            out = F.when(compression == code, lines).otherwise(out)
    return out


def is_lossy(compression: Column) -> Column:
    return compression.isin(*LOSSY)


def box_width(low: Column, high: Column) -> Column:
    """Of an inclusive integer box."""
    return high - low + 1


def box_empty(min_x: Column, min_y: Column, max_x: Column, max_y: Column) -> Column:
    return (max_x < min_x) | (max_y < min_y)


def box_contains(min_x: Column, min_y: Column, max_x: Column, max_y: Column, x: Column, y: Column) -> Column:
    return x.between(min_x, max_x) & y.between(min_y, max_y)


def has_row(y: Column, sampling: Column) -> Column:
    """Whether a channel of a sampling stores row y; negative rows too."""
    return F.pmod(y, sampling) == 0


def sampled(n: Column, sampling: Column) -> Column:
    """Stored samples of n."""
    return F.floor((n + sampling - 1) / sampling).cast("bigint")


def tile_span(low: Column, high: Column, tile: Column, t: Column) -> tuple[Column, Column]:
    """First and last coordinate of tile t of a window, clipped to it."""
    start = low + t * tile
    return start, F.least(start + tile - 1, high)
