"""Mip and rip pyramids of long-form rasters (keys..., y, x, v).

A level's cell averages cells of the level before, by a filter whose weights are divided by
the weight that is there. Rounding down drops an odd last row or column, rounding up keeps it.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterweave.functions.halffloat import to_half
from rasterweave.plans.materialize import checkpointed


def level_sizes(n: int, up: bool, levels: int) -> list[int]:
    return [max(1, (n + (1 << k) - 1) >> k if up else n >> k) for k in range(levels)]


def level_total(n: int, up: bool) -> int:
    return 1 if n <= 1 else ((n - 1).bit_length() + 1 if up else n.bit_length())


def _lanczos(x: float, a: float = 2.0) -> float:
    if x == 0:
        return 1.0
    return 0.0 if abs(x) > a else a * math.sin(math.pi * x) * math.sin(math.pi * x / a) / (math.pi * x) ** 2


def taps(filter: str) -> list[tuple[int, float]]:
    """(offset, weight): source cell 2 X + offset weighs so much for target X. The same along both axes."""
    if filter == "box":
        return [(0, 1.0), (1, 1.0)]
    if filter == "triangle":
        return [(0, 0.5), (1, 1.0), (2, 0.5)]
    if filter == "lanczos":
        return [(k, w) for k in range(-1, 4) if (w := _lanczos(k - 1 + 0.5))]
    raise ValueError(f"no filter {filter}")


def _stored(v: Column, store: str, clamp: bool) -> Column:
    v = F.greatest(v, F.lit(0.0)) if clamp else v
    return {"double": lambda: v, "float": lambda: v.cast("float").cast("double"), "half": lambda: to_half(v.cast("float").cast("double"))}[store]()


def _axis(at: str, offsets: Sequence[tuple[int, float]], size: int) -> Column:
    """The targets (t, w) of a source coordinate along one axis, as an array."""
    each = [F.when(F.pmod(F.col(at) - k, F.lit(2)) == 0, F.struct(F.floor((F.col(at) - k) / 2).cast("int").alias("t"), F.lit(w).alias("w"))) for k, w in offsets]
    return F.filter(F.array_compact(F.array(*each)), lambda s: s["t"].between(0, size - 1))


def downsample(pixels: DataFrame, width: int, height: int, filter: str = "box", store: str = "double", clamp: bool = False, key: Sequence[str] = ()) -> DataFrame:
    """The next level, of width x height, windows starting at 0.

    Each source cell is sent to its targets with its weights and one aggregation, combined
    before the shuffle, adds them up; the box filter sends each cell to one target.
    """
    t = taps(filter)
    if filter == "box":
        x, y = F.floor(F.col("x") / 2).cast("int"), F.floor(F.col("y") / 2).cast("int")
        sums = pixels.select(*key, y.alias("y"), x.alias("x"), "v").where((F.col("x") < width) & (F.col("y") < height)).groupBy(*key, "y", "x").agg(F.avg("v").alias("v"))
    else:
        sent = pixels.withColumn("_x", F.explode(_axis("x", t, width))).withColumn("_y", F.explode(_axis("y", t, height)))
        w = F.col("_x.w") * F.col("_y.w")
        sent = sent.select(*key, F.col("_y.t").alias("y"), F.col("_x.t").alias("x"), (w * F.col("v")).alias("wv"), w.alias("w"))
        sums = sent.groupBy(*key, "y", "x").agg((F.sum("wv") / F.sum("w")).alias("v"))
    return sums.withColumn("v", _stored(F.col("v"), store, clamp))


def _weight(at: Column, level: Column, size: int, up: bool) -> Column:
    """The weight that a cell has in a box level's cell along one axis: the product of the shares at each halving; null where rounding down drops it."""
    sizes = level_sizes(size, up, 40)
    out = F.lit(1.0)
    for k in range(1, level_total(size, up) + 1):
        before, here = sizes[k - 1], sizes[k]
        cell = F.shiftright(at, k)
        alone = (before % 2 == 1) and up and before > 1
        share = F.when(cell >= here, F.lit(None).cast("double")).when(F.lit(alone) & (cell == here - 1), 1.0).otherwise(0.5 if before > 1 else 1.0)
        out = out * F.when(level >= k, share).otherwise(1.0)
    return out


def box_pyramid(pixels: DataFrame, width: int, height: int, up: bool = False, clamp: bool = False, key: Sequence[str] = ()) -> DataFrame:
    """All mip levels of the box filter at once, (level, y, x, v), in double precision.

    A cell's weight in each of its ancestors has a closed form, so every level is one sum over
    the source: one scan and one shuffle, whose size is that of the pyramid, instead of a
    chain of aggregations. Not for stored types that round at each level.
    """
    total = level_total(max(width, height), up)
    out = pixels.select(*key, F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), "v").withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(total - 1))))
    w = _weight(F.col("x"), F.col("level"), width, up) * _weight(F.col("y"), F.col("level"), height, up)
    out = out.withColumn("w", w).where("w IS NOT NULL")
    out = out.groupBy(*key, "level", F.expr("shiftright(y, level)").alias("y"), F.expr("shiftright(x, level)").alias("x")).agg(F.sum(F.col("v") * F.col("w")).alias("v"))
    return out.withColumn("v", F.when((F.col("level") > 0) & F.lit(clamp), F.greatest("v", F.lit(0.0))).otherwise(F.col("v")))


def mip_pyramid(pixels: DataFrame, width: int, height: int, filter: str = "box", up: bool = False, store: str = "double", clamp: bool = False, key: Sequence[str] = ()) -> DataFrame:
    """(level, y, x, v) down to one cell, each level from the stored one before it."""
    if filter == "box" and store == "double" and not clamp:
        return box_pyramid(pixels, width, height, up, key=key)
    total = level_total(max(width, height), up)
    ws, hs = level_sizes(width, up, total), level_sizes(height, up, total)
    level = pixels.select(*key, F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), "v")
    out = [level.withColumn("level", F.lit(0))]
    for k in range(1, total):
        level = checkpointed(downsample(level, ws[k], hs[k], filter, store, clamp, key))
        out.append(level.withColumn("level", F.lit(k)))
    return reduce(DataFrame.unionByName, out).select(*key, "level", "y", "x", "v")


def rip_pyramid(pixels: DataFrame, width: int, height: int, up: bool = False, clamp: bool = False) -> DataFrame:
    """(lx, ly, y, x, v): both axes are halved by themselves, always by the box filter.

    Averages along x and along y commute, so a cell's weight is the product of those of its
    axes, and all levels are one sum over the source.
    """
    nx, ny = level_total(width, up), level_total(height, up)
    out = pixels.select(F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), "v")
    out = out.withColumn("lx", F.explode(F.sequence(F.lit(0), F.lit(nx - 1)))).withColumn("ly", F.explode(F.sequence(F.lit(0), F.lit(ny - 1))))
    out = out.withColumn("w", _weight(F.col("x"), F.col("lx"), width, up) * _weight(F.col("y"), F.col("ly"), height, up)).where("w IS NOT NULL")
    out = out.groupBy("lx", "ly", F.expr("shiftright(y, ly)").alias("y"), F.expr("shiftright(x, lx)").alias("x")).agg(F.sum(F.col("v") * F.col("w")).alias("v"))
    return out.withColumn("v", F.greatest("v", F.lit(0.0)) if clamp else F.col("v"))


def mixed_filters(pixels: DataFrame, width: int, height: int, filters: Mapping[str, str], default: str = "box", up: bool = False) -> DataFrame:
    """The next level of a raster with a channel column, each channel by its own filter."""
    by: dict[str, list[str]] = {}
    for channel, name in filters.items():
        by.setdefault(name, []).append(channel)
    named = [c for name, cs in by.items() if name != default for c in cs]
    parts = [downsample(pixels.where(F.col("channel").isin(cs)), width, height, name, key=["channel"]) for name, cs in by.items() if name != default]
    parts.append(downsample(pixels.where(~F.col("channel").isin(named) if named else F.lit(True)), width, height, default, key=["channel"]))
    return reduce(DataFrame.unionByName, parts)


def retile(pixels: DataFrame, tile_width: int, tile_height: int, min_x: int = 0, min_y: int = 0, partitions: int | None = None) -> DataFrame:
    """pixels with tx and ty, and rows of a tile together when partitions is given."""
    out = pixels.withColumn("tx", F.floor((F.col("x") - min_x) / tile_width).cast("int")).withColumn("ty", F.floor((F.col("y") - min_y) / tile_height).cast("int"))
    return out.repartition(partitions, "ty", "tx") if partitions else out
