"""Whole-image operators: coverage, allocation, chroma planes, previews, RGBA reads."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterweave.functions.colour import from_yc, srgb, to_byte, to_yc, tone

# Names under which the colours of an RGBA read are looked up, in order.
ALIASES: Mapping[str, tuple[str, ...]] = {"r": ("R", "r", "red", "Red"), "g": ("G", "g", "green", "Green"), "b": ("B", "b", "blue", "Blue"), "a": ("A", "a", "alpha", "Alpha")}


def grid(spark: SparkSession, min_x: int, min_y: int, max_x: int, max_y: int, **fill: float) -> DataFrame:
    """Every (y, x) of an inclusive box, with constant columns. Rows come from a range, in partitions."""
    width, height = max_x - min_x + 1, max_y - min_y + 1
    i = F.col("id")
    rows = spark.range(max(0, width) * max(0, height)).select((F.floor(i / width) + min_y).cast("bigint").alias("y"), (i % width + min_x).cast("int").alias("x"))
    return rows.select("y", "x", *[F.lit(v).alias(k) for k, v in fill.items()])


def coverage(pixels: DataFrame, box: tuple[int, int, int, int]) -> DataFrame:
    """Channels of long-form pixels (channel, y, x, ...) whose extent does not cover the inclusive box (x0, y0, x1, y1)."""
    x0, y0, x1, y1 = box
    spans = pixels.groupBy("channel").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))
    return spans.where((F.col("x0") > x0) | (F.col("y0") > y0) | (F.col("x1") < x1) | (F.col("y1") < y1))


def rgba_of(pixels: DataFrame, keep: Sequence[str] = ("y", "x")) -> DataFrame:
    """r, g, b, a of wide-form pixels by the aliases of their channels; a missing colour is 0, a missing alpha 1."""
    have = set(pixels.columns)

    def pick(name: str) -> Column:
        found = next((x for x in ALIASES[name] if x in have), None)
        return F.col(f"`{found}`").cast("double") if found else F.lit(1.0 if name == "a" else 0.0)

    return pixels.select(*keep, *[pick(c).alias(c) for c in "rgba"])


def to_uint(v: Column) -> Column:
    """A sample as an unsigned 32-bit integer: truncated and clamped; NaN is 0."""
    return F.when(F.isnan(v), 0).otherwise(F.floor(F.least(F.greatest(v, F.lit(0.0)), F.lit(4294967295.0)))).cast("bigint")


def chroma(pixels: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, cy, cx, ry, by): chroma at half size, the mean over the 2 x 2 pixels that are there. keys: of several images."""
    _, ry, by = to_yc(F.col("r"), F.col("g"), F.col("b"))
    rows = pixels.select(*keys, F.floor(F.col("y") / 2).cast("bigint").alias("cy"), F.floor(F.col("x") / 2).cast("int").alias("cx"), ry.alias("ry"), by.alias("by"))
    return rows.groupBy(*keys, "cy", "cx").agg(F.avg("ry").alias("ry"), F.avg("by").alias("by"))


def upsample_chroma(plane: DataFrame, width: int | Column, height: int | Column, keys: Sequence[str] = ()) -> DataFrame:
    """(keys, y, x, ry, by) at full size: bilinear at (x / 2, y / 2), the right and lower edges clamped.

    Each chroma cell is sent to the pixels that it weighs in, so there is one aggregation and
    no join of the plane with itself.
    """
    width, height = (n if isinstance(n, Column) else F.lit(n) for n in (width, height))
    cw, ch = F.floor((width + 1) / 2), F.floor((height + 1) / 2)

    def sends(at: str, cells: Column, size: Column) -> Column:
        """(target, weight): an even pixel has its own cell, an odd one half of it and half of the next, which at the edge is the same."""
        own = F.struct((F.col(at) * 2).alias("t"), F.lit(1.0).alias("w"))
        after = F.struct((F.col(at) * 2 + 1).alias("t"), F.when(F.col(at) == cells - 1, 1.0).otherwise(0.5).alias("w"))
        before = F.struct((F.col(at) * 2 - 1).alias("t"), F.lit(0.5).alias("w"))
        return F.filter(F.array(own, after, before), lambda s: s["t"].between(0, size - 1))

    sent = plane.withColumn("_y", F.explode(sends("cy", ch, height))).withColumn("_x", F.explode(sends("cx", cw, width)))
    w = F.col("_y.w") * F.col("_x.w")
    return sent.groupBy(*keys, F.col("_y.t").alias("y"), F.col("_x.t").alias("x")).agg(F.sum(w * F.col("ry")).alias("ry"), F.sum(w * F.col("by")).alias("by"))


def yc_round_trip(pixels: DataFrame, width: int, height: int) -> DataFrame:
    """(y, x, r, g, b) after luminance at full size and chroma at half size."""
    luma, _, _ = to_yc(F.col("r"), F.col("g"), F.col("b"))
    r, g, b = from_yc(F.col("l"), F.col("ry"), F.col("by"))
    full = upsample_chroma(chroma(pixels), width, height)
    return pixels.select("y", "x", luma.alias("l")).join(full, ["y", "x"]).select("y", "x", r.alias("r"), g.alias("g"), b.alias("b"))


def preview_size(width: int, height: int, max_width: int, max_height: int) -> tuple[int, int]:
    """Within the largest size, in proportion, never enlarged, one at least; (0, 0) where there is no room."""
    if min(max_width, max_height) <= 0:
        return 0, 0
    if width <= max_width and height <= max_height:
        return width, height
    scale = min(max_width / width, max_height / height)
    return max(1, int(width * scale)), max(1, int(height * scale))


def _touched(at: str, size: int, cells: int) -> Column:
    """Cells whose source interval touches a source pixel; one on a border counts in both."""
    scale = size / cells
    low = F.greatest(F.floor(F.col(at) / scale).cast("int") - 1, F.lit(0))
    high = F.least(F.floor((F.col(at) + 1) / scale).cast("int") + 1, F.lit(cells - 1))
    return F.filter(F.sequence(low, high), lambda c: (F.floor(c * F.lit(scale)) <= F.col(at)) & (F.ceil((c + 1) * F.lit(scale)) > F.col(at)))


def preview(pixels: DataFrame, width: int, height: int, max_width: int, max_height: int) -> DataFrame:
    """(py, px, r, g, b, a) as bytes: the mean of the touched pixels, tone mapped and gamma encoded; alpha is only rounded."""
    pw, ph = preview_size(width, height, max_width, max_height)
    sent = pixels.withColumn("py", F.explode(_touched("y", height, ph))).withColumn("px", F.explode(_touched("x", width, pw)))
    means = sent.groupBy("py", "px").agg(*[F.avg(c).alias(c) for c in "rgba"])
    return means.select("py", "px", *[to_byte(srgb(tone(F.col(c)))).alias(c) for c in "rgb"], to_byte(F.col("a")).alias("a"))
