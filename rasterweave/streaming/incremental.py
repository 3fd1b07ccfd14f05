"""Rasters and deep samples that arrive in pieces, as Structured Streaming plans.

The operators of this library are aggregations by pixel or cell; these keep the same sums as
state, so that a pyramid or a count table follows its source. A piece names when it was made,
and a watermark lets state go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterweave.operators.pyramid import _weight, level_total


def read_pieces(spark: SparkSession, path: str, schema: str, files_per_batch: int = 16) -> DataFrame:
    """A stream of the Parquet files that come into a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def box_levels(pixels: DataFrame, width: int, height: int, up: bool = False) -> DataFrame:
    """(level, y, x, v, weight) of a stream of (y, x, v): the box pyramid of what has come so far, in update mode.

    weight is the share of the cell that has come: 1 where it is whole.
    """
    out = pixels.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(level_total(max(width, height), up) - 1))))
    out = out.withColumn("w", _weight(F.col("x"), F.col("level"), width, up) * _weight(F.col("y"), F.col("level"), height, up)).where("w IS NOT NULL")
    sums = out.groupBy("level", F.expr("shiftright(y, level)").alias("y"), F.expr("shiftright(x, level)").alias("x")).agg(F.sum(F.col("v") * F.col("w")).alias("_s"), F.sum("w").alias("weight"))
    return sums.select("level", "y", "x", (F.col("_s") / F.col("weight")).alias("v"), "weight")


def sample_counts(samples: DataFrame, made: str, late: str, window: str) -> DataFrame:
    """(window, y, x, n) of a stream of deep samples: counts by pixel and window of the time made, final once the watermark has passed."""
    return samples.withWatermark(made, late).groupBy(F.window(made, window).alias("window"), "y", "x").agg(F.count("*").alias("n"))


def first_copies(pieces: DataFrame, made: str, late: str, *key: str) -> DataFrame:
    """Pieces without those that repeat a key within the watermark, as when a sender sends again."""
    return pieces.withWatermark(made, late).dropDuplicatesWithinWatermark([*key])


def viewport(pixels: DataFrame, box: tuple[int, int, int, int]) -> DataFrame:
    """The pieces of a stream that lie in an inclusive box; no state."""
    inside: Column = F.col("x").between(box[0], box[2]) & F.col("y").between(box[1], box[3])
    return pixels.where(inside)
