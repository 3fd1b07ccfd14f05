"""Summaries, comparison and validation of images."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rasterweave.functions import geometry as G
from rasterweave.functions.meta import rule_violations


def info(headers: DataFrame) -> DataFrame:
    """One summary row for each header."""
    chunks = F.when(F.col("tiled"), G.tiles(F.col("w"), F.col("tw")) * G.tiles(F.col("h"), F.col("th"))).otherwise(F.ceil(F.col("h") / G.lines_per_chunk(F.col("compression"))))
    return headers.select(
        "id", "name", "w", "h", (F.col("min_x") + F.col("w") - 1).alias("max_x"), (F.col("min_y") + F.col("h") - 1).alias("max_y"), "compression", G.is_lossy(F.col("compression")).alias("lossy"),
        "tiled", "deep", "mode", chunks.cast("bigint").alias("chunks"),
    )


def compare(a: DataFrame, b: DataFrame, tolerance: float) -> DataFrame:
    """(channel, n_diff, max_diff) of two long-form rasters (channel, y, x, v): cells that differ by more than tolerance.

    A comparison with NaN counts as equal, as IEEE has it; cells that only one has differ without a size.
    """
    met = a.alias("a").join(b.alias("b"), ["channel", "y", "x"], "full_outer").select("channel", F.col("a.v").alias("p"), F.col("b.v").alias("q"))
    d = F.abs(F.col("p") - F.col("q"))
    real = ~F.isnan(F.coalesce(d, F.lit(0.0))) & d.isNotNull()
    differ = (real & (d > tolerance)) | F.col("p").isNull() | F.col("q").isNull()
    return met.groupBy("channel").agg(F.sum(F.when(differ, 1).otherwise(0)).alias("n_diff"), F.max(F.when(real & (d > tolerance), d)).alias("max_diff"))


def channel_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """(channel, side) of channels that only one of two has."""
    only = lambda p, q, side: p.select("channel").exceptAll(q.select("channel")).withColumn("side", F.lit(side))
    return only(a, b, "first").unionByName(only(b, a, "second"))


def validate(headers: DataFrame) -> DataFrame:
    """(id, severity, rule) of each broken rule of a header."""
    c = F.col
    return rule_violations(headers, "id", [
        ("error", "window is empty", (c("w") <= 0) | (c("h") <= 0)),
        ("error", "deep data allow no, run-length or single-line deflate compression only", c("deep") & ~c("compression").isin(0, 1, 2)),
        ("error", "tile size is not positive", c("tiled") & ((c("tw") <= 0) | (c("th") <= 0))),
        ("error", "levels need tiles", ~c("tiled") & (c("mode") != "one")),
        ("error", "unknown compression", ~c("compression").between(0, 11)),
        ("warning", "larger than 32768", (c("w") > 32768) | (c("h") > 32768)),
        ("warning", "lossy compression", G.is_lossy(c("compression"))),
        ("warning", "window does not start at 0", (c("min_x") != 0) | (c("min_y") != 0)),
    ])


def chunk_violations(chunks: DataFrame, file_size: int | None = None) -> DataFrame:
    """(id, rule, n) over a catalogue: offsets that come twice, empty chunks, ends past the file. One pass over the chunks."""
    count = lambda broken: F.sum(F.when(broken, 1).otherwise(0))
    past = F.lit(False) if file_size is None else F.col("offset") + F.col("length") > file_size
    places = chunks.groupBy("id", "offset").agg(F.count("*").alias("n"), count(F.col("length") <= 0).alias("empty"), count(past).alias("past"))
    sums = places.groupBy("id").agg(F.sum(F.when(F.col("n") > 1, F.col("n")).otherwise(0)).alias("twice"), F.sum("empty").alias("empty"), F.sum("past").alias("past"))
    rules = F.array(*[F.struct(F.lit(rule).alias("rule"), F.col(c).alias("n")) for rule, c in (("offset comes twice", "twice"), ("empty chunk", "empty"), ("chunk ends past the file", "past"))])
    return sums.select("id", F.explode(rules).alias("r")).select("id", "r.rule", "r.n").where("n > 0")
