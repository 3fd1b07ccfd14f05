"""Layers, views and parts."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rasterweave.operators.image import grid


def parse(channel: Column, views: Sequence[str]) -> Column:
    """struct(layer, view, base): of two components the first is a view if it is known, else a layer; of more, the last but one."""
    part = F.split(channel, r"\.")
    n = F.size(part)
    known = lambda c: c.isin(*views) if views else F.lit(False)
    first, before = F.get(part, F.lit(0)), F.get(part, n - 2)
    view = F.when((n == 2) & known(first), first).when((n > 2) & known(before), before).otherwise("")
    kept = F.when((n == 2) & known(first), 0).when((n > 2) & known(before), n - 2).otherwise(n - 1)
    return F.struct(F.array_join(F.slice(part, F.lit(1), kept), ".").alias("layer"), view.alias("view"), F.get(part, n - 1).alias("base"))


def build(layer: Column, view: Column, base: Column) -> Column:
    """layer.view.base without what is empty."""
    return F.array_join(F.filter(F.array(layer, view, base), lambda p: p != ""), ".")


def channels_of(channels: DataFrame, view: str, views: Sequence[str], default: str) -> DataFrame:
    """Channels of a view; those that name none belong to the default one."""
    v = parse(F.col("channel"), views)["view"]
    return channels.where((v == view) | ((v == "") & F.lit(view == default)))


def read_view(pixels: DataFrame, view: str, views: Sequence[str], default: str) -> DataFrame:
    """(path, y, x, r, g, b, a) of a view of long-form pixels (path, channel, y, x, v): its channels by their base names; a missing colour is 0, a missing alpha 1."""
    own = channels_of(pixels, view, views, default).withColumn("_base", parse(F.col("channel"), views)["base"])
    wide = own.groupBy("path", "y", "x").agg(*[F.max(F.when(F.col("_base") == c, F.col("v"))).alias(c.lower()) for c in "RGBA"])
    return wide.select("path", "y", "x", *[F.coalesce(c, F.lit(1.0 if c == "a" else 0.0)).alias(c) for c in "rgba"])


def view_list(parts: DataFrame) -> DataFrame:
    """(id, views, default_view, stereo) from rows (id, view) of parts; sorted, so that the default does not depend on order."""
    views = F.array_sort(F.collect_set("view"))
    out = parts.where("view <> ''").groupBy("id").agg(views.alias("views"))
    return out.select("id", "views", F.get("views", F.lit(0)).alias("default_view"), (F.array_contains("views", "left") & F.array_contains("views", "right")).alias("stereo"))


def merge(spark: SparkSession, views: dict[str, DataFrame], channels: Sequence[str], strict: bool = False) -> DataFrame:
    """Views (y, x, channels) over the box around all of them, channels named by view; zeros where a view has no pixel.

    The boxes are one aggregate of each view. strict: all have to be the same.
    """
    boxes = {v: d.agg(F.min("x").alias("a"), F.min("y").alias("b"), F.max("x").alias("c"), F.max("y").alias("d")).first() for v, d in views.items()}
    if strict and len({tuple(b) for b in boxes.values()}) > 1:
        raise ValueError("data windows differ")
    have = [b for b in boxes.values() if b["a"] is not None]
    out = grid(spark, min(b["a"] for b in have), min(b["b"] for b in have), max(b["c"] for b in have), max(b["d"] for b in have))
    for v, d in views.items():
        named = d.select(F.col("y").cast("bigint").alias("y"), F.col("x").cast("int").alias("x"), *[F.col(c).alias(f"{v}.{c}") for c in channels])
        out = out.join(named, ["y", "x"], "left")
    return out.select("y", "x", *[F.coalesce(F.col(f"`{v}.{c}`"), F.lit(0.0)).alias(f"{v}.{c}") for v in views for c in channels])


def combine(parts: Sequence[DataFrame]) -> DataFrame:
    """One set of parts (part, name, ...) from several; a name that came before gets a suffix _1, _2, ..."""
    tagged = [p.withColumn("_file", F.lit(i)) for i, p in enumerate(parts)]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    seen = F.row_number().over(Window.partitionBy("name").orderBy("_file", "part")) - 1
    return every.withColumn("_n", seen).withColumn("name", F.when(F.col("_n") > 0, F.concat_ws("_", "name", F.col("_n").cast("string"))).otherwise(F.col("name"))).drop("_n", "_file")


def separate(parts: DataFrame, path: str) -> None:
    """One folder for each part's name."""
    parts.write.partitionBy("name").parquet(path)
