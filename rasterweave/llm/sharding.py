"""Weighted rendezvous hashing of stable record keys onto shards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts that each shard is numbered in; a shard's rows are never sorted by one task.
PARTS = 64


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    """The shard with the least -ln(u) / weight, u being uniform in (0, 1) by key and shard.

    u has 52 bits of the MD5 of 'key:shard', which any engine can compute. A shard's value
    for a key does not depend on the other shards, so that a further shard only takes rows
    into itself, and shards get rows in proportion to their weights.
    """
    if not weights or min(weights) <= 0:
        raise ValueError("weights have to be positive")
    one = F.array(*[F.struct(F.lit(i).alias("s"), F.lit(float(w)).alias("w")) for i, w in enumerate(weights)])

    def value(x: Column) -> Column:
        bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(":"), x["s"].cast("string")).cast("binary")), 1, 13), 16, 10)
        return F.struct((-F.log((bits.cast("double") + 0.5) / F.lit(float(1 << 52))) / x["w"]).alias("v"), x["s"].alias("s"))

    return F.array_min(F.transform(one, value))["s"]


def shard(docs: DataFrame, shards: int = 40, weights: Sequence[float] | None = None, id_col: str = "doc_id", text_col: str = "text", parts: int = PARTS) -> DataFrame:
    """Assign every row to a shard and a gapless slot of it.

    Returns doc_id, size (UTF-8 bytes of the text plus 16), text_crc32, shard, slot, and
    grown_shard: the shard once there is one more, of the last shard's weight.

    Null ids count as the key '' and null texts as empty. Repeated rows get the same shard
    and different slots. Other columns of docs are ignored; an empty table gives no rows.

    Slots: rows of a shard fall into parts by the MD5 of the key; a part's first slot is the
    number of rows in the parts before it (shards x parts counts, the only broadcast).
    """
    weights = list(weights or [1.0] * shards)
    raw = F.col(f"`{id_col}`")
    key = F.coalesce(raw.cast("string"), F.lit(""))
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit("")).cast("binary")
    part = F.pmod(F.conv(F.substring(F.md5(key.cast("binary")), 1, 4), 16, 10).cast("int"), F.lit(parts))
    placed = [shard_of(key, weights).alias("shard"), part.alias("_part")]
    counts = docs.select(*placed).groupBy("shard", "_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("shard", "_part", before.alias("_start"))
    rows = docs.select(
        raw.alias("doc_id"), (F.octet_length(text).cast("bigint") + 16).alias("size"), F.crc32(text).cast("bigint").alias("text_crc32"),
        *placed, shard_of(key, [*weights, weights[-1]]).alias("grown_shard"),
    )
    place = F.row_number().over(Window.partitionBy("shard", "_part").orderBy("doc_id", "text_crc32", "size")) - 1
    return rows.withColumn("_place", place).join(F.broadcast(starts), ["shard", "_part"], "left").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("_place") + F.col("_start")).cast("bigint").alias("slot"), "grown_shard"
    )
