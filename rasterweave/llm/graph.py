"""Ids, shared files, joins on hot keys, and connected components of large graphs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rasterweave.plans.materialize import shared_path


#: Spark deletes the shuffle files of a plan that has run only when the driver's garbage is collected, twice, unless this is set.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(frame: DataFrame, name: str) -> DataFrame:
    """frame, written as a table in the shared folder and read again: its lineage ends there, and lost executors don't matter. The shuffle files that made it are deleted."""
    spark = frame.sparkSession
    path = shared_path(spark, name)
    schema = frame.schema
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        frame.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(schema).parquet(path)
    out.stored_path = path
    return out


def discard(frame: DataFrame | None) -> None:
    """Delete the files of a stored frame that nothing reads any more."""
    path = getattr(frame, "stored_path", None)
    if path:
        spark = frame.sparkSession
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def whole_id(frame: DataFrame, name: str) -> Column:
    """The column of a whole-number id as bigint; an id of another type is an error, as a cast could make different ones alike."""
    kind = frame.schema[name].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"ids have to be whole numbers, not {kind}")
    return F.col(f"`{name}`").cast("bigint")


def split_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """left joined with right on the bigint column key, which left keeps.

    Joined on the complement of the key, which no earlier exchange deals by, so that both
    sides get exchanges of this join's own: only of those can adaptive execution split a
    partition in which one key is hot. A side that was just aggregated by the key would
    otherwise be joined where it lies, with all rows of a hot key in one task.
    """
    other = f"_other_{key}"
    return left.join(right.withColumnRenamed(key, other), F.bitwise_not(F.col(key)) == F.bitwise_not(F.col(other)), how).drop(other)


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, root) of every node of edges (a, b: bigint): root is the least node that links reach.

    Alternates two steps until nothing changes, about the logarithm of the longest path times:
    every node sends its larger neighbours to its least one, then itself and its smaller
    neighbours to the least of these. Each step is one aggregation, combined before its
    shuffle, and one join, which splits a hub's edges. Each round is written to the shared
    folder, and the round before it is deleted.
    """
    e = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    first = e
    all_nodes = e.select(F.col("a").alias("node")).union(e.select(F.col("b").alias("node"))).distinct()
    before = None
    for _ in range(rounds):
        both = e.union(e.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = split_join(both.where("b > a"), least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        own = large.groupBy("a").agg(F.min("b").alias("m"))
        small = split_join(large, own, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = stored(small.union(own.select("a", F.col("m").alias("b"))).distinct(), "round")
        if e is not first:
            discard(e)
        e = after
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    found = stored(all_nodes.join(e.select(F.col("a").alias("node"), F.col("b").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("root")), "components")
    discard(e)
    if e is not first:
        discard(first)
    return found
