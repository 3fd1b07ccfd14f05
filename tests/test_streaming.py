"""Streams end with what the batch operators give."""

from pyspark.sql import functions as F

from rasterweave.operators import image, pyramid
from rasterweave.streaming import incremental


def run(spark, frame, mode, name):
    q = frame.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.sql(f"SELECT * FROM {name}")


def test_levels_follow_their_source(spark, tmp_path):
    px = image.grid(spark, 0, 0, 10, 6).withColumn("v", (F.col("x") * 3 + F.col("y")).cast("double"))
    for k in range(3):
        px.where(F.col("x") % 3 == k).write.mode("append").parquet(str(tmp_path / "in"))
    stream = incremental.read_pieces(spark, str(tmp_path / "in"), "y bigint, x int, v double", 1)
    got = run(spark, incremental.box_levels(stream, 11, 7), "complete", "levels")
    want = pyramid.box_pyramid(px, 11, 7)
    last = got.where("abs(weight - 1) < 1e-9").select("level", F.col("y").cast("int"), "x", F.round("v", 9).alias("v"))
    assert last.count() == want.count() and last.exceptAll(want.select("level", "y", "x", F.round("v", 9).alias("v"))).count() == 0


def test_counts_and_copies(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 00:00:00", 0, 0, 1), ("2024-01-01 00:00:01", 0, 0, 2), ("2024-01-01 00:00:01", 0, 0, 2), ("2024-01-01 00:10:00", 0, 1, 3)], "t string, y int, x int, id int").withColumn("t", F.col("t").cast("timestamp"))
    rows.write.parquet(str(tmp_path / "in"))
    schema = "t timestamp, y int, x int, id int"
    stream = incremental.read_pieces(spark, str(tmp_path / "in"), schema)
    once = run(spark, incremental.first_copies(stream, "t", "1 minute", "id"), "append", "once")
    assert once.count() == 3
    counts = run(spark, incremental.sample_counts(stream, "t", "1 minute", "5 minutes"), "update", "counts")
    assert {(r["x"], r["n"]) for r in counts.collect()} == {(0, 3), (1, 1)}
    assert run(spark, incremental.viewport(stream, (1, 0, 5, 5)), "append", "view").count() == 1
