"""What queries do on tables larger, or of other lengths, than the test tables."""

import duckdb
import oracle
import pytest

from rasterweave.operators import envmap
from rasterweave.plans import adapters
from rasterweave.plans.oracles import ORACLES
from rasterweave.plans.queries import QUERIES

SF = "/root/testdata/sf0.001"


def embeddings_of(folder, n):
    """A folder whose only table is the first n of sf0.01's embeddings, beside links to sf0.001."""
    for t in oracle.TABLES:
        if t != "embeddings":
            (folder / f"{t}.parquet").symlink_to(f"{SF}/{t}.parquet")
    duckdb.sql(f"COPY (SELECT * FROM '/root/testdata/sf0.01/embeddings.parquet' WHERE vec_id < {n}) TO '{folder}/embeddings.parquet' (FORMAT parquet)")
    return str(folder)


def test_a_lookup_gathers_no_points(spark):
    points = adapters.raster(spark, SF).selectExpr("y", "x", "v * 40 AS px", "v * 3 AS py", "1D AS weight")
    plans = [envmap.sample(points, adapters.rgba(spark, SF), 16, height, ["y", "x"])._jdf.queryExecution().sparkPlan().toString() for height in (8, 100_000)]
    assert "BroadcastHashJoin" in plans[0] and "BuildRight" in plans[0] and "BuildLeft" not in plans[0]
    assert "SortMergeJoin" in plans[1]


@pytest.mark.parametrize("name", ["s1b_tiled_scan"])
def test_a_last_band_of_odd_length(spark, tmp_path, name):
    d = embeddings_of(tmp_path, 175)
    assert oracle.differences(QUERIES[name](spark, d), ORACLES[name], d) == []


def test_chunks_are_not_dealt_or_sorted(spark):
    """Only headers are exchanged, over a fixed number of tasks; levels are sorted, chunks are not."""
    from rasterweave.operators import inspect, region

    chunks = region.catalogue(adapters.headers(spark, SF).where("mode = 'one'"))
    plan = inspect.chunk_violations(chunks, 200_000)._jdf.queryExecution().executedPlan().toString().split("+- Generate")
    assert not any(k in plan[0] for k in ("Exchange", "Sort ", "Window")) and "REPARTITION_BY_NUM" in plan[-1]
    assert chunks.columns[-2:] == ["offset", "length"]


def test_offsets_are_sums_of_lengths(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from rasterweave.operators import region

    chunks = region.catalogue(adapters.headers(spark, SF).where("tiled AND id % 7 = 1"))
    before = Window.partitionBy("id").orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    assert chunks.withColumn("sum", F.coalesce(F.sum("length").over(before), F.lit(0))).where("sum <> offset").count() == 0
    assert chunks.where("lx > 0 AND ly <> lx").count() > 0


def test_files_of_headers_are_dealt(spark):
    """One row group of a table becomes files in many tasks."""
    assert adapters.tagged(spark, SF).rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism


def test_several_groups_of_fields_are_one_aggregation(spark):
    from rasterweave.sources import attributes, container

    heads = container.read_headers(spark, adapters.tagged(spark, SF))
    got = attributes.typed(heads, "camera", "geo")
    assert got._jdf.queryExecution().sparkPlan().toString().count("Scan parquet") == 1
    one = attributes.typed(heads, "geo").select("path", "longitude", "latitude")
    assert got.where("longitude IS NOT NULL").select("path", "longitude", "latitude").exceptAll(one).count() == 0 and got.count() == adapters.tagged(spark, SF).count() > one.count()


def test_previews_of_several_sizes_come_in_few_frames(spark):
    import struct

    from pyspark.sql import functions as F

    from rasterweave.sources import attributes

    sizes = [(3, 2), (0, 0), (1, 4), (2, 1)] * 300
    rows = [(f"f{k:04d}", 0, struct.pack("<II", w, h) + bytes((k + i) % 256 for i in range(4 * w * h))) for k, (w, h) in enumerate(sizes)]
    frame = spark.createDataFrame(rows, "path string, part int, raw binary").coalesce(1)
    heads = frame.select("path", "part", F.create_map(F.lit("preview"), F.struct(F.lit("preview").alias("type"), F.col("raw").alias("value"))).alias("attrs"))
    got = {(r["path"], r["y"], r["x"]): round(r["a"] * 255) for r in attributes.preview_pixels(heads).collect()}
    assert got == {(p, i // w, i % w): raw[8 + 4 * i + 3] for (p, _, raw), (w, h) in zip(rows, sizes, strict=True) for i in range(w * h)}


def test_a_sink_does_not_gather_an_image_by_its_path(spark):
    from pyspark.sql import functions as F

    from rasterweave.sources import sinks

    pixels = adapters.rgba(spark, SF).withColumn("path", F.concat(F.lit("image"), (F.col("x") < 0).cast("string")))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = sinks.write_rgba(pixels)._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
