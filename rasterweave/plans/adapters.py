"""Views that present the driver's tables as rasters, deep samples, headers, channels and parts.

Each view has its DuckDB SQL beside it, for the oracles.
"""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterweave.session import table
from rasterweave.sources import codecs, container
from rasterweave.sources.attributes import pack

WIDTH, RGBA_WIDTH, DEEP_WIDTH, SHIFT, BAND = 64, 16, 128, 0.55, 40


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(y, x, v): one row of WIDTH samples for each embedding."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("y"), F.posexplode("embedding").alias("x", "v")).select("y", "x", F.col("v").cast("double").alias("v"))


RASTER = "raster AS (SELECT vec_id AS y, unnest(range(64))::INTEGER AS x, unnest(embedding)::DOUBLE AS v FROM embeddings)"


def rgba(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(y, x, r, g, b, a): RGBA_WIDTH pixels for each embedding, shifted to be positive."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("y"), "embedding", F.explode(F.sequence(F.lit(0), F.lit(RGBA_WIDTH - 1))).alias("x"))
    return e.select("y", "x", *[(F.get("embedding", F.col("x") * 4 + i).cast("double") + SHIFT).alias(c) for i, c in enumerate("rgba")])


RGBA = """rgba AS (SELECT vec_id AS y, x::INTEGER AS x, embedding[4*x+1]::DOUBLE + 0.55 AS r, embedding[4*x+2]::DOUBLE + 0.55 AS g,
  embedding[4*x+3]::DOUBLE + 0.55 AS b, embedding[4*x+4]::DOUBLE + 0.55 AS a FROM embeddings, range(16) AS t(x))"""


def deep(spark: SparkSession, sf_dir: str, lines: tuple[int, int] | None = None) -> DataFrame:
    """Deep samples: pixel (y, x) by order, depth by day shipped; t1 to t4 make their order total. src is the source's tag. lines: first and last y wanted, as a range of keys that Parquet prunes by."""
    z = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("double")
    a = F.least(F.col("l_discount") * 10.7, F.lit(1.0))
    items = table(spark, sf_dir, "lineitem")
    if lines:
        items = items.where(F.col("l_orderkey").between(lines[0] * DEEP_WIDTH, (lines[1] + 1) * DEEP_WIDTH - 1))
    return (
        items
        .select(
            F.floor(F.col("l_orderkey") / DEEP_WIDTH).cast("bigint").alias("y"), (F.col("l_orderkey") % DEEP_WIDTH).alias("x"), z.alias("z"), (z + F.col("l_linenumber")).alias("zback"), a.alias("a"),
            (F.col("l_quantity") / 47 * a).alias("r"), (F.col("l_tax") * a).alias("g"), (F.col("l_extendedprice") / 97531 * a).alias("b"),
            F.col("l_linenumber").alias("t1"), F.col("l_partkey").alias("t2"), F.col("l_suppkey").alias("t3"), F.col("l_extendedprice").alias("t4"), F.col("l_returnflag").alias("src"),
        )
    )


DEEP = """deep AS (SELECT l_orderkey // 128 AS y, l_orderkey % 128 AS x, z, z + l_linenumber AS zback, a, l_quantity / 47 * a AS r, l_tax * a AS g,
  l_extendedprice / 97531 * a AS b, l_linenumber AS t1, l_partkey AS t2, l_suppkey AS t3, l_extendedprice AS t4, l_returnflag AS src
  FROM (SELECT *, date_diff('day', DATE '1970-01-01', l_shipdate::DATE)::DOUBLE AS z, least(l_discount * 10.7, 1.0) AS a FROM lineitem))"""


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One image header for each part."""
    p, s = F.col("p_partkey"), F.col("p_size")
    return table(spark, sf_dir, "part").select(
        p.alias("id"), F.col("p_name").alias("name"), (p % 2000 + 1).cast("int").alias("w"), (s * 41 + 3).cast("int").alias("h"), (p % 31 - 15).cast("int").alias("min_x"), (s % 17 - 8).cast("int").alias("min_y"),
        (s % 48 + 16).cast("int").alias("tw"), (p % 56 + 8).cast("int").alias("th"), F.element_at(F.array(F.lit("one"), F.lit("mipmap"), F.lit("ripmap")), (p % 3 + 1).cast("int")).alias("mode"),
        (p % 2 == 1).alias("up"), (p % 13).cast("int").alias("compression"), (s % 4 != 0).alias("tiled"), (p % 7 == 0).alias("deep"), F.col("p_brand").alias("brand"), F.col("p_type").alias("kind"),
    )


HEADERS = """headers AS (SELECT p_partkey AS id, p_name AS name, (p_partkey % 2000 + 1)::INTEGER AS w, (p_size * 41 + 3)::INTEGER AS h, (p_partkey % 31 - 15)::INTEGER AS min_x,
  (p_size % 17 - 8)::INTEGER AS min_y, (p_size % 48 + 16)::INTEGER AS tw, (p_partkey % 56 + 8)::INTEGER AS th, ['one', 'mipmap', 'ripmap'][p_partkey % 3 + 1] AS mode,
  p_partkey % 2 = 1 AS up, (p_partkey % 13)::INTEGER AS compression, p_size % 4 <> 0 AS tiled, p_partkey % 7 = 0 AS deep, p_brand AS brand, p_type AS kind FROM part)"""


def channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, channel): names of one to four components; some have a view's."""
    p = F.col("p_partkey")
    view = F.element_at(F.array(F.lit("left"), F.lit("right"), F.lit("diffuse")), (p % 3 + 1).cast("int"))
    base = F.element_at(F.array(*map(F.lit, ("R", "G", "B", "A", "Z"))), (p % 5 + 1).cast("int"))
    kind = F.regexp_replace("p_type", " ", "_")
    name = F.when(p % 4 == 0, base).when(p % 4 == 1, F.concat_ws(".", view, base)).when(p % 4 == 2, F.concat_ws(".", kind, view, base)).otherwise(F.concat_ws(".", kind, F.lit("left"), view, base))
    return table(spark, sf_dir, "part").select(p.alias("id"), name.alias("channel"))


CHANNELS = """channels AS (SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN base WHEN 1 THEN vw || '.' || base WHEN 2 THEN kind || '.' || vw || '.' || base
  ELSE kind || '.left.' || vw || '.' || base END AS channel FROM (SELECT p_partkey, ['left', 'right', 'diffuse'][p_partkey % 3 + 1] AS vw,
  ['R', 'G', 'B', 'A', 'Z'][p_partkey % 5 + 1] AS base, replace(p_type, ' ', '_') AS kind FROM part))"""


def files(spark: SparkSession, sf_dir: str, compression: int = codecs.ZIP, layout: str = "scanlines", damage: bool = False) -> DataFrame:
    """(path, content): container files of BAND rows of the raster each; channels A (half) and Z (float), window-absolute.

    layout: scanlines, tiles (16 x 8, all mip levels by taking every other sample, so that sizes round up), or deep (as
    many samples in a pixel as its column, modulo 3; Z only). damage: chunk tables are zeroed.
    """

    def build(frame: pd.DataFrame) -> pd.DataFrame:
        band = int(frame["y"].iloc[0]) // BAND
        y0, rows = int(frame["y"].min()), int(frame["y"].max()) - int(frame["y"].min()) + 1
        z = np.zeros((rows, WIDTH), np.float32)
        z[frame["y"].to_numpy() - y0, frame["x"].to_numpy()] = frame["v"].to_numpy()
        planes, kinds = {"A": z.astype(np.float16), "Z": z}, {"A": 1, "Z": 2}
        if layout == "tiles":
            levels = [planes]
            while max(levels[-1]["Z"].shape) > 1:
                levels.append({k: v[::2, ::2] for k, v in levels[-1].items()})
            data = container.tiled_file(levels, kinds, (16, 8), compression, (0, y0), up=True)
        elif layout == "deep":
            counts = np.tile(np.arange(WIDTH) % 3, (rows, 1))
            data = container.deep_file(counts, {"Z": np.repeat(z.ravel(), counts.ravel())}, {"Z": 2}, compression, (0, y0))
        else:
            data = container.scanline_file(planes, kinds, compression, (0, y0))
        if damage:
            f = container.File(data)
            table = 8 * len(f.offsets[0])
            data = data[: f.start - table] + bytes(table) + data[f.start :]
        return pd.DataFrame({"path": [f"band{band:05d}"], "content": [data]})

    bands = raster(spark, sf_dir).groupBy(F.floor(F.col("y") / BAND).alias("band"))
    return bands.applyInPandas(build, "path string, content binary")


def tagged(spark: SparkSession, sf_dir: str, damage: bool = False) -> DataFrame:
    """(path, content): for each part a file of one pixel whose header has fields of all groups. damage: by the key, a needed attribute is gone, the window is empty or a sampling is 0."""

    def build(parts):
        for frame in parts:
            rows = []
            for key, name, brand, size, price in frame[["p_partkey", "p_name", "p_brand", "p_size", "p_retailprice"]].itertuples(index=False):
                extra = {"owner": pack("string", name), "imageCounter": pack("int", key), "framesPerSecond": pack("rational", (24000, 1001)), "isoSpeed": pack("float", size * 100), "focus": pack("float", price), "cameraMake": pack("string", brand), "cameraColorBalance": pack("v2f", (size, 0.5)), "sensorAcquisitionRectangle": pack("box2i", (0, 0, key, size)), "worldToNDC": pack("m44f", tuple(range(16)))}
                if key % 3:
                    extra["latitude"] = pack("float", key * 0.25)
                if key % 4:
                    extra["longitude"] = pack("float" if key % 5 else "int", key * 0.5 if key % 5 else key)
                extra["preview"] = ("preview", struct.pack("<II", 2, 1) + bytes([key % 256, size, 0, 255, 255, 10, key % 7, 51]))
                raw = container.scanline_file({"Z": np.zeros((1, 1))}, {"Z": 2}, codecs.NONE, extra=extra)
                if damage:
                    h = container.headers_of(raw)[0]
                    if key % 10 < 8:
                        del h.attrs[container.NEEDED[key % 10]]
                    elif key % 10 == 8:
                        h.attrs["dataWindow"] = ("box2i", struct.pack("<4i", 0, 0, -1, 0))
                    else:
                        h.attrs["channels"] = ("chlist", b"Z\0" + struct.pack("<iIii", 2, 0, 0, 1) + b"\0")
                    raw = raw[:8] + b"".join(container._attr(k, t, v) for k, (t, v) in h.attrs.items()) + b"\0"
                rows.append((f"part{key:06d}", raw))
            yield pd.DataFrame(rows, columns=["path", "content"])

    # a few bytes of a table are a file and its parsing each, so rows are dealt, whatever splits Parquet has
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size", "p_retailprice")
    return parts.repartition(4 * spark.sparkContext.defaultParallelism).mapInPandas(build, "path string, content binary")


def broken(spark: SparkSession, sf_dir: str) -> DataFrame:
    """files() in single lines, of which, by band modulo 4, the second is cut, the third has an offset of 0 and one that comes twice, and the fourth a chunk that says it is another."""

    def harm(parts):
        for frame in parts:
            out = []
            for path, raw in zip(frame["path"], frame["content"], strict=True):
                raw, k = bytes(raw), int(path[4:]) % 4
                f = container.File(raw)
                table, places = f.start - 8 * len(f.offsets[0]), list(f.offsets[0])
                if k == 1:
                    raw = raw[: places[-1] + 3]
                elif k == 2:
                    places[1], places[3] = 0, places[2]
                    raw = raw[:table] + struct.pack(f"<{len(places)}Q", *places) + raw[f.start :]
                elif k == 3:
                    (y,) = struct.unpack_from("<i", raw, places[4])
                    raw = raw[: places[4]] + struct.pack("<i", y + 1) + raw[places[4] + 4 :]
                out.append((path, raw))
            yield pd.DataFrame(out, columns=["path", "content"])

    return files(spark, sf_dir, codecs.ZIPS).mapInPandas(harm, "path string, content binary")
