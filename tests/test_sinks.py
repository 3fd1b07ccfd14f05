"""Files that are written by DataFrame sinks and read back: layouts, colours, views, line orders, conversions."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from rasterweave.functions import colour
from rasterweave.sources import codecs, container, sinks
from rasterweave.sources.sinks import FLOAT, HALF, Layout


@pytest.fixture(scope="module")
def image(spark):
    """Two images of 21 x 11 and 21 x 6 pixels."""
    r = np.random.default_rng(3)
    rows = [(p, y, x, *map(float, r.random(4).astype(np.float16))) for p, h in (("a", 11), ("b", 6)) for y in range(h) for x in range(21)]
    return spark.createDataFrame(rows, "path string, y int, x int, r double, g double, b double, a double").cache()


def long(image, names="rgba"):
    return image.select("path", F.explode(F.create_map(*[x for c in names for x in (F.lit(c.upper()), F.col(c))])).alias("channel", "v"), "y", "x")


def same(a, b, columns=("path", "channel", "y", "x", "v")):
    a, b = a.select(*columns), b.select(*columns)
    return a.count() == b.count() and a.exceptAll(b).count() == 0


@pytest.mark.parametrize("order", [container.INCREASING, container.DECREASING, container.RANDOM])
@pytest.mark.parametrize("tile", [None, (8, 4)])
def test_layouts_come_back(spark, image, tile, order):
    files = sinks.encoded(long(image), [Layout({"R": HALF, "G": FLOAT, "B": HALF, "A": FLOAT}, codecs.ZIPS, tile, order)]).cache()
    assert same(container.read_pixels(spark, files), long(image))
    table = container.read_chunks(spark, files).where("path = 'a'").orderBy("idx").toPandas()["offset"].tolist()
    assert (table == sorted(table)) == (order == container.INCREASING) and (table[::-1] == sorted(table)) == (order == container.DECREASING)
    assert {r["attrs"]["lineOrder"]["value"][0] for r in container.read_headers(spark, files).collect()} == {order}


def test_holes_are_zero_and_parts_need_names(spark, image):
    rows = long(image, "r").where("y <> 3 OR x < 4")
    got = container.read_pixels(spark, sinks.encoded(rows, [Layout({"R": FLOAT}, codecs.ZIPS, (4, 2))])).where("path = 'a' AND y = 3").toPandas()
    assert len(got) == 21 and (got[got["x"] >= 4]["v"] == 0).all() and (got[got["x"] < 4]["v"] > 0).any()
    with pytest.raises(ValueError):
        sinks.encoded(rows, [Layout({"R": FLOAT}), Layout({"R": FLOAT})])
    with pytest.raises(ValueError):
        Layout({"RY": HALF}, tile=(4, 4), sampling={"RY": (2, 2)})


def test_rgba_and_save(spark, image, tmp_path):
    files = sinks.write_rgba(image).cache()
    assert same(sinks.read_any(spark, files), image, image.columns)
    assert {r["bytes"] for r in sinks.save(files, str(tmp_path)).collect()} == {len(r["content"]) for r in files.collect()}
    back = container.read_pixels(spark, str(tmp_path / "a"))
    assert same(back.select("channel", "y", "x", "v"), long(image.where("path = 'a'")), ("channel", "y", "x", "v"))


def brute_yc(frame):
    """Luminance at full size and mean chroma of 2 x 2, in halves, and the colours that bilinear chroma gives back."""
    h, w = frame["y"].max() + 1, frame["x"].max() + 1
    r, g, b = (frame.sort_values(["y", "x"])[c].to_numpy().reshape(h, w) for c in "rgb")
    wr, wg, wb = colour.LUMINANCE
    luma = r * wr + g * wg + b * wb
    planes = {}
    for name, c in (("RY", r), ("BY", b)):
        q = (c - luma) / luma
        planes[name] = np.array([[q[y : y + 2, x : x + 2].mean() for x in range(0, w, 2)] for y in range(0, h, 2)]).astype(np.float16).astype(float)
    luma = luma.astype(np.float16).astype(float)
    full = {}
    for name, p in planes.items():
        full[name] = np.array([[np.mean([p[j, i] for j in {y // 2, min((y + 1) // 2, p.shape[0] - 1)} for i in {x // 2, min((x + 1) // 2, p.shape[1] - 1)}]) for x in range(w)] for y in range(h)])
    red, blue = (full["RY"] + 1) * luma, (full["BY"] + 1) * luma
    return luma, planes, np.stack([red, (luma - wr * red - wb * blue) / wg, blue])


@pytest.mark.parametrize("mode", list(sinks.YC_MODES))
def test_luminance_and_chroma(spark, image, mode):
    files = sinks.write_yc(image, mode).cache()
    heads = {n: (sx, sy) for r in files.collect() for n, _, sx, sy in container.File(bytes(r["content"])).headers[0].channels()}
    assert set(heads) == set(sinks.YC_MODES[mode]) and all((s == (2, 2)) == (n in ("RY", "BY")) for n, s in heads.items())
    got = sinks.read_any(spark, files).toPandas()
    assert len(got) == 21 * 17
    for path, frame in image.toPandas().groupby("path"):
        own = got[got["path"] == path].sort_values(["y", "x"])
        assert np.allclose(own["a"], frame.sort_values(["y", "x"])["a"] if "A" in sinks.YC_MODES[mode] else 1.0)
        luma, _, back = brute_yc(frame)
        want = frame.sort_values(["y", "x"])[list("rgb")].to_numpy().T if mode == "RGBA" else back.reshape(3, -1) if "RY" in heads else np.stack([luma.ravel()] * 3)
        assert np.allclose(own[list("rgb")].to_numpy().T, want, atol=1e-6)


def test_aces_container(spark, image):
    files = sinks.write_aces(image).collect()
    h = container.File(bytes(files[0]["content"])).headers[0]
    assert h.attrs["acesImageContainerFlag"][1] == b"\x01\0\0\0" and np.allclose(np.frombuffer(h.attrs["chromaticities"][1], "<f4"), colour.ACES)
    got = container.read_pixels(spark, sinks.write_aces(image)).where("channel = 'G' AND path = 'a'").toPandas().sort_values(["y", "x"])["v"].to_numpy()
    p = image.where("path = 'a'").toPandas().sort_values(["y", "x"])[list("rgb")].to_numpy()
    assert np.array_equal(got, (p @ np.array(colour.to_aces()).T)[:, 1].astype(np.float16).astype(float))
    for wrong in ({"compression": codecs.ZIP}, {"mode": "Y"}):
        with pytest.raises(ValueError):
            sinks.write_aces(image, **wrong)
    assert set(sinks.read_any(spark, sinks.write_aces(image, "YC", codecs.NONE)).columns) == {"path", "y", "x", "r", "g", "b", "a"}


@pytest.mark.parametrize("multi", [False, True])
def test_two_views(spark, image, multi):
    right = image.withColumn("r", F.col("g")).withColumn("g", F.lit(0.25))
    files = sinks.write_stereo(image, right, multi).cache()
    heads = container.File(bytes(files.collect()[0]["content"])).headers
    assert len(heads) == 1 + multi
    if multi:
        assert [h.attrs["view"][1] for h in heads] == [b"left", b"right"]
        got = container.read_pixels(spark, files, part=1)
    else:
        assert heads[0].attrs["multiView"][1] == b"\x04\0\0\0left\x05\0\0\0right"
        got = container.read_pixels(spark, files).where("channel LIKE 'right.%'").withColumn("channel", F.substring("channel", 7, 9))
    assert same(got, long(right))
    there = sinks.convert(spark, files, parts="single" if multi else "multi").cache()
    assert len(container.File(bytes(there.collect()[0]["content"])).headers) == 2 - multi
    names = {n for r in there.collect() for h in container.File(bytes(r["content"])).headers for n, *_ in h.channels()}
    assert names == ({f"{v}.{c}" for v in ("left", "right") for c in "RGBA"} if multi else set("RGBA"))


def test_conversions_keep_pixels(spark, image):
    files = sinks.write_rgba(image, codecs.RLE).cache()
    tiled = sinks.convert(spark, files, codecs.ZIP, (8, 8)).cache()
    assert all(container.File(bytes(r["content"])).headers[0].tiled for r in tiled.collect())
    again = sinks.convert(spark, tiled, codecs.PIZ, scanlines=True).cache()
    h = container.File(bytes(again.collect()[0]["content"])).headers[0]
    assert not h.tiled and h.compression == codecs.PIZ
    assert same(container.read_pixels(spark, tiled), long(image)) and same(container.read_pixels(spark, again), long(image))


def test_a_place_outside_the_file_is_an_error(spark, image):
    raw = bytes(sinks.write_rgba(image.where("path = 'a'"), codecs.ZIPS).collect()[0]["content"])
    f = container.File(raw)
    table = f.start - 8 * len(f.offsets[0])
    broken = raw[:table] + (1 << 40).to_bytes(8, "little") + raw[table + 8 :]
    with pytest.raises(codecs.Damaged):
        list(container.File(broken).chunks(0))
    assert len(list(container.File(broken, recover=True).chunks(0))) == 11
    files = spark.createDataFrame(pd.DataFrame({"path": ["x"], "content": [bytearray(broken)]}))
    with pytest.raises(Exception, match="no place in the file"):
        container.read_pixels(spark, files).count()
    assert same(container.read_pixels(spark, files, recover=True).withColumn("path", F.lit("a")), long(image.where("path = 'a'")))
