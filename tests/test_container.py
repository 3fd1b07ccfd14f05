"""The container and its codecs: published layouts by hand, round trips, damage, pruning."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterweave.sources import codecs, container, wavelet

HALF, FLOAT, UINT = 1, 2, 0
KINDS = {"A": HALF, "B": HALF, "Z": FLOAT, "id": UINT}


def planes(h=37, w=29, seed=1):
    r = np.random.default_rng(seed)
    y, x = np.mgrid[0:h, 0:w]
    return {"A": ((x + y) / (h + w)).astype(np.float16), "B": r.normal(0, 3, (h, w)).astype(np.float16), "Z": (x * 0.37 - y).astype(np.float32), "id": r.integers(0, 2**32, (h, w), dtype=np.uint64).astype(np.uint32)}


def frame(spark, tmp_path, data, **options):
    (tmp_path / "f.img").write_bytes(data)
    return container.read_pixels(spark, str(tmp_path / "f.img"), **options).toPandas()


def grid(f, name):
    g = f[f["channel"] == name]
    out = np.full((g["y"].max() - g["y"].min() + 1, g["x"].max() - g["x"].min() + 1), np.nan)
    out[g["y"] - g["y"].min(), g["x"] - g["x"].min()] = g["v"]
    return out


@pytest.mark.parametrize("compression", [codecs.NONE, codecs.RLE, codecs.ZIPS, codecs.ZIP, codecs.PIZ])
@pytest.mark.parametrize("origin", [(0, 0), (13, -7)])
def test_scanlines(spark, tmp_path, compression, origin):
    p = planes()
    f = frame(spark, tmp_path, container.scanline_file(p, KINDS, compression, origin))
    assert f["y"].min() == origin[1] and f["x"].min() == origin[0] and len(f) == 4 * 37 * 29
    for k in p:
        assert np.array_equal(grid(f, k), p[k].astype(float))


def test_an_uncompressed_file_by_hand():
    raw = container.scanline_file({"Y": np.array([[1.0, 2.0], [3.0, 4.0]])}, {"Y": FLOAT}, codecs.NONE)
    assert raw[:8] == bytes((0x76, 0x2F, 0x31, 0x01, 2, 0, 0, 0))
    assert raw[8:26] == b"channels\0chlist\0\x13\0" and raw.endswith(struct.pack("<ii2f", 0, 8, 1, 2) + struct.pack("<ii2f", 1, 8, 3, 4))
    first = struct.unpack_from("<2Q", raw, len(raw) - 2 * 16 - 16)
    assert first == (len(raw) - 32, len(raw) - 16)


def test_split_by_hand():
    assert codecs.split(bytes([10, 1, 20, 2, 30])).tolist() == [10, (20 - 10 + 128) % 256, 138, (1 - 30 + 128) % 256, 129]
    for n in range(40):
        data = bytes(np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8))
        assert codecs.joined(codecs.split(data)) == data


def test_runs_by_hand():
    assert codecs.run_lengths(np.frombuffer(b"aaaabc", np.uint8)) == bytes((3,)) + b"a" + bytes((254,)) + b"bc"
    assert codecs.from_run_lengths(bytes((3,)) + b"a" + bytes((254,)) + b"bc", 6).tobytes() == b"aaaabc"
    r = np.random.default_rng(0)
    for n in (0, 1, 2, 3, 127, 128, 129, 500, 1000):
        for top in (2, 256):
            data = r.integers(0, top, n, dtype=np.uint8)
            assert np.array_equal(codecs.from_run_lengths(codecs.run_lengths(data), n), data)
    for bad in (b"\x05", b"\xf0ab", b"\x7fa"):
        with pytest.raises(codecs.Damaged):
            codecs.from_run_lengths(bad, 3)


def test_pxr24(spark, tmp_path):
    p = planes()
    p["Z"][0, :4] = [np.inf, -np.inf, np.nan, 3.4028235e38]
    f = frame(spark, tmp_path, container.scanline_file(p, KINDS, codecs.PXR24))
    for k in ("A", "B", "id"):
        assert np.array_equal(grid(f, k), p[k].astype(float))
    z = grid(f, "Z")
    assert z[0, 0] == np.inf and z[0, 1] == -np.inf and np.isnan(z[0, 2]) and np.isfinite(z[0, 3])
    assert np.allclose(z[1:], p["Z"][1:], rtol=2**-16)


@pytest.mark.parametrize("compression", [codecs.B44, codecs.B44A])
def test_b44(spark, tmp_path, compression):
    p = planes()
    f = frame(spark, tmp_path, container.scanline_file(p, KINDS, compression))
    assert np.array_equal(grid(f, "Z"), p["Z"].astype(float)) and np.array_equal(grid(f, "id"), p["id"].astype(float))
    assert np.abs(grid(f, "A") - p["A"]).max() < 0.02


def test_flat_blocks():
    data = np.full((8, 8), 0.5, np.float16).tobytes()
    layout = [(HALF, 8)] * 8
    assert len(codecs.b44(data, layout, 8, True)) == 12 and len(codecs.b44(data, layout, 8, False)) == 56
    for flat in (True, False):
        assert codecs.from_b44(codecs.b44(data, layout, 8, flat), layout, 8) == data
    assert codecs.pack_blocks(np.full((1, 16), 0x3800), True) == [bytes((0xB8, 0x00, 0xFC))]


def test_tiles_and_levels(spark, tmp_path):
    p = planes(40, 70)
    levels = [p] + [{k: v[:: 1 << n, :: 1 << n][: max(1, 40 >> n), : max(1, 70 >> n)] for k, v in p.items()} for n in range(1, 7)]
    data = container.tiled_file(levels, KINDS, (16, 32))
    for n in (0, 2):
        f = frame(spark, tmp_path, data, level=(n, n))
        for k in p:
            assert np.array_equal(grid(f, k), levels[n][k].astype(float))
    c = container.read_chunks(spark, str(tmp_path / "f.img")).toPandas()
    assert (c["lx"] == 0).sum() == 10 and c["idx"].tolist() == list(range(len(c)))


def test_a_viewport_is_a_crop_and_reads_few_chunks(spark, tmp_path):
    p = planes(128, 128)
    data = container.tiled_file([p], KINDS, (32, 32), origin=(13, -7))
    f = frame(spark, tmp_path, data, box=(13 + 40, -7 + 40, 13 + 60, -7 + 60), channels=["Z"])
    assert set(f["channel"]) == {"Z"} and np.array_equal(grid(f, "Z"), p["Z"][40:61, 40:61].astype(float))
    whole = container.File(data)
    assert len(list(container._wanted(whole, 0, (0, 0), (53, 33, 73, 53)))) == 1 and whole.headers[0].chunk_total() == 16


@pytest.mark.parametrize("compression", [codecs.NONE, codecs.RLE, codecs.ZIPS])
def test_deep(spark, tmp_path, compression):
    r = np.random.default_rng(5)
    counts = r.integers(0, 4, (6, 9))
    n = int(counts.sum())
    samples = {"A": r.random(n).astype(np.float16), "Z": r.random(n).astype(np.float32)}
    (tmp_path / "d.img").write_bytes(container.deep_file(counts, samples, {"A": HALF, "Z": FLOAT}, compression, (2, 5)))
    got = container.read_deep(spark, str(tmp_path / "d.img")).orderBy("y", "x", "sample").toPandas()
    assert len(got) == n and np.allclose([v["Z"] for v in got["values"]], samples["Z"]) and got["y"].min() == 5
    with pytest.raises(ValueError):
        container.deep_file(counts, samples, {"A": HALF, "Z": FLOAT}, codecs.ZIP)


def test_headers(spark, tmp_path):
    (tmp_path / "a.img").write_bytes(container.scanline_file(planes(), KINDS, extra={"owner": ("string", b"me")}))
    (tmp_path / "b.img").write_bytes(b"nothing of the kind")
    got = {r["path"].rsplit("/", 1)[1]: r for r in container.read_headers(spark, str(tmp_path)).collect()}
    assert bytes(got["a.img"]["attrs"]["owner"]["value"]) == b"me" and got["a.img"]["damaged"] is None
    assert got["b.img"]["attrs"] is None and got["b.img"]["damaged"]


def test_recovery():
    p = planes()
    raw = bytearray(container.scanline_file(p, KINDS, codecs.ZIPS))
    f = container.File(bytes(raw))
    table = f.start - 8 * len(f.offsets[0])
    raw[table : f.start] = bytes(8 * len(f.offsets[0]))
    damaged = container.File(bytes(raw), recover=True)
    assert damaged.offsets == f.offsets
    cut = container.File(bytes(raw[: f.offsets[0][20] + 5]), recover=True)
    assert sum(o > 0 for o in cut.offsets[0]) == 20 and len(list(cut.chunks(0))) == 20


def test_damage_is_told():
    raw = container.scanline_file(planes(), KINDS, codecs.ZIP)
    f = container.File(raw)
    chunk = next(f.chunks(0))
    chunk.data = chunk.data[:-9]
    with pytest.raises(codecs.Damaged):
        container.decode_chunk(f, chunk)
    for cut in (3, 40, 200, f.start - 3):
        with pytest.raises(codecs.Damaged):
            container.File(raw[:cut])
    with pytest.raises(codecs.Damaged):
        codecs.decode(zlib.compress(b"x" * 50), 60, codecs.ZIP, [], 1)


def test_sinks(spark, tmp_path):
    rows = spark.range(2 * 2 * 12).select((F.col("id") % 2).alias("image"), F.when(F.col("id") % 4 < 2, "A").otherwise("Z").alias("channel"), (F.floor(F.col("id") / 16)).cast("int").alias("y"), (F.floor(F.col("id") / 4) % 4).cast("int").alias("x"), (F.col("id") * 0.5).alias("v"))
    written = container.write_images(rows, str(tmp_path), {"Z": FLOAT}).collect()
    assert len(written) == 2
    back = container.read_pixels(spark, str(tmp_path / "*.img")).select("channel", "y", "x", "v")
    assert back.exceptAll(rows.select("channel", "y", "x", "v")).count() == 0 and back.count() == 48
    container.write_pyramid(rows.withColumn("level", F.col("image").cast("int")), str(tmp_path / "pyr"))
    assert "PartitionFilters: [isnotnull(level" in spark.read.parquet(str(tmp_path / "pyr")).where("level = 1")._jdf.queryExecution().toString()
    parts = spark.createDataFrame([(1, 0, "a"), (1, 1, "a")], "image int, part int, part_name string")
    with pytest.raises(ValueError):
        container.write_parts(parts, str(tmp_path / "parts"))


@pytest.mark.parametrize("shape", [(1, 1), (1, 7), (2, 2), (5, 3), (32, 29), (16, 64)])
@pytest.mark.parametrize("top", [2, 900, 1 << 14, 1 << 16])
def test_wavelets_are_undone(shape, top):
    r = np.random.default_rng(shape[0])
    v = r.integers(0, top, shape).astype(np.uint16)
    for signed in {top <= 1 << 14, False}:
        assert np.array_equal(wavelet.inverse(wavelet.forward(v, signed), signed), v)
    assert np.array_equal(wavelet.from_huffman(wavelet.huffman(v.ravel()), v.size), v.ravel())


def test_a_wavelet_by_hand():
    """Four values: means and differences along the rows, then along the columns."""
    assert wavelet.forward(np.array([[10, 4], [6, 2]], np.uint16), True).tolist() == [[5, 5], [3, 2]]
    assert wavelet.forward(np.array([[10, 4, 9]], np.uint16), True).tolist() == [[10, 4, 9]]


def test_codes_by_hand():
    """Three symbols and the run: a prefix code that satisfies Kraft's equality, canonical in order of symbol."""
    lengths = wavelet.code_lengths({5: 8, 6: 4, 9: 2, 10: 1})
    assert lengths == {5: 1, 6: 2, 9: 3, 10: 3} and wavelet.canonical(lengths) == {5: 1, 6: 1, 9: 0, 10: 1}
    with pytest.raises(codecs.Damaged):
        wavelet.from_huffman(wavelet.huffman(np.array([5, 5, 6], np.uint16))[:-1], 3)


def test_attributes_by_type(spark):
    """Typed fields, wrong types and sizes, problems of files, and chunks that cannot be decoded."""
    from rasterweave.sources import attributes as T

    for kind, value, text in [("int", -3, "-3"), ("v2f", (0.5, 2), "0.5 2"), ("rational", (24, 1), "24 1"), ("string", "é", "é"), ("stringvector", ["left", "r"], "left,r"), ("tiledesc", (16, 8, 1), "16 8 1"), ("double", 0.1, "0.1")]:
        assert T.unpack(*T.pack(kind, value))[1] == text
    assert T.unpack("int", b"\0") == T.unpack("no such", b"") == T.unpack("stringvector", b"\xff\0\0\0a") == (None, None)
    smooth = np.add.outer(np.arange(40.0), np.arange(64.0))
    raw = container.scanline_file({"Z": smooth}, {"Z": FLOAT}, codecs.ZIPS, extra={"latitude": T.pack("float", 2), "altitude": T.pack("string", "high"), "owner": T.pack("string", "me")})
    f = container.File(raw)
    at = f.offsets[0][4] + 8
    assert len(f.chunk_at(f.offsets[0][4])[0].data) < 256
    data = [("a", bytearray(raw)), ("b", bytearray(raw[:at] + b"\xff\xff" + raw[at + 2 :])), ("c", bytearray(b"no container")), ("d", bytearray(raw[: f.start - 9]))]
    files = spark.createDataFrame(data, "path string, content binary")
    heads = container.read_headers(spark, files)
    geo = {r["path"]: r for r in T.typed(heads, "geo").collect()}
    assert geo["a"]["latitude"] == 2 and geo["a"]["longitude"] == 0 and geo["a"]["altitude"] is None
    assert {r["owner"] for r in T.typed(heads, "production").collect()} == {"me"}
    found = {(r["path"], r["idx"]): r["rule"] for r in T.file_problems(spark, files).collect()}
    assert found[("b", 4)] == "cannot be decoded" and ("c", None) in found and ("d", None) in found and not any(p == "a" for p, _ in found)
    assert {r["path"] for r in T.header_problems(spark, files).collect()} == {"c"}
