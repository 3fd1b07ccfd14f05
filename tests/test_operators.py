"""Cases by hand: deep pixels, halves, geometry, colours, hashes, manifests, viewports."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rasterweave.functions import colour, geometry, halffloat, hashing, meta
from rasterweave.operators import deep, idmanifest, image, inspect, pyramid, region, views

TIE = ("t",)


def pixel(spark, *samples):
    rows = [(0, 0, float(z), float(zb), float(a), float(r), 0.0, 0.0, i) for i, (z, zb, a, r) in enumerate(samples)]
    return spark.createDataFrame(rows, "y int, x int, z double, zback double, a double, r double, g double, b double, t int")


@pytest.mark.parametrize(
    "samples, r, a",
    [
        ([(1, 1, 0.5, 0.5), (2, 2, 1, 1)], 1.0, 1.0),
        ([(2, 2, 1, 1), (1, 1, 0.5, 0.5)], 1.0, 1.0),
        ([(1, 1, 1, 0.25), (2, 2, 1, 9)], 0.25, 1.0),
        ([(1, 1, 1.4, 0.5)], 0.5, 1.0),
        ([(1, 1, -0.5, 0.5)], 0.5, 0.0),
        ([(1, 1, 0.5, 0.25), (1, 3, 0.5, 1.0), (1, 2, 0.5, 0.0)], 0.5, 0.875),
    ],
)
def test_over(spark, samples, r, a):
    got = deep.composite(pixel(spark, *samples), TIE).first()
    assert (round(got["r"], 9), got["a"]) == (r, a)


def test_no_samples_are_zeros(spark):
    grid = image.grid(spark, 0, 0, 1, 0)
    got = deep.merge_sources([pixel(spark, (1, 1, 1, 1))], grid, TIE).orderBy("x").collect()
    assert [(g["x"], g["r"], g["a"]) for g in got] == [(0, 1.0, 1.0), (1, 0.0, 0.0)]


def test_budget(spark):
    p = pixel(spark, (1, 1, 1, 1), (2, 2, 1, 1))
    with pytest.raises(ValueError):
        deep.merge_sources([p], None, TIE, budget=1)


def test_runs_equal_a_fold(spark):
    p = pixel(spark, *[(z, z + 0.5, 0.1 + 0.01 * z, 0.3) for z in range(40)])
    a, b = deep.composite(p, TIE).first(), deep.composite_runs(p, TIE, F.floor(F.col("z") / 7)).first()
    assert np.allclose([a[c] for c in "rgba"], [b[c] for c in "rgba"])


def test_state(spark):
    p = pixel(spark, (2, 2, 1, 1), (0, 0, 1, 1), (1, 1, 1, 1))
    assert deep.state_violations(p, ["t"], "sorted").first()["sample"] == 1
    q = pixel(spark, (1, 2.5, 1, 1), (2, 3, 1, 1))
    assert deep.state_violations(q, ["t"], "nonoverlapping").first()["rule"] == "nonoverlapping"
    assert deep.state_violations(q, ["t"], "sorted").count() == 0
    assert deep.state_violations(p, ["t"], "messy").count() == 0


@pytest.mark.parametrize("n, down, up", [(1, 1, 1), (2, 2, 2), (3, 2, 3), (500, 9, 10), (512, 10, 10), (0, 0, 0)])
def test_levels(spark, n, down, up):
    got = spark.range(1).select(geometry.level_count(F.lit(n), F.lit(False)).alias("d"), geometry.level_count(F.lit(n), F.lit(True)).alias("u")).first()
    assert (got["d"], got["u"]) == (down, up)


def test_half_against_numpy(spark):
    rng = np.random.default_rng(3)
    v = np.concatenate([rng.normal(0, 1, 500) * 10.0 ** rng.integers(-9, 6, 500), [0.0, 2**-24, 2**-25, 6.1034e-5, 65504, 65519, 65520, -65520, 1e9, 2.0**-14, 1.0]])
    got = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "i int, v double").select("i", halffloat.to_bits(F.col("v")).alias("b"), halffloat.to_half(F.col("v")).alias("h")).orderBy("i").toPandas()
    with np.errstate(over="ignore"):
        want = v.astype(np.float16)
    assert got["b"].tolist() == want.view(np.uint16).tolist()
    assert np.array_equal(got["h"].to_numpy(), want.astype(float))


def test_half_bits_round_trip(spark):
    bits = spark.range(65536).select(F.col("id").cast("int").alias("b"))
    finite = bits.where(~halffloat.classify(F.col("b")).isin("nan"))
    assert finite.where((halffloat.to_bits(halffloat.from_bits(F.col("b"))) != F.col("b")) & (F.col("b") != 0x8000)).count() == 0


def test_nan_compares_as_ieee(spark):
    n = F.lit(float("nan"))
    got = spark.range(1).select(halffloat.less(n, F.lit(1.0)).alias("a"), halffloat.equal(n, n).alias("b"), halffloat.equal(F.lit(-0.0), F.lit(0.0)).alias("c")).first()
    assert tuple(got) == (False, False, True)


def test_aces_matrix():
    m = colour.to_aces()
    assert np.allclose(m @ [0.8, 0.2, 0.1], [0.4460, 0.2441, 0.1234], atol=2e-4)
    assert np.allclose(m @ [1, 1, 1], [1, 1, 1], atol=1e-4)
    assert colour.to_aces(colour.ACES) is None


def test_black_has_no_chroma(spark):
    zero = F.lit(0.0)
    y, ry, by = colour.to_yc(zero, zero, zero)
    assert tuple(spark.range(1).select(y, ry, by).first()) == (0.0, 0.0, 0.0)


@pytest.mark.parametrize("name, value", [("hello", 6.0705627102400005616e-17), ("cube", -4.08461912519e15), ("sphere", 2.79018604383e15), ("plane", 3.66557617593e-11)])
def test_float_ids(spark, name, value):
    row = spark.createDataFrame([(name,)], "n string").select(hashing.as_float(idmanifest.hashed([F.col("n")], "float32")).alias("f")).first()
    assert np.isclose(row["f"], value, rtol=1e-9)


def test_murmur_published():
    assert hashing.murmur3_32(b"") == 0
    assert hashing.murmur3_32(b"", 1) == 0x514E28B7
    assert hashing.murmur3_32(b"test", 0) == 0xBA6BD213
    assert hashing.murmur3_128(b"") == (0, 0)
    assert hashing.murmur3_128(b"The quick brown fox jumps over the lazy dog") == (0xE34BBC7BBC071B6C, 0x7A433CA9C49A9347)


def test_manifest_bytes():
    e = {5: ["a", "ü"], 2**63 + 1: ["b"], 0: []}
    assert idmanifest.decode(idmanifest.encode(e)) == e
    with pytest.raises(ValueError):
        idmanifest.decode(idmanifest.encode(e)[:-3])


@pytest.mark.parametrize("v, want", [(23.976, (24000, 1001)), (0.333333, (1, 3)), (0.0, (0, 1)), (-4.0, (0, 1)), (24.00005, (24, 1)), (12.5, (25, 2))])
def test_rationals(spark, v, want):
    got = spark.range(1).select(meta.to_rational(F.lit(v)).alias("q")).first()["q"]
    assert abs(got["num"] / got["den"] - max(v, 0)) < 1e-3 and (v in (0.333333,) or (got["num"], got["den"]) == want)


@pytest.mark.parametrize(
    "channel, want",
    [("R", ("", "", "R")), ("left.R", ("", "left", "R")), ("diffuse.R", ("diffuse", "", "R")), ("diffuse.left.R", ("diffuse", "left", "R")), ("a.b.c.R", ("a.b.c", "", "R"))],
)
def test_view_names(spark, channel, want):
    p = spark.range(1).select(views.parse(F.lit(channel), ["left", "right"]).alias("p")).first()["p"]
    assert tuple(p) == want


def test_viewport_prunes(spark, tmp_path):
    grid = image.grid(spark, 0, 0, 63, 511, v=0.5).repartitionByRange(8, "y").sortWithinPartitions("y", "x")
    grid.write.parquet(str(tmp_path / "r"))
    view = region.viewport(spark.read.parquet(str(tmp_path / "r")), (0, 0, 63, 511), (13, -7, 40, 70))
    assert view.count() == 28 * 71
    plan = view._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(y" in plan and "LessThanOrEqual(y" in plan
    with pytest.raises(ValueError):
        region.viewport(grid, (0, 0, 63, 511), (100, 0, 120, 5))


def test_compare_and_nan(spark):
    a = spark.createDataFrame([("R", 0, 0, float("nan")), ("R", 0, 1, 1.0), ("G", 0, 0, 1.0)], "channel string, y int, x int, v double")
    b = spark.createDataFrame([("R", 0, 0, 3.0), ("R", 0, 1, 1.5), ("G", 0, 0, 1.0)], "channel string, y int, x int, v double")
    got = {r["channel"]: (r["n_diff"], r["max_diff"]) for r in inspect.compare(a, b, 0.1).collect()}
    assert got == {"R": (1, 0.5), "G": (0, None)}


@pytest.mark.parametrize("w, h, up", [(3, 3, False), (3, 3, True), (5, 4, True), (7, 2, False), (4, 1, True)])
def test_one_pass_pyramid_equals_the_cascade(spark, w, h, up):
    px = spark.createDataFrame([(y, x, float((x * 7 + y * 13) % 11)) for y in range(h) for x in range(w)], "y int, x int, v double")
    one = {tuple(r)[:3]: r["v"] for r in pyramid.box_pyramid(px, w, h, up).collect()}
    slow = {tuple(r)[:3]: r["v"] for r in pyramid.mip_pyramid(px, w, h, "box", up, clamp=True).collect()}
    assert one.keys() == slow.keys() and all(abs(one[k] - slow[k]) < 1e-9 for k in one)


def test_constant_stays_constant(spark):
    px = image.grid(spark, 0, 0, 8, 6, v=0.5)
    for f in ("box", "triangle", "lanczos"):
        assert {round(r["v"], 12) for r in pyramid.downsample(px, 4, 3, f).collect()} == {0.5}
