"""Environment maps: directions, lookups, resampling and diffuse blur.

A map is a raster (y, x, r, g, b, a) that starts at 0, 0. Directions are structs x, y, z.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterweave.operators.image import grid

FACES = ("+X", "-X", "+Y", "-Y", "+Z", "-Z")
COLOURS = ("r", "g", "b", "a")
#: Target directions that a task blurs at once, and source cells up to which the source is broadcast (it is shrunk to six faces of BLUR_FACE before).
BLUR_ROWS, BLUR_FACE = 256, 40
#: Cells of a map up to which it is sent to the points of a lookup (6 numbers each).
SENT_CELLS = 100_000


def _vec(x: Column, y: Column, z: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), z.cast("double").alias("z"))


def lat_long(d: Column) -> Column:
    """struct(lat, lon) of a direction; the zero vector is (0, 0)."""
    r = F.sqrt(d["x"] * d["x"] + d["z"] * d["z"])
    n = F.sqrt(d["x"] * d["x"] + d["y"] * d["y"] + d["z"] * d["z"])
    safe = F.when(n == 0, 1.0).otherwise(n)
    lat = F.when(n == 0, 0.0).when(r < F.abs(d["y"]), F.acos(r / safe) * F.signum(d["y"])).otherwise(F.asin(d["y"] / safe))
    lon = F.when((d["x"] == 0) & (d["z"] == 0), 0.0).otherwise(F.atan2(d["x"], d["z"]))
    return F.struct(lat.alias("lat"), lon.alias("lon"))


def direction(lat: Column, lon: Column) -> Column:
    return _vec(F.sin(lon) * F.cos(lat), F.sin(lat), F.cos(lon) * F.cos(lat))


def lat_long_pixel(lat: Column, lon: Column, width: int, height: int) -> tuple[Column, Column]:
    return (lon / (-2 * math.pi) + 0.5) * (width - 1), (lat / -math.pi + 0.5) * (height - 1)


def pixel_lat_long(x: Column, y: Column, width: int, height: int) -> tuple[Column, Column]:
    lat = -math.pi * (y / (height - 1) - 0.5) if height > 1 else F.lit(0.0)
    lon = -2 * math.pi * (x / (width - 1) - 0.5) if width > 1 else F.lit(0.0)
    return lat, lon


def face_size(width: int, height: int) -> int:
    return min(width, height // 6)


def cube_position(d: Column, size: int) -> Column:
    """struct(face 0-5, u, v) of a direction: the dominant axis, ties in the order x, y, z."""
    ax, ay, az = F.abs(d["x"]), F.abs(d["y"]), F.abs(d["z"])
    on_x = (ax >= ay) & (ax >= az)
    on_y = ~on_x & (ay >= az)
    most = F.greatest(ax, ay, az)
    safe = F.when(most == 0, 1.0).otherwise(most)
    at = lambda c: (c / safe + 1) / 2 * (size - 1)
    face = F.when(most == 0, 0).when(on_x, F.when(d["x"] > 0, 0).otherwise(1)).when(on_y, F.when(d["y"] > 0, 2).otherwise(3)).otherwise(F.when(d["z"] > 0, 4).otherwise(5))
    u = F.when(most == 0, 0.0).when(on_x, at(d["y"])).otherwise(at(d["x"]))
    v = F.when(most == 0, 0.0).when(on_x | on_y, at(d["z"])).otherwise(at(d["y"]))
    return F.struct(face.alias("face"), u.alias("u"), v.alias("v"))


def cube_direction(face: Column, u: Column, v: Column, size: int) -> Column:
    p = u / (size - 1) * 2 - 1 if size > 1 else F.lit(0.0)
    q = v / (size - 1) * 2 - 1 if size > 1 else F.lit(0.0)
    sign = F.when(face % 2 == 0, 1.0).otherwise(-1.0)
    axis = F.floor(face / 2)
    return _vec(F.when(axis == 0, sign).otherwise(p), F.when(axis == 0, p).when(axis == 1, sign).otherwise(q), F.when(axis == 2, sign).otherwise(q))


# How u and v of a face lie in its square of the image; for x and y, which of the two runs along it and whether it runs backwards.
_LAYOUT = ((("v", False), ("u", True)), (("v", True), ("u", True)), (("u", False), ("v", True)), (("u", False), ("v", False)), (("u", True), ("v", True)), (("u", False), ("v", True)))


def _laid(face: Column, u: Column, v: Column, size: int, axis: int) -> Column:
    out = F.lit(0.0)
    for k, layout in enumerate(_LAYOUT):
        name, back = layout[axis]
        c = u if name == "u" else v
        out = F.when(face == k, (size - 1) - c if back else c).otherwise(out)
    return out


def cube_pixel(face: Column, u: Column, v: Column, size: int) -> tuple[Column, Column]:
    """Image coordinates of a position; faces stand below one another."""
    return _laid(face, u, v, size, 0), _laid(face, u, v, size, 1) + face * size


def pixel_cube(x: Column, y: Column, size: int) -> Column:
    """struct(face, u, v) of image coordinates: the inverse of cube_pixel at pixel centres."""
    face = F.floor(y / size).cast("int")
    row = y - face * size
    u, v = F.lit(0.0), F.lit(0.0)
    for k, (along_x, along_y) in enumerate(_LAYOUT):
        own = {}
        for (name, back), c in ((along_x, x), (along_y, row)):
            own[name] = (size - 1) - c if back else c.cast("double")
        u, v = F.when(face == k, own["u"]).otherwise(u), F.when(face == k, own["v"]).otherwise(v)
    return F.struct(face.alias("face"), u.alias("u"), v.alias("v"))


def pixel_direction(x: Column, y: Column, kind: str, width: int, height: int) -> Column:
    if kind == "latlong":
        return direction(*pixel_lat_long(x, y, width, height))
    size = face_size(width, height)
    p = pixel_cube(x, y, size)
    return cube_direction(p["face"], p["u"], p["v"], size)


def direction_pixel(d: Column, kind: str, width: int, height: int) -> tuple[Column, Column]:
    if kind == "latlong":
        p = lat_long(d)
        return lat_long_pixel(p["lat"], p["lon"], width, height)
    size = face_size(width, height)
    p = cube_position(d, size)
    return cube_pixel(p["face"], p["u"], p["v"], size)


def _corners(x: Column, y: Column, width: int, height: int) -> Column:
    """The four cells around a point and their bilinear weights; coordinates are clamped to the edges, also across the seam."""
    x0, y0 = F.floor(x), F.floor(y)
    fx, fy = x - x0, y - y0
    clamp = lambda c, n: F.greatest(F.least(c, F.lit(n - 1)), F.lit(0))
    cell = lambda cx, cy, w: F.struct(clamp(cx, width).cast("int").alias("x"), clamp(cy, height).cast("bigint").alias("y"), w.alias("w"))
    return F.array(cell(x0, y0, (1 - fx) * (1 - fy)), cell(x0 + 1, y0, fx * (1 - fy)), cell(x0, y0 + 1, (1 - fx) * fy), cell(x0 + 1, y0 + 1, fx * fy))


def sample(points: DataFrame, image: DataFrame, width: int, height: int, key: Sequence[str]) -> DataFrame:
    """Bilinear samples of image at points (key..., px, py, weight): the weighted mean for each key.

    Each point is sent to its four cells, which meet the image in one join on (y, x); what a
    key gets is added up, so that filtered lookups are the same plan with more points. Which side
    is small is said here: Spark guesses it from the files' sizes, knows nothing of the points
    that a row becomes, and would gather them all on the driver to broadcast them.
    """
    sent = points.withColumn("_c", F.explode(_corners(F.col("px"), F.col("py"), width, height))).select(*key, F.col("_c.y").alias("_cy"), F.col("_c.x").alias("_cx"), (F.col("_c.w") * F.col("weight")).alias("_w"))
    cells = image.select(F.col("y").cast("bigint").alias("_cy"), F.col("x").cast("int").alias("_cx"), *COLOURS)
    met = sent.where("_w <> 0").join(F.broadcast(cells) if width * height <= SENT_CELLS else cells.hint("merge"), ["_cy", "_cx"])
    return met.groupBy(*key).agg(*[(F.sum(F.col("_w") * F.col(c)) / F.sum("_w")).alias(c) for c in COLOURS])


def _unit(v: Column) -> Column:
    n = F.sqrt(v["x"] * v["x"] + v["y"] * v["y"] + v["z"] * v["z"])
    n = F.when(n == 0, 1.0).otherwise(n)
    return _vec(v["x"] / n, v["y"] / n, v["z"] / n)


def _cross(a: Column, b: Column) -> Column:
    return _vec(a["y"] * b["z"] - a["z"] * b["y"], a["z"] * b["x"] - a["x"] * b["z"], a["x"] * b["y"] - a["y"] * b["x"])


def filtered_points(directions: DataFrame, kind: str, width: int, height: int, radius: float, samples: int, key: Sequence[str]) -> DataFrame:
    """(key..., px, py, weight): samples x samples directions around each d, in its tangent plane, with tent weights."""
    zero = F.lit(0.0)
    out = directions.withColumn("_d", _unit(F.col("d")))
    across = F.when(F.abs(F.col("_d.x")) > 0.707, _vec(zero, -F.col("_d.z"), F.col("_d.y"))).otherwise(_vec(zero, F.col("_d.z"), -F.col("_d.y")))
    out = out.withColumn("_a", _unit(across)).withColumn("_b", _unit(_cross(F.col("_d"), F.col("_a"))))
    steps = [(2 * i + 2) / (samples + 1) - 1 for i in range(samples)]
    offsets = F.array(*[F.struct(F.lit(s * radius).alias("i"), F.lit(t * radius).alias("j"), F.lit((1 - abs(s)) * (1 - abs(t))).alias("w")) for t in steps for s in steps])
    out = out.withColumn("_o", F.explode(offsets))
    moved = lambda c: F.col(f"_d.{c}") + F.col("_o.i") * F.col(f"_a.{c}") + F.col("_o.j") * F.col(f"_b.{c}")
    px, py = direction_pixel(F.col("_p"), kind, width, height)
    return out.withColumn("_p", _vec(moved("x"), moved("y"), moved("z"))).select(*key, px.alias("px"), py.alias("py"), F.col("_o.w").alias("weight"))


def converted_size(kind: str, face: int) -> tuple[int, int]:
    return (4 * face, 2 * face) if kind == "latlong" else (face, 6 * face)


def convert(spark: SparkSession, image: DataFrame, kind: str, width: int, height: int, to: str, to_width: int, to_height: int, filter: float = 1.0, samples: int = 5) -> DataFrame:
    """image resampled to another layout: each target pixel's direction, looked up with a filter of its angular size."""
    target = grid(spark, 0, 0, to_width - 1, to_height - 1).withColumn("d", pixel_direction(F.col("x"), F.col("y"), to, to_width, to_height))
    radius = 0.5 * 2 * math.pi * filter / to_width if to == "latlong" else 1.5 * filter / face_size(to_width, to_height)
    points = filtered_points(target.withColumnsRenamed({"x": "tx", "y": "ty"}), kind, width, height, radius, samples, ["ty", "tx"])
    return sample(points, image, width, height, ["ty", "tx"]).withColumnsRenamed({"tx": "x", "ty": "y"})


def solid_angles(face: int) -> np.ndarray:
    """(6 face^2, 4): direction and weight of each cell of a cube; cells on an edge are in two faces and count half, in a corner a third."""
    axis = np.linspace(-1, 1, face) if face > 1 else np.zeros(1)
    rows = []
    edge = lambda i: i in (0, face - 1)
    for f in range(6):
        for u in range(face):
            for v in range(face):
                p, q, s = axis[u], axis[v], 1.0 if f % 2 == 0 else -1.0
                d = ((s, p, q), (p, s, q), (p, q, s))[f // 2]
                n2 = d[0] ** 2 + d[1] ** 2 + d[2] ** 2
                part = 3 if edge(u) and edge(v) else 2 if edge(u) or edge(v) else 1
                rows.append((*(c / math.sqrt(n2) for c in d), 1 / (n2 * math.sqrt(n2)) / part))
    return np.array(rows)


def diffuse(spark: SparkSession, source: DataFrame, targets: DataFrame, key: Sequence[str]) -> DataFrame:
    """Cosine-weighted mean of source (dx, dy, dz, weight, colours) over the half space of each target direction (key..., dx, dy, dz).

    The source is the map shrunk to six faces of BLUR_FACE at most, which bounds its broadcast;
    targets are blurred in blocks, a matrix product each.
    """
    cells = source.count()
    if cells > 6 * BLUR_FACE**2:
        raise ValueError("shrink the map first")
    held = source.select("dx", "dy", "dz", "weight", *COLOURS).toPandas().to_numpy(float)
    sent = spark.sparkContext.broadcast(held)
    schema = ", ".join([f"{k} {targets.schema[k].dataType.simpleString()}" for k in key] + [f"{c} double" for c in COLOURS])

    def blur(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = sent.value
        for part in parts:
            for at in range(0, len(part), BLUR_ROWS):
                some = part.iloc[at : at + BLUR_ROWS]
                w = np.maximum(some[["dx", "dy", "dz"]].to_numpy(float) @ s[:, :3].T, 0) * s[:, 3]
                total = w.sum(1, keepdims=True)
                out = np.divide(w @ s[:, 4:], total, out=np.zeros((len(some), 4)), where=total > 0)
                yield pd.DataFrame({**{k: some[k].to_numpy() for k in key}, **{c: out[:, i] for i, c in enumerate(COLOURS)}})

    return targets.select(*key, "dx", "dy", "dz").mapInPandas(blur, schema)


def inferred(width: Column, height: Column, forced: Column, header: Column) -> Column:
    """The kind of a map: what is forced, else its header's, else by shape, else latlong."""
    return F.coalesce(forced, header, F.when(height == 6 * width, "cube").otherwise("latlong"))


def padded(spark: SparkSession, image: DataFrame, width: int, height: int, top: int, bottom: int) -> DataFrame:
    """image between black rows."""
    moved = image.select((F.col("y") + top).cast("bigint").alias("y"), F.col("x").cast("int").alias("x"), *COLOURS)
    black = grid(spark, 0, 0, width - 1, top + bottom - 1) if top + bottom else None
    if black is None:
        return moved
    rows = black.withColumn("y", F.when(F.col("y") < top, F.col("y")).otherwise(F.col("y") + height))
    return moved.unionByName(rows.select("y", "x", *[F.lit(0.0).alias(c) for c in COLOURS]))


def six_faces(faces: Sequence[DataFrame], size: int) -> DataFrame:
    """One cube image of six square ones, in the order of FACES."""
    out = None
    for k, f in enumerate(faces):
        moved = f.select((F.col("y") + k * size).alias("y"), "x", *COLOURS)
        out = moved if out is None else out.unionByName(moved)
    return out
