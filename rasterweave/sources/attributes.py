"""Typed header attributes: decoding by wire type, the standard fields by group, dumps, previews, and the rules for headers and chunks."""

from __future__ import annotations

import struct
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterweave.functions import colour
from rasterweave.sources import codecs, container

# Wire types that are a row of numbers, and the standard fields with their types, by group.
NUMBERS: Mapping[str, str] = {
    "int": "<i", "float": "<f", "double": "<d", "box2i": "<4i", "box2f": "<4f", "v2i": "<2i", "v2f": "<2f", "v2d": "<2d", "v3i": "<3i", "v3f": "<3f", "v3d": "<3d", "m33f": "<9f", "m33d": "<9d", "m44f": "<16f", "m44d": "<16d",
    "rational": "<iI", "timecode": "<2I", "keycode": "<7i", "chromaticities": "<8f", "compression": "<B", "lineOrder": "<B", "envmap": "<B", "deepImageState": "<B", "tiledesc": "<IIB",
}
GROUPS: Mapping[str, Mapping[str, str]] = {
    "production": {"owner": "string", "comments": "string", "capDate": "string", "utcOffset": "float", "framesPerSecond": "rational", "reelName": "string", "imageCounter": "int"},
    "exposure": {"aperture": "float", "focus": "float", "isoSpeed": "float", "expTime": "float", "shutterAngle": "float", "tStop": "float"},
    "focal": {"nominalFocalLength": "float", "effectiveFocalLength": "float", "pinholeFocalLength": "float"},
    "camera": {"cameraMake": "string", "cameraModel": "string", "cameraSerialNumber": "string", "cameraFirmwareVersion": "string", "cameraUuid": "string", "cameraLabel": "string", "cameraCCTSetting": "float", "cameraTintSetting": "float", "cameraColorBalance": "v2f"},
    "lens": {"lensMake": "string", "lensModel": "string", "lensSerialNumber": "string", "lensFirmwareVersion": "string"},
    "geo": {"longitude": "float", "latitude": "float", "altitude": "float"},
    "display": {"whiteLuminance": "float", "xDensity": "float", "adoptedNeutral": "v2f", "chromaticities": "chromaticities"},
    "matrices": {"worldToCamera": "m44f", "worldToNDC": "m44f"},
    "sensor": {"sensorCenterOffset": "v2f", "sensorOverallDimensions": "v2f", "sensorPhotositePitch": "float", "sensorAcquisitionRectangle": "box2i"},
    "texture": {"envmap": "envmap", "wrapmodes": "string"},
}


def pack(kind: str, value) -> tuple[str, bytes]:
    """(type, bytes) of a value: a string, a list of strings, a number or a sequence of numbers."""
    if kind == "string":
        return kind, value.encode()
    if kind == "stringvector":
        return kind, b"".join(struct.pack("<i", len(v.encode())) + v.encode() for v in value)
    return kind, struct.pack(NUMBERS[kind], *(value if isinstance(value, (list, tuple)) else [value]))


def unpack(kind: str, raw: bytes) -> tuple[list[float] | None, str | None]:
    """(numbers, text) of an attribute; (None, None) if its type is not known or its size is wrong. Text of numbers has nine digits, as tells all floats apart."""
    try:
        if kind == "string":
            return None, raw.decode("utf-8", "replace")
        if kind == "stringvector":
            out, at = [], 0
            while at < len(raw):
                (n,) = struct.unpack_from("<i", raw, at)
                if n < 0 or at + 4 + n > len(raw):
                    return None, None
                out.append(raw[at + 4 : at + 4 + n].decode("utf-8", "replace"))
                at += 4 + n
            return None, ",".join(out)
        if kind == "chlist":
            h = container.Header({"channels": (kind, raw)})
            return None, " ".join(f"{n}:{('uint', 'half', 'float')[k]}" + ("" if (sx, sy) == (1, 1) else f"/{sx}x{sy}") for n, k, sx, sy in h.channels())
        if kind in NUMBERS and struct.calcsize(NUMBERS[kind]) == len(raw):
            found = struct.unpack(NUMBERS[kind], raw)
            return [float(v) for v in found], " ".join(str(v) if isinstance(v, int) else f"{v:.9g}" for v in found)
    except (struct.error, IndexError, ValueError):
        pass
    return None, None


def attributes(headers: DataFrame, names: Sequence[str] | None = None) -> DataFrame:
    """(path, part, name, type, numbers, text) of each attribute of container.read_headers(), or of those of some names; others are not decoded."""
    each = headers.where("attrs IS NOT NULL").select("path", "part", F.explode("attrs").alias("name", "a"))
    each = (each if names is None else each.where(F.col("name").isin(*names))).select("path", "part", "name", "a.type", "a.value")

    @F.pandas_udf("numbers array<double>, text string")
    def decode(kinds: pd.Series, values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([unpack(k, bytes(v)) for k, v in zip(kinds, values, strict=True)], columns=["numbers", "text"])

    return each.withColumn("_d", decode("type", "value")).select("path", "part", "name", "type", "_d.numbers", "_d.text")


def typed(headers: DataFrame, *groups: str) -> DataFrame:
    """(path, part, one column for each field of some groups): null where the header lacks it, or has it as another type. A location without longitude or latitude takes 0 for it, and is null only without both. Parts that have no field of the groups are left out.

    One aggregation over the attributes of a part, however many groups.
    """
    fields = {n: k for g in groups for n, k in GROUPS[g].items()}
    rows = attributes(headers, list(fields))

    def one(name: str, kind: str) -> Column:
        mine = (F.col("name") == name) & (F.col("type") == kind)
        value = F.col("text") if kind == "string" else F.col("numbers")[0] if struct.calcsize(NUMBERS[kind]) == struct.calcsize(NUMBERS[kind][-1]) and len(NUMBERS[kind]) == 2 else F.col("numbers")
        return F.max(F.when(mine, value)).alias(name)

    found = rows.groupBy("path", "part").agg(*[one(n, k) for n, k in fields.items()])
    if "geo" in groups:
        there = F.col("longitude").isNotNull() | F.col("latitude").isNotNull()
        found = found if len(groups) > 1 else found.where(there)
        found = found.withColumns({c: F.when(there, F.coalesce(c, F.lit(0.0))) for c in ("longitude", "latitude")})
    return found


def dump(headers: DataFrame) -> DataFrame:
    """(path, part, line): name, type and value of each attribute, as a lister prints them."""
    return attributes(headers).select("path", "part", F.concat_ws(" ", "name", F.concat(F.lit("("), "type", F.lit("):")), F.coalesce("text", F.lit("?"))).alias("line"))


def preview_pixels(headers: DataFrame) -> DataFrame:
    """(path, part, y, x, r, g, b, a) of the preview in a header: bytes made linear, alpha only scaled."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # many small previews make one frame, a large one its own
        def joined(held: list[tuple]) -> pd.DataFrame:
            n = [w * h for _, _, w, h, _ in held]
            at = np.concatenate([np.arange(k) for k in n])
            across = np.repeat([max(1, w) for _, _, w, _, _ in held], n)
            v = np.frombuffer(b"".join(raw[8:] for *_, raw in held), np.uint8).reshape(-1, 4)
            return pd.DataFrame({"path": np.repeat(np.array([p for p, *_ in held], object), n), "part": np.repeat([k for _, k, *_ in held], n), "y": at // across, "x": at % across, **{c: v[:, i].astype(np.int32) for i, c in enumerate("rgba")}})

        for frame in parts:
            held, total = [], 0
            for path, part, raw in zip(frame["path"], frame["part"], frame["raw"], strict=True):
                w, h = struct.unpack_from("<II", raw)
                if len(raw) != 8 + 4 * w * h:
                    raise codecs.Damaged("a preview of another size")
                held.append((path, part, w, h, raw))
                total += w * h
                if total > 100_000:
                    yield joined(held)
                    held, total = [], 0
            if held:
                yield joined(held)

    has = headers.where("attrs.preview IS NOT NULL").select("path", "part", F.col("attrs.preview.value").alias("raw"))
    rows = has.mapInPandas(run, "path string, part int, y int, x int, r int, g int, b int, a int")
    return rows.select("path", "part", "y", "x", *[colour.linear(F.col(c) / 255.0).alias(c) for c in "rgb"], (F.col("a") / 255.0).alias("a"))


def header_problems(spark: SparkSession, files: str | DataFrame) -> DataFrame:
    """(path, part, rule) of the rules for headers that a file's headers break."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in parts:
            rows = []
            for path, raw in zip(frame["path"], frame["content"], strict=True):
                try:
                    rows += [(path, k, rule) for k, h in enumerate(container.headers_of(raw)) for rule in h.problems()]
                except codecs.Damaged as e:
                    rows.append((path, 0, str(e)))
            yield pd.DataFrame(rows, columns=["path", "part", "rule"])

    return container._files(spark, files).mapInPandas(run, "path string, part int, rule string")


def file_problems(spark: SparkSession, files: str | DataFrame) -> DataFrame:
    """(path, part, idx, rule) of a whole file: headers, places in the chunk table that are outside the file, come twice or hold another chunk, and chunks that cannot be decoded."""

    def of(path: str, raw: bytes) -> list[tuple]:
        try:
            f = container.File(raw)
        except codecs.Damaged as e:
            return [(path, None, None, str(e))]
        out = []
        for part, table in enumerate(f.offsets):
            seen: dict[int, int] = {}
            for k, place in enumerate(table):
                if not f.start <= place < len(raw):
                    out.append((path, part, k, "no place in the file"))
                    continue
                if place in seen:
                    out.append((path, part, k, "place comes twice"))
                    continue
                seen[place] = k
                try:
                    c, _ = f.chunk_at(place)
                    if c.part != part or f._index(c) != k:
                        out.append((path, part, k, "holds another chunk"))
                        continue
                    (container.decode_deep if f.headers[part].deep else container.decode_chunk)(f, c)
                except (codecs.Damaged, KeyError, ValueError) as e:
                    out.append((path, part, k, "cannot be decoded" if not str(e).startswith("a chunk") else str(e)))
        return out

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in parts:
            rows = [r for path, raw in zip(frame["path"], frame["content"], strict=True) for r in of(path, raw)]
            yield pd.DataFrame(rows, columns=["path", "part", "idx", "rule"]).astype({"part": "Int32", "idx": "Int32"})

    return container._files(spark, files).mapInPandas(run, "path string, part int, idx int, rule string")
