"""Images as container files, one row (path, content) each, and conversions between their layouts.

Pixels are dealt by chunk and encoded over all tasks; a file's task only joins the encoded
chunks, so it holds compressed bytes, never pixels. Such rows are read like files
(container.read_pixels takes them), and save() puts them into a folder.
"""

from __future__ import annotations

import struct
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterweave.functions import colour
from rasterweave.functions.geometry import LINES_PER_CHUNK
from rasterweave.operators.image import ALIASES, chroma, rgba_of, upsample_chroma
from rasterweave.plans.materialize import checkpointed
from rasterweave.sources import codecs, container
from rasterweave.sources.container import INCREASING

# Types of samples, and the compressions and channel sets that the academy's container allows.
UINT, HALF, FLOAT = range(3)
ACES_COMPRESSIONS = (codecs.NONE, codecs.PIZ, codecs.B44A)
ACES_MODES = ("RGB", "RGBA", "YC", "YCA")
#: Parts of files up to which their windows are broadcast.
SENT_WINDOWS = 100_000
YC_MODES: Mapping[str, tuple[str, ...]] = {"Y": ("Y",), "YA": ("Y", "A"), "YC": ("Y", "RY", "BY"), "YCA": ("Y", "RY", "BY", "A"), "RGBA": ("R", "G", "B", "A")}


@dataclass(frozen=True)
class Layout:
    """How a part is stored: types of its channels, compression, tile size (None: scanlines), line order, (x, y) sampling of channels below full size, further attributes, and its name if it is one of several."""

    kinds: Mapping[str, int]
    compression: int = codecs.ZIP
    tile: tuple[int, int] | None = None
    order: int = INCREASING
    sampling: Mapping[str, tuple[int, int]] = field(default_factory=dict)
    extra: Mapping[str, tuple[str, bytes]] = field(default_factory=dict)
    name: str | None = None

    def __post_init__(self) -> None:
        if self.tile and self.sampling:
            raise ValueError("tiles of subsampled channels")

    def grid(self, width: int, height: int) -> tuple[int, int]:
        """Chunks across and down."""
        if self.tile:
            return -(-width // self.tile[0]), -(-height // self.tile[1])
        return 1, -(-height // LINES_PER_CHUNK[self.compression])

    def chunk(self, part: int | None, box: Sequence[int], cx: int, cy: int, frame: pd.DataFrame | None) -> bytes:
        """One encoded chunk with its head; pixels that frame (channel, y, x, v) lacks are 0."""
        x0, y0, x1, y1 = box
        if self.tile:
            left, top = x0 + cx * self.tile[0], y0 + cy * self.tile[1]
            right, bottom = min(left + self.tile[0] - 1, x1), min(top + self.tile[1] - 1, y1)
        else:
            left, right, top = x0, x1, y0 + cy * LINES_PER_CHUNK[self.compression]
            bottom = min(top + LINES_PER_CHUNK[self.compression] - 1, y1)
        by = dict(tuple(frame.groupby("channel"))) if frame is not None else {}
        planes = {}
        for name, kind in sorted(self.kinds.items()):
            sx, sy = self.sampling.get(name, (1, 1))
            first = -(-top // sy) * sy
            plane = np.zeros((max(0, (bottom - first) // sy + 1), -(-(right - left + 1) // sx)), container.DTYPES[kind])
            if name in by:
                g = by[name]
                plane[(g["y"].to_numpy() - first) // sy, (g["x"].to_numpy() - left) // sx] = g["v"].to_numpy()
            planes[name] = plane, first, sy, kind
        layout, rows = [], []
        for y in range(top, bottom + 1):
            for plane, first, sy, kind in planes.values():
                if y % sy == 0:
                    layout.append((kind, plane.shape[1]))
                    rows.append(plane[(y - first) // sy].tobytes())
        data = codecs.encode(b"".join(rows), self.compression, layout, bottom - top + 1)
        place = struct.pack("<4i", cx, cy, 0, 0) if self.tile else struct.pack("<i", top)
        return (b"" if part is None else struct.pack("<i", part)) + place + struct.pack("<i", len(data)) + data

    def header(self, box: Sequence[int]) -> bytes:
        tile = (*self.tile, container.ONE, False) if self.tile else None
        return container.header_bytes(box, list(self.kinds.items()), self.compression, tile, extra=self.extra, name=self.name, order=self.order, sampling=self.sampling)


def encoded(pixels: DataFrame, layouts: Sequence[Layout], windows: DataFrame | None = None) -> DataFrame:
    """(path, content): a file of each path of (path, channel, y, x, v), and part if there are several. A part's window is the box around its pixels, or its row of windows (path, part, x0, y0, x1, y1).

    Windows of SENT_WINDOWS parts at most are sent to the pixels; a join by path would gather all
    pixels of an image in one task.
    """
    multi = len(layouts) > 1
    if multi and len({x.name for x in layouts}) < len(layouts):
        raise ValueError("parts need names of their own")
    pixels = pixels if "part" in pixels.columns else pixels.withColumn("part", F.lit(0))
    # a subsampled last row or column says nothing of the full size, which another channel has
    boxes = pixels.groupBy("path", "part").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1")) if windows is None else windows
    boxes = checkpointed(boxes)
    rows = pixels.join(F.broadcast(boxes) if boxes.count() <= SENT_WINDOWS else boxes, ["path", "part"])
    cx, cy = F.lit(0), F.lit(0)
    for k, x in enumerate(layouts):
        down = x.tile[1] if x.tile else LINES_PER_CHUNK[x.compression]
        cy = F.when(F.col("part") == k, F.floor((F.col("y") - F.col("y0")) / down)).otherwise(cy)
        if x.tile:
            cx = F.when(F.col("part") == k, F.floor((F.col("x") - F.col("x0")) / x.tile[0])).otherwise(cx)
    rows = rows.withColumn("cx", cx.cast("int")).withColumn("cy", cy.cast("int"))

    def encode(k: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        path, part, cx, cy = k
        box = [int(frame[c].iloc[0]) for c in ("x0", "y0", "x1", "y1")]
        return pd.DataFrame([(path, part, cx, cy, *box, layouts[part].chunk(part if multi else None, box, cx, cy, frame))], columns=["path", "part", "cx", "cy", "x0", "y0", "x1", "y1", "data"])

    def assemble(k: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        heads, chunks = [], []
        for part, layout in enumerate(layouts):
            own = frame[frame["part"] == part]
            if not len(own):
                raise ValueError(f"part {part} of {k[0]} has no pixels")
            box = [int(own[c].iloc[0]) for c in ("x0", "y0", "x1", "y1")]
            have = {(a, b): d for a, b, d in zip(own["cx"], own["cy"], own["data"], strict=True)}
            across, down = layout.grid(box[2] - box[0] + 1, box[3] - box[1] + 1)
            chunks.append([have.get((a, b)) or layout.chunk(part if multi else None, box, a, b, None) for b in range(down) for a in range(across)])
            heads.append(layout.header(box))
        flags = container.TILED if not multi and layouts[0].tile else 0
        return pd.DataFrame([(k[0], container._file(heads, chunks, flags, [x.order for x in layouts]))], columns=["path", "content"])

    parts = rows.groupBy("path", "part", "cx", "cy").applyInPandas(encode, "path string, part int, cx int, cy int, x0 int, y0 int, x1 int, y1 int, data binary")
    return parts.groupBy("path").applyInPandas(assemble, "path string, content binary")


def save(files: DataFrame, folder: str) -> DataFrame:
    """Each content as a file of a folder that all executors share, under its path's last component; returns (path, bytes)."""

    def run(parts):
        import os

        for part in parts:
            done = []
            for path, content in zip(part["path"], part["content"], strict=True):
                at = os.path.join(folder, os.path.basename(path))
                with open(at + ".part", "wb") as out:
                    out.write(content)
                os.replace(at + ".part", at)
                done.append((at, len(content)))
            yield pd.DataFrame(done, columns=["path", "bytes"])

    return files.select("path", "content").mapInPandas(run, "path string, bytes bigint")


def _long(wide: DataFrame, columns: Mapping[str, Column]) -> DataFrame:
    """(path, channel, y, x, v) of columns by channel."""
    pairs = F.create_map(*[x for name, c in columns.items() for x in (F.lit(name), c.cast("double"))])
    return wide.select("path", F.explode(pairs).alias("channel", "v"), F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"))


def write_rgba(pixels: DataFrame, compression: int = codecs.ZIP) -> DataFrame:
    """Files of (path, y, x, r, g, b, a): four half channels."""
    return encoded(_long(pixels, {c.upper(): F.col(c) for c in "rgba"}), [Layout(dict.fromkeys("RGBA", HALF), compression)])


def write_yc(pixels: DataFrame, mode: str = "YCA", compression: int = codecs.ZIP, extra: Mapping[str, tuple[str, bytes]] | None = None) -> DataFrame:
    """Files of (path, y, x, r, g, b, a) in a mode of YC_MODES: luminance at full size, chroma at half of it, half channels."""
    names = YC_MODES[mode]
    luma, _, _ = colour.to_yc(F.col("r"), F.col("g"), F.col("b"))
    full = {"Y": luma, "A": F.col("a"), "R": F.col("r"), "G": F.col("g"), "B": F.col("b")}
    rows = _long(pixels, {n: c for n, c in full.items() if n in names})
    if "RY" in names:
        half = chroma(pixels, ["path"]).withColumn("y", F.col("cy") * 2).withColumn("x", F.col("cx") * 2)
        rows = rows.unionByName(_long(half, {"RY": F.col("ry"), "BY": F.col("by")}))
    return encoded(rows, [Layout(dict.fromkeys(names, HALF), compression, sampling={n: (2, 2) for n in ("RY", "BY") if n in names}, extra=extra or {})])


def write_aces(pixels: DataFrame, mode: str = "RGBA", compression: int = codecs.PIZ, chromaticities: Sequence[float] = colour.REC709) -> DataFrame:
    """Files of (path, y, x, r, g, b, a) in the academy's colour space and container: scanlines, three compressions, RGB or YC with or without alpha."""
    if compression not in ACES_COMPRESSIONS:
        raise ValueError("this compression is not allowed")
    if mode not in ACES_MODES:
        raise ValueError("this channel set is not allowed")
    r, g, b = colour.apply(colour.to_aces(chromaticities), F.col("r"), F.col("g"), F.col("b"))
    into = pixels.select("path", "y", "x", r.alias("r"), g.alias("g"), b.alias("b"), "a")
    extra = {"chromaticities": ("chromaticities", struct.pack("<8f", *colour.ACES)), "acesImageContainerFlag": ("int", struct.pack("<i", 1))}
    if mode.startswith("Y"):
        return write_yc(into, mode, compression, extra)
    return encoded(_long(into, {c: F.col(c.lower()) for c in mode}), [Layout(dict.fromkeys(mode, HALF), compression, extra=extra)])


def write_stereo(left: DataFrame, right: DataFrame, multi: bool = False, compression: int = codecs.ZIP) -> DataFrame:
    """Files of two views (path, y, x, r, g, b, a): one part, with the right view's channels named by it and the left the default, or a part for each."""
    if multi:
        parts = [_long(d, {c.upper(): F.col(c) for c in "rgba"}).withColumn("part", F.lit(k)) for k, d in enumerate((left, right))]
        return encoded(parts[0].unionByName(parts[1]), [Layout(dict.fromkeys("RGBA", HALF), compression, name=v, extra={"view": ("string", v.encode())}) for v in ("left", "right")])
    rows = _long(left, {c.upper(): F.col(c) for c in "rgba"}).unionByName(_long(right, {f"right.{c.upper()}": F.col(c) for c in "rgba"}))
    views = b"".join(struct.pack("<i", len(v)) + v.encode() for v in ("left", "right"))
    return encoded(rows, [Layout({**dict.fromkeys("RGBA", HALF), **{f"right.{c}": HALF for c in "RGBA"}}, compression, extra={"multiView": ("stringvector", views)})])


def layouts_of(spark: SparkSession, files: DataFrame) -> list[tuple[list[str], list[Layout]]]:
    """(paths, layouts of the parts) of each kind of file among files: as many rows for the driver as there are files, headers only."""

    def run(parts):
        for part in parts:
            for path, raw in zip(part["path"], part["content"], strict=True):
                f = container.File(raw)
                yield pd.DataFrame([(path, k, *c, h.compression, h.tile()[0] if h.tiled else 0, h.tile()[1] if h.tiled else 0, h.attrs.get("name", ("", b""))[1].decode()) for k, h in enumerate(f.headers) for c in h.channels()], columns=["path", "part", "channel", "kind", "sx", "sy", "compression", "tw", "th", "name"])

    rows = files.select("path", "content").mapInPandas(run, "path string, part int, channel string, kind int, sx int, sy int, compression int, tw int, th int, name string")
    each = rows.groupBy("path").agg(F.array_sort(F.collect_list(F.struct(*[c for c in rows.columns if c != "path"]))).alias("c"))
    out = []
    for r in each.groupBy("c").agg(F.collect_list("path").alias("paths")).collect():
        by: dict[int, list] = {}
        for c in r["c"]:
            by.setdefault(c["part"], []).append(c)
        out.append((r["paths"], [Layout({c["channel"]: c["kind"] for c in cs}, cs[0]["compression"], (cs[0]["tw"], cs[0]["th"]) if cs[0]["tw"] else None, sampling={c["channel"]: (c["sx"], c["sy"]) for c in cs if (c["sx"], c["sy"]) != (1, 1)}, name=cs[0]["name"] or None) for _, cs in sorted(by.items())]))
    return out


def windows_of(files: DataFrame) -> DataFrame:
    """(path, part, x0, y0, x1, y1) of the data windows in files' headers."""

    def run(parts):
        for part in parts:
            yield pd.DataFrame([(path, k, *h.box()) for path, raw in zip(part["path"], part["content"], strict=True) for k, h in enumerate(container.File(raw).headers)], columns=["path", "part", "x0", "y0", "x1", "y1"])

    return files.select("path", "content").mapInPandas(run, "path string, part int, x0 int, y0 int, x1 int, y1 int")


def convert(spark: SparkSession, files: DataFrame, compression: int | None = None, tile: tuple[int, int] | None = None, scanlines: bool = False, parts: str = "") -> DataFrame:
    """(path, content) of files in another compression, as tiles or as scanlines, or with their views as parts ('multi') or their parts as one ('single', channels named by part).

    Pixels are decoded and encoded again chunk by chunk over all tasks. Windows come from the
    headers, and files are stored first, as each use of a plan would make them again.
    """
    out = []
    files = checkpointed(files.select("path", "content"))
    for paths, layouts in layouts_of(spark, files):
        own = files.where(F.col("path").isin(paths))
        rows = None
        for k in range(len(layouts)):
            part = container.read_pixels(spark, own, part=k).withColumn("part", F.lit(k))
            rows = part if rows is None else rows.unionByName(part)
        windows = windows_of(own)
        if parts == "multi" and len(layouts) == 1:
            view = lambda c: c.rpartition(".")[0]
            names = sorted({view(c) for c in layouts[0].kinds})
            at = F.create_map(*[x for c in layouts[0].kinds for x in (F.lit(c), F.lit(names.index(view(c))))])
            rows = rows.withColumn("part", F.element_at(at, F.col("channel"))).withColumn("channel", F.element_at(F.split("channel", r"\."), -1))
            windows = windows.drop("part").withColumn("part", F.explode(F.array(*[F.lit(k) for k in range(len(names))])))
            layouts = [replace(layouts[0], name=n or "main", kinds={c.rpartition(".")[2]: t for c, t in layouts[0].kinds.items() if view(c) == n}) for n in names]
        elif parts == "single" and len(layouts) > 1:
            name = F.create_map(*[x for k, y in enumerate(layouts) for x in (F.lit(k), F.lit("" if y.name == "main" else f"{y.name}."))])
            windows = windows.groupBy("path").agg(F.lit(0).alias("part"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
            rows = rows.withColumn("channel", F.concat(F.element_at(name, F.col("part")), F.col("channel"))).withColumn("part", F.lit(0))
            layouts = [replace(layouts[0], name=None, kinds={("" if y.name == "main" else f"{y.name}.") + c: t for y in layouts for c, t in y.kinds.items()})]
        layouts = [replace(x, compression=x.compression if compression is None else compression, tile=None if scanlines else tile or x.tile) for x in layouts]
        out.append(encoded(rows, layouts, windows))
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found


def _wide(long: DataFrame, names: Sequence[str]) -> DataFrame:
    """(path, y, x, c_NAME, ...) of some channels of long-form pixels."""
    return long.where(F.col("channel").isin(*names)).groupBy("path", "y", "x").agg(*[F.max(F.when(F.col("channel") == n, F.col("v"))).alias(f"c_{n}") for n in names])


def read_any(spark: SparkSession, files: DataFrame) -> DataFrame:
    """(path, y, x, r, g, b, a) of files of any colour layout: luminance and chroma, luminance alone (on all three colours), or colours by their names. Windows start at 0 or on an even line."""
    out = []
    for paths, layouts in layouts_of(spark, files):
        names = set(layouts[0].kinds)
        long = container.read_pixels(spark, files.where(F.col("path").isin(paths)))
        full = sorted(names & {"Y", *(n for some in ALIASES.values() for n in some)})
        wide = _wide(long, full)
        alpha = F.col("c_A") if "A" in names else F.lit(1.0)
        if {"Y", "RY", "BY"} <= names:
            boxes = wide.groupBy("path").agg(F.max("x").alias("w"), F.min("y").alias("y0"), F.max("y").alias("h"))
            half = _wide(long, ["RY", "BY"])
            plane = half.join(boxes, "path").select("path", "w", "h", "y0", F.floor((F.col("y") - F.col("y0")) / 2).cast("bigint").alias("cy"), F.floor(F.col("x") / 2).cast("int").alias("cx"), F.col("c_RY").alias("ry"), F.col("c_BY").alias("by"))
            up = upsample_chroma(plane, F.col("w") + 1, F.col("h") - F.col("y0") + 1, ["path", "y0"]).select("path", (F.col("y") + F.col("y0")).alias("y"), "x", "ry", "by")
            r, g, b = colour.from_yc(F.col("c_Y"), F.col("ry"), F.col("by"))
            out.append(wide.join(up, ["path", "y", "x"]).select("path", "y", "x", r.alias("r"), g.alias("g"), b.alias("b"), alpha.alias("a")))
        elif "Y" in names:
            out.append(wide.select("path", "y", "x", *[F.col("c_Y").alias(c) for c in "rgb"], alpha.alias("a")))
        else:
            out.append(rgba_of(wide.select("path", "y", "x", *[F.col(f"c_{n}").alias(n) for n in full]), ("path", "y", "x")))
    found = out[0]
    for more in out[1:]:
        found = found.unionByName(more)
    return found
