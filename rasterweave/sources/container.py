"""The layered raster container: headers, chunk tables, pixels and deep samples as DataFrames.

Files are read by Spark's binaryFile source, so any store that Spark reads will do. A first pass
parses headers and offset tables and emits one row for each wanted chunk, pruned by part,
level and window before a byte is decoded; chunks are then dealt evenly over tasks and decoded.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterweave.functions.geometry import LINES_PER_CHUNK
from rasterweave.operators.pyramid import level_sizes, level_total
from rasterweave.sources import codecs

# The container's magic number and version, flags of the version field, level modes.
MAGIC, VERSION = 20000630, 2
TILED, LONG_NAMES, DEEP, MULTI = 0x200, 0x400, 0x800, 0x1000
ONE, MIP, RIP = range(3)
INCREASING, DECREASING, RANDOM = range(3)
DTYPES = {0: "<u4", 1: "<f2", 2: "<f4"}
#: Chunks, or bytes of them, that a read picks at once, and pixels that it decodes into one frame, at least.
PICKED, DECODED = (500, 4_000_000), 65_536
NEEDED = ("channels", "compression", "dataWindow", "displayWindow", "lineOrder", "pixelAspectRatio", "screenWindowCenter", "screenWindowWidth")


@dataclass
class Header:
    attrs: dict[str, tuple[str, bytes]] = field(default_factory=dict)
    tiled: bool = False
    deep: bool = False

    def box(self, name: str = "dataWindow") -> tuple[int, int, int, int]:
        return struct.unpack("<4i", self.attrs[name][1])

    @property
    def width(self) -> int:
        return self.box()[2] - self.box()[0] + 1

    @property
    def height(self) -> int:
        return self.box()[3] - self.box()[1] + 1

    @property
    def compression(self) -> int:
        return self.attrs["compression"][1][0]

    @property
    def lines(self) -> int:
        return LINES_PER_CHUNK[self.compression]

    def channels(self) -> list[tuple[str, int, int, int]]:
        """(name, type, x sampling, y sampling) in order of name."""
        raw, at, out = self.attrs["channels"][1], 0, []
        while raw[at] != 0:
            end = raw.index(0, at)
            kind, _, sx, sy = struct.unpack_from("<iIii", raw, end + 1)
            out.append((raw[at:end].decode(), kind, sx, sy))
            at = end + 17
        return sorted(out)

    def tile(self) -> tuple[int, int, int, bool]:
        """(width, height, level mode, rounding up)."""
        w, h, mode = struct.unpack("<IIB", self.attrs["tiles"][1])
        return w, h, mode & 15, bool(mode >> 4)

    def levels(self) -> list[tuple[int, int, int, int]]:
        """(lx, ly, width, height), in the order of the chunk table."""
        _, _, mode, up = self.tile()
        nx, ny = level_total(self.width, up), level_total(self.height, up)
        n = max(nx, ny)
        ws, hs = level_sizes(self.width, up, n), level_sizes(self.height, up, n)
        if mode == MIP:
            return [(k, k, ws[k], hs[k]) for k in range(n)]
        if mode == RIP:
            return [(x, y, ws[x], hs[y]) for y in range(ny) for x in range(nx)]
        return [(0, 0, self.width, self.height)]

    def chunk_total(self) -> int:
        if self.tiled:
            tw, th, _, _ = self.tile()
            return sum(-(-w // tw) * -(-h // th) for _, _, w, h in self.levels())
        return -(-self.height // self.lines)

    def problems(self) -> list[str]:
        """What the rules for headers find wrong."""
        out = [f"no {n}" for n in NEEDED if n not in self.attrs]
        if out:
            return out
        if self.width <= 0 or self.height <= 0:
            out.append("window is empty")
        if not self.channels():
            out.append("no channels")
        if any(sx < 1 or sy < 1 for _, _, sx, sy in self.channels()):
            out.append("sampling below one")
        if self.tiled and any((sx, sy) != (1, 1) for _, _, sx, sy in self.channels()):
            out.append("tiles of subsampled channels")
        if self.deep and self.compression not in (codecs.NONE, codecs.RLE, codecs.ZIPS):
            out.append("deep data in this compression")
        return out


@dataclass
class Chunk:
    part: int
    index: int
    place: int
    y: int = 0
    tx: int = 0
    ty: int = 0
    lx: int = 0
    ly: int = 0
    counts: bytes = b""
    unpacked: int = 0
    data: bytes = b""
    end: int = 0


class File:
    """Headers and offset tables of a file's bytes; recover: rebuild damaged tables from the chunks themselves."""

    def __init__(self, raw: bytes, recover: bool = False):
        if len(raw) < 8:
            raise codecs.Damaged("too short")
        magic, version = struct.unpack_from("<II", raw)
        if magic != MAGIC:
            raise codecs.Damaged("not a container")
        if version & 255 != VERSION:
            raise codecs.Damaged("unknown version")
        self.raw, self.flags, self.recover = raw, version, recover
        self.multi = bool(version & MULTI)
        self.headers: list[Header] = []
        at = 8
        try:
            while True:
                header, at = self._header(at)
                if self.multi and not header.attrs:
                    break
                self.headers.append(header)
                if not self.multi:
                    break
            self.offsets = []
            for h in self.headers:
                if h.problems():
                    raise codecs.Damaged("; ".join(h.problems()))
                n = h.chunk_total()
                if n > max(1, len(raw)):
                    raise codecs.Damaged("more chunks than bytes")
                self.offsets.append(list(struct.unpack_from(f"<{n}Q", raw, at)))
                at += 8 * n
        except (struct.error, IndexError, ValueError, KeyError) as e:
            raise codecs.Damaged(str(e)) from e
        self.start = at
        if recover and any(not self.start <= o < len(raw) for t in self.offsets for o in t):
            self._rebuild()

    def _header(self, at: int) -> tuple[Header, int]:
        raw, h = self.raw, Header(tiled=bool(self.flags & TILED), deep=bool(self.flags & DEEP))
        while raw[at] != 0:
            end = raw.index(0, at)
            kind_end = raw.index(0, end + 1)
            (size,) = struct.unpack_from("<i", raw, kind_end + 1)
            at2 = kind_end + 5
            if size < 0 or at2 + size > len(raw):
                raise codecs.Damaged("an attribute ends past the file")
            h.attrs[raw[at:end].decode("utf-8", "replace")] = (raw[end + 1 : kind_end].decode("utf-8", "replace"), raw[at2 : at2 + size])
            at = at2 + size
        kind = h.attrs.get("type", ("", b""))[1].decode()
        if kind:
            h.tiled, h.deep = kind in ("tiledimage", "deeptile"), kind.startswith("deep")
        return h, at + 1

    def chunk_at(self, place: int) -> tuple[Chunk, int]:
        """The chunk that begins at a place, and where it ends."""
        raw, at = self.raw, place
        c = Chunk(0, -1, place)
        try:
            if self.multi:
                (c.part,) = struct.unpack_from("<i", raw, at)
                at += 4
            h = self.headers[c.part]
            if h.tiled:
                c.tx, c.ty, c.lx, c.ly = struct.unpack_from("<4i", raw, at)
                at += 16
            else:
                (c.y,) = struct.unpack_from("<i", raw, at)
                at += 4
            if h.deep:
                head, size, c.unpacked = struct.unpack_from("<3Q", raw, at)
                at += 24
                c.counts = raw[at : at + head]
                at += head
            else:
                (size,) = struct.unpack_from("<i", raw, at)
                at += 4
        except (struct.error, IndexError) as e:
            raise codecs.Damaged("a chunk's head is cut") from e
        if size < 0 or at + size > len(raw):
            raise codecs.Damaged("a chunk ends past the file")
        c.data, c.end = raw[at : at + size], at + size
        return c, c.end

    def _rebuild(self) -> None:
        """Walk over the chunks from the first on and enter those that parse where they belong."""
        tables = [[0] * len(t) for t in self.offsets]
        at = self.start
        while at < len(self.raw):
            try:
                c, end = self.chunk_at(at)
                k = self._index(c)
            except (codecs.Damaged, KeyError):
                break
            if 0 <= k < len(tables[c.part]):
                tables[c.part][k] = at
            at = end
        self.offsets = tables

    def _index(self, c: Chunk) -> int:
        h = self.headers[c.part]
        if not h.tiled:
            return (c.y - h.box()[1]) // h.lines
        tw, th, _, _ = h.tile()
        n = 0
        for lx, ly, w, hh in h.levels():
            across = -(-w // tw)
            if (lx, ly) == (c.lx, c.ly):
                return n + c.ty * across + c.tx
            n += across * -(-hh // th)
        raise KeyError("no such level")

    def box_of(self, c: Chunk) -> tuple[int, int, int, int]:
        """First and last x and y of a chunk, absolute."""
        h = self.headers[c.part]
        x0, y0, x1, y1 = h.box()
        if not h.tiled:
            return x0, c.y, x1, min(c.y + h.lines - 1, y1)
        tw, th, _, _ = h.tile()
        w, hh = next((w, hh) for lx, ly, w, hh in h.levels() if (lx, ly) == (c.lx, c.ly))
        return x0 + c.tx * tw, y0 + c.ty * th, x0 + min((c.tx + 1) * tw, w) - 1, y0 + min((c.ty + 1) * th, hh) - 1

    def chunks(self, part: int) -> Iterator[Chunk]:
        """Chunks in the order of the table. A place that holds none is an error, or, when recovering, a chunk that is lost."""
        for k, place in enumerate(self.offsets[part]):
            if self.start <= place < len(self.raw):
                c, _ = self.chunk_at(place)
                c.index = k
                yield c
            elif not self.recover:
                raise codecs.Damaged(f"chunk {k} of part {part} has no place in the file")


def headers_of(raw: bytes) -> list[Header]:
    """The headers alone, whatever the rules say of them."""
    if len(raw) < 8 or struct.unpack_from("<I", raw)[0] != MAGIC:
        raise codecs.Damaged("not a container")
    f = File.__new__(File)
    f.raw, (f.flags,) = raw, struct.unpack_from("<I", raw, 4)
    out, at = [], 8
    try:
        while True:
            h, at = f._header(at)
            if not h.attrs and f.flags & MULTI:
                return out
            out.append(h)
            if not f.flags & MULTI:
                return out
    except (struct.error, IndexError, ValueError) as e:
        raise codecs.Damaged(str(e)) from e


def decode_chunk(f: File, c: Chunk, wanted: Sequence[str] | None = None) -> dict[str, np.ndarray]:
    """Channel planes (lines x samples) of a flat chunk; subsampled channels have their own size."""
    h = f.headers[c.part]
    x0, y0, x1, y1 = f.box_of(c)
    rows = [(name, kind, -(-(x1 - x0 + 1) // sx), sy) for name, kind, sx, sy in h.channels()]
    layout, names = [], []
    for y in range(y0, y1 + 1):
        for name, kind, width, sy in rows:
            if y % sy == 0:
                layout.append((kind, width))
                names.append(name)
    size = sum(codecs.SIZE[k] * w for k, w in layout)
    plain = codecs.decode(c.data, size, h.compression, layout, y1 - y0 + 1)
    out: dict[str, list] = {r[0]: [] for r in rows}
    at = 0
    for name, (kind, width) in zip(names, layout, strict=True):
        n = codecs.SIZE[kind] * width
        if wanted is None or name in wanted:
            out[name].append(np.frombuffer(plain, DTYPES[kind], width, at))
        at += n
    return {k: np.stack(v) for k, v in out.items() if v}


def decode_deep(f: File, c: Chunk) -> tuple[np.ndarray, dict[str, list[np.ndarray]]]:
    """(counts of each pixel, lines x width; for each channel the samples of each line)."""
    h = f.headers[c.part]
    x0, y0, x1, y1 = f.box_of(c)
    lines, width = y1 - y0 + 1, x1 - x0 + 1
    table = np.frombuffer(codecs.decode(c.counts, 4 * lines * width, h.compression, [], lines), "<u4").reshape(lines, width)
    counts = np.diff(table, axis=1, prepend=0).astype(np.int64)
    if (counts < 0).any():
        raise codecs.Damaged("counts go down")
    per = sum(codecs.SIZE[k] for _, k, _, _ in h.channels())
    if int(counts.sum()) * per != c.unpacked:
        raise codecs.Damaged("wrong number of samples")
    plain = codecs.decode(c.data, c.unpacked, h.compression, [], lines)
    out: dict[str, list[np.ndarray]] = {name: [] for name, _, _, _ in h.channels()}
    at = 0
    for y in range(lines):
        n = int(counts[y].sum())
        for name, kind, _, _ in h.channels():
            out[name].append(np.frombuffer(plain, DTYPES[kind], n, at))
            at += n * codecs.SIZE[kind]
    return counts, out


def _files(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """(path, content) of files: those of a path, or a DataFrame that has them."""
    return path.select("path", "content") if isinstance(path, DataFrame) else spark.read.format("binaryFile").load(path).select("path", "content")


def read_headers(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """(path, part, attrs: name to (type, value)) of every part; damaged files have `damaged` instead."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            paths, parts, damaged, ends, names, types, values = [], [], [], [0], [], [], []
            for p, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    found = [(i, h.attrs, None) for i, h in enumerate(File(content.as_py()).headers)]
                except codecs.Damaged as e:
                    found = [(None, {}, str(e))]
                for i, attrs, why in found:
                    paths.append(p)
                    parts.append(i)
                    damaged.append(why)
                    names += attrs
                    types += [t for t, _ in attrs.values()]
                    values += [v for _, v in attrs.values()]
                    ends.append(len(names))
            # maps as flat columns: rows of Python's maps take most of a header's time
            starts = pa.array([None if w is not None else e for w, e in zip(damaged, ends[:-1], strict=True)] + ends[-1:], pa.int32())
            fields = pa.StructArray.from_arrays([pa.array(types, pa.string()), pa.array(values, pa.binary())], names=["type", "value"])
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(parts, pa.int32()), pa.MapArray.from_arrays(starts, pa.array(names, pa.string()), fields), pa.array(damaged, pa.string())], names=["path", "part", "attrs", "damaged"])

    return _files(spark, path).mapInArrow(run, "path string, part int, attrs map<string,struct<type:string,value:binary>>, damaged string")


def _wanted(f: File, part: int, level: tuple[int, int], box: Sequence[int] | None) -> Iterator[Chunk]:
    for c in f.chunks(part):
        if (c.lx, c.ly) != tuple(level):
            continue
        x0, y0, x1, y1 = f.box_of(c)
        if box is None or (x0 <= box[2] and x1 >= box[0] and y0 <= box[3] and y1 >= box[1]):
            yield c


def read_chunks(spark: SparkSession, path: str | DataFrame, recover: bool = False) -> DataFrame:
    """The catalogue: (path, part, idx, offset, length, x0, y0, x1, y1, lx, ly), from the chunks' heads alone."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for p, raw in zip(part["path"], part["content"], strict=True):
                f = File(raw, recover)
                rows = [(p, c.part, c.index, c.place, len(c.data), *f.box_of(c), c.lx, c.ly) for i in range(len(f.headers)) for c in f.chunks(i)]
                yield pd.DataFrame(rows, columns=["path", "part", "idx", "offset", "length", "x0", "y0", "x1", "y1", "lx", "ly"])

    return _files(spark, path).mapInPandas(run, "path string, part int, idx int, offset bigint, length bigint, x0 int, y0 int, x1 int, y1 int, lx int, ly int")


def read_pixels(spark: SparkSession, path: str | DataFrame, part: int = 0, level: tuple[int, int] = (0, 0), box: Sequence[int] | None = None, channels: Sequence[str] | None = None, recover: bool = False, tasks: int | None = None) -> DataFrame:
    """(path, channel, y, x, v) of a part's level: only chunks that touch the inclusive box are decoded, only wanted channels kept.

    The chunks, still compressed, with their file's head are dealt over tasks before they are decoded.
    """

    def pick(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in parts:
            for p, raw in zip(frame["path"], frame["content"], strict=True):
                f = File(raw, recover)
                head = raw[: f.start - 8 * sum(map(len, f.offsets))]
                held, size = [], 0
                for c in _wanted(f, part, level, box):
                    held.append((p, head, raw[c.place : c.end]))
                    size += len(head) + c.end - c.place
                    if len(held) >= PICKED[0] or size >= PICKED[1]:
                        yield pd.DataFrame(held, columns=["path", "head", "chunk"])
                        held, size = [], 0
                if held:
                    yield pd.DataFrame(held, columns=["path", "head", "chunk"])

    def joined(held: list[tuple]) -> pd.DataFrame:
        n = [len(v) for *_, v in held]
        name = lambda i: np.repeat(np.array([r[i] for r in held], object), n)
        return pd.DataFrame({"path": name(0), "channel": name(1), **{c: np.concatenate([r[i] for r in held]) for i, c in ((2, "y"), (3, "x"), (4, "v"))}})

    def decode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        heads: dict[bytes, _Headed] = {}
        held, total = [], 0
        for frame in parts:
            for p, head, chunk in zip(frame["path"], frame["head"], frame["chunk"], strict=True):
                if len(heads) > 100:
                    heads.clear()
                f = heads.setdefault(head, _Headed(head)) if head not in heads else heads[head]
                f.raw = head + chunk
                c, _ = f.chunk_at(len(head))
                x0, y0, _, _ = f.box_of(c)
                steps = {name: (sx, sy) for name, _, sx, sy in f.headers[c.part].channels()}
                for name, plane in decode_chunk(f, c, channels).items():
                    sx, sy = steps[name]
                    ys, xs = np.meshgrid(-(-y0 // sy) * sy + sy * np.arange(plane.shape[0]), x0 + sx * np.arange(plane.shape[1]), indexing="ij")
                    ys, xs, v = ys.ravel(), xs.ravel(), plane.ravel().astype(np.float64)
                    if box is not None:
                        keep = (xs >= box[0]) & (xs <= box[2]) & (ys >= box[1]) & (ys <= box[3])
                        ys, xs, v = ys[keep], xs[keep], v[keep]
                    held.append((p, name, ys, xs, v))
                    total += len(v)
                    if total >= DECODED:
                        yield joined(held)
                        held, total = [], 0
        if held:
            yield joined(held)

    chunks = _files(spark, path).mapInPandas(pick, "path string, head binary, chunk binary")
    return chunks.repartition(tasks or spark.sparkContext.defaultParallelism).mapInPandas(decode, "path string, channel string, y int, x int, v double")


def read_deep(spark: SparkSession, path: str | DataFrame, part: int = 0, recover: bool = False) -> DataFrame:
    """(path, y, x, sample, channel values as a map) of deep pixels; samples in stored order."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in parts:
            for p, raw in zip(frame["path"], frame["content"], strict=True):
                f = File(raw, recover)
                for c in f.chunks(part):
                    x0, y0, _, _ = f.box_of(c)
                    counts, planes = decode_deep(f, c)
                    for y in range(len(counts)):
                        n = counts[y]
                        x = np.repeat(np.arange(len(n)), n)
                        order = np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n)
                        names = list(planes)
                        values = [dict(zip(names, map(float, row), strict=True)) for row in zip(*[planes[k][y] for k in names], strict=True)]
                        yield pd.DataFrame({"path": p, "y": y0 + y, "x": x0 + x, "sample": order, "values": values})

    return _files(spark, path).mapInPandas(run, "path string, y int, x int, sample int, values map<string,double>")


class _Headed(File):
    """A file's head followed by one chunk."""

    def __init__(self, head: bytes, chunk: bytes = b""):
        self.raw = head + chunk
        (self.flags,) = struct.unpack_from("<I", head, 4)
        self.multi = bool(self.flags & MULTI)
        self.headers, at = [], 8
        while at < len(head):
            h, at = self._header(at)
            if not h.attrs:
                break
            self.headers.append(h)
            if not self.multi:
                break
        self.offsets, self.start = [], len(head)


# Writing


def _attr(name: str, kind: str, value: bytes) -> bytes:
    return name.encode() + b"\0" + kind.encode() + b"\0" + struct.pack("<i", len(value)) + value


def header_bytes(
    box: Sequence[int], channels: Sequence[tuple[str, int]], compression: int, tile: tuple[int, int, int, bool] | None = None, deep: bool = False, extra: Mapping[str, tuple[str, bytes]] | None = None,
    name: str | None = None, order: int = INCREASING, sampling: Mapping[str, tuple[int, int]] | None = None,
) -> bytes:
    """One header; a name makes it a part of several. sampling: (x, y) of the channels that are not at full size."""
    chlist = b"".join(n.encode() + b"\0" + struct.pack("<iIii", k, 0, *(sampling or {}).get(n, (1, 1))) for n, k in sorted(channels)) + b"\0"
    window = struct.pack("<4i", *box)
    out = [
        _attr("channels", "chlist", chlist), _attr("compression", "compression", bytes([compression])), _attr("dataWindow", "box2i", window), _attr("displayWindow", "box2i", window),
        _attr("lineOrder", "lineOrder", bytes([order])), _attr("pixelAspectRatio", "float", struct.pack("<f", 1)), _attr("screenWindowCenter", "v2f", struct.pack("<2f", 0, 0)), _attr("screenWindowWidth", "float", struct.pack("<f", 1)),
    ]
    if tile:
        out.append(_attr("tiles", "tiledesc", struct.pack("<IIB", tile[0], tile[1], tile[2] | int(tile[3]) << 4)))
    if name is not None or deep:
        kind = ("deep" + ("tile" if tile else "scanline")) if deep else ("tiled" if tile else "scanline") + "image"
        out.append(_attr("type", "string", kind.encode()))
    if deep:
        out.append(_attr("version", "int", struct.pack("<i", 1)))
    if name is not None:
        out.append(_attr("name", "string", name.encode()))
    out += [_attr(k, t, v) for k, (t, v) in sorted((extra or {}).items())]
    return b"".join(out) + b"\0"


def _stored(n: int, order: int) -> list[int]:
    """Chunks in the order in which a line order stores them; a random one is fixed by a hash of the index."""
    if order == RANDOM:
        return sorted(range(n), key=lambda i: zlib.crc32(struct.pack("<I", i)))
    return list(range(n))[:: -1 if order == DECREASING else 1]


def _file(headers: Sequence[bytes], chunks: Sequence[Sequence[bytes]], flags: int, orders: Sequence[int] | None = None) -> bytes:
    """Headers, the table of offsets in the order of the index, and the chunks in the order of each part's line order."""
    multi = len(headers) > 1
    head = struct.pack("<II", MAGIC, VERSION | flags | (MULTI if multi else 0)) + b"".join(headers) + (b"\0" if multi else b"")
    at = len(head) + 8 * sum(map(len, chunks))
    table, body = [], []
    for k, part in enumerate(chunks):
        places = [0] * len(part)
        for i in _stored(len(part), orders[k] if orders else INCREASING):
            places[i] = at
            at += len(part[i])
            body.append(part[i])
        table += places
    return head + struct.pack(f"<{len(table)}Q", *table) + b"".join(body)


def scanline_file(planes: dict[str, np.ndarray], kinds: dict[str, int], compression: int = codecs.ZIP, origin: tuple[int, int] = (0, 0), extra: dict | None = None) -> bytes:
    """A file of one part of scanlines."""
    height, width = next(iter(planes.values())).shape
    box = (origin[0], origin[1], origin[0] + width - 1, origin[1] + height - 1)
    names = sorted(planes)
    head = header_bytes(box, [(n, kinds[n]) for n in names], compression, extra=extra)
    step = LINES_PER_CHUNK[compression]
    chunks = []
    for y in range(0, height, step):
        rows = range(y, min(y + step, height))
        plain = b"".join(planes[n][r].astype(DTYPES[kinds[n]]).tobytes() for r in rows for n in names)
        data = codecs.encode(plain, compression, [(kinds[n], width) for _ in rows for n in names], len(rows))
        chunks.append(struct.pack("<ii", origin[1] + y, len(data)) + data)
    return _file([head], [chunks], 0)


def tiled_file(levels: Sequence[dict[str, np.ndarray]], kinds: dict[str, int], tile: tuple[int, int], compression: int = codecs.ZIP, origin: tuple[int, int] = (0, 0), up: bool = False) -> bytes:
    """A file of one part of tiles: one level, or all mip levels."""
    height, width = next(iter(levels[0].values())).shape
    box = (origin[0], origin[1], origin[0] + width - 1, origin[1] + height - 1)
    names, (tw, th) = sorted(levels[0]), tile
    head = header_bytes(box, [(n, kinds[n]) for n in names], compression, (tw, th, MIP if len(levels) > 1 else ONE, up))
    chunks = []
    for k, planes in enumerate(levels):
        h, w = planes[names[0]].shape
        for ty in range(-(-h // th)):
            for tx in range(-(-w // tw)):
                cut = {n: planes[n][ty * th : (ty + 1) * th, tx * tw : (tx + 1) * tw] for n in names}
                rows, cols = cut[names[0]].shape
                plain = b"".join(cut[n][r].astype(DTYPES[kinds[n]]).tobytes() for r in range(rows) for n in names)
                data = codecs.encode(plain, compression, [(kinds[n], cols) for _ in range(rows) for n in names], rows)
                chunks.append(struct.pack("<5i", tx, ty, k, k, len(data)) + data)
    return _file([head], [chunks], TILED)


def deep_file(counts: np.ndarray, samples: dict[str, np.ndarray], kinds: dict[str, int], compression: int = codecs.ZIPS, origin: tuple[int, int] = (0, 0)) -> bytes:
    """A file of one deep part of scanlines. samples: of each channel, all samples by line, pixel and order."""
    if compression not in (codecs.NONE, codecs.RLE, codecs.ZIPS):
        raise ValueError("deep data can't have this compression")
    height, width = counts.shape
    box = (origin[0], origin[1], origin[0] + width - 1, origin[1] + height - 1)
    names = sorted(samples)
    head = header_bytes(box, [(n, kinds[n]) for n in names], compression, deep=True)
    ends = np.concatenate([[0], np.cumsum(counts.sum(1))])
    chunks = []
    for y in range(height):
        table = np.cumsum(counts[y]).astype("<u4").tobytes()
        plain = b"".join(samples[n][ends[y] : ends[y + 1]].astype(DTYPES[kinds[n]]).tobytes() for n in names)
        a, b = codecs.encode(table, compression, [], 1), codecs.encode(plain, compression, [], 1)
        chunks.append(struct.pack("<i3Q", origin[1] + y, len(a), len(b), len(plain)) + a + b)
    return _file([head], [chunks], DEEP)


def write_images(pixels: DataFrame, folder: str, kinds: dict[str, int], compression: int = codecs.ZIP, key: str = "image") -> DataFrame:
    """Each image of (image, channel, y, x, v) as a scanline file of a folder that all executors share; returns (image, path, bytes).

    An image is gathered in one task, which bounds what this sink is for: images, not tables.
    """

    def run(k, frame: pd.DataFrame) -> pd.DataFrame:
        import os

        x0, y0 = int(frame["x"].min()), int(frame["y"].min())
        shape = (int(frame["y"].max()) - y0 + 1, int(frame["x"].max()) - x0 + 1)
        planes = {}
        for name, g in frame.groupby("channel"):
            planes[name] = np.zeros(shape)
            planes[name][g["y"].to_numpy() - y0, g["x"].to_numpy() - x0] = g["v"]
        data = scanline_file(planes, {n: kinds.get(n, 1) for n in planes}, compression, (x0, y0))
        path = os.path.join(folder, f"{k[0]}.img")
        with open(path + ".part", "wb") as out:
            out.write(data)
        os.replace(path + ".part", path)
        return pd.DataFrame([(str(k[0]), path, len(data))], columns=["image", "path", "bytes"])

    return pixels.groupBy(key).applyInPandas(run, "image string, path string, bytes bigint")


def write_pyramid(pyramid: DataFrame, path: str) -> None:
    """Levels as folders: a read of one level prunes the others."""
    pyramid.write.partitionBy("level").parquet(path)


def write_parts(parts: DataFrame, path: str) -> None:
    """Parts as folders; names have to be unique within an image."""
    if parts.groupBy("image", "part_name").agg(F.countDistinct("part").alias("n")).where("n > 1").head(1):
        raise ValueError("part names are not unique")
    parts.write.partitionBy("part_name").parquet(path)
