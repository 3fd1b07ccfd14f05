"""Payload codecs of container chunks, vectorised with NumPy.

A chunk's plain bytes are its lines in order, and in a line the rows of its channels in order of
name. layout: a list of (lines of samples: type, width) in that order, where a codec needs it.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np

# Codes of compressions, and bytes of sample types (0 unsigned, 1 half, 2 float).
NONE, RLE, ZIPS, ZIP, PIZ, PXR24, B44, B44A, DWAA, DWAB = range(10)
SIZE = {0: 4, 1: 2, 2: 4}
#: Runs of fewer bytes are copied, and the longest run or copy.
SHORTEST, LONGEST = 3, 127

Layout = Sequence[tuple[int, int]]


class Damaged(ValueError):
    """Bytes that no encoder writes."""


def split(data: bytes) -> np.ndarray:
    """Even bytes, then odd bytes; then differences of neighbours, 128 more."""
    raw = np.frombuffer(data, np.uint8)
    s = np.concatenate([raw[::2], raw[1::2]])
    out = s.copy()
    out[1:] = s[1:] - s[:-1] + np.uint8(128)
    return out


def joined(data: np.ndarray) -> bytes:
    """The inverse of split."""
    step = data.copy()
    step[1:] -= np.uint8(128)
    s = np.cumsum(step, dtype=np.uint8)
    out = np.empty(len(s), np.uint8)
    half = (len(s) + 1) // 2
    out[::2], out[1::2] = s[:half], s[half:]
    return out.tobytes()


def run_lengths(data: np.ndarray) -> bytes:
    """Runs as (length - 1, byte), other bytes as (-length, bytes)."""
    out = bytearray()
    n = len(data)
    if not n:
        return b""
    starts = np.flatnonzero(np.concatenate([[True], data[1:] != data[:-1]]))
    sizes = np.diff(np.append(starts, n))
    copied = bytearray()

    def flush() -> None:
        for i in range(0, len(copied), LONGEST):
            part = copied[i : i + LONGEST]
            out.append(256 - len(part))
            out.extend(part)
        copied.clear()

    for at, size in zip(starts.tolist(), sizes.tolist(), strict=True):
        value = int(data[at])
        if size < SHORTEST:
            copied.extend([value] * size)
            continue
        flush()
        while size:
            k = min(size, LONGEST + 1)
            out += bytes((k - 1, value))
            size -= k
    flush()
    return bytes(out)


def from_run_lengths(data: bytes, size: int) -> np.ndarray:
    out = bytearray()
    at = 0
    while at < len(data):
        n = data[at]
        at += 1
        if n > 127:
            n = 256 - n
            if at + n > len(data):
                raise Damaged("a copy ends past the chunk")
            out += data[at : at + n]
            at += n
        else:
            if at >= len(data):
                raise Damaged("a run has no byte")
            out += data[at : at + 1] * (n + 1)
            at += 1
        if len(out) > size:
            raise Damaged("too many bytes")
    if len(out) != size:
        raise Damaged("too few bytes")
    return np.frombuffer(bytes(out), np.uint8)


def _inflate(data: bytes, size: int) -> bytes:
    try:
        engine = zlib.decompressobj()
        out = engine.decompress(data, size + 1)
    except zlib.error as e:
        raise Damaged(str(e)) from e
    if len(out) != size:
        raise Damaged("wrong length")
    return out


def _to_24(v: np.ndarray) -> np.ndarray:
    """float32 bits rounded to 24; infinity stays, NaN keeps a set mantissa, what would round to infinity is cut."""
    bits = v.view(np.uint32)
    sign, e, m = bits & np.uint32(0x80000000), bits & np.uint32(0x7F800000), bits & np.uint32(0x007FFFFF)
    rounded = ((e | m) + (m & np.uint32(0x80))) >> np.uint32(8)
    rounded = np.where(rounded >= 0x7F8000, (e | m) >> np.uint32(8), rounded)
    cut = m >> np.uint32(8)
    special = np.where(m != 0, (e >> np.uint32(8)) | cut | (cut == 0), e >> np.uint32(8))
    return (sign >> np.uint32(8)) | np.where(e == 0x7F800000, special, rounded).astype(np.uint32)


def _planes(values: np.ndarray, size: int) -> np.ndarray:
    """Differences of neighbours, as one plane for each byte, the highest first."""
    d = values.copy()
    d[1:] = values[1:] - values[:-1]
    return np.concatenate([(d >> np.array(8 * (size - 1 - k), d.dtype)).astype(np.uint8) for k in range(size)])


def pxr24(data: bytes, layout: Layout) -> bytes:
    out, at = [], 0
    for kind, width in layout:
        raw = data[at : at + SIZE[kind] * width]
        at += len(raw)
        if kind == 1:
            out.append(_planes(np.frombuffer(raw, "<u2").astype(np.uint16), 2))
        elif kind == 0:
            out.append(_planes(np.frombuffer(raw, "<u4").astype(np.uint32), 4))
        else:
            out.append(_planes(_to_24(np.frombuffer(raw, "<f4").astype(np.float32)), 3))
    return zlib.compress(np.concatenate(out).tobytes() if out else b"")


def from_pxr24(data: bytes, layout: Layout) -> bytes:
    stored = {0: 4, 1: 2, 2: 3}
    raw = np.frombuffer(_inflate(data, sum(stored[k] * w for k, w in layout)), np.uint8)
    out, at = [], 0
    for kind, width in layout:
        n = stored[kind]
        planes = raw[at : at + n * width].reshape(n, width).astype(np.uint32)
        at += n * width
        d = sum((planes[k] << np.uint32(8 * (n - 1 - k)) for k in range(n)), np.zeros(width, np.uint32))
        v = np.cumsum(d, dtype=np.uint32)
        out.append(v.astype("<u2").tobytes() if kind == 1 else ((v << np.uint32(8)) if kind == 2 else v).astype("<u4").tobytes())
    return b"".join(out)


# 4 x 4 blocks of halves. A block is its first value and fifteen steps of 6 bits, which run down
# the first column and then along the rows, at a common shift.
_FROM = np.array([0, 0, 4, 8, 0, 4, 8, 12, 1, 5, 9, 13, 2, 6, 10, 14])
_TO = np.array([0, 4, 8, 12, 1, 5, 9, 13, 2, 6, 10, 14, 3, 7, 11, 15])


def _ordered(bits: np.ndarray) -> np.ndarray:
    """Halves as numbers that sort as they do; NaN and infinity as zero."""
    b = bits.astype(np.int64)
    b = np.where((b & 0x7C00) == 0x7C00, 0x8000, np.where(b & 0x8000, ~b & 0xFFFF, b | 0x8000))
    return b


def _plain(t: np.ndarray) -> np.ndarray:
    t = t & 0xFFFF
    return np.where(t & 0x8000, t & 0x7FFF, ~t & 0xFFFF).astype(np.uint16)


def pack_blocks(blocks: np.ndarray, flat: bool) -> list[bytes]:
    """blocks (n, 16) of half bits, row by row; flat: blocks of one value take three bytes."""
    t = _ordered(blocks)
    top = t.max(1, keepdims=True)
    n = len(t)
    steps = np.zeros((n, 15), np.int64)
    first = np.zeros(n, np.int64)
    shift = np.full(n, -1)
    for s in range(16):  # the least shift at which all steps fit
        todo = shift < 0
        if not todo.any():
            break
        twice = 2 * (top - t)
        d = (twice + (1 << s) - 1 + (twice >> (s + 1) & 1)) >> (s + 1)  # to the nearest, ties to even
        r = d[:, _FROM[1:]] - d[:, _TO[1:]] + 0x20
        fit = todo & (r.min(1) >= 0) & (r.max(1) <= 0x3F)
        steps[fit], first[fit], shift[fit] = r[fit], (top[:, 0] - (d[:, 0] << s))[fit], s
    out = []
    for k in range(n):
        v = int(first[k]) & 0xFFFF
        if flat and shift[k] == 0 and (steps[k] == 0x20).all():
            out.append(bytes((v >> 8, v & 255, 0xFC)))
            continue
        bits = (v << 6 | int(shift[k])) << 90
        for i, r in enumerate(steps[k].tolist()):
            bits |= r << (84 - 6 * i)
        out.append(bits.to_bytes(14, "big"))
    return out


def unpack_block(b: bytes) -> np.ndarray:
    """Sixteen half bits of a block of 14 or 3 bytes."""
    t = np.zeros(16, np.int64)
    t[0] = b[0] << 8 | b[1]
    if len(b) == 3:
        return np.repeat(_plain(t[:1]), 16)
    bits = int.from_bytes(b, "big")
    shift = bits >> 90 & 0x3F
    for i in range(15):
        t[_TO[i + 1]] = t[_FROM[i + 1]] + ((bits >> (84 - 6 * i) & 0x3F) - 0x20 << shift)
    return _plain(t)


def _channels(layout: Layout, lines: int) -> int:
    if lines <= 0 or len(layout) % lines:
        raise ValueError("the layout is not the same for each line")
    return len(layout) // lines


def b44(data: bytes, layout: Layout, lines: int, flat: bool) -> bytes:
    n = _channels(layout, lines)
    starts = np.concatenate([[0], np.cumsum([SIZE[k] * w for k, w in layout])])
    out = []
    for c in range(n):
        kind, width = layout[c]
        rows = [data[starts[y * n + c] : starts[y * n + c + 1]] for y in range(lines)]
        if kind != 1:
            out += rows
            continue
        plane = np.stack([np.frombuffer(r, "<u2") for r in rows])
        plane = np.pad(plane, ((0, -lines % 4), (0, -width % 4)), mode="edge")
        blocks = plane.reshape(plane.shape[0] // 4, 4, -1, 4).swapaxes(1, 2).reshape(-1, 16)
        out += pack_blocks(blocks, flat)
    return b"".join(out)


def from_b44(data: bytes, layout: Layout, lines: int) -> bytes:
    n = _channels(layout, lines)
    at, planes = 0, []
    for c in range(n):
        kind, width = layout[c]
        if kind != 1:
            size = SIZE[kind] * width
            planes.append([data[at + y * size : at + (y + 1) * size] for y in range(lines)])
            at += size * lines
            continue
        down, across = -(-lines // 4), -(-width // 4)
        plane = np.zeros((down * 4, across * 4), np.uint16)
        for k in range(down * across):
            if at + 3 > len(data):
                raise Damaged("a block is missing")
            size = 3 if data[at + 2] >= 13 << 2 else 14
            if at + size > len(data):
                raise Damaged("a block is cut")
            y, x = divmod(k, across)
            plane[4 * y : 4 * y + 4, 4 * x : 4 * x + 4] = unpack_block(data[at : at + size]).reshape(4, 4)
            at += size
        planes.append([plane[y, :width].astype("<u2").tobytes() for y in range(lines)])
    if at != len(data):
        raise Damaged("bytes are left")
    return b"".join(planes[c][y] for y in range(lines) for c in range(n))


def encode(data: bytes, compression: int, layout: Layout, lines: int) -> bytes:
    """The payload of plain bytes; plain where that is not longer."""
    if compression == NONE or not data:
        return data
    if compression == RLE:
        out = run_lengths(split(data))
    elif compression in (ZIPS, ZIP):
        out = zlib.compress(split(data).tobytes())
    elif compression == PXR24:
        out = pxr24(data, layout)
    elif compression in (B44, B44A):
        out = b44(data, layout, lines, compression == B44A)
    elif compression == PIZ:
        from rasterweave.sources import wavelet

        out = wavelet.encode(data, layout, lines)
    else:
        raise NotImplementedError(f"compression {compression} can't be written")
    return out if len(out) < len(data) else data


def decode(data: bytes, size: int, compression: int, layout: Layout, lines: int) -> bytes:
    """The plain bytes, size of them, of a payload."""
    if compression == NONE or len(data) >= size:
        if len(data) != size:
            raise Damaged("wrong length")
        return data
    if compression == RLE:
        return joined(from_run_lengths(data, size))
    if compression in (ZIPS, ZIP):
        return joined(np.frombuffer(_inflate(data, size), np.uint8))
    if compression == PXR24:
        return from_pxr24(data, layout)
    if compression in (B44, B44A):
        return from_b44(data, layout, lines)
    if compression == PIZ:
        from rasterweave.sources import wavelet

        return wavelet.decode(data, layout, lines)
    raise NotImplementedError(f"compression {compression} can't be read")
