"""The wavelet codec: used values renumbered, a two-dimensional Haar transform, Huffman codes.

Payload: first and last byte of the bitmap of used values, those bytes, the length of the
codes, the codes. The planes of channels follow one another, a sample of four bytes being two
interleaved planes of 16 bits.
"""

from __future__ import annotations

import heapq
import struct
from collections.abc import Sequence

import numpy as np

from rasterweave.sources.codecs import SIZE, Damaged, Layout

# In the table of code lengths (6 bits each), lengths from SHORT_ZEROS stand for runs of zeros of 2 and more, LONG_ZEROS for one of 6 and more whose size has 8 bits; the largest code length; values below which the signed transform fits.
SHORT_ZEROS, LONG_ZEROS, LONG_FROM, LONG_TO, MOST_BITS, SIGNED_BELOW = 59, 63, 6, 261, 58, 1 << 14


def _pair(a: np.ndarray, b: np.ndarray, signed: bool) -> tuple[np.ndarray, np.ndarray]:
    """Mean and difference of 16-bit numbers, so that they can be undone exactly."""
    a, b = a.astype(np.int32), b.astype(np.int32)
    if signed:
        a, b = a.astype(np.int16).astype(np.int32), b.astype(np.int16).astype(np.int32)
        return ((a + b) >> 1 & 0xFFFF).astype(np.uint16), (a - b & 0xFFFF).astype(np.uint16)
    moved = a + 0x8000 & 0xFFFF
    d = moved - b
    return (((moved + b) >> 1) + np.where(d < 0, 0x8000, 0) & 0xFFFF).astype(np.uint16), (d & 0xFFFF).astype(np.uint16)


def _unpair(m: np.ndarray, d: np.ndarray, signed: bool) -> tuple[np.ndarray, np.ndarray]:
    if signed:
        m, d = m.astype(np.int16).astype(np.int32), d.astype(np.int16).astype(np.int32)
        a = m + (d & 1) + (d >> 1)
        return (a & 0xFFFF).astype(np.uint16), (a - d & 0xFFFF).astype(np.uint16)
    m, d = m.astype(np.int32), d.astype(np.int32)
    b = m - (d >> 1) & 0xFFFF
    return (d + b - 0x8000 & 0xFFFF).astype(np.uint16), b.astype(np.uint16)


def _steps(shape: tuple[int, int]) -> list[int]:
    out, p = [], 1
    while 2 * p <= min(shape):
        out.append(p)
        p *= 2
    return out


def _cells(shape: tuple[int, int], p: int) -> tuple[slice, slice, slice, slice, bool, bool]:
    """Of a step p: the first and second rows and columns of its blocks, and whether a row or column is left over."""
    rows, cols = shape[0] // (2 * p), shape[1] // (2 * p)
    return slice(0, rows * 2 * p, 2 * p), slice(p, rows * 2 * p, 2 * p), slice(0, cols * 2 * p, 2 * p), slice(p, cols * 2 * p, 2 * p), bool(shape[0] & p), bool(shape[1] & p)


def forward(plane: np.ndarray, signed: bool) -> np.ndarray:
    v = plane.copy()
    for p in _steps(v.shape):
        r0, r1, c0, c1, odd_row, odd_col = _cells(v.shape, p)
        top, top_d = _pair(v[r0, c0], v[r0, c1], signed)
        low, low_d = _pair(v[r1, c0], v[r1, c1], signed)
        v[r0, c0], v[r1, c0] = _pair(top, low, signed)
        v[r0, c1], v[r1, c1] = _pair(top_d, low_d, signed)
        at = c0.stop
        if odd_col:
            v[r0, at], v[r1, at] = _pair(v[r0, at], v[r1, at], signed)
        at = r0.stop
        if odd_row:
            v[at, c0], v[at, c1] = _pair(v[at, c0], v[at, c1], signed)
    return v


def inverse(plane: np.ndarray, signed: bool) -> np.ndarray:
    v = plane.copy()
    for p in reversed(_steps(v.shape)):
        r0, r1, c0, c1, odd_row, odd_col = _cells(v.shape, p)
        top, low = _unpair(v[r0, c0], v[r1, c0], signed)
        top_d, low_d = _unpair(v[r0, c1], v[r1, c1], signed)
        v[r0, c0], v[r0, c1] = _unpair(top, top_d, signed)
        v[r1, c0], v[r1, c1] = _unpair(low, low_d, signed)
        at = c0.stop
        if odd_col:
            v[r0, at], v[r1, at] = _unpair(v[r0, at], v[r1, at], signed)
        at = r0.stop
        if odd_row:
            v[at, c0], v[at, c1] = _unpair(v[at, c0], v[at, c1], signed)
    return v


def code_lengths(counts: dict[int, int]) -> dict[int, int]:
    """Huffman code lengths of symbols by how often they come."""
    if len(counts) == 1:
        return dict.fromkeys(counts, 1)
    heap = [(n, s, (s,)) for s, n in counts.items()]
    heapq.heapify(heap)
    out = dict.fromkeys(counts, 0)
    while len(heap) > 1:
        n, s, a = heapq.heappop(heap)
        m, t, b = heapq.heappop(heap)
        for x in a + b:
            out[x] += 1
        heapq.heappush(heap, (n + m, min(s, t), a + b))
    return out


def canonical(lengths: dict[int, int]) -> dict[int, int]:
    """Codes in order of symbol within a length; longer codes start lower."""
    per = [0] * (MOST_BITS + 1)
    for n in lengths.values():
        per[n] += 1
    start, code = [0] * (MOST_BITS + 1), 0
    for n in range(MOST_BITS, 0, -1):
        start[n], code = code, (code + per[n]) >> 1
    out = {}
    for s in sorted(lengths):
        out[s] = start[lengths[s]]
        start[lengths[s]] += 1
    return out


class _Bits:
    def __init__(self):
        self.parts: list[str] = []
        self.size = 0

    def add(self, n: int, value: int) -> None:
        self.parts.append(format(value, f"0{n}b"))
        self.size += n

    def bytes(self) -> bytes:
        text = "".join(self.parts)
        text += "0" * (-len(text) % 8)
        return int(text, 2).to_bytes(len(text) // 8, "big") if text else b""


def huffman(values: np.ndarray) -> bytes:
    """Table of lengths and codes of 16-bit values; runs are a symbol of their own."""
    if not len(values):
        return b""
    symbols, counts = np.unique(values, return_counts=True)
    first, run = int(symbols[0]), int(symbols[-1]) + 1
    lengths = code_lengths({**dict(zip(symbols.tolist(), counts.tolist(), strict=True)), run: 1})
    codes = canonical(lengths)
    table, s = _Bits(), first
    while s <= run:
        n = lengths.get(s, 0)
        if n:
            table.add(6, n)
            s += 1
            continue
        zeros = 1
        while s + zeros <= run and zeros < LONG_TO and s + zeros not in lengths:
            zeros += 1
        if zeros >= LONG_FROM:
            table.add(6, LONG_ZEROS)
            table.add(8, zeros - LONG_FROM)
        elif zeros >= 2:
            table.add(6, SHORT_ZEROS + zeros - 2)
        else:
            table.add(6, 0)
        s += zeros
    out = _Bits()
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    for at, size in zip(starts.tolist(), np.diff(np.append(starts, len(values))).tolist(), strict=True):
        s = int(values[at])
        while size:
            more = min(size, 256) - 1
            if lengths[s] + lengths[run] + 8 < lengths[s] * more:
                out.add(lengths[s], codes[s])
                out.add(lengths[run], codes[run])
                out.add(8, more)
            else:
                for _ in range(more + 1):
                    out.add(lengths[s], codes[s])
            size -= more + 1
    packed = table.bytes()
    return struct.pack("<5I", first, run, len(packed), out.size, 0) + packed + out.bytes()


def from_huffman(data: bytes, size: int) -> np.ndarray:
    if size == 0:
        return np.zeros(0, np.uint16)
    if len(data) < 20:
        raise Damaged("codes are cut")
    first, run, _, bits, _ = struct.unpack_from("<5I", data)
    if first > 65536 or run > 65536 or first > run:
        raise Damaged("symbols out of range")
    text = format(int.from_bytes(b"\1" + data[20:], "big"), "b")[1:]
    at, s, lengths = 0, first, {}

    def take(n: int) -> int:
        nonlocal at
        if at + n > len(text):
            raise Damaged("codes are cut")
        at += n
        return int(text[at - n : at], 2)

    while s <= run:
        n = take(6)
        if n == LONG_ZEROS:
            s += take(8) + LONG_FROM
        elif n >= SHORT_ZEROS:
            s += n - SHORT_ZEROS + 2
        else:
            if n:
                lengths[s] = n
            s += 1
    at = (at + 7) // 8 * 8
    end = at + bits
    if end > len(text):
        raise Damaged("codes are cut")
    words = {format(c, f"0{lengths[s]}b"): s for s, c in canonical(lengths).items()}
    sizes = sorted(set(lengths.values()))
    out: list[int] = []
    while at < end and len(out) < size:
        for n in sizes:
            found = words.get(text[at : at + n])
            if found is not None:
                break
        else:
            raise Damaged("no such code")
        at += n
        if found == run:
            if not out:
                raise Damaged("a run of nothing")
            out += [out[-1]] * take(8)
        else:
            out.append(found)
    if len(out) != size:
        raise Damaged("wrong number of values")
    return np.array(out, np.uint16)


def _planes(layout: Layout, lines: int) -> list[tuple[int, int]]:
    """(words of a sample, width) of each channel."""
    n = len(layout) // lines
    return [(SIZE[k] // 2, w) for k, w in layout[:n]]


def encode(data: bytes, layout: Layout, lines: int) -> bytes:
    channels = _planes(layout, lines)
    rows = np.frombuffer(data, "<u2").reshape(lines, -1)
    ends = np.cumsum([0] + [k * w for k, w in channels])
    planes = [rows[:, a:b] for a, b in zip(ends, ends[1:], strict=False)]
    used = np.zeros(65536, bool)
    used[rows.ravel()] = True
    used[0] = False
    bitmap = np.packbits(used, bitorder="little")
    at = np.flatnonzero(bitmap)
    low, high = (int(at[0]), int(at[-1])) if len(at) else (8191, 0)
    used[0] = True
    number = (np.cumsum(used) - 1).astype(np.uint16)
    signed = int(number[-1]) < SIGNED_BELOW
    out = []
    for (k, w), plane in zip(channels, planes, strict=True):
        v = number[plane].reshape(lines, w, k)
        for j in range(k):
            v[:, :, j] = forward(v[:, :, j], signed)
        out.append(v.ravel())
    codes = huffman(np.concatenate(out))
    return struct.pack("<HH", low, high) + (bitmap[low : high + 1].tobytes() if low <= high else b"") + struct.pack("<i", len(codes)) + codes


def decode(data: bytes, layout: Layout, lines: int) -> bytes:
    channels = _planes(layout, lines)
    try:
        low, high = struct.unpack_from("<HH", data)
        if high >= 8192:
            raise Damaged("bitmap out of range")
        bitmap = np.zeros(8192, np.uint8)
        at = 4
        if low <= high:
            own = np.frombuffer(data, np.uint8, high - low + 1, at)
            bitmap[low : high + 1] = own
            at += len(own)
        (n,) = struct.unpack_from("<i", data, at)
    except (struct.error, ValueError) as e:
        raise Damaged("a head is cut") from e
    used = np.unpackbits(bitmap, bitorder="little").astype(bool)
    used[0] = True
    values = np.zeros(65536, np.uint16)
    known = np.flatnonzero(used)
    values[: len(known)] = known
    signed = len(known) - 1 < SIGNED_BELOW
    flat = from_huffman(data[at + 4 : at + 4 + n], sum(k * w for k, w in channels) * lines)
    planes, at = [], 0
    for k, w in channels:
        v = flat[at : at + lines * w * k].reshape(lines, w, k).copy()
        at += lines * w * k
        for j in range(k):
            v[:, :, j] = inverse(v[:, :, j], signed)
        planes.append(values[v].reshape(lines, w * k))
    return np.concatenate(planes, 1).astype("<u2").tobytes()


def planes_of(kinds: Sequence[int]) -> int:
    """Planes of 16 bits that samples of these types have."""
    return sum(SIZE[k] // 2 for k in kinds)
