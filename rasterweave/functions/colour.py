"""Colour: luminance and chroma, colour spaces, tone and gamma, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Luminance weights of red, green and blue; red, green, blue and white (x, y) of Rec. 709 and of the academy's space; the Bradford cone matrix and its inverse, applied to column vectors.
LUMINANCE = (0.2126, 0.7152, 0.0722)
REC709 = (0.64, 0.33, 0.30, 0.60, 0.15, 0.06, 0.3127, 0.3290)
ACES = (0.7347, 0.2653, 0.0, 1.0, 0.0001, -0.077, 0.32168, 0.33767)
BRADFORD = ((0.8951, 0.2664, -0.1614), (-0.7502, 1.7135, 0.0367), (0.0389, -0.0685, 1.0296))
BRADFORD_INVERSE = ((0.986993, -0.147054, 0.159963), (0.432305, 0.518360, 0.049291), (-0.008529, 0.040043, 0.968487))
#: How close primaries have to be to count as the same.
SAME = 1e-5


def to_yc(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """(Y, RY, BY); all zero where Y is."""
    y = r * LUMINANCE[0] + g * LUMINANCE[1] + b * LUMINANCE[2]
    part = lambda c: F.when(y == 0, 0.0).otherwise((c - y) / F.when(y == 0, 1.0).otherwise(y))
    return y, part(r), part(b)


def from_yc(y: Column, ry: Column, by: Column) -> tuple[Column, Column, Column]:
    r, b = (ry + 1) * y, (by + 1) * y
    return r, (y - r * LUMINANCE[0] - b * LUMINANCE[2]) / LUMINANCE[1], b


def _xyz(x: float, y: float) -> np.ndarray:
    return np.array([x / y, 1.0, (1 - x - y) / y])


def rgb_to_xyz(c: Sequence[float]) -> np.ndarray:
    """The matrix of chromaticities (red, green, blue, white x and y), white having Y = 1; the identity if it is singular."""
    m = np.array([_xyz(c[0], c[1]), _xyz(c[2], c[3]), _xyz(c[4], c[5])]).T
    if abs(np.linalg.det(m)) < 1e-10:
        return np.eye(3)
    return m * np.linalg.solve(m, _xyz(c[6], c[7]))


def xyz_to_rgb(c: Sequence[float]) -> np.ndarray:
    return np.linalg.inv(rgb_to_xyz(c))


def adaptation(source: Sequence[float], target: Sequence[float]) -> np.ndarray:
    """Bradford: cone responses scaled by the ratio of the white points."""
    cone = np.array(BRADFORD)
    ratio = (cone @ _xyz(*target)) / (cone @ _xyz(*source))
    return np.array(BRADFORD_INVERSE) @ np.diag(ratio) @ cone


def to_aces(chromaticities: Sequence[float] = REC709, neutral: Sequence[float] | None = None) -> np.ndarray | None:
    """The matrix into the academy's space; None where the file is in it. neutral replaces the white point."""
    c = [*chromaticities[:6], *(neutral or chromaticities[6:])]
    if max(abs(a - b) for a, b in zip(c, ACES, strict=True)) < SAME:
        return None
    return xyz_to_rgb(ACES) @ adaptation(c[6:], ACES[6:]) @ rgb_to_xyz(c)


def apply(matrix: np.ndarray | None, r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Three linear projections, the nine numbers being literals of the plan; no work without a matrix."""
    if matrix is None:
        return r, g, b
    return tuple(r * float(row[0]) + g * float(row[1]) + b * float(row[2]) for row in matrix)


def tone(v: Column) -> Column:
    return F.when(v <= 0, 0.0).otherwise(v / (F.greatest(v, F.lit(0.0)) + 1))


def srgb(v: Column) -> Column:
    return F.when(v <= 0, 0.0).when(v >= 1, 1.0).when(v <= 0.0031308, v * 12.92).otherwise(F.pow(F.greatest(v, F.lit(0.0)), F.lit(1 / 2.4)) * 1.055 - 0.055)


def linear(v: Column) -> Column:
    return F.when(v <= 0.04045, v / 12.92).otherwise(F.pow((F.greatest(v, F.lit(0.0)) + 0.055) / 1.055, F.lit(2.4)))


def to_byte(v: Column) -> Column:
    return F.when(v <= 0, 0).when(v >= 1, 255).otherwise(F.floor(v * 255 + 0.5)).cast("int")
