"""binary16: rounding, bits, classes and comparison, as column expressions.

Values are doubles that a binary16 can hold; bits are integers of 0 to 65535.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The largest finite value, and the first that rounds to infinity.
MAX, OVERFLOW = 65504.0, 65520.0


def _exponent(v: Column) -> Column:
    """floor(log2 |v|), -14 at least, corrected where the logarithm is off by one."""
    a = F.abs(v)
    e = F.greatest(F.floor(F.log2(F.when(a == 0, 1.0).otherwise(a))).cast("int"), F.lit(-14))
    m = a / F.pow(F.lit(2.0), e.cast("double"))
    return F.greatest(F.when(m >= 2, e + 1).when((m < 1) & (e > -14), e - 1).otherwise(e), F.lit(-14))


def to_half(v: Column) -> Column:
    """Round to the nearest binary16, ties to even; infinity from 65520; NaN stays, zeros keep their sign."""
    unit = F.pow(F.lit(2.0), (10 - _exponent(v)).cast("double"))
    rounded = F.rint(v * unit) / unit
    return F.when(F.isnan(v) | (v == 0), v).when(F.abs(v) >= OVERFLOW, F.signum(v) * F.lit(float("inf"))).otherwise(rounded)


def to_bits(v: Column) -> Column:
    """Bits of the binary16 nearest to v; NaN is 0x7E00. The rounded value and its exponent are bound once by lambdas, else the expression would grow too large to compile."""

    def of(p: Column) -> Column:
        a = F.abs(p["h"])
        normal = a >= 2.0**-14
        mantissa = F.when(normal, (a / F.pow(F.lit(2.0), p["e"].cast("double")) - 1) * 1024).otherwise(a * 2.0**24)
        finite = F.when(normal, (p["e"] + 15) * 1024).otherwise(0) + F.when(a <= MAX, mantissa).otherwise(0.0).cast("int")
        sign = F.when((p["v"] < 0) | (p["v"].cast("string") == "-0.0"), 0x8000).otherwise(0)
        return F.when(F.isnan(p["v"]), 0x7E00).when(a > MAX, sign + 0x7C00).otherwise(sign + finite).cast("int")

    with_exponent = lambda p: F.struct(p["v"].alias("v"), p["h"].alias("h"), F.when(F.abs(p["h"]) <= MAX, _exponent(p["h"])).otherwise(0).alias("e"))
    rounded = F.array(F.struct(v.alias("v"), to_half(v).alias("h")))
    return F.transform(F.transform(rounded, with_exponent), of)[0]


def from_bits(bits: Column) -> Column:
    """The exact value of a binary16's bits."""
    sign = F.when(bits.bitwiseAND(F.lit(0x8000)) != 0, -1.0).otherwise(1.0)
    e = F.shiftright(bits, 10).bitwiseAND(F.lit(31))
    m = bits.bitwiseAND(F.lit(1023)).cast("double")
    finite = F.when(e == 0, m * 2.0**-24).otherwise((1 + m / 1024) * F.pow(F.lit(2.0), (e - 15).cast("double")))
    return F.when((e == 31) & (m > 0), F.lit(float("nan"))).when(e == 31, sign * F.lit(float("inf"))).otherwise(sign * finite)


def classify(bits: Column) -> Column:
    """nan, infinite, zero, subnormal or normal."""
    e, m = F.shiftright(bits, 10).bitwiseAND(F.lit(31)), bits.bitwiseAND(F.lit(1023))
    return F.when((e == 31) & (m != 0), "nan").when(e == 31, "infinite").when((e == 0) & (m == 0), "zero").when(e == 0, "subnormal").otherwise("normal")


def is_negative(bits: Column) -> Column:
    return bits.bitwiseAND(F.lit(0x8000)) != 0


def negate(bits: Column) -> Column:
    return bits.bitwiseXOR(F.lit(0x8000))


def absolute(bits: Column) -> Column:
    return bits.bitwiseAND(F.lit(0x7FFF))


def less(a: Column, b: Column) -> Column:
    """IEEE comparison: false if either is NaN; zeros are equal."""
    return ~F.isnan(a) & ~F.isnan(b) & (a < b)


def equal(a: Column, b: Column) -> Column:
    return ~F.isnan(a) & ~F.isnan(b) & (a == b)


def clamp(values: Column) -> Column:
    """Each of an array: NaN to 0, else within the finite range."""
    return F.transform(values, lambda v: F.when(F.isnan(v), 0.0).otherwise(F.least(F.greatest(v, F.lit(-MAX)), F.lit(MAX))))


def scale(values: Column, factor: Column) -> Column:
    return F.transform(values, lambda v: to_half(v * factor))


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda p, q: to_half(p + q))


def lerp(a: Column, b: Column, t: Column) -> Column:
    return F.zip_with(a, b, lambda p, q: to_half(p + (q - p) * t))
