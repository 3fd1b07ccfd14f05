"""Header metadata: attributes, channel names, rates, timecodes, rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Frame rates (numerator, denominator) in the order in which they are tried, and their names.
RATES = ((24, 1), (24000, 1001), (25, 1), (30000, 1001), (30, 1), (48, 1), (50, 1), (60000, 1001), (60, 1), (120, 1))
RATE_NAMES = (
    "24 fps (Cinema)", "23.976 fps (NTSC Film)", "25 fps (PAL)", "29.97 fps (NTSC)", "30 fps", "48 fps (HFR Cinema)", "50 fps (PAL HFR)", "59.94 fps (NTSC HFR)", "60 fps", "120 fps",
)
DROP = ((24000, 1001), (30000, 1001), (60000, 1001))
#: Attributes that a copy of metadata leaves out: they describe the file's structure.
STRUCTURAL = ("channels", "compression", "dataWindow", "displayWindow", "lineOrder", "pixelAspectRatio", "screenWindowCenter", "screenWindowWidth", "tiles", "type", "name", "version", "chunkCount")
REQUIRED = STRUCTURAL[:8]
SAMPLE_BYTES = {"uint": 4, "half": 2, "float": 4}


def layer_of(channel: Column) -> Column:
    """What stands before the last dot; '' without one."""
    return F.when(F.instr(channel, ".") > 0, F.regexp_extract(channel, r"^(.*)\.[^.]*$", 1)).otherwise("")


def base_of(channel: Column) -> Column:
    return F.substring_index(channel, ".", -1)


def bytes_per_pixel(types: Column) -> Column:
    """Of an array of sample types."""
    size = F.create_map(*[F.lit(x) for kv in SAMPLE_BYTES.items() for x in kv])
    return F.aggregate(types, F.lit(0), lambda n, t: n + F.element_at(size, t))


def has_all(names: Column, wanted: Sequence[str]) -> Column:
    return F.size(F.array_intersect(names, F.array(*map(F.lit, wanted)))) == len(wanted)


def rational(num: Column, den: Column) -> Column:
    """As a number; 0 where the denominator is."""
    return F.when(den == 0, 0.0).otherwise(num.cast("double") / F.when(den == 0, 1).otherwise(den))


def to_rational(v: Column, most: int = 1001) -> Column:
    """struct(num, den): a known rate within 1e-4, else the last convergent of the continued fraction whose denominator is at most `most`; 0/1 for v <= 0."""
    state = lambda x, n0, n1, d0, d1, go: F.struct(x.alias("x"), n0.alias("n0"), n1.alias("n1"), d0.alias("d0"), d1.alias("d1"), go.alias("go"))
    big = lambda k: F.lit(k).cast("bigint")

    def step(s: Column, _: Column) -> Column:
        a = F.floor(s["x"]).cast("bigint")
        n, d = a * s["n1"] + s["n0"], a * s["d1"] + s["d0"]
        rest = s["x"] - a
        ok = s["go"] & (d <= most)
        nxt = F.when(rest < 1e-10, 0.0).otherwise(F.lit(1.0) / F.when(rest < 1e-10, 1.0).otherwise(rest))
        return F.when(ok, state(nxt, s["n1"], n, s["d1"], d, rest >= 1e-10)).otherwise(state(s["x"], s["n0"], s["n1"], s["d0"], s["d1"], F.lit(False)))

    start = state(F.least(v, F.lit(2147483647.0)).cast("double"), big(0), big(1), big(1), big(0), F.lit(True))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(20)), start, step, lambda s: F.struct(s["n1"].alias("num"), s["d1"].alias("den")))
    for n, d in reversed(RATES):
        found = F.when(F.abs(v - n / d) < 0.0001, F.struct(big(n).alias("num"), big(d).alias("den"))).otherwise(found)
    return F.when(v <= 0, F.struct(big(0).alias("num"), big(1).alias("den"))).otherwise(found)


def is_drop_frame(num: Column, den: Column) -> Column:
    out = F.lit(False)
    for n, d in DROP:
        out = out | ((num == n) & (den == d))
    return out


def rate_name(num: Column, den: Column) -> Column:
    out = F.lit("")
    for (n, d), name in zip(RATES, RATE_NAMES, strict=True):
        out = F.when((num == n) & (den == d), name).otherwise(out)
    return out


def _bcd(n: Column, at: int) -> Column:
    return F.shiftleft((n % 10 + F.shiftleft(F.floor(n / 10).cast("bigint"), 4)).cast("bigint"), at)


def timecode(hours: Column, minutes: Column, seconds: Column, frames: Column, drop: Column) -> Column:
    """Packed BCD fields: frames from bit 0, drop at bit 6, seconds 8, minutes 16, hours 24; null out of range."""
    ok = hours.between(0, 23) & minutes.between(0, 59) & seconds.between(0, 59) & frames.between(0, 29)
    packed = _bcd(frames, 0) + F.when(drop, 64).otherwise(0) + _bcd(seconds, 8) + _bcd(minutes, 16) + _bcd(hours, 24)
    return F.when(ok, packed).cast("bigint")


def timecode_field(time: Column, low: int, high: int) -> Column:
    """The number in BCD bits low to high."""
    bits = F.shiftright(time, low).bitwiseAND(F.lit((1 << (high - low + 1)) - 1))
    return (bits.bitwiseAND(F.lit(15)) + F.shiftright(bits, 4) * 10).cast("int")


#: (lowest, highest) bit of the fields.
FIELDS = {"frames": (0, 5), "seconds": (8, 14), "minutes": (16, 22), "hours": (24, 29)}


def repacked(time: Column, packing: str) -> Column:
    """A 60-field timecode in another packing: 50-field moves the flags, film drops two of them."""
    bit = lambda k: F.shiftright(time, k).bitwiseAND(F.lit(1))
    if packing == "film24":
        return time.bitwiseAND(F.lit(0xFFFFFFFF & ~(1 << 6) & ~(1 << 7)))
    if packing == "tv50":
        kept = time.bitwiseAND(F.lit(0xFFFFFFFF & ~(1 << 6 | 1 << 15 | 1 << 23 | 1 << 30 | 1 << 31)))
        return kept + F.shiftleft(bit(23), 15) + F.shiftleft(bit(31), 23) + F.shiftleft(bit(30), 30) + F.shiftleft(bit(15), 31)
    return time


def copied(attrs: Column) -> Column:
    """A map of attributes without the structural ones."""
    return F.map_filter(attrs, lambda k, v: ~k.isin(*STRUCTURAL))


def rule_violations(rows: DataFrame, key: str, rules: Sequence[tuple[str, str, Column]]) -> DataFrame:
    """(key, severity, rule) of each rule that holds for a row: (severity, rule, condition). One pass over rows."""
    found = F.array_compact(F.array(*[F.when(c, F.struct(F.lit(s).alias("severity"), F.lit(r).alias("rule"))) for s, r, c in rules]))
    return rows.select(key, F.explode(found).alias("f")).select(key, "f.*")
