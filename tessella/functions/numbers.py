"""Numbers."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessella.functions.base import DOUBLE, col, rowwise


def trunc(x: Column, n: int = 0) -> Column:
    """Towards zero, to n decimals."""
    s = F.lit(10.0**n)
    return F.when(x >= 0, F.floor(x * s)).otherwise(F.ceil(x * s)) / s


def trunc_decimal(x: Column, n: int = 0) -> Column:
    """Of a decimal, exactly."""
    whole = F.regexp_extract(x.cast("string"), rf"^(-?\d*\.?\d{{0,{n}}})" if n > 0 else r"^(-?\d+)", 1)
    return whole.cast(f"decimal(38,{max(n, 0)})")


def round_half_even(x: Column) -> Column:
    """Doubles round to the nearest whole number, ties to the even one."""
    return F.rint(x)


def round_half_away(x: Column, n: int = 0) -> Column:
    """Decimals round ties away from zero."""
    return F.round(x, n)


def gcd(a, b) -> Column:
    """Euclid's steps; 64-bit numbers need 93 at most."""
    pair = F.struct(F.abs(col(a).cast("long")).alias("a"), F.abs(col(b).cast("long")).alias("b"))
    steps = F.sequence(F.lit(1), F.lit(93))
    return F.aggregate(steps, pair, lambda p, _: F.when(p["b"] == 0, p).otherwise(F.struct(p["b"].alias("a"), F.try_mod(p["a"], p["b"]).alias("b"))))["a"]


def lcm(a, b) -> Column:
    a, b = col(a).cast("long"), col(b).cast("long")
    g = gcd(a, b)
    return F.when((a == 0) | (b == 0), F.lit(0).cast("long")).otherwise(F.abs(F.call_function("div", a, g) * b))


def log(x, base=10.0) -> Column:
    """log(x) is to base 10; log(x, base)."""
    return F.log10(col(x)) if base == 10.0 else F.ln(col(x)) / F.ln(col(base))


def _exact(x: Column, table: dict[int, float], period: int, other: Column) -> Column:
    r = F.pmod(x, F.lit(float(period)))
    for k, v in table.items():
        other = F.when(r == float(k), F.lit(v)).otherwise(other)
    return other


def sind(x: Column) -> Column:
    """Of degrees, exact at multiples of 30 and 90 where the result is."""
    return _exact(x, {0: 0.0, 30: 0.5, 90: 1.0, 150: 0.5, 180: 0.0, 210: -0.5, 270: -1.0, 330: -0.5}, 360, F.sin(F.radians(x)))


def cosd(x: Column) -> Column:
    return _exact(x, {0: 1.0, 60: 0.5, 90: 0.0, 120: -0.5, 180: -1.0, 240: -0.5, 270: 0.0, 300: 0.5}, 360, F.cos(F.radians(x)))


def tand(x: Column) -> Column:
    return _exact(x, {0: 0.0, 45: 1.0, 135: -1.0}, 180, F.tan(F.radians(x)))


def cotd(x: Column) -> Column:
    return _exact(x, {45: 1.0, 90: 0.0, 135: -1.0}, 180, F.cot(F.radians(x)))


def asind(x: Column) -> Column:
    return F.when(F.abs(x) == 0.5, F.signum(x) * 30.0).otherwise(F.degrees(F.asin(x)))


def acosd(x: Column) -> Column:
    return F.when(x == 0.5, 60.0).when(x == -0.5, 120.0).otherwise(F.degrees(F.acos(x)))


def atand(x: Column) -> Column:
    return F.degrees(F.atan(x))


def atan2d(y: Column, x: Column) -> Column:
    return F.degrees(F.atan2(y, x))


erf = rowwise(math.erf, DOUBLE)
erfc = rowwise(math.erfc, DOUBLE)
gamma = rowwise(lambda x: math.inf if x > 171.7 else math.gamma(x), DOUBLE)
lgamma = rowwise(math.lgamma, DOUBLE)


def scale(x: Column) -> Column:
    """Decimals behind the point."""
    return F.length(F.regexp_extract(x.cast("string"), r"\.(\d+)$", 1))


def min_scale(x: Column) -> Column:
    """Decimals that are needed."""
    return F.length(F.regexp_extract(x.cast("string"), r"\.(\d*[1-9])0*$", 1))


def trim_scale(x: Column) -> Column:
    """As text, without zeros at the end."""
    return F.regexp_replace(F.regexp_replace(x.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", "")


def width_bucket(x: Column, thresholds: list[float]) -> Column:
    """How many of the sorted thresholds are at or below x."""
    n = F.lit(0)
    for t in thresholds:
        n = n + F.when(x >= t, 1).otherwise(0)
    return F.when(x.isNotNull(), n)


def random(seed: int, *key: Column) -> Column:
    """In [0, 1), the same for one seed and key in every run, so that retried tasks agree; with a
    key of the row it doesn't depend on how rows are dealt."""
    return (F.shiftrightunsigned(F.xxhash64(F.lit(seed), *key), 11)).cast("double") / F.lit(float(1 << 53))


def random_normal(seed: int, *key: Column, mean: float = 0.0, stddev: float = 1.0) -> Column:
    """By Box and Muller from two such numbers."""
    u, v = random(seed, F.lit(1), *key), random(seed, F.lit(2), *key)
    return F.sqrt(-2 * F.ln(1 - u)) * F.cos(2 * math.pi * v) * stddev + mean


def random_between(seed: int, low, high, *key: Column) -> Column:
    """Whole numbers from low to high."""
    low, high = col(low), col(high)
    return (low + F.floor(random(seed, *key) * (high - low + 1))).cast("long")


_POWERS = {"bytes": 0, "b": 0, "kb": 1, "mb": 2, "gb": 3, "tb": 4, "pb": 5}


def size_bytes(s: Column) -> Column:
    """Bytes of a text such as ``1.5 GB``."""
    unit = F.lower(F.regexp_extract(s, r"([A-Za-z]*)\s*$", 1))
    factor = F.lit(1)
    for name, p in _POWERS.items():
        factor = F.when(unit == name, F.lit(1024**p)).otherwise(factor)
    return F.round(F.regexp_extract(s, r"^\s*(-?[0-9.]+)", 1).cast("decimal(30,6)") * factor).cast("long")


def size_pretty(n: Column) -> Column:
    """In the largest unit that keeps more than ten thousand from showing: half units round up."""
    out = None
    a = F.abs(n)
    for i, unit in enumerate(("bytes", "kB", "MB", "GB", "TB", "PB")):
        part = a if i == 0 else F.floor((F.floor(a / F.lit(2 ** (10 * i - 1))) + 1) / 2)
        text = F.concat(F.when(n < 0, F.lit("-")).otherwise(F.lit("")), part.cast("long").cast("string"), F.lit(f" {unit}"))
        fits = (a < 10 * 1024) if i == 0 else (F.floor(a / F.lit(2 ** (10 * i - 1))) < 20 * 1024 - 1)
        out = F.when(fits, text) if out is None else (out.when(fits, text) if i < 5 else out.otherwise(text))
    return out
