"""Colour arithmetic on pixels as Column expressions, within whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# YIQ coefficients, the metric's weights, and its scale.
Y = (0.29889531, 0.58662247, 0.11448223)
I = (0.59597799, -0.2741761, -0.32180189)  # noqa: E741
Q = (0.21147017, -0.52261711, 0.31114694)
WEIGHTS = (0.5053, 0.299, 0.1957)
FULL = 35215.0
LAMBDA = 0.2560782  # no squared channel distance d gives a metric beyond LAMBDA * d
GRAY = (0.298936, 0.587043, 0.114021)
BT601 = (0.299, 0.587, 0.114)
PHI, PHI2 = 1.618033988749895, 2.618033988749895


def _dot(v: tuple[Column, Column, Column], w: tuple[float, float, float]) -> Column:
    return v[0] * F.lit(w[0]) + v[1] * F.lit(w[1]) + v[2] * F.lit(w[2])


def offset(width: int, x: str = "x", y: str = "y") -> Column:
    """Byte offset of a pixel, the phase of the checkerboard that transparent pixels are blended over."""
    return (F.col(y) * width + F.col(x)) * 4


def channel_deltas(one: list[Column], two: list[Column], at: Column) -> tuple[Column, Column, Column]:
    """Differences of red, green and blue; over the checkerboard where either pixel is transparent."""
    opaque = (one[3] >= 255) & (two[3] >= 255)
    da = one[3] - two[3]
    backs = [F.lit(48), 48 + 159 * (F.floor(at / F.lit(PHI)) % 2), 48 + 159 * (F.floor(at / F.lit(PHI2)) % 2)]
    r, g, b = (F.when(opaque, (p - q).cast("double")).otherwise((p * one[3] - q * two[3] - back * da) / F.lit(255.0)) for p, q, back in zip(one, two, backs))
    return r, g, b


def channels(suffix: str = "") -> list[Column]:
    return [F.col(f"{c}{suffix}") for c in "rgba"]


def brightness_delta(one: list[Column], two: list[Column], at: Column) -> Column:
    return _dot(channel_deltas(one, two, at), Y)


def color_delta(one: list[Column], two: list[Column], at: Column) -> Column:
    """The signed metric: negative where the second pixel is darker."""
    d = channel_deltas(one, two, at)
    y, i, q = _dot(d, Y), _dot(d, I), _dot(d, Q)
    size = F.lit(WEIGHTS[0]) * y * y + F.lit(WEIGHTS[1]) * i * i + F.lit(WEIGHTS[2]) * q * q
    return F.when(y > 0, -size).otherwise(size)


def max_delta(threshold: float) -> float:
    return FULL * threshold * threshold


def with_delta(df: DataFrame, one: list[Column], two: list[Column], at: Column) -> DataFrame:
    """Adds brightness and delta step by step, so that generated code holds each difference once."""
    for c, d in zip(("_dr", "_dg", "_db"), channel_deltas(one, two, at)):
        df = df.withColumn(c, d)
    d = (F.col("_dr"), F.col("_dg"), F.col("_db"))
    for c, w in zip(("brightness", "_i", "_q"), (Y, I, Q)):
        df = df.withColumn(c, _dot(d, w))
    y, i, q = F.col("brightness"), F.col("_i"), F.col("_q")
    df = df.withColumn("_d", F.lit(WEIGHTS[0]) * y * y + F.lit(WEIGHTS[1]) * i * i + F.lit(WEIGHTS[2]) * q * q)
    return df.withColumn("delta", F.when(y > 0, -F.col("_d")).otherwise(F.col("_d"))).drop("_dr", "_dg", "_db", "_i", "_q", "_d")


def exceeds(one: list[Column], two: list[Column], at: Column, threshold: float) -> Column:
    """Is the metric beyond the threshold?  Equal pixels and, by the metric's largest eigenvalue, slight differences are
    told apart by integer arithmetic first."""
    limit = max_delta(threshold)
    equal = (one[0] == two[0]) & (one[1] == two[1]) & (one[2] == two[2]) & (one[3] == two[3])
    d = [p - q for p, q in zip(one[:3], two[:3])]
    slight = (one[3] == 255) & (two[3] == 255) & (d[0] * d[0] + d[1] * d[1] + d[2] * d[2] <= F.lit(limit / LAMBDA))
    return ~equal & ~slight & (F.abs(color_delta(one, two, at)) > F.lit(limit))


def pack(c: list[Column]) -> Column:
    """RGBA as one number, red in the low byte."""
    return c[0].cast("long") + c[1].cast("long") * 256 + c[2].cast("long") * 65536 + c[3].cast("long") * 16777216


def unpack(p: Column) -> list[Column]:
    return [F.shiftrightunsigned(p, 8 * i).bitwiseAND(F.lit(255).cast("long")).cast("int") for i in range(4)]


def gray(c: list[Column]) -> Column:
    """Luma as in MATLAB's rgb2gray."""
    return _dot((c[0], c[1], c[2]), GRAY)


def luminance(c: list[Column]) -> Column:
    return _dot((c[0], c[1], c[2]), BT601)


def yiq(c: list[Column]) -> list[Column]:
    return [_dot((c[0], c[1], c[2]), w) for w in (Y, I, Q)]


def faded(c: list[Column], alpha: float) -> Column:
    """The gray that stands for an unchanged pixel in a picture of differences."""
    return (255 + (_dot((c[0], c[1], c[2]), Y) - 255) * F.lit(alpha) * c[3] / 255).cast("int")


def lab(c: list[Column]) -> list[Column]:
    """CIE L*a*b* of sRGB under D65."""

    def linear(v: Column) -> Column:
        s = v / F.lit(255.0)
        return F.when(s <= 0.04045, s / 12.92).otherwise(F.pow((s + 0.055) / 1.055, F.lit(2.4)))

    r, g, b = (linear(v) for v in c[:3])
    xyz = [(0.4124564 * r + 0.3575761 * g + 0.1804375 * b) / 0.95047, 0.2126729 * r + 0.7151522 * g + 0.0721750 * b, (0.0193339 * r + 0.1191920 * g + 0.9503041 * b) / 1.08883]
    f = [F.when(t > 216 / 24389, F.cbrt(t)).otherwise((24389 / 27 * t + 16) / 116) for t in xyz]
    return [116 * f[1] - 16, 500 * (f[0] - f[1]), 200 * (f[1] - f[2])]


def lab_bytes(c: list[Column]) -> list[Column]:
    """L*a*b* with each channel on the scale of 0 to 255, as similarity over colours takes it."""
    l, a, b = lab(c)
    return [l * 2.55, a + 128, b + 128]


def parse_rgb(text: str) -> tuple[int, int, int]:
    """'r,g,b' as an option."""
    parts = [p.strip() for p in text.split(",")]
    if len(parts) != 3 or not all(p.isdigit() and int(p) < 256 for p in parts):
        raise ValueError(f"expected r,g,b with values from 0 to 255, got {text!r}")
    return tuple(int(p) for p in parts)  # type: ignore[return-value]
