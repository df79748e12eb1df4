"""Structural and gradient similarity of exploded image pairs, as groupings and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlake.functions import color

C1, C2 = (0.01 * 255) ** 2, (0.03 * 255) ** 2
GMS_C = 170.0


def with_gray(pairs: DataFrame) -> DataFrame:
    """Luma in single precision, as metrics see it: l1, l2."""
    return pairs.withColumn("l1", color.gray(color.channels("1")).cast("float").cast("double")).withColumn("l2", color.gray(color.channels("2")).cast("float").cast("double"))


def _ssim(m1: Column, m2: Column, v1: Column, v2: Column, cov: Column) -> Column:
    return (2 * m1 * m2 + C1) * (2 * cov + C2) / ((m1 * m1 + m2 * m2 + C1) * (v1 + v2 + C2))


def _window_ssim(sums: DataFrame, area: int) -> DataFrame:
    m1, m2 = F.col("s1") / area, F.col("s2") / area
    return sums.withColumn("ssim", _ssim(m1, m2, F.col("s11") / area - m1 * m1, F.col("s22") / area - m2 * m2, F.col("s12") / area - m1 * m2))


def box_windows(pairs: DataFrame, width: int, height: int, window: int = 11, stride: int | None = None, key: str = "frame") -> DataFrame:
    """SSIM of box windows: (key, wx, wy, ssim).  Windows that don't overlap are a grouping; others come from sums over
    row frames, first along rows, then along columns."""
    g = with_gray(pairs)
    moments = {"s1": F.col("l1"), "s2": F.col("l2"), "s11": F.col("l1") * F.col("l1"), "s22": F.col("l2") * F.col("l2"), "s12": F.col("l1") * F.col("l2")}
    stride = window if stride is None else stride
    across, down = (width - window) // stride + 1, (height - window) // stride + 1
    if stride == window:
        cells = g.filter((F.col("x") < across * window) & (F.col("y") < down * window)).withColumn("wx", F.floor(F.col("x") / window)).withColumn("wy", F.floor(F.col("y") / window))
        sums = cells.groupBy(key, "wx", "wy").agg(*[F.sum(c).alias(n) for n, c in moments.items()])
    else:
        row = Window.partitionBy(key, "y").orderBy("x").rowsBetween(0, window - 1)
        column = Window.partitionBy(key, "x").orderBy("y").rowsBetween(0, window - 1)
        sums = g.select(key, "x", "y", *[c.alias(n) for n, c in moments.items()]).select(key, "x", "y", *[F.sum(n).over(row).alias(n) for n in moments])
        sums = sums.select(key, "x", "y", *[F.sum(n).over(column).alias(n) for n in moments])
        sums = sums.filter((F.col("x") % stride == 0) & (F.col("y") % stride == 0) & (F.col("x") <= width - window) & (F.col("y") <= height - window))
        sums = sums.withColumn("wx", F.floor(F.col("x") / stride)).withColumn("wy", F.floor(F.col("y") / stride))
    return _window_ssim(sums, window * window).select(key, "wx", "wy", "ssim")


def cov_pooled(windows: DataFrame, key: str = "frame") -> DataFrame:
    """One minus the coefficient of variation of the windows' scores, and their plain mean."""
    pooled = F.when(F.avg("ssim") > 0, 1 - F.stddev_pop("ssim") / F.avg("ssim")).otherwise(1.0)
    return windows.groupBy(key).agg(pooled.alias("score"), F.avg("ssim").alias("mean_score"), F.count("*").alias("windows"))


def below_floor(windows: DataFrame, floor: float, min_score: float, key: str = "frame") -> DataFrame:
    """Windows under a floor, their share, and whether the mean reaches min_score (NaN never does)."""
    out = windows.groupBy(key).agg(F.count_if(F.col("ssim") < floor).alias("below"), F.count("*").alias("windows"), F.avg("ssim").alias("score"))
    return out.withColumn("below_pct", F.col("below") * 100.0 / F.col("windows")).withColumn("match", (F.col("score") >= min_score) & ~F.isnan("score"))


def taps(size: int = 11, sigma: float = 1.5) -> list[float]:
    """A normalised Gaussian window."""
    import math

    raw = [math.exp(-((i - (size - 1) / 2) ** 2) / (2 * sigma * sigma)) for i in range(size)]
    return [v / sum(raw) for v in raw]


def gaussian_windows(pairs: DataFrame, width: int, height: int, size: int = 11, key: str = "frame") -> DataFrame:
    """SSIM under a Gaussian window at every place where it fits: separable, with lead() along rows and then columns."""
    g = with_gray(pairs)
    w = taps(size)
    moments = {"s1": F.col("l1"), "s2": F.col("l2"), "s11": F.col("l1") * F.col("l1"), "s22": F.col("l2") * F.col("l2"), "s12": F.col("l1") * F.col("l2")}
    row, column = Window.partitionBy(key, "y").orderBy("x"), Window.partitionBy(key, "x").orderBy("y")
    g = g.select(key, "x", "y", F.struct(*[c.alias(n) for n, c in moments.items()]).alias("m"))

    def along(df: DataFrame, win) -> DataFrame:
        near = [F.lead("m", i).over(win) for i in range(size)]
        df = df.select(key, "x", "y", F.array(*near).alias("n"))
        return df.select(key, "x", "y", F.struct(*[sum((F.col("n")[i][c] * w[i] for i in range(1, size)), F.col("n")[0][c] * w[0]).alias(c) for c in moments]).alias("m"))

    out = along(along(g, row), column).filter((F.col("x") <= width - size) & (F.col("y") <= height - size)).select(key, "x", "y", "m.*")
    return _window_ssim(out, 1).select(key, "x", "y", "ssim")


def gaussian_ssim(pairs: DataFrame, width: int, height: int, key: str = "frame") -> DataFrame:
    """Mean SSIM, for images under 384 pixels a side (larger ones are shrunk first, see planes.ssim)."""
    return gaussian_windows(pairs, width, height, key=key).groupBy(key).agg(F.avg("ssim").alias("score"))


def gradients(pairs: DataFrame, width: int, height: int, key: str = "frame") -> DataFrame:
    """Prewitt magnitudes of interior pixels: (key, x, y, g1, g2).  One window pass along rows, one along columns."""
    g = with_gray(pairs)
    row, column = Window.partitionBy(key, "y").orderBy("x"), Window.partitionBy(key, "x").orderBy("y")
    for k in ("1", "2"):
        left, mid, right = F.lag(f"l{k}").over(row), F.col(f"l{k}"), F.lead(f"l{k}").over(row)
        g = g.withColumn(f"d{k}", left - right).withColumn(f"t{k}", left + mid + right)
    for k in ("1", "2"):
        up, down = F.lag(f"d{k}").over(column), F.lead(f"d{k}").over(column)
        gx = (up + F.col(f"d{k}") + down) / 3
        gy = (F.lag(f"t{k}").over(column) - F.lead(f"t{k}").over(column)) / 3
        g = g.withColumn(f"g{k}", F.sqrt(gx * gx + gy * gy))
    return g.filter((F.col("x") > 0) & (F.col("y") > 0) & (F.col("x") < width - 1) & (F.col("y") < height - 1)).select(key, "x", "y", "g1", "g2")


def gms(grads: DataFrame, c: float = GMS_C) -> DataFrame:
    """Gradient magnitude similarity of every pixel."""
    a, b = F.col("g1"), F.col("g2")
    return grads.withColumn("gms", (2 * a * b + c) / (a * a + b * b + c))


def gmsd(pairs: DataFrame, width: int, height: int, c: float = GMS_C, key: str = "frame") -> DataFrame:
    """Deviation of the gradient similarity: 0 for equal images."""
    return gms(gradients(pairs, width, height, key), c).groupBy(key).agg(F.stddev_pop("gms").alias("gmsd"))


def halved(pairs: DataFrame, width: int, height: int, key: str = "frame") -> DataFrame:
    """GMSD's optional reduction: 2 x 2 means, zero beyond the edge, at every second pixel."""
    g = with_gray(pairs)
    out = g.withColumn("x", F.expr("x div 2").cast("int")).withColumn("y", F.expr("y div 2").cast("int")).groupBy(key, "x", "y").agg((F.sum("l1") / 4).alias("v1"), (F.sum("l2") / 4).alias("v2"))
    out = out.filter((F.col("x") < width // 2) & (F.col("y") < height // 2))
    return out.select(key, "x", "y", *[F.col(f"v{k}").alias(f"{c}{k}") for k in (1, 2) for c in "rgb"], F.lit(255).alias("a1"), F.lit(255).alias("a2"))


def map_picture(windows: DataFrame, pixels: DataFrame, width: int, height: int, across: int, down: int, value: str = "ssim", key: str = "frame") -> DataFrame:
    """A window map scaled to the image by nearest window, as grays 0 to 255: (key, x, y, gray)."""
    at = pixels.select(key, "x", "y", F.expr(f"least(x * {across} div {width}, {across - 1})").alias("wx"), F.expr(f"least(y * {down} div {height}, {down - 1})").alias("wy"))
    shade = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(value))) * 255).cast("int")
    return at.join(windows, [key, "wx", "wy"]).select(key, "x", "y", shade.alias("gray"))
