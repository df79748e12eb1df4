"""Pixel differences over exploded image pairs: (image, x, y, r1..a1, r2..a2).

Every step groups by the image or by the image and a row or column, so a table that is repartitioned by the image once
is not shuffled again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlake.functions import color


def block_size(width: int, height: int) -> int:
    """A power of two that grows with the fourth root of the area."""
    import math

    return 1 << max(0, math.floor(math.log2(16 * math.sqrt(math.sqrt(width * height) / 100)) + 0.5))


def neighbours(df: DataFrame, cols: dict[str, str], key: str = "frame") -> DataFrame:
    """Adds for each `source: name` an array name[3 * (dx + 1) + dy + 1] of the pixels around; null outside the image."""
    row = Window.partitionBy(key, "y").orderBy("x")
    for c in cols:
        df = df.withColumn(f"_{c}", F.struct(*[(F.lag(c).over(row) if dx < 0 else F.lead(c).over(row) if dx else F.col(c)).alias(f"x{dx + 1}") for dx in (-1, 0, 1)]))
    column = Window.partitionBy(key, "x").orderBy("y")
    for c, name in cols.items():
        up, here, down = F.lag(f"_{c}").over(column), F.col(f"_{c}"), F.lead(f"_{c}").over(column)
        df = df.withColumn(f"_{c}3", F.struct(up.alias("y0"), here.alias("y1"), down.alias("y2")))
        df = df.withColumn(name, F.array(*[F.col(f"_{c}3.y{dy}.x{dx}") for dx in range(3) for dy in range(3)]))
    return df.drop(*[f"_{c}" for c in cols], *[f"_{c}3" for c in cols])


AROUND = [i for i in range(9) if i != 4]


def on_edge(width: int, height: int) -> Column:
    return (F.col("x") == 0) | (F.col("x") == width - 1) | (F.col("y") == 0) | (F.col("y") == height - 1)


def many_siblings(nine: str, width: int, height: int) -> Column:
    """Do more than two neighbours (the image's edge counts as one) equal the pixel?"""
    n = F.col(nine)
    equal = sum((F.coalesce((n[i] == n[4]).cast("int"), F.lit(0)) for i in AROUND), F.lit(0))
    return equal + on_edge(width, height).cast("int") > 2


def antialiased(steps: str, flags: str, width: int, height: int) -> Column:
    """Is the pixel likely part of anti-aliasing?  `steps` holds brightness differences to the pixels around, `flags` whether
    each of those has many siblings in both images.  Ties go to the first in scan order."""
    order = F.transform(F.arrays_zip(F.col(steps).alias("d"), F.col(flags).alias("m")), lambda s, i: F.struct(s["d"].alias("d"), i.alias("k"), (-i).alias("back"), F.coalesce(s["m"], F.lit(False)).alias("m")))
    around = F.filter(order, lambda s: (s["k"] != 4) & s["d"].isNotNull())
    zeroes = F.size(F.filter(around, lambda s: s["d"] == 0)) + on_edge(width, height).cast("int")
    low = F.array_min(F.filter(around, lambda s: s["d"] < 0))
    high = F.array_max(F.transform(F.filter(around, lambda s: s["d"] > 0), lambda s: F.struct(s["d"].alias("d"), s["back"].alias("b"), s["m"].alias("m"))))
    return (zeroes <= 2) & low.isNotNull() & high.isNotNull() & (low["m"] | high["m"])


def with_status(pairs: DataFrame, width: int, height: int, threshold: float = 0.1, include_aa: bool = False, key: str = "frame") -> DataFrame:
    """Adds delta and status: 'same', 'aa' (a difference put down to anti-aliasing) or 'diff'."""
    at = color.offset(width)
    one, two = color.channels("1"), color.channels("2")
    hit = F.abs("delta") > color.max_delta(threshold)
    out = color.with_delta(pairs, one, two, at).drop("brightness")
    if include_aa:
        return out.withColumn("status", F.when(hit, "diff").otherwise("same"))
    out = out.withColumn("p1", color.pack(one)).withColumn("p2", color.pack(two))
    out = neighbours(out, {"p1": "n1", "p2": "n2"}, key)
    out = out.withColumn("many", many_siblings("n1", width, height) & many_siblings("n2", width, height))
    out = neighbours(out, {"many": "flags"}, key)
    for k in "12":
        centre = color.unpack(F.col(f"n{k}")[4])
        steps = F.transform(f"n{k}", lambda p: color.brightness_delta(centre, color.unpack(p), at))  # noqa: B023
        out = out.withColumn(f"s{k}", steps)
    soft = antialiased("s1", "flags", width, height) | antialiased("s2", "flags", width, height)
    return out.withColumn("status", F.when(~hit, "same").when(F.coalesce(soft, F.lit(False)), "aa").otherwise("diff")).drop("p1", "p2", "n1", "n2", "s1", "s2", "many", "flags")


def severity(percentage: Column) -> Column:
    return F.when(percentage < 1, "low").when(percentage <= 10, "medium").otherwise("high")


def summary(status: DataFrame, key: str = "frame") -> DataFrame:
    """Per image: diff_count, diff_percentage, identical, severity."""
    out = status.groupBy(key).agg(
        F.count_if(F.col("status") == "diff").alias("diff_count"),
        F.count_if(F.col("status") == "aa").alias("aa_count"),
        F.count("*").alias("pixels"),
        F.bool_and(F.col("delta") == 0).alias("identical"),
    )
    share = F.when(F.col("pixels") > 0, F.col("diff_count") * 100.0 / F.col("pixels")).otherwise(0.0)
    return out.withColumn("diff_percentage", share).withColumn("severity", severity(share))


def picture(status: DataFrame, alpha: float = 0.1, diff: tuple[int, int, int] = (255, 0, 0), aa: tuple[int, int, int] = (255, 255, 0), darker: tuple[int, int, int] | None = None, mask: bool = False) -> DataFrame:
    """The picture of differences: (frame, x, y, r, g, b, a)."""
    fade = color.faded(color.channels("1"), alpha)
    out = []
    for i, c in enumerate("rgb"):
        hit = F.when(F.col("delta") < 0, darker[i]).otherwise(diff[i]) if darker else F.lit(diff[i])
        quiet = F.lit(0) if mask else fade
        out.append(F.when(F.col("status") == "diff", hit).when((F.col("status") == "aa") & F.lit(not mask), aa[i]).otherwise(quiet).cast("int").alias(c))
    return status.select("frame", "x", "y", *out, F.when((F.col("status") == "same") & F.lit(mask), 0).otherwise(255).cast("int").alias("a"))


def changed_blocks(pairs: DataFrame, size: int, width: int, threshold: float = 0.1, key: str = "frame") -> DataFrame:
    """Blocks that hold at least one perceptual difference."""
    hit = color.exceeds(color.channels("1"), color.channels("2"), color.offset(width), threshold)
    grid = pairs.withColumn("bx", F.floor(F.col("x") / size)).withColumn("by", F.floor(F.col("y") / size))
    return grid.groupBy(key, "bx", "by").agg(F.bool_or(hit).alias("changed")).filter("changed").drop("changed")


def blocked_count(pairs: DataFrame, size: int, width: int, threshold: float = 0.1, key: str = "frame") -> DataFrame:
    """Difference counts by way of changed blocks: worthwhile when costly work follows on their pixels alone."""
    grid = pairs.withColumn("bx", F.floor(F.col("x") / size)).withColumn("by", F.floor(F.col("y") / size))
    hot = grid.join(changed_blocks(pairs, size, width, threshold, key), [key, "bx", "by"], "left_semi")
    hit = color.exceeds(color.channels("1"), color.channels("2"), color.offset(width), threshold)
    return hot.groupBy(key).agg(F.count_if(hit).alias("diff_count"))


def outcome(first_sizes: DataFrame, second_sizes: DataFrame, counts: DataFrame, key: str = "frame") -> DataFrame:
    """match / layout-diff / pixel-diff / file-not-exists for every image of either side: (key, w, h) tables and counts."""
    a = first_sizes.select(key, F.col("w").alias("w1"), F.col("h").alias("h1"))
    b = second_sizes.select(key, F.col("w").alias("w2"), F.col("h").alias("h2"))
    both = a.join(b, key, "full").join(counts, key, "left")
    reason = (
        F.when(F.col("w1").isNull() | F.col("w2").isNull(), "file-not-exists")
        .when((F.col("w1") != F.col("w2")) | (F.col("h1") != F.col("h2")), "layout-diff")
        .when(F.coalesce("diff_count", F.lit(0)) > 0, "pixel-diff")
        .otherwise("match")
    )
    return both.select(key, reason.alias("reason"), F.coalesce("diff_count", F.lit(0)).alias("diff_count"))
