"""What changed between images, whatever says where to look: one way from a source of regions to regions that matter.

A source is pixels with `changed` and the regions they are measured in: pixel differences, a map of scores, or boxes that the caller knows.
Differences bring an exact mask and their own regions, which get a margin.  The others are coarser than a pixel: their boxes are
filled, refined by what the pixels say, and given back as they are.

Defined cases: a region in which nothing has changed is none; an image without regions has none, and counts as unchanged unless its source is differences that
lie in no region; scores that are NaN or null count as low.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from driftlake.operators import regions, shifts
from driftlake.operators.pixeldiff import severity
from driftlake.sources.scratch import kept


@dataclass(frozen=True)
class Source:
    px: DataFrame  # (key, x, y, r1..a1, r2..a2, delta, changed), as a table, since several steps read it
    found: DataFrame  # (key, region, bx, by, bw, bh), and pixels where the source knows better than the mask
    exact: bool  # does the mask come from differences?
    key: str = "frame"


def from_differences(px: DataFrame, width: int, height: int, key: str = "frame") -> Source:
    """Components of the changed pixels."""
    px = kept(regions.closed(px, regions.radius(width, height), key))
    return Source(px, regions.detect(px, key), True, key)


def from_boxes(px: DataFrame, boxes: DataFrame, key: str = "frame") -> Source:
    """Boxes (key, region, bx, by, bw, bh) that the caller knows; they may overlap."""
    mask = regions.refined(px, boxes, key).withColumn("_hit", F.lit(True))
    px = px.drop("changed").join(mask, [key, "x", "y"], "left").withColumn("changed", F.coalesce("_hit", F.lit(False))).drop("_hit")
    return Source(kept(px), boxes.select(key, "region", "bx", "by", "bw", "bh"), False, key)


def from_scores(px: DataFrame, cells: DataFrame, across: int, down: int, width: int, height: int, least: float, key: str = "frame") -> Source:
    """Connected cells (key, x, y, score) of a map of across x down cells that score below `least`, numbered by their first cell."""
    boxes = regions.score_map_regions(cells, across, down, width, height, least, key)
    nth = F.row_number().over(Window.partitionBy(key).orderBy("label")) - 1
    return from_boxes(px, boxes.withColumn("region", nth).drop("label"), key)


def interpret(source: Source, width: int, height: int, moves: bool = True) -> DataFrame:
    """The regions that matter: box, pixels, shape, position, change type and confidence; both halves of a move are shifts, and rendering
    noise is left out."""
    key = source.key
    out = regions.change_type(regions.measures(source.px, source.found, key))
    if "pixels" in source.found.columns:
        out = out.join(source.found.select(key, "region", "pixels"), [key, "region"])
    else:
        out = out.withColumnRenamed("n", "pixels")
    if moves:
        out = kept(out)
        out = shifts.with_shifts(out, shifts.shift_pairs(source.px, out, key), key)
    out = out.withColumn("shape", regions.shape()).withColumn("position", regions.position(width, height)).filter("change_type <> 'rendering-noise'")
    if source.exact:
        out = regions.padded(out, width, height)
    out = out.withColumn("percentage", F.col("pixels") * 100.0 / (width * height))
    return out.select(key, "region", "bx", "by", "bw", "bh", "pixels", "percentage", "shape", "position", "change_type", "confidence")


def totals(source: Source, interpreted: DataFrame, width: int, height: int) -> DataFrame:
    """(key, regions, diff_count, diff_percentage, severity) of every image.  Differences count themselves; of a coarse source the changed pixels under
    the regions that matter count, each once."""
    key = source.key
    counts = source.px.filter("changed").groupBy(key).agg(F.count("*").alias("diff_count")) if source.exact else regions.union_pixels(source.px, interpreted, key).withColumnRenamed("pixels", "diff_count")
    out = source.px.select(key).distinct().join(counts, key, "left").join(interpreted.groupBy(key).agg(F.count("*").alias("regions")), key, "left")
    count = F.coalesce("diff_count", F.lit(0))
    out = out.select(key, F.coalesce("regions", F.lit(0)).alias("regions"), count.alias("diff_count"), (count * 100.0 / (width * height)).alias("diff_percentage"))
    return out.withColumn("severity", severity(F.col("diff_percentage")))
