"""Which regions of change are the two halves of a move: what left one place is what stands at another.

Every pair of regions of one image that could fit is scored in both directions by how well the first image's crop at one
region matches the second image's crop at the other; pairs are taken best first, each region once."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlake.sources.scratch import kept

# Thresholds of the match.
NCC_LEAST, NCC_RETRY, REACH = 0.80, 0.45, 3
MAD_MOST, FLAT_MAD_MOST = 0.15, 0.05
FLAT_VARIANCE, RING_CONTRAST = 4.0, 20.0
RATIOS = (0.55, 1.82)
RETRY_SIDE = 8
BT601 = (0.299, 0.587, 0.114)
SHIFT = "shift"


def _likeness(a: np.ndarray, b: np.ndarray) -> tuple[float, float, bool]:
    """Correlation, mean absolute difference (0 to 1), and whether either crop is flat."""
    mad = float(np.abs(a - b).mean() / 255)
    da, db = a - a.mean(), b - b.mean()
    va, vb = float((da * da).mean()), float((db * db).mean())
    if va < FLAT_VARIANCE or vb < FLAT_VARIANCE:
        return 0.0, mad, True
    return float(np.clip((da * db).mean() / np.sqrt(va * vb), -1, 1)), mad, False


def _contrast(plane: np.ndarray, x: int, y: int, w: int, h: int) -> float:
    """How far a crop's mean lies from that of the pixels around it."""
    outer = plane[max(0, y - 1) : y + h + 1, max(0, x - 1) : x + w + 1]
    inner = plane[y : y + h, x : x + w]
    n = outer.size - inner.size
    return abs(float(inner.mean()) - float((outer.sum() - inner.sum()) / n)) if n else 0.0


def score(one: np.ndarray, two: np.ndarray, source: tuple[int, int, int, int], target: tuple[int, int, int, int]) -> float | None:
    """How well what stood at `source` in the first plane fits what stands at `target` in the second; None if it doesn't.  Boxes are
    (x, y, width, height); crops of their common size lie at their centres."""
    w, h = min(source[2], target[2]), min(source[3], target[3])
    if not w or not h:
        return None
    sx, sy = source[0] + (source[2] - w) // 2, source[1] + (source[3] - h) // 2
    tx, ty = target[0] + (target[2] - w) // 2, target[1] + (target[3] - h) // 2
    crop = one[sy : sy + h, sx : sx + w]
    ncc, mad, flat = _likeness(crop, two[ty : ty + h, tx : tx + w])
    if flat:  # without texture only equal means fit, and only for what stands out from its surroundings
        stands_out = _contrast(one, sx, sy, w, h) > RING_CONTRAST and _contrast(two, tx, ty, w, h) > RING_CONTRAST
        return -mad if mad <= FLAT_MAD_MOST and stands_out else None
    if ncc >= NCC_LEAST and mad <= MAD_MOST:
        return ncc - mad
    if ncc < NCC_RETRY or w < RETRY_SIDE or h < RETRY_SIDE:
        return None
    found = []
    for dy in range(-REACH, REACH + 1):
        for dx in range(-REACH, REACH + 1):
            x, y = tx + dx, ty + dy
            if (dx or dy) and x >= 0 and y >= 0 and x + w <= two.shape[1] and y + h <= two.shape[0]:
                ncc, mad, flat = _likeness(crop, two[y : y + h, x : x + w])
                if not flat and ncc >= NCC_LEAST and mad <= MAD_MOST:
                    found.append(ncc - mad)
    return max(found, default=None)


def candidates(regions: DataFrame, key: str = "frame") -> DataFrame:
    """(key, region, partner), region < partner: pairs of regions of an image whose sizes fit each other.

    A region is filed under the logarithms of its width and height, cut to steps of the largest ratio that fits, and looked up in its own and the
    neighbouring steps; so regions of other sizes never meet."""
    step = lambda c: F.floor(F.ln(F.greatest(F.lit(1), F.col(c)).cast("double")) / math.log(RATIOS[1]))
    filed = regions.select(key, "region", "change_type", "bw", "bh", step("bw").alias("_w"), step("bh").alias("_h"))
    near = F.array(F.lit(-1), F.lit(0), F.lit(1))
    asked = filed.withColumn("_dw", F.explode(near)).withColumn("_dh", F.explode(near)).withColumn("_w", F.col("_w") + F.col("_dw")).withColumn("_h", F.col("_h") + F.col("_dh")).drop("_dw", "_dh")
    names = {"region": "partner", "change_type": "_type", "bw": "_pw", "bh": "_ph"}
    both = asked.join(filed.withColumnsRenamed(names), [key, "_w", "_h"]).filter("region < partner")
    fits = lambda a, b: (F.col(a) / F.greatest(F.lit(1), F.col(b))).between(*RATIOS)
    same = (F.col("change_type") == "color-change") & (F.col("_type") == "color-change")
    return both.filter(fits("bw", "_pw") & fits("bh", "_ph") & ~same).select(key, "region", "partner")


def pairs_of(one: np.ndarray, two: np.ndarray, boxes: dict[int, tuple[int, int, int, int]], pairs: list[tuple[int, int]]) -> list[tuple[int, int, float]]:
    """(region, region, score) of matched halves among pairs of the boxes."""
    scored = []
    for a, b in pairs:
        both = [s for s in (score(one, two, boxes[a], boxes[b]), score(one, two, boxes[b], boxes[a])) if s is not None]
        if both:
            scored.append((max(both), a, b))
    taken: set[int] = set()
    out = []
    for s, a, b in sorted(scored, key=lambda t: -t[0]):
        if a not in taken and b not in taken:
            taken |= {a, b}
            out.append((a, b, s))
    return out


def shift_pairs(px: DataFrame, regions: DataFrame, key: str = "frame") -> DataFrame:
    """(key, region, partner, score): matched halves among regions (key, region, change_type, bx, by, bw, bh) of pixels
    (key, x, y, r1..b1, r2..b2).  Only images with candidates are looked at."""
    pairs = kept(candidates(regions, key))
    several = pairs.select(key).distinct()
    luma = lambda k: sum((F.col(f"{c}{k}") * F.lit(w) for c, w in zip("gb", BT601[1:])), F.col(f"r{k}") * F.lit(BT601[0])).alias(f"l{k}")
    image = px.join(F.broadcast(several) if several.count() <= 200_000 else several, key, "left_semi").select(key, "x", "y", luma(1), luma(2))
    kind = px.schema[key].dataType.simpleString()
    box = lambda n: F.struct(*[F.col(c).cast("int").alias(c) for c in ("bx", "by", "bw", "bh")]).alias(n)
    ends = regions.select(key, "region", box("a"))
    few = pairs.join(ends, [key, "region"]).join(ends.withColumnsRenamed({"region": "partner", "a": "b"}), [key, "partner"])
    few = few.select(F.col(key).alias("_image"), "region", "partner", "a", "b")  # a name of its own, as regions may come from px

    def run(pixels: pa.Table, found: pa.Table) -> pa.Table:
        out = []
        if pixels.num_rows and found.num_rows:
            x, y = pixels.column("x").to_numpy(), pixels.column("y").to_numpy()
            planes = []
            for c in ("l1", "l2"):
                p = np.zeros((int(y.max()) + 1, int(x.max()) + 1))
                p[y, x] = pixels.column(c).to_numpy()
                planes.append(p)
            rows = sorted(found.select(["region", "partner", "a", "b"]).to_pylist(), key=lambda r: (r["region"], r["partner"]))
            boxes = {r[n]: tuple(r[b].values()) for r in rows for n, b in (("region", "a"), ("partner", "b"))}
            out = pairs_of(*planes, boxes, [(r["region"], r["partner"]) for r in rows])
        columns = [pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 3, (pa.int32(), pa.int32(), pa.float64()))]
        image = found.column("_image").slice(0, 1).to_pylist() * len(out)
        return pa.table({key: pa.array(image, found.schema.field("_image").type), **dict(zip(("region", "partner", "score"), columns))})

    return image.groupBy(key).cogroup(few.groupBy("_image")).applyInArrow(run, f"`{key}` {kind}, region int, partner int, score double")


def with_shifts(regions: DataFrame, found: DataFrame, key: str = "frame") -> DataFrame:
    """regions in which both halves of every pair are shifts."""
    halves = found.select(key, F.explode(F.array("region", "partner")).alias("region"), F.lit(True).alias("_moved"))
    return regions.join(halves, [key, "region"], "left").withColumn("change_type", F.when(F.col("_moved"), SHIFT).otherwise(F.col("change_type"))).drop("_moved")
