"""Regions of change in exploded image pairs: masks, components, their measures, and what kind of change each is.

Pixels are (image, x, y, r1..a1, r2..a2) with `delta` and `changed`.  Measures are windows and groupings; only what depends
on order (labels of connected pixels, greedy merging of boxes) runs in Python, one image at a time.

Defined cases: an image without changed pixels has no regions; regions of one image are numbered by pixel count, then by
the place of their first pixel; a region without unchanged surroundings lies at distance 1 from its background.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlake.functions import color

# Thresholds of detection.
TOUCHED = 16.0  # a squared metric: the pixel differs at all
TOUCHED_SHARE = 0.45
SLACK_X, SLACK_Y = 12, 8
SPECK, CENSUS, PER_SPECK, FLOOR = 8, 64, 3, 12
MARGIN_PART, MARGIN_LEAST, MARGIN_MOST = 3, 2, 12
EDGE_SQUARED = 900.0
# Thresholds of the change types.
BLEND, ASYMMETRY = 0.08, 0.04
NCC_KEPT, NCC_REPLACED, NCC_RECOLOR = 0.55, 0.05, 0.88
RECOLOR_DELTA = 0.00005
CHROMA_MOVE, CHROMA_ROUGH, SAME_HUE, Q_MOVE, DRAB = 0.131, 0.75, 0.235, 0.071, 0.072
LIGHTEN, DARKEN, DARKEN_EDGES = 0.268, -0.150, 0.101


def radius(width: int, height: int) -> int:
    return min(15, max(2, max(width, height) // 200))


def closed(px: DataFrame, reach: int, key: str = "frame") -> DataFrame:
    """Adds `closed`, the mask `changed` dilated and eroded by a square; windows end at the image's edge."""
    row = Window.partitionBy(key, "y").orderBy("x").rowsBetween(-reach, reach)
    column = Window.partitionBy(key, "x").orderBy("y").rowsBetween(-reach, reach)
    px = px.withColumn("_m", F.max("changed").over(row)).withColumn("_m", F.max("_m").over(column))
    return px.withColumn("_m", F.min("_m").over(column)).withColumn("closed", F.min("_m").over(row)).drop("_m")


def connected(mask: np.ndarray) -> np.ndarray:
    """Labels of 4-connected cells: the least flat index of each component, -1 outside the mask."""
    none = mask.size
    grid = np.full((mask.shape[0] + 2, mask.shape[1] + 2), none)
    inner = grid[1:-1, 1:-1]
    inner[mask] = np.flatnonzero(mask)
    while mask.any():
        near = np.minimum.reduce([inner, grid[:-2, 1:-1], grid[2:, 1:-1], grid[1:-1, :-2], grid[1:-1, 2:]])
        flat = np.append(near.ravel(), none)
        near = np.where(mask, np.minimum(near, flat[near]), none)  # labels jump along labels
        if (near == inner).all():
            break
        inner[:] = near
    return np.where(mask, inner, -1)


def _grid(t: pa.Table, *names: str) -> list[np.ndarray]:
    x, y = t.column("x").to_numpy(), t.column("y").to_numpy()
    out = []
    for n in names:
        g = np.zeros((int(y.max()) + 1, int(x.max()) + 1), bool)
        g[y, x] = t.column(n).to_numpy(zero_copy_only=False)
        out.append(g)
    return out


def labelled(px: DataFrame, key: str = "frame") -> DataFrame:
    """(key, x, y, label) of closed pixels; a label is the row, above 32 bits, and the column of a component's first pixel."""
    kind = px.schema[key].dataType.simpleString()

    def run(t: pa.Table) -> pa.Table:
        (mask,) = _grid(t, "closed")
        label = connected(mask)
        y, x = np.nonzero(mask)
        top, left = np.divmod(label[y, x], mask.shape[1])
        image = pa.array([t.column(key)[0].as_py()] * len(x), t.schema.field(key).type)
        return pa.table({key: image, "x": pa.array(x, pa.int32()), "y": pa.array(y, pa.int32()), "label": pa.array(top.astype(np.int64) << 32 | left, pa.int64())})

    return px.filter("closed").select(key, "x", "y", "closed").groupBy(key).applyInArrow(run, f"{key} {kind}, x int, y int, label long")


def component_boxes(px: DataFrame, key: str = "frame") -> DataFrame:
    """(key, label, bx, by, bw, bh, pixels): the changed pixels of every component of the closed mask."""
    changed = px.filter("changed").select(key, "x", "y").join(labelled(px, key), [key, "x", "y"])
    boxes = changed.groupBy(key, "label").agg(F.min("x").alias("bx"), F.min("y").alias("by"), F.max("x").alias("_x"), F.max("y").alias("_y"), F.count("*").alias("pixels"))
    return boxes.select(key, "label", "bx", "by", (F.col("_x") - F.col("bx") + 1).alias("bw"), (F.col("_y") - F.col("by") + 1).alias("bh"), "pixels")


def noise_census(boxes: DataFrame, key: str = "frame") -> DataFrame:
    """Per image: components, specks, and the pixels that a region must have."""
    small = F.count_if(F.col("pixels") < CENSUS)
    return boxes.groupBy(key).agg(F.count("*").alias("components"), small.alias("small"), F.greatest(small * PER_SPECK, F.lit(FLOOR)).alias("floor"))


def _merged(boxes: list[list[int]], share) -> list[list[int]]:
    """Joins boxes [x0, y0, x1, y1, pixels] that lie close while what encloses them is mostly touched, until none joins."""

    def absorb(into: list[int], box: list[int]) -> bool:
        apart_x = max(box[0] - into[2], into[0] - box[2])
        apart_y = max(box[1] - into[3], into[1] - box[3])
        if apart_x > SLACK_X or apart_y > SLACK_Y:
            return False
        hull = [min(into[0], box[0]), min(into[1], box[1]), max(into[2], box[2]), max(into[3], box[3])]
        if hull != into[:4] and share(*hull) < TOUCHED_SHARE:
            return False
        into[:] = [*hull, into[4] + box[4]]
        return True

    before = -1
    while before != len(boxes):
        before, held = len(boxes), []
        for box in boxes:
            if not any(absorb(h, box) for h in held):
                held.append(list(box))
        boxes = held
    return sorted(boxes, key=lambda b: -b[4])


def detect(px: DataFrame, key: str = "frame") -> DataFrame:
    """(key, region, bx, by, bw, bh, pixels) of pixels with `closed`: components without specks, merged, above the noise floor."""
    kind = px.schema[key].dataType.simpleString()
    rows = px.select(key, "x", "y", "changed", "closed", (F.abs("delta") > TOUCHED).alias("touched"))

    def run(t: pa.Table) -> pa.Table:
        mask, close, touched = _grid(t, "changed", "closed", "touched")
        label = np.where(mask, connected(close), -1)
        y, x = np.nonzero(label >= 0)
        names, at = np.unique(label[y, x], return_inverse=True)
        pixels = np.bincount(at, minlength=len(names))
        ends = np.zeros((len(names), 4), int)
        for column, fold, values in ((0, np.minimum, x), (1, np.minimum, y), (2, np.maximum, x + 1), (3, np.maximum, y + 1)):
            ends[:, column] = mask.size if fold is np.minimum else 0
            fold.at(ends[:, column], at, values)
        floor = max(PER_SPECK * int((pixels < CENSUS).sum()), FLOOR)
        order = [i for i in np.argsort(-pixels, kind="stable") if pixels[i] >= SPECK]
        boxes = [[*map(int, ends[i]), int(pixels[i])] for i in order]
        sums = np.pad(touched.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
        share = lambda a, b, c, d: (sums[d, c] - sums[b, c] - sums[d, a] + sums[b, a]) / ((c - a) * (d - b))
        boxes = [b for b in _merged(boxes, share) if b[4] >= floor]
        image = pa.array([t.column(key)[0].as_py()] * len(boxes), t.schema.field(key).type)
        columns = {"region": [*range(len(boxes))], "bx": [b[0] for b in boxes], "by": [b[1] for b in boxes], "bw": [b[2] - b[0] for b in boxes], "bh": [b[3] - b[1] for b in boxes]}
        return pa.table({key: image, **{n: pa.array(v, pa.int32()) for n, v in columns.items()}, "pixels": pa.array([b[4] for b in boxes], pa.int64())})

    return rows.groupBy(key).applyInArrow(run, f"{key} {kind}, region int, bx int, by int, bw int, bh int, pixels long")


def with_edges(px: DataFrame, *keys: str) -> DataFrame:
    """Adds e1, e2: is the luminance's central difference, one-sided at the image's edge, an edge in each image?"""
    row, column = Window.partitionBy(*keys, "y").orderBy("x"), Window.partitionBy(*keys, "x").orderBy("y")
    for k in "12":
        px = px.withColumn(f"l{k}", color.luminance(color.channels(k)))
    for k in "12":
        here = F.col(f"l{k}")
        for name, w in (("_gx", row), ("_gy", column)):
            ahead, back = F.lead(here).over(w), F.lag(here).over(w)
            px = px.withColumn(name, F.when(back.isNull(), F.coalesce(ahead - here, F.lit(0.0))).when(ahead.isNull(), here - back).otherwise((ahead - back) * 0.5))
        px = px.withColumn(f"e{k}", F.col("_gx") * F.col("_gx") + F.col("_gy") * F.col("_gy") >= EDGE_SQUARED)
    return px.drop("_gx", "_gy")


def _chroma_distance() -> Column:
    (_, i1, q1), (_, i2, q2) = color.yiq(color.channels("1")), color.yiq(color.channels("2"))
    return F.sqrt((i2 - i1) * (i2 - i1) + (q2 - q1) * (q2 - q1))


def with_steps(px: DataFrame, *keys: str) -> DataFrame:
    """Adds dc, the move of chroma, and sx, sy: how it differs from the changed pixel to the left and above (null if unchanged)."""
    row, column = Window.partitionBy(*keys, "y").orderBy("x"), Window.partitionBy(*keys, "x").orderBy("y")
    px = px.withColumn("dc", _chroma_distance())
    moved = F.when(F.col("changed"), F.col("dc"))
    return px.withColumn("sx", F.abs(moved - F.lag(moved).over(row))).withColumn("sy", F.abs(moved - F.lag(moved).over(column)))


def _in() -> Column:
    dx, dy = F.col("x") - F.col("bx"), F.col("y") - F.col("by")
    return (dx >= 0) & (dx < F.col("bw")) & (dy >= 0) & (dy < F.col("bh"))


def measures(px: DataFrame, regions: DataFrame, key: str = "frame", name: str = "region") -> DataFrame:
    """Shape, colour, edge, correlation, chroma and background measures of every region.

    Pixels meet the boxes of their image once, with a ring of one pixel around.  The ring holds all neighbours of the pixels inside, so slopes, steps,
    the background's mean and the grouping all lie in one dealing out by (image, region)."""
    box = [name, "bx", "by", "bw", "bh"]
    px = px.select(key, "x", "y", *[f"{c}{k}" for k in "12" for c in "rgb"], "delta", "changed")
    # boxes are cut into rows, so a pixel meets those of its own row alone
    rows = regions.select(key, *box, F.explode(F.sequence((F.col("by") - 1).cast("int"), (F.col("by") + F.col("bh")).cast("int"))).alias("y"))
    near = (F.col("x") >= F.col("bx") - 1) & (F.col("x") <= F.col("bx") + F.col("bw"))
    cells = px.join(rows, [key, "y"]).filter(near).withColumn("inside", _in()).repartition(key, name)
    cells = with_steps(with_edges(cells, key, name), key, name)
    dx, dy = F.col("x") - F.col("bx"), F.col("y") - F.col("by")
    w, h = F.col("bw"), F.col("bh")
    band = F.greatest(F.lit(1), F.least(F.lit(12), F.floor(F.least(w, h) / 4))).cast("int")
    qx, qy = F.floor(w / 4), F.floor(h / 4)
    (y1, i1, q1), (y2, i2, q2) = color.yiq(color.channels("1")), color.yiq(color.channels("2"))
    m = F.col("m")
    cells = cells.withColumns(
        {
            "m": F.col("inside") & F.col("changed"),
            "_border": (dx < band) | (dx >= w - band) | (dy < band) | (dy >= h - band),
            "_centre": (dx >= qx) & (dx < w - qx) & (dy >= qy) & (dy < h - qy),
        }
    )
    named = {"_d": F.abs("delta") / color.FULL, "_dy": y2 - y1, "_dq": F.abs(q2 - q1), "_i1": i1, "_i2": i2, "_q1": q1, "_q2": q2, "_dc": F.col("dc"), "_l1": F.col("l1"), "_l2": F.col("l2")}
    named |= {"_e1": F.col("e1").cast("int"), "_e2": F.col("e2").cast("int"), "_same": (F.col("e1") == F.col("e2")).cast("int"), "_x": F.col("x"), "_y": F.col("y")}
    named |= {"_sx": F.when(dx > 0, F.col("sx")), "_sy": F.when(dy > 0, F.col("sy"))}
    cells = cells.withColumns({n: F.when(m, c) for n, c in named.items()})
    cells = cells.withColumns({"_s1": F.sqrt(F.col("_i1") * F.col("_i1") + F.col("_q1") * F.col("_q1")), "_s2": F.sqrt(F.col("_i2") * F.col("_i2") + F.col("_q2") * F.col("_q2"))})
    backs = {f"{where}_{c}{k}": F.avg(F.when(test, F.col(f"{c}{k}"))) for where, test in (("in", F.col("inside") & ~F.col("changed")), ("ring", ~F.col("inside"))) for k in "12" for c in "rgb"}
    whole = Window.partitionBy(key, name)
    cells = cells.withColumns({f"_{c}{k}": F.coalesce(backs[f"in_{c}{k}"].over(whole), backs[f"ring_{c}{k}"].over(whole)) for k in "12" for c in "rgb"})
    off = lambda k: F.sqrt(sum(((F.col(f"{c}{k}") - F.col(f"_{c}{k}")) * (F.col(f"{c}{k}") - F.col(f"_{c}{k}")) for c in "rgb"), F.lit(0.0)))
    g = cells.groupBy(key, *box).agg(
        F.count_if("m").alias("n"),
        F.count_if(m & F.col("_border")).alias("n_border"),
        F.count_if(F.col("inside") & ~F.col("_border")).alias("inner_area"),
        F.count_if(m & F.col("_centre")).alias("n_centre"),
        F.count_if(F.col("inside") & F.col("_centre")).alias("centre_area"),
        F.size(F.collect_set("_y")).alias("rows_hit"),
        F.size(F.collect_set("_x")).alias("columns_hit"),
        F.avg("_d").alias("mean_delta"),
        F.max("_d").alias("max_delta"),
        F.stddev_pop("_d").alias("delta_stddev"),
        F.avg("_e1").alias("edges1"),
        F.avg("_e2").alias("edges2"),
        F.avg("_same").alias("edges_agree"),
        F.covar_pop("_l1", "_l2").alias("_cov"),
        F.var_pop("_l1").alias("_v1"),
        F.var_pop("_l2").alias("_v2"),
        (F.avg("_dy") / 255).alias("mean_dy"),
        (F.avg("_dq") / 255).alias("mean_dq"),
        (F.avg("_dc") / 255).alias("mean_dc"),
        F.stddev_pop("_dc").alias("_sdc"),
        F.sum(F.col("_i1") * F.col("_i2") + F.col("_q1") * F.col("_q2")).alias("_dot"),
        F.sum(F.col("_s1") * F.col("_s2")).alias("_mag"),
        (F.avg("_s1") / 255).alias("sat1"),
        (F.coalesce(F.sum("_sx"), F.lit(0.0)) + F.coalesce(F.sum("_sy"), F.lit(0.0))).alias("_rough"),
        (F.count("_sx") + F.count("_sy")).alias("_steps"),
        *[F.least(F.lit(1.0), F.coalesce(F.avg(F.when(m, off(k))) / (255 * 3**0.5), F.lit(1.0))).alias(f"ground{k}") for k in "12"],
    ).filter("n > 0")
    area = w * h
    g = g.withColumn("fill", F.col("n") / area).withColumn("border", F.when(F.col("n") > 0, F.col("n_border") / F.col("n")).otherwise(0.0))
    g = g.withColumn("inner_fill", F.when(F.col("inner_area") > 0, (F.col("n") - F.col("n_border")) / F.col("inner_area")).otherwise(F.col("fill")))
    g = g.withColumn("centre", F.when(F.col("centre_area") > 0, F.col("n_centre") / F.col("centre_area")).otherwise(F.col("fill")))
    g = g.withColumn("row_share", F.col("rows_hit") / h).withColumn("column_share", F.col("columns_hit") / w)
    flat1, flat2 = F.col("_v1") * F.col("n") <= 1e-6, F.col("_v2") * F.col("n") <= 1e-6
    ratio = F.col("_cov") / F.sqrt(F.col("_v1") * F.col("_v2"))
    g = g.withColumn("ncc", F.when((F.col("n") < 2) | (flat1 & flat2), 1.0).when(flat1 | flat2, 0.0).otherwise(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), ratio))))
    g = g.withColumn("hue_cos", F.when(F.col("_mag") > 1e-6, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("_dot") / F.col("_mag")))).otherwise(1.0))
    g = g.withColumn("rough", F.when(F.col("_steps") > 0, F.col("_rough") / F.col("_steps") / (F.col("_sdc") + 1e-6)).otherwise(0.0))

    return g.select(*[c for c in g.columns if not c.startswith("_")])


def shape() -> Column:
    """What a region's filling looks like; the limits are fixed values."""
    fill, border, inner, centre = (F.col(c) for c in ("fill", "border", "inner_fill", "centre"))
    frame = (inner < 0.20) & ((border > 0.60) | ((centre < 0.10) & (border > 0.30) & (fill < 0.50)))
    spread = (F.col("row_share") > 0.7) & (F.col("column_share") > 0.7)
    return F.when(fill > 0.65, "solid-region").when(frame, "contour-frame").when((fill < 0.30) & (border > 0.45), "edge-dominated").when((fill < 0.30) & spread, "sparse-distributed").otherwise("mixed-region")


def position(width: int, height: int) -> Column:
    cx, cy = F.col("bx") + F.col("bw") / 2, F.col("by") + F.col("bh") / 2
    third = lambda c, size, names: F.when(c < size / 3, names[0]).when(c < size / 3 * 2, names[1]).otherwise(names[2])
    down, across = third(cy, height, ("top", "", "bottom")), third(cx, width, ("left", "", "right"))
    return F.coalesce(F.nullif(F.concat_ws("-", F.nullif(down, F.lit("")), F.nullif(across, F.lit(""))), F.lit("")), F.lit("center"))


def change_type(measured: DataFrame) -> DataFrame:
    """Adds change_type and confidence by an ordered list of rules; the first that holds decides.  The limits here are fixed values,
    as are those above."""
    c = F.col
    faint, still1, still2 = c("mean_delta") < 0.05, c("edges1") < 0.05, c("edges2") < 0.05
    agree = (still1 & still2) | (c("edges_agree") > 0.85)
    blends = lambda a, b: (c(a) < BLEND) | ((c(b) > BLEND) & (c(a) < c(b) * 0.5))
    b1, b2 = blends("ground1", "ground2"), blends("ground2", "ground1")
    new, gone = c("ground2") > c("ground1") * 2, c("ground1") > c("ground2") * 2
    gain, kept = c("edges2") - c("edges1"), c("ncc") > NCC_KEPT
    sparse_noise = (c("fill") < 0.35) & faint & still1 & ~((b1 & ~b2 & new) | (b2 & ~b1 & gone))
    added = b1 & ~b2 & (new | (gain > ASYMMETRY) | ~kept)
    deleted = b2 & ~b1 & (gone | (gain < -ASYMMETRY) | ~kept)
    recolored = (c("ncc") > NCC_RECOLOR) & agree & (c("mean_delta") > RECOLOR_DELTA)
    patchy = (c("ncc") < NCC_REPLACED) & (c("delta_stddev") > c("mean_delta") * 2 + 0.1)
    color_kept = (~faint | recolored) & ~patchy & kept
    moved = (c("mean_dc") > CHROMA_MOVE) & (c("rough") < CHROMA_ROUGH)
    same_hue = (c("hue_cos") > SAME_HUE) & (c("mean_dq") <= Q_MOVE) & (c("sat1") > DRAB)
    pushed = (c("mean_dy") > LIGHTEN) | ((c("mean_dy") <= DARKEN) & (c("edges2") <= DARKEN_EDGES))
    rules = [
        ((c("bw") * c("bh") <= 25) & faint, "rendering-noise", F.lit(1.0)),
        (sparse_noise, "rendering-noise", F.lit(1.0)),
        (added, "addition", F.when(still1 & ~still2, 1.0).otherwise(0.9)),
        (deleted, "deletion", F.when(still2 & ~still1, 1.0).otherwise(0.9)),
        (color_kept, "color-change", F.least(F.lit(1.0), F.least(c("mean_delta") * 5, F.lit(1.0)) * 0.5 + F.greatest(c("ncc"), F.lit(0.0)) * 0.5)),
        (moved & ~same_hue, "color-change", F.least(c("mean_dc") * 3, F.lit(1.0)) * 0.5 + 0.25),
        (~moved & pushed, "color-change", F.lit(0.6)),
        (F.lit(True), "content-change", F.lit(0.5)),
    ]
    found = F.coalesce(*[F.when(test, F.struct(F.lit(kind).alias("kind"), sure.cast("double").alias("sure"))) for test, kind, sure in rules])
    return measured.withColumn("_found", found).withColumn("change_type", F.col("_found.kind")).withColumn("confidence", F.col("_found.sure")).drop("_found")


def padded(regions: DataFrame, width: int, height: int) -> DataFrame:
    """Boxes with a margin that grows with them, within the image."""
    for at, size, whole in (("bx", "bw", width), ("by", "bh", height)):
        pad = F.greatest(F.lit(MARGIN_LEAST), F.least(F.lit(MARGIN_MOST), F.floor(F.col(size) / MARGIN_PART))).cast("int")
        lo, hi = F.greatest(F.lit(0), F.col(at) - pad), F.least(F.lit(whole), F.col(at) + F.col(size) + pad)
        regions = regions.withColumn("_lo", lo).withColumn("_hi", hi).withColumn(at, F.col("_lo")).withColumn(size, F.col("_hi") - F.col("_lo")).drop("_lo", "_hi")
    return regions


REFINE = 100.0  # a squared metric: pixels below it are no change that a coarse mask claims


def score_map_regions(cells: DataFrame, across: int, down: int, width: int, height: int, least: float, key: str = "frame") -> DataFrame:
    """(key, label, bx, by, bw, bh) in image pixels of connected cells (key, x, y, score) of a map of across x down cells that score
    below `least`; NaN counts as below.  Cells tile the image by floor division; what scales to nothing is left out."""
    low = F.isnan("score") | F.coalesce(F.col("score") < least, F.lit(True))
    cells = cells.withColumn("changed", low).withColumn("closed", low)
    at = lambda c, size, n: F.expr(f"({c}) * {size} div {n}")
    boxes = component_boxes(cells, key).select(
        key, "label", at("bx", width, across).alias("bx"), at("by", height, down).alias("by"), at("bx + bw", width, across).alias("_x"), at("by + bh", height, down).alias("_y")
    )
    return boxes.filter("_x > bx AND _y > by").select(key, "label", "bx", "by", (F.col("_x") - F.col("bx")).alias("bw"), (F.col("_y") - F.col("by")).alias("bh"))


def within(px: DataFrame, boxes: DataFrame, key: str = "frame") -> DataFrame:
    """Pixels of boxes (key, region, bx, by, bw, bh), once for each box.  Boxes are cut into rows, so a pixel meets the boxes of its own row alone."""
    rows = boxes.select(key, F.explode(F.sequence(F.col("by").cast("int"), (F.col("by") + F.col("bh") - 1).cast("int"))).alias("y"), "region", "bx", "bw")
    return px.join(rows, [key, "y"]).filter("x >= bx AND x < bx + bw").drop("bx", "bw")


def union_pixels(px: DataFrame, boxes: DataFrame, key: str = "frame") -> DataFrame:
    """(key, pixels): changed pixels under any of an image's boxes; one under two counts once."""
    return within(px.filter("changed").select(key, "x", "y"), boxes, key).select(key, "x", "y").distinct().groupBy(key).agg(F.count("*").alias("pixels"))


def refined(px: DataFrame, boxes: DataFrame, key: str = "frame") -> DataFrame:
    """(key, x, y): of the pixels that boxes claim as changed, those whose metric reaches REFINE; a box in which none does keeps all its
    pixels if any differs.  Boxes are judged apart, whatever their order."""
    inside = within(px.select(key, "x", "y", F.abs("delta").alias("size")), boxes, key)
    inside = inside.withColumn("_most", F.max("size").over(Window.partitionBy(key, "region")))
    return inside.filter((F.col("size") >= REFINE) | ((F.col("_most") < REFINE) & (F.col("_most") > 0))).select(key, "x", "y").distinct()
