"""Regions of change in images that lie in tiles: components are labelled in each tile, and joined where tiles touch.

A tile is cut with a border that covers what closing the mask reaches, so that two neighbours agree on the pixels along their common edge.
Each gives its own components, and the labels along its edges: the pixels beyond the right and lower edge that it continues into, and
its own along the left and upper edge.  Where both name the same pixel, two labels are one component; these pairs are the edges of a
graph, whose size goes with the tiles' edges and not with their area.

Defined cases: those of ``tiles``; an image without changed pixels has no regions; a closed component without a changed pixel isn't one.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlake.operators import rasters, regions
from driftlake.operators.graphs import roots
from driftlake.operators.tiles import SIZE, Tile, cut, measured
from driftlake.sources.scratch import kept

FIELDS = "kind string, label long, x int, y int, x1 int, y1 int, pixels long"


def slid(mask: np.ndarray, reach: int, axis: int, every: bool) -> np.ndarray:
    """Is any (or every) pixel within `reach` along the axis set?  What lies beyond the edge doesn't count."""
    n = mask.shape[axis]
    sums = np.concatenate((np.zeros_like(mask.take([0], axis), np.int32), mask.cumsum(axis, dtype=np.int32)), axis)
    at = np.arange(n)
    lo, hi = np.maximum(at - reach, 0), np.minimum(at + reach + 1, n)
    found = sums.take(hi, axis) - sums.take(lo, axis)
    return found == np.expand_dims(hi - lo, 1 - axis) if every else found > 0


def closed(mask: np.ndarray, reach: int) -> np.ndarray:
    """Dilated and eroded by a square."""
    for axis, every in ((1, False), (0, False), (0, True), (1, True)):
        mask = slid(mask, reach, axis, every)
    return mask


def changed(t: Tile, threshold: float, include_aa: bool) -> np.ndarray:
    w = t.right - t.left

    def spot(places: np.ndarray) -> np.ndarray:
        y, x = np.divmod(places, w)
        return (y + t.top) * t.width + x + t.left

    places, soft = rasters.difference(t.one.ravel(), t.two.ravel(), w, t.bottom - t.top, threshold, include_aa, spot)
    mask = np.zeros(t.one.shape, bool)
    mask.ravel()[places[~soft]] = True
    return mask


def _parts(t: Tile, mask: np.ndarray, close: np.ndarray) -> list[tuple]:
    """A tile's components with the extent of their changed pixels, and the labels along its edges."""
    down, across = t.core()
    inner = close[down, across]
    if not inner.any():
        return []
    local = regions.connected(inner)
    top, left = np.divmod(local, inner.shape[1])
    label = np.where(inner, (top + t.y0).astype(np.int64) << 32 | (left + t.x0), -1)
    out: list[tuple] = []
    y, x = np.nonzero(mask[down, across] & inner)
    names, at = np.unique(label[y, x], return_inverse=True)
    lo, hi = np.full((2, len(names)), 1 << 30), np.full((2, len(names)), -1)
    for k, v in enumerate((x + t.x0, y + t.y0)):
        np.minimum.at(lo[k], at, v)
        np.maximum.at(hi[k], at, v)
    out += [("part", *row) for row in zip(names.tolist(), *lo.tolist(), *hi.tolist(), np.bincount(at, minlength=len(names)).tolist())]
    bare = np.setdiff1d(np.unique(label[inner]), names)  # they may join components that have changed pixels
    out += [("part", name, None, None, None, None, 0) for name in bare.tolist()]

    def edge(kind: str, cells: np.ndarray, beyond: np.ndarray, dx: int, dy: int, xs: np.ndarray, ys: np.ndarray) -> None:
        hit = np.flatnonzero((cells >= 0) & beyond)
        out.extend((kind, int(cells[i]), int(xs[i]) + dx, int(ys[i]) + dy, None, None, None) for i in hit.tolist())

    h, w = inner.shape
    rows, columns = np.arange(t.y0, t.y1), np.arange(t.x0, t.x1)
    if t.x1 < t.width:
        edge("asks", label[:, -1], close[down, across.stop], 1, 0, np.full(h, t.x1 - 1), rows)
    if t.y1 < t.height:
        edge("asks", label[-1], close[down.stop, across], 0, 1, columns, np.full(w, t.y1 - 1))
    if t.x0:
        edge("has", label[:, 0], close[down, across.start - 1], 0, 0, np.full(h, t.x0), rows)
    if t.y0:
        edge("has", label[0], close[down.start - 1, across], 0, 0, columns, np.full(w, t.y0))
    return out


def component_boxes(bands: DataFrame, threshold: float = 0.1, include_aa: bool = True, size: int = SIZE, key: str = "frame") -> DataFrame:
    """(key, label, bx, by, bw, bh, pixels): as regions.component_boxes has it, of images in any number of tiles."""

    def look(t: Tile) -> list[tuple]:
        if np.array_equal(t.one, t.two):
            return []
        mask = changed(t, threshold, include_aa)
        return _parts(t, mask, closed(mask, regions.radius(t.width, t.height)))

    border = lambda w, h: (1, 2 * regions.radius(w, h) + 4)  # noqa: E731  the mask's closing, and what anti-aliasing looks at
    found = kept(measured(cut(bands, border, size, key), look, FIELDS, key))
    asks, has = (found.filter(F.col("kind") == k).select(key, "x", "y", F.col("label").alias(n)) for k, n in (("asks", "u"), ("has", "v")))
    same = roots(asks.join(has, [key, "x", "y"]).select(key, "u", "v"), [key])
    parts = found.filter("kind = 'part'").join(same.withColumnRenamed("u", "label"), [key, "label"], "left")
    whole = parts.groupBy(key, F.coalesce("root", "label").alias("label")).agg(F.min("x").alias("bx"), F.min("y").alias("by"), F.max("x1").alias("_x"), F.max("y1").alias("_y"), F.sum("pixels").alias("pixels"))
    return whole.filter("pixels > 0").select(key, "label", "bx", "by", (F.col("_x") - F.col("bx") + 1).alias("bw"), (F.col("_y") - F.col("by") + 1).alias("bh"), "pixels")
