"""Pixel differences of whole rasters: a row holds an image pair as RGBA bytes, and NumPy looks at what differs within tasks.

A pair is read once, without a shuffle, and only pixels that differ are measured; of these, only those beyond the threshold are
looked at for anti-aliasing.  The rules are those of ``pixeldiff``, which holds a row a pixel.  An Arrow batch holds
spark.sql.execution.arrow.maxRecordsPerBatch pairs: set it to a few for large rasters.

Defined cases: a missing image, or sizes that don't fit width and height, give a null count and the reason; equal bytes are
identical without any arithmetic; an image without pixels has no difference."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlake.functions.color import PHI, PHI2, WEIGHTS, I, Q, Y, max_delta

STEP = 1 << 18  # pixels that are measured at a time
AROUND = [(dx, dy) for dx in (-1, 0, 1) for dy in (-1, 0, 1) if dx or dy]  # in scan order


def _channels(p: np.ndarray) -> list[np.ndarray]:
    return [(p >> np.uint32(8 * i) & np.uint32(255)).astype(np.float64) for i in range(4)]


def _differences(p: np.ndarray, q: np.ndarray, place: np.ndarray) -> list[np.ndarray]:
    """Of red, green and blue; over the checkerboard where either pixel is transparent."""
    one, two = _channels(p), _channels(q)
    plain = [a - b for a, b in zip(one[:3], two[:3])]
    clear = np.flatnonzero((one[3] < 255) | (two[3] < 255))
    if len(clear):
        at = place[clear] * 4
        backs = [48.0, 48 + 159 * (np.floor(at / PHI) % 2), 48 + 159 * (np.floor(at / PHI2) % 2)]
        a1, a2 = one[3][clear], two[3][clear]
        for d, a, b, back in zip(plain, one, two, backs):
            d[clear] = (a[clear] * a1 - b[clear] * a2 - back * (a1 - a2)) / 255
    return plain


def _dot(d: list[np.ndarray], w: tuple[float, float, float]) -> np.ndarray:
    return d[0] * w[0] + d[1] * w[1] + d[2] * w[2]


def same_place(places: np.ndarray) -> np.ndarray:
    return places


def beyond(one: np.ndarray, two: np.ndarray, threshold: float, spot: Callable = same_place) -> np.ndarray:
    """Flat places of pixels whose metric exceeds the threshold.  spot() turns a place of these arrays into one of the whole image, on which the
    checkerboard depends."""
    limit, found = max_delta(threshold), []
    places = np.flatnonzero(one != two)
    for i in range(0, len(places), STEP):
        at = places[i : i + STEP]
        d = _differences(one[at], two[at], spot(at))
        y, p, q = _dot(d, Y), _dot(d, I), _dot(d, Q)
        found.append(at[WEIGHTS[0] * y * y + WEIGHTS[1] * p * p + WEIGHTS[2] * q * q > limit])
    return np.concatenate(found) if found else places


def _many(flat: np.ndarray, x: np.ndarray, y: np.ndarray, width: int, height: int) -> np.ndarray:
    """Do more than two neighbours (the edge counts as one) equal the pixel?"""
    here = flat[y * width + x]
    equal = ((x == 0) | (x == width - 1) | (y == 0) | (y == height - 1)).astype(np.int64)
    for dx, dy in AROUND:
        nx, ny = x + dx, y + dy
        inside = (nx >= 0) & (nx < width) & (ny >= 0) & (ny < height)
        equal += inside & (flat[np.where(inside, ny * width + nx, 0)] == here)
    return equal > 2


def _soft(flat: np.ndarray, both: tuple[np.ndarray, np.ndarray], places: np.ndarray, width: int, height: int, spot: Callable = same_place) -> np.ndarray:
    """Which of the pixels look anti-aliased in this image: between a darker and a brighter neighbour, of which one has many siblings in
    both images."""
    y, x = np.divmod(places, width)
    zeroes = ((x == 0) | (x == width - 1) | (y == 0) | (y == height - 1)).astype(np.int64)
    low, high = np.zeros(len(places)), np.zeros(len(places))
    low_at, high_at = np.full(len(places), -1), np.full(len(places), -1)
    here, spots = flat[places], spot(places)
    for dx, dy in AROUND:
        nx, ny = x + dx, y + dy
        inside = (nx >= 0) & (nx < width) & (ny >= 0) & (ny < height)
        to = np.where(inside, ny * width + nx, 0)
        d = _dot(_differences(here, flat[to], spots), Y)
        zeroes += inside & (d == 0)
        down, up = inside & (d < low), inside & (d > high)
        low, low_at = np.where(down, d, low), np.where(down, to, low_at)
        high, high_at = np.where(up, d, high), np.where(up, to, high_at)
    out = np.zeros(len(places), bool)
    open_ = np.flatnonzero((zeroes <= 2) & (low_at >= 0) & (high_at >= 0))
    for ends in (low_at, high_at):
        ny, nx = np.divmod(ends[open_], width)
        out[open_] |= _many(both[0], nx, ny, width, height) & _many(both[1], nx, ny, width, height)
    return out


def difference(one: np.ndarray, two: np.ndarray, width: int, height: int, threshold: float = 0.1, include_aa: bool = False, spot: Callable = same_place, within: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Flat places beyond the threshold, and which of them are put down to anti-aliasing; of those places alone that are true in `within`."""
    places = beyond(one, two, threshold, spot)
    if within is not None:
        places = places[within[places]]
    soft = np.zeros(len(places), bool)
    if not include_aa:
        for i in range(0, len(places), STEP):
            part = places[i : i + STEP]
            soft[i : i + STEP] = _soft(one, (one, two), part, width, height, spot) | _soft(two, (one, two), part, width, height, spot)
    return places, soft


def compare(rasters: DataFrame, threshold: float = 0.1, include_aa: bool = False, key: str = "frame") -> DataFrame:
    """(key, pixels, diff_count, aa_count, identical, reason) of rasters (key, width, height, one, two)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for w, h, x, y in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3), b.column(4)):
                raw = [v.as_buffer() for v in (x, y)] if x.is_valid and y.is_valid else []
                reason = "missing image" if not raw else "image sizes do not match" if raw[0].size != raw[1].size or raw[0].size != w * h * 4 else None
                if reason:
                    rows.append((None, None, None, False, reason))
                    continue
                if raw[0].equals(raw[1]):
                    rows.append((w * h, 0, 0, True, None))
                    continue
                one, two = (np.frombuffer(v, "<u4") for v in raw)
                places, soft = difference(one, two, w, h, threshold, include_aa)
                n = int(soft.sum())
                rows.append((w * h, len(places) - n, n, False, None))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string()]
            cols = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=[key, "pixels", "diff_count", "aa_count", "identical", "reason"])

    kind = rasters.schema[key].dataType.simpleString()
    return rasters.select(key, F.col("width").cast("int"), F.col("height").cast("int"), "one", "two").mapInArrow(run, f"{key} {kind}, pixels long, diff_count long, aa_count long, identical boolean, reason string")


def packed(pairs: DataFrame, key: str = "frame") -> DataFrame:
    """Rasters (key, width, height, one, two) of a row a pixel: (key, x, y, r1..a1, r2..a2)."""
    pixel = lambda k: sum((F.col(f"{c}{k}").cast("long") * (1 << 8 * i) for i, c in enumerate("gba", 1)), F.col(f"r{k}").cast("long"))
    cells = F.array_sort(F.collect_list(F.struct("y", "x", pixel(1).alias("p"), pixel(2).alias("q"))))
    rows = pairs.groupBy(key).agg(cells.alias("c"), (F.max("x") + 1).cast("int").alias("width"), (F.max("y") + 1).cast("int").alias("height")).select(key, "width", "height", F.col("c.p").alias("p"), F.col("c.q").alias("q"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sides = [pa.array([v.values.to_numpy().astype("<u4").tobytes() for v in b.column(i)], pa.binary()) for i in (3, 4)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *sides], names=[key, "width", "height", "one", "two"])

    return rows.mapInArrow(run, f"{key} {pairs.schema[key].dataType.simpleString()}, width int, height int, one binary, two binary")
