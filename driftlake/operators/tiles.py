"""Images in tiles with borders, so that one image spreads over many tasks.

An image comes as bands: rows of (key, width, height, y, lines, one, two), where one and two hold `lines` scan lines from y on as RGBA bytes.  A
whole raster is one band, a table of pixels gives a band for each line.  ``cut`` deals out each band's parts of every tile that
it meets, tiles with a border wide enough for what is to be done, and puts tiles together; no task holds more than a band or a tile.
At the image's own edges a tile ends with the image, so whatever an operator does there it does as on the whole image; where a
tile was cut, the border takes what goes wrong.

Tiles begin at multiples of what the operator shrinks by, so each scale of a tile is a tile of the scale.  Results are sums over tiles.

Defined cases: a null image, or one whose bytes don't fit its size, has no tiles and no rows in results; neither has an image
without pixels; images too small for a window or a number of scales score null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlake.functions import color
from driftlake.operators import rasters
from driftlake.operators.planes import SIDE, WEIGHTS, WINDOW, Perceptual, lab, too_small
from driftlake.operators.similarity import C1, C2, GMS_C, taps
from driftlake.sources.scratch import kept

SIZE = 512  # pixels of a tile's side, rounded up to a multiple of what the operator shrinks by
Plan = Callable[[int, int], tuple[int, int]]  # of width and height: what tiles begin at multiples of, and their border
ARROW = {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}
BATCH = 4 << 20  # bytes of an Arrow batch
TILES = 1000  # tiles of an Arrow batch at most
BAND = "width int, height int, y int, lines int, one binary, two binary"
TILE = "width int, height int, x0 int, y0 int, x1 int, y1 int, left int, top int, right int, bottom int, one binary, two binary"


@dataclass
class Tile:
    """A tile's core x0 <= x < x1, y0 <= y < y1 within what it shows: left <= x < right, top <= y < bottom."""

    width: int
    height: int
    x0: int
    y0: int
    x1: int
    y1: int
    left: int
    top: int
    right: int
    bottom: int
    one: np.ndarray
    two: np.ndarray

    def core(self, factor: int = 1, margin: int = 0) -> tuple[slice, slice]:
        """Where the core lies, at a scale that is smaller by `factor`, without what is within `margin` pixels of the image's edges."""
        return (_within(self.y0, self.y1, self.top, self.height, factor, margin), _within(self.x0, self.x1, self.left, self.width, factor, margin))


def _within(lo: int, hi: int, start: int, whole: int, factor: int, margin: int) -> slice:
    n = whole // factor
    a, b = max(lo // factor, margin), min(n if hi == whole else hi // factor, n - margin)
    return slice(a - start // factor, max(a, b) - start // factor)


def lines_of(pairs: DataFrame, width: int, height: int, key: str = "frame") -> DataFrame:
    """Bands of one scan line, from a row a pixel: (key, x, y, r1..a1, r2..a2)."""
    pixel = lambda k: sum((F.col(f"{c}{k}").cast("long") * (1 << 8 * i) for i, c in enumerate("gba", 1)), F.col(f"r{k}").cast("long"))
    rows = pairs.groupBy(key, "y").agg(F.array_sort(F.collect_list(F.struct("x", pixel(1).alias("p"), pixel(2).alias("q")))).alias("c")).select(key, "y", F.col("c.p").alias("p"), F.col("c.q").alias("q"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = b.num_rows
            sides = [pa.array([v.values.to_numpy().astype("<u4").tobytes() for v in b.column(i)], pa.binary()) for i in (2, 3)]
            fixed = [pa.array([v] * n, pa.int32()) for v in (width, height)]
            yield pa.RecordBatch.from_arrays([b.column(0), *fixed, b.column(1).cast(pa.int32()), pa.array([1] * n, pa.int32()), *sides], names=[key, "width", "height", "y", "lines", "one", "two"])

    return rows.mapInArrow(run, f"{_kind(pairs, key)}, {BAND}")


def whole(pairs: DataFrame, key: str = "frame") -> DataFrame:
    """Rasters (key, width, height, one, two) as bands."""
    return pairs.select(key, F.col("width").cast("int"), F.col("height").cast("int"), F.lit(0).alias("y"), F.col("height").cast("int").alias("lines"), "one", "two")


def _kind(df: DataFrame, key: str) -> str:
    return f"`{key}` {df.schema[key].dataType.simpleString()}"


def _up(n: int, multiple: int) -> int:
    return -(-n // multiple) * multiple


def cut(bands: DataFrame, plan: Plan, size: int = SIZE, key: str = "frame") -> DataFrame:
    """(key, and what Tile holds) of all images, spread over tasks."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [key, "width", "height", "tx", "ty", "y", "one", "two"]
        kinds = [pa.int32()] * 5 + [pa.binary()] * 2
        for b in batches:
            held: list[tuple] = []
            large = 0

            def one_batch() -> pa.RecordBatch:
                of, *columns = zip(*held)
                return pa.RecordBatch.from_arrays([b.column(0).take(pa.array(of)), *[pa.array(c, k) for c, k in zip(columns, kinds)]], names=names)

            for i in range(b.num_rows):
                w, h, y, n, one, two = (b.column(c)[i] for c in range(1, 7))
                if not (one.is_valid and two.is_valid):
                    continue
                w, h, y, n = (v.as_py() for v in (w, h, y, n))
                buffers = one.as_buffer(), two.as_buffer()
                if not w or not h or any(v.size != 4 * w * n for v in buffers):
                    continue
                multiple, border = plan(w, h)
                step, border = _up(size, multiple), _up(border, multiple)
                sides = [np.frombuffer(v, "<u4").reshape(n, w) for v in buffers]
                for ty in range(max(0, (y - border) // step), min(h - 1, y + n - 1 + border) // step + 1):
                    top, bottom = max(y, ty * step - border), min(y + n, (ty + 1) * step + border)
                    if top >= bottom:
                        continue
                    for tx in range(-(-w // step)):
                        left, right = max(0, tx * step - border), min(w, (tx + 1) * step + border)
                        held.append((i, w, h, tx, ty, top, *[v[top - y : bottom - y, left:right].tobytes() for v in sides]))
                        large += 8 * (bottom - top) * (right - left)
                        if large > BATCH:
                            yield one_batch()
                            held, large = [], 0
            if held:
                yield one_batch()

    fields = ["width", "height", "x0", "y0", "x1", "y1", "left", "top", "right", "bottom"]

    def made(of: tuple, names: pa.Array, sides: list[list[bytes]]) -> tuple[pa.Array, list[int], list[bytes]]:
        w, h, tx, ty = of
        multiple, border = plan(w, h)
        step, border = _up(size, multiple), _up(border, multiple)
        edges = [tx * step, ty * step, min(w, (tx + 1) * step), min(h, (ty + 1) * step)]
        seen = [max(0, tx * step - border), max(0, ty * step - border), min(w, (tx + 1) * step + border), min(h, (ty + 1) * step + border)]
        both = [b"".join(v) for v in sides]
        if len(both[0]) != 4 * (seen[2] - seen[0]) * (seen[3] - seen[1]):
            raise ValueError(f"the bands of {key} {names[0].as_py()} don't make up its {h} lines")
        return names, [w, h, *edges, *seen], both

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pieces come in the order of tiles and lines: a tile's are held until the next one begins."""
        done: list[tuple] = []
        large, of, names, sides, last = 0, None, None, [[], []], None

        def one_batch() -> pa.RecordBatch:
            numbers = zip(*[n for _, n, _ in done])
            return pa.RecordBatch.from_arrays([pa.concat_arrays([k for k, _, _ in done]), *[pa.array(n, pa.int32()) for n in numbers], *[pa.array([v[i] for _, _, v in done], pa.binary()) for i in (0, 1)]], names=[key, *fields, "one", "two"])

        for b in batches:
            if not b.num_rows:
                continue
            keys, (ws, hs, txs, tys) = b.column(0).to_pylist(), (b.column(i).to_pylist() for i in range(1, 5))
            for i, at in enumerate(zip(keys, txs, tys)):
                if at != last or of is None:
                    if of is not None:
                        done.append(made(of, names, sides))
                        large += sum(map(len, done[-1][2]))
                        if large > BATCH or len(done) >= TILES:
                            yield one_batch()
                            done, large = [], 0
                    last, of, names, sides = at, (ws[i], hs[i], txs[i], tys[i]), b.column(0).slice(i, 1).take(pa.array([0])), [[], []]
                for held, c in zip(sides, (6, 7)):
                    held.append(b.column(c)[i].as_py())
        if of is not None:
            done.append(made(of, names, sides))
            yield one_batch()

    kind = _kind(bands, key)
    pieces = bands.select(key, "width", "height", "y", "lines", "one", "two").mapInArrow(parts, f"{kind}, width int, height int, tx int, ty int, y int, one binary, two binary")
    return pieces.repartition(key, "tx", "ty").sortWithinPartitions(key, "tx", "ty", "y").mapInArrow(put, f"{kind}, {TILE}")


def measured(tiles: DataFrame, measure: Callable[..., list[tuple]], fields: str, key: str = "frame") -> DataFrame:
    """(key, fields): the rows that measure() gives for each tile, and for the values of columns beyond a tile's, if there are some."""
    names, kinds = zip(*[f.split() for f in fields.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, TILES):
                some, owner, found = b.slice(at, TILES), [], []
                for i in range(some.num_rows):
                    numbers = [some.column(c)[i].as_py() for c in range(1, 11)]
                    left, top, right, bottom = numbers[6:]
                    sides = [np.frombuffer(some.column(c)[i].as_buffer(), "<u4").reshape(bottom - top, right - left) for c in (11, 12)]
                    rows = measure(Tile(*numbers, *sides), *[some.column(c)[i].as_py() for c in range(13, some.num_columns)])
                    owner += [i] * len(rows)
                    found += rows
                if found:
                    yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(owner)), *[pa.array(c, ARROW[k]) for c, k in zip(zip(*found), kinds)]], names=[key, *names])

    return tiles.mapInArrow(run, f"{_kind(tiles, key)}, {fields}")


# What differs.


def compare(bands: DataFrame, threshold: float = 0.1, include_aa: bool = False, size: int = SIZE, key: str = "frame") -> DataFrame:
    """(key, pixels, diff_count, aa_count, identical): as rasters.compare has it, with images of any size."""

    def count(t: Tile) -> list[tuple]:
        (down, across), w = t.core(), t.right - t.left
        area = (t.x1 - t.x0) * (t.y1 - t.y0)
        if np.array_equal(t.one, t.two):
            return [(area, 0, 0, True)]

        def spot(places: np.ndarray) -> np.ndarray:
            y, x = np.divmod(places, w)
            return (y + t.top) * t.width + x + t.left

        within = np.zeros(t.one.shape, bool)
        within[down, across] = True
        places, soft = rasters.difference(t.one.ravel(), t.two.ravel(), w, t.bottom - t.top, threshold, include_aa, spot, within.ravel())
        n = int(soft.sum())
        return [(area, len(places) - n, n, bool(np.array_equal(t.one[down, across], t.two[down, across])))]

    found = measured(cut(bands, lambda w, h: (1, 3), size, key), count, "pixels long, diff_count long, aa_count long, identical boolean", key)
    return found.groupBy(key).agg(F.sum("pixels").alias("pixels"), F.sum("diff_count").alias("diff_count"), F.sum("aa_count").alias("aa_count"), F.bool_and("identical").alias("identical"))


# Similarity.


def gray(p: np.ndarray) -> np.ndarray:
    """Luma in single precision, as with_gray has it."""
    r, g, b = ((p >> np.uint32(8 * i) & np.uint32(255)).astype(np.float64) for i in range(3))
    return (r * color.GRAY[0] + g * color.GRAY[1] + b * color.GRAY[2]).astype(np.float32).astype(np.float64)


def _folded(plane: np.ndarray, before: int, after: int, axis: int) -> np.ndarray:
    """The plane with pixels beyond its edges, folded back about the edge pixel and then stopped there."""
    n = plane.shape[axis]
    at = np.arange(-before, n + after)
    return np.take(plane, np.clip(np.where(at < 0, -at, np.where(at > n - 1, 2 * (n - 1) - at, at)), 0, n - 1), axis)


def smoothed(plane: np.ndarray, kernel: Sequence[float]) -> np.ndarray:
    """Separable filter of the same size, with reflection: sums of shifted views of a plane that is padded once."""
    pad = len(kernel) // 2
    for axis in (1, 0):
        n, wide = plane.shape[axis], _folded(plane, pad, len(kernel) - 1 - pad, axis)
        view = (lambda i: wide[:, i : i + n]) if axis else (lambda i: wide[i : i + n])
        total, part = view(0) * kernel[0], np.empty_like(plane)
        for i in range(1, len(kernel)):
            np.multiply(view(i), kernel[i], out=part)
            total += part
        plane = total
    return plane


def shrunk(plane: np.ndarray, factor: int) -> np.ndarray:
    h, w = plane.shape
    if factor == 2:  # means of pixels 2x - 1 and 2x, where -1 is 1
        down = _folded(plane[: h // 2 * 2], 1, 0, 0)
        half = (down[0:-1:2] + down[1::2]) * 0.5
        across = _folded(half[:, : w // 2 * 2], 1, 0, 1)
        return (across[:, 0:-1:2] + across[:, 1::2]) * 0.5
    return smoothed(plane, [1 / factor] * factor)[: h // factor * factor : factor, : w // factor * factor : factor]


def maps(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """SSIM and its contrast-structure part at every pixel."""
    w = taps(WINDOW)
    ma, mb = smoothed(a, w), smoothed(b, w)
    squares, both, product = ma * ma, smoothed(a * a + b * b, w), ma * mb
    squares += mb * mb
    structure = (2 * (smoothed(a * b, w) - product) + C2) / (both - squares + C2)
    return (2 * product + C1) / (squares + C1) * structure, structure


def _scales_plan(scales: int, halvings: int = 0) -> Plan:
    top = 1 << (scales - 1 + halvings)
    return lambda w, h: (top, (WINDOW // 2 + 2) * top)


def scale_statistics(bands: DataFrame, scales: int, size: int = SIZE, key: str = "frame") -> DataFrame:
    """(key, scale, ssim, structure): the means at every scale, the finest first; scales of less than two pixels a side are left out."""

    def sums(t: Tile) -> list[tuple]:
        a, b, out = gray(t.one), gray(t.two), []
        for scale in range(scales):
            if min(t.width, t.height) >> scale < 2:
                break
            if scale:
                a, b = shrunk(a, 2), shrunk(b, 2)
            core = t.core(1 << scale)
            s, c = (m[core] for m in maps(a, b))
            out.append((scale, s.size, float(s.sum()), float(c.sum())))
        return out

    found = measured(cut(bands, _scales_plan(scales), size, key), sums, "scale int, n long, ssim double, structure double", key)
    mean = lambda c: (F.sum(c) / F.sum("n")).alias(c)
    return found.groupBy(key, "scale").agg(mean("ssim"), mean("structure"))


def _pooled(stats: DataFrame, images: DataFrame, weights: Sequence[float], product: bool, key: str) -> DataFrame:
    """(key, score) of means by scale: contrast and structure of all scales but the coarsest, of which SSIM counts."""
    last = len(weights) - 1
    terms = [F.max(F.when(F.col("scale") == i, F.col("ssim" if i == last else "structure"))) for i in range(len(weights))]
    if product:
        score = F.lit(1.0)
        for t, w in zip(terms, weights):
            score = score * F.when(t < 0, float("nan")).otherwise(F.pow(t, F.lit(w)))
    else:
        score = sum((t * w for t, w in zip(terms, weights)), F.lit(0.0)) / sum(weights)
    short = F.shiftright(F.least("width", "height"), last) < WINDOW
    return images.join(stats.groupBy(key).agg(score.alias("score")), key, "left").select(key, F.when(~short, F.col("score")).alias("score"))


def _images(bands: DataFrame, key: str) -> DataFrame:
    return bands.filter("one IS NOT NULL AND two IS NOT NULL").groupBy(key).agg(F.first("width").alias("width"), F.first("height").alias("height"))


def ms_ssim(bands: DataFrame, weights: Sequence[float] = WEIGHTS, product: bool = True, size: int = SIZE, key: str = "frame") -> DataFrame:
    """(key, score): similarity over scales; null for images that are too small for so many."""
    return _pooled(scale_statistics(bands, len(weights), size, key), _images(bands, key), weights, product, key)


def shrink_factor(width: int, height: int) -> int:
    return max(1, int(min(width, height) / SIDE + 0.5))


def ssim(bands: DataFrame, factor: int | None = None, size: int = SIZE, key: str = "frame") -> DataFrame:
    """(key, score): single-scale similarity where the window fits, of images that are first shrunk by `factor`, or to about SIDE pixels."""
    by = lambda w, h: shrink_factor(w, h) if factor is None else factor

    def total(t: Tile) -> list[tuple]:
        f = by(t.width, t.height)
        if min(t.width, t.height) // f < WINDOW:
            return [(0, 0.0)]
        a, b = gray(t.one), gray(t.two)
        if f > 1:
            a, b = shrunk(a, f), shrunk(b, f)
        s = maps(a, b)[0][t.core(f, WINDOW // 2)]
        return [(s.size, float(s.sum()))]

    found = measured(cut(bands, lambda w, h: (by(w, h), (WINDOW // 2 + 1) * by(w, h)), size, key), total, "n long, ssim double", key)
    return found.groupBy(key).agg(F.try_divide(F.sum("ssim"), F.sum("n")).alias("score"))


def gradient(plane: np.ndarray) -> np.ndarray:
    """Prewitt magnitude of the interior."""
    rows, columns = plane[:-2] + plane[1:-1] + plane[2:], plane[:, :-2] + plane[:, 1:-1] + plane[:, 2:]
    gx, gy = (rows[:, :-2] - rows[:, 2:]) / 3, (columns[:-2] - columns[2:]) / 3
    return np.sqrt(gx * gx + gy * gy)


def _combined(n: str, mean: str, m2: str):
    """Population variance of parts' counts, means and squared deviations."""
    total = F.sum(n)
    return (F.sum(m2) + F.sum(F.col(n) * F.col(mean) * F.col(mean)) - F.pow(F.sum(F.col(n) * F.col(mean)), F.lit(2.0)) / total) / total


def gmsd(bands: DataFrame, c: float = GMS_C, halve: bool = False, size: int = SIZE, key: str = "frame") -> DataFrame:
    """(key, gmsd): deviation of gradient similarity in the interior, of images that are halved first if asked; null without an interior."""
    f = 2 if halve else 1

    def spread(t: Tile) -> list[tuple]:
        a, b = gray(t.one), gray(t.two)
        if halve:
            h, w = a.shape
            a, b = (p[: h // 2 * 2, : w // 2 * 2].reshape(h // 2, 2, w // 2, 2).mean((1, 3)) for p in (a, b))
        down, across = t.core(f, 1)
        if down.stop <= down.start or across.stop <= across.start:
            return []
        wide = slice(down.start - 1, down.stop + 1), slice(across.start - 1, across.stop + 1)
        g1, g2 = gradient(a[wide]), gradient(b[wide])
        s = (2 * g1 * g2 + c) / (g1 * g1 + g2 * g2 + c)
        return [(s.size, float(s.mean() - 1), float(((s - s.mean()) ** 2).sum()))]

    found = measured(cut(bands, lambda w, h: (f, 2 * f), size, key), spread, "n long, mean double, m2 double", key)
    out = found.groupBy(key).agg(F.sqrt(F.greatest(F.lit(0.0), _combined("n", "mean", "m2"))).alias("gmsd"))
    return _images(bands, key).select(key).join(out, key, "left")


def perceptual_ssim(bands: DataFrame, options: Perceptual = Perceptual(), size: int = SIZE, key: str = "frame") -> DataFrame:
    """(key, score) of opaque colour pairs: SSIM over scales of lightness and, by weight, of both chroma channels.  With a weight of
    deviation the maps are made a second time, when their means are known."""
    scales = len(options.weights)

    def each(t: Tile, known: list[dict] | None = None) -> list[tuple]:
        means = {(m["scale"], m["channel"]): (m["ssim"], m["structure"]) for m in known or ()}
        if too_small(t.width, t.height, scales):
            return []
        linear = np.array([v / 255 / 12.92 if v / 255 <= 0.04045 else ((v / 255 + 0.055) / 1.055) ** 2.4 for v in range(256)])
        a, b = ([linear[p >> np.uint32(8 * i) & np.uint32(255)] for i in range(3)] for p in (t.one, t.two))
        out = []
        for scale in range(scales):
            if scale:
                a, b = [shrunk(p, 2) for p in a], [shrunk(p, 2) for p in b]
            for channel, (p, q) in enumerate(zip(lab(a), lab(b))):
                by, side = scale, min(t.width, t.height) >> scale
                for _ in range(options.chroma_halvings if channel else 0):
                    if side > 1:
                        p, q, by, side = shrunk(p, 2), shrunk(q, 2), by + 1, side >> 1
                if (channel and not options.chroma_weight) or side < WINDOW:
                    continue
                s, c = (m[t.core(1 << by)] for m in maps(p, q))
                if means:
                    ms, mc = means[scale, channel]
                    s, c = np.abs(s - ms), np.abs(c - mc)
                out.append((scale, channel, s.size, float(s.sum()), float(c.sum())))
        return out

    fields = "scale int, channel int, n long, ssim double, structure double"
    tiles = cut(bands, _scales_plan(scales, options.chroma_halvings), size, key)
    if options.deviation_weight is not None:
        tiles = kept(tiles)  # measured twice, cut once
    mean = lambda c: (F.sum(c) / F.sum("n")).alias(c)
    per = measured(tiles, each, fields, key).groupBy(key, "scale", "channel").agg(mean("ssim"), mean("structure"))
    if options.deviation_weight is not None:
        known = per.groupBy(key).agg(F.collect_list(F.struct("scale", "channel", "ssim", "structure")).alias("means"))  # three for each scale at most
        deviations = measured(tiles.join(known, key), each, fields, key).groupBy(key, "scale", "channel").agg(mean("ssim").alias("ds"), mean("structure").alias("dc"))
        w = options.deviation_weight
        per = per.join(deviations, [key, "scale", "channel"]).select(key, "scale", "channel", (F.col("ssim") - w * F.col("ds")).alias("ssim"), (F.col("structure") - w * F.col("dc")).alias("structure"))
    weight = F.when(F.col("channel") == 0, 1.0).otherwise(options.chroma_weight)
    over = lambda c: (F.sum(F.col(c) * weight) / F.sum(weight)).alias(c)
    return _pooled(per.groupBy(key, "scale").agg(over("ssim"), over("structure")), _images(bands, key), options.weights, options.product, key)
