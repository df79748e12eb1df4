"""Similarity over scales, on whole planes: a row holds an image pair as arrays, and NumPy works on them within tasks.

Images are the unit of work: pairs are independent rows, so tasks never exchange pixels.  A plane is a row-major array of doubles."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlake.operators.similarity import C1, C2, taps, with_gray

WINDOW = 11
WEIGHTS = (0.0448, 0.2856, 0.3001, 0.2363, 0.1333)  # fixed values: the weights of five scales
SIDE = 256  # an image of about this size or less isn't shrunk before single-scale similarity
# Linear sRGB to XYZ (D65), and the white point.
XYZ = ((0.4124564, 0.3575761, 0.1804375), (0.2126729, 0.7151522, 0.0721750), (0.0193339, 0.1191920, 0.9503041))
WHITE = (0.95047, 1.0, 1.08883)


def reflected(index: np.ndarray, n: int) -> np.ndarray:
    """Places beyond an edge fold back once about the edge pixel, which isn't repeated, and then stop at the edges."""
    return np.clip(np.where(index < 0, -index, np.where(index > n - 1, 2 * (n - 1) - index, index)), 0, n - 1)


def smoothed(plane: np.ndarray, kernel: Sequence[float]) -> np.ndarray:
    """Separable filter of the same size, with reflection."""
    h, w = plane.shape
    pad = len(kernel) // 2
    across = sum(k * plane[:, reflected(np.arange(w) + i - pad, w)] for i, k in enumerate(kernel))
    return sum(k * across[reflected(np.arange(h) + i - pad, h)] for i, k in enumerate(kernel))


def shrunk(plane: np.ndarray, factor: int) -> np.ndarray:
    """Box filter, then every factor-th pixel."""
    h, w = plane.shape
    return smoothed(plane, [1 / factor] * factor)[: h // factor * factor : factor, : w // factor * factor : factor]


def scale_maps(a: np.ndarray, b: np.ndarray, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """SSIM and its contrast-structure part at every pixel."""
    w = taps(size)
    ma, mb = smoothed(a, w), smoothed(b, w)
    va, vb, cov = smoothed(a * a, w) - ma * ma, smoothed(b * b, w) - mb * mb, smoothed(a * b, w) - ma * mb
    structure = (2 * cov + C2) / (va + vb + C2)
    return (2 * ma * mb + C1) / (ma * ma + mb * mb + C1) * structure, structure


def pooled(ssim: list[float], structure: list[float], weights: Sequence[float], product: bool = True) -> float:
    """All scales but the coarsest give contrast and structure, the coarsest gives SSIM.  A product with a negative mean is NaN."""
    terms = [*structure[:-1], ssim[-1]]
    if product:
        return float(np.prod([np.nan if t < 0 else t**w for t, w in zip(terms, weights)]))
    return float(sum(t * w for t, w in zip(terms, weights)) / sum(weights))


def too_small(width: int, height: int, scales: int, size: int = WINDOW) -> bool:
    return min(width, height) >> (scales - 1) < size


def ms_ssim_of(a: np.ndarray, b: np.ndarray, weights: Sequence[float] = WEIGHTS, product: bool = True) -> float | None:
    """None where the coarsest scale is smaller than the window."""
    if too_small(a.shape[1], a.shape[0], len(weights)):
        return None
    ssim, structure = [], []
    for scale in range(len(weights)):
        if scale:
            a, b = shrunk(a, 2), shrunk(b, 2)
        s, c = scale_maps(a, b)
        ssim.append(float(s.mean()))
        structure.append(float(c.mean()))
    return pooled(ssim, structure, weights, product)


def ssim_of(a: np.ndarray, b: np.ndarray, factor: int | None = None) -> float | None:
    """Mean SSIM where the window fits, of images shrunk to about SIDE pixels."""
    factor = max(1, int(min(a.shape) / SIDE + 0.5)) if factor is None else factor
    if factor > 1:
        a, b = shrunk(a, factor), shrunk(b, factor)
    if min(a.shape) < WINDOW:
        return None
    pad = WINDOW // 2
    return float(scale_maps(a, b)[0][pad:-pad, pad:-pad].mean())


@dataclass(frozen=True)
class Perceptual:
    weights: tuple[float, ...] = WEIGHTS
    product: bool = True
    chroma_weight: float = 0.0
    chroma_halvings: int = 0
    deviation_weight: float | None = None  # with a number, the mean less so many mean absolute deviations


def lab(rgb: list[np.ndarray]) -> list[np.ndarray]:
    """Linear light to L*a*b*, each on the scale of 0 to 255."""
    f = []
    for row, white in zip(XYZ, WHITE):
        t = sum(c * p for c, p in zip(row, rgb)) / white
        f.append(np.where(t > 216 / 24389, np.cbrt(t), (24389 / 27 * t + 16) / 116))
    return [(116 * f[1] - 16) * 2.55, 500 * (f[0] - f[1]) + 128, 200 * (f[1] - f[2]) + 128]


def perceptual_of(one: list[np.ndarray], two: list[np.ndarray], options: Perceptual = Perceptual()) -> float | None:
    """SSIM over scales of lightness and, by weight, of both chroma channels.  Planes are halved in linear light."""
    h, w = one[0].shape
    if too_small(w, h, len(options.weights)):
        return None
    linear = lambda p: np.where(p / 255 <= 0.04045, p / 255 / 12.92, ((p / 255 + 0.055) / 1.055) ** 2.4)
    a, b = [linear(p) for p in one], [linear(p) for p in two]

    def pool(m: np.ndarray) -> float:
        mean = float(m.mean())
        return mean if options.deviation_weight is None else mean - options.deviation_weight * float(np.abs(m - mean).mean())

    ssim, structure = [], []
    for scale in range(len(options.weights)):
        if scale:
            a, b = [shrunk(p, 2) for p in a], [shrunk(p, 2) for p in b]
        total = np.zeros(3)
        for index, (p, q) in enumerate(zip(lab(a), lab(b))):
            weight = options.chroma_weight if index else 1.0
            for _ in range(options.chroma_halvings if index else 0):
                if min(p.shape) > 1:
                    p, q = shrunk(p, 2), shrunk(q, 2)
            if weight and min(p.shape) >= WINDOW:  # a chroma plane may get smaller than the window, and is left out
                s, c = scale_maps(p, q)
                total += weight * np.array([pool(s), pool(c), 1])
        ssim.append(total[0] / total[2])
        structure.append(total[1] / total[2])
    return pooled(ssim, structure, options.weights, options.product)


def planes(pairs: DataFrame, columns: Sequence[str], key: str = "frame") -> DataFrame:
    """(key, width, height, one array for each column): an image pair a row, from a row a pixel."""
    cells = F.array_sort(F.collect_list(F.struct("y", "x", *columns)))
    rows = pairs.groupBy(key).agg(cells.alias("cells"), (F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))
    return rows.select(key, "width", "height", *[F.col("cells")[c].alias(c) for c in columns])


def _scores(rows: DataFrame, columns: Sequence[str], score, key: str) -> DataFrame:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            found = []
            for row in part.itertuples(index=False):
                found.append(score(*[np.asarray(getattr(row, c), float).reshape(row.height, row.width) for c in columns]))
            yield pd.DataFrame({key: part[key], "score": pd.Series(found, dtype=float)})

    return rows.mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, score double")


def ms_ssim(pairs: DataFrame, weights: Sequence[float] = WEIGHTS, product: bool = True, key: str = "frame") -> DataFrame:
    """(key, score): null for images that are too small for so many scales."""
    return _scores(planes(with_gray(pairs), ("l1", "l2"), key), ("l1", "l2"), lambda a, b: ms_ssim_of(a, b, weights, product), key)


def ssim(pairs: DataFrame, factor: int | None = None, key: str = "frame") -> DataFrame:
    """(key, score): single-scale similarity, shrinking large images first (by `factor`, or to about SIDE pixels)."""
    return _scores(planes(with_gray(pairs), ("l1", "l2"), key), ("l1", "l2"), lambda a, b: ssim_of(a, b, factor), key)


def perceptual_ssim(pairs: DataFrame, options: Perceptual = Perceptual(), key: str = "frame") -> DataFrame:
    """(key, score) of opaque colour pairs; alpha is ignored."""
    columns = [f"{c}{k}" for k in (1, 2) for c in "rgb"]
    return _scores(planes(pairs, columns, key), columns, lambda *p: perceptual_of(list(p[:3]), list(p[3:]), options), key)


def scale_statistics(pairs: DataFrame, scales: int, key: str = "frame") -> DataFrame:
    """(key, scale, ssim, structure): the means at every scale, the finest first."""
    rows = planes(with_gray(pairs), ("l1", "l2"), key)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for row in part.itertuples(index=False):
                a, b = (np.asarray(getattr(row, c), float).reshape(row.height, row.width) for c in ("l1", "l2"))
                for scale in range(scales):
                    if scale:
                        a, b = shrunk(a, 2), shrunk(b, 2)
                    if min(a.shape) < 2:
                        break
                    s, c = scale_maps(a, b)
                    out.append((getattr(row, key), scale, float(s.mean()), float(c.mean())))
            yield pd.DataFrame(out, columns=[key, "scale", "ssim", "structure"])

    return rows.mapInPandas(run, f"{key} {rows.schema[key].dataType.simpleString()}, scale int, ssim double, structure double")


# A metric by name: what it gives for pairs, and its score where two images differ in size.
METRICS = {"ssim": (ssim, 0.0), "msssim": (ms_ssim, 0.0), "perceptual": (perceptual_ssim, 0.0)}


def compare(pairs: DataFrame, method: str, mismatched: DataFrame | None = None, key: str = "frame", **options) -> DataFrame:
    """(key, method, score) by a metric's name; images of different sizes (mismatched: key) get its worst score."""
    if method not in METRICS:
        raise ValueError(f"method is one of {', '.join(sorted(METRICS))}, not {method!r}")
    run, worst = METRICS[method]
    out = run(pairs, key=key, **options).select(key, F.lit(method).alias("method"), "score")
    if mismatched is not None:
        out = out.join(mismatched.select(key), key, "left_anti").unionByName(mismatched.select(key, F.lit(method).alias("method"), F.lit(worst).alias("score")))
    return out
