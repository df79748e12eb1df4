"""Queries of similarity over scales."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlake.operators import planes, similarity, tiles
from driftlake.plans.imaging import GRAY_SQL
from driftlake.plans.registry import query
from driftlake.sources.frames import FRAMES_SQL, SIDE, frame_pairs

TAPS = ", ".join(f"({i}, {w!r}::DOUBLE)" for i, w in enumerate(similarity.taps()))
HALF = SIDE // 2
C1, C2 = f"{similarity.C1!r}::DOUBLE", f"{similarity.C2!r}::DOUBLE"


def _reflect(v: str, n: int) -> str:
    return f"(CASE WHEN {v} < 0 THEN -({v}) WHEN {v} > {n - 1} THEN {2 * (n - 1)} - ({v}) ELSE {v} END)"


def maps_sql(name: str, src: str, n: int) -> str:
    """CTEs that end in {name}m(k, x, y, ssim, cs), of src(k, x, y, a, b) of side n."""
    return f"""
{name}h AS (SELECT p.k, p.x, p.y, sum(w * q.a) AS a, sum(w * q.b) AS b, sum(w * q.a * q.a) AS aa, sum(w * q.b * q.b) AS bb, sum(w * q.a * q.b) AS ab
  FROM {src} p CROSS JOIN tap JOIN {src} q ON q.k = p.k AND q.y = p.y AND q.x = {_reflect('p.x + i - 5', n)} GROUP BY ALL),
{name}v AS (SELECT p.k, p.x, p.y, sum(w * q.a) AS a, sum(w * q.b) AS b, sum(w * q.aa) AS aa, sum(w * q.bb) AS bb, sum(w * q.ab) AS ab
  FROM (SELECT k, x, y FROM {name}h) p CROSS JOIN tap JOIN {name}h q ON q.k = p.k AND q.x = p.x AND q.y = {_reflect('p.y + i - 5', n)} GROUP BY ALL),
{name}m AS (SELECT k, x, y, (2 * (ab - a * b) + {C2}) / (aa - a * a + bb - b * b + {C2}) AS cs, (2 * a * b + {C1}) / (a * a + b * b + {C1}) * (2 * (ab - a * b) + {C2}) / (aa - a * a + bb - b * b + {C2}) AS ssim FROM {name}v)"""


def _half(name: str, src: str, n: int, columns: str = "a b") -> str:
    """Means of the pixels (2x - 1, 2x) of either direction, where -1 is 1."""
    means = ", ".join(f"avg(q.{c}) AS {c}" for c in columns.split())
    return f"""{name} AS (SELECT o.k, o.x, o.y, {means} FROM (SELECT k, x, y FROM {src} WHERE x < {n // 2} AND y < {n // 2}) o CROSS JOIN (VALUES (-1), (0)) dx(i) CROSS JOIN (VALUES (-1), (0)) dy(j)
  JOIN {src} q ON q.k = o.k AND q.x = {_reflect('2 * o.x + i', n)} AND q.y = {_reflect('2 * o.y + j', n)} GROUP BY ALL)"""


TWO = (0.3, 0.7)  # the frames are large enough for two scales
SCALES_SQL = f"""{GRAY_SQL}, tap(i, w) AS (VALUES {TAPS}), s0 AS (SELECT frame AS k, x, y, l1 AS a, l2 AS b FROM gr), {_half('s1', 's0', SIDE)},{maps_sql('f', 's0', SIDE)},{maps_sql('c', 's1', HALF)},
mean0 AS (SELECT k, avg(cs) AS cs FROM fm GROUP BY k), mean1 AS (SELECT k, avg(ssim) AS ssim FROM cm GROUP BY k)"""


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("score", F.round("score", 6))


@query("ms_ssim", f"{SCALES_SQL} SELECT k AS frame, round(CASE WHEN cs < 0 OR ssim < 0 THEN 'nan'::DOUBLE ELSE pow(cs, {TWO[0]}) * pow(ssim, {TWO[1]}) END, 6) AS score FROM mean0 JOIN mean1 USING (k)")
def ms_ssim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(planes.ms_ssim(frame_pairs(spark, sf_dir), TWO))


@query("ms_ssim_weighted", f"{SCALES_SQL} SELECT k AS frame, round(cs * {TWO[0]} + ssim * {TWO[1]}, 6) AS score FROM mean0 JOIN mean1 USING (k)")
def ms_ssim_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(planes.ms_ssim(frame_pairs(spark, sf_dir), TWO, product=False))


@query("ssim_shrunk", f"{SCALES_SQL} SELECT k AS frame, round(avg(ssim), 6) AS score FROM cm WHERE x BETWEEN 5 AND {HALF - 6} AND y BETWEEN 5 AND {HALF - 6} GROUP BY k")
def ssim_shrunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single-scale similarity of images that are halved first, as large ones are."""
    return _rounded(planes.ssim(frame_pairs(spark, sf_dir), factor=2))


CHANNELS = [f"{c}{k}" for k in (1, 2) for c in "rgb"]
_LINEAR = ", ".join(f"CASE WHEN {c} / 255.0::DOUBLE <= 0.04045 THEN {c} / 255.0::DOUBLE / 12.92 ELSE pow(({c} / 255.0::DOUBLE + 0.055) / 1.055, 2.4) END AS {c}" for c in CHANNELS)


def _f(row: tuple[float, ...], white: float, k: int) -> str:
    t = "((" + " + ".join(f"{w}::DOUBLE * {c}{k}" for c, w in zip("rgb", row)) + f") / {white}::DOUBLE)"
    return f"CASE WHEN {t} > 216 / 24389.0::DOUBLE THEN cbrt({t}) ELSE (24389 / 27.0::DOUBLE * {t} + 16) / 116 END"


def lab_sql(name: str, src: str) -> str:
    """{name}(k, x, y, a, b): lightness and both chroma channels of src as three images, 3 k to 3 k + 2."""
    f = ", ".join(f"{_f(row, white, k)} AS {n}{k}" for k in (1, 2) for row, white, n in zip(planes.XYZ, planes.WHITE, "uvw"))
    shown = ["(116 * v{0} - 16) * 2.55", "500 * (u{0} - v{0}) + 128", "200 * (v{0} - w{0}) + 128"]
    return f"{name}f AS (SELECT k, x, y, {f} FROM {src}), {name} AS (" + " UNION ALL ".join(f"SELECT k * 3 + {i} AS k, x, y, {e.format(1)} AS a, {e.format(2)} AS b FROM {name}f" for i, e in enumerate(shown)) + ")"


def _spread(name: str, value: str) -> str:
    return f"{name} AS (SELECT k // 3 AS k, sum((m - d) * CASE WHEN k % 3 = 0 THEN 1 ELSE 0.5 END) / 2 AS v FROM (SELECT k, any_value(m) AS m, avg(abs(v - m)) AS d FROM (SELECT k, {value} AS v, avg({value}) OVER (PARTITION BY k) AS m FROM {name[0]}m) GROUP BY k) GROUP BY k // 3)"


PERCEPTUAL_SQL = f"""WITH {FRAMES_SQL}, tap(i, w) AS (VALUES {TAPS}), n0 AS (SELECT frame AS k, x, y, {_LINEAR} FROM px), {_half('n1', 'n0', SIDE, ' '.join(CHANNELS))},
{lab_sql('l0', 'n0')}, {lab_sql('l1', 'n1')},{maps_sql('f', 'l0', SIDE)},{maps_sql('c', 'l1', HALF)}, {_spread('f0', 'cs')}, {_spread('c1', 'ssim')}
SELECT k AS frame, round(CASE WHEN f0.v < 0 OR c1.v < 0 THEN 'nan'::DOUBLE ELSE pow(f0.v, {TWO[0]}) * pow(c1.v, {TWO[1]}) END, 6) AS score FROM f0 JOIN c1 USING (k)"""


@query("perceptual_ssim", PERCEPTUAL_SQL)
def perceptual_ssim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colour similarity over two scales, each map's mean less its mean absolute deviation."""
    return _rounded(planes.perceptual_ssim(frame_pairs(spark, sf_dir), planes.Perceptual(TWO, chroma_weight=0.5, deviation_weight=1.0)))


def bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frame pair as scan lines; the queries below cut them into tiles of a few pixels, so that borders matter."""
    return tiles.lines_of(frame_pairs(spark, sf_dir), SIDE, SIDE)


@query("tiled_ms_ssim", f"{SCALES_SQL} SELECT k AS frame, round(CASE WHEN cs < 0 OR ssim < 0 THEN 'nan'::DOUBLE ELSE pow(cs, {TWO[0]}) * pow(ssim, {TWO[1]}) END, 6) AS score FROM mean0 JOIN mean1 USING (k)")
def tiled_ms_ssim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(tiles.ms_ssim(bands(spark, sf_dir), TWO, size=12))


@query("tiled_scale_statistics", f"{SCALES_SQL} SELECT k AS frame, 0 AS scale, round(avg(ssim), 6) AS ssim, round(avg(cs), 6) AS structure FROM fm GROUP BY k UNION ALL SELECT k, 1, round(avg(ssim), 6), round(avg(cs), 6) FROM cm GROUP BY k")
def tiled_scale_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.scale_statistics(bands(spark, sf_dir), 2, size=10).select("frame", "scale", F.round("ssim", 6).alias("ssim"), F.round("structure", 6).alias("structure"))


@query("tiled_ssim", f"{SCALES_SQL} SELECT k AS frame, round(avg(ssim), 6) AS score FROM cm WHERE x BETWEEN 5 AND {HALF - 6} AND y BETWEEN 5 AND {HALF - 6} GROUP BY k")
def tiled_ssim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(tiles.ssim(bands(spark, sf_dir), factor=2, size=14))


@query("tiled_perceptual_ssim", PERCEPTUAL_SQL)
def tiled_perceptual_ssim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(tiles.perceptual_ssim(bands(spark, sf_dir), planes.Perceptual(TWO, chroma_weight=0.5, deviation_weight=1.0), size=16))
