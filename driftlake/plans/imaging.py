"""Queries over derived image pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlake.functions import color
from driftlake.operators import pixeldiff, rasters, similarity, tiles
from driftlake.plans.registry import query
from driftlake.sources.frames import FRAMES_SQL, SIDE, frame_pairs, frames, edited, pair

BACKS = "48 + 159 * (CAST(floor(off / 1.618033988749895) AS BIGINT) % 2)", "48 + 159 * (CAST(floor(off / 2.618033988749895) AS BIGINT) % 2)"


def deltas_sql(r1: str = "r1", g1: str = "g1", b1: str = "b1", a1: str = "a1", r2: str = "r2", g2: str = "g2", b2: str = "b2", a2: str = "a2") -> tuple[str, str, str]:
    out = []
    for p, q, back in ((r1, r2, "48"), (g1, g2, BACKS[0]), (b1, b2, BACKS[1])):
        out.append(f"CASE WHEN {a1} >= 255 AND {a2} >= 255 THEN CAST({p} - {q} AS DOUBLE) ELSE ({p} * {a1} - {q} * {a2} - ({back}) * ({a1} - {a2})) / 255.0::DOUBLE END")
    return out[0], out[1], out[2]


def dot_sql(v: tuple[str, str, str], w: tuple[float, float, float]) -> str:
    return " + ".join(f"({x}) * ({c}::DOUBLE)" for x, c in zip(v, w))


DR, DG, DB = deltas_sql()
DELTA_SQL = f"""WITH {FRAMES_SQL},
o AS (SELECT *, (y * {SIDE} + x) * 4 AS off FROM px),
c AS (SELECT *, {DR} AS dr, {DG} AS dg, {DB} AS db FROM o),
q AS (SELECT *, {dot_sql(('dr', 'dg', 'db'), color.Y)} AS dy, {dot_sql(('dr', 'dg', 'db'), color.I)} AS di, {dot_sql(('dr', 'dg', 'db'), color.Q)} AS dq FROM c),
d AS (SELECT *, CASE WHEN dy > 0 THEN -1 ELSE 1 END * (0.5053::DOUBLE * dy * dy + 0.299::DOUBLE * di * di + 0.1957::DOUBLE * dq * dq) AS delta FROM q)
"""
LIMIT = color.max_delta(0.1)


def plain_status(spark: SparkSession, sf_dir: str, threshold: float = 0.1) -> DataFrame:
    return pixeldiff.with_status(frame_pairs(spark, sf_dir), SIDE, SIDE, threshold, include_aa=True)


@query("pixel_diff_severity", f"""{DELTA_SQL}
SELECT frame, count(*) FILTER (abs(delta) > {LIMIT}) AS diff_count, count(*) AS pixels, bool_and(delta = 0) AS identical,
       100.0::DOUBLE * count(*) FILTER (abs(delta) > {LIMIT}) / count(*) AS diff_percentage,
       CASE WHEN 100.0 * count(*) FILTER (abs(delta) > {LIMIT}) / count(*) < 1 THEN 'low' WHEN 100.0 * count(*) FILTER (abs(delta) > {LIMIT}) / count(*) <= 10 THEN 'medium' ELSE 'high' END AS severity
FROM d GROUP BY frame""")
def pixel_diff_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixeldiff.summary(plain_status(spark, sf_dir)).drop("aa_count")


@query("color_delta", f"{DELTA_SQL} SELECT frame, x, y, round(delta, 4) AS delta, round(dy, 4) AS brightness FROM d WHERE delta <> 0")
def color_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = frame_pairs(spark, sf_dir)
    p = color.with_delta(p, color.channels("1"), color.channels("2"), color.offset(SIDE)).filter("delta <> 0")
    return p.select("frame", "x", "y", F.round("delta", 4).alias("delta"), F.round("brightness", 4).alias("brightness"))


@query("threshold_sweep", f"{DELTA_SQL} SELECT t AS threshold, sum(CASE WHEN abs(delta) > 35215.0::DOUBLE * t * t THEN 1 ELSE 0 END) AS diff_count FROM d, (VALUES (0.01::DOUBLE), (0.05), (0.1), (0.2), (0.4)) v(t) GROUP BY t")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All thresholds in one pass over the pairs."""
    p = frame_pairs(spark, sf_dir)
    p = color.with_delta(p, color.channels("1"), color.channels("2"), color.offset(SIDE))
    d = F.abs("delta")
    levels = (0.01, 0.05, 0.1, 0.2, 0.4)
    counts = p.agg(*[F.count_if(d > color.FULL * t * t).alias(f"c{i}") for i, t in enumerate(levels)])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"c{i}").alias("diff_count")) for i, t in enumerate(levels)])).alias("r")).select("r.*")


@query("blocked_diff_count", f"{DELTA_SQL} SELECT frame, count(*) AS diff_count FROM d WHERE abs(delta) > {LIMIT} GROUP BY frame")
def blocked_diff_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixeldiff.blocked_count(frame_pairs(spark, sf_dir), pixeldiff.block_size(SIDE, SIDE), SIDE)


@query("changed_blocks", f"{DELTA_SQL} SELECT DISTINCT frame, CAST(x // 8 AS BIGINT) AS bx, CAST(y // 8 AS BIGINT) AS by FROM d WHERE abs(delta) > {LIMIT}")
def changed_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixeldiff.changed_blocks(frame_pairs(spark, sf_dir), 8, SIDE)


@query("identical_pairs", f"WITH {FRAMES_SQL} SELECT frame, bool_and(r1 = r2 AND g1 = g2 AND b1 = b2 AND a1 = a2) AS identical FROM px GROUP BY frame")
def identical_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identity by order-free digests of both sides' pixels, as a gate before costly work."""
    p = frame_pairs(spark, sf_dir)
    digest = lambda k: F.bit_xor(F.xxhash64("x", "y", f"r{k}", f"g{k}", f"b{k}", f"a{k}"))
    return p.groupBy("frame").agg((digest("1") == digest("2")).alias("identical"))


AROUND_SQL = f"""
pk AS (SELECT *, r1 + 256 * g1 + 65536 * b1 + 16777216::BIGINT * a1 AS p1, r2 + 256 * g2 + 65536 * b2 + 16777216::BIGINT * a2 AS p2 FROM d),
nb AS (SELECT c.frame, c.x, c.y, n.x AS nx, n.y AS ny, c.off, c.p1 = n.p1 AS e1, c.p2 = n.p2 AS e2,
              c.r1, c.g1, c.b1, c.a1, n.r1 AS nr1, n.g1 AS ng1, n.b1 AS nb1, n.a1 AS na1,
              c.r2, c.g2, c.b2, c.a2, n.r2 AS nr2, n.g2 AS ng2, n.b2 AS nb2, n.a2 AS na2
       FROM pk c JOIN pk n ON c.frame = n.frame AND n.x BETWEEN c.x - 1 AND c.x + 1 AND n.y BETWEEN c.y - 1 AND c.y + 1 AND (n.x <> c.x OR n.y <> c.y)),
sib AS (SELECT frame, x, y, (x IN (0, {SIDE - 1}) OR y IN (0, {SIDE - 1})) AS edge,
               count(*) FILTER (e1) + CAST((x IN (0, {SIDE - 1}) OR y IN (0, {SIDE - 1})) AS INT) > 2
               AND count(*) FILTER (e2) + CAST((x IN (0, {SIDE - 1}) OR y IN (0, {SIDE - 1})) AS INT) > 2 AS many FROM nb GROUP BY frame, x, y),
br AS (SELECT nb.frame, nb.x, nb.y, nx, ny, m.many, s.edge,
              {dot_sql(deltas_sql('r1', 'g1', 'b1', 'a1', 'nr1', 'ng1', 'nb1', 'na1'), color.Y)} AS d1,
              {dot_sql(deltas_sql('r2', 'g2', 'b2', 'a2', 'nr2', 'ng2', 'nb2', 'na2'), color.Y)} AS d2
       FROM nb JOIN sib m ON m.frame = nb.frame AND m.x = nx AND m.y = ny JOIN sib s ON s.frame = nb.frame AND s.x = nb.x AND s.y = nb.y),
aa AS (SELECT frame, x, y, {' OR '.join(f'''(count(*) FILTER (d{k} = 0) + CAST(any_value(edge) AS INT) <= 2 AND count(*) FILTER (d{k} < 0) > 0 AND count(*) FILTER (d{k} > 0) > 0 AND
              (arg_min(many, (d{k}, nx, ny)) OR arg_max(many, (d{k}, -nx, -ny))))''' for k in (1, 2))} AS soft FROM br GROUP BY frame, x, y),
st AS (SELECT d.*, CASE WHEN abs(delta) <= {LIMIT} THEN 'same' WHEN soft THEN 'aa' ELSE 'diff' END AS status FROM d JOIN aa USING (frame, x, y))
"""


def aa_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixeldiff.with_status(frame_pairs(spark, sf_dir), SIDE, SIDE)


@query("pixel_status", f"{DELTA_SQL}, {AROUND_SQL} SELECT frame, x, y, status FROM st WHERE status <> 'same'")
def pixel_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aa_status(spark, sf_dir).filter("status <> 'same'").select("frame", "x", "y", "status")


@query("aa_aware_diff", f"{DELTA_SQL}, {AROUND_SQL} SELECT frame, count(*) FILTER (status = 'diff') AS diff_count, count(*) FILTER (status = 'aa') AS aa_count FROM st GROUP BY frame")
def aa_aware_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixeldiff.summary(aa_status(spark, sf_dir)).select("frame", "diff_count", "aa_count")


RASTER_SQL = f"{DELTA_SQL}, {AROUND_SQL} SELECT frame, count(*) AS pixels, count(*) FILTER (status = 'diff') AS diff_count, count(*) FILTER (status = 'aa') AS aa_count, bool_and(r1 = r2 AND g1 = g2 AND b1 = b2 AND a1 = a2) AS identical FROM st GROUP BY frame"


@query("raster_diff", RASTER_SQL)
def raster_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as aa_aware_diff, on rasters."""
    return rasters.compare(rasters.packed(frame_pairs(spark, sf_dir))).drop("reason")


@query("tiled_diff", RASTER_SQL)
def tiled_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same again, on tiles with borders: images of any size spread over tasks."""
    return tiles.compare(tiles.lines_of(frame_pairs(spark, sf_dir), SIDE, SIDE), size=11)


FADE = f"CAST(trunc(255 + (({dot_sql(('r1', 'g1', 'b1'), color.Y)}) - 255) * 0.1::DOUBLE * a1 / 255) AS INT)"


@query("diff_picture", f"""{DELTA_SQL}, f AS (SELECT *, {FADE} AS v, abs(delta) > {LIMIT} AS hit FROM d)
SELECT frame, sum(CASE WHEN hit THEN 255 ELSE v END) AS red, sum(CASE WHEN hit THEN 0 ELSE v END) AS green, sum(CASE WHEN hit THEN CASE WHEN delta < 0 THEN 200 ELSE 0 END ELSE v END) AS blue, min(v) AS darkest FROM f GROUP BY frame""")
def diff_picture(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = plain_status(spark, sf_dir)
    pic = pixeldiff.picture(status, diff=(255, 0, 0), darker=(255, 0, 200))
    low = status.groupBy("frame").agg(F.min(color.faded(color.channels("1"), 0.1)).alias("darkest"))
    return pic.groupBy("frame").agg(F.sum("r").alias("red"), F.sum("g").alias("green"), F.sum("b").alias("blue")).join(low, "frame")


@query("pixel_pack", f"WITH {FRAMES_SQL} SELECT frame, sum(r1 + 256 * g1 + 65536 * b1 + 16777216::BIGINT * a1)::BIGINT AS packed, count(*) FILTER (a1 = 255) AS opaque FROM px GROUP BY frame")
def pixel_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = frame_pairs(spark, sf_dir).withColumn("p", color.pack(color.channels("1")))
    return p.groupBy("frame").agg(F.sum("p").alias("packed"), F.count_if(color.unpack(F.col("p"))[3] == 255).alias("opaque"))


@query("color_spaces", f"""WITH {FRAMES_SQL} SELECT frame, round(avg({dot_sql(('r1', 'g1', 'b1'), color.GRAY)}), 6) AS gray, round(avg({dot_sql(('r1', 'g1', 'b1'), color.BT601)}), 6) AS luminance,
round(avg({dot_sql(('r1', 'g1', 'b1'), color.I)}), 6) AS i, round(avg({dot_sql(('r1', 'g1', 'b1'), color.Q)}), 6) AS q FROM px GROUP BY frame""")
def color_spaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = color.channels("1")
    p = frame_pairs(spark, sf_dir)
    return p.groupBy("frame").agg(*[F.round(F.avg(v), 6).alias(n) for n, v in (("gray", color.gray(c)), ("luminance", color.luminance(c)), ("i", color.yiq(c)[1]), ("q", color.yiq(c)[2]))])


def _linear(c: str) -> str:
    return f"CASE WHEN {c} / 255.0::DOUBLE <= 0.04045 THEN {c} / 255.0::DOUBLE / 12.92::DOUBLE ELSE pow(({c} / 255.0::DOUBLE + 0.055::DOUBLE) / 1.055::DOUBLE, 2.4) END"


def _curve(t: str) -> str:
    return f"CASE WHEN {t} > 216.0::DOUBLE / 24389 THEN cbrt({t}) ELSE (24389.0::DOUBLE / 27 * {t} + 16) / 116 END"


@query("lab_means", f"""WITH {FRAMES_SQL}, lin AS (SELECT frame, {_linear('r1')} AS r, {_linear('g1')} AS g, {_linear('b1')} AS b FROM px),
xyz AS (SELECT frame, (0.4124564::DOUBLE * r + 0.3575761::DOUBLE * g + 0.1804375::DOUBLE * b) / 0.95047::DOUBLE AS x, 0.2126729::DOUBLE * r + 0.7151522::DOUBLE * g + 0.0721750::DOUBLE * b AS y, (0.0193339::DOUBLE * r + 0.1191920::DOUBLE * g + 0.9503041::DOUBLE * b) / 1.08883::DOUBLE AS z FROM lin),
f AS (SELECT frame, {_curve('x')} AS x, {_curve('y')} AS y, {_curve('z')} AS z FROM xyz)
SELECT frame, round(avg(116 * y - 16), 5) AS l, round(avg(500 * (x - y)), 5) AS a, round(avg(200 * (y - z)), 5) AS b FROM f GROUP BY frame""")
def lab_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    l, a, b = color.lab(color.channels("1"))
    return frame_pairs(spark, sf_dir).groupBy("frame").agg(F.round(F.avg(l), 5).alias("l"), F.round(F.avg(a), 5).alias("a"), F.round(F.avg(b), 5).alias("b"))


GRAY_SQL = f"""WITH {FRAMES_SQL},
gr AS (SELECT frame, x, y, CAST(CAST({dot_sql(('r1', 'g1', 'b1'), color.GRAY)} AS FLOAT) AS DOUBLE) AS l1, CAST(CAST({dot_sql(('r2', 'g2', 'b2'), color.GRAY)} AS FLOAT) AS DOUBLE) AS l2 FROM px)"""
SSIM_OF = f"(2 * m1 * m2 + {similarity.C1}) * (2 * (m12 - m1 * m2) + {similarity.C2}) / ((m1 * m1 + m2 * m2 + {similarity.C1}) * (m11 - m1 * m1 + m22 - m2 * m2 + {similarity.C2}))"
BOX_SQL = f"""{GRAY_SQL},
ws AS (SELECT frame, x // 11 AS wx, y // 11 AS wy, avg(l1) AS m1, avg(l2) AS m2, avg(l1 * l1) AS m11, avg(l2 * l2) AS m22, avg(l1 * l2) AS m12 FROM gr WHERE x < 22 AND y < 22 GROUP BY ALL),
ss AS (SELECT frame, wx, wy, {SSIM_OF} AS ssim FROM ws)"""


@query("box_ssim", f"{BOX_SQL} SELECT frame, round(CASE WHEN avg(ssim) > 0 THEN 1 - stddev_pop(ssim) / avg(ssim) ELSE 1 END, 6) AS score, round(avg(ssim), 6) AS mean_score, count(*) AS windows FROM ss GROUP BY frame")
def box_ssim(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = similarity.cov_pooled(similarity.box_windows(frame_pairs(spark, sf_dir), SIDE, SIDE))
    return out.withColumn("score", F.round("score", 6)).withColumn("mean_score", F.round("mean_score", 6))


@query("box_ssim_sliding", f"""{GRAY_SQL},
ws AS (SELECT a.frame, a.x, a.y, avg(b.l1) AS m1, avg(b.l2) AS m2, avg(b.l1 * b.l1) AS m11, avg(b.l2 * b.l2) AS m22, avg(b.l1 * b.l2) AS m12
       FROM gr a JOIN gr b ON a.frame = b.frame AND b.x BETWEEN a.x AND a.x + 7 AND b.y BETWEEN a.y AND a.y + 7 WHERE a.x % 4 = 0 AND a.y % 4 = 0 AND a.x <= 24 AND a.y <= 24 GROUP BY ALL)
SELECT frame, round(avg({SSIM_OF}), 6) AS mean_score, count(*) AS windows FROM ws GROUP BY frame""")
def box_ssim_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = similarity.cov_pooled(similarity.box_windows(frame_pairs(spark, sf_dir), SIDE, SIDE, window=8, stride=4))
    return out.select("frame", F.round("mean_score", 6).alias("mean_score"), "windows")


@query("ssim_below_floor", f"{BOX_SQL} SELECT frame, count(*) FILTER (ssim < 0.9) AS below, count(*) AS windows, round(avg(ssim), 6) AS score, 100.0::DOUBLE * count(*) FILTER (ssim < 0.9) / count(*) AS below_pct, avg(ssim) >= 0.95 AS match FROM ss GROUP BY frame")
def ssim_below_floor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.below_floor(similarity.box_windows(frame_pairs(spark, sf_dir), SIDE, SIDE), 0.9, 0.95).withColumn("score", F.round("score", 6))


TAPS = ", ".join(f"({i}, {w!r}::DOUBLE)" for i, w in enumerate(similarity.taps()))


@query("gaussian_ssim", f"""{GRAY_SQL}, taps AS (SELECT * FROM (VALUES {TAPS}) t(i, w)),
h AS (SELECT frame, x - i AS x, y, sum(w * l1) AS m1, sum(w * l2) AS m2, sum(w * (l1 * l1)) AS m11, sum(w * (l2 * l2)) AS m22, sum(w * (l1 * l2)) AS m12 FROM gr, taps WHERE x - i BETWEEN 0 AND {SIDE - 11} GROUP BY ALL),
v AS (SELECT frame, x, y - i AS y, sum(w * m1) AS m1, sum(w * m2) AS m2, sum(w * m11) AS m11, sum(w * m22) AS m22, sum(w * m12) AS m12 FROM h, taps WHERE y - i BETWEEN 0 AND {SIDE - 11} GROUP BY ALL)
SELECT frame, round(avg({SSIM_OF}), 6) AS score FROM v GROUP BY frame""")
def gaussian_ssim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.gaussian_ssim(frame_pairs(spark, sf_dir), SIDE, SIDE).withColumn("score", F.round("score", 6))


def _gms_sql(src: str, side: int) -> str:
    n = lambda k, dx, dy: f"max(CASE WHEN n.x = c.x + ({dx}) AND n.y = c.y + ({dy}) THEN n.l{k} END)"
    gx = lambda k: "(" + " + ".join(n(k, -1, d) for d in (-1, 0, 1)) + " - " + " - ".join(n(k, 1, d) for d in (-1, 0, 1)) + ") / 3"
    gy = lambda k: "(" + " + ".join(n(k, d, -1) for d in (-1, 0, 1)) + " - " + " - ".join(n(k, d, 1) for d in (-1, 0, 1)) + ") / 3"
    return f"""gg AS (SELECT c.frame, c.x, c.y, {gx(1)} AS gx1, {gy(1)} AS gy1, {gx(2)} AS gx2, {gy(2)} AS gy2
FROM {src} c JOIN {src} n ON n.frame = c.frame AND n.x BETWEEN c.x - 1 AND c.x + 1 AND n.y BETWEEN c.y - 1 AND c.y + 1 WHERE c.x BETWEEN 1 AND {side - 2} AND c.y BETWEEN 1 AND {side - 2} GROUP BY ALL),
gm AS (SELECT frame, x, y, sqrt(gx1 * gx1 + gy1 * gy1) AS g1, sqrt(gx2 * gx2 + gy2 * gy2) AS g2 FROM gg),
gs AS (SELECT *, (2 * g1 * g2 + 170) / (g1 * g1 + g2 * g2 + 170) AS gms FROM gm)"""


@query("gmsd", f"{GRAY_SQL}, {_gms_sql('gr', SIDE)} SELECT frame, round(stddev_pop(gms), 6) AS gmsd FROM gs GROUP BY frame")
def gmsd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity.gmsd(frame_pairs(spark, sf_dir), SIDE, SIDE).withColumn("gmsd", F.round("gmsd", 6))


@query("gmsd_halved", f"""{GRAY_SQL}, hv AS (SELECT frame, x // 2 AS x, y // 2 AS y, CAST(CAST({dot_sql(('v', 'v', 'v'), color.GRAY)} AS FLOAT) AS DOUBLE) AS l1, CAST(CAST({dot_sql(('w', 'w', 'w'), color.GRAY)} AS FLOAT) AS DOUBLE) AS l2
FROM (SELECT frame, x // 2 * 2 AS x, y // 2 * 2 AS y, sum(l1) / 4 AS v, sum(l2) / 4 AS w FROM gr GROUP BY ALL)), {_gms_sql('hv', SIDE // 2)} SELECT frame, round(stddev_pop(gms), 6) AS gmsd FROM gs GROUP BY frame""")
def gmsd_halved(spark: SparkSession, sf_dir: str) -> DataFrame:
    half = similarity.halved(frame_pairs(spark, sf_dir), SIDE, SIDE)
    return similarity.gmsd(half, SIDE // 2, SIDE // 2).withColumn("gmsd", F.round("gmsd", 6))


@query("gms_picture", f"{GRAY_SQL}, {_gms_sql('gr', SIDE)} SELECT frame, x, y, CAST(floor(round(gms, 9) * 255) AS INT) AS gray FROM gs WHERE gms < 0.9")
def gms_picture(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = similarity.gms(similarity.gradients(frame_pairs(spark, sf_dir), SIDE, SIDE))
    return g.filter("gms < 0.9").select("frame", "x", "y", F.floor(F.round("gms", 9) * 255).cast("int").alias("gray"))


@query("ssim_picture", f"{BOX_SQL} SELECT frame, x, y, CAST(floor(greatest(0.0::DOUBLE, least(1.0::DOUBLE, round(ssim, 9))) * 255) AS INT) AS gray FROM px JOIN ss USING (frame) WHERE wx = least(x * 2 // 32, 1) AND wy = least(y * 2 // 32, 1) AND ssim < 0.99")
def ssim_picture(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = frame_pairs(spark, sf_dir)
    w = similarity.box_windows(p, SIDE, SIDE).filter("ssim < 0.99").withColumn("ssim", F.round("ssim", 9))
    return similarity.map_picture(w, p, SIDE, SIDE, 2, 2)


@query("pair_outcome", f"""{DELTA_SQL}, sz AS (SELECT frame, max(x) + 1 AS w, max(y) + 1 AS h FROM px GROUP BY frame), n AS (SELECT frame, count(*) AS diff_count FROM d WHERE abs(delta) > {LIMIT} GROUP BY frame),
b AS (SELECT frame, CASE WHEN frame % 9 = 4 THEN w - 1 ELSE w END AS w, h FROM sz WHERE frame % 7 <> 3)
SELECT frame, CASE WHEN b.w IS NULL THEN 'file-not-exists' WHEN sz.w <> b.w OR sz.h <> b.h THEN 'layout-diff' WHEN coalesce(diff_count, 0) > 0 THEN 'pixel-diff' ELSE 'match' END AS reason, coalesce(diff_count, 0) AS diff_count
FROM sz LEFT JOIN b USING (frame) LEFT JOIN n USING (frame)""")
def pair_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = frames(spark, sf_dir)
    sizes = px.groupBy("frame").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    other = sizes.filter("frame % 7 <> 3").withColumn("w", F.when(F.col("frame") % 9 == 4, F.col("w") - 1).otherwise(F.col("w")))
    counts = pixeldiff.summary(pixeldiff.with_status(pair(px, edited(px)), SIDE, SIDE, include_aa=True)).filter("diff_count > 0").select("frame", "diff_count")
    return pixeldiff.outcome(sizes, other, counts)


@query("tiled_gmsd", f"{GRAY_SQL}, {_gms_sql('gr', SIDE)} SELECT frame, round(stddev_pop(gms), 6) AS gmsd FROM gs GROUP BY frame")
def tiled_gmsd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiles.gmsd(tiles.lines_of(frame_pairs(spark, sf_dir), SIDE, SIDE), size=9).withColumn("gmsd", F.round("gmsd", 6))
