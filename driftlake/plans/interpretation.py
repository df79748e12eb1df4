"""Queries over regions of change, their interpretation, verdicts and snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlake.functions import color
from driftlake.operators import interpreting, pixeldiff, regions, similarity, tiledregions, tiles, verdicts
from driftlake.plans.imaging import DELTA_SQL, GRAY_SQL, LIMIT, _gms_sql, plain_status
from driftlake.plans.registry import query
from driftlake.sources.frames import SIDE, frame_pairs

REACH = regions.radius(SIDE, SIDE)


def changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plain_status(spark, sf_dir).withColumn("changed", F.col("status") == "diff")


def closed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.closed(changed(spark, sf_dir), REACH)


def _window_sql(fold: str, of: str, part: str, along: str) -> str:
    return f"{fold}({of}) OVER (PARTITION BY frame, {part} ORDER BY {along} ROWS BETWEEN {REACH} PRECEDING AND {REACH} FOLLOWING)"


CLOSED_SQL = f"""{DELTA_SQL},
ch AS (SELECT *, abs(delta) > {LIMIT} AS changed FROM d),
m1 AS (SELECT *, {_window_sql('max', 'changed', 'y', 'x')} AS m FROM ch),
m2 AS (SELECT * REPLACE ({_window_sql('max', 'm', 'x', 'y')} AS m) FROM m1),
m3 AS (SELECT * REPLACE ({_window_sql('min', 'm', 'x', 'y')} AS m) FROM m2),
cm AS (SELECT *, {_window_sql('min', 'm', 'y', 'x')} AS closed FROM m3)"""
COMPONENTS_SQL = f"""{CLOSED_SQL.replace('WITH ', 'WITH RECURSIVE ', 1)},
cl AS MATERIALIZED (SELECT frame, x, y, y * {SIDE} + x AS i FROM cm WHERE closed),
near AS MATERIALIZED (SELECT a.frame, a.i, b.i AS j FROM cl a, (VALUES (0, 1), (1, 0), (0, -1), (-1, 0)) o(dx, dy), cl b WHERE b.frame = a.frame AND b.x = a.x + dx AND b.y = a.y + dy),
reach AS (SELECT frame, i, i AS l FROM cl UNION SELECT n.frame, n.j, r.l FROM reach r JOIN near n ON n.frame = r.frame AND n.i = r.i WHERE r.l < n.j),
lb AS (SELECT frame, i, min(l) // {SIDE} * 4294967296 + min(l) % {SIDE} AS label FROM reach GROUP BY frame, i),
boxes AS (SELECT frame, label, min(x) AS bx, min(y) AS by, max(x) - min(x) + 1 AS bw, max(y) - min(y) + 1 AS bh, count(*) AS pixels
       FROM cm JOIN lb USING (frame) WHERE changed AND lb.i = y * {SIDE} + x GROUP BY frame, label)"""


@query("morph_close", f"{CLOSED_SQL} SELECT frame, count(*) FILTER (changed) AS changed, count(*) FILTER (closed) AS closed, sum(CASE WHEN closed THEN y * {SIDE} + x ELSE 0 END) AS places FROM cm GROUP BY frame")
def morph_close(spark: SparkSession, sf_dir: str) -> DataFrame:
    return closed(spark, sf_dir).groupBy("frame").agg(F.count_if("changed").alias("changed"), F.count_if("closed").alias("closed"), F.sum(F.when(F.col("closed"), F.col("y") * SIDE + F.col("x")).otherwise(0)).alias("places"))


@query("component_boxes", f"{COMPONENTS_SQL} SELECT * FROM boxes")
def component_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.component_boxes(closed(spark, sf_dir))


@query("tiled_components", f"{COMPONENTS_SQL} SELECT * FROM boxes")
def tiled_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, labelled in tiles and joined along their edges."""
    return tiledregions.component_boxes(tiles.lines_of(frame_pairs(spark, sf_dir), SIDE, SIDE), size=10)


@query("noise_census", f"{COMPONENTS_SQL} SELECT frame, count(*) AS components, count(*) FILTER (pixels < 64) AS small, greatest(3 * count(*) FILTER (pixels < 64), 12) AS floor FROM boxes GROUP BY frame")
def noise_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions.noise_census(component_boxes(spark, sf_dir))


# known boxes: two of every edited frame, one over the block and one over the upper left
KNOWN_SQL = 'kb AS (SELECT frame, region, CASE region WHEN 0 THEN 6 + frame % 8 ELSE 0 END AS bx, CASE region WHEN 0 THEN 5 + frame % 5 ELSE 0 END AS "by", CASE region WHEN 0 THEN 14 ELSE 11 END AS bw, CASE region WHEN 0 THEN 10 ELSE 9 END AS bh FROM (SELECT DISTINCT frame FROM px WHERE frame % 5 <> 0), (VALUES (0), (1)) v(region))'


def known_boxes(px: DataFrame) -> DataFrame:
    f, block = F.col("frame"), F.col("region") == 0
    each = px.filter("frame % 5 <> 0").select("frame").distinct().withColumn("region", F.explode(F.array(F.lit(0), F.lit(1))))
    pick = lambda a, b: F.when(block, a).otherwise(b)
    return each.select("frame", "region", pick(6 + f % 8, 0).alias("bx"), pick(5 + f % 5, 0).alias("by"), pick(14, 11).alias("bw"), pick(10, 9).alias("bh"))


LUMA = "(0.299::DOUBLE * r{k} + 0.587::DOUBLE * g{k} + 0.114::DOUBLE * b{k})"
MEASURES_SQL = f"""{DELTA_SQL}, {KNOWN_SQL},
ce AS (SELECT d.*, kb.region, bx, "by", bw, bh, d.x - bx AS ex, d.y - "by" AS ey, abs(delta) / 35215.0::DOUBLE AS nd, {LUMA.format(k=1)} AS l1, {LUMA.format(k=2)} AS l2,
       greatest(1, least(12, least(bw, bh) // 4)) AS band
       FROM d JOIN kb ON d.frame = kb.frame AND d.x >= bx AND d.x < bx + bw AND d.y >= "by" AND d.y < "by" + bh),
cf AS (SELECT *, abs(delta) > {LIMIT} AS m, ex < band OR ex >= bw - band OR ey < band OR ey >= bh - band AS onb,
       ex >= bw // 4 AND ex < bw - bw // 4 AND ey >= bh // 4 AND ey < bh - bh // 4 AS onc FROM ce)"""


@query("region_shapes", f"""{MEASURES_SQL}, g AS (SELECT frame, region, bw, bh, bx, "by", count(*) FILTER (m) AS n, count(*) FILTER (m) / (bw * bh)::DOUBLE AS fill,
 CASE WHEN count(*) FILTER (m) > 0 THEN count(*) FILTER (m AND onb) / (count(*) FILTER (m))::DOUBLE ELSE 0 END AS border,
 count(*) FILTER (m AND NOT onb) / (count(*) FILTER (NOT onb))::DOUBLE AS inner_fill, count(*) FILTER (m AND onc) / (count(*) FILTER (onc))::DOUBLE AS centre,
 count(DISTINCT y) FILTER (m) / bh::DOUBLE AS row_share, count(DISTINCT x) FILTER (m) / bw::DOUBLE AS column_share FROM cf GROUP BY frame, region, bw, bh, bx, "by" HAVING count(*) FILTER (m) > 0)
SELECT frame, region, round(fill, 6) AS fill, round(border, 6) AS border, round(inner_fill, 6) AS inner_fill, round(centre, 6) AS centre, round(row_share, 6) AS row_share, round(column_share, 6) AS column_share,
 CASE WHEN fill > 0.65 THEN 'solid-region' WHEN inner_fill < 0.2 AND (border > 0.6 OR (centre < 0.1 AND border > 0.3 AND fill < 0.5)) THEN 'contour-frame'
      WHEN fill < 0.3 AND border > 0.45 THEN 'edge-dominated' WHEN fill < 0.3 AND row_share > 0.7 AND column_share > 0.7 THEN 'sparse-distributed' ELSE 'mixed-region' END AS shape,
 CASE WHEN "by" + bh / 2 < 32 / 3.0 THEN CASE WHEN bx + bw / 2 < 32 / 3.0 THEN 'top-left' WHEN bx + bw / 2 < 64 / 3.0 THEN 'top' ELSE 'top-right' END
      WHEN "by" + bh / 2 < 64 / 3.0 THEN CASE WHEN bx + bw / 2 < 32 / 3.0 THEN 'left' WHEN bx + bw / 2 < 64 / 3.0 THEN 'center' ELSE 'right' END
      ELSE CASE WHEN bx + bw / 2 < 32 / 3.0 THEN 'bottom-left' WHEN bx + bw / 2 < 64 / 3.0 THEN 'bottom' ELSE 'bottom-right' END END AS position FROM g""")
def region_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = changed(spark, sf_dir)
    m = regions.measures(px, known_boxes(px))
    rounded = [F.round(c, 6).alias(c) for c in ("fill", "border", "inner_fill", "centre", "row_share", "column_share")]
    return m.select("frame", "region", *rounded, regions.shape().alias("shape"), regions.position(SIDE, SIDE).alias("position"))


@query("region_color", f"""{MEASURES_SQL} SELECT frame, region, round(avg(nd) FILTER (m), 6) AS mean_delta, round(max(nd) FILTER (m), 6) AS max_delta, round(stddev_pop(nd) FILTER (m), 6) AS delta_stddev,
 round(CASE WHEN count(*) FILTER (m) < 2 THEN 1 WHEN var_pop(l1) FILTER (m) * count(*) FILTER (m) <= 1e-6 AND var_pop(l2) FILTER (m) * count(*) FILTER (m) <= 1e-6 THEN 1
            WHEN var_pop(l1) FILTER (m) * count(*) FILTER (m) <= 1e-6 OR var_pop(l2) FILTER (m) * count(*) FILTER (m) <= 1e-6 THEN 0
            ELSE greatest(-1, least(1, covar_pop(l1, l2) FILTER (m) / sqrt(var_pop(l1) FILTER (m) * var_pop(l2) FILTER (m)))) END, 6) AS ncc
 FROM cf GROUP BY frame, region HAVING count(*) FILTER (m) > 0""")
def region_color(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = changed(spark, sf_dir)
    return regions.measures(px, known_boxes(px)).select("frame", "region", *[F.round(c, 6).alias(c) for c in ("mean_delta", "max_delta", "delta_stddev", "ncc")])


@query("region_edges", f"""{MEASURES_SQL}, lu AS (SELECT frame, x, y, {LUMA.format(k=1)} AS l1, {LUMA.format(k=2)} AS l2 FROM px),
ng AS (SELECT a.frame, a.region, a.x, a.y,
 power(CASE WHEN a.x = 0 THEN r.l1 - a.l1 WHEN a.x = 31 THEN a.l1 - l.l1 ELSE (r.l1 - l.l1) * 0.5 END, 2) + power(CASE WHEN a.y = 0 THEN u.l1 - a.l1 WHEN a.y = 31 THEN a.l1 - o.l1 ELSE (u.l1 - o.l1) * 0.5 END, 2) >= 900 AS e1,
 power(CASE WHEN a.x = 0 THEN r.l2 - a.l2 WHEN a.x = 31 THEN a.l2 - l.l2 ELSE (r.l2 - l.l2) * 0.5 END, 2) + power(CASE WHEN a.y = 0 THEN u.l2 - a.l2 WHEN a.y = 31 THEN a.l2 - o.l2 ELSE (u.l2 - o.l2) * 0.5 END, 2) >= 900 AS e2
 FROM cf a LEFT JOIN lu r ON r.frame = a.frame AND r.x = a.x + 1 AND r.y = a.y LEFT JOIN lu l ON l.frame = a.frame AND l.x = a.x - 1 AND l.y = a.y
 LEFT JOIN lu u ON u.frame = a.frame AND u.x = a.x AND u.y = a.y + 1 LEFT JOIN lu o ON o.frame = a.frame AND o.x = a.x AND o.y = a.y - 1 WHERE a.m)
SELECT frame, region, round(avg(CAST(e1 AS INT)), 6) AS edges1, round(avg(CAST(e2 AS INT)), 6) AS edges2, round(avg(CAST(e1 = e2 AS INT)), 6) AS edges_agree FROM ng GROUP BY frame, region""")
def region_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = changed(spark, sf_dir)
    return regions.measures(px, known_boxes(px)).select("frame", "region", *[F.round(c, 6).alias(c) for c in ("edges1", "edges2", "edges_agree")])


def _side(k: int) -> str:
    dot = lambda w: " + ".join(f"{c}{k} * {v!r}::DOUBLE" for c, v in zip("rgb", w))
    return f"{dot(color.Y)} AS y{k}, {dot(color.I)} AS i{k}, {dot(color.Q)} AS q{k}, {dot(color.BT601)} AS l{k}"


def _slope(k: int, part: str, along: str) -> str:
    w = f"(PARTITION BY frame, {part} ORDER BY {along})"
    ahead, back = f"lead(l{k}) OVER {w}", f"lag(l{k}) OVER {w}"
    return f"power(CASE WHEN {back} IS NULL THEN {ahead} - l{k} WHEN {ahead} IS NULL THEN l{k} - {back} ELSE ({ahead} - {back}) * 0.5 END, 2)"


def _step(part: str, along: str) -> str:
    w = f"(PARTITION BY frame, {part} ORDER BY {along})"
    return f"CASE WHEN ch AND lag(ch) OVER {w} THEN abs(dc - lag(dc) OVER {w}) END"


def _near_ground(k: int) -> str:
    far = " + ".join(f"power({c}{k} - g_{c}{k}, 2)" for c in "rgb")
    return f"least(1.0::DOUBLE, coalesce(avg(sqrt({far})) FILTER (m) / (255 * sqrt(3.0::DOUBLE)), 1)) AS ground{k}"


def types_sql(boxes: str, mask: str = f"abs(delta) > {LIMIT}") -> str:
    """CTEs over d that end in typed(frame, region, bx, by, bw, bh, n, change_type, confidence): every measure of the boxes `boxes`, and the rules in order.  `mask` says what has
    changed."""
    grounds = ", ".join(f"coalesce(avg({c}{k}) FILTER (inside AND NOT ch), avg({c}{k}) FILTER (NOT inside)) AS g_{c}{k}" for k in (1, 2) for c in "rgb")
    rules = [
        ("bw * bh <= 25 AND faint", "rendering-noise", "1.0"),
        ("fill < 0.35 AND faint AND edges1 < 0.05 AND NOT ((b1 AND NOT b2 AND fresh) OR (b2 AND NOT b1 AND gone))", "rendering-noise", "1.0"),
        ("b1 AND NOT b2 AND (fresh OR edges2 - edges1 > 0.04 OR NOT (ncc > 0.55))", "addition", "CASE WHEN edges1 < 0.05 AND NOT (edges2 < 0.05) THEN 1.0 ELSE 0.9 END"),
        ("b2 AND NOT b1 AND (gone OR edges2 - edges1 < -0.04 OR NOT (ncc > 0.55))", "deletion", "CASE WHEN edges2 < 0.05 AND NOT (edges1 < 0.05) THEN 1.0 ELSE 0.9 END"),
        ("(NOT faint OR (ncc > 0.88 AND ((edges1 < 0.05 AND edges2 < 0.05) OR agree > 0.85) AND mean_delta > 0.00005)) AND NOT (ncc < 0.05 AND spread > mean_delta * 2 + 0.1) AND ncc > 0.55", "color-change", "least(1.0, least(mean_delta * 5, 1.0) * 0.5 + greatest(ncc, 0.0) * 0.5)"),
        ("moved AND NOT (hue > 0.235 AND mean_dq <= 0.071 AND sat1 > 0.072)", "color-change", "least(mean_dc * 3, 1.0) * 0.5 + 0.25"),
        ("NOT moved AND (mean_dy > 0.268 OR (mean_dy <= -0.150 AND edges2 <= 0.101))", "color-change", "0.6"),
        ("true", "content-change", "0.5"),
    ]
    pick = lambda at: "CASE " + " ".join(f"WHEN {r[0]} THEN {at(r)}" for r in rules) + " END"
    return f"""
yq AS (SELECT *, {mask} AS ch, abs(delta) / 35215.0::DOUBLE AS nd, {_side(1)}, {_side(2)} FROM d),
dc AS (SELECT *, sqrt(power(i2 - i1, 2) + power(q2 - q1, 2)) AS dc, {_slope(1, 'y', 'x')} + {_slope(1, 'x', 'y')} >= 900 AS e1, {_slope(2, 'y', 'x')} + {_slope(2, 'x', 'y')} >= 900 AS e2 FROM yq),
sp AS (SELECT *, {_step('y', 'x')} AS sx, {_step('x', 'y')} AS sy FROM dc),
cg AS (SELECT sp.*, b.region, bx, "by", bw, bh, sp.x - bx AS ex, sp.y - "by" AS ey, sp.x >= bx AND sp.x < bx + bw AND sp.y >= "by" AND sp.y < "by" + bh AS inside FROM sp JOIN {boxes} b ON b.frame = sp.frame AND sp.x BETWEEN bx - 1 AND bx + bw AND sp.y BETWEEN "by" - 1 AND "by" + bh),
gd AS (SELECT frame, region, {grounds} FROM cg GROUP BY ALL),
cm2 AS (SELECT cg.*, inside AND ch AS m, sqrt(i1 * i1 + q1 * q1) AS s1, sqrt(i2 * i2 + q2 * q2) AS s2, {', '.join(f'g_{c}{k}' for k in (1, 2) for c in 'rgb')} FROM cg JOIN gd USING (frame, region)),
ms AS (SELECT frame, region, bx, "by", bw, bh, count(*) FILTER (m) AS n, count(*) FILTER (m) / (bw * bh)::DOUBLE AS fill, avg(nd) FILTER (m) AS mean_delta, stddev_pop(nd) FILTER (m) AS spread,
  avg(CAST(e1 AS INT)) FILTER (m) AS edges1, avg(CAST(e2 AS INT)) FILTER (m) AS edges2, avg(CAST(e1 = e2 AS INT)) FILTER (m) AS agree, avg(y2 - y1) FILTER (m) / 255 AS mean_dy, avg(abs(q2 - q1)) FILTER (m) / 255 AS mean_dq, avg(dc) FILTER (m) / 255 AS mean_dc, avg(s1) FILTER (m) / 255 AS sat1,
  CASE WHEN sum(s1 * s2) FILTER (m) > 1e-6 THEN greatest(-1, least(1, sum(i1 * i2 + q1 * q2) FILTER (m) / sum(s1 * s2) FILTER (m))) ELSE 1 END AS hue,
  CASE WHEN count(*) FILTER (m) < 2 OR (var_pop(l1) FILTER (m) * count(*) FILTER (m) <= 1e-6 AND var_pop(l2) FILTER (m) * count(*) FILTER (m) <= 1e-6) THEN 1 WHEN var_pop(l1) FILTER (m) * count(*) FILTER (m) <= 1e-6 OR var_pop(l2) FILTER (m) * count(*) FILTER (m) <= 1e-6 THEN 0
       ELSE greatest(-1, least(1, covar_pop(l1, l2) FILTER (m) / sqrt(var_pop(l1) FILTER (m) * var_pop(l2) FILTER (m)))) END AS ncc,
  count(sx) FILTER (m AND ex > 0) + count(sy) FILTER (m AND ey > 0) AS steps, coalesce(sum(sx) FILTER (m AND ex > 0), 0) + coalesce(sum(sy) FILTER (m AND ey > 0), 0) AS jumps, stddev_pop(dc) FILTER (m) AS sdc, {_near_ground(1)}, {_near_ground(2)}
  FROM cm2 GROUP BY frame, region, bx, "by", bw, bh HAVING count(*) FILTER (m) > 0),
fl AS (SELECT *, mean_delta < 0.05 AS faint, ground1 < 0.08 OR (ground2 > 0.08 AND ground1 < ground2 * 0.5) AS b1, ground2 < 0.08 OR (ground1 > 0.08 AND ground2 < ground1 * 0.5) AS b2, ground2 > ground1 * 2 AS fresh, ground1 > ground2 * 2 AS gone,
  mean_dc > 0.131 AND CASE WHEN steps > 0 THEN jumps / steps / (sdc + 1e-6) ELSE 0 END < 0.75 AS moved FROM ms),
typed AS (SELECT frame, region, bx, "by", bw, bh, n, {pick(lambda r: f"'{r[1]}'")} AS change_type, CAST({pick(lambda r: r[2])} AS DOUBLE) AS confidence FROM fl)"""


@query("known_region_types", f'{DELTA_SQL}, {KNOWN_SQL}, {types_sql("kb")} SELECT frame, region, bx, "by", bw, bh, n, change_type, round(confidence, 6) AS confidence FROM typed')
def known_region_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes given by the caller, measured and classified."""
    px = changed(spark, sf_dir)
    return regions.change_type(regions.measures(px, known_boxes(px))).select("frame", "region", "bx", "by", "bw", "bh", "n", "change_type", F.round("confidence", 6).alias("confidence"))


# The mask of a coarse source: of the pixels in its boxes those of a metric of 100 or more; a box with none of these keeps all that differ at all.
COARSE_SQL = f"""ins AS (SELECT d.frame, kb.region, d.x, d.y, abs(delta) AS size FROM d JOIN kb ON d.frame = kb.frame AND d.x >= bx AND d.x < bx + bw AND d.y >= "by" AND d.y < "by" + bh),
ft AS (SELECT frame, region FROM ins GROUP BY ALL HAVING max(size) < 100 AND max(size) > 0), rf AS (SELECT frame, x, y FROM ins WHERE size >= 100 UNION SELECT frame, x, y FROM ins SEMI JOIN ft USING (frame, region))"""
PLACE_SQL = """CASE WHEN "by" + bh / 2 < 32 / 3.0 THEN CASE WHEN bx + bw / 2 < 32 / 3.0 THEN 'top-left' WHEN bx + bw / 2 < 64 / 3.0 THEN 'top' ELSE 'top-right' END
  WHEN "by" + bh / 2 < 64 / 3.0 THEN CASE WHEN bx + bw / 2 < 32 / 3.0 THEN 'left' WHEN bx + bw / 2 < 64 / 3.0 THEN 'center' ELSE 'right' END
  ELSE CASE WHEN bx + bw / 2 < 32 / 3.0 THEN 'bottom-left' WHEN bx + bw / 2 < 64 / 3.0 THEN 'bottom' ELSE 'bottom-right' END END"""


@query("interpreted_boxes", f"""{DELTA_SQL}, {KNOWN_SQL}, {COARSE_SQL}, {types_sql("kb", "(frame, x, y) IN (SELECT (frame, x, y) FROM rf)")}
SELECT frame, region, bx, "by", bw, bh, n AS pixels, round(100.0::DOUBLE * n / {SIDE * SIDE}, 6) AS percentage, {PLACE_SQL} AS position, change_type FROM typed WHERE change_type <> 'rendering-noise'""")
def interpreted_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The caller's boxes as the source of regions.  Moves are left to `interpreted_moves`."""
    px = changed(spark, sf_dir)
    found = interpreting.interpret(interpreting.from_boxes(px, known_boxes(px)), SIDE, SIDE, moves=False)
    return found.select("frame", "region", "bx", "by", "bw", "bh", "pixels", F.round("percentage", 6).alias("percentage"), "position", "change_type")


@query("interpreted_totals", f"""{DELTA_SQL}, {KNOWN_SQL}, {COARSE_SQL}, {types_sql("kb", "(frame, x, y) IN (SELECT (frame, x, y) FROM rf)")}, lf AS (SELECT * FROM typed WHERE change_type <> 'rendering-noise'),
un AS (SELECT DISTINCT rf.frame, rf.x, rf.y FROM rf JOIN lf ON lf.frame = rf.frame AND rf.x >= bx AND rf.x < bx + bw AND rf.y >= "by" AND rf.y < "by" + bh),
ct AS (SELECT frame, count(*) AS diff_count FROM un GROUP BY frame), rg AS (SELECT frame, count(*) AS regions FROM lf GROUP BY frame)
SELECT frame, coalesce(regions, 0) AS regions, coalesce(diff_count, 0) AS diff_count, round(100.0::DOUBLE * coalesce(diff_count, 0) / {SIDE * SIDE}, 6) AS diff_percentage, CASE WHEN 100.0 * coalesce(diff_count, 0) / {SIDE * SIDE} < 1 THEN 'low' WHEN 100.0 * coalesce(diff_count, 0) / {SIDE * SIDE} <= 10 THEN 'medium' ELSE 'high' END AS severity
FROM (SELECT DISTINCT frame FROM px) LEFT JOIN ct USING (frame) LEFT JOIN rg USING (frame)""")
def interpreted_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the caller's boxes come to for each image; a pixel under two boxes counts once."""
    px = changed(spark, sf_dir)
    source = interpreting.from_boxes(px, known_boxes(px))
    return interpreting.totals(source, interpreting.interpret(source, SIDE, SIDE, moves=False), SIDE, SIDE).select("frame", "regions", "diff_count", F.round("diff_percentage", 6).alias("diff_percentage"), "severity")


MAP, LOW = SIDE - 2, 0.9
# Boxes of connected cells of the gradient similarity under LOW, scaled to the image and numbered by their first cell.
SCORES_SQL = f"""gr AS {GRAY_SQL.split("gr AS ", 1)[1]}, {_gms_sql('gr', SIDE)},
lc AS MATERIALIZED (SELECT frame, x - 1 AS x, y - 1 AS y, (y - 1) * {MAP} + x - 1 AS i FROM gs WHERE gms < {LOW}),
nc AS MATERIALIZED (SELECT a.frame, a.i, b.i AS j FROM lc a, (VALUES (0, 1), (1, 0), (0, -1), (-1, 0)) o(dx, dy), lc b WHERE b.frame = a.frame AND b.x = a.x + dx AND b.y = a.y + dy),
rc AS (SELECT frame, i, i AS l FROM lc UNION SELECT n.frame, n.j, r.l FROM rc r JOIN nc n ON n.frame = r.frame AND n.i = r.i WHERE r.l < n.j),
ll AS (SELECT frame, i, min(l) AS l FROM rc GROUP BY frame, i),
sb AS (SELECT frame, l, min(x) * {SIDE} // {MAP} AS x0, min(y) * {SIDE} // {MAP} AS y0, (max(x) + 1) * {SIDE} // {MAP} AS x1, (max(y) + 1) * {SIDE} // {MAP} AS y1 FROM lc JOIN ll USING (frame, i) GROUP BY frame, l),
kb AS (SELECT frame, row_number() OVER (PARTITION BY frame ORDER BY l) - 1 AS region, x0 AS bx, y0 AS "by", x1 - x0 AS bw, y1 - y0 AS bh FROM sb WHERE x1 > x0 AND y1 > y0)"""


@query("interpreted_scores", f"""{DELTA_SQL.replace("WITH ", "WITH RECURSIVE ", 1)}, {SCORES_SQL}, {COARSE_SQL}, {types_sql("kb", "(frame, x, y) IN (SELECT (frame, x, y) FROM rf)")}
SELECT frame, region, bx, "by", bw, bh, n AS pixels, round(100.0::DOUBLE * n / {SIDE * SIDE}, 6) AS percentage, {PLACE_SQL} AS position, change_type FROM typed WHERE change_type <> 'rendering-noise'""")
def interpreted_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the gradient similarity is low, as the source of regions."""
    px = changed(spark, sf_dir)
    cells = similarity.gms(similarity.gradients(frame_pairs(spark, sf_dir), SIDE, SIDE)).select("frame", (F.col("x") - 1).alias("x"), (F.col("y") - 1).alias("y"), F.col("gms").alias("score"))
    found = interpreting.interpret(interpreting.from_scores(px, cells, MAP, MAP, SIDE, SIDE, LOW), SIDE, SIDE, moves=False)
    return found.select("frame", "region", "bx", "by", "bw", "bh", "pixels", F.round("percentage", 6).alias("percentage"), "position", "change_type")


@query("interpreted_regions")
def interpreted_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpreting.interpret(interpreting.from_differences(changed(spark, sf_dir), SIDE, SIDE), SIDE, SIDE)


def compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = pixeldiff.summary(plain_status(spark, sf_dir))
    return s.select("frame", F.when(F.col("diff_count") > 0, "pixel-diff").alias("reason"), "diff_count", "diff_percentage")


@query("region_summary")
def region_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts.summaries(compared(spark, sf_dir).filter("diff_count > 0"), interpreted_regions(spark, sf_dir))


@query("pair_verdicts")
def pair_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verdicts.verdicts(compared(spark, sf_dir).filter("diff_count > 0"), interpreted_regions(spark, sf_dir))


@query("threshold_gate", f"""{DELTA_SQL}, cnt AS (SELECT frame, count(*) FILTER (abs(delta) > {LIMIT}) AS n, 100.0::DOUBLE * count(*) FILTER (abs(delta) > {LIMIT}) / count(*) AS pct FROM d GROUP BY frame)
SELECT frame, n = 0 AS strict, n <= 70 AS within_pixels, pct <= 7.5 AS within_percent FROM cnt""")
def threshold_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = compared(spark, sf_dir)
    return c.select("frame", verdicts.passes("core").alias("strict"), verdicts.passes("core", 70).alias("within_pixels"), verdicts.passes("core", 7.5, "percent").alias("within_percent"))


@query("snapshot_ids", r"SELECT conv_id, turn, coalesce(nullif(lower(regexp_replace(regexp_replace(text, '[^a-zA-Z0-9\-_\s]', '', 'g'), '\s+', '-', 'g')), ''), 'snapshot') AS id FROM conversations")
def snapshot_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return c.select("conv_id", "turn", verdicts.snapshot_id(F.col("text")).alias("id"))


STATES_SQL = "bs AS (SELECT page_id AS id, md5(html) AS was FROM pages WHERE page_id % 7 <> 0), rc AS (SELECT page_id AS id, md5(CASE WHEN page_id % 5 = 0 THEN html || '!' ELSE html END) AS now FROM pages)"


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = spark.read.parquet(f"{sf_dir}/pages.parquet")
    received = p.select(F.col("page_id").alias("id"), F.md5(F.when(F.col("page_id") % 5 == 0, F.concat("html", F.lit("!"))).otherwise(F.col("html"))).alias("now"))
    return p.filter("page_id % 7 <> 0").select(F.col("page_id").alias("id"), F.md5("html").alias("was")), received


@query("snapshot_status", f"WITH {STATES_SQL} SELECT id, mode, CASE WHEN was IS NULL THEN CASE mode WHEN 'none' THEN 'failed' ELSE 'added' END WHEN was = now THEN 'matched' WHEN mode = 'all' THEN 'updated' ELSE 'failed' END AS status FROM rc LEFT JOIN bs USING (id), (VALUES ('all'), ('new'), ('none')) v(mode)")
def snapshot_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    before, received = _snapshots(spark, sf_dir)
    each = [verdicts.snapshot_states(before, received, F.col("was") == F.col("now"), mode).withColumn("mode", F.lit(mode)) for mode in ("all", "new", "none")]
    return each[0].unionByName(each[1]).unionByName(each[2])


@query("snapshot_promote", f"WITH {STATES_SQL} SELECT id, now AS digest FROM rc")
def snapshot_promote(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The baseline after everything received was taken over."""
    before, received = _snapshots(spark, sf_dir)
    states = verdicts.snapshot_states(before, received, F.col("was") == F.col("now"), "all")
    return verdicts.promoted(before.withColumnRenamed("was", "digest"), received.withColumnRenamed("now", "digest"), states)
