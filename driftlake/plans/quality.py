"""Queries of score maps, coarse masks, moves, and of how well metrics meet ratings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlake.functions import color
from driftlake.operators import evaluation, interpreting, pixeldiff, planes, regions, shifts, similarity, structdiff
from driftlake.plans import evaluation as boxes_of
from driftlake.plans.imaging import GRAY_SQL, _curve, _gms_sql, _linear, plain_status
from driftlake.plans.interpretation import CLOSED_SQL, KNOWN_SQL, changed, known_boxes
from driftlake.plans.registry import query
from driftlake.plans.scales import SCALES_SQL
from driftlake.sources.frames import FRAMES_SQL, SIDE, frame_pairs

MAP = SIDE - 2
LOW = 0.9


@query("score_map_regions", f"""{GRAY_SQL.replace('WITH ', 'WITH RECURSIVE ', 1)}, {_gms_sql('gr', SIDE)},
cl AS MATERIALIZED (SELECT frame, x - 1 AS x, y - 1 AS y, (y - 1) * {MAP} + x - 1 AS i FROM gs WHERE gms < {LOW}),
near AS MATERIALIZED (SELECT a.frame, a.i, b.i AS j FROM cl a, (VALUES (0, 1), (1, 0), (0, -1), (-1, 0)) o(dx, dy), cl b WHERE b.frame = a.frame AND b.x = a.x + dx AND b.y = a.y + dy),
reach AS (SELECT frame, i, i AS l FROM cl UNION SELECT n.frame, n.j, r.l FROM reach r JOIN near n ON n.frame = r.frame AND n.i = r.i WHERE r.l < n.j),
lb AS (SELECT frame, i, min(l) AS l FROM reach GROUP BY frame, i),
bx AS (SELECT frame, l // {MAP} * 4294967296 + l % {MAP} AS label, min(x) * {SIDE} // {MAP} AS x0, min(y) * {SIDE} // {MAP} AS y0, (max(x) + 1) * {SIDE} // {MAP} AS x1, (max(y) + 1) * {SIDE} // {MAP} AS y1 FROM cl JOIN lb USING (frame, i) GROUP BY frame, l)
SELECT frame, label, x0 AS bx, y0 AS "by", x1 - x0 AS bw, y1 - y0 AS bh FROM bx WHERE x1 > x0 AND y1 > y0""")
def score_map_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the gradient similarity falls under a floor."""
    cells = similarity.gms(similarity.gradients(frame_pairs(spark, sf_dir), SIDE, SIDE)).select("frame", (F.col("x") - 1).alias("x"), (F.col("y") - 1).alias("y"), F.col("gms").alias("score"))
    return regions.score_map_regions(cells, MAP, MAP, SIDE, SIDE, LOW)


INSIDE = 'x >= bx AND x < bx + bw AND y >= "by" AND y < "by" + bh'


@query("union_pixels", f"{CLOSED_SQL}, {KNOWN_SQL} SELECT frame, count(*) AS pixels FROM (SELECT DISTINCT cm.frame, x, y FROM cm JOIN kb ON kb.frame = cm.frame AND {INSIDE} WHERE changed) GROUP BY frame")
def union_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = changed(spark, sf_dir)
    return regions.union_pixels(px, known_boxes(px))


@query("refined_mask", f"""{CLOSED_SQL}, {KNOWN_SQL}, ins AS (SELECT cm.frame, region, x, y, abs(delta) AS size FROM cm JOIN kb ON kb.frame = cm.frame AND {INSIDE}),
ft AS (SELECT frame, region FROM ins GROUP BY ALL HAVING max(size) < 100 AND max(size) > 0),
rf AS (SELECT frame, x, y FROM ins WHERE size >= 100 UNION SELECT frame, x, y FROM ins SEMI JOIN ft USING (frame, region))
SELECT frame, count(*) AS pixels, CAST(sum(y * {SIDE} + x) AS BIGINT) AS places FROM rf GROUP BY frame""")
def refined_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = changed(spark, sf_dir)
    return regions.refined(px, known_boxes(px)).groupBy("frame").agg(F.count("*").alias("pixels"), F.sum(F.col("y") * SIDE + F.col("x")).cast("long").alias("places"))


# A tile of each embedding stands at one place of a gray image and at another of the next; of every third the second one is negated, which is no move.
MOVED = 40


def moved_tiles(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(pixels, boxes): an image pair for each embedding of 64 values or more, of which the first 64 make a tile of 8 x 8."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet").filter("size(embedding) >= 64").select(F.col("vec_id").alias("frame"), F.slice("embedding", 1, 64).alias("v"))
    f, x, y = F.col("frame"), F.col("x"), F.col("y")
    grid = e.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(MOVED * MOVED - 1)))).withColumn("x", F.col("i") % MOVED).withColumn("y", F.expr(f"i div {MOVED}"))
    ax, ay, bx, by = (f % 9).cast("int"), (f % 7).cast("int"), (20 + f % 11).cast("int"), (22 + f % 8).cast("int")
    level = lambda dx, dy: F.greatest(F.lit(0), F.least(F.lit(255), F.floor((F.get("v", (dy * 8 + dx).cast("int")).cast("double") + 0.5) * 255))).cast("int")
    within = lambda dx, dy: (dx >= 0) & (dx < 8) & (dy >= 0) & (dy < 8)
    one = F.when(within(x - ax, y - ay), level(x - ax, y - ay)).otherwise(128)
    there = level(x - bx, y - by)
    two = F.when(within(x - bx, y - by), F.when(f % 3 == 0, 255 - there).otherwise(there)).otherwise(128)
    px = grid.select("frame", "x", "y", *[one.alias(f"{c}1") for c in "rgb"], F.lit(255).alias("a1"), *[two.alias(f"{c}2") for c in "rgb"], F.lit(255).alias("a2"))
    boxes = e.select("frame", F.explode(F.array(*[F.struct(F.lit(n).alias("region"), a.alias("bx"), b.alias("by"), F.lit(w).alias("bw"), F.lit(8).alias("bh")) for n, a, b, w in ((0, ax, ay, 8), (1, bx, by, 8), (2, bx, ay, 3))])).alias("b")).select("frame", "b.*")
    return px, boxes.withColumn("change_type", F.when(F.col("region") == 2, "color-change").otherwise("content-change"))


MOVED_SQL = """tl AS (SELECT vec_id AS frame, list_transform(embedding[1:64], lambda v: CAST(greatest(0, least(255, floor((CAST(v AS DOUBLE) + 0.5) * 255))) AS INT)) AS t FROM embeddings WHERE len(embedding) >= 64)"""


@query("shift_pairs", f"WITH {MOVED_SQL} SELECT frame, 0 AS region, 1 AS partner, 1.0::DOUBLE AS score FROM tl WHERE frame % 3 <> 0 AND list_var_pop(t) >= 4")
def shift_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matched halves of moves."""
    px, boxes = moved_tiles(spark, sf_dir)
    return shifts.shift_pairs(px, boxes).withColumn("score", F.round("score", 9))


@query("shift_candidates", f"""WITH {MOVED_SQL}, bx(region, bw, bh, kind) AS (VALUES (0, 8, 8, 0), (1, 8, 8, 0), (2, 3, 8, 1))
SELECT frame, a.region, b.region AS partner FROM tl, bx a JOIN bx b ON a.region < b.region AND a.bw / b.bw BETWEEN 0.55 AND 1.82 AND a.bh / b.bh BETWEEN 0.55 AND 1.82 AND NOT (a.kind = 1 AND b.kind = 1)""")
def shift_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shifts.candidates(moved_tiles(spark, sf_dir)[1])


@query("interpreted_moves", f"WITH {MOVED_SQL} SELECT frame, count(*) FILTER (frame % 3 <> 0) AS shifts FROM tl, (VALUES (0), (1)) v(i) WHERE list_var_pop(t) >= 4 GROUP BY frame")
def interpreted_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of the regions of each image are halves of a move."""
    px, boxes = moved_tiles(spark, sf_dir)
    px = color.with_delta(px, color.channels("1"), color.channels("2"), color.offset(MOVED))
    found = interpreting.interpret(interpreting.from_boxes(px, boxes.filter("region < 2")), MOVED, MOVED)
    return boxes.select("frame").distinct().join(found.filter("change_type = 'shift'").groupBy("frame").count(), "frame", "left").select("frame", F.coalesce("count", F.lit(0)).alias("shifts"))


@query("chroma_share", f"""WITH {FRAMES_SQL}, yy AS (SELECT *, r1 * 0.299::DOUBLE + g1 * 0.587::DOUBLE + b1 * 0.114::DOUBLE AS y1, r2 * 0.299::DOUBLE + g2 * 0.587::DOUBLE + b2 * 0.114::DOUBLE AS y2 FROM px),
s AS (SELECT frame, sum(abs(y1 - y2)) AS l, sum((abs((b1 - y1) - (b2 - y2)) * 0.564::DOUBLE + abs((r1 - y1) - (r2 - y2)) * 0.713::DOUBLE) * 0.5::DOUBLE) AS c FROM yy GROUP BY frame)
SELECT frame, round(CASE WHEN l + c > 0 THEN c / (l + c) ELSE 0 END, 6) AS chroma_share FROM s""")
def chroma_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.chroma_share(frame_pairs(spark, sf_dir)).withColumn("chroma_share", F.round("chroma_share", 6))


@query("scale_statistics", f"{SCALES_SQL} SELECT k AS frame, 0 AS scale, round(avg(ssim), 6) AS ssim, round(avg(cs), 6) AS structure FROM fm GROUP BY k UNION ALL SELECT k, 1, round(avg(ssim), 6), round(avg(cs), 6) FROM cm GROUP BY k")
def scale_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = planes.scale_statistics(frame_pairs(spark, sf_dir), 2)
    return s.select("frame", "scale", F.round("ssim", 6).alias("ssim"), F.round("structure", 6).alias("structure"))


@query("method_dispatch", f"{SCALES_SQL} SELECT k AS frame, 'msssim' AS method, CASE WHEN k % 9 = 4 THEN 0 ELSE round(cs * 0.3 + ssim * 0.7, 6) END AS score FROM mean0 JOIN mean1 USING (k)")
def method_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A metric by its name, where every ninth pair differs in size."""
    px = frame_pairs(spark, sf_dir)
    odd = px.filter("frame % 9 = 4").select("frame").distinct()
    return planes.compare(px, "msssim", odd, weights=(0.3, 0.7), product=False).withColumn("score", F.round("score", 6))


@query("lab_bytes", f"""WITH {FRAMES_SQL}, lin AS (SELECT frame, {_linear('r2')} AS r, {_linear('g2')} AS g, {_linear('b2')} AS b FROM px),
xyz AS (SELECT frame, (0.4124564::DOUBLE * r + 0.3575761::DOUBLE * g + 0.1804375::DOUBLE * b) / 0.95047::DOUBLE AS x, 0.2126729::DOUBLE * r + 0.7151522::DOUBLE * g + 0.0721750::DOUBLE * b AS y, (0.0193339::DOUBLE * r + 0.1191920::DOUBLE * g + 0.9503041::DOUBLE * b) / 1.08883::DOUBLE AS z FROM lin),
f AS (SELECT frame, {_curve('x')} AS x, {_curve('y')} AS y, {_curve('z')} AS z FROM xyz)
SELECT frame, round(avg((116 * y - 16) * 2.55), 5) AS l, round(avg(500 * (x - y) + 128), 5) AS a, round(avg(200 * (y - z) + 128), 5) AS b FROM f GROUP BY frame""")
def lab_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    l, a, b = color.lab_bytes(color.channels("2"))
    return frame_pairs(spark, sf_dir).groupBy("frame").agg(F.round(F.avg(l), 5).alias("l"), F.round(F.avg(a), 5).alias("a"), F.round(F.avg(b), 5).alias("b"))


GREEDY_SQL = f"""WITH RECURSIVE {boxes_of.BOXES_SQL},
rk AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY "case" ORDER BY same DESC, iou DESC, truth_id, found_id) AS n FROM io),
gr AS (SELECT DISTINCT "case", 0::BIGINT AS n, []::BIGINT[] AS ts, []::BIGINT[] AS fs, false AS got FROM io
 UNION ALL SELECT rk."case", rk.n, CASE WHEN list_contains(ts, truth_id) OR list_contains(fs, found_id) THEN ts ELSE list_append(ts, truth_id) END, CASE WHEN list_contains(ts, truth_id) OR list_contains(fs, found_id) THEN fs ELSE list_append(fs, found_id) END,
  NOT (list_contains(ts, truth_id) OR list_contains(fs, found_id)) FROM gr JOIN rk ON rk."case" = gr."case" AND rk.n = gr.n + 1),
mt AS (SELECT rk."case", truth_id, found_id, same, iou FROM rk JOIN gr ON gr."case" = rk."case" AND gr.n = rk.n WHERE got),
al AS (SELECT * FROM mt UNION ALL SELECT "case", id, NULL, true, 1 FROM truth WHERE NOT expected AND id NOT IN (SELECT truth_id FROM io)),
ms AS (SELECT "case", id FROM truth WHERE id NOT IN (SELECT truth_id FROM al)), ex AS (SELECT "case", id FROM found WHERE id NOT IN (SELECT found_id FROM mt))"""


@query("iou_greedy", f'{GREEDY_SQL} SELECT "case", truth_id, found_id, same, round(iou, 9) AS iou FROM mt')
def iou_greedy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-to-one matches, best first."""
    return evaluation.match(evaluation.iou_pairs(*boxes_of.boxes(spark, sf_dir))).withColumn("iou", F.round("iou", 9))


@query("outcome_totals", f"{GREEDY_SQL} SELECT (SELECT count(*) FROM al) AS matched, (SELECT count(*) FROM al WHERE NOT same) AS wrong_type, (SELECT count(*) FROM ms) AS missed, (SELECT count(*) FROM ex) AS extra")
def outcome_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.outcome_totals(*evaluation.match_cases(*boxes_of.boxes(spark, sf_dir)))


@query("outcome_lines", f"""{GREEDY_SQL} SELECT "case", CASE WHEN same THEN 'match' ELSE 'confused' END AS kind, truth_id, found_id, round(iou, 9) AS iou FROM al
UNION ALL SELECT "case", 'missed', id, NULL, NULL FROM ms UNION ALL SELECT "case", 'extra', NULL, id, NULL FROM ex""")
def outcome_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.flattened(*evaluation.match_cases(*boxes_of.boxes(spark, sf_dir))).withColumn("iou", F.round("iou", 9))


@query("large_boxes", f'WITH {boxes_of.BOXES_SQL} SELECT (SELECT count(*) FROM truth WHERE box.width * box.height >= 150) AS truths, (SELECT count(*) FROM found WHERE box.width * box.height >= 150) AS found')
def large_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many boxes an evaluation of larger regions takes."""
    t, f = (evaluation.large_enough(x, 150) for x in boxes_of.boxes(spark, sf_dir))
    return t.agg(F.count("*").alias("truths")).join(f.agg(F.count("*").alias("found")), F.lit(True))


RATED = "concat('set/I', lpad(CAST(event_id % 81 + 1 AS STRING), 2, '0'), '_', lpad(CAST(event_id % 25 + 1 AS STRING), 2, '0'), '_', lpad(CAST(event_id % 5 + 1 AS STRING), 2, '0'), '.png')"


def _rated(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.expr(RATED).alias("path"), F.col("value").alias("rated"), (F.col("value") * 0.01 + F.col("event_id") % 7).alias("predicted"))
    return evaluation.rated_pairs(e)


RATED_SQL = "rt AS (SELECT event_id % 81 + 1 AS reference, event_id % 25 + 1 AS distortion, event_id % 5 + 1 AS level, (event_id % 81 + 1) % 5 AS fold, value AS rated, value * 0.01 + event_id % 7 AS predicted FROM events)"


@query("rated_folds", f"WITH {RATED_SQL} SELECT fold, count(*) AS n, count(DISTINCT reference) AS references_, round(corr(predicted, rated), 9) AS correlation FROM rt GROUP BY fold")
def rated_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rated(spark, sf_dir).groupBy("fold").agg(F.count("*").alias("n"), F.countDistinct("reference").alias("references_"), F.round(F.corr("predicted", "rated"), 9).alias("correlation"))


@query("quality_correlations", f"WITH {RATED_SQL} SELECT distortion, round(corr(CASE WHEN distortion % 2 = 0 THEN -predicted ELSE predicted END, rated), 9) AS correlation FROM rt GROUP BY distortion")
def quality_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlations after distances were turned, so that more is better for every metric."""
    q = F.when(F.col("distortion") % 2 == 0, evaluation.as_quality(F.col("predicted"), True)).otherwise(evaluation.as_quality(F.col("predicted"), False))
    return _rated(spark, sf_dir).withColumn("q", q).groupBy("distortion").agg(F.round(F.corr("q", "rated"), 9).alias("correlation"))


@query("distortion_polarity", f"WITH {RATED_SQL} SELECT distortion, round(corr(predicted, rated), 9) AS correlation, distortion % 2 = 0 AS declared, CASE WHEN distortion % 2 = 0 THEN corr(predicted, rated) < 0 ELSE corr(predicted, rated) > 0 END AS holds FROM rt GROUP BY distortion")
def distortion_polarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Does each distortion's metric turn the way it declares?"""
    return evaluation.polarity(_rated(spark, sf_dir).withColumn("distance", F.col("distortion") % 2 == 0), "distortion").withColumn("correlation", F.round("correlation", 9))


# ratings on a logistic of the value, which the fit meets: no error is left
@query("logistic_fits", "SELECT event_type, count(*) AS n, 1.0::DOUBLE AS plcc, 0.0::DOUBLE AS rmse FROM events WHERE value IS NOT NULL GROUP BY event_type")
def logistic_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlation and error of a fitted logistic for each kind of event."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", F.col("value").alias("predicted"), (F.lit(5) / (1 + F.exp(-(F.col("value") - 100) / 40))).alias("rated"))
    return evaluation.fitted(e, "event_type").select("event_type", "n", F.round("plcc", 4).alias("plcc"), F.round("rmse", 1).alias("rmse"))


RICH_SQL = """rc AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'date' WHEN 1 THEN 'regexp' WHEN 2 THEN 'number' ELSE 'text' END AS kind,
 CASE event_id % 4 WHEN 0 THEN CASE WHEN event_id % 3 = 0 THEN 'never' ELSE '2024-01-0' || (event_id % 5 + 1) END WHEN 1 THEN '/a+/' || CASE WHEN event_id % 3 = 0 THEN 'g' ELSE '' END WHEN 2 THEN (event_id % 5) || '.0' ELSE event_type END AS one,
 CASE event_id % 4 WHEN 0 THEN CASE WHEN event_id % 2 = 0 AND event_id % 3 = 0 THEN 'none' ELSE '2024-01-03 00:00:00' END WHEN 1 THEN '/a+/' || CASE WHEN event_id % 5 = 0 THEN 'g' ELSE '' END WHEN 2 THEN (event_id % 3) || '' ELSE 'click' END AS two FROM events)"""


@query("rich_equality", f"""WITH {RICH_SQL} SELECT event_id, kind, CASE kind WHEN 'date' THEN TRY_CAST(one AS TIMESTAMP) IS NOT DISTINCT FROM TRY_CAST(two AS TIMESTAMP) WHEN 'number' THEN CAST(one AS DOUBLE) = CAST(two AS DOUBLE) ELSE one = two END AS same FROM rc""")
def rich_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, lit = F.col("event_id"), F.lit
    one = F.when(i % 4 == 0, F.when(i % 3 == 0, "never").otherwise(F.concat(lit("2024-01-0"), (i % 5 + 1).cast("string")))).when(i % 4 == 1, F.concat(lit("/a+/"), F.when(i % 3 == 0, "g").otherwise(""))).when(i % 4 == 2, F.concat((i % 5).cast("string"), lit(".0"))).otherwise(F.col("event_type"))
    two = F.when(i % 4 == 0, F.when((i % 2 == 0) & (i % 3 == 0), "none").otherwise("2024-01-03 00:00:00")).when(i % 4 == 1, F.concat(lit("/a+/"), F.when(i % 5 == 0, "g").otherwise(""))).when(i % 4 == 2, (i % 3).cast("string")).otherwise("click")
    kind = F.when(i % 4 == 0, "date").when(i % 4 == 1, "regexp").when(i % 4 == 2, "number").otherwise("text")
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", kind.alias("kind"), one.alias("one"), two.alias("two"))
    return e.select("event_id", "kind", structdiff.rich_equal(F.col("kind"), F.col("one"), F.col("two")).alias("same"))


@query("diff_mask_picture", f"""{CLOSED_SQL} SELECT frame, count(*) FILTER (changed) AS painted, 255 * count(*) FILTER (changed) AS alpha FROM cm GROUP BY frame""")
def diff_mask_picture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences alone: whatever else is clear."""
    pic = pixeldiff.picture(plain_status(spark, sf_dir), diff=(255, 0, 0), darker=(255, 0, 200), mask=True)
    return pic.groupBy("frame").agg(F.count_if(F.col("r") == 255).alias("painted"), F.sum("a").cast("long").alias("alpha"))
