"""Queries that evaluate derived detections."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlake.operators import evaluation
from driftlake.plans.registry import query
from driftlake.sources import cases
from driftlake.sources.scratch import new_path

NAMES = "[" + ", ".join(f"'{t}'" for t in evaluation.TYPES) + "]"
# Actual and predicted types from the embeddings' labels: one in five is off by one, some are missed, some are false alarms.
PAIRS_SQL = f"pairs AS (SELECT vec_id, CASE WHEN vec_id % 19 <> 0 THEN {NAMES}[label % 6 + 1] END AS actual, CASE WHEN vec_id % 17 <> 0 THEN {NAMES}[(label + CASE WHEN vec_id % 5 = 0 THEN 1 ELSE 0 END) % 6 + 1] END AS predicted FROM embeddings)"
SCORES_SQL = """types AS (SELECT DISTINCT type FROM (SELECT actual AS type FROM pairs UNION ALL SELECT predicted FROM pairs) WHERE type IS NOT NULL),
cnt AS (SELECT type, (SELECT count(*) FROM pairs WHERE actual = type) AS support, (SELECT count(*) FROM pairs WHERE predicted = type) AS claimed, (SELECT count(*) FROM pairs WHERE predicted = type AND actual = type) AS hits FROM types),
pr AS (SELECT type, CASE WHEN claimed = 0 THEN 0 ELSE hits / claimed END AS precision, CASE WHEN support = 0 THEN 0 ELSE hits / support END AS recall, support FROM cnt),
sc AS (SELECT type, precision, recall, CASE WHEN precision + recall = 0 THEN 0 ELSE 2 * precision * recall / (precision + recall) END AS f1, support FROM pr)"""


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*[F.lit(t) for t in evaluation.TYPES])
    off = F.when(F.col("vec_id") % 5 == 0, 1).otherwise(0)
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(
        "vec_id", F.when(F.col("vec_id") % 19 != 0, F.get(names, F.col("label") % 6)).alias("actual"), F.when(F.col("vec_id") % 17 != 0, F.get(names, (F.col("label") + off) % 6)).alias("predicted")
    )


@query("confusion_matrix", f"WITH {PAIRS_SQL} SELECT actual, " + ", ".join(f"count(*) FILTER (predicted = '{t}') AS \"{t}\"" for t in evaluation.TYPES) + ", count(*) FILTER (predicted IS NULL) AS missed FROM pairs WHERE actual IS NOT NULL GROUP BY actual")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.confusion(pairs(spark, sf_dir))


@query("class_f1", f"WITH {PAIRS_SQL}, {SCORES_SQL} SELECT type, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, support FROM sc")
def class_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.class_scores(pairs(spark, sf_dir)).select("type", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")], "support")


@query("macro_f1", f"WITH {PAIRS_SQL}, {SCORES_SQL} SELECT round(avg(f1) FILTER (support > 0), 9) AS macro_f1, round(sum(f1 * support) / sum(support), 9) AS weighted_f1 FROM sc")
def macro_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.averaged_f1(evaluation.class_scores(pairs(spark, sf_dir))).select(F.round("macro_f1", 9).alias("macro_f1"), F.round("weighted_f1", 9).alias("weighted_f1"))


@query("worst_confusions", f"WITH {PAIRS_SQL} SELECT actual, predicted, count(*) AS n FROM pairs WHERE actual <> predicted GROUP BY ALL ORDER BY n DESC, actual, predicted LIMIT 3")
def worst_confusions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.worst_confusions(pairs(spark, sf_dir), 3)


@query("quality_gates", f"""WITH {PAIRS_SQL}, {SCORES_SQL}, bs AS (SELECT type, 0.9::DOUBLE AS f1, 1 AS support FROM types),
rs AS (SELECT printf('%s F1 %.3f fell below floor %.3f', type, f1, 0.8::DOUBLE) AS r FROM sc WHERE f1 < 0.8 UNION ALL SELECT printf('%s F1 drop %.3f exceeded tolerance %.3f', type, 0.9::DOUBLE - f1, 0.12::DOUBLE) FROM sc WHERE 0.9 - f1 > 0.12
 UNION ALL SELECT printf('macro F1 %.3f fell below floor %.3f', m, 0.95::DOUBLE) FROM (SELECT avg(f1) AS m FROM sc WHERE support > 0) WHERE m < 0.95)
SELECT count(r) = 0 AS passed, coalesce(string_agg(r, '; ' ORDER BY r), '') AS reasons, round((SELECT avg(f1) FROM sc WHERE support > 0) - 0.9, 9) AS macro_delta FROM rs""")
def quality_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = evaluation.class_scores(pairs(spark, sf_dir))
    before = scores.select("type", F.lit(0.9).alias("f1"), F.lit(1).alias("support"))
    floors = scores.select("type", F.lit(0.8).alias("floor"), F.lit(0.12).alias("max_drop"))
    return evaluation.gates(scores, before, floors, macro_floor=0.95).withColumn("macro_delta", F.round("macro_delta", 9))


BOX_T = "struct_pack(x := CAST(vec_id * 37 % 80 AS INT), y := CAST(vec_id * 53 % 60 AS INT), width := CAST(10 + vec_id % 15 AS INT), height := CAST(8 + vec_id % 11 AS INT))"
BOX_P = "struct_pack(x := CAST(vec_id * 37 % 80 + vec_id % 5 AS INT), y := CAST(vec_id * 53 % 60 + vec_id % 3 AS INT), width := CAST(10 + vec_id % 13 AS INT), height := CAST(8 + vec_id % 9 AS INT))"
BOXES_SQL = f"""{PAIRS_SQL}, truth AS (SELECT vec_id // 20 AS "case", vec_id AS id, actual AS type, {BOX_T} AS box, vec_id % 7 <> 0 AS expected FROM pairs WHERE actual IS NOT NULL),
found AS (SELECT vec_id // 20 AS "case", vec_id AS id, predicted AS type, {BOX_P} AS box FROM pairs WHERE predicted IS NOT NULL),
ov AS (SELECT t."case", t.id AS truth_id, p.id AS found_id, t.type = p.type AS same, least(t.box.x + t.box.width, p.box.x + p.box.width) - greatest(t.box.x, p.box.x) AS w, least(t.box.y + t.box.height, p.box.y + p.box.height) - greatest(t.box.y, p.box.y) AS h,
       t.box.width * t.box.height + p.box.width * p.box.height AS areas FROM truth t JOIN found p USING ("case")),
io AS (SELECT "case", truth_id, found_id, same, w * h / (areas - w * h) AS iou FROM ov WHERE w > 0 AND h > 0 AND w * h / (areas - w * h) >= 0.3)"""


def boxes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p, i = pairs(spark, sf_dir), F.col("vec_id")
    whole = lambda c, n: c.cast("int").alias(n)
    tb = F.struct(whole(i * 37 % 80, "x"), whole(i * 53 % 60, "y"), whole(10 + i % 15, "width"), whole(8 + i % 11, "height"))
    pb = F.struct(whole(i * 37 % 80 + i % 5, "x"), whole(i * 53 % 60 + i % 3, "y"), whole(10 + i % 13, "width"), whole(8 + i % 9, "height"))
    case = F.expr("vec_id div 20").alias("case")
    truth = p.filter("actual IS NOT NULL").select(case, i.alias("id"), F.col("actual").alias("type"), tb.alias("box"), (i % 7 != 0).alias("expected"))
    return truth, p.filter("predicted IS NOT NULL").select(case, i.alias("id"), F.col("predicted").alias("type"), pb.alias("box"))


@query("iou_pairs", f'WITH {BOXES_SQL} SELECT "case", truth_id, found_id, same, round(iou, 9) AS iou FROM io')
def iou_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluation.iou_pairs(*boxes(spark, sf_dir)).withColumn("iou", F.round("iou", 9))


@query("expected_absent", f'WITH {BOXES_SQL} SELECT "case", id FROM truth WHERE NOT expected AND id NOT IN (SELECT truth_id FROM io)')
def expected_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    matched = evaluation.match_cases(*boxes(spark, sf_dir))[0]
    return matched.filter("found_id IS NULL").select("case", F.col("truth_id").alias("id"))


RATED_SQL = "rt AS (SELECT event_type, CAST(extract(hour FROM ts) AS DOUBLE) AS a, round(value / 5) AS b FROM events WHERE value IS NOT NULL)"


@query("rank_correlations", f"""WITH {RATED_SQL}, en AS (SELECT event_type FROM rt GROUP BY 1 HAVING count(*) >= 3), r2 AS (SELECT * FROM rt SEMI JOIN en USING (event_type)),
rk AS (SELECT *, rank() OVER (PARTITION BY event_type ORDER BY a) + (count(*) OVER (PARTITION BY event_type, a) - 1) / 2 AS ra, rank() OVER (PARTITION BY event_type ORDER BY b) + (count(*) OVER (PARTITION BY event_type, b) - 1) / 2 AS rb FROM r2),
ce AS (SELECT event_type, a, b, count(*) AS c FROM r2 GROUP BY ALL),
pq AS (SELECT p.event_type, p.c * q.c AS c, sign(q.a - p.a) AS da, sign(q.b - p.b) AS db FROM ce p JOIN ce q ON p.event_type = q.event_type AND (p.a < q.a OR (p.a = q.a AND p.b < q.b)) UNION ALL SELECT event_type, c * (c - 1) // 2, 0, 0 FROM ce),
kt AS (SELECT event_type, sum(c * da * db) / sqrt(CAST(sum(c * abs(da * db)) + sum(c) FILTER (da = 0) AS DOUBLE) * (sum(c * abs(da * db)) + sum(c) FILTER (db = 0))) AS kendall FROM pq GROUP BY 1)
SELECT event_type, count(*) AS n, round(corr(a, b), 9) AS pearson, round(corr(ra, rb), 9) AS spearman, round(any_value(kendall), 9) AS kendall FROM rk JOIN kt USING (event_type) GROUP BY event_type""")
def rank_correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet").filter("value IS NOT NULL").select("event_type", F.hour("ts").alias("a"), F.round(F.col("value") / 5).alias("b"))
    return evaluation.correlations(e, "a", "b", "event_type").select("event_type", "n", *[F.round(c, 9).alias(c) for c in ("pearson", "spearman", "kendall")])


EXACT_SQL = "rt AS (SELECT event_type, CAST(user_id AS DOUBLE) + value / 1000 AS a, value AS b FROM events WHERE value IS NOT NULL)"


@query("rank_correlations_continuous", f"""WITH {EXACT_SQL}, rk AS (SELECT *, rank() OVER (PARTITION BY event_type ORDER BY a) + (count(*) OVER (PARTITION BY event_type, a) - 1) / 2 AS ra, rank() OVER (PARTITION BY event_type ORDER BY b) + (count(*) OVER (PARTITION BY event_type, b) - 1) / 2 AS rb FROM rt),
pq AS (SELECT p.event_type, sum(sign(q.a - p.a) * sign(q.b - p.b)) AS s, count(*) FILTER (p.a = q.a) AS ta, count(*) FILTER (p.b = q.b) AS tb, count(*) FILTER (p.a <> q.a AND p.b <> q.b) AS n0 FROM (SELECT *, row_number() OVER () AS i FROM rt) p JOIN (SELECT *, row_number() OVER () AS i FROM rt) q ON p.event_type = q.event_type AND p.i < q.i GROUP BY p.event_type)
SELECT event_type, count(*) AS n, round(corr(a, b), 9) AS pearson, round(corr(ra, rb), 9) AS spearman, round(any_value(s / sqrt(CAST(n0 + ta AS DOUBLE) * (n0 + tb))), 9) AS kendall FROM rk JOIN pq USING (event_type) GROUP BY event_type HAVING count(*) >= 3""")
def rank_correlations_continuous(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of values that hardly ever repeat."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").filter("value IS NOT NULL").select("event_type", (F.col("user_id").cast("double") + F.col("value") / 1000).alias("a"), F.col("value").alias("b"))
    return evaluation.correlations(e, "a", "b", "event_type").select("event_type", "n", *[F.round(c, 9).alias(c) for c in ("pearson", "spearman", "kendall")])


# A manifest: an order is a case, its line items are regions.  Some lines are cut off, some tiers and types unknown, some masks missing.
DECLARED = ("Addition", "Deletion", "Shift", "ColorChange", "ContentChange", "RenderingNoise", "Redesign")
CASES_SQL = f"""rg AS (SELECT l_orderkey AS k, count(*) AS n, bool_or(l_partkey % 61 = 0) AS odd_type, bool_or(l_suppkey % 37 = 0 AND l_partkey % 61 <> 0 AND l_partkey % 5 <> 0) AS flat, bool_or(l_partkey % 5 = 0 AND l_partkey % 61 <> 0 AND l_linenumber > 3) AS lost FROM lineitem GROUP BY 1),
ca AS (SELECT o_orderkey AS k, coalesce(n, 0) AS n, CASE WHEN o_orderkey % 50 = 7 THEN 'not a case' WHEN o_orderkey % 31 = 0 THEN 'no image' WHEN o_orderkey % 40 = 3 THEN 'unknown tier odd' WHEN odd_type OR flat OR lost THEN 'region' END AS error,
  CASE WHEN o_orderkey % 50 = 7 OR o_orderkey % 40 = 3 THEN 'stress' WHEN o_orderkey % 4 = 0 THEN 'regression' WHEN o_orderkey % 4 = 1 THEN 'gate' ELSE 'stress' END AS tier FROM orders LEFT JOIN rg ON k = o_orderkey)"""


def manifest(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The cases of a manifest written beforehand, and their regions."""
    li, k = spark.read.parquet(f"{sf_dir}/lineitem.parquet"), F.col("o_orderkey")
    p, s = F.col("l_partkey"), F.col("l_suppkey")
    named = F.when(p % 61 == 0, "Mystery").otherwise(F.get(F.array(*[F.lit(n) for n in DECLARED]), (p % len(DECLARED)).cast("int")))
    box = F.when(p % 5 != 0, F.struct((p % 50).cast("int").alias("x"), (s % 50).cast("int").alias("y"), F.when(s % 37 == 0, 0).otherwise(7).alias("width"), F.lit(9).alias("height")))
    mask = F.when(p % 5 == 0, F.concat(F.lit("m"), F.when(F.col("l_linenumber") <= 3, F.col("l_linenumber").cast("string")).otherwise("x")))
    region = F.struct(named.alias("change_type"), box.alias("bbox"), mask.alias("mask_path"))
    of = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.collect_list(region).alias("regions"))
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").join(of, "o_orderkey", "left")
    tier = F.when(k % 40 == 3, "odd").when(k % 4 == 0, "regression").when(k % 4 == 1, "gate")
    case = F.to_json(F.struct(F.concat(F.lit("o"), k.cast("string")).alias("name"), F.lit("a.png").alias("img1"), F.when(k % 31 != 0, "b.png").alias("img2"), tier.alias("tier"), "regions"))
    path = new_path(spark, "cases")
    o.select(F.when(k % 50 == 7, F.substring(case, F.lit(1), F.floor(F.length(case) / 2).cast("int"))).otherwise(case).alias("value")).write.text(path)
    masks = spark.createDataFrame([(f"m{n}", 0, 0, 4, 5) for n in (1, 2, 3)], "mask string, bx int, by int, bw int, bh int")
    return cases.read(spark, path, {"Redesign": "ContentChange"}, "stress", masks)


@query("verification_totals", f"WITH {CASES_SQL} SELECT tier, count(*) AS cases, count(error) AS errors, CAST(coalesce(sum(n) FILTER (error IS NULL), 0) AS BIGINT) AS regions FROM ca GROUP BY tier")
def verification_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cases.totals(manifest(spark, sf_dir)[0])


@query("verification_errors", f"WITH {CASES_SQL} SELECT error AS error, count(*) AS n FROM ca WHERE error IS NOT NULL GROUP BY error")
def verification_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors by kind; those of regions together."""
    found = manifest(spark, sf_dir)[0].filter("error IS NOT NULL")
    known = F.col("error").isin("not a case", "no image", "unknown tier odd")
    return found.groupBy(F.when(known, F.col("error")).otherwise("region").alias("error")).agg(F.count("*").alias("n"))


@query("verification_regions", f"""WITH {CASES_SQL}, ok AS (SELECT k FROM ca WHERE error IS NULL) SELECT ['addition', 'deletion', 'shift', 'color-change', 'content-change', 'rendering-noise', 'content-change'][l_partkey % 7 + 1] AS type, count(*) AS n,
CAST(sum(CASE WHEN l_partkey % 5 = 0 THEN 20 ELSE 63 END) AS BIGINT) AS area FROM lineitem JOIN ok ON k = l_orderkey GROUP BY 1""")
def verification_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the cases without errors ask for, by type."""
    return manifest(spark, sf_dir)[1].groupBy("type").agg(F.count("*").alias("n"), F.sum(F.col("box.width") * F.col("box.height")).alias("area"))
