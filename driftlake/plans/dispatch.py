"""Queries of comparison by name, given boxes and evaluation modes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlake.functions import color
from driftlake.operators import dispatch, pixeldiff
from driftlake.plans import evaluation as boxes_of
from driftlake.plans.imaging import DELTA_SQL, FADE, LIMIT, plain_status
from driftlake.plans.registry import ORACLE, query
from driftlake.sources.frames import SIDE, frame_pairs


def _score_sql(name: str, method: str, column: str = "score", worst: int = 0) -> str:
    return f"SELECT frame, '{method}' AS method, NULL::BIGINT AS diff_count, NULL::DOUBLE AS diff_percentage, CASE WHEN frame % 9 = 4 THEN {worst} ELSE {column} END AS score FROM ({ORACLE[name]})"


@query("comparison_methods", f"""SELECT frame, 'core' AS method, CASE WHEN frame % 9 = 4 THEN {SIDE * SIDE} ELSE diff_count END AS diff_count, CASE WHEN frame % 9 = 4 THEN 100 ELSE diff_percentage END AS diff_percentage, NULL::DOUBLE AS score
 FROM ({ORACLE['pixel_diff_severity']}) UNION ALL {_score_sql('gaussian_ssim', 'ssim')} UNION ALL {_score_sql('gmsd', 'gmsd', 'gmsd', 1)} UNION ALL {_score_sql('ms_ssim', 'msssim')}""")
def comparison_methods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Methods by name, where every ninth pair differs in size."""
    px = frame_pairs(spark, sf_dir)
    odd = px.filter("frame % 9 = 4").select("frame").distinct()
    runs = [dispatch.compare(px, m, SIDE, SIDE, odd, **({"weights": (0.3, 0.7)} if m == "msssim" else {})) for m in ("core", "ssim", "gmsd", "msssim")]
    out = runs[0]
    for r in runs[1:]:
        out = out.unionByName(r)
    return out.withColumn("score", F.round("score", 6))


@query("box_validation", f"""WITH b AS (SELECT o_orderkey AS k, o_orderkey % 40 - 4 AS bx, CASE WHEN o_orderkey % 7 = 6 THEN NULL ELSE o_orderkey % 30 END AS "by", o_orderkey % 9 AS bw, o_orderkey % 5 + 1 AS bh FROM orders)
SELECT k AS o_orderkey, CASE WHEN "by" IS NULL THEN 'incomplete box' WHEN bw <= 0 THEN 'empty box' WHEN bx < 0 OR bx + bw > {SIDE} OR "by" + bh > {SIDE} THEN 'box outside the image' END AS fault FROM b""")
def box_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    b = spark.read.parquet(f"{sf_dir}/orders.parquet").select(k, (k % 40 - 4).alias("bx"), F.when(k % 7 != 6, k % 30).alias("by"), (k % 9).alias("bw"), (k % 5 + 1).alias("bh"))
    return b.select("o_orderkey", dispatch.box_fault(SIDE, SIDE).alias("fault"))


@query("recolored_picture", f"""{DELTA_SQL}, f AS (SELECT *, {FADE} AS v, abs(delta) > {LIMIT} AS hit FROM d)
SELECT frame, sum(CASE WHEN hit THEN 0 ELSE v END) AS red, sum(CASE WHEN hit THEN 128 ELSE v END) AS green, sum(CASE WHEN hit THEN 255 ELSE v END) AS blue FROM f GROUP BY frame""")
def recolored_picture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The picture of differences in a caller's colour, given as text."""
    pic = pixeldiff.picture(plain_status(spark, sf_dir), diff=color.parse_rgb("0, 128, 255"))
    return pic.groupBy("frame").agg(F.sum("r").alias("red"), F.sum("g").alias("green"), F.sum("b").alias("blue"))


@query("evaluation_modes", f"""WITH {boxes_of.BOXES_SQL}, t AS (SELECT * FROM truth WHERE box.width * box.height >= 120), f AS (SELECT * FROM found WHERE box.width * box.height >= 120),
b AS (SELECT t."case", t.id, t.type = f.type AS same FROM t JOIN f ON t."case" = f."case" AND t.id = f.id)
SELECT 'classifier' AS mode, (SELECT count(*) FROM b) AS matched, (SELECT count(*) FROM b WHERE NOT same) AS wrong_type, (SELECT count(*) FROM t WHERE id NOT IN (SELECT id FROM b)) AS missed, (SELECT count(*) FROM f WHERE id NOT IN (SELECT id FROM b)) AS extra""")
def evaluation_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types of larger boxes that are taken as given; matching by overlap is outcome_totals."""
    return dispatch.evaluated(*boxes_of.boxes(spark, sf_dir), "classifier", 120)
