"""Image pairs derived from the embeddings table: 32 x 32 RGBA frames in exploded form, one row for each pixel.

Sixteen embeddings make a frame: each fills an 8 x 8 tile with its 64 values; the first ones fill up the last frame.  The second image of a pair differs in a block
(four frames of five) whose strength varies with the frame, and in a sparse grid of slight changes elsewhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SIDE = 32
TASK_TILES = 4000  # embeddings whose pixels, 64 each, one task holds


def parts(spark: SparkSession, n: int) -> int:
    """How many parts n embeddings are dealt into: as many as their number asks for, so that no task's rows grow with the table, and enough for all cores."""
    return max(-(-n // TASK_TILES), min(spark.sparkContext.defaultParallelism, -(-n // 16)), 1)


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(frame, x, y, r, g, b, a): the first images."""
    source = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    n = source.count()
    source = source.select("vec_id", "embedding")
    again = source.filter(F.col("vec_id") < -n % 16).withColumn("vec_id", F.col("vec_id") + n)  # the first tiles fill up the last frame
    e = source.unionByName(again).select("vec_id", F.posexplode("embedding").alias("i", "v"))
    tile = F.col("vec_id") % 16
    level = F.greatest(F.lit(0), F.least(F.lit(255), F.floor((F.col("v").cast("double") + 0.5) * 255))).cast("int")
    px = e.select(
        F.floor(F.col("vec_id") / 16).alias("frame"),
        ((tile % 4) * 8 + F.col("i") % 8).cast("int").alias("x"),
        (F.floor(tile / 4) * 8 + F.floor(F.col("i") / 8)).cast("int").alias("y"),
        level.alias("r"),
    )
    px = px.withColumn("g", 255 - F.col("r")).withColumn("b", (F.col("r") + 85) % 256)
    px = px.repartition(parts(spark, n), "frame")  # once: what follows groups by the frame, or by the frame and a row or column
    return px.withColumn("a", F.when((F.col("x") + F.col("y") + F.col("frame")) % 13 == 0, 128 + F.expr("r div 2")).otherwise(255).cast("int"))


def _edits(r, g) -> list:
    f, x, y = F.col("frame"), F.col("x"), F.col("y")
    block = (x >= 8 + f % 8) & (x <= 17 + f % 8) & (y >= 6 + f % 5) & (y <= 13 + f % 5)
    changed = f % 5 != 0
    grid = (x * 7 + y * 13 + f) % 11 == 0
    return [
        F.when(changed & block, (r + 20 + f % 90) % 256).when(changed & grid, F.least(F.lit(255), r + 3)).otherwise(r).cast("int"),
        F.when(changed & block, (g + 40) % 256).otherwise(g).cast("int"),
    ]


def edited(px: DataFrame) -> DataFrame:
    """The second image of every frame."""
    r, g = _edits(F.col("r"), F.col("g"))
    return px.select("frame", "x", "y", r.alias("r"), g.alias("g"), "b", "a")


def frame_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(frame, x, y, r1..a1, r2..a2).  The second image is a function of the first's row, so no join is needed."""
    px = frames(spark, sf_dir)
    r, g = _edits(F.col("r"), F.col("g"))
    return px.select("frame", "x", "y", *[F.col(c).alias(f"{c}1") for c in "rgba"], r.alias("r2"), g.alias("g2"), F.col("b").alias("b2"), F.col("a").alias("a2"))


def pair(first: DataFrame, second: DataFrame, keys: tuple[str, ...] = ("frame", "x", "y")) -> DataFrame:
    """Two tables of pixels side by side."""
    one = first.withColumnsRenamed({c: f"{c}1" for c in "rgba"})
    two = second.withColumnsRenamed({c: f"{c}2" for c in "rgba"})
    return one.join(two, list(keys))


FRAMES_SQL = """
vn AS (SELECT count(*) AS n FROM embeddings),
ve AS (SELECT vec_id, embedding FROM embeddings UNION ALL SELECT vec_id + n, embedding FROM embeddings, vn WHERE vec_id < (16 - n % 16) % 16),
e AS (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM ve),
fa AS (SELECT vec_id // 16 AS frame, CAST((vec_id % 16 % 4) * 8 + i % 8 AS INT) AS x, CAST((vec_id % 16 // 4) * 8 + i // 8 AS INT) AS y,
       CAST(greatest(0, least(255, floor((CAST(v AS DOUBLE) + 0.5) * 255))) AS INT) AS r FROM e),
fb AS (SELECT frame, x, y, r AS r1, 255 - r AS g1, (r + 85) % 256 AS b1,
       CASE WHEN (x + y + frame) % 13 = 0 THEN 128 + r // 2 ELSE 255 END AS a1,
       x BETWEEN 8 + frame % 8 AND 17 + frame % 8 AND y BETWEEN 6 + frame % 5 AND 13 + frame % 5 AS blk FROM fa),
px AS (SELECT frame, x, y, r1, g1, b1, a1,
       CASE WHEN frame % 5 = 0 THEN r1 WHEN blk THEN (r1 + 20 + frame % 90) % 256 WHEN (x * 7 + y * 13 + frame) % 11 = 0 THEN least(255, r1 + 3) ELSE r1 END AS r2,
       CASE WHEN frame % 5 <> 0 AND blk THEN (g1 + 40) % 256 ELSE g1 END AS g2, b1 AS b2, a1 AS a2 FROM fb)
"""
