"""Tables that come and go as files: manifests of entries, rated data sets, masks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from driftlake.operators.evaluation import rated_pairs


def save(entries: DataFrame, path: str) -> None:
    """A manifest as JSON lines, an entry a line."""
    entries.write.option("ignoreNullFields", "true").json(path)


def load(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Entries of a manifest of JSON lines; lines that are no entry stop the load."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def load_document(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Entries of a manifest that is one JSON document, {"entries": [...]}."""
    whole = StructType([StructField("entries", ArrayType(schema))])
    return spark.read.schema(whole).option("multiLine", "true").json(path).select(F.explode("entries").alias("e")).select("e.*")


def rated_table(spark: SparkSession, path: str, image: str = "dist_img", rating: str = "dmos", folds: int = 5) -> DataFrame:
    """(path, rated, reference, distortion, level, fold) of a CSV of images named like I07_12_03.png; other rows are left out."""
    rows = spark.read.option("header", "true").csv(path).select(F.col(image).alias("path"), F.col(rating).cast("double").alias("rated"))
    return rated_pairs(rows, folds)


def mask_boxes(pixels: DataFrame, key: str = "mask") -> DataFrame:
    """(key, bx, by, bw, bh): what encloses a mask's pixels (key, x, y, inside); a mask without any has no box."""
    ends = pixels.filter("inside").groupBy(key).agg(F.min("x").alias("bx"), F.min("y").alias("by"), F.max("x").alias("_x"), F.max("y").alias("_y"))
    return ends.select(key, "bx", "by", (F.col("_x") - F.col("bx") + 1).alias("bw"), (F.col("_y") - F.col("by") + 1).alias("bh"))
