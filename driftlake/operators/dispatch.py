"""Comparison by a method's name, validation of given boxes, and evaluation by mode."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlake.operators import evaluation, pixeldiff, planes, similarity

PIXELS = ("core", "core-native", "core-wasm")
SCORED = ("ssim", "msssim", "hitchhikers-ssim", "gmsd")
METHODS = PIXELS + SCORED


def _scored(pairs: DataFrame, method: str, width: int, height: int, key: str, options: dict) -> DataFrame:
    if method == "ssim":
        return planes.ssim(pairs, key=key, **options)
    if method == "msssim":
        return planes.ms_ssim(pairs, key=key, **options)
    if method == "gmsd":
        return similarity.gmsd(pairs, width, height, key=key, **options).withColumnRenamed("gmsd", "score")
    return similarity.cov_pooled(similarity.box_windows(pairs, width, height, key=key, **options), key).select(key, "score")


def compare(pairs: DataFrame, method: str, width: int, height: int, mismatched: DataFrame | None = None, key: str = "frame", **options) -> DataFrame:
    """(key, method, diff_count, diff_percentage, score): pixel methods count, the others score.  Pairs whose images differ in size
    (mismatched: key) are compared as wholly different: 100 %, score 0, or 1 where the score is a deviation."""
    if method not in METHODS:
        raise ValueError(f"method is one of {', '.join(METHODS)}, not {method!r}")
    null = lambda kind: F.lit(None).cast(kind)
    if mismatched is not None:
        pairs = pairs.join(mismatched.select(key), key, "left_anti")
    if method in PIXELS:
        status = pixeldiff.with_status(pairs, width, height, include_aa=options.get("include_aa", True), key=key)
        out = pixeldiff.summary(status, key).select(key, F.lit(method).alias("method"), F.col("diff_count").cast("long").alias("diff_count"), "diff_percentage", null("double").alias("score"))
        worst = [F.lit(width * height).cast("long").alias("diff_count"), F.lit(100.0).alias("diff_percentage"), null("double").alias("score")]
    else:
        out = _scored(pairs, method, width, height, key, options).select(key, F.lit(method).alias("method"), null("long").alias("diff_count"), null("double").alias("diff_percentage"), "score")
        worst = [null("long").alias("diff_count"), null("double").alias("diff_percentage"), F.lit(1.0 if method == "gmsd" else 0.0).alias("score")]
    return out if mismatched is None else out.unionByName(mismatched.select(key, F.lit(method).alias("method"), *worst))


def box_fault(width: int, height: int) -> Column:
    """Why a box (bx, by, bw, bh) given by a caller can't be measured; null if it can."""
    outside = (F.col("bx") < 0) | (F.col("by") < 0) | (F.col("bx") + F.col("bw") > width) | (F.col("by") + F.col("bh") > height)
    missing = F.col("bx").isNull() | F.col("by").isNull() | F.col("bw").isNull() | F.col("bh").isNull()
    return F.when(missing, "incomplete box").when((F.col("bw") <= 0) | (F.col("bh") <= 0), "empty box").when(outside, "box outside the image")


def evaluated(truth: DataFrame, found: DataFrame, mode: str, least: int = 0) -> DataFrame:
    """One row: mode, matched, wrong_type, missed, extra.  'classifier' takes found boxes as given for the truth of the same id, 'end-to-end'
    matches them by overlap; boxes under `least` pixels are left out on both sides."""
    truth, found = (evaluation.large_enough(x, least) for x in (truth, found))
    if mode == "classifier":
        both = truth.select("case", "id", F.col("type").alias("_t")).join(found.select("case", "id", F.col("type").alias("_f")), ["case", "id"])
        keys = both.select("case", "id")
        matches = both.select("case", (F.col("_t") == F.col("_f")).alias("same"))
        missed, extra = (x.join(keys, ["case", "id"], "left_anti") for x in (truth, found))
    elif mode == "end-to-end":
        matches, missed, extra = evaluation.match_cases(truth, found)
    else:
        raise ValueError(f"mode is classifier or end-to-end, not {mode!r}")
    return evaluation.outcome_totals(matches, missed, extra).withColumn("mode", F.lit(mode))
