"""Commands: ``python -m driftlake compare`` for a table of image pairs, ``run`` for a named query, ``list`` for the names.

compare reads rasters (key, width, height, one, two) or bands of them (also y, lines) from Parquet, writes a row for each image, and ends with 1 if
one of them differs, as reports.exit_codes has it: by any pixel, or by a similarity under 0.95; a distance differs if it isn't 0, and an image
without a score differs.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlake.operators import tiles
from driftlake.operators.reports import SSIM_LEAST

METHODS = {"pixels": tiles.compare, "ssim": tiles.ssim, "msssim": tiles.ms_ssim, "perceptual": tiles.perceptual_ssim, "gmsd": tiles.gmsd}


def compare(images: DataFrame, method: str = "pixels", key: str = "frame", **options) -> DataFrame:
    """What tiles.<method> says of rasters or bands, with `differs`."""
    if method not in METHODS:
        raise ValueError(f"method is one of {', '.join(METHODS)}, not {method!r}")
    bands = images if {"y", "lines"} <= set(images.columns) else tiles.whole(images, key)
    out = METHODS[method](bands, key=key, **options)
    if method == "pixels":
        return out.withColumn("differs", F.col("diff_count") > 0)
    good = F.col("gmsd") == 0 if method == "gmsd" else F.col("score") >= SSIM_LEAST
    return out.withColumn("differs", ~F.coalesce(good, F.lit(False)))


def main(arguments: list[str], spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="driftlake")
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("compare", help="compare image pairs")
    one.add_argument("images")
    one.add_argument("out")
    one.add_argument("--method", choices=METHODS, default="pixels")
    one.add_argument("--threshold", type=float, help="of pixels, 0 to 1")
    one.add_argument("--include-aa", action="store_true", help="count anti-aliased pixels, too")
    one.add_argument("--key", default="frame")
    run = commands.add_parser("run", help="run a named query over a folder of tables")
    run.add_argument("query")
    run.add_argument("tables")
    run.add_argument("out")
    commands.add_parser("list", help="names of queries")
    given = parser.parse_args(arguments)
    from driftlake.plans import registry

    if given.command == "list":
        print("\n".join(sorted(registry.QUERIES)))
        return 0
    if given.command == "run" and given.query not in registry.QUERIES:
        parser.error(f"there is no query {given.query!r}")
    spark = spark or SparkSession.builder.getOrCreate()
    if given.command == "run":
        registry.QUERIES[given.query](spark, given.tables).write.parquet(given.out)
        return 0
    options: dict = {"include_aa": given.include_aa} if given.method == "pixels" else {}
    if given.threshold is not None and given.method == "pixels":
        options["threshold"] = given.threshold
    compare(spark.read.parquet(given.images), given.method, given.key, **options).write.parquet(given.out)
    return 0 if spark.read.parquet(given.out).filter("differs").isEmpty() else 1


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
