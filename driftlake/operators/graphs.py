"""Connected parts of a graph that is a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftlake.sources.scratch import dropped, kept


def _stars(edges: DataFrame, keys: list[str], upward: bool) -> DataFrame:
    """Edges (keys, u, v) with u > v anew: each node's neighbours are tied to the least of them and the node.  Upward, only its greater neighbours
    are; downward, its lesser ones and the node itself."""
    if upward:
        edges = edges.unionByName(edges.select(*keys, F.col("v").alias("u"), F.col("u").alias("v")))
    least = edges.groupBy(*keys, "u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    tied = edges.join(least, [*keys, "u"])
    if upward:
        tied = tied.filter("v > u").select(*keys, F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        tied = tied.select(*keys, F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select(*keys, "e.*")
    return tied.filter("u > v").distinct()


def roots(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, u, root): of every node that has an edge (keys, u, v), the least node that it reaches; roots are left out.

    Edges turn into stars about the least nodes, by turns upward and downward, in a number of rounds that grows with the logarithm of the
    paths' lengths.  Rounds never have more than twice the edges there are."""
    tidy = edges.select(*keys, F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u > v").distinct()
    now, seen = kept(tidy), None
    while True:
        mark = tuple(now.agg(F.count("*"), F.bit_xor(F.xxhash64(*keys, "u", "v"))).first())
        if mark == seen:
            return now.withColumnRenamed("v", "root")
        seen, before = mark, now
        now = kept(_stars(_stars(now, keys, True), keys, False))
        dropped(before)
