"""Cases of verification as JSON lines, read so that a bad case is a row with its error and not a failed job.

A case names two images, a tier and the regions that are to be found:

    {"name", "img1", "img2", "tier"?, "tags"?, "regions": [{"id"?, "change_type", "expected_change_type"?, "bbox": {"x", "y", "width", "height"}?,
    "mask_path"?, "pair_id"?, "expect_in_output"?}]}

Types are given by name, or through a mapping of a data set's own names.  Masks lie in a table of their own and give boxes.

Defined cases: a line that isn't JSON, lacks a name or an image, has an unknown tier or type, a box without area, or a region with neither a box nor a mask that
is known and not empty, is a case with an error; of several errors the first in this order is told; a line that isn't JSON has the default tier; a case without a name is called after its line's
hash; names that repeat are cases of their own; blank lines are no cases.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftlake.sources.scratch import kept

TIERS = ("gate", "regression", "stress")
# Names of the types in manifests.
NAMES = {"Addition": "addition", "Deletion": "deletion", "Shift": "shift", "ColorChange": "color-change", "ContentChange": "content-change", "RenderingNoise": "rendering-noise"}
MASKS, SALTS = 100_000, 32  # so many masks are broadcast; of more, each is held so often
BOX = "struct<x:int,y:int,width:int,height:int>"
REGION = f"struct<id:string,change_type:string,expected_change_type:string,bbox:{BOX},mask_path:string,pair_id:string,tags:array<string>,expect_in_output:boolean>"
SCHEMA = f"name string, img1 string, img2 string, tier string, tags array<string>, regions array<{REGION}>, corrupt string"


def _lookup(names: dict[str, str], c):
    return F.create_map(*[F.lit(x) for kv in names.items() for x in kv])[c]


def _with_masks(each: DataFrame, masks: DataFrame) -> DataFrame:
    """Adds `_mask` to regions.  Most name no mask and many may name one: few masks go to all tasks, and of more each goes to SALTS partitions; what names
    none is dealt out by its case."""
    if masks.count() <= MASKS:
        return each.join(F.broadcast(masks), "mask_path", "left")
    salt = F.pmod(F.xxhash64("case", "nth"), F.lit(SALTS)).cast("int")
    each = each.withColumn("_salt", salt).withColumn("_none", F.when(F.col("mask_path").isNull(), F.col("case")))
    masks = masks.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).filter("mask_path IS NOT NULL").withColumn("_none", F.lit(None).cast("long"))
    same = each["mask_path"].eqNullSafe(masks["mask_path"]) & (each["_salt"] == masks["_salt"]) & each["_none"].eqNullSafe(masks["_none"])
    return each.join(masks, same, "left").drop(masks["mask_path"], masks["_salt"], masks["_none"], each["_salt"], each["_none"])


def read(spark: SparkSession, path: str, type_mapping: dict[str, str] | None = None, default_tier: str = "gate", masks: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(cases, regions): (case, name, img1, img2, tier, n_regions, error), and of cases without an error (case, id, type, box, expected, pair_id).

    `masks` has (mask, bx, by, bw, bh), as manifests.mask_boxes gives them."""
    lines = spark.read.text(path).filter("trim(value) <> ''")
    parsed = F.from_json("value", SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt"})
    rows = kept(lines.select(F.sha2("value", 256).alias("hash"), parsed.alias("c")).select("hash", "c.*").withColumn("case", F.monotonically_increasing_id()))  # numbers stay
    known = NAMES | {k: NAMES.get(v, v) for k, v in (type_mapping or {}).items()}
    rows = rows.withColumn("tier", F.lower(F.when(F.col("corrupt").isNull() & F.col("tier").isNotNull(), F.col("tier")).otherwise(default_tier)))
    each = rows.select("case", F.posexplode("regions").alias("nth", "r")).select("case", "nth", "r.*")
    each = each.withColumn("type", _lookup(known, F.coalesce("expected_change_type", "change_type"))).withColumn("declared", _lookup(known, F.col("change_type")))
    if masks is not None:
        box = F.struct(*[F.col(a).cast("int").alias(b) for a, b in (("bx", "x"), ("by", "y"), ("bw", "width"), ("bh", "height"))])
        each = _with_masks(each, masks.select(F.col("mask").alias("mask_path"), box.alias("_mask")))
    else:
        each = each.withColumn("_mask", F.lit(None).cast(BOX))
    each = each.withColumn("box", F.coalesce("bbox", "_mask"))
    problem = (
        F.when(F.col("declared").isNull() | F.col("type").isNull(), F.concat(F.lit("unknown change type "), F.coalesce("expected_change_type", "change_type", F.lit("?"))))
        .when((F.col("bbox.width") <= 0) | (F.col("bbox.height") <= 0), "box without area")
        .when(F.col("box").isNull() & F.col("mask_path").isNotNull(), F.concat(F.lit("no mask "), "mask_path"))
        .when(F.col("box").isNull(), "region without box or mask")
    )
    each = each.withColumn("problem", problem)
    worst = each.filter("problem IS NOT NULL").groupBy("case").agg(F.min_by("problem", "nth").alias("problem"))
    error = (
        F.when(F.col("corrupt").isNotNull(), "not a case")
        .when(F.col("name").isNull(), "no name")
        .when(F.col("img1").isNull() | F.col("img2").isNull(), "no image")
        .when(~F.col("tier").isin(*TIERS), F.concat(F.lit("unknown tier "), "tier"))
        .otherwise(F.col("problem"))
    )
    cases = rows.join(worst, "case", "left").select(
        "case", F.coalesce("name", F.concat(F.lit("line-"), F.substring("hash", 1, 12))).alias("name"), "img1", "img2", F.when(F.col("tier").isin(*TIERS), F.col("tier")).otherwise(default_tier).alias("tier"), F.coalesce(F.size("regions"), F.lit(0)).alias("n_regions"), error.alias("error")
    )
    fine = each.join(cases.filter("error IS NULL").select("case"), "case", "left_semi")
    return cases, fine.select("case", F.coalesce("id", F.concat(F.lit("r"), F.col("nth").cast("string"))).alias("id"), "type", "box", F.coalesce("expect_in_output", F.lit(True)).alias("expected"), "pair_id")


def totals(cases: DataFrame) -> DataFrame:
    """(tier, cases, errors, regions): a row for each tier that has a case."""
    return cases.groupBy("tier").agg(F.count("*").alias("cases"), F.count("error").alias("errors"), F.coalesce(F.sum(F.when(F.col("error").isNull(), F.col("n_regions"))), F.lit(0)).alias("regions"))
