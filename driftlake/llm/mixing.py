"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame operations only.

Each source's documents are put in a fixed random order (MD5 of the id) and its words cut into blocks
of equally many words.  Slot i of the mix draws source s where frac((i + 1/2) * golden ratio) falls into
s's part of the cumulative targets; the k-th slot of a source takes the k-th block of its stream, which
repeats at most `max_epochs` times.  A source has as many blocks as its target needs, and the last is trimmed: it gives its target,
rounded up to a word, whatever the corpus's size.  Blocks without a slot of their own, as of sources smaller than a
block, share slots at even distances.

Everything that is ordered is ordered within small groups (source and hash prefix) with offsets summed
above them, so that a source with a third of all documents is not sorted in one task.  The number of slots is a
parameter: blocks grow with the corpus, the schedule does not, and sources beyond that number share slots.  The table of sources has a row for each source.

Defined cases: a null text has no words and is never taken; a null source is a source, the last one; rows with
the same id are told apart by source and text, and rows equal in all three are drawn like any others; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlake.llm.quality_rules import words
from driftlake.llm.tables import kept

SLOTS = 100_000
MAX_EPOCHS = 3
GOLDEN = 0.6180339887498949  # the golden ratio's fractional part
CELLS = 1024  # of the unit interval, by which points and sources meet
PREFIX = 3  # hex digits of the order key that make a group


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> DataFrame:
    return docs.select(
        F.col(id_col).alias("_id"),
        F.col(source_col).alias("_source"),
        F.size(words(F.col(text_col))).cast("long").alias("_size"),
        F.md5(F.concat(F.lit("mix:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))).alias("_ord"),
        F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")))).alias("_key"),
    )


def _targets(totals: DataFrame, weights: tuple[float, ...], max_epochs: int) -> DataFrame:
    """Adds _target and _total: shares by weight, capped at max_epochs sizes, the excess dealt to the others by weight."""
    everything = Window.partitionBy(F.lit(0))
    by_name = everything.orderBy(F.col("_source").asc_nulls_last())
    pick: Column = F.lit(float(weights[-1]))
    for i, w in enumerate(weights[:-1]):
        pick = F.when(F.pmod(F.col("_rank"), F.lit(len(weights))) == i, F.lit(float(w))).otherwise(pick)
    t = totals.withColumn("_rank", F.row_number().over(by_name) - 1).withColumn("_weight", pick)
    t = t.withColumn("_total", F.sum("_source_size").over(everything)).withColumn("_cap", F.col("_source_size").cast("double") * max_epochs)
    by_fill = everything.orderBy((F.col("_cap") / F.col("_weight")).asc(), F.col("_rank").asc())
    t = t.withColumn("_before", F.coalesce(F.sum("_cap").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    t = t.withColumn("_rest", F.sum("_weight").over(by_fill.rowsBetween(0, Window.unboundedFollowing)))
    t = t.withColumn("_level", (F.col("_total") - F.col("_before")) / F.col("_rest")).withColumn("_capped", F.col("_cap") <= F.col("_weight") * F.col("_level"))
    level = F.min(F.when(~F.col("_capped"), F.struct("_before", "_level"))).over(everything)["_level"]
    t = t.withColumn("_target", F.when(F.col("_capped"), F.col("_cap")).otherwise(F.col("_weight") * level))
    return t.select("_source", "_rank", "_source_size", "_total", "_target")


def _streams(sized: DataFrame) -> DataFrame:
    """Adds _start: the words before the document in its source's order."""
    d = sized.withColumn("_group", F.substring("_ord", 1, PREFIX))
    sums = d.groupBy("_source", "_group").agg(F.sum("_size").alias("_sum"))
    earlier = Window.partitionBy("_source").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("_source").alias("_s"), F.col("_group").alias("_g"), F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"))
    inner = Window.partitionBy("_source", "_group").orderBy("_ord", "_id", "_size", "_key").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_inner", F.coalesce(F.sum("_size").over(inner), F.lit(0)))
    return d.join(sums, d["_source"].eqNullSafe(sums["_s"]) & (d["_group"] == sums["_g"])).withColumn("_start", F.col("_base") + F.col("_inner")).drop("_s", "_g", "_base", "_inner")


def schedule(sources: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(_rank, _k, _slot): the k-th block of source _rank goes to slot _slot of the mix."""
    block = _block(slots)
    everything = Window.partitionBy(F.lit(0))
    edges = sources.withColumn("_hi", F.sum("_target").over(everything.orderBy("_rank").rowsBetween(Window.unboundedPreceding, 0)) / F.col("_total"))
    edges = edges.withColumn("_lo", F.coalesce(F.lag("_hi").over(everything.orderBy("_rank")), F.lit(0.0)))
    edges = edges.withColumn("_hi", F.when(F.col("_rank") == F.max("_rank").over(everything), F.lit(2.0)).otherwise(F.col("_hi")))
    edges = edges.filter("_hi > _lo AND _total > 0").select("_rank", "_lo", "_hi", (F.col("_total") / block).alias("_used"))
    cell = lambda x: F.least(F.floor(x * CELLS), F.lit(CELLS - 1)).cast("long")
    edges = edges.withColumn("_cell", F.explode(F.sequence(cell(F.col("_lo")), cell(F.col("_hi")))))
    points = sources.sparkSession.range(slots).select(F.col("id").alias("_slot"), ((F.col("id") + F.lit(0.5)) * F.lit(GOLDEN)).alias("_x"))
    points = points.withColumn("_x", F.col("_x") - F.floor("_x")).withColumn("_cell", cell(F.col("_x")))
    drawn = points.join(edges, "_cell").filter("_x >= _lo AND _x < _hi AND _slot < _used")
    k = F.row_number().over(Window.partitionBy("_rank").orderBy("_slot")) - 1
    drawn = drawn.select("_rank", k.cast("long").alias("_k"), "_slot")
    wanted = sources.filter("_target > 0").select("_rank", F.ceil(_quota() / block).alias("_n"), F.ceil(F.col("_total") / block).alias("_used"))
    wanted = wanted.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_n") - 1)))
    even = F.floor((F.col("_k") + F.lit(0.5)) / F.col("_n") * F.col("_used"))
    return wanted.join(drawn, ["_rank", "_k"], "left").select("_rank", "_k", F.coalesce("_slot", even).alias("_slot"))


def _block(slots: int) -> Column:
    """Words in a block: as many as share all words out over at most `slots` slots."""
    return F.greatest(F.lit(1), F.expr(f"(_total + {slots - 1}) div {slots}"))


def _quota() -> Column:
    """A source's target in whole words."""
    return F.ceil("_target").cast("long")


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (1, 2, 3), slots: int = SLOTS, max_epochs: int = MAX_EPOCHS) -> tuple[DataFrame, DataFrame]:
    """The documents with sizes and targets, and the taken pieces: (_ord, _id, _key, _source, _start, _rank, _size, _epoch, _slot, _words)."""
    sized = kept(_sized(docs, id_col, text_col, source_col))
    totals = sized.groupBy("_source").agg(F.sum("_size").alias("_source_size"))
    sources = _targets(totals, weights, max_epochs)
    streams = _streams(sized)
    s = sources.withColumnRenamed("_source", "_s")
    all_docs = streams.join(s, streams["_source"].eqNullSafe(s["_s"])).drop("_s")
    copies = all_docs.filter("_size > 0").withColumn("_epoch", F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1))))
    copies = copies.withColumn("_block", _block(slots)).withColumn("_from", F.col("_start") + F.col("_epoch") * F.col("_source_size"))
    copies = copies.withColumn("_upto", F.least(F.col("_from") + F.col("_size"), _quota())).filter("_from < _upto")
    copies = copies.withColumn("_k", F.explode(F.sequence(F.expr("_from div _block"), F.expr("(_upto - 1) div _block"))))
    overlap = F.least(F.col("_upto"), (F.col("_k") + 1) * F.col("_block")) - F.greatest(F.col("_from"), F.col("_k") * F.col("_block"))
    copies = copies.select("_ord", "_id", "_key", "_source", "_start", "_rank", "_size", "_epoch", "_k", overlap.alias("_words"))
    return all_docs, copies.join(schedule(sources, slots), ["_rank", "_k"])


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (1, 2, 3), slots: int = SLOTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """For every row: id_col, size (words), source_size, target (words wanted of its source), taken (words the mix takes of it)."""
    all_docs, got = pieces(docs, id_col, text_col, source_col, weights, slots, max_epochs)
    key = ["_rank", "_start", "_id", "_size"]
    sums = got.groupBy(*key).agg(F.sum("_words").alias("_taken")).select(*[F.col(c).alias(f"k{c}") for c in key], "_taken")
    same = (F.col("_rank") == F.col("k_rank")) & (F.col("_start") == F.col("k_start")) & F.col("_id").eqNullSafe(F.col("k_id")) & (F.col("_size") == F.col("k_size"))
    out = all_docs.join(sums, same, "left")
    return out.select(F.col("_id").alias(id_col), F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), F.coalesce("_taken", F.lit(0).cast("long")).alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (1, 2, 3), slots: int = SLOTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The mix itself, with docs' columns: a row for each time that a document is drawn, up to max_epochs times, and
    cut to its first words where the source's last block ends within it.  Rows equal in id, source and text share their draws."""
    _, got = pieces(docs, id_col, text_col, source_col, weights, slots, max_epochs)
    draws = got.groupBy("_rank", "_start", "_id", "_size", "_epoch").agg(F.first("_key").alias("_key"), F.first("_source").alias("_src"), F.sum("_words").alias("_take"))
    draws = draws.select(F.col("_id").alias("_mix_id"), F.col("_src").alias("_mix_source"), F.col("_key").alias("_mix_text"), F.col("_size").alias("_mix_size"), F.col("_take").alias("_mix_take"))
    texts = docs.withColumn("_mix_key", F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit(""))))).dropDuplicates([id_col, source_col, "_mix_key"])
    drawn = texts.join(draws, F.col(id_col).eqNullSafe(F.col("_mix_id")) & F.col(source_col).eqNullSafe(F.col("_mix_source")) & (F.col("_mix_key") == F.col("_mix_text")))
    cut = F.array_join(F.slice(words(F.col(text_col)), 1, F.col("_mix_take").cast("int")), " ")
    drawn = drawn.withColumn(text_col, F.when(F.col("_mix_take") < F.col("_mix_size"), cut).otherwise(F.col(text_col)))
    if "n_chars" in docs.columns:
        drawn = drawn.withColumn("n_chars", F.length(text_col).cast(docs.schema["n_chars"].dataType))
    return drawn.select(docs.columns)


QUERY_SQL = rf"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
                  md5(concat('mix:', coalesce(CAST(doc_id AS VARCHAR), ''))) AS ord FROM documents),
t AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank, CAST(sum(source_size) OVER () AS BIGINT) AS total, {MAX_EPOCHS} * CAST(source_size AS DOUBLE) AS cap FROM t),
w AS (SELECT *, 1.0::DOUBLE + rank % 3 AS weight FROM r),
f AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
             sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest FROM w),
g AS (SELECT *, (total - before) / rest AS level, cap <= weight * ((total - before) / rest) AS capped FROM f),
h AS (SELECT *, CASE WHEN capped THEN cap ELSE weight * (SELECT arg_min(level, before) FROM g WHERE NOT capped) END AS target FROM g),
q AS (SELECT *, CAST(ceil(target) AS BIGINT) AS quota FROM h),
s AS (SELECT doc_id, d.source, size, coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY ord, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM d)
SELECT doc_id, size, source_size, target,
       CAST((SELECT sum(greatest(0, least(start + size + ep * source_size, quota) - (start + ep * source_size))) FROM range({MAX_EPOCHS}) v(ep)) AS BIGINT) AS taken
FROM s JOIN q ON s.source IS NOT DISTINCT FROM q.source
"""
