"""Sharding along a Hilbert curve.

Source, language and size are each quantised to 16 steps (sources and languages by their cumulated share of
rows in code-point order, sizes by their logarithm); a row's place is the Hilbert index of that cell, then the
MD5 of its text, then its id.  Runs of near-equal bytes along that order are the shards, so a filter on
any of the dimensions touches few of them.

Rows with equal texts take the metadata of the least of them and stand together; they stay in one shard unless they
hold more than SPLIT of a shard's bytes, in which case they are cut like any other run: the law is near-equal bytes, and a group kept
whole makes shards unequal by up to its size.  Ranks and byte offsets
are sums over four levels (curve index, hash prefix, text and id residue, row), so no task ever orders the
whole table or a whole group of copies.

Defined cases: a null text counts as empty (size 1); null sources and languages come last; a null id
orders first; rows equal in every respect take neighbouring slots.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlake.llm.tables import kept

BITS, DIMS = 4, 3
SPLIT = 0.05
RESIDUES = 37


def hilbert_index(point: tuple[int, ...], bits: int) -> int:
    """The place of a cell on the Hilbert curve through the cube of side 2**bits (Skilling's transposed form)."""
    x, n = list(point), len(point)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            if x[i] & q:
                x[0] ^= p
            else:
                t = (x[0] ^ x[i]) & p
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, 1 << (bits - 1)
    while q > 1:
        if x[n - 1] & q:
            t ^= q - 1
        q >>= 1
    x = [v ^ t for v in x]
    index = 0
    for b in range(bits - 1, -1, -1):
        for v in x:
            index = index << 1 | v >> b & 1
    return index


def curve() -> list[int]:
    """Hilbert index of every cell, by cell number (source * 256 + lang * 16 + size)."""
    side = 1 << BITS
    return [hilbert_index((c // side // side, c // side % side, c % side), BITS) for c in range(side**DIMS)]


def _share(rows: DataFrame, c: str) -> DataFrame:
    """Each value of c with its step: the share of rows before it, in 16ths."""
    counts = rows.groupBy(c).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(F.lit(0)).orderBy(F.col(c).asc_nulls_last())
    before = F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = F.sum("_n").over(Window.partitionBy(F.lit(0)))
    return counts.select(F.col(c).alias(f"{c}_v"), F.floor(before * (1 << BITS) / total).cast("int").alias(f"{c}_step"))


def _before(c: str, by: list[str], order: list[str]) -> Column:
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    return F.coalesce(F.sum(c).over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def shard(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", split: float = SPLIT) -> DataFrame:
    """For every row: id_col, size, text_crc32, law ('bytes'), shard, slot (its place in the shard), grown_shard (null), curve."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("id"),
        F.col(source_col).alias("source"),
        F.col(lang_col).alias("lang"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("crc"),
        F.md5(text).alias("key"),
    )
    rows = kept(rows)  # sizes and digests: all that follows reads these, and the texts once
    groups = rows.groupBy("key").agg(F.count("*").alias("n"), F.max("size").alias("size"), F.min("source").alias("source"), F.min("lang").alias("lang"))
    cells = spread = groups
    for c in ("source", "lang"):
        steps = _share(groups, c)
        spread = spread.join(steps, spread[c].eqNullSafe(steps[f"{c}_v"])).drop(f"{c}_v")
    size_step = F.least(F.lit(15), F.floor(F.log2(F.col("size").cast("double"))).cast("int"))
    index = docs.sparkSession.createDataFrame(list(enumerate(curve())), "cell int, curve int")  # 4096 rows, a fixed number
    cells = spread.withColumn("cell", F.col("source_step") * 256 + F.col("lang_step") * 16 + size_step).join(F.broadcast(index), "cell")
    cells = cells.select("key", "curve", (F.col("n") * F.col("size")).alias("group_bytes"))

    placed = rows.join(cells, "key").withColumn("prefix", F.substring("key", 1, 2)).withColumn("residue", F.coalesce(F.pmod(F.xxhash64(F.col("id")), F.lit(RESIDUES)), F.lit(0)))
    leaf = ["curve", "prefix", "key", "residue"]
    sums = placed.groupBy(*leaf).agg(F.count("*").alias("n"), F.sum("size").alias("b"))
    level1 = sums.groupBy("curve", "prefix").agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
    level0 = level1.groupBy("curve").agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
    level0 = level0.select("curve", _before("n", [], ["curve"]).alias("n0"), _before("b", [], ["curve"]).alias("b0"), F.sum("b").over(Window.partitionBy(F.lit(0))).alias("total"))
    level1 = level1.select("curve", "prefix", _before("n", ["curve"], ["prefix"]).alias("n1"), _before("b", ["curve"], ["prefix"]).alias("b1")).join(level0, "curve")
    level2 = sums.select(*leaf, _before("n", ["curve", "prefix"], ["key", "residue"]).alias("n2"), _before("b", ["curve", "prefix"], ["key", "residue"]).alias("b2"))
    level2 = level2.withColumn("g2", F.min("b2").over(Window.partitionBy("curve", "prefix").orderBy("key").rangeBetween(0, 0)))
    level2 = level2.join(level1, ["curve", "prefix"]).select(*leaf, (F.col("n0") + F.col("n1") + F.col("n2")).alias("n_at"), (F.col("b0") + F.col("b1") + F.col("b2")).alias("b_at"), (F.col("b0") + F.col("b1") + F.col("g2")).alias("g_at"), "total")
    w = Window.partitionBy(*leaf).orderBy("id", "source", "lang")
    ranked = placed.withColumn("nth", F.row_number().over(w) - 1).join(level2, leaf)
    middle = F.when(F.col("group_bytes") * shards > F.col("total") * split, F.col("b_at") + F.col("nth") * F.col("size") + F.col("size") / 2).otherwise(F.col("g_at") + F.col("group_bytes") / 2)
    ranked = ranked.select("id", "size", "crc", "curve", (F.col("n_at") + F.col("nth")).alias("rank"), F.least(F.lit(shards - 1), F.floor(middle * shards / F.col("total"))).cast("int").alias("shard"))
    first = ranked.groupBy("shard").agg(F.min("rank").alias("first"))  # a row for each shard
    out = ranked.join(F.broadcast(first), "shard")
    return out.select(
        F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), F.lit("bytes").alias("law"), "shard", (F.col("rank") - F.col("first")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "curve"
    )
