"""I-Match fingerprints, in DataFrame expressions only.

Terms are lower-cased words.  The lexicon holds the terms that occur in a chosen band of shares of distinct texts, so that
exact copies count once; it has at most (mean distinct terms of a text) / (least share) terms however large the corpus
is, which is why it can be broadcast once that size is checked.  A document keeps its distinct lexicon terms and hashes several randomised
lexicon subsets: the subsets of level l hold each term with probability 4**-l.  A subset's hash is the exclusive or of
its terms' hashes, which like a hash over the sorted list depends on the set alone.  Sparse subsets survive
an edit that changes many terms, dense ones tell near copies apart.

Near copies by the third of all rows still lift all their terms out of the band, and other documents hold only rare or
common terms.  So every document also hashes the same subsets of all its terms; likeness uses those where one of the
two documents has fewer than FEW lexicon terms.

A fingerprint is 16 hex digits for all terms, 16 for each lexicon subset ('-' for an empty one, and for all of a document
with fewer than FEW lexicon terms) and 16 for each subset of all terms, joined by commas.

The edited text of a document needs the next document in descending id order.  Rows are dealt into id
ranges once; the largest id of each range is copied to the range above, so every step after that (next text, terms,
subset hashes, next fingerprint) stays within its range without another shuffle of texts.

Defined cases: a null text is empty; equal fingerprints have likeness 1; an empty table gives no rows; rows with
the same id follow one another by the MD5 of their texts, descending; null ids come last, in a fixed order of their texts; ids may be
of any type that can be ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftlake.llm.quality_rules import SEPARATORS
from driftlake.llm.tables import kept, parts

BAND = (0.001, 0.2)  # shares of documents between which a term is in the lexicon
LEVELS = (1, 2, 3, 4)
SEEDS = 10
FEW = 8  # lexicon terms below which a document is compared by all its terms
BROADCAST_TERMS = 2_000_000  # beyond it the lexicon is joined by a shuffle
BROADCAST_COPIES = 200_000  # likewise for the texts that have copies
RANGE_SAMPLE = 40  # ids for each range, from which the ranges' cuts are taken


def terms(text: Column) -> Column:
    return F.array_distinct(F.array_remove(F.split(F.lower(text), SEPARATORS), ""))


def lexicon(docs: DataFrame, text_col: str = "text", band: tuple[float, float] = BAND, index: DataFrame | None = None) -> DataFrame:
    """Hashes of the terms whose share of distinct texts lies in the band; index: docs' column md5, if it is at hand already."""
    docs = docs.select(F.col(text_col).alias("text"), F.unhex(F.md5(F.coalesce(F.col(text_col), F.lit("")))).alias("md5"))
    index = docs if index is None else index
    copied = kept(index.groupBy("md5").agg(F.count("*").alias("rows")).filter("rows > 1"))
    groups, again = copied.agg(F.count("*"), F.coalesce(F.sum(F.col("rows") - 1), F.lit(0))).first()
    n = index.count() - again
    each = docs.join(F.broadcast(copied) if groups <= BROADCAST_COPIES else copied, "md5", "left")
    each = each.select((F.lit(1.0) / F.coalesce("rows", F.lit(1))).alias("weight"), F.explode(terms(F.col("text"))).alias("t")).select(F.xxhash64("t").alias("term"), "weight")
    # the copies of a text weigh 1 together: the sum is a whole number but for rounding
    return each.groupBy("term").agg(F.round(F.sum("weight")).alias("df")).filter((F.col("df") >= max(2.0, band[0] * n)) & (F.col("df") <= max(2.0, band[1] * n))).select("term")


def _subsets() -> list[tuple[int, int]]:
    return [(level, seed) for level in LEVELS for seed in range(SEEDS)]


def _odd(seed: int) -> int:
    """A fixed odd 63-bit multiplier for each seed."""
    return (0x9E3779B97F4A7C15 * (2 * seed + 3) % (1 << 63)) | 1


def subset_hashes(term: Column, known: Column) -> list[Column]:
    """Aggregates over a document's distinct terms: the hash of each randomised subset, of the lexicon's (known, null for
    others) and of all terms."""
    made = []
    for level, seed in _subsets():
        chosen = F.shiftrightunsigned(F.xxhash64(term, F.lit(seed)), 40).bitwiseAND(F.lit(4**level - 1)) == 0
        made += [F.bit_xor(F.when(chosen, known)).alias(f"s{level}_{seed}"), F.bit_xor(F.when(chosen, term)).alias(f"a{level}_{seed}")]
    return made


def fingerprint(own: Column, listed: Column) -> Column:
    """Of the subsets' hashes and the number of lexicon terms."""
    hexed = lambda c: F.lpad(F.hex(c), 16, "0")
    shown = lambda kind: [F.coalesce(hexed(F.col(f"{kind}{a}_{b}")), F.lit("-")) for a, b in _subsets()]
    known = F.when(listed >= FEW, F.concat_ws(",", *shown("s"))).otherwise(",".join("-" * len(_subsets())))
    return F.lower(F.concat_ws(",", hexed(F.coalesce(own, F.lit(0))), known, *shown("a")))


def _alike(x: Column, y: Column, start: int) -> Column:
    """Of the subset hashes from position `start` on."""
    value: Column = F.lit(None).cast("double")
    for level in LEVELS:
        at = start + LEVELS.index(level) * SEEDS
        pairs = F.arrays_zip(F.slice(x, at, SEEDS).alias("x"), F.slice(y, at, SEEDS).alias("y"))
        some = F.size(F.filter(pairs, lambda p: (p["x"] != "-") | (p["y"] != "-")))
        same = F.size(F.filter(pairs, lambda p: (p["x"] == p["y"]) & (p["x"] != "-")))
        here = F.when(some > 0, same / some)
        value = F.coalesce(here if level == LEVELS[0] else F.when(some * 2 >= SEEDS, here), value)
    return F.coalesce(value, F.lit(0.0))


def likeness(a: Column, b: Column) -> Column:
    """Of two fingerprints, 0 to 1: the share of equal subset hashes among those that either has, at the sparsest level
    at which at least half of the subsets have terms (at level 1 if none does).  There it estimates the share of terms in
    common: of lexicon terms if both documents have enough of them, else of all terms."""
    x, y = F.split(a, ","), F.split(b, ",")
    width = len(_subsets())
    known = lambda z: F.exists(F.slice(z, 2, width), lambda h: h != "-")
    value = F.when(known(x) & known(y), _alike(x, y, 2)).otherwise(_alike(x, y, 2 + width))
    return F.when(a == b, F.lit(1.0)).otherwise(F.coalesce(value, F.lit(0.0)))


def _ranges(index: DataFrame, ranges: int) -> Column:
    """Number of the id range of a row (id, md5), ascending: ranges hold about equally many rows.  Null ids lie below, dealt out by
    their texts.  Cuts come from a sample of RANGE_SAMPLE ids a range; they decide where rows are worked on, not what comes out."""
    named = index.filter("id IS NOT NULL").select("id")
    n = named.count()
    share = min(1.0, RANGE_SAMPLE * ranges / max(n, 1))
    got = sorted(x[0] for x in (named if share == 1.0 else named.sample(share, seed=1)).collect())
    cuts = sorted({got[len(got) * i // ranges] for i in range(1, ranges)}) if got else []
    kind = index.schema["id"].dataType
    below = F.size(F.filter(F.array(*[F.lit(x).cast(kind) for x in cuts]), lambda x: x < F.col("id"))) if cuts else F.lit(0)
    return F.when(F.col("id").isNull(), -1 - F.pmod(F.xxhash64("md5"), F.lit(ranges)).cast("int")).otherwise(below)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", band: tuple[float, float] = BAND) -> DataFrame:
    """For every row: id_col, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    spark = docs.sparkSession
    src = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("md5", F.unhex(F.md5("text")))
    index = kept(src.select("id", "md5"))
    words = kept(lexicon(src, "text", band, index))
    where = _ranges(index, parts(spark))
    src = src.withColumn("r", where)

    # one row a range goes to the driver: its first in the order, to be copied to the end of the next range that has rows
    heads = {h["r"]: h["top"] for h in index.withColumn("r", where).groupBy("r").agg(F.max(F.struct("id", "md5")).alias("top")).collect()}
    order = sorted(heads)
    rows = src.withColumn("copy", F.lit(False))
    if order:
        goes = {r: order[(i + 1) % len(order)] for i, r in enumerate(order)}
        kind = index.schema["id"].dataType.simpleString()
        moves = spark.createDataFrame([(r, goes[r], heads[r]["id"], heads[r]["md5"]) for r in order], f"r int, up int, top {kind}, top_md5 binary")
        copies = src.join(F.broadcast(moves), "r").filter(F.col("id").eqNullSafe(F.col("top"))).filter(F.col("md5") == F.col("top_md5")).dropDuplicates(["r"])
        rows = rows.unionByName(copies.select("id", "text", "md5", F.col("up").alias("r"), F.lit(True).alias("copy")))

    w = Window.partitionBy("r").orderBy("copy", F.col("id").desc_nulls_last(), F.col("md5").desc())
    n = F.length("text")
    k = F.floor(n / 3).cast("int")
    rows = rows.withColumn("next", F.lead("text").over(w)).withColumn("nth", F.row_number().over(w))
    rows = rows.withColumn("edited", F.concat(F.substring(F.col("text"), F.lit(1), n - k), F.substring(F.col("next"), F.lit(1), k)))
    two = F.array(F.struct(F.lit(0).alias("e"), F.col("text").alias("x"), F.lit(None).cast("binary").alias("sha")), F.struct(F.lit(1).alias("e"), F.coalesce("edited", F.lit("")).alias("x"), F.unhex(F.sha2(F.coalesce("edited", F.lit("")), 256)).alias("sha")))
    both = rows.select("r", "nth", "id", "copy", n.alias("n"), F.explode(two).alias("v")).select("r", "nth", "id", "copy", "n", "v.e", "v.sha", F.explode_outer(terms(F.col("v.x"))).alias("t"))
    each = both.withColumn("term", F.xxhash64("t")).withColumn("term", F.when(F.col("t").isNotNull(), F.col("term"))).drop("t")
    known = words.select(F.col("term").alias("known"))
    # at most (mean distinct terms) / band[0] terms, whatever the corpus holds; still, the count decides
    each = each.join(F.broadcast(known) if words.count() <= BROADCAST_TERMS else known, each["term"] == known["known"], "left")
    # what is not a number goes with the key: buffers of longs alone are aggregated in place, by hash, without a sort of all terms
    one = each.groupBy("r", "nth", "e", "id", "copy", "n", "sha").agg(F.bit_xor("term").alias("own"), F.count("known").alias("listed"), *subset_hashes(F.col("term"), F.col("known")))
    one = one.select("r", "nth", "e", "id", "copy", "n", "sha", fingerprint(F.col("own"), F.col("listed")).alias("fp"))
    follow = Window.partitionBy("r").orderBy("nth", "e")  # a text, its edited text, the next text
    doc = one.withColumns({"fe": F.lead("fp", 1).over(follow), "sha": F.lead("sha", 1).over(follow), "fn": F.lead("fp", 2).over(follow)}).filter("e = 0 AND NOT copy")
    return doc.select(
        F.col("id").alias(id_col), F.col("n").cast("long").alias("n_chars"), F.lower(F.hex("sha")).alias("edited_sha256"), F.col("fp").alias("fingerprint"), F.col("fe").alias("edited_fingerprint"), likeness(F.col("fp"), F.col("fe")).alias("near_edited"), likeness(F.col("fp"), F.col("fn")).alias("near_next")
    )
