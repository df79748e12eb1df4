"""Deep differences of nested records.

Two tables of JSON documents meet once, by key.  From there on everything is narrow: a frontier of paths at which both
sides hold unequal containers of one kind is opened level by level, members of objects by name and elements of
arrays by index, and equal subtrees below the documents are dropped before they are opened.  Two levels are opened at a time; the differences found and
what is left of the frontier are then written to the shared folder, so the plan does not grow with the depth.

A difference is (key, type, path, value, old_value): type 0 created, 1 removed, 2 changed; path elements are (key, idx), one of
them null; values are JSON.  An added or removed subtree is one difference.  Numbers are compared as doubles;
a null member differs from a missing one; an object in an array's place is one change.

Defined cases: a null document counts as JSON null; a key on one side alone gives one difference with an empty path; null
keys match nothing; malformed JSON is an error of the task that reads it; repeated keys are paired with each other.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftlake.sources.scratch import kept

CREATE, REMOVE, CHANGE = 0, 1, 2
PATH = "array<struct<key:string,idx:int>>"
MEMBERS = """transform(array_union(map_keys(coalesce(ma, map())), map_keys(coalesce(mb, map()))), n -> named_struct('key', n, 'idx', CAST(NULL AS INT),
    'in_a', map_contains_key(ma, n), 'in_b', map_contains_key(mb, n), 'a', element_at(ma, n), 'b', element_at(mb, n)))"""
ELEMENTS = """transform(slice(sequence(0, greatest(size(la), size(lb))), 1, greatest(size(la), size(lb))), i -> named_struct('key', CAST(NULL AS STRING), 'idx', i,
    'in_a', i < size(la), 'in_b', i < size(lb), 'a', get(la, i), 'b', get(lb, i)))"""


def kind_of(json: Column) -> Column:
    c = F.substring(json, 1, 1)
    return F.when(c == "{", "object").when(c == "[", "array").when(c == '"', "string").when(c.isin("t", "f"), "boolean").when(c == "n", "null").otherwise("number")


def _both_open() -> Column:
    return F.col("in_a") & F.col("in_b") & (F.col("ka") == F.col("kb")) & F.col("ka").isin("object", "array")


def _once(df: DataFrame) -> DataFrame:
    """The fields of the struct `_made` as columns.  Exploded, they are made once a row; as mere columns they'd be made anew in every filter and column that uses them."""
    return df.select(*[c for c in df.columns if c != "_made"], F.inline(F.array("_made")))


def _typed(df: DataFrame) -> DataFrame:
    """(key, path, type, a, b, ta, tb): a difference has a type and its sides' JSON; containers of one kind have none yet, and keep both sides."""
    new, opened = F.col("type").isNull(), F.col("type").isNull() & _both_open()
    kind = F.when(~F.col("in_a"), CREATE).when(~F.col("in_b"), REMOVE).otherwise(CHANGE)
    sides = [F.when(opened, F.col(s)).alias(s) for s in ("a", "b")]
    texts = [F.when(~opened & (~new | F.col(f"in_{s}")), F.col(f"t{s}")).alias(f"t{s}") for s in ("a", "b")]
    return df.select("key", "path", F.coalesce("type", F.when(~opened, kind)).alias("type"), *sides, *texts)


def _judged(df: DataFrame, write: Column) -> DataFrame:
    """Without the pairs that are equal; differences found before stay.  Sides get their JSON where `write` holds, and have a text elsewhere."""
    new = F.col("type").isNull()
    texts = {s: F.when(write, F.coalesce(F.to_json(s), F.lit("null"))).otherwise(F.col(f"t{s}")) for s in ("a", "b")}
    df = _once(df.select("key", "path", "type", "in_a", "in_b", "a", "b", F.struct(*[t.alias(f"t{s}") for s, t in texts.items()]).alias("_made")))
    for s in ("a", "b"):
        df = df.withColumn(f"k{s}", kind_of(F.col(f"t{s}")))
    numbers = (F.col("ka") == "number") & (F.col("kb") == "number")
    differ = F.when(numbers, ~F.try_variant_get("a", "$", "double").eqNullSafe(F.try_variant_get("b", "$", "double"))).otherwise(F.col("ta") != F.col("tb"))
    return _typed(df.filter(~new | ~F.col("in_a") | ~F.col("in_b") | differ))


def _opened(level: DataFrame) -> DataFrame:
    """The differences found so far, and of every pair of containers the members that differ."""
    new = F.col("type").isNull()
    parts = [F.expr(f"try_variant_get({s}, '$', '{kind}')").alias(f"{name}{s}") for s in ("a", "b") for name, kind in (("m", "map<string,variant>"), ("l", "array<variant>"))]
    level = _once(level.select("key", "path", "type", "ta", "tb", F.struct(*parts).alias("_made")))
    members = F.when(F.col("ma").isNotNull(), F.expr(MEMBERS)).when(new, F.expr(ELEMENTS))
    each = level.select("key", "path", "type", "ta", "tb", F.explode_outer(members).alias("c")).filter("type IS NOT NULL OR c IS NOT NULL")
    path = F.when(new, F.concat("path", F.array(F.struct("c.key", "c.idx")))).otherwise(F.col("path")).cast(PATH)
    return _judged(each.select("key", path.alias("path"), "type", "c.in_a", "c.in_b", "c.a", "c.b", "ta", "tb"), new)


def _sides(df: DataFrame, key: str, **docs: str) -> DataFrame:
    """Documents, and their texts without leading white space."""
    made = [c for s, doc in docs.items() for c in (F.parse_json(doc).alias(s), F.ltrim(F.coalesce(F.col(doc), F.lit("null")), F.lit(" \t\n\r")).alias(f"t{s}"), F.lit(True).alias(f"in_{s}"))]
    return _once(df.select(F.col(key).alias("key"), F.struct(*made).alias("_made")))


def deep_diff(old: DataFrame, new: DataFrame, key: str = "key", doc: str = "doc") -> DataFrame:
    """All differences between the JSON documents of two tables."""
    both = _sides(old, key, a=doc).join(_sides(new, key, b=doc), "key", "full")
    return _deep(both.withColumns({c: F.coalesce(c, F.lit(v)) for s in ("a", "b") for c, v in ((f"in_{s}", False), (f"t{s}", "null"))}), key)


def deep_diff_pairs(pairs: DataFrame, key: str = "key", old: str = "old", new: str = "new") -> DataFrame:
    """All differences between the two JSON documents of every row."""
    return _deep(_sides(pairs, key, a=old, b=new), key)


def _deep(both: DataFrame, key: str) -> DataFrame:
    # documents that are opened need not be written as JSON; their kind is told by their texts
    for s in ("a", "b"):
        both = both.withColumn(f"k{s}", kind_of(F.col(f"t{s}")))
    both = both.withColumn("path", F.array().cast(PATH)).withColumn("type", F.lit(None).cast("int"))
    level, found = _judged(both, ~_both_open()), []
    while True:
        level = kept(_opened(_opened(level)))
        found.append(level.filter("type IS NOT NULL"))
        level = level.filter("type IS NULL")
        if level.isEmpty():
            break
    out = reduce(DataFrame.unionByName, found)
    return out.select(F.col("key").alias(key), "type", "path", F.col("tb").alias("value"), F.col("ta").alias("old_value"))


def path_text(path: str = "path") -> Column:
    """A path as text, such as $.lines[0].qty."""
    step = lambda p: F.when(p["idx"].isNull(), F.concat(F.lit("."), p["key"])).otherwise(F.concat(F.lit("["), p["idx"].cast("string"), F.lit("]")))
    return F.concat(F.lit("$"), F.array_join(F.transform(path, step), ""))


def rich_equal(kind: Column, one: Column, two: Column) -> Column:
    """Are two values equal that JSON writes as text?  Dates by their instant, and equal where neither is one; numbers by value; patterns
    by source and flags; other texts as they are."""
    instant = lambda c: F.try_to_timestamp(c)
    return F.when(kind == "date", instant(one).eqNullSafe(instant(two))).when(kind == "number", one.try_cast("double") == two.try_cast("double")).otherwise(one == two)
