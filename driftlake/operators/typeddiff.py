"""Deep differences of typed records, as one projection that is generated from their schema.

Both tables meet once, by key.  For every field of the schema the plan holds the comparison itself: structs by field, arrays by index,
maps by key, all else by value; so there is no JSON, no job per level and no Python.  Differences have the form that ``structdiff`` gives:
(key, type, path, value, old_value).

Defined cases: a null field is one that isn't there, as it is in JSON written from the record; a null element of an array or map is
JSON null and there; a key on one side alone gives one difference with an empty path; null keys match nothing; repeated keys are paired
with each other; NaN equals NaN, and zeros of either sign are equal.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType

from driftlake.operators.structdiff import CHANGE, CREATE, PATH, REMOVE

RECORD = f"struct<type:int,path:{PATH},value:string,old_value:string>"


def as_json(v: Column, kind: DataType) -> Column:
    """The value as JSON text; null as null."""
    if isinstance(kind, (StructType, MapType, ArrayType)):
        return F.coalesce(F.to_json(v), F.lit("null"))
    text = F.to_json(F.array(v))
    return F.substring(text, F.lit(2), F.length(text) - 2)


def _step(name: Column | None = None, index: Column | None = None) -> Column:
    return F.struct((F.lit(None).cast("string") if name is None else name.cast("string")).alias("key"), (F.lit(None).cast("int") if index is None else index.cast("int")).alias("idx"))


def _record(kind: int, path: Column, new: Column, old: Column) -> Column:
    return F.array(F.struct(F.lit(kind).alias("type"), path.cast(PATH).alias("path"), new.cast("string").alias("value"), old.cast("string").alias("old_value")).cast(RECORD))


def _none() -> Column:
    return F.array().cast(f"array<{RECORD}>")


def _fields(kind: StructType, path: list[Column], a: Column, b: Column) -> Iterator[Column]:
    for f in kind.fields:
        x, y = a.getField(f.name), b.getField(f.name)
        yield _compared(f.dataType, [*path, _step(F.lit(f.name))], x, y, x.isNotNull(), y.isNotNull())


def _inside(kind: DataType, path: list[Column], a: Column, b: Column) -> Column:
    """Differences of two values that aren't null."""
    if isinstance(kind, StructType):
        found = list(_fields(kind, path, a, b))
        return F.concat(*found) if found else _none()
    if isinstance(kind, ArrayType):
        longer = F.greatest(F.size(a), F.size(b))
        at = F.when(longer > 0, F.sequence(F.lit(0), longer - 1)).otherwise(F.array().cast("array<int>"))
        return F.flatten(F.transform(at, lambda i: _compared(kind.elementType, [*path, _step(index=i)], F.get(a, i), F.get(b, i), i < F.size(a), i < F.size(b))))
    names = F.array_union(F.map_keys(a), F.map_keys(b))
    return F.flatten(F.transform(names, lambda n: _compared(kind.valueType, [*path, _step(n)], F.element_at(a, n), F.element_at(b, n), F.map_contains_key(a, n), F.map_contains_key(b, n))))


def _compared(kind: DataType, path: list[Column], a: Column, b: Column, in_a: Column, in_b: Column) -> Column:
    """Differences of two places of one type, of which each may be missing."""
    at = F.array(*path) if path else F.array()
    x, y, none = as_json(a, kind), as_json(b, kind), F.lit(None)
    changed = _record(CHANGE, at, y, x)
    if isinstance(kind, (StructType, ArrayType, MapType)):
        both = F.when(a.isNull() & b.isNull(), _none()).when(a.isNull() | b.isNull(), changed).otherwise(_inside(kind, path, a, b))
    else:
        both = F.when(a.eqNullSafe(b), _none()).otherwise(changed)
    return F.when(in_a & in_b, both).when(in_b, _record(CREATE, at, y, none)).when(in_a, _record(REMOVE, at, none, x)).otherwise(_none())


def typed_diff(old: DataFrame, new: DataFrame, key: str = "key", doc: str = "doc") -> DataFrame:
    """All differences between the records (doc, a struct, array or map of the same type on both sides) of two tables."""
    kind = old.schema[doc].dataType
    if kind.simpleString() != new.schema[doc].dataType.simpleString():
        raise ValueError(f"{doc} has the types {kind.simpleString()} and {new.schema[doc].dataType.simpleString()}")
    sides = [df.select(F.col(key).alias("key"), F.col(doc).alias(side), F.lit(True).alias(f"in_{side}")) for df, side in ((old, "a"), (new, "b"))]
    both = sides[0].join(sides[1], "key", "full")
    found = _compared(kind, [], F.col("a"), F.col("b"), F.coalesce("in_a", F.lit(False)), F.coalesce("in_b", F.lit(False)))
    return both.select("key", F.explode(found).alias("d")).select(F.col("key").alias(key), "d.type", "d.path", "d.value", "d.old_value")
