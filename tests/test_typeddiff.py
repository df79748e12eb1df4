"""Typed differences against those of the same records as JSON."""

import json
import random

import pytest
from driftlake.operators import structdiff, typeddiff
from pyspark.sql import functions as F

KIND = "struct<a:int,b:double,s:string,inner:struct<x:int,y:array<string>>,list:array<struct<p:int,q:array<int>>>,names:map<string,struct<v:int>>,none:struct<z:int>>"


def record(rng):
    pick = lambda make: None if rng.random() < 0.15 else make()
    text = lambda: rng.choice(["", 'q"u', "é\n", "x"])
    item = lambda: (pick(lambda: rng.randint(0, 2)), pick(lambda: [rng.choice([None, 0, 1]) for _ in range(rng.randint(0, 3))]))
    return (
        pick(lambda: rng.randint(0, 3)),
        pick(lambda: rng.choice([0.5, 1.25, -0.0, 0.0])),
        pick(text),
        pick(lambda: (pick(lambda: rng.randint(0, 2)), pick(lambda: [rng.choice([None, text()]) for _ in range(rng.randint(0, 3))]))),
        pick(lambda: [rng.choice([None, item()]) for _ in range(rng.randint(0, 3))]),
        pick(lambda: {k: rng.choice([None, (rng.randint(0, 2),)]) for k in rng.sample("uvw", rng.randint(0, 3))}),
        pick(lambda: (None,)),
    )


def rows(df):
    """JSON as values: members have no order, and numbers several forms."""
    load = lambda t: None if t is None else repr(json.loads(t, parse_int=float, parse_float=lambda v: float(v) + 0.0, object_hook=lambda o: sorted(o.items())))
    return sorted((str(r["key"]), r["type"], str(r["path"]), str(load(r["value"])), str(load(r["old_value"]))) for r in df.collect())


def test_equals_the_json_form(spark):
    rng = random.Random(4)
    old = spark.createDataFrame([(i, record(rng)) for i in range(120)], f"key int, doc {KIND}")
    new = spark.createDataFrame([(i, record(rng)) for i in range(20, 140)], f"key int, doc {KIND}")
    text = lambda df: df.withColumn("doc", F.to_json("doc"))
    got = typeddiff.typed_diff(old, new)
    want = structdiff.deep_diff(text(old), text(new))
    assert rows(got) == rows(want) and got.count() > 300
    assert "BatchEvalPython" not in got._jdf.queryExecution().toString()


def test_keys_and_types(spark):
    old = spark.createDataFrame([(1, (1,)), (1, (2,)), (None, (1,)), (3, None)], "key int, doc struct<a:int>")
    new = spark.createDataFrame([(1, (1,)), (None, (1,)), (3, (1,)), (4, None)], "key int, doc struct<a:int>")
    got = [(r["key"], r["type"], r["value"], r["old_value"]) for r in typeddiff.typed_diff(old, new).collect()]
    assert sorted(got, key=str) == sorted([(1, 2, "1", "2"), (None, 1, None, '{"a":1}'), (None, 0, '{"a":1}', None), (3, 2, '{"a":1}', "null"), (4, 0, "null", None)], key=str)
    assert typeddiff.typed_diff(old.limit(0), new.limit(0)).count() == 0
    with pytest.raises(ValueError, match="has the types"):
        typeddiff.typed_diff(old, spark.createDataFrame([(1, "x")], "key int, doc string"))
