"""Comparison by name, and evaluation by mode."""

import pytest
from driftlake.operators import dispatch


def test_unknown_names(spark):
    df = spark.createDataFrame([(1, 1, 1)], "frame int, x int, y int")
    with pytest.raises(ValueError, match="method"):
        dispatch.compare(df, "other", 1, 1)
    with pytest.raises(ValueError, match="mode"):
        dispatch.evaluated(*[spark.createDataFrame([], "case int, id int, type string, box struct<x:int,y:int,width:int,height:int>, expected boolean")] * 2, "other")


def test_modes(spark):
    schema = "case int, id int, type string, box struct<x:int,y:int,width:int,height:int>, expected boolean"
    truth = spark.createDataFrame([(1, 1, "a", (0, 0, 10, 10), True), (1, 2, "b", (50, 50, 10, 10), True), (1, 3, "a", (80, 80, 2, 2), True)], schema)
    found = spark.createDataFrame([(1, 1, "b", (60, 60, 9, 9), True), (1, 2, "b", (1, 1, 10, 10), True), (1, 9, "c", (51, 50, 10, 10), True)], schema)
    given = dispatch.evaluated(truth, found, "classifier", 50).first()
    assert (given.matched, given.wrong_type, given.missed, given.extra) == (2, 1, 0, 1)
    matched = dispatch.evaluated(truth, found, "end-to-end", 50).first()
    assert (matched.matched, matched.wrong_type, matched.missed, matched.extra) == (2, 2, 0, 1)
